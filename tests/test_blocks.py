"""Pairs by direction, clusters in rounds, numbers by ranges, records by groups: against plain numpy and folds."""

import os
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import tables
from quillspark.operators import aggregates, blocks, claims, resolution
from tests.test_folds import fold


def vectors(n, spread, seed=1, d=12):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True), rng.integers(0, 9, n)


@pytest.mark.parametrize("spread,least,unit", [(0.1, 0.8, True), (0.1, 0.9, False), (5, -0.2, False)])
def test_no_pair_over_the_threshold_is_lost(spark, monkeypatch, spread, least, unit):
    monkeypatch.setattr(claims, "BLOCK", 50)
    v, g = vectors(600, spread)
    if not unit:
        v = v * np.random.default_rng(2).uniform(0.2, 3, (600, 1))
        v[5] = 0
    df = spark.createDataFrame([(i, int(g[i]), x.tolist()) for i, x in enumerate(v)] + [(9000, 1, None), (9001, None, v[0].tolist())], "id long, g int, vec array<double>")
    p, apart = v @ v.T, np.triu(g[:, None] != g[None, :], 1)
    got = claims.match_pairs(df, "g", "id", "vec", least).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((int(i), int(j)) for i, j in zip(*np.nonzero((p >= least) & apart), strict=True))
    assert all(abs(r.similarity - p[r.a, r.b]) < 1e-9 and r.group_a == g[r.a] and r.group_b == g[r.b] for r in got)
    s = claims.similarity_stats(df, "g", "id", "vec", least).first()
    assert np.allclose([s.low, s.mean, s.high, s.over], [p[apart].min(), p[apart].mean(), p[apart].max(), (p[apart] >= least).sum()])


def test_cells_spare_what_is_far_apart(spark):
    v, _ = vectors(2000, 0.02, d=4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    cells = blocks.Cells(df, "vec", "id", 50)
    cells.compare(cells.bounds()[1] >= 0.95, lambda a, b: a.select(["id"]), "id long")
    assert cells.spared > 0.8
    low, high = cells.bounds()
    own = {r.id: r._cell for r in cells.placed.collect()}
    place = {c: i for i, c in enumerate(cells.cells.column("_cell").to_pylist())}
    at = np.array([place[own[i]] for i in range(len(v))])
    p = v @ v.T
    assert (low[at[:, None], at[None, :]] <= p).all() and (p <= high[at[:, None], at[None, :]]).all()


def test_rows_that_are_not_finite_or_empty_meet_all(spark, monkeypatch):
    monkeypatch.setattr(claims, "BLOCK", 10)
    rows = [(i, i % 3, [1.0, 0.1 * (i % 4)]) for i in range(60)] + [(100, 5, [float("inf"), 1.0]), (101, 6, [])]
    df = spark.createDataFrame(rows, "id long, g int, vec array<double>")
    got = claims.match_pairs(df, "g", "id", "vec", 0.5)
    assert got.where("b = 100").count() == 60 and got.where("b = 101").isEmpty()
    assert claims.match_pairs(df.limit(0), "g", "id", "vec", 0.5).isEmpty()
    assert claims.similarity_stats(df.limit(0), "g", "id", "vec", 0.5).first()[:] == (None, None, None, 0)


def test_pairs_of_one_ordinal_do_not_count(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 1, [3.0])], "id long, g int, vec array<double>")
    assert claims.similarity_stats(df, "g", "id", "vec", 2.5).first()[:] == (3.0, 3.0, 3.0, 1)


def test_clusters_in_rounds_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "BATCH", 150)
    monkeypatch.setattr(aggregates, "BLOCK", 16)
    v, _ = vectors(700, 0.3, d=8)
    rows = [("a" if i % 7 else None, 3 * i, x.tolist()) for i, x in enumerate(v)] + [("c", i, x.tolist()) for i, x in enumerate(v[:20])]
    df = spark.createDataFrame(rows, "t string, o long, vec array<double>")
    got = {(r.t, r.o): r.cluster for r in aggregates.cluster(df, "t", "o", "vec", 0.8).collect()}
    want = {}
    for t in ("a", None, "c"):
        sums = []
        for _, o, x in sorted((r for r in rows if r[0] == t), key=lambda r: r[1]):
            hit = next((k for k, s in enumerate(sums) if s @ np.array(x) / (np.linalg.norm(s) + 1e-8) >= 0.8), None)
            if hit is None:
                sums.append(np.array(x))
            else:
                sums[hit] += x
            want[t, o] = len(sums) - 1 if hit is None else hit
    assert got == want and max(want.values()) > 20


def test_numbers_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, i int")
    got = {r.i: r.n for r in tables.numbered(df, ["k"], [F.desc("x"), F.asc("i")], "n").collect()}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[i] for _, _, i in own] == list(range(1, len(own) + 1))
    assert sorted(r.n for r in tables.numbered(df, [], ["x", "i"], "n").collect()) == list(range(1, 501))
    assert tables.numbered(df.limit(0), ["k"], ["x"], "n").isEmpty()


def test_stored_tables_go(spark):
    before = tables.held(spark)
    df = tables.stored(spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and tables.held(spark) == before + 1 and os.path.exists(path)
    tables.release(spark, before)
    assert not os.path.exists(path) and tables.held(spark) == before


def test_records_merge_as_in_one_fold(spark, monkeypatch):
    monkeypatch.setattr(resolution, "TITLES", 16)
    monkeypatch.setattr(resolution, "FEW", 6)
    rng = random.Random(2)
    words = "deep graph neural learning for wireless mobile edge networks with robust federated routing of large sparse models".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(25)]
    rows = []
    for i in range(220):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        authors = [f"{a} {rng.choice(['Lee', 'kim', 'DIAZ', 'Wu', 'Ng', 'Roy'])}" for a in rng.sample("ABC", rng.randrange(0, 3))]
        rows.append({"ordinal": i, "title": " ".join(w).title() if rng.random() < 0.3 else " ".join(w), "authors": authors, "year": rng.choice([None, *range(2015, 2024)]), "source": rng.choice("xyz"), "doi": rng.choice([None] * 6 + [f"10.1/{rng.randrange(12)}"])})
    df = spark.createDataFrame([(r["ordinal"], r["title"], r["authors"], r["year"], r["source"], r["doi"], "", None, None) for r in rows], resolution.PAPER)
    got = sorted((r.ordinal, r.title, r.year, r.source, r.doi) for r in resolution.deduplicate(df).collect())
    assert got == fold(rows)
    sizes = sorted(r["count"] for r in resolution.groups(df).groupBy("component").count().collect())
    assert sizes[-1] < 220  # groups stay apart that titles alone would join


def long_titles(n, seed):
    """Titles around and above the length from which difflib leaves out popular signs, with near copies, and short and wide ones."""
    rng = random.Random(seed)
    parts = "the ing on er an re qu ly zo th en de la ver jo ex ku tion ment".split()
    out = []
    for _ in range(n):
        one = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.choice([20, 60, 75, 110, 260]))).strip()
        other = list(one)
        for _ in range(rng.choice([1, len(one) // 20, len(one) // 8])):
            other[rng.randrange(len(other))] = rng.choice("aexyz 1")
        cut = rng.randrange(len(one) // 3)
        out += [one, " ".join("".join(other).split()), one[cut:].strip(), one[: len(one) - cut].strip()]
    return list(enumerate(dict.fromkeys(out)))


@pytest.mark.parametrize("least,either", [(0.75, False), (0.75, True), (0.88, True), (0.5, False)])
def test_long_titles_found_by_seeds_are_all_pairs(least, either):
    rows = long_titles(12, 5)
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(u, v) for u, a in rows for v, b in rows if u < v and (ratio(b, a) >= least or (either and ratio(a, b) >= least))}
    assert set(resolution._alike(rows, None, least, either)) == want and len(want) > 15
    random.Random(1).shuffle(rows)
    half = {u for u, _ in rows[::2]}
    assert set(resolution._alike(rows[::2], rows[1::2], least, either)) == {(u, v) for u, v in want if (u in half) != (v in half)}
    assert (resolution._seeds([t for _, t in rows], least)[1] > 0).sum() > 15


def test_many_long_titles_meet_by_their_grams_only(monkeypatch):
    """Titles of like counts of signs and no common gram at a seed are not compared sign by sign."""
    rng = random.Random(7)
    parts = [a + b for a in "aeioutnrsl" for b in "aeioutnrsl"] + ["z", "k"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(300))) for i in range(40)]
    seen = []
    monkeypatch.setattr(resolution, "_common_long", lambda a, b: seen.append((a, b)) or 0)
    assert resolution._alike(rows, None, 0.75) == [] and len(seen) < 20


def test_pairs_that_are_not_new_or_do_not_lead_are_left_out():
    rows = [(i, f"a title of some length number {i}", bool(i % 2), bool(i % 3)) for i in range(9)]
    table = lambda rs: pa.table({"ordinal": [r[0] for r in rs], "t": [r[1] for r in rs], "new": [r[2] for r in rs], "leads": [r[3] for r in rs], "least": [0.75] * len(rs)})
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[2] or b[2]) and (a[3] or b[3])}
    assert set(resolution._meet(table(rows), None, True)) == want
    assert set(resolution._meet(table(rows[:4]), table(rows[4:]), True)) == {(u, v) for u, v in want if u < 4 <= v}
