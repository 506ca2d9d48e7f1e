"""Order-dependent operators against plain sequential folds."""

import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import aggregates, claims, fulltext, ranking, resolution
from quillspark.plans import catalogue, catalogue_reports  # noqa: F401


def tokens(s):
    return len(re.findall(r"\w+|[^\w\s]", s))


def chunks(text, most=480, overlap=96):
    out, cur = [], []
    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if x.strip()]:
        parts, pack = [], []
        if tokens(s) <= most:
            parts = [s]
        else:
            for w in s.split():
                if pack and sum(map(tokens, pack)) + tokens(w) > most:
                    parts.append(" ".join(pack))
                    pack = []
                pack.append(w)
            parts += [" ".join(pack)] if pack else []
        for p in parts:
            if cur and sum(map(tokens, cur)) + tokens(p) > most:
                out.append(" ".join(cur))
                keep, n = [], 0
                for x in reversed(cur):
                    if n + tokens(x) > overlap:
                        break
                    keep.insert(0, x)
                    n += tokens(x)
                cur = keep
            cur.append(p)
    return out + ([" ".join(cur)] if cur else [])


def test_chunks(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in catalogue.chunk_documents(spark, sf).orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert all(got.get(i, []) == chunks(t.strip()) for i, t in docs.items())


def fold(rows):
    """Greedy merging in order, written plainly."""
    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", (s or "").lower())).strip()
    kept = []
    for r in rows:
        for k in kept:
            a, b = norm(r["title"]), norm(k["title"])
            sim = SequenceMatcher(None, a, b).ratio() if a and b else 0
            years = r["year"] is not None and k["year"] is not None
            if r["doi"] and r["doi"] == k["doi"]:
                same = True
            elif sim >= 0.88:
                same = not years or abs(r["year"] - k["year"]) <= 1
            else:
                same = sim >= 0.75 and years and r["year"] == k["year"] and bool({x.split()[-1].lower() for x in r["authors"]} & {x.split()[-1].lower() for x in k["authors"]})
            if same:
                k["title"] = r["title"] if len(r["title"]) > len(k["title"]) else k["title"]
                k["authors"] = r["authors"] if len(r["authors"]) > len(k["authors"]) else k["authors"]
                k["year"] = k["year"] or r["year"]
                k["doi"] = k["doi"] or r["doi"]
                k["source"] = ", ".join(sorted(set(k["source"].split(", ") + r["source"].split(", "))))
                break
        else:
            kept.append(dict(r))
    return sorted((k["ordinal"], k["title"], k["year"], k["source"], k["doi"]) for k in kept)


def test_greedy_merge_equals_global_fold(spark):
    import random

    rng = random.Random(1)
    base = ["deep learning for wireless networks", "graph neural routing in mobile networks", "federated optimisation of edge devices", "a survey of contradiction mining"]
    rows = []
    for i in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["robust", "fast", "networks", "large"])
        rows.append({"ordinal": i, "title": " ".join(w), "authors": [rng.choice(["A Lee", "B Kim", "C Diaz"])], "year": rng.choice([2020, 2021, 2023, None]), "source": rng.choice("xyz"), "doi": rng.choice([None, None, None, f"10.1/{rng.randrange(6)}"])})
    df = spark.createDataFrame([(r["ordinal"], r["title"], r["authors"], r["year"], r["source"], r["doi"], "", None, None) for r in rows], resolution.PAPER)
    got = sorted((r.ordinal, r.title, r.year, r.source, r.doi) for r in resolution.deduplicate(df).collect())
    assert got == fold(rows)
    assert resolution.deduplicate(df.limit(0)).collect() == []


def test_fuzzy_dedup_is_idempotent_on_exact_titles(spark, sf):
    got = catalogue.fuzzy_dedup(spark, sf)
    assert 0 < got.count() < 1000


def test_clusters(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("label < 3")
    got = {r.vec_id: r.cluster for r in aggregates.cluster(rows, "label", "vec_id", "embedding", 0.2).collect()}
    for label in range(3):
        sums = []
        for r in rows.where(F.col("label") == label).orderBy("vec_id").collect():
            v = np.array(r.embedding, float)
            at = next((i for i, s in enumerate(sums) if s / (np.linalg.norm(s) + 1e-8) @ v >= 0.2), None)
            if at is None:
                sums.append(v)
                at = len(sums) - 1
            else:
                sums[at] = sums[at] + v
            assert got[r.vec_id] == at


def test_gate_identity_and_replacement(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(1, 41)], "rank int, valid boolean")
    got = fulltext.gate(rows, "rank", F.col("valid"), 5)
    s = fulltext.gate_stats(got, F.col("valid")).first()
    assert (s.final, s.retrieved, s.rejected, s.replaced, s.surplus) == (5, 16, 11, 3, 0)
    assert s.retrieved == s.rejected + s.final + s.surplus


def test_gap_table_against_fold(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    cluster = {r.vec_id: (r.label, r.cluster) for r in aggregates.cluster(rows, "label", "vec_id", "embedding", 0.2).collect()}
    want = {}
    for i in sorted(cluster):
        want.setdefault(cluster[i], []).append(i)
    got = {(r.label, r.cluster): (r.frequency, r.papers, r.gap) for r in catalogue.gap_table(spark, sf).collect()}
    assert got == {k: (len(v), ", ".join(sorted({str(i % 10) for i in v})), f"statement {v[0]}") for k, v in want.items()}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_can_be_written(spark, sf, tmp_path, name):
    catalogue.QUERIES[name](spark, sf).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_pairs_of_blocks_are_complete(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 150").withColumn("label", F.col("label").cast("string"))
    run = lambda: (sorted(map(tuple, claims.match_pairs(rows, "label", "vec_id", "embedding", 0.2).select("a", "b", "group_a", "group_b").collect())), [tuple(r) for r in claims.match_pairs(rows, "label", "vec_id", "embedding", 0.2, 7).select("a", "b").collect()], claims.similarity_stats(rows, "label", "vec_id", "embedding", 0.2).first())
    one = run()
    monkeypatch.setattr(claims, "BLOCK", 16)
    many = run()
    assert one[0] == many[0] and one[1] == many[1] and len(one[0]) > 10
    assert [round(x, 9) for x in one[2]] == [round(x, 9) for x in many[2]]
    labels, vec = {r.vec_id: r.label for r in rows.collect()}, {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    assert one[0] == sorted((a, b, labels[a], labels[b]) for a in vec for b in vec if a < b and labels[a] != labels[b] and vec[a] @ vec[b] >= 0.2)
    assert claims.match_pairs(rows.limit(0), "label", "vec_id", "embedding", 0.2).collect() == []
    assert claims.similarity_stats(rows.limit(0), "label", "vec_id", "embedding", 0.2).first().over == 0


def test_group_top_k_in_blocks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id", F.col("embedding").alias("vec"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    run = lambda: sorted(map(tuple, ranking.group_top_k(rows, asked, "label", "vec_id", 3).select("query_id", "label", "rank", "vec_id", "similarity").collect()))
    one = run()
    monkeypatch.setattr(ranking, "ASKED", 3)
    monkeypatch.setattr(ranking, "ITEMS", 40)
    assert run() == one and len(one) > 100
    assert ranking.group_top_k(rows, asked.limit(0), "label", "vec_id", 3).collect() == [] == ranking.group_top_k(rows.limit(0), asked, "label", "vec_id", 3).collect()


def garbled(n, seed):
    import random

    rng = random.Random(seed)
    words = "deep learning for wireless networks graph neural routing in mobile federated optimisation of edge devices survey".split()
    out = []
    for _ in range(n):
        held = [rng.choice(words) for _ in range(rng.randint(1, 10))]
        bad = [list(w) for w in held]
        for _ in range(4):
            w = rng.choice(bad)
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        out += [" ".join(held), " ".join("".join(w) for w in bad)]
    return list(enumerate(dict.fromkeys(out)))


def test_no_pair_of_alike_titles_is_lost(spark, monkeypatch):
    monkeypatch.setattr(resolution, "TITLES", 24)
    rows = garbled(60, 3) + [(1000, "a " * 400), (1001, "b " + "a " * 399), (1002, "x"), (1003, "")]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "ordinal long, title string, doi string")
    got = {(r.u, r.v) for r in resolution.relaxed_pairs(df, resolution.DEFAULT).collect()}
    norm = [(i, t.strip()) for i, t in rows if t]
    want = {(u, v) for u, a in norm for v, b in norm if u < v and SequenceMatcher(None, b, a).ratio() >= 0.75}
    assert got == want and len(want) > 20


def test_common_length_against_the_table():
    import random

    rng = random.Random(1)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(60):
        a, *others = ("".join(rng.choice("abc 1") for _ in range(rng.choice([1, 5, 63, 64, 65, 130]))) for _ in range(5))
        want = [table(a, b) for b in others]
        assert resolution.common_length(a, others, resolution._coded(others)[0]).tolist() == want == [resolution._common_long(a, b) for b in others]


def test_projection_against_svd(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    got = np.array([r.projection for r in catalogue.QUERIES["projection"](spark, sf).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ axes.T), atol=1e-6)


def test_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = ranking.top_k(ranking.term_cosine(docs.select("doc_id", "text"), "doc_id", F.col("text"), "the of"), 5, "score", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and not any(x in plan for x in ("Join", "Exchange", "Python"))
    for made in (fulltext.clean_text(docs.select("doc_id", "text"), ["doc_id"], "text"), fulltext.split_sections(docs, "doc_id", F.col("text"))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def section_fold(text):
    """Sections of a text, line by line."""
    alias = {a: name for name, names in fulltext.SECTION_ALIASES.items() for a in names}
    parts, cur = {"Body": []}, "Body"
    for line in text.split("\n"):
        m, r = re.match(fulltext.HEADING, line), re.match(fulltext.RUN_IN_HEADING, line)
        if m and m[1].strip().lower() in alias:
            cur = alias[m[1].strip().lower()]
            parts.setdefault(cur, [])
        elif r and r[1].strip().lower() in alias:
            cur = alias[r[1].strip().lower()]
            parts.setdefault(cur, []).append(r[2])
        else:
            parts.setdefault(cur, []).append(line)
    if "Abstract" not in parts:
        body = parts["Body"]
        start = next((i for i, x in enumerate(body) if "@" not in x and len(x.split()) > 6), None)
        if start is not None:
            end, n = start, 0
            while end < len(body) and body[end].strip() and n < 250:
                n += len(body[end].split())
                end += 1
            text = " ".join(x.strip() for x in body[start:end])
            ends = len(re.findall("[.!?]", text))
            if n >= 40 and ends >= 2 and n / ends >= 15:
                parts["Body"], parts["Abstract"] = body[:start] + body[end:], body[start:end]
    return [(k, "\n".join(v).strip()) for k, v in parts.items() if "\n".join(v).strip()]


def test_sections_and_abstracts_against_fold(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    head = "Some Title\nA. Author a@b.c\n"
    prose = " ".join(["This paper studies a number of things in some detail for readers who want to know about all of them."] * 5)
    extra = [head + prose + "\n\nRest.\nResults\nx", prose.replace(". ", ".\n") + "\n1. Introduction\ny", "Abstract\n" + prose, "", "References\n", "Methods: a b\nResults - c\nMethods\nd", "\n".join([prose] * 4)]
    rows = docs + [(-1 - i, x) for i, x in enumerate(extra)]
    got = {}
    for r in fulltext.split_sections(spark.createDataFrame([*rows, (-99, None)], "i long, t string"), "i", F.col("t")).orderBy("i", "section_ord").collect():
        got.setdefault(r.i, []).append((r.section_name, r.text))
    assert got == {i: s for i, x in rows if (s := section_fold(x or ""))}
    assert any(k == "Abstract" for i, s in got.items() if i < 0 for k, _ in s)


def test_guess_abstract(spark):
    body = "Some Title\nA. Author a@b.c\n" + " ".join(["This paper studies a number of things in some detail for readers who want to know about all of them."] * 5) + "\n\nRest of the text follows here."
    got = spark.createDataFrame([(body,), ("short\ntext",), ("",)], "t string").select(fulltext.guess_abstract(F.col("t")).alias("a")).collect()
    assert got[0].a is not None and got[0].a.startswith("This paper") and "Rest" not in got[0].a
    assert got[1].a is None and got[2].a is None


def test_text_edges(spark):
    df = spark.createDataFrame([(None, []), ("", ["x"]), (" a, b / b; Not Found in Retrieved Context and ", ["Ann Lee", " Bo  LEE "])], "t string, a array<string>")
    got = df.select(tx.multi_values(F.col("t")).alias("v"), tx.authors_display(F.col("a")).alias("d"), tx.dedupe_terms(F.array(F.lit("A"), F.lit("a "), F.lit("b"), F.lit(""))).alias("k"), tx.as_str_list(F.lit('["x", " ", "y "]')).alias("j"), tx.as_str_list(F.lit('"z"')).alias("s"), tx.as_str_list(F.lit("3")).alias("n")).collect()
    assert [r.v for r in got][2] == ["a", "b", "b"] and got[0].d == "Unknown authors"
    assert got[0].k == ["A", "b"] and got[0].j == ["x", "y"] and got[0].s == ["z"] and got[0].n == []
    both = spark.createDataFrame([(["Ann Lee"], ["B LEE"]), (["Ann Lee"], []), (["A B"], ["C D"])], "a array<string>, b array<string>").select(tx.authors_overlap(F.col("a"), F.col("b")).alias("o")).collect()
    assert [r.o for r in both] == [True, False, False]
