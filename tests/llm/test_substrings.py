"""Passages that start earlier, against a plain list of all windows."""

import random
import re

import pytest

from quillspark.llm import substrings
from tests.llm.helpers import awkward, empty, words


def plain(rows, least):
    """(doc_id, n_words, n_removed, kept): every window of distinct documents, in order of id."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, found = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w, gone = split(text), set()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                gone |= set(range(i, i + least))
            seen.add(key)
        found[doc_id, text] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return sorted(((d, *found[d, t]) for d, t in rows), key=repr)


def same(docs, plan):
    got = substrings.deduplicate(docs, plan).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plan.least)
    for r in got:
        spans = [tuple(s) for s in r.spans or ()]
        assert sum(b - a for a, b in spans) == r.n_removed and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    return got


def woven(seed, rows=120, passages=6, length=60, alphabet=400):
    """Documents of shared passages, whole, cut, changed in places (changes are copied on), and of few words, so that anchors tie."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(alphabet)}" for _ in range(n)]
    pool, out = [fresh(length) for _ in range(passages)], []
    for i in range(rows):
        text = fresh(rng.randrange(12))
        for _ in range(rng.randrange(4)):
            part = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(fresh(1))
            a = rng.randrange(len(part) // 2)
            part = part[a : a + rng.randrange(1, len(part))]
            if rng.random() < 0.3:
                pool.append(part + fresh(3))
            text += part + fresh(rng.randrange(4))
        if rng.random() < 0.2 and out:
            text = list(rng.choice(out)[1].split())
        out.append((i * 7 % 1009, " ".join(text)))
    return out


@pytest.mark.parametrize("seed", [0, 2, 4])
def test_equals_all_windows(spark, seed):
    docs = spark.createDataFrame(woven(seed, alphabet=[400, 400, 5, 2, 40, 400][seed]), "doc_id long, text string")
    got = same(docs, substrings.Plan())
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("plan", [substrings.Plan(5, 3), substrings.Plan(6, 6)])
def test_other_lengths(spark, plan):
    same(spark.createDataFrame(woven(plan.least, 60), "doc_id long, text string"), plan)


def test_copied_changes_are_found_though_the_hub_lacks_them(spark):
    base = words(40, 3).split()
    changed = [*base[:19], "CHANGED", *base[20:]]
    docs = [(1, " ".join(base)), (2, "a b " + " ".join(changed) + " c"), (3, "d " + " ".join(changed[5:36]) + " e"), (4, " ".join(changed[10:29]))]
    got = {r.doc_id: r.n_removed for r in same(spark.createDataFrame(docs, "doc_id long, text string"), substrings.Plan())}
    assert got == {1: 0, 2: 20, 3: 31, 4: 0}


def test_large_groups_and_repeats_within_a_document(spark):
    line = " ".join(f"l{i}" for i in range(25))
    rows = [(i, f"x{i} " + line + f" y{i % 3} z") for i in range(400)] + [(1000 + i, "again and " * 50) for i in range(30)] + [(2000, (line + " ") * 30)]
    got = {r.doc_id: r.n_removed for r in same(spark.createDataFrame(rows, "doc_id long, text string"), substrings.Plan())}
    assert got[0] == 0 and got[399] >= 25


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, "doc version spans hash at n kind start")
    same(docs, substrings.Plan())
    assert substrings.deduplicate(empty(spark)).collect() == []
    null = spark.createDataFrame([(None, words(30, 2)), (None, words(30, 2)), (5, words(30, 2)), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substrings.deduplicate(null).collect()) == [(0, 0), (30, 0), (30, 30), (30, 30)]


def test_rows_of_one_id_with_several_texts(spark):
    rows = [(1, words(30, 2)), (1, "x " + words(30, 2)), (2, words(30, 2))]
    got = [tuple(r)[:3] for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(n for d, _, n in got if d == 1) == [0, 30] and [n for d, _, n in got if d == 2] == [30]
