"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import phrases
from tests.llm.helpers import awkward, empty


def plain(rows, plan):
    """Every phrase counted; lang, rank, phrase, a, l, r, n, score."""
    f, n = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, plan.longest + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= plan.least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if not (longer[lang, w] and 100 * longer[lang, w] >= plan.inside * a):
            score, _, left, right = min((plan.factor * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[: plan.best], 1)]


def same(docs, plan):
    got = [tuple(r) for r in phrases.collocations(docs, plan).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], plan)
    assert sorted(got) == sorted(want)
    return got


def garbled(spark, rows=300):
    rng = random.Random(5)
    vocabulary = ["The", "of", "and", "a", "new york", "new york city", "é", "zß", "x y", "rare", *[f"w{i}" for i in range(12)]]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))
    return spark.createDataFrame([(i, text(), rng.choice(["en", "en", "de", None, ""])) for i in range(rows)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("plan", [phrases.Plan(least=3, best=10), phrases.Plan(least=2, longest=3), phrases.Plan(least=4, buckets=3, share=7)])
def test_equals_a_plain_count(spark, plan):
    assert same(garbled(spark), plan)


def test_parts_of_long_texts_and_many_parts_give_the_same(spark, monkeypatch):
    docs = garbled(spark, 60)
    want = sorted(map(tuple, phrases.collocations(docs, phrases.Plan(least=3)).collect()))
    # the functions that tasks run read the sizes from their module, so they are held against each other here
    monkeypatch.setattr(phrases, "BYTES", 20)
    text = " ".join(r.text for r in docs.collect()).encode()
    parts = [w for part in phrases._split(text) for w in part]
    monkeypatch.setattr(phrases, "BYTES", 1 << 30)
    assert parts == [w for part in phrases._split(text) for w in part] and want


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, "word f phrase pivot salt n a size").unionByName(garbled(spark, 40), allowMissingColumns=True)
    assert same(docs, phrases.Plan(least=2))
    assert phrases.collocations(empty(spark)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " . ", "en")], "doc_id long, text string, lang string")).collect() == []


def test_arithmetic_beyond_64_bits(spark):
    big = 1 << 61
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, big // 2)], "lang string, phrase string, size int, a long")
    counted = spark.createDataFrame([("en", "a", big + 3), ("en", "b", big + 5), ("en", "c", (1 << 63) - 1)], "lang string, word string, f long")
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.scored(found, counted, phrases.Plan()).collect()}
    assert got["a b"] == (big + 3, big + 5, 2_000_000 * big // (2 * big + 8))
    assert got["a b c"][2] == 2_000_000 * (big // 2) // (big + (1 << 63) - 1)


def test_tasks_hash_words_as_the_order_does(spark):
    rows = spark.createDataFrame([("en", "würde"), ("", "x"), ("und", "")], "lang string, word string")
    for r in rows.withColumn("h", F.xxhash64("lang", "word")).collect():
        assert np.uint64(xxhash.xxh64_intdigest(r.word.encode(), xxhash.xxh64_intdigest(r.lang.encode(), 42))).view(np.int64) == r.h
