"""The filter audit against a plain walk through all orders."""

import re
from itertools import permutations

from quillspark.llm import interaction
from tests.llm.helpers import awkward, empty

LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 1, None), (7, 1, 1), (None, 1, 1)]


def plain(rows, labels):
    """The figures of every part, order and step, document by document."""
    failing = []
    for doc_id, text, lang, *_ in rows:
        t, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        said = [x for x in labels if x[0] == doc_id and doc_id is not None]
        smaller = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        quality, toxic = [x[1] for x in said if x[1] is not None], [x[2] for x in said if x[2] is not None]
        failing.append((lang or "", {k for k, v in fails.items() if v}, bool(quality) and min(quality) == 1, bool(toxic) and max(toxic) == 1))
    out = []
    for part in {f[0] for f in failing}:
        own, found, shapley = [f for f in failing if f[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*f, shapley[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def test_equals_a_walk_through_all_orders_on_awkward_rows(spark):
    more = spark.createDataFrame([(20, "A B # " * 40, "en", "a"), (21, "A B # " * 40, "de", "a"), (21, "A B # " * 40, "de", "a"), (None, "A B # " * 40, None, "a"), (22, "", "en", "b"), (23, None, "en", "b")], "doc_id long, text string, lang string, source string")
    docs = awkward(spark, "part mask n good toxic digest cells step").unionByName(more, allowMissingColumns=True)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS text", "'clash' AS part")
    got = interaction.audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], LABELS)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(empty(spark), labels).collect() == []
    unlabelled = interaction.audit(awkward(spark), labels)
    assert unlabelled.agg({"good_lost": "max", "toxic_lost": "max"}).first()[:] == (0, 0)
    assert unlabelled.groupBy("part").count().where("count <> 600").isEmpty()


def test_other_rules(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a b", "x"), (3, "a b", "y")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in interaction.audit(docs, labels, {"S": "n_words < 2"}, "C").collect()}
    assert len(got) == 4 * 2 and got["x", "SC", 1].removed == 1 and got["x", "SC", 1].good_lost == 1 and got["y", "CS", 1].removed == 1 and got["y", "SC", 2].shapley == 2
