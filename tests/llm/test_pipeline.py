"""The pipeline, stage by stage against plain Python, then as a whole."""

import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillspark.llm import queries, toxicity
from quillspark.llm.common import hold_out, table
from pyspark.sql import functions as F

from .helpers import awkward, empty
from .test_mixing import brute as mix_brute
from .test_near_dedup import brute as dedup_brute
from .test_text_scans import personal_spans


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    docs = table(spark, sf, "documents").where("length(text) < 4000").limit(250)
    docs.write.parquet(f"{d}/documents.parquet")
    table(spark, sf, "labels").write.parquet(f"{d}/labels.parquet")
    return d


def masked(text):
    out, at = [], 0
    order = ["email", "ip", "card", "phone"]
    for k, s, e in sorted(personal_spans(text), key=lambda x: (x[1], order.index(x[0]), x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages_and_run(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        got = stage(spark, docs, small)
        if name != "best_fit_pack":
            assert got.columns == columns
        got.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows, was = docs.collect(), before.collect()
        if name == "toxicity":
            model = toxicity.fit(before, table(spark, small, "labels"), hold_out(F.col("doc_id"), 3) != 1)
            want = {r.doc_id for r in toxicity.predict(before, model).collect() if not r.predicted}
            assert {r.doc_id for r in rows} == want
        elif name == "near_dedup":
            groups = dedup_brute([(r.doc_id, r.text) for r in was], 5, 80)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in groups.items() if c == i)
        elif name == "pii":
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: masked(r.text) for r in was}  # no term discloses anything in so few
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "source_mix":
            want = {i: int(taken / n + 0.5) if n else 1 for i, n, _, _, taken in mix_brute([(r.doc_id, r.source, r.text) for r in was])}
            times = {}
            for r in rows:
                times[r.doc_id] = times.get(r.doc_id, 0) + 1
            assert times == {i: n for i, n in want.items() if n}
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sum(r.length for r in rows) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in was)
        kept[name] = len(rows)
    whole = cp.run(spark, small)
    assert whole.count() == kept["best_fit_pack"]
    assert kept["toxicity"] > kept["near_dedup"] > 0


def test_stages_on_awkward_and_empty_tables(spark, sf):
    docs = awkward(spark, "score kept size taken row key start kind").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(docs.where("doc_id = 2").limit(1).withColumn("text", F.lit("mail me a@b.cc please " * 20))).unionByName(docs.where("doc_id IS NULL"))
    stages = dict(cp.STAGES)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    rows = lambda df: sorted(map(tuple, df.collect()), key=key)
    whole = rows(docs)
    assert rows(stages["toxicity"](spark, docs, sf)) == whole  # nothing toxic there
    kept = rows(stages["near_dedup"](spark, docs, sf))
    at = docs.columns.index("doc_id")
    ids = [r[at] for r in kept]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9] or sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert ids.count(None) == 2 and set(kept) <= set(whole) and rows(stages["near_dedup"](spark, docs, sf)) == kept
    clean = rows(stages["pii"](spark, docs, sf))
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars")
    assert len(clean) == len(whole) and sum("[EMAIL]" in (r[text] or "") for r in clean) == 1 and not any("a@b.cc" in (r[text] or "") for r in clean)
    assert all(r[chars] == (None if r[text] is None else len(r[text])) for r in clean) and sorted(r[at] or 0 for r in clean) == sorted(r[at] or 0 for r in whole)
    mixed = rows(stages["source_mix"](spark, docs, sf))
    assert set(mixed) <= set(whole) and {r[at] for r in whole if not (r[text] or "").split()} <= {r[at] for r in mixed} and all(mixed.count(r) <= 2 * whole.count(r) for r in set(mixed))
    packed = stages["best_fit_pack"](spark, docs, sf).collect()
    assert sum(r.piece == 0 for r in packed) == len(whole) and {r.doc_id for r in packed} == {r[at] for r in whole}
    nothing = empty(spark).withColumn("n_chars", F.lit(1).cast("long"))
    for name, stage in cp.STAGES:
        got = stage(spark, nothing, sf)
        assert got.collect() == [] and (name == "best_fit_pack" or got.columns == nothing.columns)
        assert name == "best_fit_pack" or stage(spark, docs, sf).columns == docs.columns


def test_run_leaves_one_stage_behind(spark, small):
    from quillspark.llm import common

    common.release(spark)
    cp.run(spark, small).count()
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._made[spark.sparkContext.applicationId]]
    assert left == ["source_mix", "pieces", "packed"]


def test_all_is_deleted_at_exit(tmp_path):
    import subprocess
    import sys

    code = """import sys
from pyspark.sql import SparkSession
from quillspark.llm.common import durable
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert durable(spark.range(3), "t").count() == 3
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "shared")], check=True, timeout=120, capture_output=True)
    assert [f for _, _, files in os.walk(tmp_path / "shared") for f in files] == []


def test_registered_queries_and_sql(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|.*", n)[0] for n in names} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())
    here = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    for base, _, files in os.walk(os.path.join(here, "quillspark")):
        for f in files:
            if f.endswith(".py") and "/llm" not in base:
                assert "llm" not in [w for line in open(os.path.join(base, f)) if "import" in line for w in re.findall(r"\w+", line)]
