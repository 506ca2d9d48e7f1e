"""Texts by key under many writers; batches that stop early."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import fulltext
from quillspark.sources import files
from quillspark.sources.store import Store, _writes


def rows(spark, held):
    return spark.createDataFrame(list(held.items()), "key string, value string")


def test_the_last_write_counts_and_lookups_read_their_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    assert store.read().isEmpty() and store.get(rows(spark, {"a": ""})).isEmpty()
    store.put(rows(spark, {f"k{i}": "zzz" for i in range(60)}))
    store.put(rows(spark, {"k3": "a", "new": "b"}))
    assert {r.key: r.value for r in store.read().collect()} == {**{f"k{i}": "zzz" for i in range(60)}, "k3": "a", "new": "b"}
    got = store.get(rows(spark, {"k3": "", "new": "", "absent": ""}))
    assert {r.key: r.value for r in got.collect()} == {"k3": "a", "new": "b"}
    plan = store._rows(_writes(spark, store.path), [1, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#").replace("cast(", "") and "1,5" in plan


def test_writers_at_once_and_compaction_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.put(rows(spark, {f"k{i}": str(i), "shared": str(i)})), range(6)))
    before = {r.key: r.value for r in store.read().collect()}
    assert set(before) == {f"k{i}" for i in range(6)} | {"shared"}
    store.compact()
    assert len(_writes(spark, store.path)) == 1 and {r.key: r.value for r in store.read().collect()} == before
    store.put(rows(spark, {"shared": "last"}))
    store.compact()
    assert {r.key: r.value for r in store.read().collect()} == {**before, "shared": "last"}


def test_a_write_that_is_not_complete_is_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put(rows(spark, {"a": "1"}))
    (tmp_path / "s" / "write=9-broken" / "bucket=1").mkdir(parents=True)
    assert store.read().count() == 1


def test_text_cache_keeps_the_last_text(spark, tmp_path):
    for text in ("zebra", "ant"):
        files.append_cache(spark.createDataFrame([("p", text)], "paper_id string, full_text string"), str(tmp_path / "c"))
    assert [r.full_text for r in files.read_cache(spark, str(tmp_path / "c")).collect()] == ["ant"]


def test_collection_judges_no_more_batches_than_it_needs(spark):
    ranked = spark.range(1, 101).withColumnRenamed("id", "rank")
    judged = spark.sparkContext.accumulator(0)

    def judge(batch):
        def count(tables):
            for t in tables:
                judged.add(t.num_rows)
                yield t

        return batch.mapInArrow(count, "rank long").withColumn("status", F.when(F.col("rank") % 4 == 0, "VALID").otherwise("INVALID"))

    got = fulltext.collect(ranked, "rank", judge, 10)
    want = fulltext.gate(ranked.withColumn("status", F.when(F.col("rank") % 4 == 0, "VALID").otherwise("INVALID")), "rank", F.col("status") == "VALID", 10)
    assert judged.value == 40 == got.count()
    assert sorted(map(tuple, got.select("rank", "batch", "attempted", "final", "replaced").collect())) == sorted(map(tuple, want.where("attempted").select("rank", "batch", "attempted", "final", "replaced").collect()))
    assert fulltext.collect(ranked.where("rank < 5"), "rank", judge, 10).where("final").count() == 1
    assert fulltext.collect(ranked.limit(0), "rank", judge, 10).isEmpty()


def test_query_terms_are_those_of_the_column(spark):
    for q in ("Deep-learning for é über x 5g a_b  naïve", "", "one"):
        assert tx.terms_of(q) == spark.range(1).select(tx.terms(F.lit(q))).first()[0]
