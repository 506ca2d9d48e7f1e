"""Duplicates as papers arrive, against the plain fold of all papers."""

import random

from quillspark.sources.connectors import PAPER
from quillspark.streaming.arrivals import Arrivals

from .test_folds import fold


def papers():
    rng = random.Random(1)
    base = ["deep learning for wireless networks", "graph neural routing in mobile networks", "federated optimisation of edge devices", "a survey of contradiction mining"]
    out = []
    for i in range(40):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["robust", "fast", "networks", "large"])
        out.append({"ordinal": i, "title": " ".join(words), "authors": [rng.choice(["A Lee", "B Kim", "C Diaz"])], "year": rng.choice([2020, 2021, 2023, None]), "source": rng.choice("xyz"), "doi": rng.choice([None, None, None, f"10.1/{rng.randrange(6)}"])})
    return out


def test_a_stream_in_any_order_gives_the_fold_of_all(spark, tmp_path):
    """Two micro-batches, in another order than the papers'; then papers without title, and some that are there already."""
    rows = papers()
    random.Random(2).shuffle(rows)
    frame = lambda part: spark.createDataFrame([(r["ordinal"], r["title"], r["authors"], r["year"], r["source"], r["doi"], "", None, None) for r in part], PAPER)
    for part in (rows[:25], rows[25:]):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    inbox = Arrivals(f"file://{tmp_path}/log")
    stream = spark.readStream.schema(PAPER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = inbox.run(stream, str(tmp_path / "checkpoint"))
    query.awaitTermination(600)
    assert query.exception() is None
    got = sorted((r.ordinal, r.title, r.year, r.source, r.doi) for r in inbox.current(spark).collect())
    assert got == fold(sorted(rows, key=lambda r: r["ordinal"]))
    log = inbox.changes(spark)
    assert log.select("batch").distinct().count() == 2 and log.where("op = '-'").count() > 0
    left = log.where("op = '+'").drop("op", "batch").exceptAll(log.where("op = '-'").drop("op", "batch"))
    assert sorted(r.ordinal for r in left.collect()) == [g[0] for g in got]


def test_settled_components_and_batches_run_again(spark, tmp_path):
    """keep=1: papers of batch 2 do not join a component of batch 0. A batch run again, and a repeated ordinal, change nothing."""
    row = lambda i, source: (i, "a survey of contradiction mining", ["B Kim"], 2021, source, None, "", None, None)
    inbox = Arrivals(f"file://{tmp_path}/log", keep=1)
    late = spark.createDataFrame([row(1, "y"), row(1, "z"), row(0, "w"), (2, " ", None, None, "x", None, None, None, None)], PAPER)
    inbox.arrive(spark.createDataFrame([row(0, "x")], PAPER), 0)
    for _ in range(2):
        inbox.arrive(late, 2)
        assert sorted((r.component, r.ordinal, r.source) for r in inbox.current(spark).collect()) == [(0, 0, "x"), (1, 1, "y")]
