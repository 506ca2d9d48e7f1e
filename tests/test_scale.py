"""What must not grow beyond the input: plans and rows between steps, held with the results of plain code."""

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import resolution
from quillspark.plans import catalogue, catalogue_reports  # noqa: F401


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_source_queries_clean_each_term_once(spark, sf):
    row = spark.createDataFrame([("a b", "P", None), ("a b", "", "s")], "p string, q string, s string")
    made = row.select(tx.source_queries(F.lit("raw"), F.col("p"), F.col("q"), F.lit("two"), F.array(F.lit("A B "), F.lit("c")), F.lit(None).cast("array<string>"), F.lit("d"), F.array(F.lit("k"), F.lit("K")), F.col("s")).alias("m"))
    got = [dict(r.m) for r in made.collect()]
    bags = ("openalex", "crossref", "semantic_scholar")
    assert got[0] == {"arxiv": '(all:"a b" OR all:c) AND (all:P OR all:d OR all:k) AND all:two', "core": "raw"} | dict.fromkeys(bags, "a b P two k")
    assert got[1] == {"arxiv": '(all:"a b" OR all:c) AND (all:d OR all:k) AND all:two', "core": "s"} | dict.fromkeys(bags, "a b two k")
    # terms of three groups and of the bag are stripped once, not again for each use of what is left
    assert plan(catalogue.QUERIES["source_query_compile"](spark, sf)).count("regexp_replace(") <= 4


def test_overlaps_are_counted_without_pairs(spark, sf):
    left = [(1, 0, ["Ann Lee", "B. Orr"]), (2, 0, ["C LEE "]), (3, 0, []), (4, 1, ["Ann Lee"]), (5, None, ["Ann Lee"]), (6, 2, ["Ann Lee"]), (7, 0, None), (8, 0, [None, "x orr"]), (1, 1, ["D Orr"])]
    right = [(0, ["A Lee", "A Orr"]), (0, ["A Lee"]), (0, ["Lee"]), (0, ["Zed"]), (0, [" "]), (0, None), (1, ["E Orr"]), (1, ["E Orr"]), (None, ["Ann Lee"])]
    last = lambda names: {n.split()[-1].lower() for n in names or [] if n and n.strip()}
    want: dict = {}
    for key, group, names in left:
        for g, theirs in right:
            if group is not None and g == group:
                total, shared = want.get(key, (0, 0))
                want[key] = (total + 1, shared + bool(last(names) & last(theirs)))
    made = resolution.authors_overlap_counts(spark.createDataFrame(left, "k int, g int, authors array<string>"), spark.createDataFrame(right, "g int, authors array<string>"), "k", "g")
    assert {r.k: (r.total, r.shared) for r in made.collect()} == want
    # suppliers never meet customers by nation alone: every join of rows with names has the surname, too
    joins = [line for line in plan(catalogue.QUERIES["authors_overlap_pairs"](spark, sf)).splitlines() if "Join" in line]
    assert joins and not any("s_nationkey" in line and "c_nationkey" in line for line in joins)


def test_index_is_made_within_the_row(spark, sf):
    rows = [(1, "b a b\n a  a"), (1, "a"), (2, ""), (3, None), (4, " \n "), (5, "x " * 3000)]
    made = spark.createDataFrame(rows, "i int, t string").select("i", "t", tx.inverted_index(tx.words(F.col("t"))).alias("m")).withColumn("back", tx.inverted_index_text(F.col("m")))
    got = made.collect()
    assert sorted((r.i, r.back) for r in got) == sorted((i, " ".join((t or "").split())) for i, t in rows)
    for r in got:
        want: dict = {}
        for at, w in enumerate((r.t or "").split()):
            want.setdefault(w, []).append(at)
        assert (r.m or {}) == want and (r.m is None) == (r.t is None)
    assert not any(step in plan(catalogue.QUERIES["inverted_index_rebuild"](spark, sf)) for step in ("Aggregate", "Join", "Generate"))


def test_sections_in_one_pass(spark, sf):
    import random
    import time

    draw = random.Random(3)
    texts = ["".join(draw.choice(" \t\n\r\x0b\f\x85 \xa0ab") for _ in range(draw.randrange(9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~tx.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"^\s+|\s+$", ""))).count() == 0
    began = time.time()
    long = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b ")).alias("t"))
    assert long.select(F.length(tx.strip(F.col("t")))).first()[0] == 300_002
    assert time.time() - began < 20  # 45 thousand million steps, if each blank of a run starts a new attempt
    assert plan(catalogue.QUERIES["section_split"](spark, sf)).count("regexp_extract(") == 3


def test_doubles_round_as_sql_rounds_them(spark):
    import duckdb

    values = [k / 1e6 * sign for k in range(500, 1_000_000, 1000) for sign in (1, -1)] + [0.0, -0.0001, 0.1235, 1e17, 0.49999999999999994, float("nan"), float("inf")]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.format_number(tx.rounded(F.col("v"), 3), 3).alias("v")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT printf('%.3f', round(v, 3)) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    assert got[:-3] == [w if "e" in w or float(w) < 1000 else f"{float(w):,.3f}" for w in want[:-3]]


def test_vectors_of_chunks_are_small(spark):
    import tracemalloc

    import pandas as pd

    from quillspark.operators import index

    texts = pd.Series([" ".join(f"w{(i * 7 + j * 13) % 5000}x" for j in range(500)) for i in range(300)])
    tracemalloc.start()
    made = index._vectors(texts, index.WIDTH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [dict(zip(a.tolist(), n.tolist(), strict=True)) for a, n in zip(made["at"], made["n"], strict=True)] == [index.hashed(t) for t in texts]
    assert peak < 300 * 12_000  # as dicts and lists some 100 KB a text


def test_figures_of_pairs_hold_few_products(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quillspark.operators import claims

    draw = np.random.default_rng(5)

    def table(n, first):
        return pa.table({"g": pa.array(draw.integers(0, 4, n), pa.int32()), "i": pa.array(np.arange(first, first + n)), "v": pa.array(list(draw.normal(size=(n, 8)).astype(np.float32)), pa.list_(pa.float32()))})

    for left, right in ((table(300, 0), None), (table(300, 0), table(170, 200)), (table(1, 0), None), (table(3, 0), table(0, 0)), (table(2048, 0), table(2048, 2048))):
        product = claims._products(left, right, "g", "i", "v")[2]
        tracemalloc.start()
        got = claims._figures(left, right, "g", "i", "v", 0.3).to_pylist()[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got["over"] == (product >= 0.3).sum()
        assert (got["low"] is None and got["high"] is None and not len(product)) or np.allclose([got["low"], got["high"]], [product.min(), product.max()])
        assert peak < 8e6  # all products of two tiles, and their places, took 130 MB


def test_decoys_are_made_of_the_words_of_all_texts(spark):
    from collections import Counter

    from quillspark.llm import secrets

    texts = ["alpha beta " * 300, None, "", "12 x"] + [f"gamma {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}word" for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Counter(w for t in texts for w in (t or "").split() if len(w) > 1 and w.isalpha())
    assert Counter(r.w for r in secrets.places(docs, secrets.Battery()).collect()) == whole
    few = Counter(r.w for r in secrets.places(docs, secrets.Battery(words=400)).collect())
    total = sum(whole.values())
    assert sum(few.values()) == 400 and all(abs(few[w] - n * 400 / total) < 1 for w, n in whole.items())


def test_sections_of_odd_texts_as_their_sql_says(spark, tmp_path):
    import duckdb

    texts = ["Introduction", "a\nResults: b\nc", "Methods\n\nb\n1. Conclusion\n", " \n lead", "trail \t\r\n\f", " \n ", "", None, "\x0b", "\x0ba\x0b", "a\n \x0b\n\x0bSummary\nb", "\xa0a\x85", "\nReferences\nx",
             "II. METHODS \u20ac\U0001f600\n\U0001f600\n\n\nSummary - \u00e9", "a\r\nDataset\r\nb", "@\nAbstract\n@", "x\u2028Results\u2028y", "plain text. Of two lines\n here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["section_split_documents"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLE["section_split_documents"]).fetchall()) and len(got) == len(texts) - 3


def test_first_sentence_and_pairs_left_early(spark):
    import numpy as np

    texts = ["A b. C d. E", " \n a! B", "", " \n ", None, ".  X", "one", "a?\n\nB. c", "a. b. C"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~tx.first_sentence(F.col("t")).eqNullSafe(F.get(tx.sentences(F.col("t")), 0))).count() == 0
    draw = np.random.default_rng(2)
    titles = ["".join(draw.choice(list("abcde "), draw.integers(1, 140))) for _ in range(60)]
    titles += [t[:-3] + "x" for t in titles if len(t) > 9]
    coded, _ = resolution._coded(titles)
    n, masks = np.array([len(t) for t in titles]), resolution._masks(coded)
    a, b = (x.ravel() for x in np.indices((len(titles), len(titles))))
    whole, early = resolution._common_lengths(masks, n, coded, n, a, b), resolution._common_lengths(masks, n, coded, n, a, b, 0.75)
    hit = 2 * whole >= 0.75 * (n[a] + n[b]) - 1e-9
    assert (early[hit] == whole[hit]).all() and (2 * early[~hit] < 0.75 * (n[a] + n[b])[~hit]).all() and (early[~hit] != whole[~hit]).any()
