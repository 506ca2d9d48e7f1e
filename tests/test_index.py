"""The kept index against dense vectors and plain code."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators.embedding import hashing_embedder
from quillspark.operators.index import PaperIndex, hashed
from quillspark.plans import catalogue, catalogue_reports
from quillspark.plans import pipelines as pl


@pytest.fixture()
def chunks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    return spark.createDataFrame([(f"p{p}", c, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for p in range(12) for c in range(rng.randrange(1, 8))], "paper_id string, chunk_ord long, chunk_text string")


def test_sparse_vectors_find_what_dense_ones_find_without_a_shuffle(spark, chunks):
    index = PaperIndex(spark, "index_test", buckets=4)
    index.drop()
    try:
        index.add(chunks.where("paper_id < 'p5'"))
        index.add(chunks.where("paper_id >= 'p5'"))  # papers that come later
        queries = [("w1 w2 w3", 2), ("w7", 3)]
        found = index.search(queries, 3)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        dense = pl.build_index(chunks, hashing_embedder())
        from quillspark.config import Config

        want = pl.retrieve(dense, queries, 3, hashing_embedder(), Config(query_instruction=""))
        shown = lambda df: sorted((r.paper_id, r.chunk_ord, round(r.similarity, 6), r.position) for r in df.collect())
        assert shown(found) == shown(want)
        assert index.rows().agg(F.sum(8 * F.size("vec.at") + 8)).first()[0] * 10 <= dense.count() * 4096 * 4
    finally:
        index.drop()
    assert not spark.catalog.tableExists("index_test")


def test_hashed_is_the_dense_vector_without_zeros():
    dense = hashing_embedder()()(["a bc de bc", ""])
    assert {i: x for i, x in enumerate(dense[0]) if x} == hashed("a bc de bc") and hashed("") == {} == hashed(None)


def test_retrieval_chain_over_documents(spark, tmp_path):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {}
    for r in catalogue.chunk_documents(spark, "/root/testdata/sf0.001").collect():
        rows.setdefault(r.doc_id, []).append((r.chunk_ord, r.chunk_text))

    def unit(text):
        w = re.findall(r"\w\w+", text.lower())
        c = Counter(zlib.crc32(t.encode()) % 4096 for t in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
        n = sum(x * x for x in c.values()) ** 0.5
        return {k: x / n for k, x in c.items()}

    want = set()
    for doc, held in rows.items():
        best = {}
        for q, k in catalogue_reports.RETRIEVED:
            asked = unit(q)
            scores = sorted((-round(sum(w * asked.get(at, 0) for at, w in unit(text).items()), 9), at) for at, text in held)
            for s, at in scores[:k]:
                best[at] = max(best.get(at, -1), -s)
        top = sorted(best, key=lambda at: (-best[at], at))[:2]
        want |= {(doc, at, best[at], i) for i, at in enumerate(sorted(top), 1)}
    got = catalogue_reports.retrieval_chain(spark, "/root/testdata/sf0.001")
    assert docs.count() >= len(rows) and {(r.paper_id, r.chunk_ord, round(r.similarity, 6) + 0.0, r.position) for r in got.collect()} == {(d, a, round(s, 6) + 0.0, i) for d, a, s, i in want}
