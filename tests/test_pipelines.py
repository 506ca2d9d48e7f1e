"""The entry points end to end, with fake models."""

import json

from pyspark.sql import functions as F

from quillspark.config import Config
from quillspark.operators import embedding
from quillspark.operators.resolution import PAPER
from quillspark.plans import pipelines as pl
from quillspark.plans import service as sv
from quillspark.sources import files

SMALL = Config(min_words=20, min_unique=5, min_abstract_words=5, min_abstract_unique=3, chunk_tokens=30, chunk_overlap=8)


def body(topic, n):
    return "Introduction\n" + " ".join(f"The {topic} method number {i} improves {topic} in networks." for i in range(n)) + "\nReferences\nold things"


def papers(spark):
    rows = [(i, f"{t} learning for networks {t}", ["A Lee"], 2020 + i % 3, "openalex", f"10.1/{i}", f"We study {t} in mobile networks and more.", None, "IEEE") for i, t in enumerate(["graph", "routing", "vision", "speech"])]
    rows.append((9, "Graph Learning for Networks: graph", ["A Lee", "B Kim"], 2020, "core", "10.1/0", "", None, None))
    return spark.createDataFrame(rows, PAPER)


def test_search(spark):
    ps = papers(spark)
    ids = {r.doi: r.paper_id for r in ps.select("doi", F.expr("substring(sha1(doi), 1, 16)").alias("paper_id")).collect()}
    texts = spark.createDataFrame([(ids["10.1/0"], body("graph", 12)), (ids["10.1/1"], body("routing", 12)), (ids["10.1/2"], "")], "paper_id string, full_text string")
    got = pl.search(ps, texts, "graph networks", target=2, how=SMALL)
    final = got.papers.collect()
    assert len(final) == 2 and final[0].doi == "10.1/0" and final[0].source == "core, openalex" and final[0].ai_summary
    assert got.stats.first().final == 2
    assert {r.paper_id for r in got.chunks.select("paper_id").collect()} == {r.paper_id for r in final}
    assert got.chunks.where("section_name = 'References'").count() == 0
    blocks = pl.context(got.chunks, ["graph method", "improves"], 2, 3, SMALL).collect()
    assert len(blocks) == 2 and all(b.context.startswith("[") for b in blocks)
    table = pl.knowledge(sv.Service(lambda m, n: ('{"Dataset": "X"}', 1)), pl.context(got.chunks, ["graph"], 1, 1, SMALL), ["Dataset", "Optimizer"])
    assert {(r.Dataset, r.Optimizer) for r in table.collect()} == {("X", sv.NOT_FOUND)}
    assert pl.search(ps.limit(0), texts, "x", how=SMALL).papers.count() == 0


def test_contradictions(spark):
    claims = spark.createDataFrame([(1, "p", "Accuracy", "Accuracy improves by 18%."), (2, "q", "accuracy", "Accuracy drops by 12% relative to it."), (3, "q", "Other", "Unrelated.")], "ordinal long, paper string, topic string, claim string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.43589]), (3, [0.0, 1.0])], "ordinal long, vec array<double>")
    got = pl.contradictions(claims, vec).collect()
    assert [(r.paper_a, r.paper_b, r.prediction, r.classification, r.root_cause) for r in got] == [("p", "q", "Likely Contradiction", "Insufficient Evidence", "Not Applicable")]
    model = lambda m, n: ('[{"index": 1, "classification": "Contradiction", "confidence": 90, "category": "Different Dataset"}]', 1)
    got = pl.contradictions(claims, vec, sv.Service(model)).first()
    assert (got.classification, got.confidence, got.root_cause) == ("Contradiction", 90, "Different Dataset")


def analysed(spark):
    """Two papers with an index, and a model that answers for every agent."""
    held = spark.createDataFrame([(1, "p1", "First", 2020, "openalex"), (2, "p2", "Second", None, "core"), (3, "p3", "Third", 2021, "core")], "rank long, paper_id string, title string, year int, source string")
    chunks = spark.createDataFrame([("p1", 0, "Introduction", "c0", "graph routing problem latency is high"), ("p1", 1, "Results", "c1", "accuracy improves by 18% on the benchmark"), ("p2", 0, "Body", "c2", "future work and limitations of latency")], "paper_id string, chunk_ord long, section_name string, chunk_id string, chunk_text string")
    answers = {
        "Extract the listed": {"ai_technique": "GNN, RL", "ai_model": "GCN", "accuracy": "95.2%", "research_gap": "energy is not measured", "dataset": "D1"},
        "gap_label": {"clusters": [{"index": 1, "gap_label": "Energy", "recommendation": "measure"}]}, "future_work_label": {"clusters": []},
        "one insight": {"insights": [{"category": "Research Trend", "insight": "graphs"}]}, "main_problem": {"papers": [{"index": 1, "main_problem": "High Latency", "secondary_problems": ["Cost"]}, {"index": 2, "main_problem": "High Latency"}]},
        "problem_label": {"clusters": [{"index": 1, "problem_label": "Latency"}]},
        "checkable": {"papers": [{"index": 1, "claims": [{"topic": "Accuracy", "claim_text": "accuracy improves by 18% here", "claim_type": "Result"}]}, {"index": 2, "claims": [{"topic": "Accuracy", "claim_text": "accuracy drops by 18% here", "claim_type": "Result"}]}]},
        "Classify": {"comparisons": [{"index": 1, "classification": "Contradiction", "confidence": 80, "supporting_evidence": ["e1", "e2"]}]}, "root cause": {"root_causes": [{"index": 1, "category": "Different Dataset"}]},
        "Recommend": {"recommendations": [{"current_approach": " GCN ", "supporting_papers": ["second", "FIRST", "none"]}, {"why_better": "x"}], "final_recommendation": {"recommended_ai_model": "GAT"}},
    }
    asked = []

    def model(messages, n):
        asked.append(messages)
        return next(json.dumps(a) for w, a in answers.items() if w in messages[0]["content"]), 1

    return held, pl.build_index(chunks), sv.Service(model), asked


def test_analysis_from_papers_to_recommendation(spark):
    held, index, service, asked = analysed(spark)
    assert {r.paper_id: r.label for r in pl.index_labels(held, index).collect()} == {"p1": "RAG (2 chunks from Full PDF)", "p2": "RAG (1 chunk from Full PDF)", "p3": "Not Available"}
    assert [r.chunk_ord for r in pl.retrieve(index, [("accuracy benchmark", 1)]).where("paper_id = 'p1'").collect()] == [1]
    got = pl.analyze_papers(held, index, service)
    table = {r.title: r for r in got.knowledge.collect()}
    assert table["First"].year == "2020" and table["Second"].year == sv.NOT_FOUND and table["Third"].evidence_source == "Not Available" and table["First"].optimizer == sv.NOT_FOUND
    overall = {r.category: (r.common, r.evidence) for r in got.overall.collect()}
    assert overall["Most Used AI Technique"] == ("GNN", "3 of 3 papers") and overall["Most Used Hardware"] == (sv.NOT_FOUND, sv.NOT_FOUND) and overall["Highest Reported Accuracy"] == ("95.2% - First", "Reported in 3 of 3 papers")
    assert got.gaps == [{"gap": "Energy", "papers": "First, Second, Third", "frequency": 3, "recommendation": "measure"}] and got.future_work == [] and got.insights[0]["insight"] == "graphs"
    assert {r.paper_id for r in got.retrieved.collect()} == {"p1", "p2"}
    problems = pl.analyze_problems_and_solutions(held, index, got.knowledge, got.overall, service)
    rows = [(r.problem, r.frequency, r.techniques, r.models, r.best, r.papers) for r in problems.table.orderBy("at").collect()]
    assert rows == [("Latency", 2, "GNN, RL", "GCN", "95.2% (Accuracy)", "First, Second"), ("Cost", 1, "GNN, RL", "GCN", "95.2% (Accuracy)", "First")] and problems.status == "success"
    assert {r.category: r.value for r in problems.summary.collect()} == {"Most Common Research Problem": "Latency (2 papers)", "Most Used AI Technique": "GNN", "Most Used AI Model": "GCN", "Problem With Most Proposed Solutions": "Latency (3 distinct techniques/models)", "Problem That Remains Least Solved": "Latency (3 distinct techniques/models)"}
    status, claims = pl.claims_of(held, index, service)
    compared = pl.contradictions(claims.drop("vec"), claims.select("ordinal", "vec"), service)
    r = compared.first()
    assert status == "success" and (r.paper_a, r.paper_b, r.classification, r.confidence, r.evidence, r.root_cause) == ("Paper 1: First", "Paper 2: Second", "Contradiction", 80, "e1; e2", "Different Dataset")
    assert any("Pair 1 (topic similarity 0." in m[1]["content"] and "Claim (Result): accuracy drops" in m[1]["content"] for m in asked)
    best = pl.recommendation(held, index, got.knowledge, got.overall, got.gaps, got.future_work, problems.table, problems.summary, compared, service)
    assert [tuple(r) for r in best.recommendations.select("current_approach", "why_better", "evidence").collect()] == [("GCN", "Not Reported", "Second, First"), ("Not Reported", "x", "General AI Best Practice")]
    final = {r.field: r.value for r in best.final.collect()}
    assert final["Recommended AI Model"] == "GAT" and final["Recommended AI Technique"] == "GNN" and final["Recommended Framework"].startswith("Use a reproducible") and len(final) == 9 and best.reason == ""
    assert {r.problem for r in best.improvements.collect()} >= {"Training Optimizer Not Reported"} and "Weak or Missing Performance Metrics" not in {r.problem for r in best.improvements.collect()}
    sent = json.loads(next(m[1]["content"] for m in asked if "Recommend improved" in m[0]["content"]))
    assert sent["papers"][0]["best_reported_metric"] == "95.2% (Accuracy)" and len(sent["supplementary_retrieved_evidence"]) == 2 and sent["contradictions"][0]["root_cause"] == "Different Dataset"


def test_analysis_without_a_model(spark):
    held, index, _, _ = analysed(spark)
    got = pl.analyze_papers(held, index)
    assert {r.common for r in got.overall.collect()} == {sv.NOT_FOUND} and got.gaps == [] and len(got.insights) == 8
    problems = pl.analyze_problems_and_solutions(held, index, got.knowledge, got.overall)
    assert problems.status == "llm_unavailable" and problems.table.count() == 0 and {r.value for r in problems.summary.collect()} == {"No data available"}
    status, claims = pl.claims_of(held, index, sv.Service())
    assert status == "llm_unavailable" and claims.count() == 0
    best = pl.recommendation(held, index, got.knowledge, got.overall, [], [], problems.table, problems.summary, spark.createDataFrame([], pl.COMPARED))
    assert best.reason and best.final.count() == 9 and best.recommendations.count() == 0
    assert pl.contradiction_status("success", 3, 0)[1].startswith("Claims were extracted") and pl.contradiction_status("success", 0, 0)[1].startswith("No checkable") and pl.contradiction_status("success", 3, 1) == ("success", "")


def test_embedding_chain_and_scores(spark):
    def broken():
        raise OSError("no model")

    def length_model():
        return lambda texts: [[len(t), 1.0] for t in texts]

    assert embedding.first_working([broken, length_model]) is length_model and embedding.first_working([broken]) is None
    rows = spark.createDataFrame([("abc",), (None,)], "t string")
    got = embedding.embed(rows, "t", length_model, "q: ").collect()
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-6 for r in got)
    assert [r.rerank_score for r in embedding.cross_score(rows, "q", "t", lambda: lambda pairs: [len(t) for _, t in pairs]).collect()] == [3.0, 0.0]


def test_texts_are_acquired_through_the_cache(spark, tmp_path):
    cache, asked = str(tmp_path / "cache"), str(tmp_path / "asked")

    def fetch(url):
        with open(asked, "a") as out:
            out.write(url + "\n")
        if url == "broken":
            raise OSError("403")
        return "" if url == "empty" else "Abstract\nshort one\nResults\nok  then\n12\nReferences\nx"

    rows = [("a", "good", "A"), ("b", "broken", " abstract of b "), ("c", None, "abstract of c"), ("d", "empty", None), ("a", "good", "A")]
    ps = spark.createDataFrame(rows, "paper_id string, pdf_url string, abstract string")
    want = {"a": "Abstract\nshort one\n\nResults\nok then", "b": "Abstract\nabstract of b", "c": "Abstract\nabstract of c"}
    assert {r.paper_id: r.full_text for r in pl.acquire_texts(ps, cache, fetch).collect()} == want
    assert sorted(open(asked).read().split()) == ["broken", "empty", "good"]
    assert {r.paper_id: r.full_text for r in pl.acquire_texts(ps, cache, fetch).collect()} == want
    assert sorted(open(asked).read().split()) == ["broken", "empty", "empty", "good"]


def test_spring_layout():
    from quillspark.operators.layout import spring_layout

    nodes = [f"{g}{i}" for g in "ab" for i in range(5)]
    edges = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)]
    at = spring_layout(nodes, [*edges, ("a0", "nobody")])
    assert at == spring_layout(nodes, edges) and len(at) == 10 and max(abs(c) for p in at.values() for c in p) <= 1
    gap = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
    near = [gap(*e) for e in edges]
    assert sum(near) / len(near) < min(1.0, sum(gap(f"a{i}", f"b{j}") for i in range(5) for j in range(5)) / 25)
    assert spring_layout([], []) == {} and len(spring_layout(["x"], [])) == 1


def test_tables_and_keys(spark, tmp_path):
    import hashlib

    files.write_table(spark.range(3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    digest = hashlib.sha256(b'{"a": 1, "b": [2]}').hexdigest()[:24]
    assert sv.cache_key("Agent", {"b": [2], "a": 1}, "v2", "paper") == f"paper::Agent::v2::{digest}" and sv.cache_key("Agent", {"b": [2], "a": 1}, "v2") == f"Agent::v2::{digest}"


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 page one")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF broken")

    def parse(content):
        if b"broken" in content:
            raise ValueError
        return ["one", "two"]

    assert [(r.paper_id, r.text) for r in files.documents(spark, str(tmp_path), parse).collect()] == [("a.pdf", "one\ntwo")]
    cache = str(tmp_path / "cache")
    assert files.read_cache(spark, cache).count() == 0
    files.append_cache(spark.createDataFrame([("p", "t")], "paper_id string, full_text string"), cache)
    assert files.read_cache(spark, cache).collect()[0].full_text == "t"
