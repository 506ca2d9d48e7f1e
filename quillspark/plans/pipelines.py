"""The entry points: search, paper analysis, problems and solutions, contradictions, recommendation (survey 3.1-3.3, 2.P).

Search works on any number of records. What comes after it works on the few papers that it keeps (Config.max_papers): their
passages are retrieved by Spark, and the language model is called from the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, NOT_FOUND, Config
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import claims as cl
from ..operators import fulltext as ft
from ..operators import ranking as rk
from ..operators import resolution as rs
from ..operators import synthesis as sy
from ..operators.embedding import Embedder, embed, hashing_embedder
from ..sources import connectors as cn
from ..sources import files, paged
from ..tables import stored
from . import service as sv


@dataclass
class SearchResult:
    papers: DataFrame  # final papers in rank order, with scores, summary and reason
    validation: DataFrame
    stats: DataFrame
    chunks: DataFrame


def search(papers: DataFrame, full_texts: DataFrame | Callable[[DataFrame], DataFrame], query: str, target: int = 10, top_k: int = DEFAULT.top_k, year_from: int | None = None, year_to: int | None = None, publishers: list[str] | None = None, how: Config = DEFAULT, service: sv.Service | None = None) -> SearchResult:
    """Merge duplicates, filter, rank, shorten, rerank, validate, collect until `target` are valid, chunk.

    papers: connectors.fan_out's schema; full_texts: paper_id, full_text, or what gives them for a batch of papers that is
    about to be judged. The filter stays after merging, which may change a record's year.
    """
    merged = cn.metadata_filter(rs.deduplicate(papers, how), year_from, year_to, publishers)
    merged = merged.withColumn("paper_id", tx.paper_id(F.col("doi"), F.col("title"))).withColumn("_t", tx.text_for_embedding(F.col("title"), F.col("abstract")))
    ranked = rk.term_cosine(merged, "ordinal", F.col("_t"), how.query_instruction + query)
    short = stored(rk.top_k(ranked, top_k, "score", "ordinal").withColumnRenamed("score", "similarity_score"), "short-list")  # read more than once
    scored = rk.offline_rerank(short, "ordinal", F.col("_t"), query).drop("score", "_t")
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rerank_score"), "ordinal")))  # top_k rows
    taken: list[DataFrame] = []

    def judge(batch: DataFrame) -> DataFrame:
        batch = stored(batch, "batch")
        acquired = ft.acquire(batch, full_texts(batch) if callable(full_texts) else full_texts, "paper_id")
        has = acquired.where("text IS NOT NULL")
        cut = ft.keep_sections(ft.split_sections(has.where("source_kind = 'Full PDF'"), "paper_id", F.col("text")))
        cleaned = ft.clean_text(cut, ["paper_id", "section_ord", "section_name"], "text").drop("kept_lines").select("paper_id", "section_ord", "section_name", "text")
        abstracts = has.where("source_kind = 'Abstract fallback'").select("paper_id", F.lit(1).alias("section_ord"), F.lit("Abstract").alias("section_name"), "text")
        taken.append(stored(cleaned.unionByName(abstracts), "sections"))
        return batch.join(ft.validation_of_missing(batch, ft.validate(taken[-1], "paper_id", how), "paper_id"), "paper_id")

    gated = ft.collect(placed, "rank", judge, target)
    sections, validation = reduce(DataFrame.unionByName, taken), gated.select("paper_id", "word_count", "unique_words", "sections_found", "status", "reasons")
    final = told(gated.where("final"), query, service or sv.Service())
    chunks = ft.chunk_sections(sections.join(final.select("paper_id"), "paper_id", "left_semi"), "paper_id", how)
    return SearchResult(final.orderBy("rank"), validation, ft.gate_stats(gated, F.col("status") == "VALID"), chunks)


def acquire_texts(papers: DataFrame, cache: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """The cache's paper_id, full_text after what papers lack there was fetched, sectioned, cleaned and added.

    papers: paper_id, pdf_url, abstract. Without a link, or where fetching or reading gives no text, the abstract is
    cached in its place; papers with neither stay out, and are asked for again the next time.
    """
    spark = papers.sparkSession
    texts = files.text_cache(spark, cache)
    missing = stored(papers.join(texts.get(papers).select("paper_id"), "paper_id", "left_anti").dropDuplicates(["paper_id"]), "missing")
    got = stored(files.fetched(missing, fetch).where("raw IS NOT NULL"), "fetched")  # asked for once
    cut = ft.keep_sections(ft.split_sections(got, "paper_id", F.col("raw")))
    cleaned = ft.clean_text(cut, ["paper_id", "section_ord", "section_name"], "text").where("text <> ''")
    full = ft.round_trip_text(cleaned.select("paper_id", "section_ord", "section_name", "text"), "paper_id").withColumnRenamed("text", "full_text")
    abstract = F.nullif(tx.strip(F.col("abstract")), F.lit(""))
    rest = missing.join(full.select("paper_id"), "paper_id", "left_anti").where(abstract.isNotNull()).select("paper_id", F.concat(F.lit("Abstract\n"), abstract).alias("full_text"))
    texts.put(full.unionByName(rest))
    return texts.read()


def told(papers: DataFrame, query: str, service: sv.Service) -> DataFrame:
    """K2, K3: papers with ai_summary and ai_reason. Without a model both are columns; with one, the papers shown are few."""
    if service.model is None:
        return papers.withColumn("ai_summary", sy.summary_fallback(F.col("abstract"))).withColumn("ai_reason", F.lit(sy.NO_REASON))
    rows = papers.select("ordinal", "title", "abstract").collect()  # `target` rows at most
    said = papers.sparkSession.createDataFrame([(r.ordinal, sv.summarise(service, r.title, r.abstract), sv.relevance(service, query, r.title, r.abstract)) for r in rows], "ordinal long, ai_summary string, ai_reason string")
    return papers.join(said, "ordinal")


def build_index(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with `vec`, unit vectors of their texts, ready for retrieve(). No embedder: hashed words."""
    return stored(embed(chunks, "chunk_text", embedder or hashing_embedder()), "index")


def index_labels(papers: DataFrame, index: DataFrame) -> DataFrame:
    """What each paper's index says of itself; 'Not Available' where it has no chunks."""
    return papers.select("paper_id").join(rk.index_label(index, "paper_id"), "paper_id", "left").fillna({"label": "Not Available"})


def retrieve(index: DataFrame, queries: list[tuple[str, int]], cap: int | None = None, embedder: Embedder | None = None, how: Config = DEFAULT) -> DataFrame:
    """Per paper the chunks for (query, k) pairs, a chunk once at its best similarity, the `cap` best, in document
    order as `position`. Query vectors carry the instruction, chunk vectors do not."""
    spark = index.sparkSession
    asked = embed(spark.createDataFrame([(i, how.query_instruction + q) for i, (q, _) in enumerate(queries)], "query_id int, q string"), "q", embedder or hashing_embedder(), out="qvec")
    found = rk.group_top_k(index.select("paper_id", "chunk_ord", F.col("vec")), asked.select("query_id", "qvec"), "paper_id", "chunk_ord", max(k for _, k in queries))
    most = F.create_map(*[F.lit(x) for i, (_, k) in enumerate(queries) for x in (i, k)])
    merged = rk.merge_context(found.where(F.col("rank") <= F.element_at(most, F.col("query_id"))), "paper_id", "chunk_ord", cap)
    return merged.join(index.drop("vec"), ["paper_id", "chunk_ord"])


def blocks(retrieved: DataFrame) -> DataFrame:
    """paper_id and its passages as one text of '[Section] text' blocks, in document order."""
    block = F.struct("position", F.concat(F.lit("["), F.col("section_name"), F.lit("] "), F.col("chunk_text")).alias("b"))
    return retrieved.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def context(chunks: DataFrame, queries: list[str], k: int, cap: int | None = DEFAULT.context_chunks, how: Config = DEFAULT, embedder: Embedder | None = None) -> DataFrame:
    """Per paper the passages for several queries as one text."""
    return blocks(retrieve(build_index(chunks, embedder), [(q, k) for q in queries], cap, embedder, how))


def _contexts(papers: list, index: DataFrame, queries: list[tuple[str, int]], cap: int | None, embedder: Embedder | None, how: Config) -> list[str]:
    """The passages of each of a few papers; '' where there are none."""
    held = {r.paper_id: r.context for r in blocks(retrieve(index, queries, cap, embedder, how)).collect()}
    return [held.get(p.paper_id, "") for p in papers]


# What passages are asked for, and how many chunks each question gets.
FIELD_GROUPS = [
    ["research_domain", "objectives", "key_contributions"], ["ai_technique", "ai_model", "model_architecture", "llm_used", "agent_framework", "embedding_model"],
    ["dataset", "preprocessing"], ["optimizer", "loss_function", "learning_rate", "epochs", "hyperparameters", "training_strategy"], ["programming_language", "framework", "hardware"],
    ["evaluation_metrics", "accuracy", "precision", "recall", "f1_score", "auc", "map_score"],
]
GAP_QUERY, FUTURE_QUERY = "limitations, discussion, conclusion, research gap, open problems", "future work, conclusion, discussion, next steps, future research directions"
PROBLEM_QUERY, CLAIM_QUERY = "problem statement, research problem, methodology, results", "claims, experimental results, evaluation, discussion, findings"
INVENTOR_QUERY = "best results, highest accuracy, datasets, models, future work, research gaps"
PER_GROUP, PER_GAP, PER_TASK = 4, 2, 3
KNOWLEDGE = [*[f for g in FIELD_GROUPS for f in g], "research_gap", "limitations", "future_work"]
OVERALL = [
    ("Most Used AI Technique", "ai_technique"), ("Most Used AI Model", "ai_model"), ("Most Used Dataset", "dataset"), ("Most Used Framework", "framework"),
    ("Most Used Evaluation Metric", "evaluation_metrics"), ("Most Used Programming Language", "programming_language"), ("Most Used Hardware", "hardware"), ("Most Common Research Domain", "research_domain"),
]
COLUMN_OF = {"Dataset": "dataset", "Optimizer": "optimizer", "Loss Function": "loss_function", "Hyperparameters": "hyperparameters", "Hardware": "hardware", "Evaluation Metrics": "evaluation_metrics", "Accuracy": "accuracy", "F1 Score": "f1_score", "Precision": "precision", "Recall": "recall", "AUC": "auc", "mAP": "map_score"}


def knowledge(service: sv.Service, contexts: DataFrame, fields: list[str], how: Config = DEFAULT) -> DataFrame:
    """K4: a row of fields per paper, at most `max_papers`; calls run on the driver over their contexts."""
    rows = contexts.orderBy("paper_id").limit(how.max_papers).collect()
    made = [(r.paper_id, *sv.extract_knowledge(service, r.paper_id, r.context, fields)[1].values()) for r in rows]
    return contexts.sparkSession.createDataFrame(made, "paper_id string, " + ", ".join(f"`{f}` string" for f in fields))


def _clusters(spark: SparkSession, items: list[tuple[str, str]], least: float, embedder: Embedder | None) -> list[list[tuple[str, str]]]:
    """(paper, text) items in greedy clusters, in order of their first members; the sentinel is no text."""
    kept = [(0, i, p, t) for i, (p, t) in enumerate(items) if t and t.lower() != NOT_FOUND.lower()]
    rows = embed(spark.createDataFrame(kept, "one int, i long, paper string, t string"), "t", embedder or hashing_embedder())
    out: dict[int, list[tuple[str, str]]] = {}
    for r in ag.cluster(rows, "one", "i", "vec", least).orderBy("i").collect():  # statements of at most max_papers papers
        out.setdefault(r.cluster, []).append((r.paper, r.t))
    return [out[k] for k in sorted(out)]


@dataclass
class PaperAnalysis:
    knowledge: DataFrame  # paper_id, title, year, source, evidence_source and a column per field
    overall: DataFrame  # category, common, evidence
    items: DataFrame  # category, token, n, rank
    gaps: list[dict]
    future_work: list[dict]
    insights: list[dict]
    retrieved: DataFrame


def analyze_papers(papers: DataFrame, index: DataFrame, service: sv.Service | None = None, embedder: Embedder | None = None, how: Config = DEFAULT) -> PaperAnalysis:
    """Knowledge per paper, what is common, research gaps, future work, insights, and the chunks that were read.

    papers: rank, paper_id, title, year, source; the first `max_papers` count. index: build_index().
    """
    service, spark = service or sv.Service(), papers.sparkSession
    held = papers.orderBy("rank").limit(how.max_papers).collect()
    queries = [(", ".join(f.replace("_", " ") for f in g), PER_GROUP) for g in FIELD_GROUPS] + [(GAP_QUERY, PER_GAP), (FUTURE_QUERY, PER_GAP)]
    own = index.join(spark.createDataFrame([(p.paper_id, p.title) for p in held], "paper_id string, paper string"), "paper_id", "left_semi")
    found = stored(retrieve(own, queries, how.context_chunks, embedder, how), "retrieved")
    passages = {r.paper_id: r.context for r in blocks(found).collect()}
    labels = {r.paper_id: r.label for r in index_labels(papers, index).collect()}
    rows = [(p.rank, p.paper_id, p.title, str(p.year or NOT_FOUND), p.source, labels[p.paper_id], *sv.extract_knowledge(service, p.title, passages.get(p.paper_id, ""), KNOWLEDGE)[1].values()) for p in held]
    table = spark.createDataFrame(rows, "rank long, paper_id string, title string, year string, source string, evidence_source string, " + ", ".join(f"{f} string" for f in KNOWLEDGE))
    items = ag.frequency(ag.unpivot(table, "rank", [f for _, f in OVERALL]), F.col("category"), F.col("value"), "rank")
    named = spark.createDataFrame(OVERALL, "category string, field string")
    top = ag.top_with_evidence(items, len(held)).withColumnRenamed("category", "field")
    overall = named.join(top, "field", "left").select("category", F.coalesce("token", F.lit(NOT_FOUND)).alias("common"), F.coalesce("evidence", F.lit(NOT_FOUND)).alias("evidence"))
    best = ag.highest_number(table.withColumn("accuracy", F.when(~tx.is_missing(F.col("accuracy")), F.concat("accuracy", F.lit(" - "), "title"))), "accuracy", "rank")
    shown = F.when(F.col("accuracy").isNotNull(), F.format_string(f"Reported in %d of {len(held)} papers", "reported")).otherwise(f"0 of {len(held)} papers report accuracy")
    overall = stored(overall.unionByName(best.select(F.lit("Highest Reported Accuracy").alias("category"), F.coalesce("accuracy", F.lit(NOT_FOUND)).alias("common"), shown.alias("evidence"))), "overall")
    at = {f: i + 6 for i, f in enumerate(KNOWLEDGE)}
    texts = lambda f: [(r[2], r[at[f]]) for r in rows]
    joined = lambda c: ", ".join(sorted({p for p, _ in c}))
    gap_groups, work_groups = (_clusters(spark, texts(f), how.gap_cluster, embedder) for f in ("research_gap", "future_work"))
    gaps = sorted(({"gap": l["gap"], "papers": joined(c), "frequency": len(c), "recommendation": l["recommendation"]} for c, l in zip(gap_groups, sv.label_gaps(service, gap_groups), strict=True)), key=lambda g: -g["frequency"])
    work = sorted(({"future_work": l, "papers": joined(c), "frequency": len(c)} for c, l in zip(work_groups, sv.label_future_work(service, work_groups), strict=True)), key=lambda g: -g["frequency"])
    said = sv.insights(service, len(held), [r.asDict() for r in overall.collect()], [(g["gap"], g["frequency"]) for g in gaps], [(g["future_work"], g["frequency"]) for g in work])
    return PaperAnalysis(table, overall, items, gaps, work, said, rk.transparency(found, F.col("chunk_text")))


@dataclass
class ProblemAnalysis:
    table: DataFrame  # problem, frequency, techniques, models, best, papers, in order `at`
    summary: DataFrame  # category, value
    status: str


def analyze_problems_and_solutions(papers: DataFrame, index: DataFrame, table: DataFrame, overall: DataFrame, service: sv.Service | None = None, embedder: Embedder | None = None, how: Config = DEFAULT) -> ProblemAnalysis:
    """K7 -> E12 -> K8 -> D9 -> G14 -> G15: problems that papers name, grouped and labelled, with the solutions that
    the knowledge table holds for their papers (by title; a paper without a row adds nothing)."""
    service, spark = service or sv.Service(), papers.sparkSession
    held = papers.orderBy("rank").limit(how.max_papers).collect()
    status, found = sv.extract_problems(service, [p.title for p in held], _contexts(held, index, [(PROBLEM_QUERY, PER_TASK)], None, embedder, how) if service.model is not None else [""] * len(held))
    items = [(p.title, t) for p, f in zip(held, found, strict=True) for t in [*([f["main"]] if f["main"] != NOT_FOUND else []), *f["secondary"]]]
    groups = _clusters(spark, items, how.problem_cluster, embedder) if items else []
    members = [(i, label, paper) for i, (c, label) in enumerate(zip(groups, sv.label_problems(service, groups), strict=True)) for paper in sorted({p for p, _ in c})]
    rows = spark.createDataFrame(members, "cluster int, label string, title string")
    joined = title_lookup(rows, table, ["ai_technique", "ai_model", *[COLUMN_OF[m] for m in sy.METRIC_COLUMNS]])
    made = ag.problem_table(joined, "cluster", "title", "ai_technique", "ai_model", {m: COLUMN_OF[m] for m in sy.METRIC_COLUMNS})
    order = Window.orderBy(F.desc("frequency"), "cluster")  # problems of at most max_papers papers
    made = stored(made.join(rows.groupBy("cluster").agg(F.first("label").alias("problem")), "cluster").withColumn("at", F.row_number().over(order)), "problems")
    return ProblemAnalysis(made.drop("cluster", "diversity"), ag.problem_summary(made, "problem", "at", overall), "success" if members else status)


def title_lookup(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with columns of the table's row of their title (of several the last by rank); the sentinel without one."""
    last = table.groupBy("title").agg(*[F.max_by(c, "rank").alias(c) for c in columns])
    return rows.join(last, "title", "left").fillna(NOT_FOUND, subset=columns)


def claims_of(papers: DataFrame, index: DataFrame, service: sv.Service, embedder: Embedder | None = None, how: Config = DEFAULT) -> tuple[str, DataFrame]:
    """K9 with its retrieval: (status, claims): ordinal, paper ('Paper i: title'), topic, claim, kind, and vec."""
    held = papers.orderBy("rank").limit(how.max_papers).collect()
    contexts = _contexts(held, index, [(CLAIM_QUERY, PER_TASK)], None, embedder, how) if service.model is not None else [""] * len(held)
    status, found = sv.extract_claims(service, [f"Paper {i}: {p.title}" for i, p in enumerate(held, 1)], [p.title for p in held], contexts)
    rows = papers.sparkSession.createDataFrame([(i, c["paper"], c["topic"], c["claim"], c["kind"]) for i, c in enumerate(found)], "ordinal long, paper string, topic string, claim string, kind string")
    return status, embed(rows, "claim", embedder or hashing_embedder())


COMPARED = "paper_a string, paper_b string, topic string, claim_a string, claim_b string, similarity double, prediction string, score double, prediction_reason string, classification string, confidence int, reason string, evidence string, root_cause string"


def contradictions(claims: DataFrame, vectors: DataFrame, service: sv.Service | None = None, how: Config = DEFAULT) -> DataFrame:
    """Claims of different papers, paired by similarity, with rule-based risk (D11: one per pair) and the model's class.

    claims: ordinal, paper, topic, claim, and kind if known; vectors: ordinal, vec (unit). Without a model every
    pair is Insufficient Evidence at confidence 0. evidence: '; '-joined, or Not Mentioned (L3).
    """
    service = service or sv.Service()
    claims = claims if "kind" in claims.columns else claims.withColumn("kind", F.lit("Unspecified"))
    capped = cl.cap_per_group(claims, "paper", "ordinal", how.claims_per_paper).join(vectors, "ordinal")
    pairs = cl.match_pairs(capped, "paper", "ordinal", "vec", how.claim_similarity, how.claim_pairs)
    side = lambda s: claims.select(F.col("ordinal").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("topic", "claim", "kind")])
    wide = pairs.join(side("a"), "a").join(side("b"), "b").withColumnRenamed("group_a", "paper_a").withColumnRenamed("group_b", "paper_b")
    rows = cl.predict(wide).orderBy(F.desc(F.round("similarity", 9)), "a", "b").collect()  # at most claim_pairs rows
    of = lambda r, s: {"label": r[f"paper_{s}"], "topic": r[f"topic_{s}"], "claim": r[f"claim_{s}"], "kind": r[f"kind_{s}"]}
    told_pairs = [sv.pair_block(of(r, "a"), of(r, "b"), r.similarity) for r in rows]
    _, classes = sv.classify_pairs(service, told_pairs, cl.CLASSES)
    causes = sv.root_causes(service, [f"{r.claim_a}\n{r.claim_b}" for r in rows], [c["classification"] in cl.FLAGGED for c in classes])
    made = [(str(r.paper_a), str(r.paper_b), r.topic_a, r.claim_a, r.claim_b, r.similarity, r.prediction, r.score, r.reason, c["classification"], c["confidence"], c["reason"], "; ".join(c["supporting_evidence"]) or "Not Mentioned", k["category"]) for r, c, k in zip(rows, classes, causes, strict=True)]
    return claims.sparkSession.createDataFrame(made, COMPARED)


def contradiction_status(claim_status: str, claims: int, comparisons: int) -> tuple[str, str]:
    """What a report says of itself. Both ways to lack evidence have their own words."""
    if comparisons:
        return "success", ""
    if claim_status == "insufficient_evidence":
        return claim_status, sy.NO_CLAIMS
    if claim_status != "success":
        return claim_status, sy.STATUS_MESSAGES[claim_status]
    return "insufficient_evidence", sy.NO_SHARED_TOPIC if claims else sy.NO_EXTRACTED_CLAIMS


@dataclass
class Recommendation:
    final: DataFrame  # at, field, value
    recommendations: DataFrame
    improvements: DataFrame
    reason: str  # why there is none, or ''


def recommendation(papers: DataFrame, index: DataFrame, table: DataFrame, overall: DataFrame, gaps: list[dict], future_work: list[dict], problems: DataFrame, summary: DataFrame, compared: DataFrame, service: sv.Service | None = None, embedder: Embedder | None = None, how: Config = DEFAULT) -> Recommendation:
    """The model's recommendations with citations checked, the floor of best practices if it gives no improvement, and
    the nine final fields with their defaults.

    table: analyze_papers' knowledge; gaps and future_work: most frequent first; problems: in order `at`; compared: contradictions().
    """
    service, spark = service or sv.Service(), papers.sparkSession
    known = [f for f in sy.COVERAGE_FIELDS if COLUMN_OF[f] in table.columns]
    family = [COLUMN_OF[m] for m in sy.METRIC_COLUMNS if COLUMN_OF[m] in table.columns]
    shown = table.select(*[F.col(COLUMN_OF[f]).alias(f) for f in known], *family)
    covered = stored(ag.coverage(shown, known, {sy.METRIC_FAMILY: family} if family else None), "coverage")
    empty = lambda columns: spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    if service.model is None or not table.take(1):
        why = sy.STATUS_MESSAGES["llm_unavailable"] if table.take(1) else "No Knowledge Retrieval data is available yet - run a search first."
        return Recommendation(sy.final_recommendation(spark.createDataFrame([], "key string, given string"), overall, covered), empty([*sy.ADVICE, "evidence"]), empty([*sy.IMPROVEMENT, "evidence"]), why)
    held = papers.orderBy("rank").limit(how.max_papers).collect()
    more = supplementary(retrieve(index, [(INVENTOR_QUERY, 1)], None, embedder, how), "chunk_text")
    listed = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  tables of at most max_papers papers
    causes = compared.where(F.col("classification").isin(*cl.FLAGGED)).select("paper_a", "paper_b", "topic", "classification", "root_cause").limit(4)
    told_all = {
        "papers": listed(condensed(table)), "overall_analysis": listed(overall), "field_coverage": listed(covered), "research_gap_analysis": gaps[:5], "future_work_analysis": future_work[:5],
        "problem_solution_table": listed(problems.orderBy("at").limit(4)), "problem_solution_summary": listed(summary), "contradictions": listed(causes), "supplementary_retrieved_evidence": listed(more),
    }
    given = service.ask("InventorAgent", "Recommend improved research directions: recommendations, improvement_table and final_recommendation, citing titles in supporting_papers.", json.dumps(told_all, separators=(",", ":")), 1200, {}, lambda x: x if isinstance(x, dict) else None, paper_id=f"papers[{len(held)}]")[1]
    titles = spark.createDataFrame([(p.title,) for p in held], "title string")

    def rows(name: str, columns: list[str]) -> DataFrame:
        entries = [e for e in given.get(name) or [] if isinstance(e, dict)] if isinstance(given.get(name), list) else []
        made = spark.createDataFrame([(i, *[None if e.get(c) is None else str(e[c]) for c in columns]) for i, e in enumerate(entries)], "i int, " + ", ".join(f"{c} string" for c in columns))
        cited = spark.createDataFrame([(i, at, str(t)) for i, e in enumerate(entries) for at, t in enumerate(e.get("supporting_papers") if isinstance(e.get("supporting_papers"), list) else [])], "i int, at int, cited string")
        return sy.normalise_recommendation(made, columns).join(sy.evidence(made.select("i"), sy.verified_citations(cited, titles, "title"), "i"), "i").orderBy("i").drop("i")

    final = given.get("final_recommendation") if isinstance(given.get("final_recommendation"), dict) else {}
    advice, improved = rows("recommendations", sy.ADVICE), rows("improvement_table", sy.IMPROVEMENT)
    if not improved.take(1):
        improved = sy.floor_rows(covered)
    none = not advice.take(1) and not improved.take(1)
    answers = spark.createDataFrame([(k, None if final.get(k) is None else str(final[k])) for k, *_ in sy.FINAL_FIELDS], "key string, given string")
    return Recommendation(sy.final_recommendation(answers, overall, covered), advice, improved, sy.NOTHING_TO_SAY if none else "")


@dataclass
class Run:
    found: SearchResult
    sources: DataFrame  # source, status
    analysis: PaperAnalysis | None = None
    problems: ProblemAnalysis | None = None
    claims_status: str = ""
    compared: DataFrame | None = None
    advice: Recommendation | None = None


def run_pipeline(spark: SparkSession, query: str, urls: dict[str, str | None], cache: str, fetch: Callable[[str], str | None], target: int = 10, queries: dict[str, str] | None = None, year_from: int | None = None, year_to: int | None = None, publishers: list[str] | None = None, top_k: int = DEFAULT.top_k, how: Config = DEFAULT, service: sv.Service | None = None, embedder: Embedder | None = None, **options: object) -> Run:
    """2.P: from a query to papers, validation and all analyses. Pages are fetched by tasks (paged.search; options are the
    source's); full texts through the cache, only of papers that are about to be judged; nothing is analysed where no paper is valid.

    queries: what each source is asked, if not the query itself.
    """
    service = service or sv.Service()
    papers, sources = paged.search(spark, queries or query, urls, year_from, year_to, limit=how.results_per_source, attempts=how.retry_attempts, delay=how.retry_delay, **options)
    texts = lambda batch: acquire_texts(batch.select("paper_id", "pdf_url", "abstract"), cache, fetch)
    run = Run(search(papers, texts, query, target, top_k, year_from, year_to, publishers, how, service), stored(sources, "sources"))
    held = run.found.papers = stored(run.found.papers, "papers")
    if held.isEmpty():
        return run
    index = build_index(run.found.chunks, embedder)
    run.analysis = analyze_papers(held, index, service, embedder, how)
    run.problems = analyze_problems_and_solutions(held, index, run.analysis.knowledge, run.analysis.overall, service, embedder, how)
    run.claims_status, claims = claims_of(held, index, service, embedder, how)
    run.compared = contradictions(claims.drop("vec"), claims.select("ordinal", "vec"), service, how) if run.claims_status == "success" else spark.createDataFrame([], COMPARED)
    run.advice = recommendation(held, index, run.analysis.knowledge, run.analysis.overall, run.analysis.gaps, run.analysis.future_work, run.problems.table, run.problems.summary, run.compared, service, embedder, how)
    return run


def condensed(table: DataFrame) -> DataFrame:
    """The nine columns that a recommendation reads of the knowledge table."""
    metrics = [(m, F.col(COLUMN_OF[m])) for m in sy.METRIC_COLUMNS if COLUMN_OF[m] in table.columns]
    held = table.withColumn("best_reported_metric", tx.best_metric(metrics)).withColumnsRenamed({"key_contributions": "key_contribution"})
    return condense(held, ["title", "year", "ai_technique", "ai_model", "dataset", "framework", "best_reported_metric", "key_contribution", "limitations"])


def condense(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A projection with the sentinel for what is missing."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(NOT_FOUND)).alias(c) if c in rows.columns else F.lit(NOT_FOUND).alias(c) for c in columns])


def supplementary(found: DataFrame, text: str) -> DataFrame:
    """Each paper's best passage, 250 characters."""
    order = Window.partitionBy("paper_id").orderBy(F.desc("similarity"), "chunk_ord")
    return found.withColumn("_at", F.row_number().over(order)).where("_at = 1").select("paper_id", "section_name", tx.truncate(F.col(text), 250).alias("evidence"))


def chunks_by_paper(found: DataFrame) -> DataFrame:
    """paper_id and its retrieved chunks, best first."""
    listed = F.sort_array(F.collect_list(F.struct("similarity", (-F.col("chunk_ord")).alias("back"), "section_name", "chunk_text")), False)
    return found.groupBy("paper_id").agg(F.transform(listed, lambda c: F.struct(tx.rounded(c["similarity"], 3).alias("similarity"), c["section_name"].alias("section_name"), c["chunk_text"].alias("chunk_text"))).alias("chunks"))
