"""More registered queries, as in catalogue: source mappers, lookups, reports and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NOT_FOUND
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import claims as cl
from ..operators import fulltext as ft
from ..operators import ranking as rk
from ..operators import resolution as rs
from ..operators import synthesis as sy
from ..sources import connectors as cn
from . import pipelines as pl
from .catalogue import _CLASS, _KNN, _MISSING, _STRIP, _VALUES, _WORDS, _compared, _knn, query, t

_PAGE = 100


def _payloads(spark, sf_dir, item, path: list[str]) -> DataFrame:
    """Parts as payloads of 100 records each: page, body."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(item).alias("r")))), lambda x: x["r"]), ",")
    head, tail = "".join(f'{{"{n}":' for n in path) + "[", "]" + "}" * len(path)
    return t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / _PAGE).cast("int").alias("page")).agg(F.concat(F.lit(head), listed, F.lit(tail)).alias("body"))


def _shown(papers: DataFrame) -> DataFrame:
    return papers.select("page", "item", "title", F.array_join("authors", "|").alias("authors"), "year", "source", "doi", "abstract", "pdf_url", "publisher")


def _papers_sql(**c: str) -> str:
    kept = c.pop("kept", "true")
    return f"""SELECT (p_partkey // {_PAGE})::INT AS page, (p_partkey % {_PAGE})::INT AS item, {c['title']} AS title, {c['authors']} AS authors, {c['year']}::INT AS year, '{c['source']}' AS source, {c['doi']} AS doi, {c['abstract']} AS abstract, {c['pdf_url']} AS pdf_url, {c['publisher']} AS publisher FROM part WHERE {kept}"""


def _given(c: str, n: int):
    return F.when(F.col("p_partkey") % n > 0, F.col(c))


@query(_papers_sql(kept="p_partkey % 11 > 0", title="p_name", authors="p_brand || '|' || p_type", year="2000 + p_size % 25", source="openalex", doi="lower('10.1/' || p_brand)", abstract="CASE WHEN p_partkey % 3 > 0 THEN 'a ' || p_type || ' a' ELSE '' END", pdf_url="CASE WHEN p_partkey % 2 > 0 THEN p_type ELSE p_brand END", publisher="CASE WHEN p_partkey % 2 > 0 THEN p_name END"))
def source_openalex(spark, sf_dir):
    """A1, over records made of parts: inverted abstracts, venues that may be missing, untitled records."""
    name = lambda c: F.struct(F.struct(F.col(c).alias("display_name")).alias("author"))
    place = F.when(F.col("p_partkey") % 2 > 0, F.struct(F.col("p_type").alias("pdf_url"), F.struct(F.col("p_name").alias("display_name")).alias("source")))
    index = F.when(F.col("p_partkey") % 3 > 0, F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.col("p_type"), F.array(F.lit(1))))
    item = F.struct(_given("p_name", 11).alias("title"), F.array(name("p_brand"), name("p_type")).alias("authorships"), (2000 + F.col("p_size") % 25).alias("publication_year"), F.concat(F.lit("https://doi.org/10.1/"), "p_brand").alias("doi"), index.alias("abstract_inverted_index"), F.struct(F.col("p_brand").alias("oa_url")).alias("open_access"), place.alias("primary_location"))
    return _shown(cn.openalex(_payloads(spark, sf_dir, item, ["results"])))


@query(_papers_sql(title="p_name", authors="'G ' || p_brand", year="CASE WHEN p_partkey % 2 > 0 THEN 1990 + p_size ELSE 1980 END", source="crossref", doi="lower(p_type)", abstract="p_name || ' text'", pdf_url="CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE p_brand END", publisher="p_brand"))
def source_crossref(spark, sf_dir):
    """A2: date fallbacks, authors without family name, tagged abstracts, the link of type PDF."""
    dates = lambda y: F.struct(F.array(F.array(y.cast("int"), F.lit(1))).alias("date-parts"))
    link = F.when(F.col("p_partkey") % 3 > 0, F.array(F.struct(F.lit("html").alias("URL"), F.lit("text/html").alias("content-type")), F.struct(F.col("p_type").alias("URL"), F.lit("application/pdf").alias("content-type"))))
    authors = F.array(F.struct(F.lit("G").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit("x").alias("given"), F.lit(None).cast("string").alias("family")))
    online = F.when(F.col("p_partkey") % 2 > 0, dates(1990 + F.col("p_size")))
    item = F.struct(F.array("p_name").alias("title"), authors.alias("author"), online.alias("published-online"), dates(F.lit(1980)).alias("issued"), F.concat("p_type", F.lit("/")).alias("DOI"), F.concat(F.lit("<jats:p>"), "p_name", F.lit("</jats:p> <b>text</b>")).alias("abstract"), F.col("p_brand").alias("URL"), link.alias("link"), F.array("p_brand").alias("container-title"))
    return _shown(cn.crossref(_payloads(spark, sf_dir, item, ["message", "items"])))


@query(_papers_sql(title="p_name || ' a'", authors="p_brand || '|' || p_type", year="1990 + p_size % 9", source="arxiv", doi="NULL::VARCHAR", abstract="p_type || ' text'", pdf_url="CASE WHEN p_partkey % 2 > 0 THEN 'pdf' || p_partkey ELSE 'id' || p_partkey END", publisher="'arXiv'"))
def source_arxiv(spark, sf_dir):
    """A3: Atom entries; the record's id where no link is a PDF."""
    key = F.col("p_partkey").cast("string")
    link = F.when(F.col("p_partkey") % 2 > 0, F.concat(F.lit('<link title="pdf" href="pdf'), key, F.lit('"/>'))).otherwise("")
    entry = F.concat(F.lit("<entry><id>id"), key, F.lit("</id><title>"), "p_name", F.lit("\na</title><author><name>"), "p_brand", F.lit("</name></author><author><name>"), "p_type", F.lit("</name></author><published>"), (1990 + F.col("p_size") % 9).cast("string"), F.lit("-05-01</published><summary> "), "p_type", F.lit("\ntext </summary>"), link, F.lit("</entry>"))
    rows = t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / _PAGE).cast("int").alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), ""), F.lit("</feed>")).alias("body"))
    return _shown(cn.arxiv(rows))


@query(_papers_sql(title="p_name", authors="p_brand", year="CASE WHEN p_partkey % 4 > 0 THEN p_size END", source="core", doi="NULL::VARCHAR", abstract="coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_type END, '')", pdf_url="CASE WHEN p_partkey % 2 > 0 THEN p_type ELSE p_name END", publisher="p_brand"))
def source_core(spark, sf_dir):
    """A4."""
    item = F.struct(F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"), _given("p_size", 4).alias("yearPublished"), F.lit("https://doi.org/").alias("doi"), _given("p_type", 3).alias("abstract"), _given("p_type", 2).alias("downloadUrl"), F.array("p_name").alias("sourceFulltextUrls"), F.col("p_brand").alias("publisher"))
    return _shown(cn.core(_payloads(spark, sf_dir, item, ["results"])))


@query(_papers_sql(title="p_name", authors="p_brand || '|' || p_type", year="p_size", source="semantic_scholar", doi="CASE WHEN p_partkey % 2 > 0 THEN lower(p_brand) END", abstract="p_type", pdf_url="CASE WHEN p_partkey % 3 > 0 THEN p_type END", publisher="CASE WHEN p_partkey % 5 > 0 THEN p_brand END"))
def source_semantic_scholar(spark, sf_dir):
    """A5."""
    one = lambda c, n, name: F.when(F.col("p_partkey") % n > 0, F.struct(F.col(c).alias(name)))
    item = F.struct(F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("authors"), F.col("p_size").alias("year"), one("p_brand", 2, "DOI").alias("externalIds"), F.col("p_type").alias("abstract"), one("p_type", 3, "url").alias("openAccessPdf"), one("p_brand", 5, "publisher").alias("publicationVenue"))
    return _shown(cn.semantic_scholar(_payloads(spark, sf_dir, item, ["data"])))


@query(f"SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN source || '. ' || text ELSE source END AS text FROM documents")
def embedding_texts(spark, sf_dir):
    """B8."""
    return t(spark, sf_dir, "documents").select("doc_id", tx.text_for_embedding(F.col("source"), F.col("text")).alias("text"))


@query("SELECT page_id, substr(trim(regexp_replace(url, '^[^:]*:', '')), 1, 40) AS label FROM pages")
def short_labels(spark, sf_dir):
    """B28."""
    return t(spark, sf_dir, "pages").select("page_id", tx.short_label(F.col("url")).alias("label"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' (Accuracy)' WHEN p_partkey % 3 = 0 THEN p_type || ' (F1 Score)' ELSE '{NOT_FOUND}' END AS best FROM part")
def best_metrics(spark, sf_dir):
    """B29."""
    of = lambda c, n, other: F.when(F.col("p_partkey") % n == 0, F.col(c)).otherwise(other)
    return t(spark, sf_dir, "part").select("p_partkey", tx.best_metric([("Accuracy", of("p_brand", 2, NOT_FOUND)), ("F1 Score", of("p_type", 3, " "))]).alias("best"))


@query(f"SELECT p_name AS title, CASE WHEN p_partkey % 2 > 0 THEN p_type ELSE '{NOT_FOUND}' END AS ai_model, '{NOT_FOUND}' AS dataset FROM part")
def condensed_papers(spark, sf_dir):
    """B30."""
    rows = t(spark, sf_dir, "part").select(F.col("p_name").alias("title"), _given("p_type", 2).alias("ai_model"))
    return pl.condense(rows, ["title", "ai_model", "dataset"])


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'abstract' ELSE 'other' END AS kind FROM part")
def evidence_kinds(spark, sf_dir):
    """B31."""
    label = F.when(F.col("p_partkey") % 3 == 0, "RAG (3 chunks from Full PDF)").when(F.col("p_partkey") % 3 == 1, "RAG (1 chunk from Abstract fallback)").otherwise("Not Available")
    return t(spark, sf_dir, "part").select("p_partkey", tx.evidence_kind(label).alias("kind"))


@query(f"SELECT p_partkey, array_to_string(list_concat({_VALUES.format(c='p_name || ' + chr(39) + ', ' + chr(39) + ' || p_type')}, CASE WHEN p_partkey % 2 > 0 THEN ['; /'] ELSE [] END), '|') AS chips FROM part")
def chip_values(spark, sf_dir):
    """Two fields, one of them of separators alone or the sentinel."""
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type").alias("a"), F.when(F.col("p_partkey") % 2 > 0, " ; / ").otherwise(NOT_FOUND).alias("b"))
    split = ag.chips(rows.withColumn("b", F.replace("b", F.lit("; /"), F.lit(";,"))), "p_partkey", ["a", "b"])
    return split.select("p_partkey", F.replace(F.array_join("chips", "|"), F.lit(";,"), F.lit("; /")).alias("chips"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a|b' WHEN event_id % 3 = 1 THEN event_type ELSE '' END AS listed, CASE WHEN event_id % 2 = 0 THEN event_type || '|b' ELSE event_type END AS terms FROM events")
def string_lists(spark, sf_dir):
    """Lists out of JSON of any shape; terms without repeats."""
    json = F.when(F.col("event_id") % 3 == 0, '["a", " ", "b "]').when(F.col("event_id") % 3 == 1, F.concat(F.lit('" '), "event_type", F.lit('"'))).otherwise('{"a": 1}')
    terms = F.array("event_type", F.upper("event_type"), F.lit(" "), F.when(F.col("event_id") % 2 == 0, "b "), F.when(F.col("event_id") % 2 == 0, "B"))
    return t(spark, sf_dir, "events").select("event_id", F.array_join(tx.as_str_list(json), "|").alias("listed"), F.array_join(tx.dedupe_terms(terms), "|").alias("terms"))


@query(f"SELECT doc_id, length(text)::BIGINT AS chars, len({_WORDS.format(c='text')})::BIGINT AS words, substr(text, 1, 1000) AS head FROM documents")
def extraction_summary(spark, sf_dir):
    """F11."""
    return ft.extraction_summary(t(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT conv_id, role AS section_name, turn FROM conversations WHERE role <> 'user'")
def kept_sections(spark, sf_dir):
    """users' turns stand for sections that are ignored."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, "References").otherwise("Acknowledgements")).otherwise(F.col("role")).alias("section_name"))
    return ft.keep_sections(rows).select("conv_id", "section_name", "turn")


@query("SELECT o_orderkey, coalesce(c_name, 'Not Found in Retrieved Context') AS c_name, coalesce(c_mktsegment, 'Not Found in Retrieved Context') AS c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def title_lookup(spark, sf_dir):
    """Customers are the knowledge table, by title; those in debt have no row."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("title"))
    table = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("title"), F.col("c_custkey").alias("rank"), "c_name", "c_mktsegment")
    return pl.title_lookup(rows, table, ["c_name", "c_mktsegment"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("WITH e AS (SELECT user_id % 3000 AS index, arg_max(props, event_id) AS entry FROM events GROUP BY 1) SELECT p_partkey AS index, entry FROM part LEFT JOIN e ON p_partkey = e.index")
def index_entries(spark, sf_dir):
    """Of entries with one index the last wins; parts without entry have none."""
    entries = t(spark, sf_dir, "events").select((F.col("user_id") % 3000).alias("index"), F.col("props").alias("entry"), F.col("event_id").alias("pos"))
    return cl.by_index(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("index")), entries)


@query("SELECT event_id, event_type, value FROM events")
def positional_zip(spark, sf_dir):
    """Both halves of a table, side by side; with a side that is shorter nothing is joined."""
    e = t(spark, sf_dir, "events")
    whole = cl.zip_join(e.select("event_id", "event_type"), e.select("event_id", "value"), "event_id")
    return whole.unionByName(cl.zip_join(e.select("event_id", "event_type"), e.select("event_id", "value").where("value > 20"), "event_id"))


_HITS = "h AS (SELECT query_id, label, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3)"


def _hits(spark, sf_dir) -> DataFrame:
    found = _knn(spark, sf_dir, 3).withColumn("similarity", tx.rounded(F.col("similarity"), 6))
    return found.select("query_id", F.col("label").alias("paper_id"), F.col("vec_id").alias("chunk_ord"), "similarity", F.lit("Body").alias("section_name"), F.repeat(F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit(" ")), 30).alias("chunk_text"))


@query(f"WITH {_KNN}, {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS n FROM h) SELECT label AS paper_id, substr(repeat('chunk ' || vec_id || ' ', 30), 1, 250) || CASE WHEN length(repeat('chunk ' || vec_id || ' ', 30)) > 250 THEN '...' ELSE '' END AS evidence FROM n WHERE n = 1")
def supplementary_evidence(spark, sf_dir):
    """E15."""
    return pl.supplementary(_hits(spark, sf_dir), "chunk_text").select("paper_id", "evidence")


@query(f"WITH {_KNN}, {_HITS} SELECT query_id, label AS paper_id, vec_id AS chunk_ord, round(similarity, 3) AS similarity, substr(repeat('chunk ' || vec_id || ' ', 30), 1, 200) || CASE WHEN length(repeat('chunk ' || vec_id || ' ', 30)) > 200 THEN '...' ELSE '' END AS preview FROM h")
def retrieved_chunks(spark, sf_dir):
    """E16."""
    return rk.transparency(_hits(spark, sf_dir), F.col("chunk_text")).select("query_id", "paper_id", "chunk_ord", "similarity", "preview")


@query(f"WITH {_KNN}, {_HITS} SELECT label AS paper_id, string_agg(printf('%.3f', round(similarity, 3)) || ':' || vec_id, ',' ORDER BY similarity DESC, vec_id) AS chunks FROM h GROUP BY label")
def chunks_by_paper(spark, sf_dir):
    """D13."""
    found = pl.chunks_by_paper(_hits(spark, sf_dir))
    return found.select("paper_id", F.array_join(F.transform("chunks", lambda c: F.concat(F.format_number(c["similarity"], 3), F.lit(":"), F.regexp_extract(c["chunk_text"], r"\d+", 0))), ",").alias("chunks"))


@query(f"SELECT 'p::' || unnest([user_id % 40, event_id % 41]) AS source, 'c::' || event_type AS target FROM events WHERE ({_CLASS}) IN ('Contradiction', 'Partial Contradiction')")
def root_cause_network(spark, sf_dir):
    """G12."""
    flagged = _compared(spark, sf_dir).where(F.col("classification").isin(*cl.FLAGGED)).select(F.col("paper_a").cast("string").alias("paper_a"), F.col("paper_b").cast("string").alias("paper_b"), F.col("topic").alias("root_cause"))
    return cl.root_cause_edges(flagged)


@query(f"SELECT ({_CLASS}) AS classification, count(*)::BIGINT AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS comparisons FROM events GROUP BY 1")
def evidence_tree(spark, sf_dir):
    """G13."""
    tree = cl.evidence_tree(_compared(spark, sf_dir).withColumn("comparison", F.col("event_id")))
    return tree.select("classification", F.size("comparisons").cast("long").alias("n"), F.array_join(F.transform("comparisons", lambda c: c.cast("string")), ",").alias("comparisons"))


@query("SELECT n_nationkey AS row_id, coalesce((SELECT string_agg(c_name, ', ' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900), 'General AI Best Practice') AS evidence FROM nation")
def cited_evidence(spark, sf_dir):
    """Rows cite customers in other spelling, and others that do not exist."""
    customers = t(spark, sf_dir, "customer")
    cited = customers.select(F.col("c_nationkey").alias("row_id"), F.col("c_custkey").alias("at"), F.concat(F.lit(" "), F.when(F.col("c_acctbal") < -900, F.upper("c_name")).otherwise("nobody")).alias("cited"))
    return sy.evidence(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_id")), sy.verified_citations(cited, customers, "c_name"), "row_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE 'Not Reported' END AS problem, 'Not Reported' AS reason, p_name FROM part")
def normalised_rows(spark, sf_dir):
    """L7."""
    rows = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), _given("p_type", 3)).alias("problem"), F.lit("  ").alias("reason"), "p_name")
    return sy.normalise_recommendation(rows, ["problem", "reason"])


@query("""SELECT '[' || string_agg('{"p_name":"' || p_name || '","p_size":' || p_size || '}', ',' ORDER BY p_size DESC, p_partkey) || ']' AS context FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 5)""")
def context_json(spark, sf_dir):
    """The five first rows, as is the feature."""
    return sy.context_json(t(spark, sf_dir, "part"), ["p_name", "p_size"], [F.desc("p_size"), F.asc("p_partkey")], 5)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'retrieval_failure' ELSE 'success' END AS status, CASE event_id % 4 WHEN 1 THEN 'Related evidence was found, but not enough to report a confident result here. This is a valid outcome, not a failure.' WHEN 2 THEN 'No relevant text could be retrieved from the selected paper(s) - they may only have an abstract available, or their PDF could not be downloaded.' ELSE '' END AS message FROM events")
def status_of_reports(spark, sf_dir):
    """L9, L10."""
    n, claims = F.when(F.col("event_id") % 4 == 0, 3).when(F.col("event_id") % 4 == 3, 1).otherwise(0), F.when(F.col("event_id") % 4 >= 2, "retrieval_failure").otherwise("success")
    rows = t(spark, sf_dir, "events").select("event_id", sy.resolve_status(n, claims).alias("status"))
    return rows.withColumn("message", sy.status_message(F.col("status")))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT <= 6 AS kept FROM events")
def claims_cap(spark, sf_dir):
    """Six claims a paper."""
    rows = t(spark, sf_dir, "events").select("event_id", "event_type")
    kept = cl.cap_per_group(rows, "event_type", "event_id", 6).select("event_id", F.lit(True).alias("kept"))
    return rows.join(kept, "event_id", "left").fillna({"kept": False})


@query("""SELECT DISTINCT unnest([s_suppkey, o_suppkey]) AS id, min(least(s_suppkey, o_suppkey)) OVER (PARTITION BY k) AS component FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS o_suppkey, s_nationkey AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n > 1""")
def linked_groups(spark, sf_dir):
    """D3's components: suppliers of a nation form a chain."""
    from pyspark.sql import Window

    from ..operators.graph import components

    s = t(spark, sf_dir, "supplier")
    return components(s.select(F.col("s_suppkey").alias("u"), F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("v")).where("v IS NOT NULL"))


@query(f"SELECT p_partkey, {_MISSING.format(c='v')} AS missing FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '{NOT_FOUND}' ELSE p_name END AS v FROM part)")
def missing_values(spark, sf_dir):
    """C4."""
    v = F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 1, NOT_FOUND).otherwise(F.col("p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", tx.is_missing(v).alias("missing"))


@query("SELECT p_brand, n, row_number() OVER (ORDER BY n, p_brand)::INT AS \"at\" FROM (SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY p_brand)")
def bar_order(spark, sf_dir):
    """I4."""
    return ag.bar_order(t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "n", "p_brand")


@query()
def same_titles(spark, sf_dir):
    """Pairs of titles alike, the candidates of fuzzy_dedup; held against all pairs in the tests."""
    from ..config import DEFAULT

    docs, no = t(spark, sf_dir, "documents"), F.lit(None).cast("string")
    papers = docs.select(F.col("doc_id").alias("ordinal"), tx.first_sentence(F.col("text")).alias("title"), no.alias("doi"))
    return rs.relaxed_pairs(papers, DEFAULT)


@query()
def projection(spark, sf_dir):
    """Two principal components; signs are free, so tests hold their absolute values."""
    return rk.pca(t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "projection")


@query(f"SELECT page_id, {_STRIP.format(c='url')} AS abstract, 'No abstract available from the source API.' AS none FROM pages")
def summaries(spark, sf_dir):
    """K2 without a model: short abstracts as they are, none by its own words."""
    return t(spark, sf_dir, "pages").select("page_id", sy.summary_fallback(F.col("url")).alias("abstract"), sy.summary_fallback(F.lit("")).alias("none"))


RETRIEVED = [("energy of wireless networks", 2), ("the people and the market", 1)]


@query()
def retrieval_chain(spark, sf_dir):
    """Documents chunked, embedded, indexed by paper, and each one's best chunks for two questions;
    held against plain code in the tests."""
    import uuid

    from ..operators import fulltext as ft
    from ..operators.index import PaperIndex
    from ..tables import stored

    sections = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("section_ord"), F.lit("Body").alias("section_name"), "text")
    index = PaperIndex(spark, f"quillspark_chunks_{uuid.uuid4().hex}")
    index.add(ft.chunk_sections(sections, "paper_id").select("paper_id", "chunk_ord", "chunk_text"))
    found = stored(index.search(RETRIEVED, 2), "retrieved")
    index.drop()
    return found
