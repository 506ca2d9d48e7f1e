"""Full text: sections, cleaning, validation, gated collection, chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..tables import stored

# Canonical sections and the headings that name them.
SECTION_ALIASES = {
    "Abstract": ["abstract"],
    "Introduction": ["introduction", "background"],
    "Related Work": ["related work", "related works", "literature review", "prior work", "background and related work"],
    "Methodology": [
        "methodology", "method", "methods", "materials and methods", "proposed method", "proposed approach", "approach", "system design", "model architecture",
        "system architecture", "system model", "network model", "problem formulation", "problem statement", "algorithm", "proposed system", "framework",
        "experimental setup", "experimental design", "implementation",
    ],
    "Dataset": ["dataset", "datasets", "data description", "data collection"],
    "Results": [
        "results", "results and discussion", "experimental results", "evaluation", "results and analysis", "performance evaluation", "simulation results",
        "numerical results", "performance analysis", "numerical evaluation", "simulation", "simulation and results", "experiments",
    ],
    "Limitations": ["limitations", "threats to validity"],
    "Conclusion": [
        "conclusion", "conclusions", "summary", "conclusion and future work", "conclusions and future work", "conclusion and future works",
        "summary and conclusion", "discussion", "discussion and analysis",
    ],
    "Future Work": ["future work", "future directions", "future research", "future scope", "open challenges", "open problems"],
    "References": ["references", "bibliography"],
    "Acknowledgements": ["acknowledgements", "acknowledgments", "acknowledgement"],
}
IGNORED_SECTIONS = ["References", "Acknowledgements"]
HEADING = r"^\s*(?:[IVXLC]+\.|\d+(?:\.\d+)*\.?)?\s*([A-Za-z][A-Za-z \-]{2,45})\s*$"
RUN_IN_HEADING = r"^\s*([A-Za-z][A-Za-z \-]{1,30}?)\s*[\-—:.]\s*(\S.*)$"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"


def _canonical(heading: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, aliases in SECTION_ALIASES.items() for a in aliases for x in (a, name)])
    return F.try_element_at(known, F.lower(tx.strip(heading)))


def split_sections(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Key, section_ord, section_name, text. A heading holds until the next, before any: Body; sections of one
    name are one, in order of first appearance. Without an Abstract, the paragraph of Body that looks like one is it,
    and comes last. All within the row."""
    parts = "array<struct<name:string,lines:array<string>>>"

    def marked(line: Column, at: Column) -> Column:
        own, run_in = (_canonical(F.regexp_extract(line, pattern, 1)) for pattern in (HEADING, RUN_IN_HEADING))

        def said(h: Column) -> Column:
            rest = F.when(h["own"].isNull() & h["run_in"].isNotNull(), F.regexp_extract(line, RUN_IN_HEADING, 2))
            return F.struct(at.alias("at"), F.coalesce(h["own"], h["run_in"]).alias("name"), rest.alias("rest"))

        return tx.let(F.struct(own.alias("own"), run_in.alias("run_in")), said)  # either pattern reads the line once

    def cut(lines: Column) -> Column:
        start = F.array(F.struct(F.lit(-1).alias("at"), F.lit("Body").alias("name"), F.lit(None).cast("string").alias("rest")))
        return tx.let(F.concat(start, F.filter(F.transform(lines, marked), lambda m: m["name"].isNotNull())), lambda heads: gathered(lines, heads))

    def gathered(lines: Column, heads: Column) -> Column:
        end = lambda i: F.coalesce(F.get(heads, i + 1)["at"], F.size(lines))
        pieces = F.transform(heads, lambda h, i: F.struct(h["name"].alias("name"), F.concat(F.when(h["rest"].isNotNull(), F.array(h["rest"])).otherwise(F.array().cast("array<string>")), F.slice(lines, h["at"] + 2, end(i) - h["at"] - 1)).alias("lines")))
        names = F.array_distinct(F.transform(heads, lambda h: h["name"]))
        return tx.let(pieces, lambda ps: F.transform(names, lambda n: F.struct(n.alias("name"), F.flatten(F.transform(F.filter(ps, lambda p: p["name"] == n), lambda p: p["lines"])).alias("lines"))))

    def with_abstract(found: Column) -> Column:
        body = F.get(found, 0)["lines"]
        lifted = lambda g: F.concat(
            F.array(F.struct(F.lit("Body").alias("name"), F.concat(F.slice(body, 1, g["start"]), F.slice(body, g["end"] + 1, F.size(body))).alias("lines"))),
            F.slice(found, 2, F.size(found)), F.array(F.struct(F.lit("Abstract").alias("name"), F.slice(body, g["start"] + 1, g["end"] - g["start"]).alias("lines"))),
        ).cast(parts)
        guessed = tx.let(abstract_lines(body), lambda g: F.when(g.isNotNull(), lifted(g)).otherwise(found.cast(parts)))
        return F.when(F.exists(found, lambda f: f["name"] == "Abstract"), found.cast(parts)).otherwise(guessed)

    cuts = tx.let(F.split(text, "\n"), lambda lines: tx.let(cut(lines), with_abstract))
    sections = F.filter(F.transform(cuts, lambda c: F.struct(c["name"].alias("name"), tx.strip(F.array_join(c["lines"], "\n")).alias("text"))), lambda x: x["text"] != "")
    made = docs.select(key, F.posexplode_outer(sections).alias("at", "s")).where("s IS NOT NULL")  # a text without sections, or none, has no row
    return made.select(key, F.col("s.name").alias("section_name"), F.col("s.text").alias("text"), (F.col("at") + 1).alias("section_ord"))


def keep_sections(sections: DataFrame) -> DataFrame:
    """C5."""
    return sections.where(~F.col("section_name").isin(*IGNORED_SECTIONS))


def abstract_lines(lines: Column) -> Column:
    """(start, end) of the lines that look like an unheaded abstract, else null: from the first line of more than
    six words without '@' to a blank line or 250 words; 40 words and two sentence ends at least, 15 words a sentence."""

    def told(start: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), start.alias("end"), F.lit(False).alias("done"))

        def step(a: Column, l: Column) -> Column:
            n = a["n"] + tx.word_count(l)
            open_ = ~a["done"] & (tx.strip(l) != "")
            return F.struct(F.when(open_, n).otherwise(a["n"]).alias("n"), F.when(open_, a["end"] + 1).otherwise(a["end"]).alias("end"), (~open_ | (n >= 250)).alias("done"))

        end = F.aggregate(F.slice(lines, start + 1, F.size(lines)), zero, step, lambda a: a["end"])
        return tx.let(end, lambda e: tx.let(F.array_join(F.transform(F.slice(lines, start + 1, e - start), tx.strip), " "), lambda para: judged(start, e, para)))

    def judged(start: Column, end: Column, para: Column) -> Column:
        n, ends = tx.word_count(para), F.regexp_count(para, F.lit("[.!?]"))
        return F.when((n >= 40) & (ends >= 2) & (n / ends >= 15), F.struct(start.alias("start"), end.alias("end")))

    first = F.array_position(F.transform(lines, lambda l: ((tx.word_count(l) > 6) & ~l.contains("@")).cast("int")), 1).cast("int") - 1
    return tx.let(first, lambda at: F.when(at >= 0, told(at)))


def guess_abstract(text: Column) -> Column:
    """the abstract of a text without headings as one line, else null."""
    joined = lambda lines: tx.let(abstract_lines(lines), lambda g: F.when(g.isNotNull(), F.array_join(F.transform(F.slice(lines, g["start"] + 1, g["end"] - g["start"]), tx.strip), " ")))
    return tx.let(F.split(text, "\n"), joined)


def clean_text(sections: DataFrame, keys: list[str], text: str) -> DataFrame:
    """F8: page numbers and short lines that repeat three times go; runs of blanks and empty lines shrink. Rows of which
    no line is left go. All within the row: sorted, a line equals the one two places before it if it stands three times."""

    def kept(lines: Column) -> Column:
        ordered = F.array_sort(F.transform(lines, tx.strip))
        boiler = tx.let(ordered, lambda s: F.array_distinct(F.filter(s, lambda l, i: (i > 1) & (l != "") & (F.get(s, i - 2) == l) & (tx.word_count(l) <= 12))))
        return tx.let(boiler, lambda b: F.filter(lines, lambda l: ~l.rlike(PAGE_NUMBER) & ~F.array_contains(b, tx.strip(l))))

    cleaned = lambda lines: tx.strip(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))
    rows = sections.select(*keys, tx.let(tx.let(F.split(text, "\n"), kept), lambda k: F.struct(cleaned(k).alias("text"), F.size(k).cast("long").alias("n"))).alias("c"))
    return rows.where("c.n > 0").select(*keys, F.col("c.text").alias(text), F.col("c.n").alias("kept_lines"))


def acquire(papers: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Cached full text, else the stripped abstract; source_kind says which (null: neither)."""
    joined = papers.join(cached.select(key, F.col("full_text")), key, "left")
    full, abstract = F.nullif(tx.strip(F.col("full_text")), F.lit("")), F.nullif(tx.strip(F.col("abstract")), F.lit(""))
    return joined.withColumn("source_kind", F.when(full.isNotNull(), "Full PDF").when(abstract.isNotNull(), "Abstract fallback")).withColumn("text", F.coalesce(full, abstract)).drop("full_text")


def round_trip_text(sections: DataFrame, key: str) -> DataFrame:
    """Sections as one text, each but Body under its name."""
    part = F.when(F.col("section_name") == "Body", F.col("text")).otherwise(F.concat("section_name", F.lit("\n"), "text"))
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


def validate(sections: DataFrame, key: str, how: Config = DEFAULT) -> DataFrame:
    """key, word_count, unique_words, sections_found, status, reasons ('; '-joined). Papers without sections
    have no row here; see validation_of_missing()."""
    per = sections.select(key, "section_name", tx.word_count(F.col("text")).alias("w"), tx.unique_alpha_words(F.col("text")).alias("u"))
    agg = per.groupBy(key).agg(F.sum("w").cast("long").alias("word_count"), F.size(F.array_distinct(F.flatten(F.collect_list("u")))).cast("long").alias("unique_words"), F.array_sort(F.collect_set("section_name")).alias("found"))
    only = F.array_join("found", ",") == "Abstract"
    few_words = F.when(only, F.when(F.col("word_count") < how.min_abstract_words, F.format_string(f"Abstract-only fallback is only %d words (minimum {how.min_abstract_words} required).", "word_count"))).otherwise(
        F.when(F.col("word_count") < how.min_words, F.format_string(f"Extracted text is only %d words (minimum {how.min_words} required).", "word_count"))
    )
    few_unique = F.when(only, F.when(F.col("unique_words") < how.min_abstract_unique, F.format_string("Abstract-only fallback has only %d distinct words - looks degenerate or truncated.", "unique_words"))).otherwise(
        F.when(F.col("unique_words") < how.min_unique, F.format_string("No meaningful technical content detected (only %d distinct words - looks like a degenerate/garbled extraction rather than real prose).", "unique_words"))
    )
    reasons = F.array_compact(F.array(few_words, few_unique))
    return agg.select(key, "word_count", "unique_words", F.array_join("found", ", ").alias("sections_found"), F.when(F.size(reasons) > 0, "INVALID").otherwise("VALID").alias("status"), F.array_join(reasons, "; ").alias("reasons"))


def validation_of_missing(papers: DataFrame, validated: DataFrame, key: str) -> DataFrame:
    """Every paper's validation; those without sections are invalid."""
    out = papers.select(key).join(validated, key, "left")
    return out.withColumn("reasons", F.when(F.col("status").isNull(), "No retrievable content - PDF unavailable, download failed, or could not be parsed.").otherwise(F.col("reasons"))).fillna({"status": "INVALID", "word_count": 0, "unique_words": 0, "sections_found": ""})


def gate(ranked: DataFrame, rank: str, valid: Column, target: int) -> DataFrame:
    """batches of max(target, 8) in rank order until target are valid; adds batch, attempted, final, replaced.

    Counts per batch are summed first; the running sums then go over the batches (one row each), and only
    inside a batch over rows, so no task sees all rows.
    """
    size = max(target, 8)
    rows = ranked.withColumn("batch", F.floor((F.col(rank) - 1) / size)).withColumn("_v", valid.cast("int"))
    sums = rows.groupBy("batch").agg(F.sum("_v").alias("n"))
    before = F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("batch", F.coalesce(before, F.lit(0)).alias("before"))
    seen = F.col("before") + F.sum("_v").over(Window.partitionBy("batch").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(sums, "batch").withColumn("attempted", F.col("before") < target).withColumn("final", F.col("attempted") & (F.col("_v") == 1) & (seen <= target))
    return out.withColumn("replaced", F.col("final") & (F.col("batch") > 0)).drop("before", "_v")


def collect(ranked: DataFrame, rank: str, judge: Callable[[DataFrame], DataFrame], target: int) -> DataFrame:
    """F3 with an early stop: judge(batch) adds `status` to a batch of max(target, 8) ranks; the next batch is judged only
    while fewer than `target` are VALID. Rows that were attempted, with gate()'s columns. Each batch is written once judged.

    ranked: at most as many rows as a short list has, ranks from 1; batches are read from it by rank.
    """
    size, last = max(target, 8), ranked.agg(F.max(rank)).first()[0] or 0
    held = stored(ranked, "ranked")
    batches, valid, at = [], 0, 0
    while not batches or (valid < target and at < last):
        batches.append(stored(judge(held.where((F.col(rank) > at) & (F.col(rank) <= at + size))), "batch"))
        valid += batches[-1].where("status = 'VALID'").count()
        at += size
    return gate(reduce(DataFrame.unionByName, batches), rank, F.col("status") == "VALID", target)


def gate_stats(gated: DataFrame, valid: Column) -> DataFrame:
    return gated.agg(
        F.count_if("attempted").alias("retrieved"), F.count_if(F.col("attempted") & ~valid).alias("rejected"), F.count_if("replaced").alias("replaced"), F.count_if("final").alias("final"), F.count_if(F.col("attempted") & valid & ~F.col("final")).alias("surplus")
    )


def _split_long(s: Column, most: int) -> Column:
    """a sentence beyond the limit in word packs of at most `most` tokens."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        n = tx.token_count(w)
        over = (a["n"] + n > most) & (a["cur"] != "")
        return F.struct(F.when(over, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"), F.when(over | (a["cur"] == ""), w).otherwise(F.concat(a["cur"], F.lit(" "), w)).alias("cur"), F.when(over, n).otherwise(a["n"] + n).cast("int").alias("n"))

    packed = F.aggregate(tx.words(s), zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
    return F.when(tx.token_count(s) <= most, F.array(s)).otherwise(packed)


def chunk_text(text: Column, most: int = DEFAULT.chunk_tokens, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """chunks of whole sentences; after each, its last sentences of at most `overlap` tokens open the next."""
    pieces = F.transform(F.flatten(F.transform(tx.sentences(text), lambda s: _split_long(s, most))), lambda s: F.struct(s.alias("s"), tx.token_count(s).alias("n")))
    kind = "array<struct<s:string,n:int>>"
    empty = F.array().cast(kind)

    def carried(cur: Column) -> Column:
        zero = F.struct(empty.alias("keep"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def back(a: Column, x: Column) -> Column:
            fits = a["open"] & (a["n"] + x["n"] <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), a["keep"])).otherwise(a["keep"]).alias("keep"), F.when(fits, a["n"] + x["n"]).otherwise(a["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(cur), zero, back, lambda a: F.struct(a["keep"].alias("cur"), a["n"].alias("n")))

    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), " ")
    zero = F.struct(F.array().cast("array<string>").alias("out"), empty.alias("cur"), F.lit(0).alias("n"))  # n: tokens of cur

    def step(a: Column, x: Column) -> Column:
        over = (F.size(a["cur"]) > 0) & (a["n"] + x["n"] > most)
        held = F.when(over, carried(a["cur"])).otherwise(F.struct(a["cur"].alias("cur"), a["n"].alias("n")))
        return tx.let(held, lambda h: F.struct(F.when(over, F.concat(a["out"], F.array(joined(a["cur"])))).otherwise(a["out"]).alias("out"), F.concat(h["cur"], F.array(x)).alias("cur"), (h["n"] + x["n"]).alias("n")))

    return F.aggregate(pieces, zero, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(joined(a["cur"])))).otherwise(a["out"]))


def chunk_sections(sections: DataFrame, key: str, how: Config = DEFAULT) -> DataFrame:
    """key, chunk_ord, section_name, chunk_id, chunk_text. Chunks never span sections; numbers run across them."""
    cut = keep_sections(sections).select(key, "section_ord", "section_name", F.posexplode(chunk_text(F.col("text"), how.chunk_tokens, how.chunk_overlap)).alias("at", "chunk_text"))
    cut = cut.withColumn("chunk_ord", (F.row_number().over(Window.partitionBy(key).orderBy("section_ord", "at")) - 1).cast("long"))
    return cut.select(key, "chunk_ord", "section_name", F.concat_ws("::", F.col(key).cast("string"), "section_name", F.col("chunk_ord").cast("string")).alias("chunk_id"), "chunk_text")


def extraction_summary(papers: DataFrame, title: str, text: str) -> DataFrame:
    """F11."""
    return papers.select(F.col(title), F.length(text).cast("long").alias("chars"), tx.word_count(F.col(text)).cast("long").alias("words"), F.substring(text, 1, 1000).alias("head"))
