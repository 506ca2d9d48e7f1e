"""Personal data: patterns, then information-theoretic sanitisation of the terms that reveal them.

Base entities are e-mail addresses, IP addresses, card and phone numbers, by pattern and check. Terms
near an entity may disclose it as well. Over the corpus, a term t that stands near entity e in n_te
documents, is in n_t documents and e in n_e of N, tells PMI(t; e) = ln(n_te N / (n_t n_e)) of the
ln(N / n_e) that e itself carries. A term whose share reaches the disclosure threshold and that stood
near e in enough different contexts (copies of a text count once) is sanitised wherever it stands, in
every text. With fewer contexts the lower confidence bound of the PMI must reach the threshold, so rare
entities are decided as far as the size of the corpus lets so few places tell. All counts cover the
whole corpus. Rows are named by a hash of their content, so the corpus is read again, not copied.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import durable

_LOCAL = "A-Za-z0-9._%+-"
#: No attempt starts inside a run that failed before, and no group backtracks: linear on long texts.
KINDS = [
    spans.Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    spans.Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    spans.Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    spans.Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
NAMES = [k.name for k in KINDS]
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TERM = r"\p{L}{4,}"
#: Disclosing terms up to so many (some 30 MB) are sent to the scan of the texts; more are joined by sorting.
BROADCAST = 500_000


@dataclass(frozen=True)
class Disclosure:
    """share of an entity's information; different contexts at which the PMI counts as it is; characters around an
    entity; normal quantile of the confidence bound (one-sided 95 %) for fewer contexts."""

    share: float = 0.9
    contexts: int = 3
    window: int = 60
    sure: float = 1.645


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    chars = F.reverse(F.split(digits, ""))
    twice = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    ip = F.col("value").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    card = F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    return F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).otherwise(n.between(10, 15))


def _key() -> Column:
    """Names a row by its id and whole text: rows with one key are alike, so their spans are."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")).alias("key")


def entities(docs: DataFrame, context: int) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, doc_id, key; base spans), as spans.locate gives them, without matches that fail their check."""
    rows, found = spans.locate(docs, KINDS, context, (_key(),))
    return rows, durable(found.where(_valid()), "entities")


def _near(base: DataFrame, window: int) -> DataFrame:
    """A row per whole term near an entity: rid, entity, seen (the context's hash), term. base has one character more around."""

    def side(text: str, first: Column) -> Column:
        between, values = F.split(F.col(text), _TERM, -1), F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
        zero = F.struct(first.cast("long").alias("at"), F.array().cast("array<struct<term:string,start:long,end:long>>").alias("got"))
        step = lambda acc, z: F.struct((acc["at"] + F.length(z["b"]) + F.coalesce(F.length(z["v"]), F.lit(0))).cast("long").alias("at"), F.when(z["v"].isNull(), acc["got"]).otherwise(F.concat(acc["got"], F.array(F.struct(z["v"].alias("term"), (acc["at"] + F.length(z["b"])).cast("long").alias("start"), (acc["at"] + F.length(z["b"]) + F.length(z["v"])).cast("long").alias("end"))))).alias("got"))
        return F.aggregate(F.arrays_zip(between.alias("b"), values.alias("v")), zero, step)["got"]

    whole = F.filter(side("before", F.col("start") - F.length("before")), lambda t: t["start"] >= F.col("start") - window)
    both = F.concat(whole, F.filter(side("after", F.col("end")), lambda t: t["end"] <= F.col("end") + window))
    seen = F.xxhash64(F.substring("before", -window, window), F.substring("after", 1, window))
    named = base.select("rid", _entity(), seen.alias("seen"), F.explode(both).alias("t"))
    return named.select("rid", "entity", "seen", F.lower("t.term").alias("term"))


def _entity() -> Column:
    return F.sha1(F.concat_ws(":", "kind", F.lower("value")).cast("binary")).alias("entity")


def disclosing(docs: DataFrame, rows: DataFrame, base: DataFrame, how: Disclosure) -> DataFrame:
    """Terms that disclose an entity they stand near somewhere: a row per `term`. All terms of all texts are counted, each
    task its own first, and only then joined: what is shuffled grows with the vocabulary of tasks, at every size alike."""
    near = durable(_near(base, how.window), "near")
    pairs = durable(near.groupBy("entity", "term").agg(F.count_distinct("seen").alias("contexts"), F.count_distinct("rid").alias("n_te")), "pairs")
    terms = pairs.select(F.col("term").alias("t")).distinct()
    known = _words(docs).groupBy("term").count().join(terms, F.col("term") == F.col("t")).drop("t")  # inner: a semi join would be moved below the counting
    own = base.groupBy(_entity()).agg(F.count_distinct("rid").alias("n_e"))
    total = float(max(1, rows.count()))
    told = lambda p: F.ln(p * total / F.col("n_e")) >= how.share * F.ln(F.lit(total) / F.col("n_e"))
    p = F.col("n_te") / F.greatest("count", "n_te")
    n, z2 = F.col("contexts") / p, how.sure**2  # a context is one observation, however many copies it has
    low = (p + z2 / (2 * n) - how.sure * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)  # Wilson's bound of P(e | t)
    strong = pairs.join(known, "term").join(own, "entity").where(((F.col("contexts") >= how.contexts) & told(p)) | told(low)).where(F.col("n_e") < total)
    return durable(strong.select("term").distinct(), "strong")


def _words(docs: DataFrame, *keep: Column) -> DataFrame:
    """A row per text and distinct lower-cased term of it."""
    return docs.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_TERM), F.lit(0)))).alias("term"))


def _places(docs: DataFrame, rows: DataFrame, strong: DataFrame) -> DataFrame:
    """rid, kind 0, start, end of strong terms in every text. A text is read along once, and only what is strong is kept."""
    if strong.isEmpty():
        return rows.select("rid", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).limit(0)
    if strong.count() <= BROADCAST:
        strong = F.broadcast(strong)
    told = durable(_words(docs, _key()).join(strong, "term", "left_semi").groupBy("key").agg(F.collect_set("term").alias("terms")), "told")
    text = F.col("text").cast("string")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("got"))

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z["b"])
        end = start + F.coalesce(F.length(z["v"]), F.lit(0))
        hit = F.coalesce(F.array_contains("terms", F.lower(z["v"])), F.lit(False))
        return F.struct(end.cast("long").alias("at"), F.when(hit, F.concat(a["got"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(a["got"]).alias("got"))

    along = F.aggregate(F.arrays_zip(F.split(text, _TERM, -1).alias("b"), F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)).alias("v")), zero, step, lambda a: a["got"])
    placed = docs.select(_key(), "text").join(told, "key").select("key", F.explode(along).alias("s")).select("key", "s.start", "s.end").distinct()
    return placed.join(rows.select("rid", "key"), "key").select("rid", F.lit(0).alias("kind"), "start", "end")


def find(docs: DataFrame, how: Disclosure = Disclosure()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, base spans, added term spans) of docs' whole texts.

    docs: doc_id and text; other columns are ignored, so they may have any name. Null text is empty; very
    long texts are read whole. Repeated rows each get their spans. Added spans may overlap base spans.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, base = entities(texts, how.window + 1)
    added = durable(_places(texts, rows, disclosing(texts, rows, base, how)), "terms")
    return rows, base, added


def report(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs. An empty table: no rows."""
    rows, base, added = find(docs, how)
    return spans.digest(rows, base, added, NAMES, ["term"])


def sanitise(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """docs with every span replaced in text by its kind in brackets; all columns and rows stay.

    Overlapping spans are replaced as one, by the kind that starts first. Texts without spans, and null
    texts, stay as they are. Columns may have any name. Repeated rows are each replaced, alike. An empty table stays empty.
    """
    rows, base, added = find(docs, how)
    every = base.select("rid", "kind", "start", "end").unionByName(added.withColumn("kind", F.lit(len(NAMES)))).join(rows.select("rid", "key"), "rid")
    names = F.array(*[F.lit(f"[{n.upper()}]") for n in [*NAMES, "term"]])
    marks = durable(every.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("__marks")), "marks")
    text = F.col("text")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, m):
        kept = F.concat(acc["out"], F.array(text.substr((acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int")), F.element_at(names, m["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(m["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("__marks", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    joined = docs.withColumn("__key", _key()).join(marks, "__key", "left")
    return joined.withColumn("text", F.when(F.col("__marks").isNotNull(), folded).otherwise(text)).select(*docs.columns)
