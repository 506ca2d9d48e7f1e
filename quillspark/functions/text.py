"""Scalar text functions, Column -> Column (survey B1-B36). All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NOT_FOUND, NOT_REPORTED

#: Fixed patterns.
SPLIT_VALUES = r",| / |/| and |;"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
TOKEN = r"(?U)\w+|[^\w\s]"
TERM = r"(?U)\b\w\w+\b"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without blanks at both ends. A run inside is tried from its first blank only, so time does not grow with the square of runs."""
    return F.regexp_replace(c, r"^\s++|(?<!\s)\s++$", "")


def inverted_index(words: Column) -> Column:
    """B1's input: map word -> positions from 0, of a list of words. Within the row: sorted, a word's positions are neighbours."""
    ordered = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["w"] != x["w"]), i)), lambda i: i.isNotNull())
    entry = lambda s, at: lambda a, j: F.struct(F.get(s, a)["w"].alias("w"), F.transform(F.slice(s, a + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - a), lambda x: x["p"]).alias("ps"))
    return let(ordered, lambda s: let(starts(s), lambda at: F.map_from_entries(F.transform(at, entry(s, at)))))


def inverted_index_text(index: Column) -> Column:
    """B1: map word -> positions to text; null gives ''."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "), F.lit(""))


def strip_tags(c: Column) -> Column:
    """B2."""
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def normalize_title(c: Column) -> Column:
    """B3."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_doi(c: Column) -> Column:
    """Null if nothing is left."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.regexp_replace(bare, "^/+|/+$", ""), F.lit(""))


def surnames(authors: Column) -> Column:
    return F.transform(F.filter(authors, lambda a: strip(a) != ""), lambda a: F.element_at(F.split(F.lower(strip(a)), r"\s+"), -1))


def authors_overlap(a: Column, b: Column) -> Column:
    """Whether any surname is shared; false if either is empty."""
    return F.coalesce(F.size(F.array_intersect(surnames(a), surnames(b))) > 0, F.lit(False))


def authors_display(authors: Column) -> Column:
    """B7."""
    n = F.size(F.coalesce(authors, F.array().cast("array<string>")))
    return F.when(n == 0, "Unknown authors").when(n > 5, F.concat(F.array_join(F.slice(authors, 1, 5), ", "), F.lit(" et al. ("), n.cast("string"), F.lit(" authors)"))).otherwise(F.array_join(authors, ", "))


def text_for_embedding(title: Column, abstract: Column) -> Column:
    """B8."""
    return F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(title, F.lit(". "), abstract)).otherwise(title)


def paper_id(doi: Column, title: Column) -> Column:
    """16 hex digits of the DOI's or else the title's SHA-1."""
    key = F.coalesce(normalize_doi(doi), F.nullif(normalize_title(title), F.lit("")), title)
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


def sentences(c: Column) -> Column:
    """B10."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def first_sentence(c: Column) -> Column:
    """sentences(c)[0], without what follows it: null if there is none. Only a text of blanks begins with a blank sentence."""
    return F.nullif(strip(F.split(c, SENTENCE_END, 2)[0]), F.lit(""))


def token_count(c: Column) -> Column:
    """B11."""
    return F.regexp_count(c, F.lit(TOKEN))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """B12."""
    return F.regexp_count(c, F.lit(r"\S+"))


def unique_alpha_words(c: Column) -> Column:
    """Distinct lower-cased tokens of letters only."""
    return F.array_distinct(F.transform(F.filter(words(c), lambda w: w.rlike(r"^\p{L}+$")), F.lower))


def multi_values(c: Column, sentinel: str = NOT_FOUND) -> Column:
    """Values of a multi-value field without blanks and sentinels."""
    return F.filter(F.transform(F.split(c, SPLIT_VALUES), strip), lambda v: (v != "") & (F.lower(v) != sentinel.lower()))


def first_number(c: Column) -> Column:
    """B15."""
    return F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def all_numbers(c: Column) -> Column:
    """B16."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def alpha_tokens(c: Column) -> Column:
    """B17."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def dedupe_terms(terms: Column) -> Column:
    """First spelling of each term, case-insensitively, blanks dropped, order kept. Terms are cleaned and lowered once a row."""
    clean = F.filter(F.transform(terms, strip), lambda t: F.coalesce(t, F.lit("")) != "")
    return let(clean, lambda held: let(F.transform(held, F.lower), lambda low: F.filter(held, lambda t, i: F.array_position(low, F.get(low, i)) == i + 1)))


def quote_multiword(c: Column) -> Column:
    """B19."""
    return F.when(c.contains(" "), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def boolean_group(terms: Column, field: str = "", most: int = 5) -> Column:
    """The first distinct terms OR-joined, in parentheses if several."""
    joined = lambda kept: F.array_join(F.transform(kept, lambda t: F.concat(F.lit(f"{field}:" if field else ""), quote_multiword(t))), " OR ")
    return let(F.slice(dedupe_terms(terms), 1, most), lambda kept: F.when(F.size(kept) > 1, F.concat(F.lit("("), joined(kept), F.lit(")"))).otherwise(joined(kept)))


def source_queries(raw_title: Column, primary: Column, problem: Column, secondary: Column, synonyms: Column, alternatives: Column, domain: Column, keywords: Column, search_query: Column) -> Column:
    """Source and query for each source, as an array of structs made once a row; each query falls back to the raw title."""
    none = F.array().cast("array<string>")
    arr = lambda c: F.array(c)
    many = lambda c: F.coalesce(c, none)
    groups = [F.concat(arr(primary), many(synonyms), many(alternatives)), F.concat(arr(problem), arr(domain), F.slice(many(keywords), 1, 3)), arr(secondary)]
    fielded = F.array_join(F.filter(F.array(*[boolean_group(g, "all") for g in groups]), lambda g: g != ""), " AND ")
    bag = F.array_join(dedupe_terms(F.concat(arr(primary), arr(problem), arr(secondary), F.slice(many(keywords), 1, 5))), " ")
    made = F.transform(F.array(fielded, search_query, bag), lambda c: F.coalesce(F.nullif(c, F.lit("")), raw_title))
    kinds = {"arxiv": 0, "core": 1, "openalex": 2, "crossref": 2, "semantic_scholar": 2}
    return let(made, lambda held: F.array(*[F.struct(F.lit(s).alias("source"), F.get(held, F.lit(i)).alias("query")) for s, i in kinds.items()]))


def as_str_list(json: Column) -> Column:
    """A JSON list of strings, or one string as a list; trimmed, blanks dropped, anything else empty."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    listed = F.try_variant_get(v, "$", "array<string>")
    single = F.try_variant_get(v, "$", "string")
    out = F.when(kind.startswith("ARRAY"), listed).when(kind == "STRING", F.array(single))
    return F.filter(F.transform(F.coalesce(out, F.array().cast("array<string>")), strip), lambda s: F.coalesce(s, F.lit("")) != "")


def parse_json_best_effort(c: Column) -> Column:
    """The JSON text that parses: all of it, or its outermost braces or brackets; else null."""
    part = F.regexp_extract(c, r"(?s)\{.*\}|\[.*\]", 0)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(F.nullif(part, F.lit(""))).isNotNull(), part)


def duration_seconds(c: Column) -> Column:
    """B24: '1h37m55.2s' or '229ms' in seconds; 0 or no match: null."""
    pattern = r"^(?:(\d+)h)?(?:(\d+)m(?!s))?(?:(\d+(?:\.\d+)?)s)?(?:(\d+(?:\.\d+)?)ms)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(strip(c), pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.nullif(part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000, F.lit(0.0))


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as SQL's round() does it: scaled by a power of ten, then half away from zero. F.round goes by the shortest
    decimal instead, and what stands at half there need not do so once scaled. Negative ones keep their sign, also at zero."""
    scaled = F.abs(c) * 10.0**digits
    whole = F.floor(scaled)
    up = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)).cast("double") / 10.0**digits
    return F.when(scaled < 2.0**52, F.when(c < 0, -up).otherwise(up)).otherwise(c)


def token_estimate(chars: Column, max_tokens: int) -> Column:
    """B25."""
    return F.floor(chars / 4) + max_tokens


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    """B27."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def short_label(c: Column) -> Column:
    """What follows the first colon, at most 40 characters."""
    return F.substring(strip(F.regexp_replace(c, "^[^:]*:", "")), 1, 40)


def is_missing(c: Column, sentinel: str = NOT_FOUND) -> Column:
    return F.coalesce(strip(c), F.lit("")).isin("", sentinel)


def best_metric(metrics: list[tuple[str, Column]]) -> Column:
    """The first reported metric with its name."""
    return F.coalesce(*[F.when(~is_missing(c), F.concat(c, F.lit(f" ({name})"))) for name, c in metrics], F.lit(NOT_FOUND))


def evidence_kind(c: Column) -> Column:
    """B31."""
    return F.when(c.contains("Full PDF"), "full").when(c.contains("Abstract fallback"), "abstract").otherwise("other")


def confidence_band(c: Column) -> Column:
    """B33."""
    return F.when(c >= 70, "green").when(c >= 40, "amber").otherwise("grey")


def clamp_confidence(c: Column) -> Column:
    """An integer in 0..100; what is none counts as 0."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c.try_cast("int"), F.lit(0))))


def coerce_enum(c: Column, allowed: list[str], default: str) -> Column:
    """B35."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def usable_or(c: Column, default: Column) -> Column:
    """B37."""
    return F.when(F.coalesce(strip(c), F.lit("")).isin("", NOT_REPORTED, NOT_FOUND), default).otherwise(c)


def terms(c: Column) -> Column:
    """E4's features: words of two characters or more, lower-cased, and their bigrams."""
    one = F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    two = F.transform(F.arrays_zip(one.alias("a"), F.slice(one, 2, 1 << 30).alias("b")), lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    return F.concat(one, F.filter(two, lambda t: t.isNotNull()))


def terms_of(text: str) -> list[str]:
    """terms() of a text that is here."""
    one = re.findall(r"\b\w\w+\b", text.lower())
    return one + [f"{a} {b}" for a, b in zip(one, one[1:], strict=False)]
