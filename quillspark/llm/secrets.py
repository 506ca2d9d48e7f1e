"""Secrets: patterns, then a randomness test battery under length-aware false-discovery control.

Long runs of encoding characters are tokens. A token's encoding is inferred from its characters; in
that encoding's alphabet three tests ask whether it looks random: chi-squared uniformity, runs about
the middle of the alphabet, and serial correlation. Their smallest p-value, corrected for three tests,
is the token's score. Decoys are built in every class of tokens (a factor of two of length, and one
encoding): corpus words and numbers in the same characters, at lengths of the class's tokens. The score a
token needs is the least at which the share of its class's decoys that reach it keeps the expected false
discoveries within `rate`. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import durable, let, unit_hash

_RUN = "A-Za-z0-9+/_-"
_KEYWORD = "password|passwd|secret|token|api_?key"
KINDS = [
    spans.Kind("assign", rf"""(?i:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", rf"(?i:{_KEYWORD})", 1),
    spans.Kind("access", r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    spans.Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", r"[0-9a-f]{32}"),
    spans.Kind("random", rf"(?<![{_RUN}])[{_RUN}]{{20,}}+={{0,2}}", rf"[{_RUN}]{{20}}"),
]
NAMES = [k.name for k in KINDS[:3]]
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by falling strictness: pattern of the whole token, its alphabet.
ENCODINGS = [
    ("[0-9a-f]+", "0123456789abcdef"), ("[0-9A-F]+", "0123456789ABCDEF"), ("[a-z]+", _LOWER), ("[A-Z]+", _UPPER), ("[A-Z2-7]+", _UPPER + "234567"),
    ("[a-z0-9]+", _LOWER + _DIGITS), ("[A-Z0-9]+", _UPPER + _DIGITS), ("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"), ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Words for decoys of a table that has few of its own.
_WORDS = "the and report about people water which system other after house number school because found great little world und nicht einer werden schule haus jahr zwischen por para entre ciudad tiempo pour dans avec temps maison".split()
_WORD = rf"(?<![{_RUN}])[A-Za-z]{{2,19}}(?![{_RUN}])"


#: Hash ranges over which counts of words are summed.
RANGES = 4096


@dataclass(frozen=True)
class Battery:
    """False-discovery rate; least score; bins of the score; decoys built a class, and their greatest length (longer
    ones only look less random); places among all corpus words whose words decoys are made of."""

    rate: float = 0.05
    least: float = 0.001
    bins: int = 40
    decoys: int = 500
    longest: int = 1 << 16
    words: int = 8000


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, within 1e-7 (a fixed rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _alphabet(token: Column) -> Column:
    out = None
    for pattern, alphabet in ENCODINGS:
        hit = token.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(alphabet)) if out is None else out.when(hit, F.lit(alphabet))
    return out.otherwise(F.lit(_UPPER + _LOWER + _DIGITS + "+/-_"))


def score(token: Column) -> Column:
    """Corrected p-value of the battery: near 0 where some test says that the token is not random."""

    def tests(pair: Column) -> Column:
        x, size, body = pair["x"], F.length(pair["a"]).cast("double"), pair["t"]
        n = F.size(x).cast("double")
        chi = F.aggregate(F.filter(F.split(pair["a"], ""), lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))) - n / size, F.lit(2.0)) / (n / size))
        k = size - 1
        p_chi = _upper_tail((F.pow(chi / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))
        mid = (size - 1) / 2
        zero = F.struct(F.lit(-1.0).alias("p"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("sxy"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sxx"))

        def step(a: Column, v: Column) -> Column:
            first = a["p"] < 0
            change = first | ((a["p"] > mid) != (v > mid))
            return F.struct(v.alias("p"), (a["runs"] + F.when(change, 1.0).otherwise(0.0)).alias("runs"), (a["high"] + F.when(v > mid, 1.0).otherwise(0.0)).alias("high"), (a["sxy"] + F.when(first, 0.0).otherwise((a["p"] - mid) * (v - mid))).alias("sxy"), (a["sx"] + v).alias("sx"), (a["sxx"] + F.pow(v - mid, F.lit(2.0))).alias("sxx"))

        def pair_tests(s: Column) -> Column:
            high, low = s["high"], n - s["high"]
            mean = 2 * high * low / n + 1
            var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
            p_runs = 2 * _upper_tail(F.abs(s["runs"] - mean) / F.sqrt(var))
            p_serial = 2 * _upper_tail(F.abs(s["sxy"] / F.greatest(s["sxx"], F.lit(1e-9))) * F.sqrt(n))
            return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

        return let(F.aggregate(x, zero, step), pair_tests)

    def coded(p: Column) -> Column:
        codes = F.transform(F.filter(F.split(p["t"], ""), lambda c: c != ""), lambda c: (F.instr(p["a"], c) - 1).cast("double"))
        return let(F.struct(codes.alias("x"), p["a"].alias("a"), p["t"].alias("t")), tests)

    body = F.regexp_replace(token, "=+$", "")
    return let(F.struct(_alphabet(body).alias("a"), body.alias("t")), coded)  # the alphabet is found once a token, not once a character


def _is_target(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _scored(tokens: DataFrame, how: Battery) -> DataFrame:
    """tokens with score and its bin."""
    return tokens.withColumn("score", score(F.col("value"))).withColumn("bin", F.least(F.lit(how.bins - 1), F.floor(F.col("score") * how.bins)).cast("int"))


def places(docs: DataFrame, how: Battery) -> DataFrame:
    """w: the words at how.words even places of all words of all texts (all words, each as often, where there are fewer), ordered by hash.

    Every occurrence counts: a word of n of N occurrences has n * how.words / N places, rounded up or down. Running sums go over hash ranges, and over words within one.
    """
    word = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_WORD), F.lit(0))).alias("w"))
    counts = word.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.pmod(F.xxhash64("w"), F.lit(RANGES)).cast("int"))
    counts = durable(counts, "words")
    sums = counts.groupBy("range").agg(F.sum("n").alias("of"))
    before = sums.select("range", (F.sum("of").over(Window.orderBy("range")) - F.col("of")).alias("before"), F.sum("of").over(Window.partitionBy()).alias("all"))  # at most RANGES rows
    ended = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy(F.xxhash64("w"), "w"))
    held = counts.join(F.broadcast(before), "range").select("w", "n", "all", ended.alias("end")).withColumn("many", F.least(F.lit(how.words), F.col("all")))
    upto = lambda end: F.expr(f"({end} * many) div all")  # noqa: E731  places that end before
    return held.select("w", (upto("end") - upto("(end - n)")).cast("int").alias("k")).where("k > 0").select("w", F.explode(F.sequence(F.lit(1), F.col("k")))).select("w")


def decoys(docs: DataFrame, total: int, targets: DataFrame, how: Battery) -> DataFrame:
    """size, code, value: how.decoys tokens a class of targets, less those that fall outside the class.

    They are corpus words and numbers, joined as the class's characters allow; hex classes get the hex code of
    words. Words are those of all texts, see places; total is not needed for them. Parts of tokens are no words. Base64 of plain text is not among the decoys: up to some 60
    characters the battery cannot tell it from keys, so it may be added.
    """
    pool = places(docs, how).agg(F.concat(F.sort_array(F.collect_list("w")), F.array(*map(F.lit, _WORDS))).alias("pool"))
    lengths = targets.groupBy("size", "code").agg(F.percentile_approx(F.length("value"), [k / 16 for k in range(17)]).alias("lengths"))
    made = docs.sparkSession.range(how.decoys).crossJoin(F.broadcast(lengths)).crossJoin(F.broadcast(pool))

    def pick(i: Column, n: Column) -> Column:
        return F.pmod(F.xxhash64("id", "size", "code", i), n).cast("int")

    made = made.withColumn("n", F.least(F.lit(how.longest), F.get("lengths", pick(F.lit(0), F.lit(17)))))
    parts = F.transform(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int") + 2), lambda i: F.when(pick(i * 2, F.lit(4)) == 0, pick(i * 2 + 1, F.lit(3000)).cast("string")).otherwise(F.get("pool", pick(i * 2 + 1, F.size("pool")))))
    made = made.select("size", "code", "n", (F.col("id") % 2 == 1).alias("odd"), parts.alias("parts"))
    code, odd, words = F.col("code"), F.col("odd"), F.array_join("parts", " ")
    slash, dash, both = code.contains("/"), code.contains("_"), code.contains("z") & code.contains("Z")
    glue = F.when(slash & dash, F.lit("/_")).when(slash, F.lit("/")).when(dash, F.when(odd, "-").otherwise("_")).otherwise("")
    glued = F.regexp_replace(F.when(both, F.initcap(words)).otherwise(words), F.lit(" "), glue)
    encoded = F.when(F.length("code") == 16, F.hex(words)).otherwise(glued)
    formed = F.when(both, encoded).when(code.contains("A"), F.upper(encoded)).otherwise(F.lower(encoded))
    formed = F.when(F.length("code") == 32, F.translate(formed, "0189", "2345")).otherwise(formed)
    built = made.select("size", "code", formed.substr(F.lit(1), F.col("n")).alias("value"))
    return built.where(_is_target(F.col("value")) & (_alphabet(F.col("value")) == code))


def random_tokens(docs: DataFrame, total: int, tokens: DataFrame, how: Battery) -> DataFrame:
    """rid, kind 0, start, end of tokens that pass the battery at their class's cutoff. total: rows of docs."""
    value = F.col("value")
    targets = tokens.where(_is_target(value)).withColumn("size", F.floor(F.log2(F.length("value").cast("double"))).cast("int")).withColumn("code", _alphabet(F.regexp_replace(value, "=+$", "")))
    scored = durable(_scored(targets, how), "tokens")
    null = _scored(decoys(docs, total, scored, how), how)
    both = scored.select("size", "code", "bin", F.lit(1).alias("hit")).unionByName(null.select("size", "code", "bin", F.lit(0).alias("hit")))
    binned = both.groupBy("size", "code", "bin").agg(F.count_if(F.col("hit") == 1).alias("t"), F.count_if(F.col("hit") == 0).alias("d"))
    whole = Window.partitionBy("size", "code")
    above = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    false = F.sum("t").over(whole) * (F.sum("d").over(above) + 1) / (F.sum("d").over(whole) + 1)
    passed = binned.withColumn("fdr", false / F.greatest(F.sum("t").over(above), F.lit(1))).where(F.col("fdr") <= how.rate).groupBy("size", "code").agg(F.min("bin").alias("cut"))
    return scored.join(passed, ["size", "code"]).where((F.col("bin") >= F.col("cut")) & (F.col("score") >= how.least)).select("rid", F.lit(0).alias("kind"), "start", "end")


def find(docs: DataFrame, how: Battery = Battery()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, base spans, added random spans) of docs' whole texts.

    docs: doc_id and text; other columns are ignored, so they may have any name. Null text is empty.
    Very long texts are read whole. Repeated rows each get their spans. Every class of tokens is decided,
    by decoys built for it.
    """
    rows, found = spans.locate(docs, KINDS)
    kept = (F.col("kind") != 0) | (F.length("inner") >= 8)
    found = durable(found.where(kept), "matches")
    return rows, found.where("kind < 3"), random_tokens(docs, rows.count(), found.where("kind = 3"), how)


def report(docs: DataFrame, how: Battery = Battery()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs. An empty table: no rows."""
    rows, base, added = find(docs, how)
    return spans.digest(rows, base, added, NAMES, ["random"])
