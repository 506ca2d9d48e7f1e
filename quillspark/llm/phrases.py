"""Phrases whose words stand together more often than apart, counted by pivot partitioning (as MG-FSM does).

1. One scan counts words by language. Words below the threshold cannot be in a frequent phrase.
2. A second scan routes text. A phrase belongs to its pivot, its rarest word (leftmost, if it occurs
   twice). For each place of a word, the text around it is rewritten to the longest fragment, up to the
   phrase length, in which that place is the pivot: it ends at rarer and infrequent words and at the ends
   of a piece. Each fragment goes to its pivot, equal ones once with their number. A frequent word has
   rarer neighbours almost everywhere, so its fragments are few and short.
3. A pivot's fragments hold all occurrences of its phrases. They are mined where they arrive, pivot
   after pivot: only phrases that contain the pivot's place are made, so no phrase is counted by two pivots. A pivot with
   more places than a task should take is dealt over several, whose sums are added up.
4. Scores, containment and ranks are joins and groupings of the frequent phrases.

The order by rarity must be one and the same in all tasks, and is a table of bounded size: frequent words
are hashed to `buckets` places, a place holds the largest count, and words are ordered by place's count, then
hash. A frequent word never gets a count below its own. Where two words share a place, an infrequent one may
pass for frequent: that costs a few fragments, and is right, as phrases are counted in full before they are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

_END = b"."
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
#: Tokens that are rewritten at once; bytes of text that are split at once, ended at a piece's end; fragments of a row.
TOKENS, BYTES, FRAGMENTS = 500_000, 1_000_000, 4096
_ROUTE = "lang string, pivot string, salt long, salts long, words string, shape binary, times binary"
_ROUTE_NAMES = [c.split()[0] for c in _ROUTE.split(", ")]


@dataclass(frozen=True)
class Plan:
    """Phrases of 2 to `longest` words, `least` times or more; the score's factor; a longer phrase takes the place of a part that it
    makes up to `inside` per cent; `best` a language. `buckets` bounds what is broadcast (8 bytes each), `share` a pivot's places in a task."""

    longest: int = 4
    least: int = 30
    factor: int = 2_000_000
    inside: int = 80
    best: int = 2000
    buckets: int = 1 << 21
    share: int = 1_000_000


def _split(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, a lone full stop where a piece ends; long texts in parts that end with a piece."""
    marked = (text or b"").lower().translate(_MARKS)  # bytes: only A-Z are lower-cased
    at = 0
    while at < len(marked):
        end = len(marked) if len(marked) - at <= BYTES else marked.find(_END, at + BYTES) + 1 or len(marked)
        yield marked[at:end].replace(_END, b" . ").split()
        at = end


def _own(docs: DataFrame, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def words(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """lang, word, f: how often each word occurs."""

    def run(batches):
        held: Counter = Counter()

        def told():
            keys, n = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _split(text.as_py()):
                    by.setdefault(lang, Counter()).update(part)
            for lang, counts in by.items():
                counts.pop(_END, None)
                for w, n in counts.items():
                    held[lang, w] += n
            if len(held) > TOKENS // 2:
                yield told()
        yield told()

    return _own(docs, lang).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def rarity(counted: DataFrame, plan: Plan) -> np.ndarray:
    """The largest count of frequent words at each place of the order's table; at most plan.buckets rows come to the driver."""
    place = F.pmod(F.xxhash64("lang", "word"), F.lit(plan.buckets))
    found = counted.where(F.col("f") >= plan.least).groupBy(place.alias("at")).agg(F.max("f").alias("f")).toArrow()
    out = np.zeros(plan.buckets, np.int64)
    out[found.column("at").to_numpy()] = found.column("f").to_numpy()
    return out


def _ranks(vocabulary: list[bytes], seed: int, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank by rarity, -1 for infrequent words and ends; count in the order's table) of each word."""
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary)).view(np.int64)
    count = table[h % len(table)]
    order = np.lexsort((h, count))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (h[order][1:] != h[order][:-1]) | (count[order][1:] != count[order][:-1])]))
    return np.where((count < least) | (np.array(vocabulary, object) == _END), -1, rank), count


def _reach(rank: np.ndarray, step: int, longest: int) -> np.ndarray:
    """How many words on one side of a place belong to its fragment. Of equal words the leftmost is the pivot."""
    ok, out = rank >= 0, np.zeros(len(rank), np.int32)
    for j in range(1, longest):
        beside = np.full(len(rank), -1, np.int64)
        if step < 0:
            beside[j:] = rank[:-j]
            ok = ok & (beside > rank)
        else:
            beside[:-j] = rank[j:]
            ok = ok & (beside >= rank)
        out += ok
    return out


def _fragments(tokens: list[bytes], lang: str, seed: int, table: np.ndarray, plan: Plan) -> pa.RecordBatch | None:
    """Rows of pivots with their fragments: all their words; of each, how many stand left and right of the pivot's place, and how many such fragments there are."""
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in tokens), np.int32, len(tokens))
    vocabulary = list(known)
    ranks, counts = _ranks(vocabulary, seed, table, plan.least)
    rank = ranks[codes]
    left, right = _reach(rank, -1, plan.longest), _reach(rank, 1, plan.longest)
    at = np.flatnonzero(left + right > 0)
    if not len(at):
        return None
    left, right, pivot = left[at], right[at], codes[at]
    side = plan.longest - 1
    padded = np.concatenate([np.full(side, -1, np.int32), codes, np.full(side, -1, np.int32)])
    window = np.stack([np.where((-left <= j) & (j <= right), padded[at + side + j], -1) for j in range(-side, side + 1)], axis=1)
    mixed = np.zeros(len(at), np.uint64)
    for column in window.T:
        mixed = (mixed ^ (column.astype(np.uint64) + np.uint64(2))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    salts = counts[pivot] // plan.share + 1
    salt = (mixed >> np.uint64(8)).astype(np.int64) % salts
    order = np.lexsort((mixed, salt, pivot))  # equal fragments of a pivot stand together
    window, left, right, pivot, salt, salts = (x[order] for x in (window, left, right, pivot, salt, salts))
    new = np.concatenate([[True], (window[1:] != window[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(new))).astype(np.int64)
    window, left, right, pivot, salt, salts = (x[first] for x in (window, left, right, pivot, salt, salts))
    changed = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])])
    begins = np.flatnonzero(changed)
    within = np.arange(len(changed)) - begins[np.cumsum(changed) - 1]
    rows = np.flatnonzero(changed | (within % FRAGMENTS == 0))
    edges = np.append(rows, len(changed))
    placed = np.concatenate([[0], np.cumsum(left + right + 1)])[edges]
    dictionary = pa.array(vocabulary, pa.binary()).cast(pa.string())
    spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(placed, pa.int32()), dictionary.take(pa.array(window[window >= 0]))), " ")
    bytes_of = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), dictionary.take(pa.array(pivot[rows])), pa.array(salt[rows], pa.int64()), pa.array(salts[rows], pa.int64()), spelled, bytes_of(np.stack([left, right], axis=1).astype(np.uint8)), bytes_of(times)], _ROUTE_NAMES)


def routed(docs: DataFrame, table: np.ndarray, plan: Plan, lang: str = "lang") -> DataFrame:
    """Fragments on the way to their pivots, see _fragments."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        n = 0

        def told(name):
            seed = xxhash.xxh64_intdigest(name.encode(), 42)  # a language's words hash as xxhash64(lang, word) does
            return _fragments(held.pop(name), name, seed, shared.value, plan)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _split(text.as_py()):
                    own = held.setdefault(name, [])
                    own += part
                    own.append(_END)
                    n += len(part) + 1
                    if n >= TOKENS:  # of all languages together; the largest goes
                        most = max(held, key=lambda k: len(held[k]))
                        n -= len(held[most])
                        if (out := told(most)) is not None:
                            yield out
        for name in list(held):
            if (out := told(name)) is not None:
                yield out

    return _own(docs, lang).mapInArrow(run, _ROUTE)


def _mined(words: list[str], shape: bytes, times: bytes, salts: np.ndarray, plan: Plan) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(phrases, their sizes, how often) of whole groups of fragments: those that contain the pivot's place. salts: of each row of words."""
    spelled = pc.split_pattern(pa.array(words, pa.large_string()), " ")
    held = spelled.flatten().dictionary_encode()
    codes = held.indices.to_numpy().astype(np.int64)
    left, right = np.frombuffer(shape, np.uint8).reshape(-1, 2).astype(np.int64).T
    n = np.frombuffer(times, np.int64)
    at = np.cumsum(left + right + 1) - right - 1
    dealt = salts[np.searchsorted(np.asarray(spelled.offsets), at, "right") - 1] > 1
    keys, counts, open_ = [], [], []
    for i in range(plan.longest):
        for j in range(plan.longest - i):
            if i + j:
                own = np.flatnonzero((left >= i) & (right >= j))
                key = np.full((len(own), plan.longest), -1, np.int32)
                for k in range(i + j + 1):
                    key[:, k] = codes[at[own] - i + k]
                keys.append(key), counts.append(n[own]), open_.append(dealt[own])
    key, count, open_ = np.concatenate(keys), np.concatenate(counts), np.concatenate(open_)
    order = np.lexsort(key.T)
    key, count, open_ = key[order], count[order], open_[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count, first) if len(first) else count
    keep = (total >= plan.least) | open_[first]
    key, total = key[first][keep], total[keep]
    sizes = (key >= 0).sum(axis=1)
    texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), held.dictionary.take(pa.array(key[key >= 0])).cast(pa.string()))
    return pc.binary_join(texts, " "), sizes, total


def frequent(routes: DataFrame, plan: Plan) -> DataFrame:
    """lang, phrase, size, a: phrases of 2 words and more that occur often enough, mined pivot by pivot.

    A task takes its pivots one after the other, whole, as many at once as hold about TOKENS fragments.
    """

    def run(batches):
        held, seen, lang, last = [], 0, None, None

        def told():
            phrases, sizes, total = _mined([r[0] for r in held], b"".join(r[1] for r in held), b"".join(r[2] for r in held), np.array([r[3] for r in held]), plan)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(sizes), pa.string()), phrases, pa.array(sizes, pa.int32()), pa.array(total, pa.int64())], ["lang", "phrase", "size", "a"])

        for batch in batches:
            own, pivot, salt, salts, *rest = (c.to_pylist() for c in batch.columns)
            for key, m, row in zip(zip(own, pivot, salt, strict=True), salts, zip(*rest, strict=True), strict=True):
                if held and (key[0] != lang or (seen >= TOKENS and key != last)):
                    yield told()
                    held, seen = [], 0
                lang, last = key[0], key
                held.append((*row, m))
                seen += len(row[2]) // 8
        if held:
            yield told()

    ordered = routes.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt")
    mined = ordered.mapInArrow(run, "lang string, phrase string, size int, a long")
    return mined.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= plan.least)


def _joined(word: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(word, start, size), " ")


def scored(phrases: DataFrame, counted: DataFrame, plan: Plan) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut, without phrases that a longer one takes the place of."""
    parts = durable(phrases.where(F.col("size") < plan.longest).select("lang", "phrase", F.col("a").alias("f")).unionByName(counted.where(F.col("f") >= plan.least).select("lang", F.col("word").alias("phrase"), "f")), "parts")
    word = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "size", "a", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("head"), _joined(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    exact = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  19 digits and the factor's stay below 38
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * CAST({plan.factor} AS DECIMAL(17,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    told = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).withColumn("score", score)
    best = told.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _joined(F.col("w"), i, n))))
    covers = phrases.where("size > 2").select("lang", "a", "size", word.alias("w")).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    inside = best.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * plan.inside))
    return inside.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, plan: Plan = Plan(), lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    docs: text and the language's column; other columns are ignored, so they may have any name. Null and
    empty texts have no words; a null language counts as `und`. Rows repeated count again. Long texts are
    read whole, in parts that end with a piece. Of equal scores the more frequent phrase, then the first by
    bytes, ranks higher. An empty table, or one without frequent phrases, gives an empty result.
    """
    counted = durable(words(docs, lang), "words")
    phrases = durable(frequent(routed(docs, rarity(counted, plan), plan, lang), plan), "phrases")
    kept = durable(scored(phrases, counted, plan), "scored")
    order = "ORDER BY score DESC, a DESC, phrase"
    # the best of a share of a language's phrases first, so that no task ranks all of them
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("at", F.expr(f"row_number() OVER (PARTITION BY lang, share {order})")).where(F.col("at") <= plan.best)
    ranked = shares.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= plan.best)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
