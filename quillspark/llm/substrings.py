"""Passages that stand elsewhere already: seed and extend on winnowed anchors.

A window is `least` consecutive words. It is a repeat if its words also start earlier: in a document of
smaller id, or further left in the same one.

1. Winnowing: of the hashes of `seed` consecutive words, each window's smallest (the rightmost of equal
   ones) is an anchor. Equal windows have equal anchors at equal places, and neighbouring anchors of a
   passage overlap or touch.
2. Anchors that occur more than once are seeds. Documents are joined on them as stars: each seed with
   the earliest one of its anchor, the hub, so k occurrences give k - 1 pairs.
3. Seeds of a document that have one hub document and one distance, and touch, are one match. It is
   extended both ways, word by word, at its two ends. What reaches the length is a repeat.
4. A window can repeat one that is not the hub's: the passage around the anchor was changed, and the
   change was copied. Such windows hold an end of a match, where the hub has other words. They are held
   against each other by their content: of equal ones all but the earliest are repeats. So no repeat is
   lost, and no pairs within a group are made.

Texts leave the scan twice: for the ends of matches, and to cut what repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, made, release

#: Words that are hashed at once.
WORDS = 500_000
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ENDS = "doc long, version long, kind int, hash long, start int, stop int, left array<long>, right array<long>, starts array<int>, w1 array<long>, w2 array<long>"
_MATCH, _END, _HUB = 0, 1, 2


@dataclass(frozen=True)
class Plan:
    """Words of a window, and of an anchor: more than half of them, so that a match has no holes between its anchors."""

    least: int = 20
    seed: int = 11

    @property
    def reach(self) -> int:
        """Words that a window may have on one side of its anchor."""
        return self.least - self.seed


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[codes]


def owners(h: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(hash of `seed` words from each place, place of each window's anchor) of words' hashes; at least a window long."""
    grams = np.zeros(len(h) - plan.seed + 1, np.uint64)
    for j in range(plan.seed):
        grams = grams * _ODD + h[j : j + len(grams)]
    grams = _mix(grams)
    wide, at = 1, np.arange(len(grams))
    while wide <= plan.reach:  # smallest of `wide` neighbours, then of twice as many
        step = min(wide, plan.reach + 1 - wide)
        a, b = at[: len(at) - step], at[step:]
        at, wide = np.where(grams[b] <= grams[a], b, a), wide + step
    return grams, at


def anchors(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc, version, at, hash: the anchors of each document of a window or more."""

    def told(held: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for _, _, w in held], np.int64)
        grams, at = owners(_hashes([x for _, _, w in held for x in w]), plan)
        begin = np.cumsum(sizes) - sizes
        chosen = np.zeros(len(grams), bool)
        whole = np.ones(len(at), bool)  # windows inside one document
        for b in begin[1:]:
            whole[max(0, b - plan.least + 1) : b] = False
        chosen[at[whole]] = True
        places = np.flatnonzero(chosen)
        owner = np.searchsorted(begin, places, "right") - 1
        offsets = pa.array(np.searchsorted(owner, np.arange(len(held) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((places - begin[owner]).astype(np.int32), grams[places].view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in held], pa.int64()), pa.array([v for _, v, _ in held], pa.int64()), *lists], ["doc", "version", "at", "hash"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()  # bytes: the six ASCII blanks
                if len(words) >= plan.least:
                    held.append((doc, version, words))
                    n += len(words)
                if n >= WORDS:
                    yield told(held)
                    held, n = [], 0
        if held:
            yield told(held)

    return docs.mapInArrow(run, "doc long, version long, at array<int>, hash array<long>")


def seeds(rows: DataFrame) -> DataFrame:
    """hash, n, doc, version, at: anchors that occur more than once."""
    each = rows.select("doc", "version", F.explode(F.arrays_zip("at", "hash")).alias("a")).select("doc", "version", "a.at", "a.hash")
    shared = durable(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")  # written, so that a hot join is split
    return each.join(shared, "hash").select("hash", "n", "doc", "version", "at")


def _around(h: np.ndarray, at: np.ndarray, plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words' hashes one after the other, how many are each anchor's) left and right of anchors, nearest first."""
    step = np.arange(plan.reach)
    left, right = at[:, None] - 1 - step, at[:, None] + plan.seed + step
    return [(h[i[ok]], ok.sum(axis=1)) for i, ok in ((left, left >= 0), (right, right < len(h)))]


def _ends(h: np.ndarray, doc: int, version: int, own: dict[str, np.ndarray], plan: Plan) -> tuple[dict, dict, dict]:
    """Of one document, by words' hashes and seeds: its matches between their outer anchors, the ends of matches, and its hubs."""
    place, first = np.unique(own["at"], return_index=True)
    own = {k: v[first] for k, v in own.items()}
    hub = (own["hub_doc"] == doc) & (own["hub_version"] == version) & (own["hub_at"] == place)
    left, right = _around(h, place[hub], plan)
    hubs = {"hash": own["hash"][hub], "left": left, "right": right}
    met = np.flatnonzero(~hub)
    met = met[np.lexsort((place[met], place[met] - own["hub_at"][met], own["hub_version"][met], own["hub_doc"][met]))]
    p = place[met]
    line = np.stack([own["hub_doc"][met], own["hub_version"][met], p - own["hub_at"][met]])
    begins = np.flatnonzero(np.concatenate([[True], (line[:, 1:] != line[:, :-1]).any(axis=0) | (p[1:] - p[:-1] > plan.seed)])) if len(p) else np.zeros(0, np.int64)
    stops = np.append(begins, len(p))[1:] - 1
    long = p[stops] + plan.seed - p[begins] >= plan.least
    matched = {"start": p[begins][long], "stop": p[stops][long] + plan.seed}
    # windows that hold an end, and whose anchor occurs a third time: they may repeat another than the hub
    ends = np.union1d(begins, stops)
    at = p[ends]
    many = np.zeros(len(h), bool)
    many[place] = own["n"] > 2
    window = many[owners(h, plan)[1]]
    starts = at[:, None] - plan.reach + np.arange(plan.reach + 1)
    ok = (starts >= 0) & (starts < len(window))
    ok &= window[np.where(ok, starts, 0)]
    begun = starts[ok]
    w1, w2 = np.zeros(len(begun), np.uint64), np.zeros(len(begun), np.uint64)
    for j in range(plan.least):
        column = h[begun + j]
        w1, w2 = w1 * _ODD + column, (w2 + _mix(column)) * _OTHER
    left, right = _around(h, at, plan)
    sizes = ok.sum(axis=1)
    return matched, {"hash": own["hash"][met[ends]], "start": at, "left": left, "right": right, "starts": (begun, sizes), "w1": (_mix(w1), sizes), "w2": (_mix(w2), sizes)}, hubs


_COLUMNS = {"hash": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "left": pa.list_(pa.int64()), "right": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "w1": pa.list_(pa.int64()), "w2": pa.list_(pa.int64())}


def _batch(kind: int, held: list[tuple[int, int, dict]]) -> pa.RecordBatch:
    """Rows of one kind from several documents; columns that the kind lacks are null."""
    first = next(iter(held[0][2]))
    counts = [len(x[first]) for _, _, x in held]
    n = sum(counts)
    columns = [pa.array(np.repeat(np.array([x[i] for x in held], np.int64), counts)) for i in (0, 1)] + [pa.array(np.full(n, kind, np.int32))]
    for name, dtype in _COLUMNS.items():
        if name not in held[0][2]:
            columns.append(pa.nulls(n, dtype))
        elif pa.types.is_list(dtype):
            values, sizes = (np.concatenate([x[name][i] for _, _, x in held]) for i in (0, 1))
            values = values.view(np.int64) if dtype.value_type == pa.int64() else values.astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values)))
        else:
            columns.append(pa.array(np.concatenate([x[name] for _, _, x in held]).astype(np.int64)).cast(dtype))
    return pa.RecordBatch.from_arrays(columns, ["doc", "version", "kind", *_COLUMNS])


def matches(docs: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """Matches, ends of matches and hubs (see _ends) of documents with seeds."""
    hubs = durable(found.groupBy("hash").agg(F.min(F.struct("doc", "version", "at")).alias("hub")), "earliest")
    fields = ["at", "n", "hash", "hub_doc", "hub_version", "hub_at"]
    led = found.join(hubs, "hash").select("doc", "version", F.struct("at", "n", "hash", F.col("hub.doc").alias("hub_doc"), F.col("hub.version").alias("hub_version"), F.col("hub.at").alias("hub_at")).alias("s"))
    stars = durable(led.groupBy("doc", "version").agg(F.collect_list("s").alias("s")), "stars")

    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        n = 0

        def told():
            for kind, rows in enumerate(held):
                rows = [r for r in rows if len(next(iter(r[2].values())))]
                if rows:
                    yield _batch(kind, rows)

        for batch in batches:
            lists = batch.column(3)
            edges = lists.offsets.to_numpy()
            seeds_ = {f: lists.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields}
            for k, (doc, version) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = {f: v[edges[k] : edges[k + 1]] for f, v in seeds_.items()}
                for rows, x in zip(held, _ends(_hashes(batch.column(2)[k].as_py().split()), doc, version, own, plan), strict=True):
                    rows.append((doc, version, x))
                    n += len(next(iter(x.values())))
                if n > 20_000:
                    yield from told()
                    held, n = ([], [], []), 0
        yield from told()

    return docs.join(stars, ["doc", "version"]).select("doc", "version", "text", "s").mapInArrow(run, _ENDS)


def _common(a: Column, b: Column) -> Column:
    """How many words, nearest first, are equal."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a)).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc and version, by which texts are told apart and ordered, and text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))


def repeats(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc, version, spans: places (start, stop) of words in windows that start earlier, of documents that have some. docs as _keyed gives them."""
    spark = docs.sparkSession
    before = made(spark)
    rows = durable(anchors(docs.select("doc", "version", "text"), plan), "anchors")
    found = durable(seeds(rows), "seeds")
    release(spark, before, before + 1)
    ends = durable(matches(docs, found, plan), "matches")
    hubs = durable(ends.where(F.col("kind") == _HUB).select("hash", F.col("left").alias("l"), F.col("right").alias("r")).dropDuplicates(["hash"]), "hubs")
    grown = ends.where(F.col("kind") == _END).join(hubs, "hash").select("doc", "version", (F.col("start") - _common(F.col("left"), F.col("l"))).alias("start"), (F.col("start") + plan.seed + _common(F.col("right"), F.col("r"))).alias("stop"), "starts", "w1", "w2")
    grown = durable(grown, "grown")
    open_ = grown.select("doc", "version", "start", "stop", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).where((F.col("w.starts") < F.col("start")) | (F.col("w.starts") + plan.least > F.col("stop")))
    open_ = durable(open_.select("doc", "version", F.col("w.starts").alias("start"), "w.w1", "w.w2"), "open")
    first = durable(open_.groupBy("w1", "w2").agg(F.min(F.struct("doc", "version", "start")).alias("f"), F.max(F.struct("doc", "version", "start")).alias("last")).where("f < last").drop("last"), "first")
    later = open_.join(first, ["w1", "w2"]).where(F.struct("doc", "version", "start") > F.col("f")).select("doc", "version", "start", (F.col("start") + plan.least).alias("stop"))
    every = ends.where(F.col("kind") == _MATCH).select("doc", "version", "start", "stop").unionByName(grown.where(F.col("stop") - F.col("start") >= plan.least).select("doc", "version", "start", "stop")).unionByName(later)
    return every.groupBy("doc", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).mapInArrow(_merged, "doc long, version long, spans array<struct<start:int,stop:int>>")


def _merged(batches):
    """Spans in order; those that overlap or touch are one."""
    for batch in batches:
        out = []
        for held in batch.column(2):
            start, stop = (held.values.field(f).to_numpy().astype(np.int64) for f in ("start", "stop"))
            order = np.argsort(start, kind="stable")
            start, most = start[order], np.maximum.accumulate(stop[order])
            first = np.concatenate([[True], start[1:] > most[:-1]])
            last = np.append(first[1:], True)
            out.append([{"start": a, "stop": b} for a, b in zip(start[first].tolist(), most[last].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["doc", "version", "spans"])


def deduplicate(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (start, stop of those that go), for every row.

    docs: doc_id and text; other columns are ignored, so they may have any name. Null and blank texts have no
    words: nothing goes, kept is empty. Texts are read whole. Rows of one doc_id and text are one document and
    lose the same words. Rows of one doc_id and several texts are several documents, in an order that depends on the texts alone;
    rows without doc_id come after all others. An empty table gives an empty result.
    """
    keyed = _keyed(docs)
    found = durable(repeats(keyed, plan), "repeats")

    def run(batches):
        for batch in batches:
            n, removed, kept, spans = [], [], [], batch.column(2).to_pylist()
            for text, gone in zip(batch.column(1), spans, strict=True):
                words = text.as_py().split()
                n.append(len(words))
                removed.append(sum(s["stop"] - s["start"] for s in gone or ()))
                at, left = 0, []
                for s in gone or ():
                    left += words[at : s["start"]]
                    at = s["stop"]
                kept.append(b" ".join(left + words[at:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(2)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    rows = keyed.join(found, ["doc", "version"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>")
