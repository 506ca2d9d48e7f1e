"""MinHash near-duplicate detection on SetSketch registers.

1. One scan hashes each document's word shingles and keeps a SetSketch: register i holds the
   exponentially spaced, truncated minimum of the i-th hash over the set. Registers of a union are
   the maxima of the parts' registers, and equal registers grow likelier with similarity.
2. Documents of equal shingle sets form a class; its smallest id stands for it from there on.
3. Register bands are groups. A group is a star around its most central class (hub): a group of k
   classes gives k-1 pairs, not k^2.
4. A pair's similarity is estimated jointly by likelihood from how many registers are larger, smaller
   and equal; pairs far below the threshold by that estimate are no links.
5. The full sets of the others decide: linked, or not.
6. Components come from alternating large and small stars on the links.
7. What a star leaves open is settled exactly, without comparing pairs. A group's centre is the set of
   shingles that more than half of its members have; D(x) are those in which x differs from it. Sizes
   alone link members that are close to the centre. For any other link between x and y, D(x) and D(y)
   overlap, by at least a number that follows from sizes. So in the order of rarity within the group,
   the first few of either's D have one in common (prefix filter): members that share such a shingle
   are a new group. A shingle of D belongs to at most half of a group, so groups at least halve each
   time; groups of one component, or without a member that needs them, are dropped. Groups of bounded
   size are settled at once, in one task each. Nothing is capped.

Texts of classes in groups are shuffled once; sets never leave the task that compares them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .common import durable

SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, keys array<long>"
#: Shingles of members that one comparison task takes at most (about).
TASK_SHINGLES = 4_000_000
#: A group of at most so many members, and so many shingles, is settled in one task.
SMALL, SMALL_SHINGLES = 512, 1_000_000
#: A pair is far, and no link, if its estimate is this many standard errors below the threshold.
FAR = 5
_BASE, _RATE, _TOP = 1.001, 20.0, (1 << 16) - 2


@dataclass(frozen=True)
class Plan:
    """words a shingle; link at 100 * |A and B| >= percent * |A or B|; chance to miss a link at the threshold."""

    words: int = 3
    percent: int = 85
    band_rows: int = 7
    miss: float = 1e-5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.band_rows))

    @property
    def registers(self) -> int:
        return self.bands * self.band_rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; shorter texts: all words as one; none: empty."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.lower().split()  # bytes: only A-Z are lower-cased, only ASCII blanks split
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    last = len(h) - width + 1
    out = _mix(h[:last] + np.uint64(width))
    for i in range(1, width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last])
    return np.unique(out)


def _hashers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    draw = lambda: rng.integers(0, 1 << 64, registers, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def registers_of(shingles: np.ndarray, plan: Plan) -> np.ndarray:
    """SetSketch registers (uint16); all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(plan.registers, np.uint16)
    a, b = _hashers(plan.registers)
    low = np.full(plan.registers, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(low, ((part[None, :] ^ b[:, None]) * a[:, None]).min(axis=1), out=low)
    u = (low.astype(np.float64) + 0.5) * 2.0**-64
    spaced = np.floor(1 - np.log(-np.log1p(-u) / _RATE) / math.log(_BASE))
    return np.clip(spaced, 0, _TOP + 1).astype(np.uint16)


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood, given how registers of A compare with those of B and both sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (_BASE - 1) / _BASE) / math.log(_BASE), 1e-12, 1)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    for _ in range(40):  # concave: narrowing thirds
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) < likelihood(y)
        low, high = np.where(left, x, low), np.where(left, high, y)
    return (low + high) / 2


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row per document row: doc_id, n_shingles, set fingerprint, sketch, band keys (none for empty sets)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, plan.words)
                if not len(s):
                    out.append((doc_id, 0, 0, 0, b"", []))
                    continue
                r = registers_of(s, plan)
                keys = [xxhash.xxh3_64_intdigest(r[i * plan.band_rows : (i + 1) * plan.band_rows].tobytes(), seed=i) - (1 << 63) for i in range(plan.bands)]
                f1, f2 = int(_mix(s + np.uint64(1)).sum()), int(_mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())
                out.append((doc_id, len(s), f1 - (1 << 63), f2 - (1 << 63), r.tobytes(), keys))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_shingles", "f1", "f2", "sketch", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNATURE)


def _estimated(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (hub, id) with n, the shingles of id, and far: the joint estimate is far below the threshold."""
    bound = plan.percent / 100
    least = bound - FAR * math.sqrt(bound * (1 - bound) / plan.registers)

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
            k_a, k_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(n_a), -1).astype(np.int32) for i in (4, 5))
            up, down = (k_a > k_b).sum(axis=1), (k_a < k_b).sum(axis=1)
            far = estimate(up, down, plan.registers - up - down, n_a, n_b) < least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(far)], ["hub", "id", "n", "far"])

    side = lambda name, n, k: classes.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(n), F.col("sketch").alias(k))
    wide = pairs.join(side("hub", "n_a", "k_a"), "hub").join(side("id", "n", "k_b"), "id")
    return wide.select("hub", "id", "n_a", "n", "k_a", "k_b").mapInArrow(run, "hub long, id long, n long, far boolean")


def _compared(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """hub, id, linked by full sets. A hub's members are dealt over tasks of bounded size."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(TASK_SHINGLES)).alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    members = dealt.join(texts.withColumnRenamed("doc_id", "id"), "id").select("hub", "part", "id", "text")
    hubs = dealt.select(F.col("hub").alias("h"), F.col("part").alias("p")).distinct().join(texts.select(F.col("doc_id").alias("h"), F.col("text").alias("t")), "h")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        hub_sets = [shingle_set(t, plan.words) for t in right.column("t").to_pylist()]
        for hub, i, text in zip(left.column("hub").to_pylist(), left.column("id").to_pylist(), left.column("text").to_pylist(), strict=True):
            s = shingle_set(text, plan.words)
            shared = [len(np.intersect1d(h, s, assume_unique=True)) for h in hub_sets]
            rows.append((hub, i, any(100 * n >= plan.percent * (len(h) + len(s) - n) for h, n in zip(hub_sets, shared, strict=True))))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("hub", "id", "linked"), cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)})

    return members.groupBy("hub", "part").cogroup(hubs.groupBy("h", "p")).applyInArrow(compare, "hub long, id long, linked boolean")


def _sets(members: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """key, id, s: the shingles of every member of a group."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, plan.words).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["key", "id", "s"])

    return members.select("key", "id").join(texts.withColumnRenamed("doc_id", "id"), "id").select("key", "id", "text").mapInArrow(run, "key long, id long, s array<long>")


def _apart(groups: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """key, id, n, apart: the shingles in which a member differs from its group's centre; spare: how far inside the linking radius."""
    sets = durable(_sets(groups, texts, plan), "sets")
    sizes = sets.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    counted = sets.select("key", F.explode("s").alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("seen"))
    centres = counted.join(sizes, "key").where("2 * seen > size").groupBy("key").agg(F.collect_list("t").alias("centre"))
    held = sets.join(centres, "key", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    apart = F.concat(F.array_except("s", "centre"), F.array_except("centre", "s"))
    low, high = 100 - plan.percent, 100 + plan.percent
    return held.select("key", "id", F.size("s").cast("long").alias("n"), apart.alias("apart")).withColumn("spare", F.lit(low) * F.col("n") - F.lit(high) * F.size("apart"))


def _settled(apart: DataFrame) -> DataFrame:
    """Links (u, v) that sizes prove: to the member with most to spare, of those whose lack it covers."""
    best = apart.groupBy("key").agg(F.max(F.struct("spare", (-F.col("id")).alias("minus"))).alias("top"))
    return apart.join(best, "key").where(F.col("spare") + F.col("top.spare") >= 0).select((-F.col("top.minus")).alias("u"), F.col("id").alias("v")).where("u <> v").distinct()


def _subgroups(apart: DataFrame, plan: Plan) -> DataFrame:
    """New groups (key, id, lead): members of a group that share a shingle among their first by rarity."""
    most = F.col("n") * ((100 - plan.percent) / (100 + plan.percent) * (1 + 100 / plan.percent)) + 0.001  # that x and a linked y can have apart
    d = F.size("apart")
    # the one of a linked pair with fewer shingles apart has the shared one among its first `short`, the other among its first `long`
    short, long = d - F.greatest(F.lit(1), F.ceil(d - most / 2)) + 1, d - F.greatest(F.lit(1), F.ceil(d - most)) + 1
    each = apart.select("key", "id", "n", short.alias("short"), long.alias("long"), F.explode("apart").alias("s"))
    each = each.withColumn("seen", F.expr("count(*) OVER (PARTITION BY key, s)"))
    first = each.withColumn("at", F.expr("row_number() OVER (PARTITION BY key, id ORDER BY seen, s)")).where("at <= long AND seen > 1")
    first = first.select(F.xxhash64("key", "s").alias("key"), "id", "n", (F.col("at") <= F.col("short")).alias("lead"))
    led = first.withColumn("led", F.expr("max(lead) OVER (PARTITION BY key)")).withColumn("size", F.expr("count(*) OVER (PARTITION BY key)"))
    return led.where("led AND size > 1").select("key", "id", "n", "lead")


def _live(groups: DataFrame, label: DataFrame) -> DataFrame:
    """key, id, n, component, small: members of groups that hold several components and a member that needs them; of equal groups one."""
    named = groups.join(label, "id", "left").select("key", "id", "n", "lead", F.coalesce("component", "id").alias("component"))
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)"))
    live = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("lead").alias("led"), hashed(1).alias("f"), hashed(2).alias("g"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"))
    live = live.where("a <> b AND led").groupBy("f", "g", "size", "all").agg(F.min("key").alias("key"))
    small = (F.col("size") <= SMALL) & (F.col("all") <= SMALL_SHINGLES)
    return named.join(live.select("key", small.alias("small")), "key").select("key", "id", "n", "component", "small")


def _within(groups: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) between components of small groups, by full sets."""
    rows = groups.join(texts.withColumnRenamed("doc_id", "id"), "id").select("key", "id", "component", "text")

    def settle(group: pa.Table) -> pa.Table:
        ids, parent = group.column("id").to_pylist(), {c: c for c in group.column("component").to_pylist()}
        own, sets = group.column("component").to_pylist(), [shingle_set(t, plan.words) for t in group.column("text").to_pylist()]

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        u, v = [], []
        for i, s in enumerate(sets):
            for j in range(i):
                a, b = root(own[i]), root(own[j])
                low, high = sorted((len(s), len(sets[j])))
                if a == b or 100 * low < plan.percent * high:
                    continue
                both = len(np.intersect1d(s, sets[j], assume_unique=True))
                if 100 * both >= plan.percent * (low + high - both):
                    parent[a] = b
                    u.append(ids[i]), v.append(ids[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("key").applyInArrow(settle, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link."""
    return durable(graph.components(links, durable), "components")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Groups near-duplicate documents.

    docs: doc_id and text; other columns are ignored, so they may have any name. Returns a row per row
    of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself
    included) and kept (doc_id = component_id). Null or blank text: n_shingles 0, linked with nothing.
    Very long texts are read whole. Rows with the same doc_id are one document. A null doc_id is linked
    with nothing: component_id null, kept true. An empty table gives an empty result.
    """
    rows = durable(signatures(docs, plan), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # copies are summed up before anything is joined, and only rows that have some are; written, so that a hot join is split
    twins = durable(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"), "twins")
    members = durable(full.select("doc_id", "f1", "f2", "n_shingles").join(twins, ["f1", "f2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep", "f1", "f2"), "members")
    classes = full.join(members, ["doc_id", "f1", "f2"], "left_anti").dropDuplicates(["doc_id", "f1", "f2"])
    classes = durable(classes.select("doc_id", "n_shingles", "sketch", "keys"), "classes")

    banded = classes.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")).distinct()
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    groups = durable(banded.join(shared, "key").select("key", "id"), "groups")
    texts = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(groups.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sized = groups.join(sizes, "key")
    central = sized.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = groups.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    starred = durable(groups.join(hubs, "key").where("id <> hub").select("key", "hub", "id"), "starred")
    stars = durable(_estimated(starred.select("hub", "id").distinct(), classes, plan), "stars")
    links = durable(_compared(stars.where("NOT far"), texts, plan).where("linked").select(F.col("hub").alias("u"), F.col("id").alias("v")), "found")
    label = components(links)
    # open: buckets that hold several components besides the hub; a hub's open buckets go on as one group
    named = starred.join(stars.select("hub", "id", "n"), ["hub", "id"]).join(label, "id", "left").select("key", "hub", "id", "n", F.coalesce("component", "id").alias("component"))
    unsettled = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    groups = named.join(unsettled, "key").select(F.col("hub").alias("key"), "id", "n", F.lit(True).alias("lead")).distinct()
    while True:
        live = durable(_live(groups, label), "live")
        links = links.unionByName(_within(live.where("small"), texts, plan))
        large = live.where("NOT small")
        if large.isEmpty():
            break
        apart = durable(_apart(large, texts, plan), "apart")
        links = durable(links.unionByName(_settled(apart)), "found")
        label = components(links)
        groups = durable(_subgroups(apart, plan), "groups")
    twin_links = members.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links.unionByName(twin_links))
    return rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce(F.coalesce(F.col("component"), F.col("doc_id")) == F.col("doc_id"), F.lit(True))).alias("kept")
    )
