"""Best-fit packing of tokenised documents into fixed-length sequences, improved by local search.

1. One scan tokenises whole texts and cuts only documents longer than a sequence. What goes on is a
   narrow row per piece, never the tokens.
2. Pieces are dealt by hash over blocks of bounded size, so a hot source or repeated document spreads
   evenly and no task holds more than a block.
3. A block is packed best-fit, longest first. Then local search between underfull bins: moves and
   one-for-one or two-for-one exchanges that increase the sum of squared fills, emptying the least
   filled bin into the others, until no exchange helps.
4. Pieces of bins that stay underfull meet those of other blocks in a second round of far fewer,
   equally bounded blocks.
"""

from __future__ import annotations

import bisect
import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Pieces a block holds on average; a bin filled less than this share goes into the second round.
BLOCK, FULL_ENOUGH = 4096, 0.99
#: Word pieces whose ids a Python worker remembers, and their longest length in bytes.
REMEMBERED, LONGEST = 500_000, 64
#: Signs that end a word and are a token of their own after letters and digits.
_ENDS = (b".", b",", b";", b":", b"!", b"?")

_coders: dict[str, object] = {}


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Coder(dict):
    """Blank-free byte chunk -> little-endian ids. The tokenizer lower-cases, and never joins text across ASCII blanks.

    A chunk not remembered that is a word of Latin letters, with at most one sign at its end, goes straight
    to the BPE model, which is what the tokenizer would do with it; any other goes through the tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.quick = True
        probes = ["word", "Unlikelyword", "\u00c9t\u00e9", "stra\u00dfe", "a", "zzzqx", "\u00e0", "end.", "ni\u00f1o,", "why?"]
        self.quick = all(self._quick(p.lower().encode()) == self._whole(p.encode()) for p in probes)

    def _whole(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        return b"".join([self.four[i] for i in ids])

    def _quick(self, chunk: bytes) -> bytes | None:
        """Ids of a word, or None if it is not one."""
        if chunk[-1:] in _ENDS and len(chunk) > 1:
            head = self._quick(chunk[:-1]) if chunk[-2:-1] not in _ENDS else None
            return None if head is None else head + self.four[self.model.tokenize(chunk[-1:].decode())[0].id]
        word = chunk.decode("utf-8", "replace")
        if not word.isalpha() or (not word.isascii() and max(word) > "\u00ff"):
            return None
        if not word.isascii():
            word = word.lower().encode().decode("latin-1").translate(self.letters)
        return b"".join([self.four[t.id] for t in self.model.tokenize(word)])

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self._quick(chunk) if self.quick else None
        if ids is None:
            ids = self._whole(chunk)
        if len(self) < REMEMBERED and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if self.quick and b"<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        # what may hold a special token keeps its case: those are only found as they are written
        return b"".join(self[c if not self.quick or b"<|" in c else c.lower()] for c in text.split())


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. A document's ids end with end_id."""

    def run(batches):
        own = coder(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = ([], [], [], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = own.encode(text) + end
                    for n, lo in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[lo : lo + 4 * length]
                        for col, v in zip(rows, (doc_id, n, lo // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that have a bin
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[b].append(i)
        left = room - n
        if left > 0:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Shifts load from the least filled bin to fuller underfull ones while the squared fill grows."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    while len(under) > 1 and sum(capacity - fill[b] for b in under) >= capacity:
        donor, gained = under[0], True
        while gained and bins[donor]:
            gained = False
            for to in reversed(under[1:]):
                room = capacity - fill[to]
                if not room:
                    continue
                give = _exchange([(lengths[i], i) for i in bins[donor]], [(lengths[i], i) for i in bins[to]], room)
                if give is None:
                    continue
                out, back = give
                moved = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                bins[donor] = [i for i in bins[donor] if i not in out] + list(back)
                bins[to] = [i for i in bins[to] if i not in back] + list(out)
                fill[donor] -= moved
                fill[to] += moved
                gained = True
                if not bins[donor]:
                    break
        under = [b for b in under[1:] if fill[b] < capacity]
    return [b for b in bins if b]


def _exchange(own: list[tuple[int, int]], other: list[tuple[int, int]], room: int):
    """What the donor gives and takes back: the largest net transfer that fits in room, or None.

    The receiver is at least as full, so every positive net transfer increases the squared fill.
    """
    best, found = 0, None
    gives = [(n, (i,)) for n, i in own] + [(n + m, (i, j)) for x, (n, i) in enumerate(own) for m, j in own[x + 1 :]]
    takes = sorted([(0, ())] + [(n, (i,)) for n, i in other])
    sizes = [t[0] for t in takes]
    for n, out in gives:
        at = bisect.bisect_left(sizes, n - room)  # least that comes back
        if at < len(takes) and best < n - sizes[at] <= room and (len(out) == 1 or takes[at][1]):
            best, found = n - sizes[at], (out, takes[at][1])
            if best == room:
                break
    return found


def _packed(rows: DataFrame, blocks: int, capacity: int, base: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = group.column("length").to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, filled = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        first = (base + group.column("block")[0].as_py()) << 32
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
            for i in b:
                filled[i] = at
        for name, values in (("sequence_id", sequence), ("offset", offset), ("filled", filled)):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group.drop_columns(["block"])

    block = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(blocks)).alias("block")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, filled long"
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "row", block).groupBy("block").applyInArrow(run, out)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document row into sequences of at most capacity tokens.

    docs: doc_id and text; other columns are ignored, so they may have any name. Returns a row per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null or empty text is its end
    id alone. Very long texts are read whole. Repeated rows are packed each for itself; null ids stay
    null. An empty table gives an empty result. Only documents longer than capacity are cut.
    """
    made = durable(pieces(docs, tokenizer_path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, round(made.count() / BLOCK))
    first = durable(_packed(made, blocks, capacity, 0), "packed")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    under = F.col("filled") < int(FULL_ENOUGH * capacity)
    rest = first.where(under)
    again = _packed(rest, max(1, round(rest.count() / BLOCK)), capacity, blocks)  # blocks of either round have numbers of their own
    return first.where(~under).select(*cols).unionByName(again.select(*cols))
