"""Language identification by word-first backoff.

A known word scores each language by the log of its frequency there. An unseen word backs off to
character n-grams of falling length: the longest length at which the model knows any n-gram of the
word scores it by their mean log frequency, over the whole word however long it is. A document's
languages are weighed by the sums over its words.

The model is fitted on a bounded sample of labelled rows: Fit.rows rows in expectation, equally many of
each language that has them, drawn by a hash of the id; each counts with its whole text. Every language,
word and n-gram of the sample counts. The model holds them as sparse rows, so its size follows the
sample's and it can be broadcast. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, unit_hash

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
UNKNOWN = "und"
#: Scores that a worker remembers, over all languages, and characters of their words; texts scored at once.
REMEMBERED, CHARS, TEXTS = 4_000_000, 1 << 26, 64


@dataclass(frozen=True)
class Fit:
    """rows: labelled rows sampled. longest: n-grams. least_seen: times that the sample holds a word at least, for it to be known."""

    rows: int = 20_000
    longest: int = 5
    least_seen: int = 2


@dataclass
class Table:
    """Counts by key and language, sparse: keys ascending, row r holds entries starts[r] to starts[r + 1]; sums: all counts of a language."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def __post_init__(self):
        total = self.sums + 0.5 * (len(self.keys) + 1)
        self.unseen = np.log(0.5 / total)
        self.log_total = np.log(total)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of every key; -1 if it is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def means(self, rows: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """By owner, the mean over its rows of log frequencies by language: ln((count + 1/2) / (sum + (keys + 1) / 2))."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        more = np.log(self.counts[at] + 0.5) - math.log(0.5)  # what is above the unseen
        out = np.bincount(np.repeat(owner, sizes) * len(self.sums) + self.langs[at], more, owners * len(self.sums))
        return self.unseen + out.reshape(owners, len(self.sums)) / np.maximum(np.bincount(owner, minlength=owners), 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: list[Table]  # of lengths 1 to longest
    floor: float

    def log_frequencies(self, words: list[str]) -> np.ndarray:
        """Log frequency of letter runs by language, a row each."""
        out = np.full((len(words), len(self.languages)), self.floor)
        rows = self.words.find(word_keys(words))
        known = np.flatnonzero(rows >= 0)
        out[known] = self.words.means(rows[known], np.arange(len(known)), len(known))
        left = np.flatnonzero(rows < 0)
        for n in range(len(self.grams), 0, -1):
            if not len(left):
                break
            keys, owner = gram_keys([words[i] for i in left], n)
            rows = self.grams[n - 1].find(keys)
            rows, owner = rows[rows >= 0], owner[rows >= 0]
            hit, owner = np.unique(owner, return_inverse=True)
            out[left[hit]] = self.grams[n - 1].means(rows, owner, len(hit))
            left = np.delete(left, hit)
        return out


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64)


def gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words between their ends, and whose they are; single letters have no ends."""
    held = words if n == 1 else [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner, ends = np.repeat(np.arange(len(held)), sizes), np.repeat(np.cumsum(sizes), sizes)
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    inside = np.arange(len(out)) + n <= ends[: len(out)]
    return out[inside].view(np.int64), owner[: len(out)][inside]


def letter_runs(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def fit(docs: DataFrame, allowed: Column, how: Fit = Fit()) -> Model:
    """Learns from text and lang of the rows where allowed; rows of null lang or text teach nothing.

    Repeated rows count as often as they stand. An empty table, or one without languages, gives a model
    that names none.
    """
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("i"), F.col("lang").cast("string").alias("l"), F.col("text").cast("string").alias("t"))
    sizes = durable(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = how.rows / max(1, sizes.count())
    sample = rows.join(sizes.select(F.col("l").alias("name"), (F.lit(each) / F.col("n")).alias("share")), F.col("l") == F.col("name")).where(unit_hash(F.col("i")) < F.col("share"))
    sample = sample.select("l", "t").repartition(docs.sparkSession.sparkContext.defaultParallelism)  # bounded

    def count(batches):
        for batch in batches:
            own: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[lang].update(letter_runs(text))
            flat = [(lang, w, n) for lang, c in own.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    words = durable(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")

    def keyed(batches):
        for batch in batches:
            own: dict[str, list[tuple[str, int]]] = defaultdict(list)
            for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own[lang].append((word, n))
            for lang, held in own.items():
                names, counts = [w for w, _ in held], np.array([n for _, n in held], np.int64)
                yield _batch(lang, 0, word_keys(names), counts)
                for size in range(1, how.longest + 1):
                    keys, owner = gram_keys(names, size)
                    yield _batch(lang, size, keys, counts[owner])

    counted = words.mapInArrow(keyed, "lang string, size int, key long, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    known = counted.withColumn("all", F.expr("sum(n) OVER (PARTITION BY size, key)")).where((F.col("size") > 0) | (F.col("all") >= how.least_seen))
    held = known.select("size", "key", "lang", "n").toArrow()  # of the bounded sample
    return model(held, how)


def _batch(lang: str, size: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts summed by key."""
    unique, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, counts, len(unique)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(np.full(len(unique), size, np.int32)), pa.array(unique), pa.array(sums)], ["lang", "size", "key", "n"])


def model(held: pa.Table, how: Fit = Fit()) -> Model:
    """A model of counts: size (0: whole words, or the length of n-grams), key, lang, n."""
    languages = sorted(set(held.column("lang").unique().to_pylist()))
    code = {l: i for i, l in enumerate(languages)}
    names = held.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([code[l] for l in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(held) else np.zeros(0, np.int64)
    size, key, n = (held.column(c).to_numpy() for c in ("size", "key", "n"))

    def table(k: int) -> Table:
        own = np.flatnonzero(size == k)
        own = own[np.lexsort((lang[own], key[own]))]
        keys, first = np.unique(key[own], return_index=True)
        sums = np.bincount(lang[own], n[own], len(languages)).astype(np.float64)
        return Table(keys, np.append(first, len(own)).astype(np.int64), lang[own].astype(np.int32), n[own].astype(np.float32 if n.max(initial=0) < 1 << 24 else np.float64), sums)

    words = table(0)
    return Model(languages, words, [table(k) for k in range(1, how.longest + 1)], float(np.mean(np.log(0.5 / (words.sums + 1)))) if languages else 0.0)


class _Scorer:
    """Scores texts; remembers words with their rows of log frequencies, until there are too many."""

    def __init__(self, fitted: Model):
        self.model, self.held = fitted, max(1, REMEMBERED // max(1, len(fitted.languages)))
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(fitted.languages)))
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        """Remembers the rows of words, some million characters at a time."""
        if len(self.at) + len(words) > self.held or self.chars > CHARS:
            self.at, self.chars, self.rows = {}, 0, self.rows[:0]
        new, parts, size, lo = [w for w in words if w not in self.at], [], 0, 0
        for hi, w in enumerate(new, 1):
            size += len(w) + 2
            if size > 1 << 20 or hi == len(new):
                parts.append(self.model.log_frequencies(new[lo:hi]))
                self.chars, lo, size = self.chars + size, hi, 0
        start = len(self.at)
        self.at.update((w, start + i) for i, w in enumerate(new))
        more = np.concatenate(parts) if parts else self.rows[:0]
        if start + len(more) > len(self.rows):  # room doubles
            grown = np.zeros((max(2 * len(self.rows), start + len(more)), self.rows.shape[1]))
            grown[:start] = self.rows[:start]
            self.rows = grown
        self.rows[start : start + len(more)] = more

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Sums by language of every text; None without letters."""
        runs = [letter_runs(t) for t in texts]
        self.learn(list(dict.fromkeys(w for r in runs for w in r)))
        out = []
        for r in runs:
            at = np.fromiter(map(self.at.__getitem__, r), np.int64, len(r))
            out.append(sum(self.rows[at[lo : lo + 65536]].sum(axis=0) for lo in range(0, len(at), 65536)) if r else None)
        return out


_scorers: dict[str, _Scorer] = {}


def predict(docs: DataFrame, fitted: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from the text alone.

    Null text or text without letters (Unicode class L): und, score 0; so too if nothing was learned.
    score is the posterior weight of the language named; ties go to the first by name. Very long texts
    and words are read whole. Other columns of docs are ignored, so they may have any name. An empty
    table gives an empty result; repeated rows are each scored, alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    names, own = fitted.languages, uuid.uuid4().hex

    def run(batches):
        if own not in _scorers:
            _scorers.clear()
            _scorers[own] = _Scorer(shared.value)
        scorer = _scorers[own]
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(1)
            for s in (s for lo in range(0, len(texts), TEXTS) for s in (scorer.score(texts.slice(lo, TEXTS).to_pylist()) if names else [None] * len(texts.slice(lo, TEXTS)))):
                if s is None:
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                best = int(np.argmax(s))
                langs.append(names[best]), scores.append(float(1 / np.exp(np.maximum(s - s[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
