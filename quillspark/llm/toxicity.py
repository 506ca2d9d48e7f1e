"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (Fit.rows in expectation, drawn by a hash of the id) is read with
   whole texts. Features are words and word beginnings, each at three levels: it occurs, it occurs
   twice, it makes up Fit.dense percent of the words. Those that mark toxic rows beyond chance, by a
   likelihood test corrected for how many were tested, are kept; of nested beginnings the most telling.
2. Voters: every kept feature votes toxic where it fires (lexicon words and beginning patterns alike),
   one votes clean where none fires, and the label votes, too; they abstain elsewhere.
3. A generative label model estimates every voter's accuracy, and the correlations of voters within a
   class, by expectation maximisation from the voters' majority. A row's posterior is made of the
   accuracies of the voters that fire there, each divided by how much the others there repeat it.
4. A linear classifier over the features is trained on the posterior labels.

Only the small linear model goes to the executors; scoring reads every whole text once.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, unit_hash

_WORDS = re.compile(r"[^\W\d_]+")
#: Marks of a feature's level: it occurs, twice, densely.
LEVELS = ("", "#2", "#%")
LABEL, CLEAN = "label", "clean:no mark"
#: Counts, and words with their features, that a worker holds.
HELD = 150_000


@dataclass(frozen=True)
class Fit:
    """rows: labelled rows sampled. starts: lengths of word beginnings. dense: percent of a text's words. lift: how many
    times a feature must raise the odds of toxicity. error: features expected to pass by chance. trust: accuracy of labels,
    the one voter whose accuracy is given, so that the others' are estimated against something."""

    rows: int = 20_000
    starts: tuple[int, ...] = (3, 4, 5, 6, 8)
    dense: int = 1
    lift: float = 3.0
    error: float = 0.05
    trust: float = 0.98
    rounds: int = 60


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    starts: tuple[int, ...]
    dense: int
    accuracies: dict[str, float]
    correlations: dict[tuple[str, str], float]
    prior: float


def features_of(word: str, starts: tuple[int, ...]) -> list[str]:
    """The word, and marked beginnings of longer words."""
    return [word] + [f"{word[:n]}*" for n in starts if len(word) > n]


def plain(feature: str) -> str:
    """Without its level."""
    return feature[:-2] if feature.endswith(LEVELS[1:]) else feature


def levels_of(counts: dict[str, int], words: int, dense: int) -> list[str]:
    """Features at all levels that counts of them among so many words reach."""
    twice, often = [f + LEVELS[1] for f, n in counts.items() if n > 1], -(-dense * words // 100)
    return [*counts, *twice, *[f + LEVELS[2] for f, n in counts.items() if n >= often]]


class _Known(dict):
    """Word -> its features (those of `only`, if given)."""

    def __init__(self, starts: tuple[int, ...], only: set[str] | None = None, held: int = HELD):
        super().__init__()
        self.starts, self.only, self.held = starts, only, held

    def __missing__(self, word: str) -> tuple[str, ...]:
        own = tuple(f for f in features_of(word, self.starts) if self.only is None or f in self.only)
        if len(self) < self.held:
            self[word] = own
        return own


def doc_counts(text: str, how: Fit, known: _Known | None = None) -> tuple[dict[str, int], int]:
    """How often a text has each feature, from its letter runs; its blank-separated chunks, which count as its words."""
    counts: dict[str, int] = {}
    known = _Known(how.starts) if known is None else known
    for w, n in Counter(_WORDS.findall(text.lower())).items():
        own = known[w]
        for f in own:
            counts[f] = counts.get(f, 0) + n
    return counts, len(text.split())


def doc_features(text: str, how: Fit, known: _Known | None = None) -> list[str]:
    """What a text has, at all levels."""
    return levels_of(*doc_counts(text, how, known), how.dense)


def first_places(text: str, how: Fit) -> dict[str, int]:
    """Feature -> hash of the words beside its first place."""
    words, out = _WORDS.findall(text.lower()), {}
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    for w, i in sorted(first.items(), key=lambda x: x[1]):
        new = [f for f in features_of(w, how.starts) if f not in out]
        if new:
            out.update(dict.fromkeys(new, zlib.crc32(" ".join(words[max(0, i - 1) : i] + ["|"] + words[i + 1 : i + 2]).encode())))
    return out


def tests(margins: list[tuple[int, int]], base: float, error: float) -> int:
    """How many tests to correct for, of (documents that have a feature, how many such features) in any order.

    A feature of so few documents that it could not pass, were they all toxic, needs no correction (Tarone): the
    least K such that at most K features could pass a test corrected for K.
    """
    ordered, reach = sorted(margins, reverse=True), 0
    for n, features in ordered:
        if n * math.log(1 / base) < math.log(max(1, reach) / error):
            break
        reach += features
    return max(1, reach)


def evidence(places: int | np.ndarray, good: int | np.ndarray, base: float):
    """Log likelihood that a feature at `places` toxic and `good` clean ones adds over the base rate."""
    n = np.maximum(places + good, 1e-9)
    p = np.clip(places / n, 1e-12, 1 - 1e-12)
    return n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))


def chosen(rows: list[tuple[str, int, int, int]], base: float, tested: int, how: Fit) -> list[str]:
    """Features to keep of (feature, toxic documents, places of those, clean documents), the most telling first.

    Of features at one level of which one's word or beginning begins with another's, only those stay that no
    other of them surpasses; ties go to the shorter, and to a beginning before a word.
    """
    least = math.log(tested / how.error)
    telling = {f: float(evidence(places, good, base)) for f, bad, places, good in rows if places * (1 - base) >= how.lift * base * good}
    telling = {f: e for f, e in telling.items() if e >= least}

    def split(f: str) -> tuple[str, str]:
        level = next((x for x in LEVELS[1:] if f.endswith(x)), "")
        return f.removesuffix(level).removesuffix("*"), level

    best: dict[tuple[str, str], tuple[float, int]] = {}  # stem and level -> the best among it and all that begin with it
    for f, e in telling.items():
        stem, level = split(f)
        for n in range(1, len(stem) + 1):
            key = (stem[:n], level)
            best[key] = max(best.get(key, (0.0, 0)), (e, -len(stem)))
    out = []
    for f, e in telling.items():
        stem, level = split(f)
        own = (e, -len(stem))
        above = [telling.get(stem[:n] + star + level, 0.0) for n in range(1, len(stem) + 1) for star in ("*", "") if stem[:n] + star + level != f and (n < len(stem) or star == "*")]
        if best[stem, level] <= own and max(above, default=0.0) < e:
            out.append(f)
    return sorted(out, key=lambda f: (-telling[f], f))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, how: Fit = Fit()) -> Model:
    """Learns from the labels rows where allowed (a column over doc_id). Rows of null label, id or text teach nothing."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed).groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = labelled.count()
    sample = F.broadcast(labelled.where(unit_hash(F.col("i")) < min(1.0, how.rows / max(1, known))))  # about how.rows rows of 12 bytes
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).join(sample, "i").select("y", "t")
    rows = durable(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")  # bounded, and read twice

    def count(batches):
        """Documents that have a feature; of toxic ones also where it first stands, as copies of a text all say the same."""
        known, good, bad = _Known(how.starts), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            found = [(f, c, n, 0) for (f, c), n in bad.items()] + [(f, -1, 0, n) for f, n in good.items()]
            bad.clear(), good.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, kinds, strict=True)], ["feature", "around", "bad", "good"])

        for batch in batches:
            for y, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if y.as_py() > 0:
                    bad["", 0] += 1
                    around = first_places(text, how)
                    bad.update((f, around[plain(f)]) for f in doc_features(text, how, known))
                else:
                    good.update(doc_features(text, how, known))
                    good[""] += 1
                if len(bad) + len(good) > HELD:
                    yield counted()
        yield counted()

    each = rows.mapInArrow(count, "feature string, around long, bad long, good long").groupBy("feature", "around").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = each.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("places"))
    counted = durable(counted, "marks")
    total = counted.where("feature = ''").first()
    if total is None or not total["bad"] or not total["good"]:
        return Model({}, -20.0, how.starts, how.dense, {}, {}, 0.0)
    base = total["bad"] / (total["bad"] + total["good"])
    margins = counted.where("feature <> ''").groupBy((F.col("places") + F.col("good")).alias("n")).agg(F.count(F.lit(1)).alias("features")).collect()  # at most as many as sampled rows
    tested = tests([(r["n"], r["features"]) for r in margins], base, how.error)
    # what `places` alone could show is more than what a feature does show, so this only spares the driver hopeless ones
    hopeful = counted.where((F.col("feature") != "") & (F.col("places") * math.log(1 / base) >= math.log(tested / how.error)) & (F.col("places") * (1 - base) >= how.lift * base * F.col("good")))
    names = chosen([(r["feature"], r["bad"], r["places"], r["good"]) for r in hopeful.collect()], base, tested, how)
    if not names:
        return Model({}, -20.0, how.starts, how.dense, {}, {}, base)
    index = {f: k for k, f in enumerate(names)}

    def vote(batches):
        known = _Known(how.starts, {plain(f) for f in index})
        for batch in batches:
            hits = [sorted(index[f] for f in doc_features(t, how, known) if f in index) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    patterns = rows.mapInArrow(vote, "y int, hits array<int>").groupBy("y", "hits").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "hits").collect()  # at most as many as sampled rows
    x = np.zeros((len(patterns), len(names)), np.float32)
    for i, r in enumerate(patterns):
        x[i, r["hits"]] = 1
    y, n = np.array([r["y"] > 0 for r in patterns], float), np.array([r["n"] for r in patterns], float)
    return train(x, y, n, names, how)


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, names: list[str], how: Fit) -> Model:
    """x: rows by features (0/1); y: labels; n: how many documents each row stands for."""
    votes = np.concatenate([x, -(x.sum(axis=1, keepdims=True) == 0).astype(np.float32), (2 * y - 1)[:, None].astype(np.float32)], axis=1)
    voters = [*names, CLEAN, LABEL]
    posterior, accuracies, correlations, prior = label_model(votes, n, how.rounds, how.trust)
    weights, bias = linear(x, posterior, n)
    pairs = {(voters[i], voters[j]): float(correlations[i, j]) for i, j in zip(*np.where(np.triu(correlations, 1) > 0.3), strict=True)}
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias, how.starts, how.dense, dict(zip(voters, accuracies.tolist(), strict=True)), pairs, prior)


def label_model(votes: np.ndarray, n: np.ndarray, rounds: int, trust: float):
    """(posterior of toxic by row, accuracy by voter, correlations of voters, prior) of votes +1, -1 or 0; the last voter is the label.

    P(toxic | row) has log odds of prior + sum over its voters j of vote * (logit(accuracy j) - vote * prior odds) / r,
    r being the sum of j's correlations with the row's voters, itself included. It starts at the majority vote.
    """
    fires = votes != 0
    logit = lambda q: np.log(q / (1 - q))
    p = 0.5 + 0.45 * np.sign(votes.sum(axis=1))
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 1 - 1e-4))
        right = np.where(votes > 0, p[:, None], 1 - p[:, None]) * fires
        accuracy = np.clip((n @ right + 1) / (n @ fires + 2), 0.01, 0.99)
        accuracy[-1] = trust
        linked = correlation(votes, p, n)
        repeats = fires @ linked
        told = votes * logit(accuracy)[None, :] - (votes != 0) * logit(prior)
        new = 1 / (1 + np.exp(-np.clip(logit(prior) + (np.where(fires, told / np.maximum(repeats, 1), 0)).sum(axis=1), -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-6:
            break
    return p, accuracy, linked, prior


def correlation(votes: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The larger of the voters' correlations within either class, 0 where negative, 1 with itself.

    Two voters of a class in which one of them is constant are not correlated there.
    """
    out = np.zeros((votes.shape[1],) * 2)
    for w in (n * p, n * (1 - p)):
        total = max(w.sum(), 1e-9)
        centred = votes - (w @ votes) / total
        cov = (centred * w[:, None]).T @ centred / total
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        out = np.maximum(out, np.where(np.outer(sd, sd) > 1e-6, cov / np.maximum(np.outer(sd, sd), 1e-6), 0))
    np.fill_diagonal(out, 1)
    return np.clip(out, 0, 1)


def linear(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 0.1, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ a + np.diag(penalty), a.T @ (n * (p - q)) - penalty * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


class _Marks(dict):
    """Chunk -> the features, of those with a level that counts, of its letter runs, each as often as it stands there; an empty tuple for nearly all."""

    def __init__(self, model: Model, held: int = 300_000):
        super().__init__()
        self.model, self.held = model, held
        self.known = _Known(model.starts, {plain(f) for f in model.weights}, 0)

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        found = tuple(f for w in _WORDS.findall(chunk.lower()) for f in self.known[w])
        if len(self) < self.held:
            self[chunk] = found
        return found

    def score(self, text: str | None) -> float:
        chunks = (text or "").split()
        counts = Counter(f for found in map(self.__getitem__, chunks) if found for f in found)
        z = self.model.bias + sum(self.model.weights.get(f, 0.0) for f in sorted(levels_of(counts, len(chunks), self.model.dense)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_marks: dict[str, _Marks] = {}


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score in [0, 1]. Null text scores as empty text."""
    shared, own = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        if own not in _marks:
            _marks.clear()
            _marks[own] = _Marks(shared.value)
        return text.map(_marks[own].score, na_action=None).astype("float64")

    return score


def predict(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of docs, from the text alone.

    Null or empty text gets the score of a text without marks. Very long texts are read whole; what a
    worker remembers of their chunks is bounded. Other columns of docs are ignored, so they may have any
    name. Repeated rows are each scored, alike; an empty table gives an empty result; without labels of
    both kinds nothing is toxic.
    """
    scored = docs.select(F.col("doc_id"), scorer(docs, model)(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
