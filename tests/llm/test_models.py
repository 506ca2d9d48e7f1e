"""op3 and op9: brute force, held-out accuracy, edge cases, no use of what must not be used."""

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language, queries, toxicity
from quillspark.llm.common import hold_out, table

from .helpers import awkward, empty


def test_language_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    got = queries.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def letter_runs(text):
    """Runs of letters and the marks on them, by Unicode classes."""
    out, run = [], ""
    for ch in (text or "").lower() + " ":
        kind = unicodedata.category(ch)[0]
        if kind == "L" or (kind == "M" and run):
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out


def grams(word, n):
    held = word if n == 1 else f"<{word}>"
    return [held[i : i + n] for i in range(len(held) - n + 1)]


def brute_language(learn, texts, least=2, longest=5):
    """(language, score) of texts by plain counts over (language, text) rows."""
    words, parts = defaultdict(Counter), [defaultdict(Counter) for _ in range(longest + 1)]
    for lang, text in learn:
        words[lang].update(letter_runs(text))
    names, total = sorted(k for k, c in words.items() if c), Counter()
    for lang in names:
        total.update(words[lang])
        for w, n in words[lang].items():
            for size in range(1, longest + 1):
                for g in grams(w, size):
                    parts[size][lang][g] += n
    known = {w for w, n in total.items() if n >= least}
    tables = [{lang: Counter({w: n for w, n in words[lang].items() if w in known}) for lang in names}, *parts[1:]]
    keys = [set().union(*(t[lang] for lang in names)) for t in tables] if names else []
    sums = [{lang: sum(t[lang].values()) + 0.5 * (len(k) + 1) for lang in names} for t, k in zip(tables, keys)]
    value = lambda size, key: [math.log((tables[size][lang][key] + 0.5) / sums[size][lang]) for lang in names]
    floor = sum(math.log(0.5 / (sum(tables[0][lang].values()) + 1)) for lang in names) / max(1, len(names))

    def word(w):
        if w in known:
            return value(0, w)
        for size in range(longest, 0, -1):
            found = [value(size, g) for g in grams(w, size) if g in keys[size]]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [floor] * len(names)

    out = []
    for text in texts:
        runs = letter_runs(text)
        if not runs or not names:
            out.append(("und", 0.0))
            continue
        s = [math.fsum(c) for c in zip(*map(word, runs))]
        best = max(range(len(names)), key=lambda i: (s[i], -i))
        out.append((names[best], 1 / sum(math.exp(max(x - s[best], -700)) for x in s)))
    return out


def check_language(docs, allowed):
    rows = docs.select("doc_id", "lang", "text", allowed.alias("learn")).collect()
    want = brute_language([(r.lang, r.text) for r in rows if r.learn and r.lang is not None and r.text is not None], [r.text for r in rows])
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.predict(docs, language.fit(docs, allowed)).collect())
    assert got == Counter((r.doc_id, lang, round(s, 6)) for r, (lang, s) in zip(rows, want))
    return {r.doc_id: lang for r, (lang, _) in zip(rows, want)}


def test_language_against_brute_force(spark, sf):
    check_language(table(spark, sf, "documents"), hold_out(F.col("doc_id"), 5) != 0)


def test_language_hard_cases_against_brute_force(spark):
    rows = [(i, f"the thing thinks of them {i}", "en") for i in range(5)] + [(10 + i, f"die schule schafft schöne dinge e\u0301 {i}", "de") for i in range(4)]
    rows += [(20, "a b", f"x{i}") for i in range(300)] + [(21, "hindi में शब्द", "hi"), (22, "日本語の文章", "ja")]
    asked = ["½ ²", "Ⅷ Ⅳ", "123 _ !", "schuhe", "thinking", "日" * 70_000 + "本", "th" * 40_000 + "schule", "\u0301\u0302", "में", "ÿÿ", "", None, "ﬁ İ ǅ"]
    rows += [(100 + i, t, None) for i, t in enumerate(asked)]
    got = check_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 100)
    assert [got[100 + i] for i in range(3)] == ["und"] * 3 and got[103] == "de" and got[104] == "en" and got[105] == "ja" and got[107] == got[110] == got[111] == "und"


def test_language_sample_is_even_and_remembers_within_bounds(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    some = language.fit(docs, F.lit(True), language.Fit(rows=200))
    every = language.fit(docs, F.lit(True))
    assert some.languages == every.languages and len(some.words.keys) < len(every.words.keys)
    want = sorted(map(tuple, language.predict(docs, every).collect()))
    monkeypatch.setattr(language, "REMEMBERED", 64)
    scorer = language._Scorer(every)
    texts = [r.text for r in docs.orderBy("doc_id").limit(300).collect()]
    for lo in range(0, 300, 50):
        for t, s in zip(texts[lo : lo + 50], scorer.score(texts[lo : lo + 50])):
            if s is not None:
                assert every.languages[int(s.argmax())] in {x[1] for x in want}


def test_language_edges(spark):
    df = awkward(spark, "score lang_pred held_out words")
    m = language.fit(df, F.lit(True))
    got = language.predict(df, m).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert by[9].lang_pred in m.languages
    assert language.predict(empty(spark), m).collect() == []
    none = language.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}


def test_toxicity_held_out(spark, sf):
    labels = table(spark, sf, "labels")
    got = queries.op9_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.8, auc
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(good) + 1


def brute_features(text, how):
    """Feature -> (level names), by plain counting."""
    words, chunks, counts = re.findall(r"[^\W\d_]+", text.lower()), len(text.split()), Counter()
    for w in words:
        counts[w] += 1
        for n in how.starts:
            if len(w) > n:
                counts[w[:n] + "*"] += 1
    out = set(counts)
    out |= {f + "#2" for f, n in counts.items() if n >= 2}
    return out | {f + "#%" for f, n in counts.items() if 100 * n >= how.dense * chunks}


def brute_marks(rows, how):
    """Features chosen, of (text, label) rows."""
    bad, good, places = Counter(), Counter(), defaultdict(set)
    for text, y in rows:
        own = brute_features(text, how)
        if not y:
            good.update(own)
            continue
        bad.update(own)
        words = re.findall(r"[^\W\d_]+", text.lower())
        for f in own:
            base = re.sub("#[2%]$", "", f)
            at = next(i for i, w in enumerate(words) if w == base or (base.endswith("*") and w.startswith(base[:-1]) and len(w) > len(base) - 1))
            places[f].add((tuple(words[max(0, at - 1) : at]), tuple(words[at + 1 : at + 2])))
    base = sum(y for _, y in rows) / len(rows)
    margin = {f: len(places[f]) + good[f] for f in {*bad, *good}}
    top = lambda k: math.log(k / how.error)
    k = 1
    sizes = sorted(set(margin.values()), reverse=True)
    reach = 0
    for n in sizes:  # the testable ones, none of which a correction for all larger margins rules out
        if n * math.log(1 / base) < top(max(1, reach)):
            break
        reach = sum(m >= n for m in margin.values())
    k = max(1, reach)

    def gain(f):
        n, p = margin[f], len(places[f]) / margin[f]
        return n * sum(x * math.log(x / b) for x, b in ((p, base), (1 - p, 1 - base)) if x > 1e-11)

    telling = {f: gain(f) for f in bad if len(places[f]) * (1 - base) >= how.lift * base * good[f] and gain(f) >= top(k)}
    parts = lambda f: re.fullmatch(r"(.*?)(\*?)(#[2%])?", f, re.S).groups()

    def beaten(f):
        stem, star, level = parts(f)
        for g, e in telling.items():
            s, other_star, other = parts(g)
            if g != f and other == level and (s.startswith(stem) or stem.startswith(s)) and (e > telling[f] + 1e-9 or (abs(e - telling[f]) <= 1e-9 and (len(s) < len(stem) or (s == stem and other_star > star)))):
                return True
        return False

    return {f for f in telling if not beaten(f)}


def test_toxicity_marks_against_brute_force(spark, sf):
    how = toxicity.Fit()
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id").where("toxic IS NOT NULL AND text IS NOT NULL").select("text", "toxic").collect()
    m = toxicity.fit(docs, labels, F.lit(True), how)
    assert m.weights.keys() == brute_marks([(r.text, r.toxic > 0) for r in rows], how) and m.weights
    for r in docs.collect():  # scores by plain sums
        z = m.bias + sum(m.weights.get(f, 0) for f in (brute_features(r.text or "", how)))
        assert abs(toxicity._Marks(m, 0).score(r.text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_label_model_against_loops():
    rng = np.random.default_rng(0)
    truth = rng.random(400) < 0.2
    a = np.where(truth, rng.random(400) < 0.7, rng.random(400) < 0.02).astype(float)
    votes = np.stack([a, a, np.where(truth, rng.random(400) < 0.6, rng.random(400) < 0.1), np.zeros(400), np.where(rng.random(400) < 0.05, ~truth, truth) * 2 - 1], axis=1)
    votes[:, 3] = -1.0 * (votes[:, :3].sum(axis=1) == 0)
    n = rng.integers(1, 4, 400).astype(float)
    got, accuracy, linked, prior = toxicity.label_model(votes, n, 5, 0.98)
    logit = lambda q: math.log(q / (1 - q))
    p = [0.5 + 0.45 * float(np.sign(sum(v))) for v in votes]
    for _ in range(5):
        pr = sum(n * p) / sum(n)
        acc = [min(0.99, max(0.01, (sum(n[i] * (p[i] if votes[i][j] > 0 else 1 - p[i]) for i in range(400) if votes[i][j]) + 1) / (sum(n[i] for i in range(400) if votes[i][j]) + 2))) for j in range(5)]
        acc[4] = 0.98
        r = np.eye(5)
        for j in range(5):
            for k in range(5):
                for w in (n * np.array(p), n * (1 - np.array(p))):
                    mj, mk = sum(w * votes[:, j]) / sum(w), sum(w * votes[:, k]) / sum(w)
                    sj, sk = (math.sqrt(sum(w * (votes[:, x] - m) ** 2) / sum(w)) for x, m in ((j, mj), (k, mk)))
                    if j != k and sj * sk > 1e-6:
                        r[j, k] = max(r[j, k], sum(w * (votes[:, j] - mj) * (votes[:, k] - mk)) / sum(w) / (sj * sk))
        p = [1 / (1 + math.exp(-(logit(pr) + sum(votes[i][j] * (logit(acc[j]) - votes[i][j] * logit(pr)) / max(1, sum(r[j, k] for k in range(5) if votes[i][k])) for j in range(5) if votes[i][j])))) for i in range(400)]
    assert np.allclose(got, p, atol=1e-6) and np.allclose(accuracy, acc, atol=1e-6) and abs(prior - pr) < 1e-6 and np.allclose(linked, r, atol=1e-6)
    assert accuracy[0] > accuracy[2] > prior and linked[0, 1] > 0.999  # a voter and its copy count once
    x = votes[:, :3]
    weights, bias = toxicity.linear(x, got, n)
    q = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.abs(x.T @ (n * (got - q)) - 0.1 * weights).max() < 1e-3 and abs((n * (got - q)).sum() - 1e-3 * bias) < 1e-3


def test_small_languages_are_caught(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    held = hold_out(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.predict(docs.where(held), model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("toxic IS NOT NULL").collect()
    for lang in ("en", "de", "es", "fr"):
        bad = [r.predicted for r in got if r.lang == lang and r.toxic]
        assert sum(bad) >= 0.8 * len(bad), (lang, sum(bad), len(bad))
    clean = [r.predicted for r in got if not r.toxic]
    assert sum(clean) <= 0.01 * len(clean)


def test_label_model_and_classifier_on_planted_votes(spark):
    w = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"calm words number {w(i)} here", 0) for i in range(300)] + [(1000 + i, f"you {w(i)} nasty{'gram' if i % 2 else ''} {w(i + 7)} fool {w(i * 3)} here", 1) for i in range(60)]
    rows += [(2000 + i, "copied rare wording of one text, toxic fool", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    assert m.weights and m.accuracies and m.correlations and 0 < m.prior < 1 and {toxicity.CLEAN, toxicity.LABEL} <= m.accuracies.keys()
    new = spark.createDataFrame([(1, "a fool and nasty one"), (2, "a calm one"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.predict(new, m).collect()}
    assert got[1].predicted == 1 and [got[i].predicted for i in (2, 3, 4)] == [0, 0, 0]
    assert got[3].score == got[4].score
    assert not {"copied", "rare", "wording", "copi*", "word*"} & m.weights.keys()  # copies of one text are one place


def test_toxicity_edges(spark):
    df = awkward(spark, "score predicted toxic y t i")
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    got = toxicity.predict(df, none).collect()
    assert len(got) == df.count() and not any(r.predicted for r in got)
    assert toxicity.predict(empty(spark), none).collect() == []
