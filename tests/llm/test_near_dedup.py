import random

from quillspark.llm import near_dedup
from quillspark.llm.common import table

from .helpers import awkward, empty, words


def brute(rows, k, percent):
    """rows: (id, text) -> {id: (n, component)} by comparing every pair."""
    sets, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
        parent[i] = i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i][0]), root(i)) for i in ids}


def check(df, k=3, percent=85):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute([r for r in rows if r[0] is not None], k, percent)
    got = near_dedup.near_duplicates(df, near_dedup.Plan(k, percent)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r
    return got


def test_fixture_against_every_pair(spark, sf):
    check(table(spark, sf, "documents").where("length(text) < 6000").limit(400))


def test_family_of_edits_settles_pairs_that_no_hub_links(spark):
    """Chains, far variants and variants of variants share bands; links must be exact."""
    rng, rows = random.Random(5), []
    base = words(150, 3).split()
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", f"new{i}"])
        rows.append((i * 3 + 1, " ".join(w)))
        if i % 10 == 0:
            for j in range(3):
                v = list(w)
                v[rng.randrange(len(v))] = f"variant{j}"
                rows.append((1000 + i * 5 + j, " ".join(v)))
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r.component_id for r in got}) > 5


def test_five_words_and_eighty_percent(spark, sf):
    check(table(spark, sf, "documents").where("length(text) < 3000").limit(200), 5, 80)


def test_awkward_and_empty(spark):
    check(awkward(spark, "n_shingles kept component_id hub id"))
    assert near_dedup.near_duplicates(empty(spark)).collect() == []


def test_pairs_at_the_threshold_share_a_band_and_are_not_far():
    """Measured: of 600 pairs a plan at exactly its threshold none is missed by the bands, or by the estimate."""
    import numpy as np

    rng = np.random.default_rng(8)
    for plan, shared, own in ((near_dedup.Plan(3, 85), 170, 15), (near_dedup.Plan(5, 80), 160, 20)):
        bound = plan.percent / 100
        least = bound - near_dedup.FAR * (bound * (1 - bound) / plan.registers) ** 0.5
        missed, estimates = 0, []
        for _ in range(600):
            s = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
            a, b = (near_dedup.registers_of(np.sort(x), plan).astype(int) for x in (s[: shared + own], np.concatenate([s[:shared], s[shared + own :]])))
            missed += not (a == b).reshape(plan.bands, plan.band_rows).all(axis=1).any()
            up, down = np.array([(a > b).sum()]), np.array([(a < b).sum()])
            n = np.array([float(shared + own)])
            estimates.append(near_dedup.estimate(up, down, plan.registers - up - down, n, n)[0])
        assert missed == 0 and min(estimates) >= least and abs(np.mean(estimates) - bound) < 0.01
