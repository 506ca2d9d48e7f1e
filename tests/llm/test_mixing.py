import hashlib
import re

import pytest

from quillspark.llm import mixing
from quillspark.llm.common import table

from .helpers import awkward, empty


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, x, t in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, open_, target = share * sum(total.values()), set(sources), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / w > most * total[s] + 1e-9]
        if not over:
            target |= {s: weight[s] * left / w for s in open_}
            break
        for s in over:
            target[s] = most * total[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    out = []
    for s in sources:
        own = sorted(((hashlib.md5(str((t or "") if i is None else i).encode()).hexdigest(), -1 if i is None else i, size(t)) for i, x, t in rows if x == s))
        budget, at = int(target[s] + 0.5), 0
        whole = budget // total[s] if total[s] else 0
        for _, i, n in own:
            out.append((i, n, total[s], round(target[s], 3), whole * n + max(0, min(n, budget - whole * total[s] - at))))
            at += n
    return sorted(out)


def rows_of(df):
    return [(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()]


def got_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in mixing.mix(df).collect())


def test_fixture(spark, sf):
    df = table(spark, sf, "documents")
    got = got_of(df)
    assert got == brute(rows_of(df))
    assert all(taken <= 2 * n for _, n, _, _, taken in got)
    assert sum(g[4] for g in got) == pytest.approx(1.5 * sum(g[1] for g in got), rel=1e-3)


def test_small_ranges_give_the_same(spark, sf, monkeypatch):
    df = table(spark, sf, "documents")
    want = got_of(df)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 17)
    assert got_of(df) == want


def test_awkward_and_empty(spark):
    df = awkward(spark, "size taken target span key")
    assert got_of(df) == brute(rows_of(df))
    assert mixing.mix(empty(spark)).collect() == []
