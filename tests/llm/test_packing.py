import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.common import table

from .helpers import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, capacity=2048):
    t = Tokenizer.from_file(PATH)
    got = packing.pack(df, PATH, capacity).collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    return len(bins), -(-total // capacity)


def test_fixture(spark, sf):
    used, least = check(table(spark, sf, "documents"))
    assert used <= least + 2


def test_blocks_meet_in_a_second_round(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    used, least = check(table(spark, sf, "documents"))
    assert used <= least * 1.03 + 2


def test_awkward_and_empty(spark):
    check(awkward(spark, "piece length offset block row filled"), 128)
    assert packing.pack(empty(spark), PATH).collect() == []


def test_special_tokens_and_odd_blanks(spark):
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "é́ é ́a", "A B\x1cC\x0bD\x85E", "İstanbul ΣΑΣ", "don't I'LL 123 45.6"]
    texts += ["a <| Hello World", "<|user|> Anna", "Hello <|ENDOFTEXT|> World", "<|endoftext|>Anna.", "B<|endoftext|>C <|", "Élan <| ÉTÉ!"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_fuzzed_texts_equal_the_tokenizer():
    import random

    from hypothesis import given, settings
    from hypothesis import strategies as st

    own, t = packing.coder(PATH), Tokenizer.from_file(PATH)
    bits = ["<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "Hello", "WORLD", "É", "ß", "İ", "ﬁ", "Σ", "e\u0301", "don't", "I'LL", "1", "23", ".", "!?", ",", "\u00a0", "\u2003", "\x1c", "\x85", "日本", "😀", "#", "'s", "_", "<", "|"]

    @settings(max_examples=400, deadline=None, derandomize=True)
    @given(st.lists(st.one_of(st.sampled_from(bits), st.text(max_size=4)), max_size=12), st.integers(0, 1 << 30))
    def run(parts, seed):
        rng = random.Random(seed)
        text = "".join(p + rng.choice(["", "", " ", "\n", "\t "]) for p in parts)
        text = text.encode("utf-8", "ignore").decode()
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)

    run()


def test_rounds_have_sequence_numbers_of_their_own(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    got = packing.pack(table(spark, sf, "documents"), PATH)
    over = got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048")
    assert over.count() == 0


def test_local_search_raises_squared_fill_and_empties_bins():
    lengths = [60, 60, 50, 50, 40, 40]
    bins = [[0], [1], [2], [3], [4], [5]]
    out = packing.local_search(bins, lengths, 100)
    assert sorted(i for b in out for i in b) == list(range(6))
    assert len(out) <= 4 and all(sum(lengths[i] for i in b) <= 100 for b in out)


def test_exchange_finds_two_for_one():
    assert packing._exchange([(30, 0), (30, 1)], [(50, 2)], 10) in (((0, 1), (2,)), ((1, 0), (2,)))
    assert packing._exchange([(30, 0)], [(50, 2)], 5) is None
