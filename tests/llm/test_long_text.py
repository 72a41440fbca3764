"""Texts so long that they alone fill many batches."""

import numpy as np


def test_anchors_do_not_depend_on_the_length_of_a_text():
    from ledgerloom.llm.suffixes import Hasher, segments

    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 5 << 20).astype(np.uint8)
    whole, part = Hasher(), Hasher()
    whole.read(text)
    long = {(f, n, a) for f, n, a, _ in zip(*segments(whole, text, np.array([len(text)]), 100))}
    cut = text[2_000_000:2_300_000]
    part.read(cut)
    short = [(f + 2_000_000, n, a + 2_000_000) for f, n, a, _ in zip(*segments(part, cut, np.array([len(cut)]), 100))]
    assert set(short[1:-1]) <= long and len(short) > 5000


def test_repeats_of_a_long_text(spark):
    from ledgerloom.llm.suffixes import suffix_dedup

    rng = np.random.default_rng(6)
    long = rng.integers(97, 101, 4_500_000).astype(np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, long), (2, long[1_000_000:1_003_000]), (3, "x" + long[4_400_000:4_400_150] + "y" + long[5:104])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, [(s.start, s.end) for s in r.spans]) for r in suffix_dedup(docs).collect()}
    assert got == {1: (0, []), 2: (3000, [(0, 3000)]), 3: (150, [(1, 151)])}


def test_crowded_anchors_and_many_parts(spark, monkeypatch):
    from collections import Counter

    from ledgerloom.llm import packed, suffixes
    from tests.llm.cases import documents

    docs, _ = documents(spark)
    key = lambda r: (r.doc_id, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept))
    expected = Counter(map(key, suffixes.suffix_dedup(docs).collect()))
    monkeypatch.setattr(suffixes, "CROWD", 2)
    monkeypatch.setattr(suffixes, "LOT", 300)
    monkeypatch.setattr(packed, "turns", lambda df: 5)
    assert Counter(map(key, suffixes.suffix_dedup(docs).collect())) == expected
