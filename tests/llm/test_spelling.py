"""Spelling variants against all pairs of words that share a deletion, and the filters against what they must hold."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import spelling
from ledgerloom.llm.spelling import Filters, edits, runs, shard_of, spelling_variants, word_hashes
from tests.llm.cases import documents


def brute(rows, every=97):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    shared = defaultdict(set)
    for w in count:
        for i in range(len(w)):
            shared[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for own in shared.values():
        for w in own:
            near[w] |= own - {w}
    for w in count:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in count:
                near[w].add(v)
                near[v].add(w)
    best = {w: min(near[w], key=lambda v: (-count[v], v)) for w in count if near[w]}
    form = {w: v for w, v in best.items() if count[v] >= 2 * count[w]}
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), count.get(form.get(w))))
    return out


def got(docs, **options):
    rows = spelling_variants(docs, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


CHAIN = " ".join(["abcde"] * 3 + ["abcdef"] * 6 + ["abcdeg"] * 7 + ["xbcdeg"] * 14 + ["xbcdég"] * 28 + ["bookkeeper"] * 9 + ["bokkeeper"] * 4 + ["bookeeper"] * 3 + ["Ärger"] * 4 + ["ärger"] * 9 + ["l" * 300] * 5 + ["l" * 299] * 11)
TEXTS = [None, "", CHAIN, "x" * 20_000 + " Maß Maße Maße Maße Maßen ÄÖÜäöü×÷ éaĀbcdefgĀ ÿ🙂ÿ", ("tests teste teste's TESTED " * 40) + "Ĳssel\x00ssel", "tests-teste_tests"]


@pytest.mark.parametrize("every", [97, 2, None])
def test_awkward_texts(spark, every):
    for texts in (TEXTS, []):
        docs, rows = documents(spark, texts)
        assert got(docs, every=every) == brute(rows, every)


def test_chains_lead_to_their_last(spark):
    docs, rows = documents(spark, [CHAIN])
    roots = {r.word: r.root for r in spelling_variants(docs, every=None).collect()}
    assert roots["abcde"] == "xbcdég" and roots["bokkeeper"] == roots["bookeeper"] == "bookkeeper"


def test_registered_query(spark, sf_dir):
    from ledgerloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, sf_dir).collect()} == brute(rows)


def test_a_text_is_taken_in_parts(monkeypatch):
    monkeypatch.setattr(spelling, "TAKEN", 7)
    text = "Some words, and sömé more of them " * 30
    assert runs(text) == Counter(re.sub("[A-Z]", lambda m: m[0].lower(), r).encode() for r in re.findall("[A-Za-zÀ-ÿ]+", text))


@pytest.mark.parametrize("room", [32 << 20, 64])
def test_filters_lose_nothing(monkeypatch, room):
    """A filter that is far too small lets more through, and still every edit that is a word."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", room)
    rng = np.random.default_rng(3)
    words = sorted({"".join(chr(97 + c) for c in rng.integers(0, 3, n)) for n in rng.integers(5, 8, 400)})
    held = Filters(dict(Counter(int(shard_of(len(w))) for w in words)), np.array([97, 98, 99]))
    for w in words:
        block, mask = held.places(word_hashes(np.array([[ord(c) for c in w]])), int(shard_of(len(w))))
        held.bits[block] |= mask
    found = {(words[i], e) for i, e in edits(words, held)}
    sub = {(w, w[:i] + c + w[i + 1 :]) for w in words for i in range(len(w)) for c in "abc" if c > w[i]}
    wanted = {(w, e) for w, e in sub | {(w, w[:i] + w[i + 1 :]) for w in words for i in range(len(w))} if e in set(words)}
    assert wanted <= found
    if room > 1 << 20:
        assert len(found - wanted) < 0.05 * len(sub)
