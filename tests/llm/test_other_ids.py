"""Ids of other names, letters of later Unicode versions, and whole license texts."""

import re

import pytest


def test_id_columns_keep_their_name(spark):
    from ledgerloom.llm.bpe import bpe_encode
    from ledgerloom.llm.licenses import license_scan
    from ledgerloom.llm.queries import default_vocabulary

    docs = spark.createDataFrame([("a", "all rights reserved")], "key string, text string")
    assert license_scan(docs, id_col="key").first().key == "a" and bpe_encode(docs, default_vocabulary(), id_col="key").first().key == "a"


def test_later_letters(spark):
    from tokenizers import Tokenizer

    from ledgerloom.llm.bpe import LATER_LOWER, bpe_encode
    from ledgerloom.llm.queries import default_vocabulary

    library = Tokenizer.from_file(default_vocabulary())
    both = [c for c in LATER_LOWER if c not in (0xA7CE, 0xA7D2, 0xA7D4) and c < 0x16EA0]  # the others are letters to one side only
    texts = [f"a{chr(c)}b" for c in both] + ["".join(map(chr, both)), "it's <|endoftext|> <| |>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe_encode(docs, default_vocabulary()).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and b"".join(i.to_bytes(4, "little") for i in ids) == bytes(r.ids)


def test_templates_against_patterns():
    """Every template as a regular expression over words: its own wording with and without optional regions, and with a word changed."""
    from ledgerloom.llm.licenses import TEMPLATES, compile_template, words

    for label, markup in TEMPLATES:
        a = compile_template(label, markup)
        pattern = re.sub(r"<<any (\d+)\.\.(\d+)>>", lambda m: f" ANY{m[1]}TO{m[2]} ", markup).replace("<<optional>>", " OPT( ").replace("<<end>>", " )END ")
        out = []
        for t in re.findall(r"OPT\(|\)END|ANY\d+TO\d+|[A-Za-z0-9]+", pattern):
            m = re.fullmatch(r"ANY(\d+)TO(\d+)", t)
            out.append("(?:" if t == "OPT(" else ")?" if t == ")END" else rf"(?:\S+ ){{{m[1]},{m[2]}}}" if m else re.escape(t.lower()) + " ")
        exact = re.compile("".join(out))
        full = re.sub(r"<<any (\d+)\.\.(\d+)>>", lambda m: " x" * int(m[2]) + " ", markup).replace("<<optional>>", " ").replace("<<end>>", " ")
        bare = re.sub(r"<<any (\d+)\.\.(\d+)>>", lambda m: " x" * int(m[1]) + " ", markup)
        while (less := re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", " ", bare)) != bare:
            bare = less
        for text in (full, bare):
            w = words("before " + text + " after")
            changed = [*w[: len(w) // 2], b"zz", *w[len(w) // 2 + 1 :]]
            for own in (w, changed, w[: len(w) // 2]):
                line = b" ".join(own).decode() + " "
                starts = [m.start() for m in re.finditer(r"\S+", line)]
                expected = {i for i, s in enumerate(starts) if exact.match(line, s)}
                assert {i for i in range(len(own)) if a.match(own, i) >= 0} == expected
            assert any(a.match(w, i) >= 0 for i in range(len(w)))
