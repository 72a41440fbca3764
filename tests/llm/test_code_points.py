"""Every code point of Unicode is split, and those that tables differ about are encoded, as by the library."""

import numpy as np
import regex
from tokenizers import Regex, Tokenizer, pre_tokenizers

from ledgerloom.llm.bpe import LATER_LETTERS, LATER_LOWER, LATER_NUMBERS, PIECES, Encoder, read_vocabulary
from ledgerloom.llm.queries import default_vocabulary


def runs(text):
    return [range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1) for r in text.split()]


def test_all_code_points_are_split_as_by_the_library():
    library = pre_tokenizers.Split(Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
    ours = regex.compile(PIECES)
    for a in range(0, 0x110000, 256):
        text = " ".join(f"a{c}b 1{c}1 {c}{c} .{c}." for c in map(chr, range(a, a + 256)) if not 0xD800 <= ord(c) < 0xE000)
        assert ours.findall(text) == [t for t, _ in library.pre_tokenize_str(text)], hex(a)


def test_later_characters_are_encoded_as_by_the_library():
    path = default_vocabulary()
    tokenizer, encoder = Tokenizer.from_file(path), Encoder(read_vocabulary(path))
    points = [p for r in runs(LATER_LETTERS + LATER_NUMBERS) for p in (*r[:3], *r[-3:])] + list(LATER_LOWER) + [*LATER_LOWER.values()]
    texts = [f"a{chr(p)}b {chr(p)}1 {chr(p)}{chr(p)}́ it's {chr(p)}'s" for p in points]
    packed, decoded, _ = encoder.batch(texts)
    for text, ids, said in zip(texts, packed, decoded):
        own = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == own and said == tokenizer.decode(own, skip_special_tokens=False), text.encode("unicode_escape")
