"""Hashes of word shingles, whole batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import mix, spaced_words

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hash a task remembers.
REMEMBERED = 200_000


class WordHashes(dict):
    """64-bit hash of each word; looked up after its first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], size: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of so many words, as sorted hashes; with fewer words, the whole sequence as one."""
    split = [spaced_words(t) for t in texts]
    counts = [len(w) for w in split]
    flat = np.fromiter(map(hashes.__getitem__, (w for words in split for w in words)), np.uint64, sum(counts))
    if len(flat) >= size:
        rolled = flat[: len(flat) - size + 1].copy()
        for k in range(1, size):
            rolled *= STEP
            rolled += flat[k : len(flat) - size + 1 + k]
        rolled = mix(rolled)
    at = 0
    for n in counts:
        if n >= size:
            own = np.sort(rolled[at : at + n - size + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in flat[at : at + n]:
                    whole = whole * STEP + h
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def set_id(own: np.ndarray) -> int:
    """A signed 64-bit name for a set of hashes."""
    return int.from_bytes(xxhash.xxh3_64_digest(own.tobytes()), "little", signed=True)
