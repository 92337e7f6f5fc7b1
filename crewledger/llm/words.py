"""Words `[^\\x20\\x09-\\x0D]+` of whole texts as numbers, for vectorised work on a slice of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from crewledger.llm.frames import segment_starts

# Odd constants of the splitmix64 finaliser.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def seeds(count: int, seed: int) -> np.ndarray:
    """`count` fixed 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * GOLDEN)


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


class Words:
    """The words of a slice of texts.

    `ids` has a number per word (equal words, equal numbers), `starts` and `counts` the range of each
    text, `vocabulary` the word of each number as bytes.
    """

    def __init__(self, texts: list[bytes]) -> None:
        lists = [x.split() for x in texts]  # bytes.split() knows exactly the six ASCII blanks
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = segment_starts(self.counts)
        coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary: list[bytes] = coded.dictionary.to_pylist()

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A hash of every run of `width` words, by position; runs cross texts, callers mask those."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(seeds(width, seed) | np.uint64(1)):
            out += hashes[k : k + len(out)] * factor
    return mix(out)
