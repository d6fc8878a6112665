"""Words and word shingles as 64-bit hashes, vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MOST_CACHED = 300_000


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """A word's hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_CACHED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at blanks, tabs and line ends (0x20, 0x09 to 0x0D), as bytes.split() does."""
    return text.lower().split()


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; of all words as one where there are fewer, of none where there is none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * M1 + hashes[i : n - k + 1 + i])
    return out


def shingle_set(text: bytes, k: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    return np.unique(rolled(known.of(words_of(text)), k))


def raw_texts(column) -> list[bytes]:
    """An Arrow string column's texts in UTF-8, b"" for null, without decoding them."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
