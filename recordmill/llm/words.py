"""Words and shingles of texts, and numpy hashes of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Bytes that end a word of letters and digits become spaces; A-Z become a-z; bytes over 127 stay.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of any other non-ASCII characters, with A-Z lower-cased."""
    return text.encode().translate(ALNUM).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def spaced_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The spaced words of a column's texts one after the other, with empty ones among them, and where each text's start."""
    found = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(column, "")))
    return found.flatten().cast(pa.binary()), found.offsets.to_numpy()


def shingle_set(words: list[bytes], width: int) -> set:
    """Distinct runs of so many words; fewer words, but not none, are one shingle."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers by which the words of a shingle are told apart.
PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, from its words' hashes."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * PLACES[i]
    return np.unique(mix(total))
