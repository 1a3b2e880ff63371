"""Vectorised word and window hashes over batches of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are held as Python objects at once, and texts whose bytes are hashed at once (about 50 bytes of arrays a byte).
CHUNK_BYTES, HASH_BYTES = 2 << 20, 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words: a sum of random byte values times powers of an odd base, finalised.
    ``lower``: A-Z count as a-z."""

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.value[SPACES] = 0
        self.base = rng.integers(1, 2 ** 62, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, words per text)."""
        hashes, counts = [], []
        for part in chunks(texts, HASH_BYTES):
            h, n = self._chunk(part)
            hashes.append(h)
            counts.append(n)
        if not counts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(counts)

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = SPACES[buf]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        counts = np.diff(np.searchsorted(start, ends), prepend=0)
        if not len(start):
            return np.zeros(0, np.uint64), counts
        place = np.arange(start[0], len(buf)) - np.repeat(start, np.diff(start, append=len(buf)))
        most = int(place.max()) + 1
        if most > len(self.powers):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * most, self.base)]), dtype=np.uint64)
        terms = self.value[buf[start[0]:]] * self.powers[place]
        return mix64(np.add.reduceat(terms, start - start[0])), counts


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The runs of ``chunks`` over a string column (null: empty); only one run at a time is held as Python objects."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, side="right")) - 1)
        yield [t or b"" for t in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
        lo = hi


def window_hash(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the ``width`` words from each position (the last width - 1 positions are left out)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(base) + words[j:j + n]
    return mix64(out)


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, place in its text) of every word."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return owner, np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)


def runs_of(sorted_places: np.ndarray) -> bytes:
    """Ascending integers as (start, length) pairs."""
    if not len(sorted_places):
        return b""
    cut = np.flatnonzero(np.diff(sorted_places) != 1) + 1
    start = sorted_places[np.concatenate([[0], cut])]
    length = np.diff(np.concatenate([[0], cut, [len(sorted_places)]]))
    return np.stack([start, length], axis=1).astype("<i4").tobytes()


def mark_runs(mask: np.ndarray, runs: bytes) -> None:
    for start, length in np.frombuffer(runs, "<i4").reshape(-1, 2):
        mask[start:start + length] = True
