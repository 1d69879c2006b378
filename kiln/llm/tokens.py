"""Word and shingle hashes of many texts at once, in numpy.

Texts are joined into byte buffers of about 256 kB, whatever the size of an
Arrow batch, so memory follows the longest text. A word's hash is a polynomial
over its bytes modulo 2**64, put through a mixing step.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 18
PIECE_ROWS = 1_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """``separators``: the bytes between words. ``lower``: fold A-Z."""

    def __init__(self, separators: bytes, lower: bool = True):
        self.sep = np.zeros(256, dtype=bool)
        self.sep[list(separators)] = True
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.values = _TABLE[self.fold]
        self.values[self.sep] = 0
        self.space = bytes([separators[0]])
        self.powers = np.ones(1, dtype=np.uint64)

    def _power(self, n: int) -> np.ndarray:
        if n > len(self.powers):
            self.powers = np.concatenate([np.ones(1, dtype=np.uint64),
                                          np.cumprod(np.full(max(n, 256), _BASE, dtype=np.uint64))])
        return self.powers

    def _hash(self, texts: list[bytes]):
        """Word hashes of all texts, and the index of each text's first word (one more at the end)."""
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        buf = np.frombuffer(self.space.join(texts) + self.space, dtype=np.uint8)
        word = ~self.sep[buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts = np.flatnonzero(first)
        bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
        if not len(starts):
            return np.zeros(0, dtype=np.uint64), bounds
        gaps = np.diff(starts, append=len(buf))
        place = np.arange(starts[0], len(buf)) - np.repeat(starts, gaps)
        place[~word[starts[0]:]] = 0
        scaled = self.values[buf[starts[0]:]] * self._power(int(place.max()) + 1)[place]
        return mix(np.add.reduceat(scaled, starts - starts[0])), bounds

    def words(self, texts):
        """Yield an array of word hashes for each text (str or None), in order."""
        for hashes, bounds in self.chunks(texts):
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield hashes[a:b]

    def chunks(self, texts):
        """Yield the word hashes of some texts at once, and the index of each text's first word (one more at the end)."""
        held, size = [], 0
        for t in texts:
            b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
            held.append(b)
            size += len(b)
            if size >= CHUNK_BYTES:
                yield self._hash(held)
                held, size = [], 0
        if held:
            yield self._hash(held)


def windows(words: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of the words at ``offsets`` from every place where all of them exist."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j, o in enumerate(offsets):
        out += words[o:o + n] * np.uint64((0xD1342543DE82EF95 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    return mix(out)


#: Words of the contracts: everything but ASCII white space, A-Z folded.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Looser words: ASCII letters, digits and all bytes above 127.
PUNCTUATED = bytes(b for b in range(128) if not chr(b).isalnum())
PUNCTUATED = b" " + PUNCTUATED.replace(b" ", b"")


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words make one; none make an empty set."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        return windows(words, tuple(range(len(words))), salt=len(words))
    return np.unique(windows(words, tuple(range(k))))


def pieces(batches):
    """The batches in pieces, so that what is made of a text, which may be larger than it, leaves soon."""
    for pdf in batches:
        for a in range(0, len(pdf), PIECE_ROWS):
            yield pdf.iloc[a:a + PIECE_ROWS]
    release()


def release():
    """Give freed memory back at the end of a task: Spark keeps the worker for later ones, which would add up."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def runs(batches, keys: list[str], least: int = 1):
    """Frames of the rows that share a key, from batches sorted by it. A run may span batches; only one
    is held at a time. Runs of fewer than ``least`` rows are passed over."""
    import pandas as pd

    held: list = []

    def whole():
        return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])
        inner = np.arange(1, len(cuts) - 2)  # runs that neither begin nor end the batch
        first = pdf.iloc[:cuts[1]]
        if held and any(held[-1][k].iloc[0] != first[k].iloc[0] for k in keys):
            if sum(map(len, held)) >= least:
                yield whole()
            held = []
        held.append(first)
        if len(cuts) > 2:
            if sum(map(len, held)) >= least:
                yield whole()
            for i in inner[np.diff(cuts)[inner] >= least]:
                yield pdf.iloc[cuts[i]:cuts[i + 1]]
            held = [pdf.iloc[cuts[-2]:]]
    if held and sum(map(len, held)) >= least:
        yield whole()
