"""Vectorised word scanning over Arrow string columns.

Every function works on one bounded slice of a batch (``slices``): whole
texts, never prefixes.  Words are found on the raw UTF-8 bytes with a 256-entry
table, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a Python worker; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(separators: bytes, lower: bool) -> tuple[np.ndarray, bytes]:
    """(is a word byte?, byte translation) for a set of separator bytes."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    return word, bytes(b + 32 if lower and 65 <= b <= 90 else b for b in range(256))


#: Words [^\x20\x09-\x0D]+, unchanged.
PLAIN = table(b" \t\n\x0b\x0c\r", False)
#: The same after A-Z are lower-cased.
PLAIN_LOWER = table(b" \t\n\x0b\x0c\r", True)
#: Words of a-z, 0-9 and non-ASCII after A-Z are lower-cased.
ALNUM_LOWER = table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _inverse(r: int) -> int:
    return pow(r, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if len(have) <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column as plain StringArray without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def slices(col: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) that hold about ``limit`` bytes at most, one row at least."""
    n = len(col)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


class Words:
    """The words of a slice: byte ranges, the document of each, and their hashes."""

    def __init__(self, col: pa.Array, how: tuple[np.ndarray, bytes]):
        is_word, translation = how
        n = len(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = memoryview(col.buffers()[2])[int(off[0]) : int(off[-1])] if col.buffers()[2] is not None else b""
        self.bytes = bytes(data).translate(translation)
        self.offsets = off - off[0]
        self.n_docs = n
        a = np.frombuffer(self.bytes, np.uint8)
        w = is_word[a]
        first = np.zeros(len(a) + 1, bool)
        first[self.offsets] = True  # a text's first byte; a word never spans two texts
        before = np.empty(len(a), bool)
        before[:1] = False
        before[1:] = w[:-1]
        self.starts = np.flatnonzero(w & (~before | first[:-1]))
        after = np.empty(len(a), bool)
        after[-1:] = False
        after[:-1] = w[1:]
        self.ends = np.flatnonzero(w & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of text i: bounds[i]..bounds[i+1]
        self.doc = np.repeat(np.arange(n), np.diff(self.bounds))
        self.counts = np.diff(self.bounds)
        self._raw = a

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        p = powers(int(_R), len(self._raw) + 1)
        q = powers(_inverse(int(_R)), len(self._raw) + 1)
        h = np.zeros(len(self._raw) + 1, np.uint64)
        np.cumsum((self._raw.astype(np.uint64) + np.uint64(1)) * p[:-1], out=h[1:])
        return mix((h[self.ends] - h[self.starts]) * q[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every window of k consecutive words of one text."""
        n = len(h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        base = 0xD6E8FEB86659FD93
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(base, n), out=s[1:])
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, mix((s[at + k] - s[at]) * powers(_inverse(base), n)[at] + np.uint64(k))

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]]

    def texts(self, lo: int, hi: int) -> list[bytes]:
        """Words lo..hi as byte strings."""
        b = self.bytes
        return [b[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + k, n), -1)
    return np.cumsum(d[:-1]) > 0
