"""Words of many texts at once: numpy over the bytes of an Arrow string column.

Tasks get texts as Arrow batches. The helpers here look at the concatenated UTF-8 bytes of a slice of a
batch, so the cost per byte is a few vector passes and memory stays at a small multiple of the slice (or of
the longest single text, which is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at once, at about 100 bytes of memory each.
SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: The separators of words: space and the controls tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but ASCII letters, digits and bytes of other scripts.
_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x100)]] = False

#: Bytes with A-Z lowered, plus one so that no byte counts as nothing.
_LOWERED = np.arange(1, 257, dtype=_U)
_LOWERED[65:91] += _U(32)
_AS_IS = np.arange(1, 257, dtype=_U)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every bit of ``h`` over the word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, kept between calls up to 4 million."""
    have = known.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, _U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if size <= 1 << 22:
            known[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64) if len(at) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    body, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, body[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the runs ``codes[start:end]``."""
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * _powers(_BASE, len(codes)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(codes) + 1)[starts])


class Words:
    """The words of some texts: where each starts and ends, its text, and hashes of it or of its first bytes."""

    def __init__(self, body: np.ndarray, at: np.ndarray, separators: np.ndarray = _SPACE, lower: bool = True):
        self.body, self.at, self.n_texts = body, at, len(at) - 1
        inside = ~separators[body]
        edge = np.zeros(len(body) + 1, bool)
        edge[at] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside = inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, at)  # words before each text; one entry more than texts
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(self.n_texts), self.counts)
        self._sums: np.ndarray | None = None
        self._lower = lower

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` bytes (0 where the word is shorter)."""
        if self._sums is None:
            codes = (_LOWERED if self._lower else _AS_IS)[self.body]
            self._sums = np.zeros(len(codes) + 1, _U)
            np.cumsum(codes * _powers(_BASE, len(codes)), out=self._sums[1:])
            self._back = _powers(_BASE_INVERSE, len(codes) + 1)
        ends = self.ends if prefix is None else self.starts + prefix
        if prefix is not None:
            short = ends > self.ends
            ends = np.minimum(ends, self.ends)
        found = mixed((self._sums[ends] - self._sums[self.starts]) * self._back[self.starts])
        if prefix is not None:
            found ^= _U(prefix * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            found[short] = 0
        return found


def punctuated(body: np.ndarray, at: np.ndarray) -> Words:
    """Words as runs of letters, digits and non-ASCII bytes, A-Z lowered."""
    return Words(body, at, _PUNCTUATION)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``k`` words, and how many each text has (repeats included).

    A text with fewer than ``k`` words, but one at least, has its whole sequence as one run.
    """
    h, n = words.hashes(), words.counts
    made = np.maximum(n - k + 1, (n > 0).astype(n.dtype))
    ends = np.cumsum(made)
    begin = np.repeat(words.first[:-1], made) + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - made, made)
    short = np.repeat(n < k, made)
    room = np.repeat(n, made)
    out = np.zeros(len(begin), _U)
    for i in range(k):
        add = h[np.minimum(begin + i, len(h) - 1)] * _powers(0xD6E8FEB86659FD93, k)[i] if len(h) else out
        out += np.where(short & (i >= room), _U(0), add)
    return mixed(out + np.where(short, room.astype(_U), _U(0))), made


def word_hash(text: str, prefix: int | None = None) -> int:
    """`Words.hashes` of one word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]), np.zeros(256, bool))
    return int(words.hashes(prefix)[0])
