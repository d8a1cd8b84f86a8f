"""Vectorised hashes of words and of runs of words.

A word's hash is a polynomial in its bytes modulo 2^64, mixed with its length, taken for all words of a batch at once from prefix sums
over the batch's bytes; a run's hash is the same in the hashes of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES_INVERSE = np.uint64(pow(int(_BYTES), -1, 1 << 64))
#: Bytes whose prefix sums are held at once; a longer word makes its own block longer.
BLOCK = 1 << 16

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


_up, _down, _terms, _sums = powers(BLOCK, _BYTES), powers(BLOCK, _BYTES_INVERSE), np.zeros(BLOCK, np.uint64), np.zeros(BLOCK + 1, np.uint64)


class Words:
    """The words of a batch of texts: ``hashes``, their first and last bytes in ``data``, and how many each text has."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, fold: bool):
        """``edges``: where the texts start in ``data``, and the end of the last one."""
        spaces = (data == 32) | ((data - np.uint8(9)) < 5)  # the word rule ``[^\x20\x09-\x0D]+``; bytes wrap around
        inside = ~spaces
        head, tail = inside.copy(), inside.copy()
        head[1:] &= spaces[:-1]
        tail[:-1] &= spaces[1:]
        cuts = edges[(edges > 0) & (edges < len(data))]  # a word ends with its text
        head[cuts] = inside[cuts]
        tail[cuts - 1] = inside[cuts - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.hashes = _hashes(data + (((data - np.uint8(65)) < 26) * np.uint8(32)) if fold else data, self.starts, self.ends)
        at = np.searchsorted(self.starts, edges)
        self.lengths = np.diff(at)

    def split(self) -> list[np.ndarray]:
        """Each text's hashes."""
        return np.split(self.hashes, np.cumsum(self.lengths)[:-1]) if len(self.lengths) else []


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, first = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            low = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
            n = int(ends[last - 1]) - low
            up, down, terms, sums = (_up, _down, _terms, _sums) if n <= BLOCK else (powers(n, _BYTES), powers(n, _BYTES_INVERSE), np.zeros(n, np.uint64), np.zeros(n + 1, np.uint64))
            np.multiply(data[low : low + n], up[:n], out=terms[:n], casting="unsafe")
            np.cumsum(terms[:n], out=sums[1 : n + 1])
            a, b = starts[first:last] - low, ends[first:last] - low
            out[first:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            first = last
    return out


def words_of(texts: pa.Array | list, fold: bool = False) -> Words:
    """Words of Arrow strings or of a list of str, bytes and None (no words); ``fold`` lower-cases A-Z."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts], pa.large_binary())
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, body = texts.buffers()
    if not len(texts) or offsets is None:
        return Words(np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64), fold)
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None else np.zeros(0, np.uint8)
    return Words(data, edges - edges[0], fold)


def pieces(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes each; a longer text makes a range of its own."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    out, first = [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + size, side="right")) - 1)
        last = min(last, len(texts))
        out.append((first, last))
        first = last
    return out


def run_hashes(hashes: np.ndarray, size: int, up: np.ndarray | None = None, down: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by prefix sums; runs cross document ends, which the caller leaves out."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes)) if up is None else up, powers(len(hashes), INVERSE) if down is None else down
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
        return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours, doubling the width."""
    width, out = 1, x
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == size else np.minimum(out[: len(out) - (size - width)], out[size - width :])
