"""Vectorised numpy helpers that run inside Arrow tasks: word spans, word, shingle and window hashes.

All hashes are 64-bit and the same on every machine and in every run.  A word is a run of bytes other than
ASCII white space, so UTF-8 bytes can be scanned without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
#: Bytes of text handled in one go; it bounds the temporaries of a task.
CHUNK_BYTES = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, U64)
        out[1:] = U64(base)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    x = x + U64((seed * _R + _R) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Words:
    """The words of several documents: spans in ``data``, a hash each, and where each document's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()  # of bytes: A-Z only
        self.data = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        #: Document i begins at offsets[i] in ``data`` and has the words bounds[i] to bounds[i+1].
        self.offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, self.offsets)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_TABLE[self.data] * powers(_R, len(self.data)), out=total[1:])
        self._total: np.ndarray | None = None
        self.hashes = mix((total[self.ends] - total[self.starts]) * powers(_RINV, len(self.data))[self.starts])

    def _sums(self) -> np.ndarray:
        """Sums of the words' hashes, each times a power of its place, up to each place."""
        if self._total is None:
            self._total = np.zeros(len(self.hashes) + 1, U64)
            np.cumsum(self.hashes * powers(_R, len(self.hashes)), out=self._total[1:])
        return self._total

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each position on (also across documents; callers cut by ``bounds``)."""
        total, n = self._sums(), max(0, len(self.hashes) - k + 1)
        return mix((total[k : k + n] - total[:n]) * powers(_RINV, max(1, n))[:n], k)

    def spans(self, a: np.ndarray, b: np.ndarray, seed: int = 77) -> np.ndarray:
        """A hash of the words from each a up to b, and of their number."""
        total = self._sums()
        return mix((total[b] - total[a]) * powers(_RINV, len(self.hashes) + 1)[a] + (b - a).astype(U64), seed)

    def whole(self) -> np.ndarray:
        """A hash of each document's word sequence."""
        return self.spans(self.bounds[:-1], self.bounds[1:])


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes each; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
