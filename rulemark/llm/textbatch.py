"""Vectorised tokenising of Arrow string columns with numpy.

A batch's texts are one byte buffer plus offsets, so words, windows and hashes
of thousands of documents come from a handful of array operations. Words are
runs of anything but space and the bytes 0x09-0x0D; as UTF-8 continuation bytes
are all above 0x7F, working on bytes splits exactly as working on code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
#: Base of a second, independent hash.
OTHER_BASE = 0xC2B2AE3D27D4EB4F
#: Bytes hashed at a time; bounds the temporaries, whatever a text's length.
HASH_BLOCK = 1 << 19
#: Bytes of text that one pass of an operator works on, unless one text is longer.
CHUNK_BYTES = 4 << 20


def pieces(table: pa.RecordBatch | pa.Table, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of a batch holding up to ``limit`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield table.slice(at, to - at)
        at = to


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


#: All bytes but ASCII letters and those of non-ASCII characters.
NOT_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of every word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.frombuffer(data.tobytes().translate((~separators).tobytes()), bool)
    # Words start and end in turn where bytes change between separators and others, or where one text follows another within a word.
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([[0] if inside[0] else [], turns, [len(data)] if inside[-1] else []]).astype(np.int64)
    starts, ends = turns[::2], turns[1::2]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    edge = np.unique(edge[inside[edge] & inside[edge - 1]])
    if len(edge):
        starts, ends = np.sort(np.append(starts, edge), kind="stable"), np.sort(np.append(ends, edge), kind="stable")
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans above this many bytes are hashed by a cryptographic hash: long strings can be built that collide as polynomials.
POLYNOMIAL_BYTES = 256
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, HASH_BLOCK)
    if (n, base) not in _POWERS:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if n > HASH_BLOCK:
            return made
        _POWERS[n, base] = made
    return _POWERS[n, base]


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray, base: int = _BASE) -> list[np.ndarray]:
    """64-bit hashes of the bytes from each start to each end, the same wherever they stand.

    Starts and the last ends must ascend; the other ends lie before the last.
    Hashes of another odd ``base`` are independent of these.
    """
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    last, at = ends[-1], 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(last, low + HASH_BLOCK, "right")))
        part = data[low : last[to - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(part) + 1, base)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * up[: len(part)], out=total[1:])
        s = starts[at:to] - low
        before, shift = total[s], down[s]
        for made, end in zip(out, ends, strict=True):
            e = end[at:to] - low
            made[at:to] = mix((total[e] - before) * shift + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    for made, end in zip(out, ends, strict=True):
        for k in np.flatnonzero(end - starts > POLYNOMIAL_BYTES):
            made[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : end[k]], digest_size=8, key=base.to_bytes(8, "little")).digest(), "little")
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    return span_hashes(data, starts, ends, base=base)[0]


def windows(hashes: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of n words within a text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        value = mix(hashes[:m])
        for k in range(1, n):
            value = mix(value * np.uint64(0x100000001B3) + hashes[k : k + m])
    inside = text_of[:m] == text_of[n - 1 :]
    return value[inside], text_of[:m][inside]


class TermTable:
    """Numbers of a bounded set of term hashes; absent terms get -1."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(np.asarray(hashes, np.uint64))
        self.there = np.zeros(1 << 20, bool)
        self.there[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.there[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            good = self.hashes[at] == hashes[maybe]
            out[maybe[good]] = at[good]
        return out
