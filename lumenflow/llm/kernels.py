"""Vectorised byte kernels over Arrow text columns: tokens, 64-bit token hashes, shingle sets.

Everything works on bounded pieces of a batch (``pieces``), so memory does not depend on text lengths
beyond the longest single text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 19


def table_of(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], bool)


#: Words of [^\x20\x09-\x0D]+.
NOT_SPACE = table_of(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words of letters, digits and everything beyond ASCII.
ALNUM = table_of(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: A-Z to a-z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PAD = U(0x5851F42D4C957F2D)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=np.uint64)
    return _pow[0], _pow[1]


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def pieces(batches, text: str, size: int = PIECE, rows: int = 4096):
    """Sub-batches of at most `rows` rows and `size` bytes of text (one longer text stands alone)."""
    for batch in batches:
        _, offs = view(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
            to = min(max(to, at + 1), at + rows, n)
            yield batch.slice(at, to - at)
            at = to
    release()


def tokens(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token, and the first token of each text (n + 1 offsets)."""
    m = word[data]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = m[full]
    ends_at = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends_at] = m[ends_at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each token's bytes (polynomial prefix sums, then mixed with the length)."""
    p, q = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=s[1:])
    return mix((s[ends] - s[starts]) * q[starts] + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def word_hash(word: bytes) -> int:
    """The hash that `hashes` gives one token."""
    d = np.frombuffer(word, np.uint8)
    return int(hashes(d, np.array([0]), np.array([len(d)]))[0])


def shingle_sets(data: np.ndarray, offs: np.ndarray, word: np.ndarray, k: int, bits: int = 51) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes (`bits` wide) of each text, and the offsets of the texts' sets.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    starts, ends, of = tokens(data, offs, word)
    n = len(of) - 1
    w = hashes(data, starts, ends)
    counts = np.diff(of)
    doc = np.repeat(np.arange(n), counts)
    pos = np.arange(len(w))
    end = of[1:][doc]
    use = (pos + k <= end) | (pos == of[:-1][doc])
    pos, doc, end = pos[use], doc[use], end[use]
    h = np.zeros(len(pos), np.uint64)
    for j in range(k):
        at = pos + j
        inside = at < end
        h = h * U(0xD6E8FEB86659FD93) + np.where(inside, w[np.minimum(at, max(len(w) - 1, 0))], PAD)
        h ^= h >> U(29)
    h = mix(h) >> U(64 - bits)
    key = (doc.astype(np.uint64) << U(bits)) | h
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    d = (key >> U(bits)).astype(np.int64)
    return key & U((1 << bits) - 1), np.searchsorted(d, np.arange(n + 1))
