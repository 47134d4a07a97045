"""Vectorised word splitting and hashing over Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Word separators: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CHUNK = 1 << 18
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_OTHER = np.random.default_rng(20250913).integers(0, 2**64, 256, dtype=U64)
_BASE = int(_rng.integers(0, 2**63)) * 8 + 5
_POW: list = []
ODD = _rng.integers(0, 2**63, 4096, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (Stafford's variant 13)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 2 * _CHUNK)
        inverse = pow(_BASE, -1, 2**64)
        out = []
        for base in (_BASE, inverse):
            p = np.full(size, U64(base & (2**64 - 1)))
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _POW[:] = out
    return _POW[0], _POW[1]


def buffer(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # an empty one stays chunked in some releases
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return (LOWER[raw] if lower else raw), offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 word offsets of the documents."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at = offsets[(offsets > 0) & (offsets < len(data))]
        first[at] = word[at]
        last[at - 1] = word[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process: a polynomial over random byte values, then mixed."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = ends[j - 1]
        p, q = _powers(int(hi - lo) + 1)
        c = np.zeros(int(hi - lo) + 1, U64)
        np.cumsum(values[data[lo:hi]] * p[: hi - lo], out=c[1:])
        s = starts[i:j] - lo
        out[i:j] = (c[ends[i:j] - lo] - c[s]) * q[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * ODD[0])


def words(texts, lower: bool = False, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts (``other``: by other byte values) and the n+1 word offsets."""
    data, offsets = buffer(texts, lower)
    starts, ends, at = spans(data, offsets)
    return hashes(data, starts, ends, _OTHER if other else _BYTE), at


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i, over document borders too (the caller masks those)."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        out += h[j : j + len(out)] * ODD[j + 1]
    return mix(out)


def doc_of(at: np.ndarray) -> np.ndarray:
    """The document's index of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted by (document, hash): document index and hash.

    A document of fewer words has its whole sequence as its one shingle; one without words has none.  Two different
    shingles of a document or of a compared pair meet in one 64-bit value with a chance under pairs / 2**64.
    """
    n, d = np.diff(at), doc_of(at)
    full = windows(h, k)
    keep = np.flatnonzero(d[: len(full)] == d[k - 1 : k - 1 + len(full)]) if len(full) else np.zeros(0, np.int64)
    docs, keys = [d[keep]], [full[keep]]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            acc = np.full(len(short), U64(m))
            for j in range(m):
                acc += h[at[short] + j] * ODD[100 + j]
            docs.append(short)
            keys.append(mix(acc))
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    if len(docs) and len(docs) > len(keep):
        order = np.argsort(docs, kind="stable")
        docs, keys = docs[order], keys[order]
    edge = np.searchsorted(docs, np.arange(len(n) + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]
