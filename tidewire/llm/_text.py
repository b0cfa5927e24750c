"""Vectorised text hashing on Arrow buffers: words, word windows, sums of arrays over partitions.

A word is a run of bytes other than [\\x20\\x09-\\x0D]. In UTF-8 these bytes stand only for themselves, so the work
can be done on bytes. Hashes are 64-bit: words of up to 8 bytes are told apart surely among those of their length; longer ones go through two
mixing chains, eight bytes at a time, and those over LONG bytes through XXH3. ``Words.unique`` compares bytes, so it is right whatever hashes do.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at once; a longer text makes a slice of its own.
SLICE = 1 << 20

_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Marks that end a run of letters; a letter is 1, a mark 2, all else 0.
MARKS = ",.!?;:|#$%&*"
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in MARKS]] = 2
#: The lowest k bytes of a number, k = 0 to 8.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can be."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number, the first lowest; zeros follow the last."""
    return np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def hash_words(buf: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``start``, of ``size`` bytes."""
    first = eight[start] & _LOW[np.minimum(size, 8)]
    h = mix(first ^ mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    if len(more):
        more = more[np.argsort(-size[more], kind="stable")]
        a, b, left, at = h[more], mix(first[more] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), size[more] - 8, start[more] + 8
        n = len(more)
        while n:
            v = eight[at[:n]] & _LOW[np.minimum(left[:n], 8)]
            a[:n] = mix(a[:n] ^ v)
            b[:n] = mix(b[:n] * np.uint64(0xA0761D6478BD642F) + v)
            left[:n] -= 8
            at[:n] += 8
            n = int(np.searchsorted(-left[:n], 0))
        h[more] = mix(a ^ (b << np.uint64(32) | b >> np.uint64(32)))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : start[i] + size[i]])
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = col.cast(pa.large_binary() if binary else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about SLICE bytes of text."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(col)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_starts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which words begin, and where each text's begin among them (and the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = _WORD[buf]
    before = np.zeros(len(buf), np.uint8)
    before[1:] = w[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = 0
    start = np.flatnonzero(w > before)
    return start, np.searchsorted(start, off)


class Words:
    """Words of a slice of texts: ``h`` their hashes, ``off`` the place of each text's first word (and the end), ``start`` and ``end`` their bytes."""

    def __init__(self, col: pa.Array, lower: bool = False, part: bool = False):
        """``part``: words are parted where an ASCII letter meets one of MARKS as well."""
        buf, off = buffers(col)
        self.buf, self.doc_off = (LOWER[buf] if lower else buf), off
        n = len(buf)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            self.off = np.zeros(len(off), np.int64)
            return
        w = _WORD[self.buf]
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = w[:-1], w[1:]
        if part:
            k = _KIND[self.buf]
            meet = np.flatnonzero((k[1:] | k[:-1]) == 3)
            before[meet + 1] = 0
            after[meet] = 0
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        before[cut] = 0
        after[cut - 1] = 0
        self.start = np.flatnonzero(w > before)
        self.end = np.flatnonzero(w > after) + 1
        self.h = hash_words(self.buf, eights(self.buf), self.start, self.end - self.start)
        self.off = np.searchsorted(self.start, off)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of one occurrence of each different word, and for each word the number of its like among these. Bytes are compared."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, first, which = np.unique(self.h, return_index=True, return_inverse=True)
        size, eight = self.end - self.start, eights(self.buf)
        other = first[which]
        same = bool((size == size[other]).all())
        todo, at = np.flatnonzero((size > 8) & (size <= LONG)), 0  # equal hashes of shorter words of one length are equal words
        while same and len(todo):
            low = _LOW[np.minimum(size[todo] - at, 8)]
            same = bool(((eight[self.start[todo] + at] ^ eight[self.start[other[todo]] + at]) & low == 0).all())
            at += 8
            todo = todo[size[todo] > at]
        for i in np.flatnonzero(size > LONG) if same else ():
            j = other[i]
            same = same and np.array_equal(self.buf[self.start[i] : self.end[i]], self.buf[self.start[j] : self.end[j]])
        if same:
            return first, which
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(x, len(place)) for x in self.bytes(slice(None))], np.int64)
        return np.unique(which, return_index=True)[1], which

    def bytes(self, which) -> list[bytes]:
        """The words at these places."""
        raw = self.buf.tobytes()
        return [raw[i:j] for i, j in zip(self.start[which].tolist(), self.end[which].tolist())]

    def grams(self, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in order (``skip`` words left out before the last), and the text of each."""
        return grams(self.h, self.doc, n, skip)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of n words and the text of each; a text of fewer words, but at least one, is one window."""
        h, doc = self.grams(n)
        size = np.diff(self.off)
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for j in range(n - 1):
                has = size[short] > j
                x[has] += self.h[self.off[short[has]] + j] * _coef(j)
            h, doc = np.concatenate([h, mix(x)]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        return h, doc


def _coef(j: int) -> np.uint64:
    return np.uint64((0xD1342543DE82EF95 * (2 * j + 3) + 2 * j * j * 0x5851F42D4C957F2C) & 0xFFFFFFFFFFFFFFFF | 1)


def grams(h: np.ndarray, doc: np.ndarray, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    last = n - 1 + skip
    m = len(h) - last
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    x = np.zeros(m, np.uint64)
    for j in range(n):
        at = j if j < n - 1 else last
        x += h[at : at + m] * _coef(j + 16 * skip if skip else j)
    ok = doc[:m] == doc[last:]
    return mix(x[ok]), doc[:m][ok]


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order of text and hash, with counts."""
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


CHUNK = 1 << 14


def tidy(f):
    """A function of batches that gives free memory back to the system when its task ends: Python workers live on, next to each other."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run


class BucketCounts:
    """Counts of hashes in a fixed number of buckets, for finding all heavy hitters in bounded memory."""

    def __init__(self, orders: int, buckets: int):
        self.buckets, self.n = buckets, np.zeros((orders, buckets), np.int32)
        self.held: list[list[np.ndarray]] = [[] for _ in range(orders)]
        self.size = 0

    def add(self, order: int, h: np.ndarray) -> None:
        self.held[order].append((h % np.uint64(self.buckets)).astype(np.int32))
        self.size += len(h)
        if self.size > 1 << 22:
            self._count()

    def _count(self) -> None:
        for n, held in zip(self.n, self.held):
            if held:
                at = np.concatenate(held)
                held.clear()
                at.sort()
                new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                n[at[new]] += np.diff(np.append(new, len(at))).astype(np.int32)
        self.size = 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._count()
        for o, x in enumerate(self.n):
            for c in range(0, self.buckets, CHUNK):
                y = x[c : c + CHUNK]
                if y.any():
                    yield pa.record_batch({"chunk": pa.array([o * (self.buckets // CHUNK) + c // CHUNK], pa.int32()), "data": pa.array([pack(y)], pa.binary())})


def pack(x: np.ndarray) -> bytes:
    """Counts as compressed bytes."""
    kind = np.uint8 if x.max(initial=0) < 256 else np.uint16 if x.max(initial=0) < 65536 else np.int64
    return bytes([np.dtype(kind).itemsize]) + pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True)


def unpack(b: bytes, n: int = CHUNK) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[b[0]]
    return np.frombuffer(pa.decompress(b[1:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind).astype(np.int64)


def sum_chunks(rows, chunks: int, finish=pack):
    """Sum rows (chunk, data) of all partitions: one row for each chunk. Each task streams over its rows and holds the sums of its few chunks.

    ``finish`` makes bytes of a chunk's sums.
    """
    from ._shared import parts

    @tidy
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = unpack(x.as_py())
                sums[c] = sums[c] + x if c in sums else x
        for c, x in sums.items():
            yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "data": pa.array([finish(x)], pa.binary())})

    return rows.repartition(max(1, min(parts(rows.sparkSession), chunks)), "chunk").mapInArrow(add, "chunk int, data binary")


def heavy_buckets(rows, orders: int, buckets: int, least: int) -> np.ndarray:
    """From rows (chunk, data) of all partitions: a bitmap for each order of the buckets counting ``least`` or more.

    Only bitmaps (orders * buckets / 8 bytes) come to the driver.
    """
    out = np.zeros((orders, buckets // 8), np.uint8)
    for r in sum_chunks(rows, orders * buckets // CHUNK, lambda x: np.packbits(x >= least).tobytes()).collect():
        o, c = divmod(r.chunk, buckets // CHUNK)
        out[o, c * CHUNK // 8 : (c + 1) * CHUNK // 8] = np.frombuffer(bytes(r.data), np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = h % np.uint64(len(bitmap) * 8)
    return (bitmap[b >> np.uint64(3)] >> (np.uint64(7) - (b & np.uint64(7))).astype(np.uint8)) & 1 == 1
