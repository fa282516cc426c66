"""Repeated byte strings across documents, by a distributed difference-cover suffix sort.

A byte is removed when a string of ``WINDOW`` bytes that covers it also starts in a document with a smaller id; strings are judged
on the input. The strings are sorted and compared with those beside them:

* Sampled triples: of the positions of a text those at 1 and 2 modulo 3 (counted in its region) are the sample. Their triples of
  bytes are numbers already; triples of these, of 9 bytes, are sorted across the cluster and named by rank.
* Recursion on names: triples of names are sorted and named again, until a name stands for 27 and then, by two
  names that overlap, for exactly 48 bytes: longer names would tell strings of ``WINDOW`` bytes apart by what follows them.
* Merging: strings of ``WINDOW`` bytes at sampled positions are ordered by their name and two bytes. The remaining ones, at
  0 modulo 3, are ordered by a byte and the name after it, and merged in: against class 1 by one byte and a name, against
  class 2 by two bytes and a name, which is what a difference cover gives. Then each is compared with the one before
  it in order; names, bytes and places are exact, no hash decides what is equal. The least id of equal strings goes back.

What is sorted: copies of whole texts are one text (each further copy repeats it wholly). A window's anchor is the least hash of its
``GRAM``-byte strings, so equal windows have equal anchors, and windows whose anchor one document alone has are left out.
Only windows of one anchor can be equal, so the others are cut out as pieces, runs of windows with one anchor, and dealt by it.
Parts of about ``PART`` bytes hold all different pieces of their anchors and are sorted alone, by the same steps. An anchor with more
than ``HOT`` bytes of pieces is sorted across the cluster: its windows are cut out as regions and laid out in parts in the order of their
anchors, so that equal passages stand beside each other. A part sends each different string once, as columns of numbers for each range
of strings; ranges are split at strings sampled from the regions. So a passage that a third of all documents hold costs a range one row
for each part, and no task or driver sees more than one range, one bucket of anchors, one part, or one chunk of ``CHUNK`` bytes of text
(or one longer text).

Defined results: a null text is empty; rows that repeat an id are judged by their own text and never remove bytes from each
other; a row with a null id is left as it is and removes nothing; matches never cross documents; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.words import M1, M2, M3, U64, mix, slices, sliding_min, text_bytes
from tracewright.session import Scratch

WINDOW, GRAM, BLOCK, CHUNK, PART, ROUTE, MOST_RANGES = 50, 20, 1 << 18, 4 << 20, 1 << 20, 24, (1 << 16) - 1
#: windows of a piece at most, bytes of an anchor's pieces that one part still holds, bytes of pieces that are dealt at a time
RUN, HOT, DEALT = 1 << 12, 1 << 18, 24 << 20
#: bytes that a name stands for -> places, from a position on, of the names that it is made of; at 9 it is bytes
NAMES = {9: (0, 8), 27: (0, 9, 18), 48: (0, 21)}
EMPTY = sha256(b"").digest()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x).view(U64)
    return b"".join((x >> U64(8 * k)).astype(np.uint8).tobytes() for k in range(8))


def packed(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; the lowest bytes of long numbers stand together, then the next ones, and so on."""
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "<i8").tobytes()
    body = b"".join([head, *(x.tobytes() if x.itemsize < 8 else planes(x) for x in arrays)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(body, "<i8", 1)[0])
    size = np.frombuffer(body, "<i8", count, 8)
    at = np.concatenate(([0], np.cumsum(size))) + 8 * (count + 1)
    out = []
    for kind, n, a in zip(kinds, size.tolist(), at.tolist()):
        if kind[-1] == "8":
            whole = np.zeros(n // 8, U64)
            for k, plane in enumerate(np.frombuffer(body, np.uint8, n, a).reshape(8, -1)):
                whole |= plane.astype(U64) << U64(8 * k)
            out.append(whole.view(kind))
        else:
            out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, a))
    return out


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers sorted: the order, where each different one begins in it, and the dense rank of each."""
    order = np.argsort(key)
    held = key[order]
    begin = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
    own = np.empty(len(key), np.int64)
    own[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    return order, begin, own


def rows_of(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def sent(names: list[str], *columns) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n)) for c, n in zip(columns, names)], names)


# Chunks of text, and the regions that may repeat


def _chunks(batches):
    at = TaskContext.get().partitionId() << 20
    for batch in slices(batches, "text", CHUNK):
        raw, ends = text_bytes(batch.column(1))
        yield sent(["chunk", "blob"], [at], [packed(raw, ends, batch.column(0).to_numpy())])
        at += 1


def least_grams(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows inside one text that have one least hash of a gram: first position, hash, windows; block by block."""
    change = np.zeros(len(raw) + 1, np.int8)
    long = np.diff(ends) >= WINDOW
    np.add.at(change, ends[:-1][long], 1)
    np.add.at(change, ends[1:][long] - WINDOW + 1, -1)
    inside = np.cumsum(change, dtype=np.int8) > 0
    data = np.concatenate([raw, np.zeros(16, np.uint8)])
    for a in range(0, len(raw) - WINDOW + 1, BLOCK):
        n = min(BLOCK + WINDOW - GRAM, len(raw) - GRAM + 1 - a)
        eight = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))[a:]
        h = eight[:n] * M1
        for k in (8, GRAM - 8):
            h = (h ^ (h >> U64(29))) * M2 + eight[k : k + n] * M3
        h = (h ^ (h >> U64(32))) * M1
        h ^= h >> U64(29)
        at = np.flatnonzero(inside[a : a + BLOCK])
        if not len(at):
            continue
        least = sliding_min(h, WINDOW - GRAM + 1)[at]
        fresh = np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))
        begin = np.flatnonzero(fresh)
        yield at[begin] + a, least[begin], np.diff(np.append(begin, len(at)))


def anchors(raw: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs, cut at ``RUN`` windows: first position, number of windows, and the anchor as bucket and 32 bits within it."""
    runs = [*least_grams(raw, ends)]
    begin, least, n = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, t) for k, t in enumerate((np.int64, U64, np.int64)))
    if len(n) and n.max() > RUN:
        cuts = -(-n // RUN)
        skip = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * RUN
        begin, least, n = np.repeat(begin, cuts) + skip, np.repeat(least, cuts), np.minimum(np.repeat(n, cuts) - skip, RUN)
    k = mix(least)
    return begin, n, (((k >> U64(32)) % U64(buckets)) << U64(32) | k & U64(0xFFFFFFFF)).view(np.int64)


def cut_by(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of equal buckets."""
    begin = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1])[: len(sorted_buckets)])
    yield from zip(sorted_buckets[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(sorted_buckets)])


def _tell_anchors(buckets):
    def tell(batches):
        for chunk, blob in rows_of(batches):
            raw, ends, _ = unpacked(blob, "u1", "<i8", "<i8")
            begin, n, key = anchors(raw, ends, buckets)
            doc = np.searchsorted(ends, begin, side="right")
            order = np.argsort(key, kind="stable")
            key, doc, size = key[order], doc[order], n[order] + WINDOW - 1  # positions, and so documents, ascend within a key
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            last = np.append(first[1:], len(key)) - 1
            several, key, size = doc[first] != doc[last], key[first], np.add.reduceat(size, first) if len(first) else size
            rows = [(b, packed(key[x:y].astype(np.uint32), np.packbits(several[x:y]), size[x:y])) for b, x, y in cut_by(key >> 32)]
            if rows:
                yield sent(["chunk", "bucket", "blob"], [chunk] * len(rows), *zip(*rows))

    return tell


def _shared_anchors(hot):
    """Of each bucket, which anchors of each chunk are found in several documents: those of at most ``hot`` bytes of pieces, and the others."""

    def shared_anchors(batches):
        for bucket, rows in groupby(rows_of(batches), key=lambda r: r[1]):
            chunks, blobs = zip(*((r[0], r[2]) for r in rows))
            told = [unpacked(b, "<u4", "u1", "<i8") for b in blobs]
            size = np.array([len(t[0]) for t in told])
            order, begin, own = numbered(np.concatenate([t[0] for t in told]))
            several = np.diff(np.append(begin, len(order))) >= 2
            several[own[np.concatenate([np.unpackbits(t[1], count=n) for t, n in zip(told, size)]).astype(bool)]] = True
            large = np.add.reduceat(np.concatenate([t[2] for t in told])[order], begin) > hot
            cuts = np.cumsum(size)[:-1]
            found = zip(np.split((several & ~large)[own], cuts), np.split((several & large)[own], cuts))
            yield sent(["chunk", "bucket", "blob"], chunks, [bucket] * len(chunks), [packed(np.packbits(x), np.packbits(y)) for x, y in found])

    return shared_anchors


def runs_of(batches, buckets: int, large: int) -> Iterator[tuple]:
    """Of each chunk (chunk, raw, ends, ids, and by run: begin, windows, anchor, document): the runs with shared anchors, large or not."""
    for chunk, blob, replies in rows_of(batches):
        told = {r["bucket"]: unpacked(r["blob"], "u1", "u1")[large] for r in replies}
        if not any(t.any() for t in told.values()):
            continue
        raw, ends, ids = unpacked(blob, "u1", "<i8", "<i8")
        begin, n, key = anchors(raw, ends, buckets)
        order, first, own = numbered(key)
        known = key[order[first]]
        shared = np.zeros(len(known), bool)
        for b, x, y in cut_by(known >> 32):
            shared[x:y] = np.unpackbits(told[b], count=y - x)
        some = np.flatnonzero(shared[own])
        begin = begin[some]
        yield chunk, raw, ends, ids, begin, n[some], key[some], np.searchsorted(ends, begin, side="right") - 1


def _pieces(buckets):
    """The runs of anchors that one part holds, by bucket: key, id, chunk, document, place and size of each, and their bytes."""

    def told(held):
        key, id, chunk, doc, at, size = (np.concatenate([h[k] for h in held]) for k in range(6))
        raw, begin = np.concatenate([h[6] for h in held]), np.cumsum(size) - size
        order = np.argsort(key)
        rows = []
        for b, x, y in cut_by(key[order] >> 32):
            own = order[x:y]
            z = size[own]
            data = raw[np.arange(z.sum()) + np.repeat(begin[own] - (np.cumsum(z) - z), z)]
            rows.append((b, packed((key[own] & 0xFFFFFFFF).astype("<u4"), id[own], chunk[own], doc[own], at[own], z, data)))
        yield sent(["bucket", "blob"], *zip(*rows))

    def pieces(batches):
        held, most = [], 0
        for chunk, raw, ends, ids, begin, n, key, doc in runs_of(batches, buckets, 0):
            size = n + WINDOW - 1
            ends_at = np.cumsum(size)
            x = 0
            while x < len(size):  # a long text is dealt in slices
                y = max(x + 1, int(np.searchsorted(ends_at, (ends_at[x - 1] if x else 0) + DEALT, side="right")))
                z, d = size[x:y], doc[x:y]
                data = raw[np.arange(z.sum()) + np.repeat(begin[x:y] - (np.cumsum(z) - z), z)]
                held.append((key[x:y], ids[d], np.full(y - x, chunk), d, begin[x:y] - ends[d], z, data))
                most += len(data)
                if most >= DEALT:
                    yield from told(held)
                    held, most = [], 0
                x = y
        if held:
            yield from told(held)

    return pieces


def _regions(buckets):
    """The parts of texts whose windows have anchors of more pieces than one part holds, each with its least anchor."""

    def regions(batches):
        for chunk, raw, ends, ids, begin, n, key, doc in runs_of(batches, buckets, 1):
            # runs whose bytes touch are one region, up to half a part
            apart = np.append(True, (doc[1:] != doc[:-1]) | (begin[1:] > (begin + n)[:-1] + WINDOW - 1))[: len(begin)]
            head = np.maximum.accumulate(np.where(apart, np.arange(len(begin)), 0))
            step = (begin - begin[head] if len(begin) else begin) // (PART // 2)
            apart[1:] |= step[1:] != step[:-1]
            first = np.flatnonzero(apart)
            last = np.append(first[1:], len(begin)) - 1 if len(first) else first
            least = np.minimum.reduceat(key, first) if len(first) else key
            for x in range(0, len(first), 2000):
                f, z = first[x : x + 2000], last[x : x + 2000]
                d = doc[f]
                data = [raw[a:b].tobytes() for a, b in zip(begin[f].tolist(), (begin[z] + n[z] + WINDOW - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(least[x : x + 2000]), pa.array(ids[d]), pa.array([chunk] * len(f), pa.int64()), pa.array(d), pa.array(begin[f] - ends[d]), pa.array(data, pa.binary())], ["key", "id", "chunk", "doc", "at", "data"])

    return regions


# Parts: regions laid out one after another, each from a multiple of 3 on

PARTS = ("u1", "<i8", "<i8", "<i8", "<i8", "<i8", "<i8", "<i8")


class Part:
    """The bytes of regions, and of each its place, size, id, chunk, document in the chunk and place there; names by position."""

    def __init__(self, raw, start, size, id, chunk, doc, at, names):
        self.raw, self.start, self.size, self.id, self.chunk, self.doc, self.at, self.names = raw, start, size, id, chunk, doc, at, names
        self.dense = False  # whether names are the part's own ranks
        self.n = len(raw)
        padded = np.diff(np.append(start, self.n))
        self.region = np.repeat(np.arange(len(start)), padded)
        self.left = np.repeat(start + size, padded) - np.arange(self.n)
        self.data = np.concatenate([raw, np.zeros(64, np.uint8)])

    @classmethod
    def of(cls, rows: list[tuple]) -> Part:
        id, chunk, doc, at = (np.array([r[k] for r in rows], np.int64) for k in range(1, 5))
        size = np.array([len(r[5]) for r in rows], np.int64)
        return cls(np.frombuffer(b"".join(r[5].ljust(-(-len(r[5]) // 3) * 3, b"\0") for r in rows), np.uint8), np.cumsum(-(-size // 3) * 3) - (-(-size // 3) * 3), size, id, chunk, doc, at, np.zeros(0, np.int64))

    @classmethod
    def alone(cls, raw: np.ndarray, ends: np.ndarray, id: np.ndarray) -> Part:
        """A part of pieces, of which only the least ids matter."""
        size = np.diff(ends)
        wide = -(-size // 3) * 3
        start = np.cumsum(wide) - wide
        laid = np.zeros(wide.sum(), np.uint8)
        laid[np.arange(len(raw)) + np.repeat(start - ends[:-1], size)] = raw
        none = np.zeros(0, np.int64)
        return cls(laid, start, size, id, none, none, none, none)

    @classmethod
    def read(cls, blob: bytes) -> Part:
        return cls(*unpacked(blob, *PARTS))

    def told(self) -> bytes:
        return packed(self.raw, self.start, self.size, self.id, self.chunk, self.doc, self.at, self.names)

    def strings(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(np.ndarray((self.n + 1, size), np.uint8, self.data.data, strides=(1, 1))[at]).view(f"S{size}").ravel()

    def ranked(self) -> np.ndarray:
        """The part's own ranks of its names, which keep their order; at most as many as positions, so 21 bits hold one."""
        if self.dense:
            return self.names
        out, some = np.full(self.n + 64, -1), np.flatnonzero(self.names >= 0)
        out[some] = numbered(self.names[some])[2]
        return out

    def sample(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions whose next ``span`` bytes lie in their region, and a number for these bytes in their order."""
        ok = (np.arange(self.n) % 3 != 0) & (self.left >= span)
        if span == 9:
            at = np.flatnonzero(ok)
            head = np.ndarray(self.n + 1, ">u8", self.data.data, strides=(1,))[at].astype(U64)
            return at, numbered(head)[2] << 8 | self.data[at + 8]
        own = self.ranked()
        for k in NAMES[span]:
            ok &= own[k : k + self.n] >= 0
        at, key = np.flatnonzero(ok), 0
        for k in NAMES[span]:
            key = key << 21 | own[at + k]
        return at, key

    def columns(self, span: int, at: np.ndarray) -> list[np.ndarray]:
        if span == 9:
            return [np.ndarray(self.n + 1, ">u8", self.data.data, strides=(1,))[at].astype("<u8"), self.data[at + 8]]
        return [self.names[at + k] for k in NAMES[span]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of whole windows, and a number for their bytes that keeps their order within each class."""
        own, i = self.ranked(), np.arange(self.n)
        kind = i % 3
        a, b = i + (kind == 0), i + np.array([2, 1, 2])[kind]
        at = np.flatnonzero((self.left >= WINDOW) & (own[a] >= 0) & (own[b] >= 0))
        kind = kind[at]
        name, last = own[a[at]], self.data[at + 49]
        return at, kind << 40 | np.where(kind == 0, self.data[at].astype(np.int64) << 29 | name << 8, name << 16 | self.data[at + 48].astype(np.int64) << 8) | last

    def window_columns(self, at: np.ndarray) -> list[np.ndarray]:
        kind = at % 3
        bytes_ = [self.data[at + k] for k in (0, 1, 48, 49)]
        return [kind.astype(np.uint8), *bytes_, self.names[at + (kind == 0)], self.names[at + np.array([2, 1, 2])[kind]]]


    def sorted_alone(self) -> np.ndarray:
        """The least id of all that hold it, for each window in the order of places: the whole sort of a part that needs no other."""
        for span in NAMES:
            at, key = self.sample(span)
            names = np.full(self.n + 64, -1)
            names[at] = numbered(key)[2]
            self.names, self.dense = names, True
        at, key = self.windows()
        by, begin, own = numbered(key)
        least = np.minimum.reduceat(self.id[self.region[at]][by], begin)
        return merged([*self.window_columns(at[by[begin]]), least])[own]


def told_runs(chunk: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of windows that a document with a smaller id has, packed by chunk: document in it, place, number of windows."""
    order = np.argsort(chunk, kind="stable")
    rows = [(c, packed(*(v[order[x:y]] for v in (doc, at, n)))) for c, x, y in cut_by(chunk[order])]
    if rows:
        yield sent(["chunk", "blob"], *zip(*rows))


def repeats(raw: np.ndarray, size: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces with all others of their anchors: runs of windows that a smaller id has, as piece, first window, windows."""
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    own = held.indices.to_numpy()
    least = np.full(len(held.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, own, id)
    part = Part.alone(*text_bytes(held.dictionary), least)
    found, windows = part.sorted_alone(), part.size - WINDOW + 1
    at = np.cumsum(windows) - windows
    some = np.flatnonzero(id > np.minimum.reduceat(found, at)[own])
    n = windows[own[some]]
    begin = np.cumsum(n) - n
    smaller = found[np.arange(n.sum()) + np.repeat(at[own[some]] - begin, n)] < np.repeat(id[some], n)
    edge = np.diff(np.concatenate(([0], smaller.astype(np.int8), [0])))
    head = np.zeros(len(smaller) + 1, bool)
    head[begin] = True
    first = np.flatnonzero((edge > 0) | (head & np.append(smaller, False)))
    last = np.flatnonzero((edge < 0) | (head & np.append(False, smaller)))  # a run ends where the next piece begins
    piece = np.searchsorted(begin, first, side="right") - 1
    return some[piece], first - begin[piece], last - first


def _sort_alone(batches):
    for _, rows in groupby(rows_of(batches), key=lambda r: r[0]):
        key, id, chunk, doc, at, size, raw = (np.concatenate(c) for c in zip(*(unpacked(r[1], "<u4", "<i8", "<i8", "<i8", "<i8", "<i8", "u1") for r in rows)))
        order = np.argsort(key)
        key, begin, ends = key[order], np.cumsum(size) - size, np.cumsum(size[order])
        heads = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        runs, x = [], 0
        while x < len(key):
            # whole anchors of about PART bytes
            y = int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PART, side="right"))
            y = int(heads[np.searchsorted(heads, max(y, x + 1))])
            own = order[x:y]
            z = size[own]
            piece, skip, n = repeats(raw[np.arange(z.sum()) + np.repeat(begin[own] - (np.cumsum(z) - z), z)], z, id[own])
            own = own[piece]
            runs.append((chunk[own], doc[own], at[own] + skip, n))
            x = y
        yield from told_runs(*(np.concatenate(c) for c in zip(*runs)))


def _lay_out(batches):
    held, size, at = [], 0, TaskContext.get().partitionId() << 20
    rng = np.random.default_rng(at)

    def part():
        p = Part.of(held)
        whole = np.flatnonzero(p.left >= WINDOW)
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([p.n]), pa.array([p.strings(rng.choice(whole, 64), ROUTE).tolist()], pa.list_(pa.binary())), pa.array([p.told()], pa.binary())], ["chunk", "n", "sample", "blob"])

    for row in rows_of(batches):
        if held and size + len(row[5]) > PART:
            yield part()
            held, size, at = [], 0, at + 1
        held.append(row)
        size += len(row[5])
    if held:
        yield part()


# Exchanges: a part's different strings go to the ranges they fall in, and what a range finds comes back in the same order


class Strings:
    """The different strings of a part, by range: ``first`` positions, ``own`` number of each position of ``at``, ``order`` and ``bucket`` by range."""

    def __init__(self, part: Part, span: int, splits: np.ndarray):
        self.at, key = part.sample(span) if span < WINDOW else part.windows()
        self.by, self.begin, self.own = numbered(key)
        first, width = self.at[self.by[self.begin]], min(span, ROUTE)
        # a class's different strings are in order already, so it is the splits that are looked up among them
        kind = np.searchsorted(key[self.by[self.begin]] >> 40, np.arange(4)) if span == WINDOW else np.array([0, len(first)])
        text = part.data.data
        bounds = [[bisect_left(range(x, y), bytes(s[:width]).ljust(width, b"\0"), key=lambda k: bytes(text[first[k] : first[k] + width])) + x for s in splits.tolist()] for x, y in zip(kind[:-1].tolist(), kind[1:].tolist())]
        route = np.concatenate([np.repeat(np.arange(len(splits) + 1), np.diff([x, *b, y])) for x, y, b in zip(kind[:-1].tolist(), kind[1:].tolist(), bounds)])
        self.order = np.argsort(route.astype(np.uint16), kind="stable")
        self.bucket = route[self.order]
        self.first = first[self.order]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value among the positions of each string, by range."""
        return (np.minimum.reduceat(values[self.by], self.begin) if len(self.by) else values)[self.order]

    def spread(self, replies, kind: str) -> np.ndarray:
        """What came back, for each position; ``replies`` has the blob of each range."""
        told = {r["bucket"]: r["blob"] for r in replies or ()}
        out = np.zeros(len(self.order), np.int64)
        for b, x, y in cut_by(self.bucket):
            (values,) = unpacked(told[b], kind)
            out[self.order[x:y]] = values if kind == "<i8" else values.astype(np.int64) | b << 32
        return out[self.own]


def asked(part: Part, span: int, splits: np.ndarray) -> list[tuple[int, bytes]]:
    strings = Strings(part, span, splits)
    columns = part.columns(span, strings.first) if span < WINDOW else [*part.window_columns(strings.first), strings.least(part.id[part.region[strings.at]])]
    return [(b, packed(*(c[x:y] for c in columns))) for b, x, y in cut_by(strings.bucket)]


def _ask(span, splits):
    def ask(batches):
        for chunk, blob in rows_of(batches):
            if rows := asked(Part.read(blob), span, splits):
                yield sent(["chunk", "bucket", "blob"], [chunk] * len(rows), *zip(*rows))

    return ask


def fresh(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, compared column by column."""
    order = np.lexsort(columns[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh([c[order] for c in columns])) - 1
    return out


def merged(columns: list[np.ndarray]) -> np.ndarray:
    """For each window the least id of all windows of a range that are equal to it."""
    kind, who = columns[0], columns[-1]
    b0, b1, b48, b49, name, more = (c.astype(U64) for c in columns[1:-1])  # names have at most 48 bits
    shift = lambda x, k: x << U64(k)
    rest, sample = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
    whole, whole_rest = shift(name, 16) | shift(b48, 8) | b49, shift(b0, 56) | shift(name, 8) | b49
    sample = sample[np.argsort(whole[sample])]
    rest = rest[np.argsort(whole_rest[rest])]
    same = np.zeros(len(kind), bool)  # as the one before it in the merged order
    same[sample] = ~fresh([whole[sample]])
    same_rest = ~fresh([whole_rest[rest]])
    place, place_rest = np.arange(len(sample)), np.arange(len(rest))
    equal = np.zeros(len(rest), bool)
    two = shift(b0, 56) | shift(b1, 48) | more
    for k, mine, its in ((1, whole_rest, shift(b0, 56) | shift(more, 8) | b49), (2, two, two)):
        at = np.flatnonzero(kind[sample] == k)
        a, b = mine[rest], its[sample[at]]  # both ascend
        upto = np.searchsorted(b, a, side="right")
        place_rest += upto
        equal |= (upto > 0) & (b[np.maximum(upto, 1) - 1] == a if len(b) else False)
        place[at] += np.searchsorted(a, b)
    order = np.empty(len(kind), np.int64)
    order[place], order[place_rest] = sample, rest
    # equal windows: those of the sample come first, so one of the rest equals what stands before it if either test says so
    same[rest] = same_rest | equal
    begins = ~same[order]
    # a window of the sample after the rest of another string: same[] compared it with the sample before it, which is nearer in order
    begin = np.flatnonzero(begins)
    out = np.empty(len(kind), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(who[order], begin), np.diff(np.append(begin, len(order))))
    return out


COLUMNS = {9: ("<u8", "u1"), 27: ("<i8",) * 3, 48: ("<i8",) * 2, WINDOW: ("u1",) * 5 + ("<i8",) * 3}


def _answer(span: int, find: Callable):
    def answer(batches):
        for bucket, rows in groupby(rows_of(batches), key=lambda r: r[1]):
            chunks, blobs = zip(*((r[0], r[2]) for r in rows))
            told = [unpacked(b, *COLUMNS[span]) for b in blobs]
            found = find([np.concatenate(c) for c in zip(*told)])
            parts = np.split(found, np.cumsum([len(t[0]) for t in told])[:-1])
            yield sent(["chunk", "bucket", "blob"], chunks, [bucket] * len(chunks), [packed(p if span == WINDOW else p.astype("<u4")) for p in parts])

    return answer


def _take_names(span, splits):
    def take(batches):
        for chunk, blob, replies in rows_of(batches):
            part = Part.read(blob)
            strings = Strings(part, span, splits)
            names = np.full(part.n + 64, -1)
            names[strings.at] = strings.spread(replies, "<u4")
            part.names = names
            yield sent(["chunk", "blob"], [chunk], [part.told()])

    return take


def _take_matches(splits):
    def take(batches):
        for _, blob, replies in rows_of(batches):
            part = Part.read(blob)
            strings = Strings(part, WINDOW, splits)
            at = strings.at[strings.spread(replies, "<i8") < part.id[part.region[strings.at]]]
            region = part.region[at]
            begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (region[1:] != region[:-1]))[: len(at)])
            n, r = np.diff(np.append(begin, len(at))), region[begin]
            yield from told_runs(part.chunk[r], part.doc[r], part.at[r] + at[begin] - part.start[r], n)

    return take


def _keep(with_bytes):
    def keep(batches):
        for _, blob, runs in rows_of(batches):
            raw, ends, ids = unpacked(blob, "u1", "<i8", "<i8")
            doc, at, n = (np.concatenate(c) for c in zip(*(unpacked(r, "<i8", "<i8", "<i8") for r in runs)))
            at = at + ends[doc]
            change = np.zeros(len(raw) + 1, np.int32)
            np.add.at(change, at, 1)
            np.add.at(change, at + n + WINDOW - 1, -1)
            gone = np.cumsum(change) > 0  # runs end within their texts
            rows = []
            for d in np.unique(doc).tolist():
                text, own = raw[ends[d] : ends[d + 1]], gone[ends[d] : ends[d + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                kept = text[~own].tobytes()
                spans = [{"at": a, "n": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
                rows.append((int(ids[d]), sha256(text.tobytes()).digest(), int(own.sum()), spans, sha256(kept).digest(), kept if with_bytes else None))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "mark", "n_removed", "spans", "kept_mark", "kept"])

    return keep


def exchange(asks: DataFrame, answer: Callable, save: Callable) -> DataFrame:
    """What each range, or bucket, says to the rows sent to it: (chunk, bucket, blob). It is written, so that what was sent can go."""
    dealt = asks.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return save(dealt.mapInArrow(answer, "chunk long, bucket int, blob binary"), "answers")


def by_chunk(answers: DataFrame) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("replies"))


class Sort:
    """The steps of the sort over one input; see the module's docstring."""

    def __init__(self, docs: DataFrame, id: str, text: str):
        self.docs = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
        self.docs = self.docs.withColumn("mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        self.scratch = Scratch(docs.sparkSession, "suffixes")

    @contextmanager
    def freeing(self):
        """Shuffle files go when the query that wrote them ends, as each step's result is a table."""
        conf = self.docs.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)

    def found(self, first: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
        """(chunks of the leading texts, runs of windows that stand in a document with a smaller id)."""
        save, drop = self.scratch.save, self.scratch.drop
        leading = self.docs.where(F.octet_length("text") >= WINDOW).join(first.select("mark", F.col("first").alias("id")), ["mark", "id"], "left_semi")
        chunks = save(leading.select("id", "text").mapInArrow(_chunks, "chunk long, blob binary"), "chunks")
        buckets = min(max(1, total >> 24), MOST_RANGES)
        answers = exchange(chunks.mapInArrow(_tell_anchors(buckets), "chunk long, bucket int, blob binary"), _shared_anchors(HOT), save)
        # a chunk without a window has no replies, and no pieces
        asked = chunks.join(by_chunk(answers), "chunk")
        dealt = asked.mapInArrow(_pieces(buckets), "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
        alone = save(dealt.mapInArrow(_sort_alone, "chunk long, blob binary"), "alone")
        regions = save(asked.mapInArrow(_regions(buckets), "key long, id long, chunk long, doc long, at long, data binary"), "regions")
        drop(answers)
        return chunks, alone if regions.isEmpty() else alone.unionByName(self.matches(regions))

    def matches(self, regions: DataFrame) -> DataFrame:
        """(chunk, blob): runs of windows of regions that stand in a document with a smaller id."""
        save, drop = self.scratch.save, self.scratch.drop
        dealt = regions.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "at")
        parts = save(dealt.mapInArrow(_lay_out, "chunk long, n long, sample array<binary>, blob binary"), "parts")
        drop(regions)
        total, count = parts.agg(F.sum("n"), F.count("*")).first()
        # at most about 2^16 strings of 24 bytes, from a bounded number of parts, whatever the input
        share = max(1, count >> 10)
        sample = np.sort(np.array([bytes(s) for r in parts.where(F.pmod(F.xxhash64("chunk"), F.lit(share)) == 0).select("sample").toLocalIterator() for s in r["sample"]], f"S{ROUTE}"))
        ranges = min(max(1, (total or 0) >> 19), MOST_RANGES, max(1, len(sample)))
        splits = sample[[len(sample) * k // ranges for k in range(1, ranges)]]
        parts = parts.select("chunk", "blob")
        schema = "chunk long, bucket int, blob binary"
        path = parts
        for span in NAMES:
            answers = exchange(parts.mapInArrow(_ask(span, splits), schema), _answer(span, ranks), save)
            parts = save(parts.join(by_chunk(answers), "chunk", "left").mapInArrow(_take_names(span, splits), "chunk long, blob binary"), f"names{span}")
            drop(answers)
            if span > 9:
                drop(path)
            path = parts
        answers = exchange(parts.mapInArrow(_ask(WINDOW, splits), schema), _answer(WINDOW, merged), save)
        found = save(parts.join(by_chunk(answers), "chunk").mapInArrow(_take_matches(splits), "chunk long, blob binary"), "matches")
        drop(parts, answers)
        return found

    def run(self, with_bytes: bool) -> tuple[DataFrame, DataFrame]:
        """(id, n_bytes, mark, copy) of every row, and the changed rows (id, mark, n_removed, spans, kept_mark, kept)."""
        with self.freeing():
            return self.steps(with_bytes)

    def steps(self, with_bytes: bool) -> tuple[DataFrame, DataFrame]:
        facts = self.scratch.save(self.docs.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "mark"), "facts")
        first = facts.where("id is not null").groupBy("mark").agg(F.min("id").alias("first"), F.max("n_bytes").alias("size"))
        total = first.agg(F.sum("size")).first()[0] or 0
        rows = facts.join(first.drop("size"), "mark", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= WINDOW))
        chunks, found = self.found(first, total)
        runs = found.groupBy("chunk").agg(F.collect_list("blob").alias("runs"))
        changed = chunks.join(runs, "chunk").mapInArrow(_keep(with_bytes), "id long, mark binary, n_removed long, spans array<struct<at:long,n:long>>, kept_mark binary, kept binary")
        return rows, self.scratch.save(changed.dropDuplicates(["id", "mark"]), "changed")


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for every row of ``docs``; ``spans`` are the removed (at, n) in order.

    ``with_bytes`` adds ``kept``, the bytes that are left, which need not be UTF-8; it is null where they are the whole text.
    """
    rows, changed = Sort(docs, id, text).run(with_bytes)
    joined = rows.join(changed, ["id", "mark"], "left")
    none = F.array().cast("array<struct<at:long,n:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_bytes").alias("n")))
    removed = F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    spans = F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none))
    mark = F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept_mark", "mark"))
    kept = [F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_bytes else []
    return joined.select(F.col("id").alias(id), "n_bytes", removed.alias("n_removed"), spans.alias("spans"), F.lower(F.hex(mark)).alias("kept_sha256"), *kept)
