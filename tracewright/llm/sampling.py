"""SentencePiece segmentations: sampled without replacement from the lattice, with inclusion scores, and decoded.

The lattice of a text has an edge for every vocabulary piece found in it (bytes where a character has no piece).
An edge weighs -alpha * log(1 + rank), and a segmentation's probability is proportional to the product of its
edges. The k segmentations with the largest Gumbel-perturbed log-probabilities are a sample without replacement.
They are found best first, without listing segmentations: in terms of exp(-Gumbel) a segmentation arrives at an
exponential time with its probability as rate, and the earliest arrival below a lattice node that is known to be t
goes to one child in proportion to the children's mass, while the rest arrive at t plus an exponential time of
their own mass. So a path leaves, at each of its steps, one arrival for the edges it did not take. These go into a
priority queue; the next segmentation is the earliest of the queue, walked on from its branch, and what its branch
still leaves goes back into the queue. Only the k earliest of a path can ever be popped, so only they are kept. The
inclusion score of a segmentation is the probability that it arrives before the first one left out. All random
numbers are hashes of the row's key, the sample's number and the place in the text, so a row's sample does not depend
on partitioning or on lost tasks.

No piece crosses from a letter to a following space, so distinct stretches (spaces and the word after them) get
their part of the lattice once per slice of texts, all in numpy.

Defined results: a null or empty text has one empty segmentation of probability 1; a text with fewer segmentations
than asked gives those it has; U+2581 in a text reads as a space; rows with a null key share the key 0.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.words import M3, U64, mix, slices

SPACE = 0x20
LONGEST = 16


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces by the hash of their characters, with the bytes each id stands for."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes, self.byte_id, words = [b""] * n, np.full(256, -1), {}
        for i in range(n):
            if model.is_byte(i):
                self.bytes[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ")
                self.bytes[i] = piece.encode()
                words[piece] = i
        self.weight = -alpha * np.log1p(np.maximum(0, -np.array([model.get_score(i) for i in range(n)])))
        self.fallback = float(self.weight.min())
        self.longest = max(map(len, words), default=1)
        entries: dict[str, int] = {}
        for piece, i in words.items():
            for k in range(1, len(piece)):
                entries.setdefault(piece[:k], -1)
            entries[piece] = i
        self.bits = 18
        self.keys, self.ids = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -2, np.int32)
        self.probes = 1
        for text, i in entries.items():
            h = np.zeros(1, U64)
            for c in text:
                h = self.step(h, np.array([ord(c)]))
            at, tries = int(h[0] >> U64(64 - self.bits)), 1
            while self.ids[at] != -2:
                at, tries = (at + 1) % (1 << self.bits), tries + 1
            self.keys[at], self.ids[at] = h[0], i
            self.probes = max(self.probes, tries)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes])
        self.at = np.cumsum(self.size) - self.size

    @staticmethod
    def step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        return mix(h * M3 + char.astype(U64) + U64(1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with this hash; -1 where it only begins one, -2 where there is none."""
        out = np.full(len(h), -2, np.int32)
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(h))
        for _ in range(self.probes):
            hit = self.keys[at[open_]] == h[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (self.ids[at[open_]] != -2)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % (1 << self.bits)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation, without the space put before it."""
        size = self.size[ids]
        index = np.arange(size.sum()) + np.repeat(self.at[ids] - np.cumsum(size) + size, size)
        return self.flat[index].tobytes()[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


SLICE = 1 << 20  # bytes of text whose lattices are held at once


class Lattices:
    """The lattices of a slice of texts; nodes are positions in the distinct stretches, laid end to end.

    ``inner`` texts continue a text and get no space in front.
    """

    def __init__(self, voc: Vocabulary, texts: list[str], inner: bool = False):
        self.voc = voc
        lead = "" if inner else " "
        chars = np.frombuffer("".join(lead + t if t else "" for t in texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) + len(lead) if t else 0 for t in texts])
        ends = np.cumsum(sizes)
        head = np.zeros(len(chars), bool)
        head[1:] = (chars[1:] == SPACE) & (chars[:-1] != SPACE)
        head[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(head)
        self.first = np.searchsorted(begin, np.concatenate(([0], ends)))
        length = np.diff(np.append(begin, len(chars)))
        place = np.arange(len(chars)) - np.repeat(begin, length)
        if len(begin):
            marks = np.add.reduceat(mix((place.astype(U64) << U64(21) | chars) + M3), begin)
            _, index, self.kind = np.unique(marks, return_index=True, return_inverse=True)
        else:
            index, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64)
        del place, head
        self._build(chars, begin[index], length[index])

    def _build(self, chars: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Edges lie in order of what is left of the stretch after their start, then by start."""
        voc, small = self.voc, np.int32
        self.base = np.concatenate(([0], np.cumsum(length + 1)))[:-1] if len(length) else np.zeros(0, np.int64)
        nodes = int((length + 1).sum())
        at = np.arange(nodes, dtype=small)
        left = np.repeat((self.base + length).astype(small), length + 1) - at  # characters to the stretch's end
        self.ended = left == 0
        char = np.zeros(nodes, np.uint32)
        inside = np.flatnonzero(~self.ended)
        char[inside] = chars[inside - np.repeat((self.base - begin), length + 1)[inside]]
        at, edges, lone = inside.astype(small), [], []
        h, seen, room = np.zeros(len(at), U64), np.zeros(nodes, small), left[at]
        for size in range(1, voc.longest + 1):
            h = voc.step(h, char[at + (size - 1)])
            id = voc.find(h)
            hit = np.flatnonzero(id >= 0)
            own = at[hit]
            edges.append((own, np.full(len(hit), size, np.int8), id[hit], seen[own]))
            seen[own] += 1
            if size == 1:
                lone = at[id < 0]
            go = np.flatnonzero((id >= -1) & (room > size))
            at, h, room = at[go], h[go], room[go]
            if not len(at):
                break
        plain = char[lone] < 128  # one byte
        edges.append((lone, np.ones(len(lone), np.int8), np.where(plain, voc.byte_id[np.where(plain, char[lone], 0)], -1 - char[lone].astype(np.int64)).astype(small), seen[lone]))
        seen[lone] += 1
        near = left if len(left) and left.max() > 65535 else left.astype(np.uint16)
        by_left = np.argsort(near, kind="stable")
        self.count, self.begin = seen, np.zeros(nodes, np.int64)
        self.begin[by_left] = np.cumsum(seen[by_left]) - seen[by_left]
        total = int(seen.sum())
        self.start, self.id, self.to = (np.empty(total, small) for _ in range(3))
        for own, size, id, rank in edges:
            to = self.begin[own] + rank
            self.start[to], self.id[to], self.to[to] = own, id, own + size
        del edges, char
        # mass from each node to the stretch's end, in logs, from the end on
        beta = np.zeros(nodes)
        weight = voc.weight[self.id]
        weight[self.id < 0] = voc.fallback
        heads = self.begin[by_left[seen[by_left] > 0]]
        bounds = np.append(heads, total)
        level = left[self.start[heads]]
        cuts = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            e0, e1 = bounds[a], bounds[b]
            value, own = weight[e0:e1] + beta[self.to[e0:e1]], heads[a:b] - e0
            top = np.maximum.reduceat(value, own)
            sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(bounds[a : b + 1]))), own)
            beta[self.start[heads[a:b]]] = top + np.log(sums)
        weight += beta[self.to]
        weight -= beta[self.start]
        self.logp = weight
        self.p = np.exp(weight)
        sums = np.cumsum(self.p)
        self.cum = (sums - np.repeat(sums[heads] - self.p[heads], np.diff(bounds))) if len(heads) else sums
        self.cum[bounds[1:] - 1] = 2.0

    def walk(self, stretch: np.ndarray, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled paths from ``node`` to the end of each stretch: (row of the arguments, edge, hash), in order."""
        row, out = np.flatnonzero(~self.ended[node]).astype(np.int32), []
        at = node[row]
        h = seed[row] + U64(1) - self.base[self.kind[stretch[row]]].astype(U64)  # plus the place in the stretch
        while len(row):
            now = mix(h + at.astype(U64))
            edge = self.begin[at]
            many = np.flatnonzero(self.count[at] > 1)
            u = _uniform(now[many])
            while len(many):
                further = u > self.cum[edge[many]]
                many, u = many[further], u[further]
                edge[many] += 1
            out.append((row, edge, now))
            at = self.to[edge].astype(np.int64)
            go = np.flatnonzero(~self.ended[at])
            row, at, h = row[go], at[go], h[go]
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, U64)
        row, edge, now = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(row, kind="stable")
        return row[order], edge[order], now[order]


class Text:
    """What the search keeps of one text: its samples so far, and the queue of branches that may come next."""

    def __init__(self, key: int):
        self.seed = mix(np.array([key], np.int64).view(U64) + M3)[0]
        self.last = float(np.log(-np.log(_uniform(mix(np.array([self.seed ^ M3])))))[0])  # log arrival of the first
        self.samples: list[list] = []  # [arrays of ids, log probability]
        self.queue: list[tuple] = []  # (log arrival, number, sample, step, log p before, place, node in stretch, edges taken, log p of the branch)
        self.pushed = 0

    def push(self, arrival, *branch):
        heapq.heappush(self.queue, (float(arrival), self.pushed, *branch))
        self.pushed += 1

    def next_arrival(self) -> float:
        return self.queue[0][0] if self.queue else np.inf

    def ids(self, sample: int) -> np.ndarray:
        held = self.samples[sample][0]
        if len(held) > 1:
            self.samples[sample][0] = held = [np.concatenate(held)]
        return held[0] if held else np.zeros(0, np.int32)


def _descend(lat: Lattices, texts: list[Text], k: int, number: int, docs, stretch, node, shift) -> None:
    """Walk on the newest sample of ``docs`` over the given stretches, which are ``shift`` stretches into their texts."""
    doc = np.searchsorted(lat.first, stretch, side="right") - 1
    seeds = np.array([t.seed for t in texts], U64)
    seed = mix(seeds[doc] + np.array([number], U64) * M3) + mix((stretch - lat.first[doc] + shift).astype(U64)) * M3
    row, edge, h = lat.walk(stretch, node, seed)
    ends = np.searchsorted(doc, docs, side="right")
    ends, begins = np.searchsorted(row, ends), np.searchsorted(row, np.searchsorted(doc, docs))
    sums = np.concatenate(([0.0], np.cumsum(lat.logp[edge])))
    many = np.flatnonzero(lat.count[lat.start[edge]] > 1)
    with np.errstate(divide="ignore"):  # log of the time that the rest of the mass at each step takes, were its prefix sure
        spread = np.log(-np.log(_uniform(mix(h[many] ^ M3))) / (1.0 - np.minimum(lat.p[edge[many]], 1.0)))
    spread -= sums[many]
    lows, highs = np.searchsorted(many, begins), np.searchsorted(many, ends)
    ids = lat.id[edge]
    for d, a, b, lo, hi in zip(docs.tolist(), begins.tolist(), ends.tolist(), lows.tolist(), highs.tolist()):
        text = texts[d]
        sample, total = len(text.samples) - 1, text.samples[-1][1]
        step0 = sum(map(len, text.samples[-1][0]))
        text.samples[-1][0].append(ids[a:b])
        text.samples[-1][1] = total + float(sums[b] - sums[a])
        own = spread[lo:hi]
        best = np.argpartition(own, k - 1)[:k] if len(own) > k else np.arange(len(own))
        for i in best.tolist():
            at = int(many[lo + i])
            before = total + float(sums[at] - sums[a])
            place = int(stretch[row[at]])
            begin = int(lat.base[lat.kind[place]])
            wait = float(own[i]) + float(sums[a]) - total  # spread over the mass of the prefix
            if np.isfinite(wait):
                start = int(lat.start[edge[at]])
                text.push(np.logaddexp(text.last, wait), sample, step0 + at - a, before, place - int(lat.first[d]) + shift, start - begin, (int(edge[at]) - int(lat.begin[start]),))


def _branch(lat: Lattices, text: Text, d: int, number: int, shift: int) -> tuple[int, int]:
    """Take the earliest branch of a text's queue; the stretch of ``lat`` and the node where its new sample walks on."""
    arrival, _, sample, step, before, place, inner, taken = heapq.heappop(text.queue)
    stretch = int(lat.first[d]) + place - shift
    node = int(lat.base[lat.kind[stretch]]) + inner
    begin = int(lat.begin[node])
    free = [r for r in range(int(lat.count[node])) if r not in taken]
    mass = lat.p[begin + np.array(free)]
    h = mix(np.array([text.seed + U64(number)], U64) ^ mix(np.array([place], U64)) ^ U64(inner))
    pick = free[min(int(np.searchsorted(np.cumsum(mass), _uniform(h)[0] * mass.sum())), len(free) - 1)]
    rest = float(mass.sum() - lat.p[begin + pick])
    text.last = arrival
    if len(free) > 1 and rest > 0:
        text.push(np.logaddexp(arrival, np.log(-np.log(_uniform(mix(h))[0])) - before - np.log(rest)), sample, step, before, place, inner, (*taken, pick))
    text.samples.append([[text.ids(sample)[:step], lat.id[begin + pick : begin + pick + 1]], before + float(lat.logp[begin + pick])])
    return stretch, int(lat.to[begin + pick])


def _search(voc: Vocabulary, strings: list[str], texts: list[Text], k: int) -> None:
    """The samples of texts that share one set of lattices."""
    lat = Lattices(voc, strings)
    for text in texts:
        text.samples.append([[], 0.0])
    _descend(lat, texts, k, 0, np.arange(len(texts)), np.arange(int(lat.first[-1])), lat.base[lat.kind], 0)
    for number in range(1, k):
        docs, stretches, nodes = [], [], []
        for d, text in enumerate(texts):
            if text.queue:
                s, node = _branch(lat, text, d, number, 0)
                docs.append(d)
                stretches.append(np.arange(s, lat.first[d + 1]))
                nodes.append(np.concatenate(([node], lat.base[lat.kind[s + 1 : lat.first[d + 1]]])))
        if docs:
            _descend(lat, texts, k, number, np.array(docs), np.concatenate(stretches), np.concatenate(nodes), 0)


def _search_long(voc: Vocabulary, string: str, text: Text, k: int, size: int) -> None:
    """The samples of one text, part by part; parts are cut before a space that follows another character, where there is one."""
    cuts, at = [0], 0
    while len(string) - at > size:
        cut = string.rfind(" ", at + 1, at + size)
        while cut > at and string[cut - 1] == " ":
            cut -= 1
        at = cut if cut > at else at + size
        cuts.append(at)
    cuts.append(len(string))
    parts, shift, shifts = list(zip(cuts, cuts[1:])), 0, []
    one = np.zeros(1, np.int64)
    text.samples.append([[], 0.0])
    for i, (a, b) in enumerate(parts):
        lat = Lattices(voc, [string[a:b]], inner=i > 0)
        shifts.append(shift)
        _descend(lat, [text], k, 0, one, np.arange(len(lat.kind)), lat.base[lat.kind], shift)
        shift += len(lat.kind)
    for number in range(1, k):
        if not text.queue:
            break
        home = int(np.searchsorted(shifts, text.queue[0][5], side="right")) - 1
        for i, (a, b) in list(enumerate(parts))[home:]:
            lat = Lattices(voc, [string[a:b]], inner=i > 0)
            stretch, node = np.arange(len(lat.kind)), lat.base[lat.kind]
            if i == home:
                s, first = _branch(lat, text, 0, number, shifts[i])
                stretch, node = stretch[s:], np.concatenate(([first], node[s + 1 :]))
            _descend(lat, [text], k, number, one, stretch, node, shifts[i])
    # the queue keeps the k earliest of each part, at least as many as of the whole path


def sample_texts(voc: Vocabulary, texts: list[str], keys: np.ndarray, k: int, size: int = SLICE) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct (ids, log probability, log inclusion score), in order of arrival."""
    strings = [t.replace("▁", " ") for t in texts]
    held = [Text(int(key)) for key in keys]
    long = [i for i, t in enumerate(strings) if len(t) > size]
    short = [i for i, t in enumerate(strings) if len(t) <= size]
    if short:
        _search(voc, [strings[i] for i in short], [held[i] for i in short], k)
    for i in long:
        _search_long(voc, strings[i], held[i], k, size)
    out = []
    for text in held:
        limit, rows = text.next_arrival(), []
        for n, (_, total) in enumerate(text.samples):
            x = total + limit  # log of rate * time
            rows.append((_spelled(voc, text.ids(n)), total, 0.0 if x > 3 * np.log(10) else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)))
        out.append(rows)
        text.samples.clear()
    return out


def _spelled(voc: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Characters that have no piece, given as -1 - code point, as the pieces of their bytes."""
    if not len(ids) or ids.min() >= 0:
        return ids
    parts = [[i] if i >= 0 else voc.byte_id[list(chr(-1 - i).encode())].tolist() for i in ids.tolist()]
    return np.array([x for p in parts for x in p], np.int32)


def sample_segmentations(rows: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = 2, alpha: float = 1.0, with_ids: bool = True) -> DataFrame:
    """(key, sample, n_pieces, log_prob, log_inclusion, ids_crc32, round_trip[, ids]), up to k rows for each row.

    ``model`` is the path of a SentencePiece model that every worker can open; ``round_trip`` tells whether the
    decoded ids are the text again.
    """
    fields = [("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("log_inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())]

    def sample(batches):
        voc = vocabulary(model, alpha)
        for batch in slices(batches, "text", SLICE):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = sample_texts(voc, texts, batch.column(1).to_numpy(), k)
            at, out, ids = [], [], []
            for i, (text, samples) in enumerate(zip(texts, found)):
                want = text.replace("▁", " ").encode()
                for n, (own, logp, inclusion) in enumerate(samples):
                    at.append(i)
                    out.append((n, len(own), logp, inclusion, zlib.crc32(own.astype("<u4").tobytes()), voc.decode(own) == want))
                    if with_ids:
                        ids.append(own.astype(np.int32, copy=False))
            columns = [batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, (_, t) in zip(zip(*out), fields))]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays(columns, ["key", *(n for n, _ in fields), *(["ids"] if with_ids else [])])

    kind = rows.schema[key].dataType.simpleString()
    shape = f"key {kind}, sample int, n_pieces long, log_prob double, log_inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    seeded = rows.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))).alias("seed"), F.col(text).alias("text"))
    return seeded.mapInArrow(sample, shape).withColumnRenamed("key", key)


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of their token ids in the column ``into``; a null list decodes to null."""

    @F.pandas_udf("string")
    def text_of(column):
        voc = vocabulary(model, 1.0)
        return column.map(lambda x: None if x is None else voc.decode(np.asarray(x, np.int64)).decode(errors="replace") if len(x) else "")

    return rows.withColumn(into, text_of(F.col(ids)))
