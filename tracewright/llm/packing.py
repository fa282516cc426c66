"""Best-fit packing of token sequences by a tree of residual rounds.

Every text is tokenised whole, word by word (a word's tokens do not depend on its neighbours in these
tokenizers, so each distinct word is encoded once for a worker), ended by the id ``end``, and cut into pieces of
``capacity`` tokens; only its last piece may be shorter. The pieces' lengths are dealt to groups of about ``group`` pieces,
however many tasks read the texts, as a few pieces by themselves fill bins badly, and later rounds move whole bins. A task packs its
group best-fit, longest first. The underfull bins are items of the next round: groups of ``fan_in`` neighbouring groups
are packed best-fit again, until one group is left. Only (bin, fill) pairs travel between rounds; a round's moves
are joined to the pieces at the end.

What goes on is bounded whatever the texts are. After best-fit no two bins of a group fit together, so a group
has at most one bin that is half full or less, and every merge of a later round needs one of those: a round of
``fan_in`` groups makes at most ``fan_in`` merges. So of each fill a group sends on no more bins than the rounds
ahead could use, ``fan_in`` for each of them; the others, which no round could complete, are emitted as they are.
A merge group therefore has at most ``fan_in * capacity * fan_in * rounds`` rows, and packs as well as if all bins
had gone on.

Defined results: a null text is empty and makes one piece that holds the end id alone; ids may be null or
repeated (each row is packed for itself); an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache
from itertools import chain, count, islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.words import slices, text_bytes
from tracewright.session import Scratch

MOST_WORDS = 400_000  # distinct words a worker remembers
CALL = 100  # words that a call encodes together
GROUP = 100_000  # pieces packed together in the first round, numbers only


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


LETTER, DIGIT, OTHER, BLANK = range(4)


def _kinds() -> np.ndarray:
    """The kind of each character below U+0250, as the tokenizer's word pattern tells them apart; -1 for those of mixed behaviour."""
    known = [(LETTER, "L"), (DIGIT, "N")]
    out = np.array([next((k for k, c in known if unicodedata.category(chr(i))[0] == c), OTHER) for i in range(0x250)], np.int8)
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = BLANK
    out[[ord("'"), ord("<"), 0x130]] = -1  # contractions, special tokens, a letter that becomes two characters in lower case
    return out


KINDS = _kinds()


class WordTokens:
    """Token ids of words parted by ASCII white space, each distinct word encoded once.

    New words are encoded many to a call where that cannot change their tokens: in words of plain Latin characters
    the number of stretches that the tokenizer takes one by one (runs of letters, single digits, runs of others) is
    known, and each stretch ends in a token marked as an end. Where a call's ends do not add up its words are encoded
    one by one, as are all other words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.codes, self.at, self.flat = _Codes(), np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32)
        self.hits = np.zeros(0, np.int64)

    def forget(self):
        """Keep the words met most often, at most half of what a worker remembers, as if each had been met once."""
        least = 2
        while (kept := np.flatnonzero(self.hits >= least)).size > MOST_WORDS // 2:
            least *= 2
        words, at, flat = list(self.codes), self.at, self.flat
        sizes = at[kept + 1] - at[kept]
        self.clear()
        self.codes.update((words[k], i) for i, k in enumerate(kept.tolist()))
        self._append(flat[np.arange(sizes.sum()) + np.repeat(at[kept] - np.cumsum(sizes) + sizes, sizes)], sizes)
        self.hits = np.ones(len(kept), np.int64)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.at[-1])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(used + len(ids), np.uint32)])
        self.flat[used : used + len(ids)] = ids
        self.at = np.concatenate([self.at, used + np.cumsum(sizes)])

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words of plain characters, CALL words to a string."""
        strings = [" ".join(words[at : at + CALL]) for at in range(0, len(words), CALL)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        chars = np.frombuffer((" ".join(strings) + " ").encode("utf-32-le"), np.uint32)
        kind = KINDS[chars]
        fresh = (kind != BLANK) & ((kind == DIGIT) | (kind != np.append(np.int8(BLANK), kind[:-1])))
        begin = np.concatenate(([0], np.flatnonzero(chars == 0x20)[:-1] + 1))
        stretches = np.add.reduceat(fresh, begin, dtype=np.int64)
        parts, sizes = [], []
        for at, ids in zip(range(0, len(words), CALL), found):
            own = np.cumsum(stretches[at : at + CALL])
            stops = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
            if len(stops) - 1 == own[-1] and stops[-1] == len(ids):
                parts.append(ids)
                sizes.append(np.diff(stops[own], prepend=0))
            else:
                ids, size = self._one_by_one(words[at : at + CALL])
                parts.append(ids)
                sizes.append(size)
        return np.concatenate(parts), np.concatenate(sizes)

    def _learn(self, fresh: list[bytes]) -> None:
        for at in range(0, len(fresh), 20_000):
            words = [w.decode() for w in fresh[at : at + 20_000]]
            size = np.fromiter(map(len, words), np.int64, len(words))
            chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            odd = np.where(chars < 0x250, KINDS[np.minimum(chars, 0x24F)] < 0, True)
            plain = ~np.logical_or.reduceat(odd, np.cumsum(size) - size)
            sizes, ids = np.zeros(len(words), np.int64), []
            for which, encode in ((np.flatnonzero(plain), self._together), (np.flatnonzero(~plain), self._one_by_one)):
                if len(which):
                    flat, sizes[which] = encode([words[i] for i in which.tolist()])
                    ids.append((which, flat))
            place, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint32)
            for which, flat in ids:
                own = sizes[which]
                out[np.arange(len(flat)) + np.repeat(place[which] - np.cumsum(own) + own, own)] = flat
            self._append(out, sizes)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry than texts)."""
        if len(self.codes) > MOST_WORDS:
            self.forget()
        words, ends = [], [0]
        for text in texts:
            words += text.split()
            ends.append(len(words))
        known = len(self.codes)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if len(self.codes) > known:
            self._learn(list(islice(self.codes, known, None)))
        met = np.bincount(codes, minlength=len(self.codes))
        met[: len(self.hits)] += self.hits
        self.hits = met
        begin = self.at[codes]
        sizes = self.at[codes + 1] - begin
        total = np.concatenate(([0], np.cumsum(sizes)))
        index = np.arange(total[-1]) + np.repeat(begin - total[:-1], sizes)
        return self.flat[index], total[np.array(ends)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the fill of each bin."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has room for r more
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            room[left].append(b)
            free |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def turns(fills: np.ndarray) -> np.ndarray:
    """The place of each bin among those of the same fill, from 0."""
    order = np.argsort(fills, kind="stable")
    begin = np.flatnonzero(np.append(True, fills[order][1:] != fills[order][:-1])) if len(fills) else np.zeros(0, np.int64)
    out = np.empty(len(fills), np.int64)
    out[order] = np.arange(len(fills)) - np.repeat(begin, np.diff(np.append(begin, len(fills))))
    return out


def pieces_of(path: str, end: int, capacity: int, batch: pa.RecordBatch):
    """(row, piece, start, length, crc) of each piece of a batch of (id, text)."""
    raw, at = text_bytes(batch.column(1))
    view = memoryview(raw)
    ids, begin = word_tokens(path).encode([bytes(view[a:b]) for a, b in zip(at[:-1], at[1:])])
    tail = np.array([end], "<u4").tobytes()
    for row, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
        length = b - a + 1
        for piece, start in enumerate(range(0, length, capacity)):
            size = min(capacity, length - start)
            last = start + size == length
            crc = zlib.crc32(ids[a + start : a + start + size - last].astype("<u4").tobytes())
            yield row, piece, start, size, zlib.crc32(tail, crc) if last else crc


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, fan_in: int = 8, group: int = GROUP) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    ``tokenizer`` is the path of a tokenizers file that every worker can open.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")

    def tokenised(batches):
        for batch in slices(batches, "text"):
            row, piece, *columns = (np.array(c, np.int64) for c in zip(*pieces_of(tokenizer, end, capacity, batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, columns)], ["id", "piece", "start", "length", "crc"])

    def first_round(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
        more = {"bin": (TaskContext.get().partitionId() << 32) + bins, "at": offsets, "fill": fills[bins], "turn": turns(fills)[bins]}
        for name, column in more.items():
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches(max_chunksize=20_000)

    shape = f"id {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, crc long"
    tokens = scratch.save(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(tokenised, shape), "tokens")
    dealt = tokens.repartition(max(1, -(-tokens.count() // group)))
    placed = scratch.save(dealt.mapInArrow(first_round, shape + ", bin long, at long, fill long, turn long"), "pieces")

    def next_round(key, frame):
        bins, offsets, fills = best_fit(frame["fill"].to_numpy(), capacity)
        roots = frame["bin"].to_numpy()[np.unique(bins, return_index=True)[1]]
        return frame.assign(into=roots[bins], shift=offsets, fill=fills[bins], turn=turns(fills)[bins])[["bin", "into", "shift", "fill", "turn"]]

    # moves: where each bin of the first round has gone so far; open: the bins that a later round may complete
    groups = (placed.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1
    spans = list(takewhile(lambda span: span < groups * fan_in, (fan_in**n for n in count(1))))
    sent = lambda rows, left: rows.where(f"fill < {capacity} and turn < {fan_in * left}").select("bin", "fill").distinct()
    open_bins, moves = scratch.save(sent(placed, len(spans)), "open"), None
    for left, span in zip(range(len(spans) - 1, -1, -1), spans):
        merged = F.floor(F.shiftright("bin", 32) / span)
        done = scratch.save(open_bins.groupBy(merged.alias("group")).applyInPandas(next_round, "bin long, into long, shift long, fill long, turn long"), "round")
        if moves is None:
            moves = done.select("bin", "into", "shift")
        else:
            later = done.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(later, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = scratch.save(moves, "moves")
        open_bins = scratch.save(sent(done.select(F.col("into").alias("bin"), "fill", "turn"), left), "open")
    if moves is None:
        moves = spark.createDataFrame([], "bin long, into long, shift long")
    full = placed.where(f"fill = {capacity}").select("*", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"))
    rest = placed.where(f"fill < {capacity}").join(moves, "bin", "left")
    rest = rest.select(*placed.columns, F.coalesce("into", "bin").alias("into"), F.coalesce("shift", F.lit(0)).alias("shift"))
    out = full.unionByName(rest)
    return out.select(F.col("id").alias(id), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("into").alias("sequence_id"), (F.col("at") + F.col("shift")).alias("offset"))
