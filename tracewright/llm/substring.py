"""Repeated passages across documents, found by streaming documents' text through FM-indexes of other documents' text.

A window of ``WINDOW`` consecutive words is removed from a document when the same words also start in a
document with a smaller id; windows are judged on the input. Every window has an anchor, the least hash
among its 8-word grams, which depends on its words alone, so equal windows have equal anchors. Windows in a
row with one anchor form a piece. Only pieces whose anchor is found in several documents go on, dealt to shards by
anchor. Of an anchor's pieces a shard indexes those that have a document with a greater id beside them (BWT in a
wavelet matrix), and streams through the index those that have one with a smaller id: backward search computes their
matching statistics, and where these reach the window, the suffix interval tells the least document id that has it.

Skew: documents with the same words are one representative (each further copy repeats it wholly); equal pieces
collapse inside each task before they are dealt, to one with its least and greatest id; anchors that more than ``HOT``
documents share, about as many as a task can index at once, are dealt by the hash of the whole window instead, one
piece a window; a piece that a document repeats is one row with its places; shards are built one after another at
``SHARD_WORDS`` words, whatever a task holds.

Defined results: null texts have no words; rows that repeat an id are judged by their own text and never
remove words from each other; a row with a null id is left as it is and removes nothing; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from hashlib import blake2b, sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.fmindex import FMIndex
from tracewright.llm.words import U64, Words, mix, slices, sliding_min
from tracewright.session import Scratch

WINDOW, GRAM, LONGEST_RUN, HOT, SHARD_WORDS = 50, 8, 64, 20_000, 400_000
EMPTY = sha256(b"").digest()


def _list(offsets: np.ndarray, /, **fields: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


def digest(raw: bytes) -> bytes:
    return sha256(b" ".join(raw.split())).digest()


def _runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one anchor: text, anchor, first word, number of windows."""
    least = sliding_min(w.grams(GRAM), WINDOW - GRAM + 1)
    at = np.flatnonzero(w.whole(WINDOW))
    doc = np.repeat(np.arange(len(w.counts)), w.counts)[at]
    value, fresh = least[at], np.ones(len(at), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(place % LONGEST_RUN == 0)
    return doc[begin], value[begin].view(np.int64), at[begin], np.diff(np.append(begin, len(at)))


def _scan(batches):
    for batch in slices(batches, "text"):
        w = Words(batch.column(1))
        raw = memoryview(w.raw)
        marks = [digest(bytes(raw[a:b])) for a, b in zip(w.text_at[:-1], w.text_at[1:])]
        doc, anchor, _, _ = _runs(w)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        each = [np.unique(anchor[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
        anchors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts.astype(np.int64)), pa.array(marks, pa.binary()), anchors], ["id", "n_words", "mark", "anchors"])


def _cut(batches):
    """The pieces of candidate texts. A task tells the words of a piece once, and then only its digest."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
    told = set()
    for batch in slices(batches, "text"):
        w = Words(batch.column(1))
        raw, hashes, window, out = memoryview(w.raw), w.hash, w.grams(WINDOW).view(np.int64), {}
        ids = batch.column(0).to_pylist()
        rows = [int.from_bytes(digest(bytes(raw[a:b]))[:8], "little", signed=True) for a, b in zip(w.text_at[:-1], w.text_at[1:])]
        shared = [{x["h"]: x["hot"] for x in row} for row in batch.column(2).to_pylist()]
        for doc, anchor, at, n in zip(*(x.tolist() for x in _runs(w))):
            hot = shared[doc].get(anchor)
            if hot is None:
                continue
            for key, start, size in [(int(window[j]), j, WINDOW) for j in range(at, at + n)] if hot else [(anchor, at, n + WINDOW - 1)]:
                words = hashes[start : start + size].tobytes()
                piece = blake2b(words, digest_size=16).digest()
                same = out.setdefault((doc, key, piece), ([], None if piece in told else words))
                same[0].append(start - int(w.first[doc]))
                told.add(piece)
        lines = [(key, piece, ids[doc], rows[doc], starts, words) for (doc, key, piece), (starts, words) in out.items()]
        for at in range(0, len(lines), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines[at : at + 5000]), kinds)], ["key", "piece", "id", "row", "starts", "words"])


def _shards(batches):
    """Of rows sorted by key, runs of about SHARD_WORDS words that never part a key."""
    held, words = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            words += batch.column("words").nbytes // 8
        if words >= SHARD_WORDS:
            table = pa.Table.from_batches(held)
            *whole, rest = _parts(table)
            yield from whole
            held, words = rest.to_batches(), rest.column("words").nbytes // 8
    if held:
        yield from _parts(pa.Table.from_batches(held))


def _parts(table: pa.Table) -> list[pa.Table]:
    """A table cut at key boundaries to SHARD_WORDS; one key with more stays whole, and so does the last key."""
    key = table.column("key").to_numpy()
    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(table.column("words")), 0).to_numpy() // 8)))
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    cuts = [0]
    for at, nxt in zip(heads, [*heads[1:], len(key)]):
        if total[nxt] - total[cuts[-1]] > SHARD_WORDS and at > cuts[-1]:
            cuts.append(int(at))
    if cuts[-1] != heads[-1]:
        cuts.append(int(heads[-1]))
    return [table.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(key)])]


def _search(batches):
    for shard in _shards(batches):
        yield _search_one(shard)


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row, each with one more place after it: where each begins, its size, and which places are words."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
    inside = np.ones(int((size + 1).sum()), bool)
    inside[start + size] = False
    return start, size, inside


def _search_one(table: pa.Table):
    """Of the pieces of each key, those that may be a source are indexed, those that may repeat one are streamed."""
    key, first, last = (table.column(c).to_numpy() for c in ("key", "first", "last"))
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    rows = np.diff(np.append(heads, len(key)))
    source = np.flatnonzero(first < np.repeat(np.maximum.reduceat(last, heads), rows))
    stream = np.flatnonzero(last > np.repeat(np.minimum.reduceat(first, heads), rows))
    words = table.column("words").to_pylist()
    found = []
    if len(source) and len(stream):
        texts = [np.frombuffer(words[i], U64) for i in source]
        _, size, inside = _laid_out(texts)
        known, code = np.unique(np.concatenate(texts), return_inverse=True)
        codes = np.zeros(len(inside), np.int64)
        codes[inside] = code + 1
        index = FMIndex(codes, np.repeat(first[source], size + 1), WINDOW)
        del codes, inside, code
        texts = [np.frombuffer(words[i], U64) for i in stream]
        start, size, inside = _laid_out(texts)
        asked = np.concatenate(texts)
        place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        codes = np.zeros(len(inside), np.int64)
        codes[inside] = np.where(known[place] == asked, place + 1, 0)
        found = index.matches(codes, start, size)
    if found:
        text, at, least = (np.concatenate([f[k] for f in found]) for k in range(3))
        text = stream[text]
    else:
        text, at, least = (np.zeros(0, np.int64) for _ in range(3))
    some = np.flatnonzero(least < last[text])
    some = some[np.lexsort((at[some], text[some]))]
    text, at, least = text[some], at[some], least[some]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    begin = np.flatnonzero(fresh)
    own, counts = np.unique(text[begin], return_counts=True)
    runs = _list(np.concatenate(([0], np.cumsum(counts))), at=at[begin].astype(np.int32), n=np.diff(np.append(begin, len(text))).astype(np.int32), least=least[begin])
    return pa.RecordBatch.from_arrays([pa.array(key[own], pa.int64()), table.column("piece").combine_chunks().take(pa.array(own)), runs], ["key", "piece", "found"])


def _keep(batches):
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string())
    for batch in batches:
        rows = []
        for id, text, row, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = (text or "").encode().split()
            mark = sha256(b" ".join(words)).digest()
            if int.from_bytes(mark[:8], "little", signed=True) != row:
                continue
            cover = np.zeros(len(words) + 1, np.int64)
            for run in runs:
                cover[run["at"]] += 1
                cover[run["at"] + run["n"] + WINDOW - 1] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            kept = b" ".join(compress(words, keep))
            rows.append((id, mark, len(words) - int(keep.sum()), sha256(kept).digest(), kept.decode()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "mark", "n_removed", "kept_mark", "kept_text"])


class Search:
    """The steps of the search over one input; see the module's docstring."""

    def __init__(self, docs: DataFrame, id: str, text: str):
        self.docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        self.scratch = Scratch(docs.sparkSession, "substring")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(id, n_words, mark, copy) of every row, and the changed rows (id, mark, n_removed, kept_mark, kept_text)."""
        save = self.scratch.save
        scan = save(self.docs.mapInArrow(_scan, "id long, n_words long, mark binary, anchors array<bigint>"), "scan")
        facts = scan.select("id", "n_words", "mark")
        first = facts.where("id is not null").groupBy("mark").agg(F.min("id").alias("first"))
        rows = facts.join(first, "mark", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
        leading = scan.where("size(anchors) > 0").join(first, (scan.mark == first.mark) & (scan.id == first["first"]), "left_semi")
        own = save(leading.select("id", F.explode("anchors").alias("h")), "anchors")
        shared = own.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("held")).where("lo < hi")
        shared = own.join(shared.select("h", (F.col("held") > HOT).alias("hot")), "h").groupBy("id").agg(F.collect_set(F.struct("h", "hot")).alias("shared"))
        texts = save(self.docs.join(shared, "id"), "texts")
        self.scratch.drop(own)
        pieces = save(texts.select("id", "text", "shared").mapInArrow(_cut, "key long, piece binary, id long, row long, starts array<int>, words binary"), "pieces")
        distinct = pieces.groupBy("key", "piece").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("words").alias("words"))
        dealt = distinct.repartition("key").sortWithinPartitions("key")
        found = save(dealt.mapInArrow(_search, "key long, piece binary, found array<struct<at:int,n:int,least:bigint>>"), "found")
        hits = pieces.select("key", "piece", "id", "row", "starts").join(found, ["key", "piece"])
        runs = F.filter("found", lambda f: f["least"] < F.col("id"))
        place = lambda start: F.transform(runs, lambda f: F.struct((start + f["at"]).alias("at"), f["n"].alias("n")))
        cover = hits.select("id", "row", F.flatten(F.transform("starts", place)).alias("cover")).where("size(cover) > 0")
        cover = cover.groupBy("id", "row").agg(F.flatten(F.collect_list("cover")).alias("cover"))
        marked = texts.select("id", "text").join(cover, "id").select("id", "text", "row", "cover")
        changed = save(marked.mapInArrow(_keep, "id long, mark binary, n_removed long, kept_mark binary, kept_text string").dropDuplicates(["id", "mark"]), "changed")
        self.scratch.drop(pieces, texts)
        return rows, changed


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    rows, changed = Search(docs, id, text).run()
    joined = rows.join(changed.drop("kept_text"), ["id", "mark"], "left")
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    mark = F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_mark", "mark"))
    return joined.select(F.col("id").alias(id), "n_words", removed.alias("n_removed"), F.lower(F.hex(mark)).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; a text that loses all its words goes with its row.

    A changed text is its kept words joined by one space; other texts are unchanged. Columns stay as they are.
    """
    search = Search(docs, id, text)
    rows, changed = search.run()
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    fate = rows.where(F.col("id").isNotNull()).join(changed, ["id", "mark"], "left").where(gone | F.col("kept_text").isNotNull())
    fate = fate.groupBy("id").agg(F.max(F.when(gone, F.lit("")).otherwise(F.col("kept_text"))).alias("kept"))
    held = docs.select(F.struct("*").alias("row"), F.col(id).cast("long").alias("id")).join(fate, "id", "left")
    left = held.where("kept is null or kept <> ''")
    return left.select(*(F.coalesce("kept", f"row.`{c}`").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
