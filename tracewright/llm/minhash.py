"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and exact confirmation.

A document's set holds its distinct 5-word shingles (the whole word sequence where it has fewer words; A-Z
lower-cased). Its signature has 36 symbols of 32 bits, each the low half of one minimum hash. Two sets of
Jaccard similarity s differ in a symbol with probability 1 - s, so at 0.75 in 9 of 36 on average; the
distance threshold is 19, which a pair at 0.75 exceeds with a probability of about 1e-4, pairs above it
far less often. (A further 124 symbols of 8 bits are only compared: 67 of all 160 may differ, five standard
deviations above the mean at 0.75, which keeps most pairs far below 0.75 from the exact check.) It is cut into 12 chunks of 3 symbols. By pigeonhole a pair within distance 19
has at most one wrong symbol in at least 3 chunks, so indexing every chunk under each of its patterns with
one symbol left out (36 keys a document) finds all pairs within the threshold. Links are then confirmed on
the full sets, so no false link survives.

Work stays linear in groups of copies: equal sets are one node with a number of its own; the rows of an index bucket
are first paired with its smallest node only, confirmed, and joined into components. Of the rows of a bucket whose
components still differ, each task keeps a spanning forest of the pairs near enough, not the pairs; the forests
connect clusters. A cluster's members are compared in tiles, first by their signatures alone, which tells whose full
sets a tile needs; then nearest pairs first, where a pair whose components have been joined is passed over and only
links are handed on. Documents that stay just below 0.75 to each other are the one case that costs a comparison (no
row) for each pair. Buckets of more than ``crowded`` rows with several components are split by the keys of a further
chunk, up to twice, which the three good chunks allow without losing a pair; what is still crowded then is dealt to
slots, and a task compares two slots. Tables between the steps lie in the shared folder.

Defined results: null texts, and texts without words, have an empty set and link with nothing; rows that repeat an id
with other texts are compared each for itself but are one document, so components join through it; a row with a null
id links with nothing, has a null component and is kept; an empty table gives no rows; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.words import U64, Words, mix, slices
from tracewright.operators.graph import components
from tracewright.session import Scratch

WORDS, SYMBOLS, CHUNK, FAR = 5, 36, 3, 19
CHECKS, FAR_ALL = 124, 67  # further symbols of 8 bits, and the distance allowed over all 160
TILE = 400  # documents of a cluster that a tile compares with as many others
SMALL_SIDE = 200_000  # ids; a larger side is never broadcast
_salt = mix(np.arange(1, 2 * (SYMBOLS + CHECKS) + 1, dtype=U64))
XORS, FACTORS = _salt[::2], _salt[1::2] | U64(1)


def shingle_sets(array: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    w = Words(array, lower=True)
    grams, out = w.grams(WORDS), []
    for at, to in zip(w.first[:-1], w.first[1:]):
        n = to - at
        if n >= WORDS:
            s = np.sort(grams[at : to - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            h = U64(n)
            with np.errstate(over="ignore"):
                for x in w.hash[at:to]:
                    h = mix(np.array([h ^ x], U64))[0]
            out.append(np.array([h], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none of them empty, SYMBOLS symbols of 32 bits and CHECKS of 8 bits."""
    flat = np.concatenate(sets)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    symbols, checks = np.empty((len(sets), SYMBOLS), np.uint32), np.empty((len(sets), CHECKS), np.uint8)
    for k in range(SYMBOLS + CHECKS):
        least = np.minimum.reduceat((flat ^ XORS[k]) * FACTORS[k], begin)
        if k < SYMBOLS:
            symbols[:, k] = least.astype(np.uint32)
        else:
            checks[:, k - SYMBOLS] = least.astype(np.uint8)
    return symbols, checks


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """For every chunk and each of its symbols left out, a hash of the others."""
    keys = []
    for c in range(0, SYMBOLS, CHUNK):
        for out in range(CHUNK):
            a, b = (symbols[:, c + j].astype(U64) for j in range(CHUNK) if j != out)
            keys.append(mix(mix(a << U64(32) | b) + U64(c + out + 1)))
    return np.stack(keys, 1).view(np.int64)


def _sketch(batches):
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column(1))
        size = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(size)
        marks = [_mark(s.tobytes()) for s in sets]
        sig, keys = [None] * len(sets), np.zeros((0, SYMBOLS), np.int64)
        if len(full):
            symbols, checks = signatures([sets[i] for i in full])
            keys = index_keys(symbols)
            for i, row, more in zip(full, symbols, checks):
                sig[i] = row.tobytes() + more.tobytes()
        at = np.concatenate(([0], np.cumsum((size > 0) * SYMBOLS))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(marks, pa.binary()), pa.array(sig, pa.binary()), lists], ["id", "n", "mark", "sig", "keys"])


def _mark(grams: bytes) -> bytes | None:
    return blake2b(grams, digest_size=16).digest() if grams else None


def _sets(batches):
    for batch in slices(batches, "text"):
        grams = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array([_mark(g) for g in grams], pa.binary()), pa.array(grams, pa.binary())], ["mark", "grams"])


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 * SYMBOLS + CHECKS)
    return np.ascontiguousarray(rows[:, : 4 * SYMBOLS]).view(np.uint32), rows[:, 4 * SYMBOLS :]


def _within(a, i, b, j) -> np.ndarray:
    """Which of the pairs of rows i of a and j of b are near enough, and how far they are (over all symbols)."""
    far = (a[0][i] != b[0][j]).sum(1)
    ok = np.flatnonzero(far <= FAR)
    whole = far[ok] + (a[1][i[ok]] != b[1][j[ok]]).sum(1)
    return ok[whole <= FAR_ALL], whole[whole <= FAR_ALL]


def _near(batches):
    """Pairs within the distance threshold."""
    for batch in batches:
        if batch.num_rows:
            every = np.arange(batch.num_rows)
            ok, _ = _within(_matrix(batch.column(2)), every, _matrix(batch.column(3)), every)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], ["a", "b"])


def _roots(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = root[x]
    while (root[x] != x).any():
        x = root[x]
    return x


def _crossing(batches):
    """Of rows sorted by key, a spanning forest of the pairs of a key that are near enough and in different components.

    Rows are compared with those 1, 2, 3, ... places further on, all keys at once.
    """

    def forest(rows: pa.Table):
        key, id, group = (rows.column(k).to_numpy() for k in ("key", "node", "component"))
        signed, root = _matrix(rows.column("sig")), np.arange(len(key))
        at, step = np.arange(len(key)), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                return
            for part in np.array_split(at, 1 + len(at) // 100_000):
                part = part[group[part] != group[part + step]]
                ok, _ = _within(signed, part, signed, part + step)
                x, y = part[ok], part[ok] + step
                while len(x):
                    a, b = _roots(root, x), _roots(root, y)
                    x, y, a, b = (v[a != b] for v in (x, y, a, b))
                    high, first = np.unique(np.maximum(a, b), return_index=True)
                    root[high] = np.minimum(a, b)[first]
                    if len(first):
                        yield pa.RecordBatch.from_arrays([pa.array(id[x[first]]), pa.array(id[y[first]])], ["a", "b"])
            step += 1

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 50_000 or held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        yield from forest(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), len(key) - cut
    if held:
        yield from forest(pa.Table.from_batches(held))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < 75 * len(b) or not len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _tile_pairs(slot, group, i, j, signed):
    """The pairs of a tile that are near enough and whose components differ, and how far they are."""
    x, y = np.triu_indices(len(slot), 1) if i == j else (v.ravel() for v in np.meshgrid(np.flatnonzero(slot == i), np.flatnonzero(slot == j), indexing="ij"))
    for at in range(0, len(x), 100_000):
        a, b = x[at : at + 100_000], y[at : at + 100_000]
        open_ = group[a] != group[b]
        ok, far = _within(signed, a[open_], signed, b[open_])
        yield a[open_][ok], b[open_][ok], far


def _needed(rows: list[tuple]):
    """The rows of a tile that are in such a pair: their sets are needed."""
    cluster, i, j, node, slot, group, sig = zip(*rows)
    some = np.zeros(len(rows), bool)
    for a, b, _ in _tile_pairs(np.array(slot), np.array(group), i[0], j[0], _matrix(pa.array(sig, pa.binary()))):
        some[a] = some[b] = True
    for k in np.flatnonzero(some).tolist():
        yield rows[k][:4]


def _tile(rows: list[tuple]):
    """Links of one tile between components that are not joined yet, nearest pairs first."""
    _, i, j, node, slot, group, sig, grams = zip(*rows)
    sets, place = [np.frombuffer(g, U64) for g in grams], {}
    group = np.array([place.setdefault(g, len(place)) for g in group])
    found = list(_tile_pairs(np.array(slot), group, i[0], j[0], _matrix(pa.array(sig, pa.binary()))))
    x, y, far = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    root = list(range(len(place)))

    def find(g):
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    order = np.argsort(far, kind="stable")
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        p, q = find(int(group[a])), find(int(group[b]))
        if p != q and _similar(sets[a], sets[b]):
            root[max(p, q)] = min(p, q)
            yield node[a], node[b]


def _by_tile(settle, names: list[str], kinds: list):
    """Batches of what ``settle`` gives for each tile; rows come sorted by tile, and a tile is settled when its last row is there."""

    def run(batches):
        rows, out = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), []
        for _, tile in groupby(rows, key=lambda r: r[:3]):
            out += settle(list(tile))
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _exact(batches):
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        keep = [_similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(batch.column(2), batch.column(3))]
        if keep:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


class Join:
    """The steps of the join over one input; see the module's docstring."""

    def __init__(self, docs: DataFrame, id: str, text: str, crowded: int):
        self.docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        self.crowded = crowded
        self.scratch = Scratch(docs.sparkSession, "minhash")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The sketches of all rows, and (node, component) of the nodes that have links."""
        save = self.scratch.save
        kinds = "id long, n long, mark binary, sig binary, keys array<long>"
        self.sketch = save(self.docs.mapInArrow(_sketch, kinds), "sketch")
        reps = self.sketch.where("id is not null and mark is not null").groupBy("mark").agg(F.min("id").alias("rep"))
        mine = self.sketch.join(reps, (self.sketch["mark"] == reps["mark"]) & (self.sketch["id"] == reps["rep"]), "left_semi")
        mine = mine.select("id", "mark", "sig", "keys").dropDuplicates(["mark"]).withColumn("node", F.monotonically_increasing_id())
        self.unique = save(mine, "unique")  # node numbers are fixed by the write
        keyed = self.unique.select("node", F.posexplode("keys").alias("pos", "key"))
        rows = save(self.buckets(keyed.withColumn("component", F.col("node"))), "rows")
        stars = rows.where("node <> least_node").select(F.col("least_node").alias("a"), F.col("node").alias("b")).distinct()
        links = self.confirmed(save(self.near(stars), "stars"))
        grouped = components(links).toDF("node", "component")
        # rows whose components still differ but that are near: clusters of them, and their pairs in tiles
        forest = save(self.crossing(self.labelled(rows.drop("component"), grouped)), "forest")
        found = self.tiled(components(forest).toDF("node", "cluster"), grouped)
        ties = grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found).unionByName(self.torn())
        return self.sketch, components(ties).toDF("node", "component")

    def torn(self) -> DataFrame:
        """Ties between the nodes of an id that has several texts."""
        known = self.sketch.where("id is not null and mark is not null").select("id", "mark")
        torn = known.groupBy("id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi")
        nodes = self.unique.select("mark", "node")
        each = known.join(torn.select("id", "lo"), "id").join(nodes.toDF("mark", "a"), "mark").join(nodes.toDF("lo", "b"), "lo")
        return each.where("a <> b").select("a", "b")

    def tiled(self, clusters: DataFrame, grouped: DataFrame) -> DataFrame:
        """Links within clusters, whose members are dealt to slots; a tile compares two slots, or one with itself."""
        clusters = self.scratch.save(clusters, "clusters")
        slots = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("slots"))
        rows = self.labelled(clusters, grouped).join(slots, "cluster").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
        rows = rows.join(self.unique.select("node", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        rows = rows.select("cluster", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "node", "slot", "component", "sig")
        tile = ["cluster", "i", "j"]
        deal = lambda rows: rows.repartition(*tile).sortWithinPartitions(*tile)
        needed = _by_tile(_needed, [*tile, "node"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])
        needed = self.scratch.save(deal(rows).mapInArrow(needed, "cluster long, i int, j int, node long"), "needed")
        sets = self.sets(needed.select("node"))
        whole = rows.join(needed, [*tile, "node"], "left_semi").join(sets, "node").select(*tile, "node", "slot", "component", "sig", "grams")
        return self.scratch.save(deal(whole).mapInArrow(_by_tile(_tile, ["a", "b"], [pa.int64(), pa.int64()]), "a long, b long"), "links")

    def labelled(self, rows: DataFrame, grouped: DataFrame, name: str = "component") -> DataFrame:
        found = grouped.select("node", F.col("component").alias("found"))
        return rows.join(found, "node", "left").withColumn(name, F.coalesce("found", "node")).drop("found")

    def buckets(self, keyed: DataFrame) -> DataFrame:
        """Rows of the keys that several components share, with the key's least node and size."""
        shared = keyed.groupBy("key").agg(F.min("node").alias("least_node"), F.count("*").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        return keyed.join(shared.where("lo <> hi").drop("lo", "hi"), "key")

    def crossing(self, rows: DataFrame) -> DataFrame:
        """Edges that span, bucket by bucket, the pairs near enough whose components differ."""
        every, rows = None, self.scratch.save(self.buckets(rows.select("key", "pos", "node", "component")), "mixed")
        for splits_left in (2, 1, 0):
            fit = rows.where(F.col("held") <= self.crowded) if splits_left else rows
            every = fit if every is None else every.unionByName(fit)
            big = rows.where(F.col("held") > self.crowded)
            if not splits_left or big.isEmpty():
                break
            further = F.expr(f"slice(keys, (pos div {CHUNK} + 1) * {CHUNK} + 1, {SYMBOLS})")
            split = big.join(self.unique.select("node", "keys"), "node").select("node", "component", "pos", "key", F.posexplode(further).alias("on", "sub"))
            split = split.select(F.xxhash64("key", "sub").alias("key"), F.expr(f"int((pos div {CHUNK} + 1) * {CHUNK} + on)").alias("pos"), "node", "component").distinct()
            rows = self.scratch.save(self.buckets(split), "split")
        # buckets that stay crowded are compared slot by slot
        slots = F.ceil(F.col("held") / self.crowded).cast("int")
        slot = F.pmod(F.xxhash64("node"), slots).cast("int")
        spread = every.select("key", "node", "component", slot.alias("slot"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("other"))
        key = F.when((F.col("slot") == 0) & (F.col("other") == 0), F.col("key")).otherwise(F.xxhash64("key", F.least("slot", "other"), F.greatest("slot", "other")))
        signed = spread.select(key.alias("key"), "node", "component").join(self.unique.select("node", "sig"), "node").select("key", "node", "component", "sig")
        return signed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_crossing, "a long, b long")

    def near(self, pairs: DataFrame) -> DataFrame:
        sig = self.unique.select("node", "sig")
        both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(_near, "a long, b long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, grams) of these nodes, from the documents that stand for them."""
        wanted = self.scratch.save(self.unique.select("node", "id", "mark").join(nodes.distinct(), "node", "left_semi"), "wanted")
        ids = wanted.select("id").distinct()
        ids = F.broadcast(ids) if wanted.count() <= SMALL_SIDE else ids
        found = self.docs.join(ids, "id", "left_semi").mapInArrow(_sets, "mark binary, grams binary")
        return self.scratch.save(found.join(wanted.select("mark", "node"), "mark").select("node", "grams").dropDuplicates(["node"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
        links = self.scratch.save(both.mapInArrow(_exact, "a long, b long"), "links")
        self.scratch.drop(sets)
        return links


def minhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", crowded: int = 2048) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; a component's smallest id is the one kept."""
    join = Join(docs, id, text, crowded)
    sketch, grouped = join.run()
    nodes = join.unique.select("mark", "node", F.col("id").alias("rep"))
    placed = nodes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    placed = placed.join(least, "component").select("mark", "least")
    joined = sketch.select("id", "n", "mark").join(placed, "mark", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    named = joined.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return named.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
