"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of unit length with cosine c lie at squared distance 2 - 2c. The vectors are rotated to the principal axes of
a sample of at most ``SAMPLE`` of them, and the axes are dealt to ``BLOCKS`` blocks in turn, each block's widest
first. A pair within the squared-distance budget is, in at least one block, within that block's proportional share
of it. Each block is range-joined: its space is cut at the means of its leading axes into cells; a vector lives in
one cell, and of the cells whose box is within the share it visits those of a higher number, so that a pair meets
once. Where a vector meets those that live in a cell, block distances find candidates, and a candidate is confirmed
by the cosine of the original vectors in double precision. A pair may be within budget in several blocks; it counts
in the first of them only, so links are summed without listing pairs. Each cell hands on, for every vector, a number
of links and the smallest id that its own links reach; the rest is connected components.

Vectors travel in packed chunks, one row for many vectors of a task that go to the same cell. Identical vectors are
one representative with a weight. A first pass only counts each cell's vectors; crowded cells are dealt to several
tasks, those that live there and those that visit both. The sample decides where cells lie, never the result. The
cost of the range joins falls with the number of cells but is not linear: see the README.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; rows that repeat an id with other vectors are vectors of their own but one
node, so components join through it; a row with a null id links with nothing, has a null component and is kept; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewright.operators.graph import components
from tracewright.session import Scratch

BLOCKS, RESIDENTS, TILE, SAMPLE, SLACK = 4, 12_000, 16_000, 2000, 1e-9
SLICE = 4 << 20  # bytes of vectors whose visits are worked out at once


def block_edges(size: int) -> list[int]:
    """Where each block of the rotated axes begins, and the end."""
    blocks = min(BLOCKS, size)
    return np.concatenate(([0], np.cumsum([len(range(b, size, blocks)) for b in range(blocks)]))).tolist()


class Axes:
    """The rotation of vectors of one length, block by block, and the means that cells are cut at."""

    def __init__(self, size: int, sample: np.ndarray | None = None):
        self.edges, self.turn, self.centre = block_edges(size), np.eye(size), np.zeros(size)
        if sample is not None and len(sample) > 1:
            unit = _unit(sample)
            wide = np.linalg.eigh(np.cov(unit.T).reshape(size, size))[1][:, ::-1]
            blocks = len(self.edges) - 1
            self.turn = wide[:, [a for b in range(blocks) for a in range(b, size, blocks)]]
            self.centre = (unit @ self.turn).mean(0)

    def cells(self, turned: np.ndarray, share: float, bits: int):
        """For each block: (block, home cell of each row, then row and cell of every visit to a cell of a higher number)."""
        for b, (first, end) in enumerate(zip(self.edges, self.edges[1:])):
            lead = slice(first, min(first + bits, end))
            off = turned[:, lead] - self.centre[lead]
            home = ((off > 0) << np.arange(off.shape[1])).sum(1).astype(np.int64)
            row, cell, spent = np.arange(len(off)), home, np.zeros(len(off))
            for i in range(off.shape[1]):
                more = spent + off[row, i] ** 2
                ok = more <= share + SLACK
                row, cell, spent = np.concatenate([row, row[ok]]), np.concatenate([cell, cell[ok] ^ (1 << i)]), np.concatenate([spent, more[ok]])
            up = cell > home[row]
            yield b, home, row[up], cell[up]


def _vectors(batches, width: str):
    """(id, size, vector bytes of floats of the width given, mark); unusable vectors have no mark."""
    for batch in batches:
        out = []
        for id, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = row.values
            v = None
            if values is not None and len(values) and not values.null_count:
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                norm = np.sqrt(v @ v)
                if not np.isfinite(norm) or norm == 0:
                    scale = np.abs(v).max()
                    v = v / scale if np.isfinite(scale) and scale > 0 else None
            data = None if v is None else v.astype(width).tobytes()
            out.append((id, 0 if v is None else len(v), data, None if data is None else blake2b(data, digest_size=16).digest()))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "size", "vector", "mark"])


def _unpack(data: bytes, size: int, width: str) -> np.ndarray:
    return np.frombuffer(data, width).reshape(-1, size).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


class Side:
    """The vectors of one side of a tile."""

    def __init__(self, rows: pd.DataFrame, size: int, width: str, axes: Axes, block: int):
        joined = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        self.node, self.rep, self.copies = (joined(n, np.int64) for n in ("nodes", "reps", "copies"))
        self.lives = np.repeat(rows["lives"].to_numpy(bool), rows["nodes"].str.len().to_numpy() // 8)
        self.vectors = _unpack(b"".join(rows["vectors"]), size, width)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.own = (self.vectors / self.norms[:, None]) @ axes.turn[:, axes.edges[block] : axes.edges[block + 1]]

    def turned(self, at: np.ndarray, axes: Axes) -> np.ndarray:
        """The rotated unit vectors of these rows, worked out once for each distinct row."""
        some, place = np.unique(at, return_inverse=True)
        return ((self.vectors[some] / self.norms[some, None]) @ axes.turn)[place]


def _meet(frame: pd.DataFrame, least: float, width: str, axes: Axes, block: int, size: int) -> pd.DataFrame:
    """The links between the guests and the hosts of one tile: (node, rep, links, label)."""
    hosts = Side(frame[frame["host"]], size, width, axes, block)
    guests = Side(frame[~frame["host"]], size, width, axes, block)
    share = (2 - 2 * least) / (len(axes.edges) - 1)
    node, place = np.unique(np.concatenate([guests.node, hosts.node]), return_inverse=True)
    of_guest, of_host = place[: len(guests.node)], place[len(guests.node) :]
    rep, links = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    rep[of_guest], rep[of_host] = guests.rep, hosts.rep
    # one single-precision product gives minus half the squared distance of each pair; the slack covers its rounding
    half = lambda side: -(side.own * side.own).sum(1)[:, None] / 2
    there = np.hstack([guests.own, half(guests), np.ones((len(guests.own), 1))]).astype(np.float32)
    here = np.ascontiguousarray(np.hstack([hosts.own, np.ones((len(hosts.own), 1)), half(hosts)]).astype(np.float32).T)
    root, step, found, held = np.arange(len(node)), max(1, 400_000 // max(len(hosts.node), 1)), [], 0
    for at in range(0, len(there), step):
        hit = np.flatnonzero(there[at : at + step] @ here >= np.float32(-share / 2 - 1e-5))
        if len(hit):
            i, j = np.divmod(hit, len(hosts.node))
            i += at
            ok = ~guests.lives[i] | (guests.node[i] < hosts.node[j])
            found.append((i[ok], j[ok]))
            held += len(hit)
        if found and (held >= 100_000 or at + step >= len(there)):
            i, j = (np.concatenate(c) for c in zip(*found))
            ok = np.einsum("ij,ij->i", guests.vectors[i], hosts.vectors[j]) / (guests.norms[i] * hosts.norms[j]) >= least
            i, j = i[ok], j[ok]
            gap = (guests.turned(i, axes) - hosts.turned(j, axes)) ** 2
            ok = (np.add.reduceat(gap, axes.edges[:-1], axis=1) <= share + SLACK).argmax(1) == block
            i, j = i[ok], j[ok]
            links += np.bincount(of_guest[i], hosts.copies[j], len(node)).astype(np.int64) + np.bincount(of_host[j], guests.copies[i], len(node)).astype(np.int64)
            _join(root, of_guest[i], of_host[j])
            found, held = [], 0
    root, low = _roots(root, np.arange(len(node))), np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(low, root, rep)
    told = links > 0
    return pd.DataFrame({"node": node[told], "rep": rep[told], "links": links[told], "label": low[root][told]})


def _roots(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = root[x]
    while (root[x] != x).any():
        x = root[x]
    return x


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each pair, the higher root below the lower one."""
    while len(i):
        a, b = _roots(root, i), _roots(root, j)
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        high, first = np.unique(np.maximum(a, b), return_index=True)
        root[high] = np.minimum(a, b)[first]


def embedding_dedup(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs of cosine >= ``least`` (which is above 0)."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    width = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = scratch.save(rows.mapInArrow(lambda batches: _vectors(batches, width), "id long, size int, vector binary, mark binary"), "vectors")
    usable = rows.where("id is not null and mark is not null")
    reps = usable.groupBy("mark", "size", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.save(reps.withColumn("node", F.monotonically_increasing_id()), "reps")  # numbers that are fixed by the write
    held = reps.count()
    bits = max(1, min(16, int(np.log2(max(held, 2) / RESIDENTS))))
    sampled: dict[int, list] = {}
    some = reps.where(F.pmod(F.xxhash64("mark"), F.lit(max(1, held // (2 * SAMPLE)))) == 0)
    for row in some.select("size", "vector").limit(SAMPLE).collect():
        sampled.setdefault(row["size"], []).append(_unpack(row["vector"], row["size"], width)[0])
    known_axes = {size: Axes(size, np.stack(v)) for size, v in sampled.items()}
    axes_of = lambda size: known_axes.get(size) or Axes(size)

    def visits(batches):
        """(part, size, block, cell, whether they live there, places in the part) of each group of vectors that go to a cell."""
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                whole, axes = batch.filter(pa.array(sizes == size)), axes_of(size)
                step = max(1, SLICE // (size * 8))
                for at in range(0, whole.num_rows, step):
                    part = whole.slice(at, step)
                    turned = _unit(_unpack(b"".join(part.column(1).to_pylist()), size, width)) @ axes.turn
                    for block, home, row, cell in axes.cells(turned, (2 - 2 * least) / (len(axes.edges) - 1), bits):
                        for lives, where, who in ((True, home, np.arange(len(home))), (False, cell, row)):
                            order = np.argsort(where, kind="stable")
                            begin = np.flatnonzero(np.append(True, where[order][1:] != where[order][:-1])) if len(order) else []
                            for a, b in zip(begin, [*begin[1:], len(order)]):
                                yield part, size, block, int(where[order[a]]), lives, who[order[a:b]]

    def count(batches):
        found = [(size, block, cell, lives, len(at)) for _, size, block, cell, lives, at in visits(batches)]
        if found:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["size", "block", "cell", "lives", "k"])

    def pack(batches):
        for part, size, block, cell, lives, at in visits(batches):
            own = part.take(pa.array(at))
            numbers = [own.column(i).to_numpy().tobytes() for i in (2, 3, 4)]
            fields = [size, block, cell, lives, *numbers, b"".join(own.column(1).to_pylist())]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(fields, kinds)], ["size", "block", "cell", "lives", "nodes", "reps", "copies", "vectors"])

    key = ["size", "block", "cell"]
    wide = reps.select("size", "vector", "node", "rep", "copies")
    load = wide.mapInArrow(count, "size int, block int, cell long, lives boolean, k long").groupBy(*key)
    load = load.agg(F.coalesce(F.sum(F.when(F.col("lives"), F.col("k"))), F.lit(0)).alias("n"), F.sum("k").alias("m")).where("n > 0")
    load = scratch.save(load.select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("rows"), F.ceil(F.col("m") / TILE).cast("int").alias("columns")), "load")
    packed = wide.mapInArrow(pack, "size int, block int, cell long, lives boolean, nodes binary, reps binary, copies binary, vectors binary").join(load, key)
    # whoever lives in a cell is a host there, and a guest like those that visit; a tile is some guests and some hosts
    turn = F.xxhash64("nodes")
    spread = packed.withColumn("host", F.explode(F.when(F.col("lives"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    own, others = F.when(F.col("host"), F.col("rows")).otherwise(F.col("columns")), F.when(F.col("host"), F.col("columns")).otherwise(F.col("rows"))
    spread = spread.withColumn("mine", F.pmod(turn, own).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), others - 1)))
    spread = spread.withColumns({"row": F.when(F.col("host"), F.col("mine")).otherwise(F.col("theirs")), "column": F.when(F.col("host"), F.col("theirs")).otherwise(F.col("mine"))})

    def tile(frame):
        size, block = int(frame["size"].iloc[0]), int(frame["block"].iloc[0])
        return _meet(frame, least, width, axes_of(size), block, size)

    tiles = scratch.save(spread.groupBy(*key, "row", "column").applyInPandas(tile, "node long, rep long, links long, label long"), "links")
    counts = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    known = rows.select("id", "mark").join(reps.select("mark", "node", "rep", "copies"), "mark", "left")
    # an id with several vectors ties them together
    torn = usable.groupBy("id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("id")
    ties = known.join(torn, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    grouped = components(tiles.select(F.col("rep").alias("a"), F.col("label").alias("b")).unionByName(ties))
    known = known.join(counts, "node", "left").join(grouped.select(F.col("id").alias("rep"), "component"), "rep", "left")
    linked = F.when(F.col("id").isNull() | F.col("rep").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = known.select(F.col("id").alias(id), linked.cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
