"""Embedding near-duplicates by lattice hashing.

A vector of length one is projected to 8 random directions at a time and every
group of 8 coordinates is decoded to its nearest point of the E8 lattice; the
points of ``BLOCKS`` such groups name a cell.  Several tables use different
directions.  A vector is at home in one cell of each table and also asks in the
neighbouring cells it lies closest to (a lattice point has 240 nearest
neighbours; the cheapest steps over all groups are taken).  Two vectors meet
where one is at home and the other at home or asking, and the cosine of every
pair that meets is verified.

On Spark: equal vectors become one row first, so copies never meet each other.
Cells are counted from their names alone; only members of cells with a home and
a second member are joined with their vectors.  A cell above ``block`` members
is dealt into parts, and every pair of parts is a run of its own, so a task
holds a few thousand vectors whatever the cell.  Links are counted inside the
run, each in the first table and cell where its two vectors meet, and leave it
as sums and as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import attach_sized, cut_lineage
from tracewell.llm.components import components

TABLES = 6
PROBES = 7  # neighbouring cells asked in each table
BLOCKS = 2  # groups of 8 coordinates in the name of a cell
SCALE = 1.5  # size of the lattice; a coordinate of a projected vector has variance 1
BLOCK = 2048
SEED = 11
MIX = np.uint64(0x9E3779B97F4A7C15)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if bin(signs).count("1") % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


NEAR = neighbours()


def _even_point(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row: the even integer points, or those moved by one half."""
    whole, half = _even_point(x), _even_point(x - 0.5) + 0.5
    first = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(first[:, None], whole, half)


def directions(dim: int, count: int) -> np.ndarray:
    """``count`` random directions, orthogonal as far as ``dim`` allows, scaled so that a projected coordinate has variance 1."""
    r = np.random.default_rng([SEED, dim])
    parts = []
    while sum(p.shape[1] for p in parts) < count:
        parts.append(np.linalg.qr(r.standard_normal((dim, dim)))[0])
    return np.concatenate(parts, 1)[:, :count] * np.sqrt(dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest entry first, so that nothing overflows."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cells(vectors: np.ndarray, tables: int, probes: int, blocks: int, scale: float) -> np.ndarray:
    """Names of the cells of each row, tables x (home, then the cheapest neighbours), as 64-bit numbers."""
    n, dim = vectors.shape
    x = unit(vectors) @ (directions(dim, tables * blocks * 8) / scale)
    keys = np.random.default_rng([SEED, 0]).integers(0, 1 << 63, (tables, blocks, 8), dtype=np.int64).view(np.uint64) | np.uint64(1)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        cost, name = np.zeros((n, 1)), np.full((n, 1), t, np.uint64) * MIX
        for b in range(blocks):
            at = (t * blocks + b) * 8
            point = decode(x[:, at : at + 8])
            step = 2.0 - 2.0 * ((x[:, at : at + 8] - point) @ NEAR.T)  # what a neighbour is farther away, squared
            best = np.argsort(step, axis=1, kind="stable")[:, :probes]
            own = ((2 * point).astype(np.int64).view(np.uint64) * keys[t, b]).sum(1, dtype=np.uint64)
            moved = ((2 * NEAR).astype(np.int64).view(np.uint64) * keys[t, b]).sum(1, dtype=np.uint64)
            step = np.concatenate([np.zeros((n, 1)), np.take_along_axis(step, best, 1)], 1)
            local = np.concatenate([own[:, None], own[:, None] + moved[best]], 1)
            # the cheapest sums of the groups so far
            both = (cost[:, :, None] + step[:, None, :]).reshape(n, -1)
            names = (name[:, :, None] + local[:, None, :]).reshape(n, -1)
            keep = np.argsort(both, axis=1, kind="stable")[:, : 1 + probes]
            cost, name = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
        name ^= name >> np.uint64(31)
        out[:, t] = name * MIX
    return out.reshape(n, -1).view(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(np.asarray(batch.column(column).offsets))
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def usable(vector: str) -> Column:
    """Neither null nor all zero, and only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _marked(distinct: DataFrame, tables: int, probes: int, blocks: int, scale: float) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_length(batch, "vector"):
                part = batch.take(pa.array(rows))
                names = cells(matrix(part.column("vector"), dim), tables, probes, blocks, scale)
                offsets = pa.array(np.arange(0, names.size + 1, names.shape[1], dtype=np.int32))
                columns = [part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(names.ravel()))], [*part.schema.names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields) + ", cells array<long>"
    return distinct.mapInArrow(kernel, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that links reach from each of ``n`` positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _pairs(u: np.ndarray, start: np.ndarray, end: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs in one run whose product is near or above ``least``; runs of two parts compare across them."""
    size = end - start
    inside = i[start] == j[start]
    short = np.flatnonzero(inside & (size <= 32))
    run = np.zeros(len(u), np.int64)  # how many rows of the same short run follow
    for k in short:
        run[start[k] : end[k]] = np.arange(size[k] - 1, -1, -1)
    for step in range(1, 32):
        a = np.flatnonzero(run >= step)
        if not len(a):
            break
        for at in range(0, len(a), 1 << 16):
            x = a[at : at + (1 << 16)]
            hit = x[np.einsum("ij,ij->i", u[x], u[x + step]) >= least]
            if len(hit):
                yield hit, hit + step
    for k in np.flatnonzero(~(inside & (size <= 32))):
        rows = np.arange(start[k], end[k])
        left, right = (rows, rows) if inside[k] else (rows[part[rows] == i[start[k]]], rows[part[rows] == j[start[k]]])
        for at in range(0, len(left), 256):
            x, y = np.nonzero(u[left[at : at + 256]] @ u[right].T >= least)
            x, y = left[at + x], right[y]
            if inside[k]:
                x, y = x[x < y], y[x < y]
            yield x, y


def meet(table: pa.Table, tables: int, probes: int, cosine: float) -> pa.RecordBatch:
    """Link sums and a forest from whole runs of members that met; ``table`` is sorted by run."""
    dim = len(table.column("vector")[0])
    column = lambda c: table.column(c).combine_chunks()
    number = lambda c: column(c).to_numpy(zero_copy_only=False)
    node, copies, code, t, part, i, j = (number(c) for c in ("node", "copies", "code", "t", "part", "i", "j"))
    names = number("code"), i, j, column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(node), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in names])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(node))
    u = unit(matrix(column("vector"), dim))
    cell = column("cells").flatten().to_numpy().reshape(len(node), tables, 1 + probes)
    home = cell[np.arange(len(node)), t, 0] == code
    links = np.zeros(len(node), np.int64)
    edges = [np.empty((0, 2), np.int64)]
    for a, b in _pairs(u, start, end, part, i, j, cosine - 1e-9):
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            keep = (home[x] | home[y]) & ((u[x] * u[y]).sum(1) >= cosine)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            edges.append(np.stack([x, y], 1))
            cx, cy = cell[x], cell[y]
            x_asks = (cx[:, :, 1:] == cy[:, :, :1]).any(2)
            y_asks = (cy[:, :, 1:] == cx[:, :, :1]).any(2)
            met = x_asks | y_asks | (cx[:, :, 0] == cy[:, :, 0])
            first = met.argmax(1) == t[x]
            # two asking each other meet twice; the meeting where the smaller one asks counts
            row = np.arange(len(x))
            twice = x_asks[row, t[x]] & y_asks[row, t[x]] & (home[x] != home[y])
            first &= ~twice | (home[y] == (node[x] < node[y]))
            np.add.at(links, x[first], copies[y[first]])
            np.add.at(links, y[first], copies[x[first]])
    ids, at = np.unique(node, return_inverse=True)
    pairs = np.concatenate(edges)
    root = forest(len(ids), at[pairs[:, 0]], at[pairs[:, 1]])
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, at, links)
    keep = (total > 0) | (root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, ids[root], total)], ["a", "b", "links"])


def _linked(marked: DataFrame, tables: int, probes: int, cosine: float, block: int) -> DataFrame:
    """(a, b, links): forest edges between nodes, and the copies of other vectors that a links to, in parts."""
    width = 1 + probes
    name = (F.col("pos") % width == 0).alias("home")
    spread = marked.select("label", F.size("vector").alias("dim"), "node", F.posexplode("cells").alias("pos", "code"))
    spread = spread.select("label", "dim", "node", "code", F.floor(F.col("pos") / width).cast("int").alias("t"), name)
    live = spread.groupBy("label", "dim", "code").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("n"))
    live = live.where("homes > 0 AND n > 1").select("label", "dim", "code", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    keys = ["label", "dim", "code"]
    met = spread.drop("home").join(cut_lineage(live), keys)
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = met.join(marked.select("node", "copies", "vector", "cells"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    runs = rows.select(*keys, "node", "copies", "vector", "cells", "t", "part", other)
    runs = runs.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")
    order = [*keys, "i", "j"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                if sum(b.num_rows for b in held) < 8192:
                    continue
                table = pa.Table.from_batches(held)
                cut = _last_run(table, order)
                if cut:
                    yield from _per_length(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _per_length(pa.Table.from_batches(held))

    def _per_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims):
            yield meet(table.filter(pa.array(dims == dim)), tables, probes, cosine)

    return runs.repartition(*order).sortWithinPartitions(*order).mapInArrow(kernel, "a long, b long, links long")


def _last_run(table: pa.Table, names: list[str]) -> int:
    """Where the last run of equal names begins."""
    last = np.ones(table.num_rows, bool)
    for c in names:
        x = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        last &= x == x[-1]
    other = np.flatnonzero(~last)
    return int(other[-1]) + 1 if len(other) else 0


def vector_links(
    rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", cosine: float = 0.98,
    tables: int = TABLES, probes: int = PROBES, blocks: int = BLOCKS, scale: float = SCALE, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows``.

    Rows with equal labels are linked if the cosine of their vectors, in double
    precision, is at least ``cosine`` and they meet in some table (two vectors at
    exactly 0.98 miss each other in all six tables about once in two thousand).
    Equal vectors are always linked.  component_id is the smallest id that links
    reach, the row's own included; kept says that it is the row's own.

    Null labels, null, empty or zero vectors and vectors with null or non-finite
    components link with nothing; nor do vectors of different lengths.  Rows that
    repeat an id are separate rows; null ids don't count for the smallest unless
    there is no other, and such a row is kept if all ids it reaches are null.
    Vectors may have any length; other columns, whatever their names, are
    ignored.  An empty table gives an empty one.
    """
    source = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    source = source.withColumn("ok", F.col("label").isNotNull() & usable("vector"))
    # two hashes with different seeds stand for label and vector
    source = source.withColumns({"h": F.xxhash64("label", "vector"), "k": F.xxhash64(F.lit(SEED), "vector", "label")})
    distinct = source.where("ok").groupBy("h", "k").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")
    )
    distinct = distinct.withColumn("node", F.monotonically_increasing_id())
    marked = cut_lineage(_marked(distinct, tables, probes, blocks, scale))
    linked = cut_lineage(_linked(marked, tables, probes, cosine, block))
    groups = components(linked.select("a", "b"))
    counted = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = marked.select("h", "k", "node", "copies", "first_id").join(groups, "node", "left").join(counted, "node", "left")
    nodes = cut_lineage(nodes.withColumns({"root": F.coalesce("root", "node"), "n_links": F.col("copies") - 1 + F.coalesce("links", F.lit(0))}))
    lowest = cut_lineage(nodes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")))
    facts = cut_lineage(attach_sized(nodes.select("h", "k", "root", "n_links", "copies"), lowest, ["root"], "size").drop("root", "size"))
    good = attach_sized(source.where("ok").select("vec_id", "h", "k"), facts, ["h", "k"], "copies")
    lone = source.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
