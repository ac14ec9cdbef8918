"""Fourier transforms of whole traces, of any length, over many tasks.

A trace of M = R * C points is a matrix of R rows and C columns, filled row by
row.  Its transform takes four steps: transform the columns, turn every entry by
a twiddle factor, transpose, transform the rows.  A task holds a block of columns
or a block of rows, at most ``CELLS`` numbers; the transposition is a shuffle of
the pieces that a block of columns and a block of rows share.  Going back takes
the same steps in reverse, and since the spectrum is only multiplied in between,
it is never put into order.

Lengths other than powers of two, as Fourier resampling needs them, are chirp
transforms: a transform of N points is a convolution with a chirp, and that is a
product of two transforms of at least twice the length.

Blocks that are small beside ``BUNDLE`` are transformed in bundles of about so many
numbers, those of one size side by side in one array.

Traces that fit a task take one group and NumPy's transform.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, join_facts, spread_facts
from tracewell.operators.recurrence import pack
from tracewell.session import cut_lineage

CELLS = 1 << 20  # complex numbers that a task holds; a power of two
BUNDLE = 1 << 16  # numbers of small blocks that a task takes at once
Gain = Callable[[np.ndarray, dict], np.ndarray]


@dataclass(frozen=True)
class Grid:
    """A matrix of ``rows`` x ``cols`` = ``size`` points, in blocks of ``wide`` columns or ``high`` rows."""

    size: int
    cells: int

    @property
    def rows(self) -> int:
        return 1 << (self.size.bit_length() - 1) // 2

    @property
    def cols(self) -> int:
        return self.size // self.rows

    @property
    def wide(self) -> int:
        return max(1, min(self.cols, self.cells // self.rows))

    @property
    def high(self) -> int:
        return max(1, min(self.rows, self.cells // self.cols))

    def points(self, first: np.ndarray) -> np.ndarray:
        """Positions in the trace of the blocks of columns that start at ``first``."""
        return first[:, None, None] + np.arange(self.rows, dtype=np.int64)[:, None] * self.cols + np.arange(self.wide, dtype=np.int64)

    def frequencies(self, first: int) -> np.ndarray:
        """Positions in the spectrum of the block of rows that starts at ``first``."""
        return first + np.arange(self.high, dtype=np.int64)[:, None] + self.rows * np.arange(self.cols, dtype=np.int64)

    def twiddle(self, rows: np.ndarray, cols: np.ndarray, sign: int) -> np.ndarray:
        return np.exp(sign * 2j * np.pi / self.size * (rows * cols))


def size_for(points: Column) -> Column:
    """The smallest power of two, from 2 on, that is at least ``points``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(points, F.lit(2)) - 1)))


def chirp(at: np.ndarray, period: int, sign: int) -> np.ndarray:
    """exp(sign * pi * i * at^2 / period), with the square reduced in whole numbers (positions below 3e9)."""
    return np.exp(sign * 1j * np.pi / period * ((at * at) % (2 * period)))


@dataclass(frozen=True)
class Chirp:
    """The transform sum x[n] exp(sign 2 pi i n k / period) for n < taken and k < given."""

    period: int | np.ndarray
    sign: int
    taken: int | np.ndarray
    given: int | np.ndarray

    def enter(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < self.taken, x * chirp(at, self.period, self.sign), 0)

    def kernel(self, at: np.ndarray, size: int) -> np.ndarray:
        lag = np.where(at < self.given, at, at - size)
        return np.where((at < self.given) | (lag > -self.taken), chirp(np.abs(lag), self.period, -self.sign), 0)

    def leave(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < self.given, c * chirp(at, self.period, self.sign), 0)


PIECE = "_b long, _r long, _h long, _c long, _w long, _re array<double>, _im array<double>, _kre array<double>, _kim array<double>"


def _lists(x: np.ndarray | None, sizes: np.ndarray) -> pa.Array:
    """Consecutive parts of ``x`` as lists, or nulls."""
    if x is None:
        return pa.nulls(len(sizes), pa.list_(pa.float64()))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, dtype=float).ravel()))


def _pieces(same: pa.Table, b, r, h, c, w, x: np.ndarray, k: np.ndarray | None = None) -> pa.Table:
    """Pieces as rows; ``same`` holds the columns of the trace of each, ``x`` and ``k`` their numbers one after the other."""
    n = same.num_rows
    places = [np.broadcast_to(np.asarray(v, np.int64), n) for v in (b, r, h, c, w)]
    imag = lambda m: m.imag if m is not None and np.iscomplexobj(m) else None
    lists = [_lists(m, places[2] * places[4]) for m in (x.real, imag(x), None if k is None else k.real, imag(k))]
    return pa.table([*same.columns, *map(pa.array, places), *lists], names=[*same.column_names, *[v.split()[0] for v in PIECE.split(", ")]])


def _gather(table: pa.Table, at: np.ndarray, shape: tuple[int, int, int], r0: np.ndarray, c0: np.ndarray, re: str = "_re", im: str = "_im") -> np.ndarray:
    """The blocks that pieces make up, piece j in block ``at[j]``; points that no piece has are zero."""
    out = np.zeros(shape, complex)
    r, c, w = (table.column(n).to_numpy() for n in ("_r", "_c", "_w"))
    for name, part in ((re, out.real), (im, out.imag)):
        lists = table.column(name)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        values = pc.list_flatten(lists).to_numpy()
        if len(values):
            j = np.repeat(np.arange(len(sizes)), sizes)
            y, x = np.divmod(np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), w[j])
            part[at[j], (r - r0)[j] + y, (c - c0)[j] + x] = values
    return out


@dataclass(frozen=True)
class Blocks:
    """Blocks of one size side by side: a row of ``same`` and a place ``first`` each, and the numbers."""

    same: pa.Table
    grid: Grid
    first: np.ndarray
    x: np.ndarray
    k: np.ndarray | None = None

    def own(self, name: str) -> np.ndarray:
        """A number of each block's trace, to go with the blocks."""
        return self.same.column(name).to_numpy()[:, None, None]

    def repeated(self, times: int) -> pa.Table:
        return self.same.take(pa.array(np.repeat(np.arange(len(self.first)), times)))


class Steps:
    """The kernels of one pass, for the traces whose facts are in every row of a group."""

    def __init__(self, names: Sequence[str], key: Sequence[str], cells: int, chunk: int):
        self.names, self.key, self.cells, self.chunk = list(names), list(key), cells, chunk

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of samples as pieces of blocks of columns."""
        for batch in batches:
            table, step = pa.Table.from_batches([batch]), max(1, BUNDLE // self.chunk)
            for lo in range(0, table.num_rows, step):
                part = table.slice(lo, step)
                sizes = part.column("_size").to_numpy()
                for size in np.unique(sizes).tolist():
                    yield from self._dealt(part.filter(pa.array(sizes == size)), Grid(size, self.cells)).to_batches()

    def _dealt(self, table: pa.Table, grid: Grid) -> pa.Table:
        n, chunks, lengths = pc.list_value_length(table.column("_v")).to_numpy(), table.column("_chunk").to_numpy(), table.column("_len").to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        r, c = np.divmod(chunks[row] * self.chunk + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), grid.cols)
        # a piece is what follows each other in one row of a block
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(r) != 0) | (np.diff(c // grid.wide) != 0)
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(row)))
        # blocks behind the end of a short trace have no samples, but a part in the chirp
        first = -(-lengths // grid.wide)
        empty = np.where(chunks == 0, np.maximum(0, grid.cols // grid.wide - first), 0)
        behind = np.repeat(np.arange(len(n)), empty)
        b = first[behind] + np.arange(len(behind)) - np.repeat(np.cumsum(empty) - empty, empty)
        none = np.zeros(len(behind), np.int64)
        both = lambda x, y: np.concatenate([x, y])
        same = table.select(self.names).take(pa.array(both(row[head], behind)))
        v = pc.list_flatten(table.column("_v")).to_numpy()
        return _pieces(same, both(c[head] // grid.wide, b), both(r[head], none), both(np.ones(len(head), np.int64), none), both(c[head], b * grid.wide), both(sizes, none), v)

    def blocks(self, table: pa.Table, of_rows: bool = False, kernels: bool = False) -> Iterator[Blocks]:
        """The blocks of columns (or of rows) in a group, those of one size together."""
        b = table.column("_b").to_numpy()
        codes = [table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in self.key]
        _, head, which = np.unique(np.stack([b, *codes], axis=1), axis=0, return_index=True, return_inverse=True)
        which, sizes = which.ravel(), table.column("_size").to_numpy()[head]
        for size in np.unique(sizes).tolist():
            grid, mine = Grid(size, self.cells), np.flatnonzero(sizes == size)
            place = np.full(len(head), -1)
            place[mine] = np.arange(len(mine))
            rows = np.flatnonzero(place[which] >= 0)
            part, at = table.take(pa.array(rows)), place[which[rows]]
            step, shape = (grid.high, (grid.high, grid.cols)) if of_rows else (grid.wide, (grid.rows, grid.wide))
            r0, c0 = (b[rows] * step, 0) if of_rows else (0, b[rows] * step)
            numbers = [_gather(part, at, (len(mine), *shape), r0, c0, *f) for f in (("_re", "_im"), ("_kre", "_kim"))[: 1 + kernels]]
            yield Blocks(table.select(self.names).take(pa.array(head[mine])), grid, b[head[mine]] * step, *numbers)

    def out_of_columns(self, blocks: Blocks, x: np.ndarray, k: np.ndarray | None = None) -> pa.Table:
        """Columns transformed and turned, as pieces of blocks of rows."""
        grid, first = blocks.grid, blocks.first
        turn = grid.twiddle(np.arange(grid.rows)[:, None], first[:, None, None] + np.arange(grid.wide), -1)
        both = [np.fft.fft(m, axis=1) * turn for m in (x, k) if m is not None]
        r, n = np.arange(0, grid.rows, grid.high), grid.rows // grid.high
        return _pieces(blocks.repeated(n), np.tile(r // grid.high, len(first)), np.tile(r, len(first)), grid.high, np.repeat(first, n), grid.wide, *both)

    def through_rows(self, table: pa.Table, gain: Gain | None) -> pa.Table:
        """Rows transformed, multiplied by the gain or by the chirp's own transform, and back to blocks of columns."""
        out = []
        for blocks in self.blocks(table, of_rows=True, kernels=gain is None):
            grid, first = blocks.grid, blocks.first
            x = np.fft.fft(blocks.x, axis=2)
            if gain is None:
                x *= np.fft.fft(blocks.k, axis=2)
            else:
                for j, facts in enumerate(blocks.same.to_pylist()):
                    x[j] *= two_sided(gain, grid.frequencies(int(first[j])), grid.size, facts)
            x = np.fft.ifft(x, axis=2) * grid.twiddle(first[:, None, None] + np.arange(grid.high)[:, None], np.arange(grid.cols), 1)
            c, n = np.arange(0, grid.cols, grid.wide), grid.cols // grid.wide
            x = x.reshape(len(first), grid.high, n, grid.wide).transpose(0, 2, 1, 3)
            out.append(_pieces(blocks.repeated(n), np.tile(c // grid.wide, len(first)), np.repeat(first, n), grid.high, np.tile(c, len(first)), grid.wide, x))
        return pa.concat_tables(out)

    def samples(self, blocks: Blocks, x: np.ndarray, given: np.ndarray) -> pa.Table:
        """Rows (first position, values) of blocks of columns."""
        at = blocks.grid.points(blocks.first)
        inside = at < given
        sizes = inside.sum(axis=2).ravel()
        kept = np.flatnonzero(sizes)
        same = blocks.same.take(pa.array(kept // blocks.grid.rows))
        return pa.table([*same.columns, pa.array(at[:, :, 0].ravel()[kept]), _lists(x[inside], sizes[kept])], names=[*same.column_names, "_at", "_v"])


def _bundled(pieces: DataFrame, key: Sequence[str], cells: int, points: int):
    """Groups of whole blocks: large ones apart, small ones in bundles of about ``BUNDLE`` numbers."""
    block = F.xxhash64(*key, "_b")
    bundles = max(1, -(-points // BUNDLE))
    small = F.greatest(F.lit(float(cells)), F.sqrt("_size")) * 16 <= BUNDLE
    return pieces.withColumn("_bundle", F.when(small, F.pmod(block, F.lit(bundles))).otherwise(block)).groupBy("_bundle")


def two_sided(gain: Gain, k: np.ndarray, size: int, facts: dict) -> np.ndarray:
    """The gain at places of a whole spectrum; the upper half mirrors the lower one, both ends are real."""
    low = np.minimum(k, size - k)
    g = gain(low / size, facts).astype(complex)
    g = np.where(k > size // 2, g.conj(), g)
    return np.where((k == 0) | (2 * k == size), g.real, g)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kind[n]}" for n in names)


def _laid_out(samples: DataFrame, facts: DataFrame, key: Sequence[str], value: str, index: str, chunk: int) -> DataFrame:
    """Chunks of samples with the facts of their trace (``_len``, ``_size`` and more), written once."""
    return cut_lineage(join_facts(pack(samples, key, value, index, chunk), spread_facts(facts, "_len", chunk), [*key, "_chunk"], "inner"))


def _points(rows: DataFrame) -> int:
    """Points of all padded traces."""
    return rows.where("_chunk = 0").agg(F.sum("_size")).first()[0] or 0


def _whole(rows: DataFrame, names: Sequence[str], key: Sequence[str], each: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """(names, _at, _v) of traces that fit a task."""

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        first = {n: table.column(n).slice(0, 1) for n in names}
        out = each(table.column("_v").combine_chunks().flatten().to_numpy(), {n: x[0].as_py() for n, x in first.items()})
        return pa.table({**first, "_at": pa.array([0], pa.int64()), "_v": pa.array([out], pa.list_(pa.float64()))})

    return rows.groupBy(*key).applyInArrow(kernel, f"{_fields(rows, names)}, _at long, _v array<double>")


def _samples(parts: DataFrame, key: Sequence[str], value: str, index: str) -> DataFrame:
    rows = parts.select(*key, "_at", F.posexplode("_v").alias("_pos", value))
    return rows.select(*key, (F.col("_at") + F.col("_pos")).alias(index), value)


def fourier_filter(samples: DataFrame, key: Sequence[str], gain: Gain, facts: DataFrame, value: str = "v", index: str = "i",
                   chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """(key, index, value): the spectrum of every trace times ``gain(frequency, facts)``.

    The trace is padded with zeros to a power of two of at least twice its
    length; frequencies are in parts of the sampling rate, 0 to 1/2.  ``facts``
    has one row per trace with its length ``_len`` and whatever the gain needs;
    traces without a row are left out.  Null and NaN values count as 0.
    """
    facts = facts.withColumn("_size", size_for(2 * F.col("_len")))
    names = facts.columns
    chunk = 1 << (chunk.bit_length() - 1)  # so that chunks and rows of the matrix fit each other
    steps = Steps(names, key, cells, chunk)
    rows = _laid_out(samples, facts, key, value, index, chunk)

    def short(v: np.ndarray, own: dict) -> np.ndarray:
        size = own["_size"]
        half = np.arange(size // 2 + 1)
        return np.fft.irfft(np.fft.rfft(v, size) * two_sided(gain, half, size, own), size)[: own["_len"]]

    out = _whole(rows.where(F.col("_size") <= cells), names, key, short)
    large = rows.where(F.col("_size") > cells)
    points = _points(large)
    if points:
        schema = f"{_fields(rows, names)}, {PIECE}"

        def enter(table: pa.Table) -> pa.Table:
            return pa.concat_tables([steps.out_of_columns(b, b.x) for b in steps.blocks(table)])

        def leave(table: pa.Table) -> pa.Table:
            return pa.concat_tables([steps.samples(b, np.fft.ifft(b.x, axis=1).real, b.own("_len")) for b in steps.blocks(table)])

        pieces = large.mapInArrow(steps.deal, schema)
        pieces = _bundled(pieces, key, cells, points).applyInArrow(enter, schema)
        pieces = _bundled(pieces, key, cells, points).applyInArrow(lambda t: steps.through_rows(t, gain), schema)
        out = out.unionByName(_bundled(pieces, key, cells, points).applyInArrow(leave, f"{_fields(rows, names)}, _at long, _v array<double>"))
    return _samples(out, key, value, index)


def resampled(v: np.ndarray, num: int) -> np.ndarray:
    """``num`` points of the trigonometric polynomial through a trace."""
    n = len(v)
    if not num:
        return np.zeros(0)
    kept = min(n, num) // 2 + 1
    x = np.fft.rfft(v)[:kept] * _weights(np.arange(kept), n, num)
    # half the weight, as the inverse adds the mirrored half; where that meets the middle, only once
    x[1:] /= 2
    if num % 2 == 0 and kept == num // 2 + 1:
        x[-1] *= 2
    return np.fft.irfft(x, num) * (num / n)


def _weights(k: np.ndarray, n: int, num: int) -> np.ndarray:
    """What a place of the lower half of the spectrum counts for both halves; beyond the new middle nothing."""
    last = np.minimum(n, num) // 2
    middle = (2 * k == n) & (num >= n)
    return np.where(k > last, 0.0, np.where((k == 0) | middle, 1.0, 2.0))


def fourier_resample(samples: DataFrame, key: Sequence[str], sr: float, target: float = 40.0, value: str = "v", index: str = "i",
                     chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """Every trace at ``floor(length * target / sr)`` points, by the Fourier transform of the whole trace.

    The trace counts as one period, so its ends meet; the points are evenly
    spaced over it.  Unchanged when the rates agree.  Null and NaN values count
    as 0; a trace too short for one point gives no rows.
    """
    if sr == target:
        return samples.select(*key, index, value)
    lengths = samples.groupBy(*key).agg((F.max(index) + 1).alias("_len"))
    facts = lengths.withColumn("_num", F.floor(F.col("_len") * F.lit(float(target)) / F.lit(float(sr))).cast("long")).where("_num > 0")
    # the two chirp transforms: from the trace to the lower half of its spectrum, and from there to the new points
    half = F.floor(F.least("_len", "_num") / 2) + 1
    need = F.greatest(F.col("_len"), F.col("_num")) + half
    facts = facts.withColumn("_size", size_for(need))
    names = facts.columns
    chunk = 1 << (chunk.bit_length() - 1)  # so that chunks and rows of the matrix fit each other
    steps = Steps(names, key, cells, chunk)
    rows = _laid_out(samples, facts, key, value, index, chunk)
    out = _whole(rows.where(F.col("_size") <= cells), names, key, lambda v, own: resampled(v, own["_num"]))
    large = rows.where(F.col("_size") > cells)
    points = _points(large)
    if points:
        schema = f"{_fields(rows, names)}, {PIECE}"

        def chirps(b: Blocks) -> tuple[Chirp, Chirp]:
            n, num = b.own("_len"), b.own("_num")
            half = np.minimum(n, num) // 2 + 1
            return Chirp(n, -1, n, half), Chirp(num, 1, half, num)

        def entered(b: Blocks) -> pa.Table:
            at, there = b.grid.points(b.first), chirps(b)[0]
            return steps.out_of_columns(b, there.enter(b.x, at), there.kernel(at, b.grid.size))

        def turned(b: Blocks) -> pa.Table:
            at, (there, back) = b.grid.points(b.first), chirps(b)
            x = there.leave(np.fft.ifft(b.x, axis=1), at) * _weights(at, b.own("_len"), b.own("_num")) / b.own("_len")
            return steps.out_of_columns(b, back.enter(x, at), back.kernel(at, b.grid.size))

        def left(b: Blocks) -> pa.Table:
            x = chirps(b)[1].leave(np.fft.ifft(b.x, axis=1), b.grid.points(b.first))
            return steps.samples(b, x.real, b.own("_num"))

        each = lambda step: lambda table: pa.concat_tables([step(b) for b in steps.blocks(table)])
        pieces = large.mapInArrow(steps.deal, schema)
        for step in (entered, turned):
            pieces = _bundled(pieces, key, cells, points).applyInArrow(each(step), schema)
            pieces = _bundled(pieces, key, cells, points).applyInArrow(lambda t: steps.through_rows(t, None), schema)
        out = out.unionByName(_bundled(pieces, key, cells, points).applyInArrow(each(left), f"{_fields(rows, names)}, _at long, _v array<double>"))
    return _samples(out, key, value, index)
