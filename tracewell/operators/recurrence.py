"""Linear recurrences over traces of any length: an associative scan over chunks.

A linear filter with feedback is a state that every sample multiplies and adds
to.  Over a whole chunk this is one affine map: the state at its end is a power
of the matrix times the state at its start, plus what the chunk's own samples
leave behind.  Affine maps compose, so the state at the start of every chunk is a
prefix product over one small row per chunk:

1. samples are laid out once, one row per chunk, with what the chunk leaves;
2. rows of up to ``FAN`` consecutive chunks are folded to one, those again, until
   one is left for each trace, and the starts go down the same tree;
3. every chunk runs the recurrence from its exact start.

Nothing is cut off, so the result doesn't depend on the chunk length, and no
task sees more than a chunk or ``FAN`` small rows, however long the trace.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, chunk_of, join_facts
from tracewell.session import cut_lineage

FAN = 256
STRIDE = 64  # samples that a chunk takes at a time, as one matrix product


@dataclass(frozen=True)
class System:
    """s' = a s + b x and y = c s + d x, with s from before the sample; c may have several rows (outputs)."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def then(self, after: System) -> System:
        """This system's (single) output fed into ``after``."""
        k = len(self.a) + len(after.a)
        a = np.zeros((k, k))
        m = len(self.a)
        a[:m, :m], a[m:, m:], a[m:, :m] = self.a, after.a, np.outer(after.b, self.c[0])
        return System(a, np.append(self.b, after.b * self.d[0]), np.hstack([np.outer(after.d, self.c[0]), after.c]), after.d * self.d[0])

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    @cached_property
    def strides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a stride of samples and its start state give: (outputs of samples, of state; end state of samples, of state)."""
        k, p = len(self.a), len(self.d)
        step = [np.eye(k)]
        for _ in range(STRIDE):
            step.append(self.a @ step[-1])
        of_state = np.concatenate([self.c @ step[j] for j in range(STRIDE)])
        response = [self.d, *[self.c @ step[j] @ self.b for j in range(STRIDE - 1)]]
        of_samples = np.zeros((STRIDE * p, STRIDE))
        for j in range(STRIDE):
            for i in range(j + 1):
                of_samples[j * p : (j + 1) * p, i] = response[j - i]
        return of_samples, of_state, np.stack([step[STRIDE - 1 - i] @ self.b for i in range(STRIDE)], 1), step[STRIDE]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs (samples x outputs) and the state after the last sample."""
        of_samples, of_state, leaves, over = self.strides
        p, whole = len(self.d), len(x) // STRIDE
        blocks = x[: whole * STRIDE].reshape(whole, STRIDE)
        left = blocks @ leaves.T
        starts = np.empty((whole + 1, len(state)))
        starts[0] = state
        for j in range(whole):
            starts[j + 1] = over @ starts[j] + left[j]
        y = blocks @ of_samples.T + starts[:-1] @ of_state.T
        rest, state = x[whole * STRIDE :], starts[-1]
        n = len(rest)
        tail = of_samples[: n * p, :n] @ rest + of_state[: n * p] @ state
        end = self.power(n) @ state + leaves[:, STRIDE - n :] @ rest if n else state
        return np.concatenate([y.reshape(-1, p), tail.reshape(-1, p)]), end


def exponential_means(*lengths: int) -> System:
    """One output for each length n: s = (1 - 1/n) s + x / n."""
    keep, add = np.diag([1 - 1 / n for n in lengths]), np.array([1 / n for n in lengths])
    return System(keep, add, keep, add)


def butterworth_sections(lo: float, hi: float, sr: float, order: int) -> np.ndarray:
    """Digital Butterworth band-pass as second-order sections (b0, b1, b2, a1, a2), by the bilinear transform.

    The upper corner stays below half the sampling rate.
    """
    wl, wh = math.tan(math.pi * lo / sr), math.tan(math.pi * min(hi, sr / 2 * 0.999) / sr)
    centre, width = math.sqrt(wl * wh), wh - wl
    at = 2 * math.atan(centre)  # the angle that the centre has on the unit circle
    z = np.exp(-1j * at)
    sections = []
    for k in range((order + 1) // 2):
        pole = np.exp(1j * np.pi * (2 * k + 1 + order) / (2 * order)) * width / 2
        root = np.sqrt(pole * pole - centre * centre + 0j)
        pair = [(1 + s) / (1 - s) for s in (pole + root, pole - root)]
        # a real pole of the prototype gives one section, a complex one and its conjugate give two
        for one, two in [tuple(pair)] if 2 * k + 1 == order else [(p, p.conjugate()) for p in pair]:
            a1, a2 = -(one + two).real, (one * two).real
            gain = abs(1 + a1 * z + a2 * z * z) / abs(1 - z * z)
            sections.append((gain, 0.0, -gain, a1, a2))
    return np.array(sections)


def section(b0: float, b1: float, b2: float, a1: float, a2: float) -> System:
    """One second-order section.

    A pair of complex poles is a scaled rotation, whose powers lose no digits
    however close the poles are to one; real poles are taken in transposed direct
    form.
    """
    n1, n2 = b1 - a1 * b0, b2 - a2 * b0
    real, turn = -a1 / 2, a2 - a1 * a1 / 4
    if turn <= 0:
        return System(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([n1, n2]), np.array([[1.0, 0.0]]), np.array([b0]))
    turn = math.sqrt(turn)
    return System(np.array([[real, turn], [-turn, real]]), np.array([1.0, 0.0]), np.array([[n1, -(n2 + n1 * real) / turn]]), np.array([b0]))


def cascade(sections: np.ndarray) -> System:
    """Second-order sections (b0, b1, b2, a1, a2) one after the other."""
    out = section(*sections[0])
    for one in sections[1:]:
        out = out.then(section(*one))
    return out


def pack(samples: DataFrame, key: Sequence[str], value: str = "v", index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """One row per chunk: key, ``_chunk``, ``_v`` (its values in order; null and NaN count as 0)."""
    clean = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = samples.select(*key, chunk_of(index, chunk).alias("_chunk"), F.struct(F.col(index).alias("i"), clean.alias("v")).alias("_s"))
    return rows.groupBy(*key, "_chunk").agg(F.sort_array(F.collect_list("_s"))["v"].alias("_v"))


def _per_chunk(packed: DataFrame, schema: str, each) -> DataFrame:
    """``each(row's arrays)`` -> new columns, for every chunk; key columns pass through."""
    names = [c.split()[0] for c in schema.split(", ")]
    same = [f for f in packed.schema.fields if f.name not in names and f.name not in ("_v", "_s")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                new = [each(part.slice(r, 1)) for r in range(part.num_rows)]
                columns = [pa.array([x[k] for x in new]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in same], *columns], [*[f.name for f in same], *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in same)
    return packed.mapInArrow(kernel, f"{kept}, {schema}")


def _array(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def _starts(ends: DataFrame, key: Sequence[str], system: System, reverse: bool, fan: int) -> DataFrame | None:
    """(key, _chunk, _s): the state at the start of every chunk of traces with several; None if there are none.

    ``ends``: key, _chunk, _n (samples of the chunk), _end (state it leaves from a zero start).
    """
    several = ends.where("_chunk > 0").select(*key).distinct()
    nodes = cut_lineage(join_facts(ends, several.withColumn("_several", F.lit(True)), key, "inner").drop("_several").withColumnRenamed("_chunk", "_pos"))
    if not nodes.head(1):
        return None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields if f.name in key)
    schema = f"{fields}, _pos long, _up long, _before long, _rel array<double>, _n long, _end array<double>"

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_pos", "descending" if reverse else "ascending")])
        n, end = table.column("_n").to_pylist(), table.column("_end").to_pylist()
        state, seen, rel, before = np.zeros(len(system.a)), 0, [], []
        for size, left in zip(n, end, strict=True):
            rel.append(state.tolist())
            before.append(seen)
            state, seen = system.power(size) @ state + np.array(left), seen + size
        # the last row carries what the whole group does
        last = [None] * (len(n) - 1)
        return pa.table({
            **{k: table.column(k) for k in key}, "_pos": table.column("_pos"), "_up": table.column("_up"), "_before": pa.array(before, pa.int64()),
            "_rel": pa.array(rel, pa.list_(pa.float64())), "_n": pa.array([*last, seen], pa.int64()), "_end": pa.array([*last, state.tolist()], pa.list_(pa.float64())),
        })

    levels = []
    while True:
        grouped = nodes.withColumn("_up", F.floor(F.col("_pos") / fan).cast("bigint"))
        # fresh column identities, as every level comes from the one below
        levels.append(cut_lineage(grouped.groupBy(*key, "_up").applyInArrow(fold, schema)))
        if not levels[-1].where("_up > 0").head(1):
            break
        nodes = levels[-1].where("_n IS NOT NULL").select(*key, F.col("_up").alias("_pos"), "_n", "_end")
    starts = levels[-1].select(*key, "_pos", F.col("_rel").alias("_s"))
    for level in reversed(levels[:-1]):
        above = starts.select(*key, F.col("_pos").alias("_up"), F.col("_s").alias("_above"))
        both = join_facts(level.select(*key, "_pos", "_up", "_before", "_rel"), above, [*key, "_up"], "inner")

        def shift(row: pa.RecordBatch) -> tuple[np.ndarray]:
            return (system.power(row.column("_before")[0].as_py()) @ _array(row, "_above") + _array(row, "_rel"),)

        starts = _per_chunk(both, "_s array<double>", shift).select(*key, "_pos", "_s")
    return starts.withColumnRenamed("_pos", "_chunk")


def scan(packed: DataFrame, key: Sequence[str], system: System, reverse: bool = False, fan: int = FAN,
         feed: Callable[[np.ndarray], np.ndarray] = np.asarray) -> DataFrame:
    """Run ``system`` along every trace, from rest; ``packed`` comes from ``pack`` or another scan.

    Returns key, ``_chunk``, ``_v`` (the input) and ``_y`` (the outputs, one
    sample's after the other).  ``reverse`` runs from the end of the trace;
    ``feed`` turns a chunk's values into what the system takes.
    """
    way = slice(None, None, -1 if reverse else 1)
    rest = np.zeros(len(system.a))
    laid_out = cut_lineage(_per_chunk(packed, "_v array<double>, _n long, _end array<double>", lambda r: (v := _array(r, "_v"), len(v), system.run(feed(v)[way], rest)[1])))
    starts = _starts(laid_out.drop("_v"), key, system, reverse, fan)
    rows = laid_out.drop("_n", "_end")
    if starts is None:
        rows = rows.withColumn("_s", F.array().cast("array<double>"))
    else:
        rows = join_facts(rows, starts, [*key, "_chunk"], "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<double>")))

    def run(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v, s = _array(row, "_v"), _array(row, "_s")
        return v, system.run(feed(v)[way], s if len(s) else rest)[0][way].ravel()

    return _per_chunk(rows, "_v array<double>, _y array<double>", run)


def unpack(packed: DataFrame, key: Sequence[str], columns: dict[str, str], index: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Samples again: ``columns`` names the array expression of each value; keeps ``_chunk``."""
    zipped = F.arrays_zip(*[F.expr(e).alias(n) for n, e in columns.items()])
    rows = packed.select(*key, "_chunk", F.posexplode(zipped).alias("_at", "_row"))
    return rows.select(*key, "_chunk", (F.col("_chunk") * chunk + F.col("_at")).alias(index), *[F.col(f"_row.{n}").alias(n) for n in columns])


def filtered(samples: DataFrame, key: Sequence[str], system: System, both_ways: bool = False, value: str = "v", index: str = "i",
             chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, index, value) after ``system``; ``both_ways`` runs it again from the end, which cancels its delay.

    Positions must run from 0 without gaps, as ``add_index`` numbers them.  Null
    and NaN values count as 0.
    """
    out = scan(pack(samples, key, value, index, chunk), key, system, fan=fan).select(*key, "_chunk", F.col("_y").alias("_v"))
    if both_ways:
        out = scan(out, key, system, True, fan).select(*key, "_chunk", F.col("_y").alias("_v"))
    return unpack(out, key, {value: "_v"}, index, chunk).drop("_chunk")
