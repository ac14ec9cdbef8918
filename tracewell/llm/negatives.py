"""Hard negatives by slots of scores.

The scores of an anchor's positives are the upper limits of its windows.  All
windows of an anchor overlap, so they aren't searched one by one: the distinct
limits, descending, split the scores into disjoint slots, every slot keeps its
best few rows, and the window of a positive is answered from its own slot and
the ones after it, merged in descending order.  A window's lower limit only
cuts that merged list off.

On Spark: anchors and rows are dealt into blocks and every block of anchors
meets every block of rows once, in a task that holds the anchors and streams the
rows past them.  Such a task is a combiner: it keeps the best few of a slot, with
a rising bar below which scores aren't looked at again.  Its lists are merged by
ranking within (anchor, slot), which Spark also limits before the shuffle.  The
positives come from the same kernel with one slot and blocks of one label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage
from tracewell.operators.ordered import attach_facts

POSITIVES = 5
NEGATIVES = 5
MARGIN = 5  # a negative scores at least (MARGIN - 1) / MARGIN of its positive
ANCHORS = 8192  # anchors that a task holds
ROWS = 8192  # rows of a block at least; there are at most BLOCKS blocks, which only stream by
BLOCKS = 1024
EXACT = float(1 << 53)


def quantised(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of a list column of equal lengths, as doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256.0 * x), posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond a long they are the largest or smallest long."""
    top = max(np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1], 1.0)
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Slots:
    """The best ``keep`` rows of every slot of every anchor, by score descending and then id.

    ``limits`` (anchors x slots) descend along a row and end with repeats of the
    smallest long where an anchor has fewer; a score belongs to the last slot
    whose limit it doesn't exceed.  Scores below ``floor`` belong to none.
    """

    def __init__(self, limits: np.ndarray, floor: np.ndarray, keep: int):
        self.limits, self.keep, self.cut = limits, keep, floor.copy()
        n, m = limits.shape
        self.last = (limits > np.iinfo(np.int64).min).sum(1) - 1
        self.bar = np.full((n, m), np.iinfo(np.int64).min)  # score and id of the worst row kept, once a slot is full
        self.bar_id = np.full((n, m), np.iinfo(np.int64).max)
        self.held = [np.empty(0, np.int64) for _ in range(4)]  # anchor, slot, score, id
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None) -> None:
        """Scores of anchors ``first`` ... against rows ``ids``; ``allowed`` marks the pairs that count."""
        some = slice(first, first + len(scores))
        good = (scores >= self.cut[some, None]) & (scores <= self.limits[some, :1])
        if allowed is not None:
            good &= allowed
        a, r = np.nonzero(good)
        score, row = scores[a, r], ids[r]
        a += first
        slot = (score[:, None] <= self.limits[a]).sum(1) - 1
        better = (score > self.bar[a, slot]) | ((score == self.bar[a, slot]) & (row < self.bar_id[a, slot]))
        self.waiting.append([x[better] for x in (a, slot, score, row)])
        self.size += int(better.sum())
        if self.size > 1 << 18:
            self.settle()

    def settle(self) -> None:
        a, slot, score, row = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((row, -score, slot, a))
        a, slot, score, row = (x[order] for x in (a, slot, score, row))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (slot[1:] != slot[:-1])
        start = np.flatnonzero(new)
        rank = np.arange(len(a)) - start[np.cumsum(new) - 1] if len(a) else np.empty(0, np.int64)
        full = rank == self.keep - 1
        self.bar[a[full], slot[full]] = score[full]
        self.bar_id[a[full], slot[full]] = row[full]
        # below the last slot's worst row nothing of the anchor can matter
        lowest = full & (slot == self.last[a])
        self.cut[a[lowest]] = np.maximum(self.cut[a[lowest]], score[lowest])
        self.held = [x[rank < self.keep] for x in (a, slot, score, row)]
        self.waiting, self.size = [], 0


def _scored(met: DataFrame, keys: list[str], same: bool, keep: int) -> DataFrame:
    """(anchor, slot, score, id): the best rows of each slot among the rows that an anchor met in one run.

    ``met`` has the runs ``keys``, side 0 for anchors and 1 for rows, n, id, label,
    vector and limits (anchors, descending).  ``same``: rows of the anchor's own
    label but not the anchor itself, else rows of other labels.
    """

    def start(batches: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        limits = table.column("limits").to_pylist()
        width = max((len(x) for x in limits), default=1)
        low = np.iinfo(np.int64).min
        upper = np.array([x + [low] * (width - len(x)) for x in limits], np.int64).reshape(len(limits), width)
        least = np.array([x[-1] - x[-1] // MARGIN if not same else low for x in limits], np.int64)
        label = table.column("label").combine_chunks()
        values = label.unique()
        return {
            "n": table.column("n").to_numpy(), "q": quantised(table.column("vector").combine_chunks(), dim), "values": values,
            "label": pc.index_in(label, values).to_numpy(zero_copy_only=False), "slots": Slots(upper, least, keep), "seen": 0,
        }

    def stream(run, batch: pa.RecordBatch, dim: int) -> None:
        q = quantised(batch.column("vector"), dim)
        n, ids = batch.column("n").to_numpy(), batch.column("id").to_numpy()
        label = pc.fill_null(pc.index_in(batch.column("label"), run["values"]), -1).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(q):
            # few rows first: they set the bars that most of the others don't reach
            step = min(4096, 64 if not run["seen"] else 8 * run["seen"])
            rows = slice(at, at + step)
            high = max(1, (1 << 20) // step)
            for a in range(0, len(run["q"]), high):
                some = slice(a, a + high)
                allowed = (run["label"][some, None] == label[rows]) == same
                if same:
                    allowed &= run["n"][some, None] != n[rows]
                run["slots"].offer(a, products(run["q"][some], q[rows]), ids[rows], allowed)
            run["slots"].settle()
            at += step
            run["seen"] += step

    def finish(run) -> pa.RecordBatch:
        a, slot, score, row = run["slots"].held
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (run["n"][a], slot.astype(np.int32), score, row)], ["anchor", "slot", "score", "id"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, run = None, [], None
        for whole in batches:
            for batch in _runs(whole, [*keys, "side"]):
                *now, side = (batch.column(c)[0].as_py() for c in [*keys, "side"])
                dim = batch.column("dim")[0].as_py()
                if now != key:
                    if run:
                        yield finish(run)
                    key, anchors, run = now, [], None
                if not side:
                    anchors.append(batch)
                elif anchors or run:
                    if run is None:
                        run, anchors = start(anchors, dim), []
                    stream(run, batch, dim)
        if run:
            yield finish(run)

    order = [*keys, "side"]
    return met.repartition(*keys).sortWithinPartitions(*order).mapInArrow(kernel, "anchor long, slot int, score long, id long")


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The parts of a sorted batch with equal values in ``names``."""
    new = np.zeros(batch.num_rows, bool)
    for c in names:
        x = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many blocks of rows (rb) and of anchors (ab) the rows of each ``by`` are dealt into."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("anchor").cast("long")).alias("anchors")).where("anchors > 0")
    rb = F.least(F.ceil(F.col("rows") / ROWS), F.lit(BLOCKS)).cast("int").alias("rbs")
    return sizes.select(*by, rb, F.ceil(F.col("anchors") / ANCHORS).cast("int").alias("abs"))


def _meetings(rows: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Every block of anchors beside every block of rows of the same ``by``."""
    facts = _blocks(rows, by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("n"), F.col(n)).cast("int")
    columns = list(dict.fromkeys([*by, "dim", "rb", "ab", "side", "n", "id", "label", "vector", "limits"]))
    right = attach_facts(rows, facts, by, few=True).withColumns({"rb": own("rbs"), "side": F.lit(1), "limits": F.lit(None).cast("array<long>")}).withColumn("ab", every("abs"))
    left = attach_facts(anchors, facts, by, few=True).withColumns({"ab": own("abs"), "side": F.lit(0)}).withColumn("rb", every("rbs"))
    return left.select(*columns).unionByName(right.select(*columns))


def _best(scored: DataFrame, by: list[str], keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", rank).where(F.col("place") <= keep)


def hard_negatives(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    A component x counts as floor(256 x); the score of two rows is their inner
    product, and of equal scores the smaller id comes first.  An anchor's
    positives are its first ``positives`` other rows of its label.  For each, the
    first ``negatives`` rows of other labels are returned whose score is at most
    the positive's and at least four fifths of it (so a positive below zero has
    none); rank counts from 1.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part; zero and empty vectors do.  Only vectors of the same length
    meet.  Rows that repeat an id are separate rows: each may be an anchor and a
    positive of the other.  Scores beyond a long count as the largest or smallest
    long.  Other columns, whatever their names, are ignored; an empty table gives
    an empty one.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    part = rows.select(
        F.col(vec_id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(vector).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    part = part.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("vector", bad), F.lit(False)))
    part = cut_lineage(part.withColumns({"dim": F.size("vector"), "n": F.monotonically_increasing_id()}))
    none = F.array(F.lit((1 << 63) - 1))
    chosen = part.where("anchor").withColumn("limits", none)
    near = _scored(_meetings(part, chosen, ["label", "dim"]), ["label", "dim", "ab", "rb"], True, positives)
    near = cut_lineage(_best(near, ["anchor"], positives).select("anchor", "score", F.col("id").alias("positive_id")))
    # a positive below zero has no window
    limits = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    limited = part.where("anchor").join(limits.withColumnRenamed("anchor", "n"), "n")
    far = _scored(_meetings(part, limited, ["dim"]), ["dim", "ab", "rb"], False, negatives)
    best = _best(far, ["anchor", "slot"], negatives).select("anchor", F.struct("slot", "place", "score", "id").alias("s"))
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list("s")).alias("slots"))  # slots in descending order of scores
    inside = F.expr(f"filter(slots, s -> s.score <= positive_score AND s.score >= positive_score - positive_score div {MARGIN})")
    ids = part.where("anchor").select(F.col("n").alias("anchor"), F.col("id").alias("anchor_id"))
    out = near.where("score >= 0").withColumnRenamed("score", "positive_score").join(lists, "anchor").join(ids, "anchor")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("at", "s"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("s.id").alias("negative_id"), "positive_score", F.col("s.score").alias("negative_score")
    )
