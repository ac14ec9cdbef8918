"""Choosing rows: channels, usable files, slices, ranks, samples, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordered import CHUNK, attach_facts, chunk_of, lay_out_chunks, ranged, running

LOW_RATIO, HIGH_RATIO = 2.0, 10.0  # fixed class limits of the variance ratio
MAGNITUDE_EDGES = (2.5, 3.0, 3.5, 4.0, 5.0, 10.0)  # fixed half-open magnitude buckets


def channels(df: DataFrame, suffix: str | None = None, stations: Sequence[str] | None = None,
             codes: Sequence[str] | None = None, channel: str = "cha", station: str = "sta") -> DataFrame:
    if suffix is not None:
        df = df.where(F.col(channel).endswith(suffix))
    if stations is not None:
        df = df.where(F.col(station).isin(list(stations)))
    if codes is not None:
        df = df.where(F.col(channel).isin(list(codes)))
    return df


def usable(inventory: DataFrame, ratio: str = "razao_var", available: str = "xml_disponivel") -> DataFrame:
    return inventory.where(F.col(available) & (F.col(ratio) > HIGH_RATIO))


def classify(df: DataFrame, col: str, low: float = LOW_RATIO, high: float = HIGH_RATIO,
             names: Sequence[str] = ("ruido", "ambiguo", "evento_claro"), out: str = "classificacao") -> DataFrame:
    """below ``low``, from ``low`` to ``high`` inclusive, above ``high``."""
    value = F.col(col)
    return df.withColumn(out, F.when(value < low, names[0]).when(value <= high, names[1]).otherwise(names[2]))


def bucket(col: str | Column, edges: Sequence[float] = MAGNITUDE_EDGES) -> Column:
    """Label of the half-open bucket [a, b) holding the value; null outside."""
    value = F.col(col) if isinstance(col, str) else col
    out = None
    for a, b in zip(edges, edges[1:]):
        test, label = (value >= a) & (value < b), F.lit(f"[{a:g},{b:g})")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def events_between(df: DataFrame, magnitude: str, low: float, high: float, when: str | None = None,
                   start=None, end=None, depth: str | None = None, max_depth: float = 30.0) -> DataFrame:
    """Magnitude in [low, high], optional depth limit and [start, end) time range."""
    df = df.where(F.col(magnitude).between(low, high))
    if depth:
        df = df.where(F.col(depth) <= max_depth)
    if when and start is not None:
        df = df.where(F.col(when) >= F.lit(start))
    if when and end is not None:
        df = df.where(F.col(when) < F.lit(end))
    return df


def time_slice(samples: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    return samples.where(F.col(ts).between(F.lit(start), F.lit(end)))


def head(samples: DataFrame, n: int, index: str = "i") -> DataFrame:
    """The first n samples of every trace."""
    return samples.where(F.col(index) < n)


def reject_flat(samples: DataFrame, key: Sequence[str], eps: float = 1e-12, min_rows: int = 2, value: str = "v") -> DataFrame:
    """Keys with ``n``, ``std`` and the reason they are unusable (``ok`` when they are not)."""
    clean = F.when(~F.isnan(value), F.col(value))
    facts = samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(value).isNull() | F.isnan(value), 1).otherwise(0)).alias("n_bad"),
        F.stddev_pop(clean).alias("std"),
    )
    reason = (
        F.when(F.col("n_bad") > 0, "not_a_number").when(F.col("n") < min_rows, "short")
        .when(F.col("std") < eps, "flat").otherwise("ok")
    )
    return facts.withColumn("status", reason)


def bad_array(x: str | Column, n: int) -> Column:
    """True for window arrays that are null, of the wrong length or hold a null or NaN."""
    x = F.col(x) if isinstance(x, str) else x
    return x.isNull() | (F.size(x) != n) | F.exists(x, lambda e: e.isNull() | F.isnan(e))


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).limit(k)


def top_k_per(df: DataFrame, key: Sequence[str], by: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k largest rows of each key.  Rows first compete inside (key, salt) groups
    so that a hot key's candidates shrink to k per group before they meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(256)))
    order = [F.desc(by), *[F.asc(t) for t in tie]]
    local = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "_salt").orderBy(*order)))
    local = local.where(F.col("_rn") <= k)
    final = local.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return final.where(F.col("_rn") <= k).drop("_salt", "_rn")


def first_match(df: DataFrame, group: Sequence[str], order: Sequence[str], prefer: Column | None = None) -> DataFrame:
    """One row per group: the first row that satisfies ``prefer``, else the first row.

    ``min_by`` combines inside the map side, so a large group never meets in one sort.
    """
    rank = F.struct(F.when(prefer, 0).otherwise(1), *order) if prefer is not None else F.struct(*order)
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*group, *[f"_b.{c}" for c in rest])


def argmax_row(df: DataFrame, by: str, tie: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``by`` (first one on ties), whole table or per group."""
    rest = [c for c in df.columns if c not in group]
    low = F.struct(F.negative(F.col(by)), *tie)
    best = df.where(F.col(by).isNotNull()).groupBy(*group).agg(F.min_by(F.struct(*rest), low).alias("_b"))
    return best.where(F.col("_b").isNotNull()).select(*group, *[f"_b.{c}" for c in rest])


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first", size: str | None = None) -> DataFrame:
    """One row per key: the first in ``order``, or the one with the largest ``size`` (first on ties)."""
    if keep == "first":
        return first_match(df, keys, order)
    return argmax_row(df, size, order, keys)


SAMPLE_CELLS = 1 << 12  # cells of the unit interval that a sample is cut at


def hash_fraction(ids: Sequence[str], seed: int = 42) -> Column:
    """A repeatable number in [0, 1) per row."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42, fraction: Column | None = None) -> DataFrame:
    """Exactly n rows (all if there are fewer): those with the smallest hash fraction.

    Rows are counted per cell of the fraction (at most ``SAMPLE_CELLS`` counts).
    Cells that fit are taken whole, and only the one cell where n is reached is
    ranked, so nothing larger than 1/``SAMPLE_CELLS`` of the ids is ever sorted.
    """
    u = hash_fraction(ids, seed) if fraction is None else fraction
    coded = df.withColumn("_u", u).withColumn("_cell", F.floor(F.col("_u") * SAMPLE_CELLS))
    counts = coded.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n)
    # fixed size: at most SAMPLE_CELLS rows of three numbers
    kept = coded.join(F.broadcast(cells), "_cell")
    whole = kept.where(F.col("_before") + F.col("_n") <= n)
    edge = kept.where(F.col("_before") + F.col("_n") > n)
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_u", *ids))
    edge = edge.withColumn("_place", place).where(F.col("_place") <= F.lit(n) - F.col("_before")).drop("_place")
    return whole.unionByName(edge).drop("_u", "_cell", "_n", "_before")


def new_files(listing: DataFrame, log: DataFrame, name: str = "path", size: str = "length",
              order: Sequence[str] = ("path",), budget_bytes: int | None = None) -> DataFrame:
    """Files not logged yet, in order, until the running size passes the budget."""
    fresh = listing.join(log.select(name).distinct(), name, "left_anti")
    if budget_bytes is None:
        return fresh
    laid_out = ranged(fresh, [], list(order)).drop("_mid")
    total = running(laid_out, [], "_part", list(order), {"total_bytes": ("sum", size)}).drop("_part")
    return total.where(F.col("total_bytes") <= budget_bytes)


def exists_flag(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``name`` is true where ``other`` has a row with the same key."""
    present = other.select(*on).distinct().withColumn(name, F.lit(True))
    return attach_facts(df, present, on, how="left").withColumn(name, F.coalesce(name, F.lit(False)))


def best_so_far(df: DataFrame, key: Sequence[str], order: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Running minimum of ``value``, e.g. of the validation loss over trials."""
    chunked = lay_out_chunks(df.withColumn("_chunk", chunk_of(order, chunk)), key)
    return running(chunked, key, "_chunk", [order], {"best": ("min", value)}).drop("_chunk")


def flags_from(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row of booleans, e.g. readiness gates on counts."""
    return df.agg(*[rule.alias(name) for name, rule in rules.items()])
