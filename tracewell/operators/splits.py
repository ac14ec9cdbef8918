"""Train/val/test splits and the records that describe a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.select import hash_fraction
from tracewell.operators.ordered import add_index, attach_facts, ranged, running, side_by_side

NAMES = ("train", "val", "test")
FRACTIONS = (0.70, 0.15, 0.15)


def _cut(position: Column, total: Column, fractions: Sequence[float], names: Sequence[str]) -> Column:
    """Part by position: limits are int(total * share) of each part in turn, the rest goes last."""
    out, limit = None, F.lit(0).cast("bigint")
    for name, share in list(zip(names, fractions))[:-1]:
        limit = limit + (total * F.lit(float(share))).cast("bigint")
        out = F.when(position < limit, name) if out is None else out.when(position < limit, name)
    return out.otherwise(names[-1])


def split_ordered(df: DataFrame, order: Sequence[str], fractions: Sequence[float] = FRACTIONS,
                  names: Sequence[str] = NAMES, by: Sequence[str] = ()) -> DataFrame:
    """Split in the order of production, per ``by`` group; truncated limits, remainder last."""
    placed = add_index(df, by, order, "_pos")
    if not by:
        placed = placed.withColumn("_g", F.lit(0))
    key = list(by) or ["_g"]
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_total"))
    out = attach_facts(placed, sizes, key, counts=sizes.withColumnRenamed("_total", "_rows"))
    return out.withColumn("split", _cut(F.col("_pos"), F.col("_total"), fractions, names)).drop("_pos", "_total", "_g")


def group_order(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def split_group(df: DataFrame, key: str, seed: int = 42, order: Column | None = None,
                cuts: Sequence[float] = (0.70, 0.85), names: Sequence[str] = NAMES) -> DataFrame:
    """Whole groups (stations) go to one part: no group appears in two.

    Groups are shuffled by a seeded hash and cut at int(n * cut).  Only the group
    list is ranked; the salted join back keeps a group with most of the rows from
    becoming one task.
    """
    groups = df.select(key).distinct().withColumn("_h", group_order(key, seed) if order is None else order)
    laid_out = ranged(groups, [], ["_h", key]).drop("_mid").withColumn("_one", F.lit(1))
    ranked = running(laid_out, [], "_part", ["_h", key], {"_r": ("sum", "_one"), "_n": ("total", "_one")})
    position, total = F.col("_r") - 1, F.col("_n")
    part = F.when(position < (total * cuts[0]).cast("bigint"), names[0]).when(
        position < (total * cuts[1]).cast("bigint"), names[1]
    ).otherwise(names[2])
    return attach_facts(df, ranked.select(key, part.alias("split")), [key])


def ranked_fraction(df: DataFrame, order: Sequence[str], name: str = "frac") -> DataFrame:
    """Position in the order divided by the number of rows, both over the whole table."""
    laid_out = ranged(df, [], order).drop("_mid").withColumn("_one", F.lit(1))
    ranked = running(laid_out, [], "_part", order, {"_r": ("sum", "_one"), "_n": ("total", "_one")})
    return ranked.withColumn(name, (F.col("_r") - 1) / F.col("_n")).drop("_r", "_n", "_one", "_part")


def split_temporal(df: DataFrame, order: Sequence[str], cuts: Sequence[float] = (0.70, 0.85),
                   names: Sequence[str] = NAMES) -> DataFrame:
    frac = F.col("_frac")
    part = F.when(frac < cuts[0], names[0]).when(frac < cuts[1], names[1]).otherwise(names[2])
    return ranked_fraction(df, order, "_frac").withColumn("split", part).drop("_frac")


def split_random(df: DataFrame, ids: Sequence[str], share: float = 0.8, seed: int = 42,
                 fraction: Column | None = None, names: Sequence[str] = ("train", "test")) -> DataFrame:
    """Seeded split row by row: the same row always lands in the same part."""


    u = hash_fraction(ids, seed) if fraction is None else fraction
    return df.withColumn("split", F.when(u < share, names[0]).otherwise(names[1]))


def dataset_info(windows: DataFrame, params: Mapping[str, str], station: str = "net_sta", label: str = "label",
                 split: str = "split") -> DataFrame:
    """One record: parameters, counts per split and class, stations, prevalence.

    Prevalence is the average precision a random scorer would reach.
    """
    per = windows.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    cells = per.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", split, F.concat(F.lit("label"), F.col(label))), "n")))).alias("counts"),
        F.sum("n").alias("n_total"),
        (F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("prevalence"),
    )
    stations = windows.select(split, station).distinct().groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    stations = stations.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "n")))).alias("stations"))
    given = F.create_map(*[F.lit(str(v)) for kv in params.items() for v in kv])
    return side_by_side([cells, stations]).withColumn("parametros", given)


def yield_by_file(windows: DataFrame, file: str = "file", station: str = "net_sta", label: str = "label") -> DataFrame:
    # two levels: distinct stations are counted after partial aggregation by (file, station)
    per = windows.groupBy(file, station).agg(
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_0"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_1")
    )
    return per.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_stations"), F.sum("_0").alias("n_noise"), F.sum("_1").alias("n_event")
    )


def ledger(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per outcome: what was kept and why the rest was not."""
    return df.groupBy(F.col(status).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


