"""Ordered work on traces of any length.

A window over a whole trace would be one task, and one trace may hold a third
of all rows.  So ordered operators never partition by the trace alone:

* ``add_index`` numbers the rows of each trace with a range shuffle, so a long
  trace is spread over many partitions;
* ``with_halo`` cuts a trace into chunks of at most ``chunk`` positions and
  copies the neighbouring rows a moving window needs;
* ``running`` computes a running sum, maximum, ... inside chunks and adds what
  came before from one summary row per chunk;
* ``moving_sums`` builds a moving sum from sums of 1, 2, 4, ... rows, so the
  work per row grows with log2 of the length and nothing is ever subtracted.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

CHUNK = 1 << 16
DIRECT_FRAME = 4


def join_facts(df: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-key facts; null keys match, columns of ``on`` appear once.

    No broadcast hint: adaptive execution broadcasts the facts only when their
    measured size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    if not on:
        raise ValueError("facts need a key; use a chunk column for whole-table facts")
    renamed = facts.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in facts.columns])
    condition = None
    for c in on:
        part = df[c].eqNullSafe(renamed[f"_on_{c}"])
        condition = part if condition is None else condition & part
    return df.join(renamed, condition, how).drop(*[f"_on_{c}" for c in on])


SALTS = 64


def with_salt(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows with ``_salt``, a hash of the row: the same after a task is run again.

    Rows must differ, by an id or after a count of equal ones, to be spread.
    """
    return df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int"))


def with_salt_copies(facts: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each fact once per salt."""
    return facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


HOT_ROWS = 1 << 10  # a key with fewer rows is never hot
HOT_KEYS = 1 << 10  # so many keys are hot at most


def hot_keys(counts: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """Keys of ``counts`` (on, _rows) that hold more than 1/``HOT_KEYS`` of the rows of all keys
    with over ``HOT_ROWS``; None without such a key.  Counts at once."""
    large = cut_lineage(counts.select(*on, "_rows").where(F.col("_rows") > HOT_ROWS))
    total = large.agg(F.sum("_rows")).first()[0]
    return large.where(F.col("_rows") * HOT_KEYS > total).select(*on) if total else None


def spread_hot(df: DataFrame, facts: DataFrame, on: Sequence[str], salts: int = SALTS,
               counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join and its key, with ``_salt`` where a key is hot.

    Rows of a hot key choose one of ``salts`` sub-keys by hash, and only the facts of
    hot keys are copied to all of them.  ``counts`` (on, _rows) saves counting the rows.
    """
    if counts is None:
        counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = hot_keys(counts, on)
    if hot is None:
        return df, facts, list(on)
    # fixed size: at most HOT_KEYS keys
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    rows = join_facts(with_salt(df, salts), hot, on).withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(0))
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    copies = join_facts(facts, hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return rows.drop("_hot"), copies.drop("_hot"), [*on, "_salt"]


def attach_facts(df: DataFrame, facts: DataFrame, on: Sequence[str], salts: int = SALTS, how: str = "inner",
                 counts: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Join group facts to rows when a group may be most of the table.

    A hot group is spread over ``salts`` tasks, see ``spread_hot``; other facts
    travel once, however many they are.  With ``few`` facts (or one, with ``on``
    empty) all are copied and no row is counted.
    """
    if few or not on:
        return join_facts(with_salt(df, salts), with_salt_copies(facts, salts), [*on, "_salt"], how).drop("_salt")
    rows, copies, key = spread_hot(df, facts, on, salts, counts)
    return join_facts(rows, copies, key, how).drop("_salt")


def side_by_side(frames: Sequence[DataFrame], key: Sequence[str] = ()) -> DataFrame:
    """One row per key from several one-row-per-key frames with different columns.

    A union and one aggregate: without keys this puts single rows next to each
    other with no join at all.
    """
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns if c not in key])


def ranged(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort ``df`` by key and order over many partitions and fix the result.

    Adds ``_part`` (partition number) and ``_mid`` (increasing along the order).
    The rows are written out because both numbers depend on sampled range
    bounds, which must not change between two uses.
    """
    cols = [*key, *order]
    laid_out = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_mid", 33))
    )
    return cut_lineage(laid_out)


def add_index(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """0-based position of each row in its trace, in the order of ``order``."""
    laid_out = ranged(df, key, order)
    runs = laid_out.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select(*key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return (
        join_facts(laid_out, base, [*key, "_part"], "inner")
        .withColumn(name, F.col("_mid") + F.col("_base"))
        .drop("_mid", "_part", "_base")
    )


def chunk_of(index: str | Column, chunk: int = CHUNK) -> Column:
    col = F.col(index) if isinstance(index, str) else index
    return F.floor(col / F.lit(chunk)).cast("bigint")


def with_halo(df: DataFrame, index: str = "i", back: int = 0, ahead: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Give every row its chunk, and copy it to later chunks whose first rows look
    ``back`` rows behind and to earlier chunks whose last rows look ``ahead``.

    Adds ``_chunk`` and ``_own`` (false for copies).
    """
    own = chunk_of(index, chunk)
    if back == 0 and ahead == 0:
        return df.withColumn("_chunk", own).withColumn("_own", F.lit(True))
    first = F.greatest(F.lit(0), chunk_of(F.col(index) - ahead, chunk))
    last = chunk_of(F.col(index) + back, chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == own)


def lay_out_chunks(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One shuffle by (key, chunk); all chunk windows and chunk joins reuse it."""
    return df.repartition(*key, "_chunk")


def chunk_window(key: Sequence[str], index: str = "i"):
    return Window.partitionBy(*key, "_chunk").orderBy(index)


def _shifted(col: Column, by: int, window) -> Column:
    return col if by == 0 else F.lag(col, by, 0.0).over(window) if by > 0 else F.lead(col, -by, 0.0).over(window)


def moving_sums(df: DataFrame, window, value: str, frames: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Sums over rows ``lo .. hi`` relative to the current row, missing rows count 0.

    ``window`` orders the rows of one chunk (with its halo).  Short frames use the
    built-in row frame.  Long ones add up sums over powers of two: one lag per
    power, whatever the length, and only additions, so a loud stretch that has
    left the frame leaves no rounding error behind.
    """
    long_frames = {n: f for n, f in frames.items() if f[1] - f[0] + 1 > DIRECT_FRAME}
    short = {
        name: F.coalesce(F.sum(value).over(window.rowsBetween(lo, hi)), F.lit(0.0))
        for name, (lo, hi) in frames.items() if name not in long_frames
    }
    if short:
        df = df.withColumns(short)
    if not long_frames:
        return df
    # a frame lo..hi is the trailing part lo..min(hi, 0) plus the leading part 1..hi
    back_len = max((min(hi, 0) - lo + 1 for lo, hi in long_frames.values() if lo <= 0), default=0)
    ahead_len = max((hi - max(lo, 1) + 1 for lo, hi in long_frames.values() if hi > 0), default=0)
    df = df.withColumn("_b1", F.col(value).cast("double")).withColumn("_a1", F.col("_b1"))
    power = 1
    while power * 2 <= max(back_len, ahead_len):
        steps = {}
        if power * 2 <= back_len:
            steps[f"_b{power * 2}"] = F.col(f"_b{power}") + _shifted(F.col(f"_b{power}"), power, window)
        if power * 2 <= ahead_len:
            steps[f"_a{power * 2}"] = F.col(f"_a{power}") + _shifted(F.col(f"_a{power}"), -power, window)
        df = df.withColumns(steps)
        power *= 2
    totals = {}
    for name, (lo, hi) in long_frames.items():
        parts = []
        if lo <= 0:
            end = min(hi, 0)
            offset, rest = -end, end - lo + 1
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    parts.append(_shifted(F.col(f"_b{1 << bit}"), offset, window))
                    offset += 1 << bit
        if hi > 0:
            start = max(lo, 1)
            offset, rest = start, hi - start + 1
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    parts.append(_shifted(F.col(f"_a{1 << bit}"), -offset, window))
                    offset += 1 << bit
        totals[name] = sum(parts[1:], parts[0])
    df = df.withColumns(totals)
    return df.drop(*[c for c in df.columns if c[:2] in ("_a", "_b") and c[2:].isdigit()])


_RUNNING = {
    # name: (running, summary, combine(before, here))
    "sum": (F.sum, lambda c, o: F.sum(c), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda c, o: F.max(c), F.greatest),
    "min": (F.min, lambda c, o: F.min(c), F.least),
    "last": (
        lambda c: F.last(c, ignorenulls=True),
        lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)),
        lambda a, b: F.coalesce(b, a),
    ),
    # not running: the sum over the whole key, for shares and rates
    "total": (F.sum, lambda c, o: F.sum(c), lambda a, b: a),
}


def running(
    df: DataFrame,
    key: Sequence[str],
    chunk: str,
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    descending: bool = False,
    ties: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates along ``order``, exact across chunks.

    ``aggs`` maps a new column to ``(sum|max|min|last|total, column)``.  Chunks must
    follow the order.  ``descending`` runs from the end; ``ties`` lets rows with
    equal order values see each other, which needs them in one chunk;
    ``exclusive`` leaves the current row out.

    ``df`` is read twice (rows and chunk summaries), so it should come from a
    checkpoint or from ``lay_out_chunks``, whose shuffle both readings share.
    """
    direction = F.desc if descending else F.asc
    inside = Window.partitionBy(*key, chunk).orderBy(*[direction(c) for c in order])
    inside = (
        inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        if ties
        else inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    )
    before = Window.partitionBy(*key).orderBy(direction(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order) if not descending else None
    summaries, carried, here = [], [], {}
    for name, (kind, col) in aggs.items():
        run, summary, _ = _RUNNING[kind]
        if kind != "total":
            here[f"_here_{name}"] = run(F.col(col)).over(inside)
        if kind == "last" and descending:
            value = F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order)))
        else:
            value = summary(F.col(col), position)
        summaries.append(value.alias(f"_all_{name}"))
        span = Window.partitionBy(*key) if kind == "total" else before
        carried.append(run(F.col(f"_all_{name}")).over(span).alias(f"_carry_{name}"))
    carry = df.groupBy(*key, chunk).agg(*summaries).select(*key, chunk, *carried)
    joined = join_facts(df.withColumns(here), carry, [*key, chunk], "left")
    out = joined.withColumns(
        {
            n: _RUNNING[k][2](F.col(f"_carry_{n}"), F.col(f"_here_{n}") if k != "total" else None)
            for n, (k, _) in aggs.items()
        }
    )
    return out.drop(*[f"_here_{n}" for n in aggs], *[f"_carry_{n}" for n in aggs])


def spread_facts(facts: DataFrame, length: str, chunk: int = CHUNK) -> DataFrame:
    """Copy per-trace facts to one row per chunk of the trace, so that the join
    with the samples is by (key, chunk) and a long trace is no hot join key."""
    last = chunk_of(F.col(length) - 1, chunk)
    return facts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def attach_trace_facts(
    samples: DataFrame, facts: DataFrame, key: Sequence[str], length: str, index: str = "i", chunk: int = CHUNK
) -> DataFrame:
    """Samples with the facts of their trace; adds ``_chunk`` and keeps it."""
    if "_chunk" not in samples.columns:
        samples = samples.withColumn("_chunk", chunk_of(index, chunk))
    return join_facts(samples, spread_facts(facts, length, chunk), [*key, "_chunk"], "inner")


SKETCH = 10_000  # accuracy of the quantile sketch: ranks are off by n / SKETCH at most


def order_statistics(
    df: DataFrame, key: Sequence[str], value: str, quantiles: Mapping[str, float], rule: str = "linear", sketched: bool = True
) -> DataFrame:
    """Exact quantiles per key, one row per key, without holding a group in a task.

    A sketch (an aggregate with partial sums) bounds every wanted rank between two
    values; how many values lie below is counted, and only what lies between, a
    few ten-thousandths of the rows, is ranked, by distinct value and its count.
    So neither a large group nor one very common value meets in a task, and no
    table of all values is written.  ``linear`` interpolates between neighbours,
    ``upper`` takes the element at ``int(n * q)``.  ``sketched=False`` ranks all
    distinct values.
    """
    key = list(key) or ["_all"]
    if key == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    values = df.select(*key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    names, slack = list(quantiles), 3 / SKETCH
    ends = [p for q in quantiles.values() for p in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = values.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, SKETCH).alias("_e"))
    bounds = []
    for j, q in enumerate(quantiles.values()):
        # the slack is less than two places in a group of up to SKETCH rows: all of it is ranked
        all_ = F.col("_n") <= SKETCH if sketched else F.lit(True)
        low = F.when(all_, float("-inf")).otherwise(F.element_at("_e", 2 * j + 1)) if q > slack else F.lit(float("-inf"))
        high = F.when(all_, float("nan")).otherwise(F.element_at("_e", 2 * j + 2)) if q < 1 - slack else F.lit(float("nan"))
        bounds.append(F.struct(F.lit(j).alias("q"), low.alias("low"), high.alias("high")))
    sketch = cut_lineage(sketch.select(*key, "_n", F.array(*bounds).alias("_b")))
    # the row number spreads equal values over the salts of the join
    bounded = attach_facts(
        values.withColumn("_row", F.monotonically_increasing_id()), sketch.select(*key, "_b"), key, counts=sketch.select(*key, F.col("_n").alias("_rows"))
    ).drop("_row")
    # one pass: what lies between the bounds counts by its value, what lies below them under null
    places = bounded.select(*key, "_v", F.explode("_b").alias("_b")).where(F.col("_v") <= F.col("_b.high"))
    places = places.select(*key, F.col("_b.q").alias("_q"), F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v"))
    places = cut_lineage(places.groupBy(*key, "_q", "_v").agg(F.count(F.lit(1)).alias("_m")))
    inside = F.sum(F.when(F.col("_v").isNotNull(), F.col("_m")))
    found = places.groupBy(*key, "_q").agg(F.sum(F.when(F.col("_v").isNull(), F.col("_m"))).alias("_c"), inside.alias("_k"))
    counts = [[F.sum(F.when(F.col("_q") == j, F.col(c))) for c in ("_c", "_k")] for j in range(len(names))]
    below = found.groupBy(*key).agg(*[F.coalesce(x, F.lit(0)).alias(f"{n}{j}") for j, both in enumerate(counts) for n, x in zip(("_c", "_k"), both, strict=True)])
    below = join_facts(sketch.select(*key, "_n"), below, key, "inner")  # one row per key
    counted = places.where("_v IS NOT NULL")
    ranks = cumulative(counted, [*key, "_q"], ["_v"], "_m", "_to")
    wanted = []
    for j, q in enumerate(quantiles.values()):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        if rule == "linear":
            points = [(F.floor(at), F.lit(1.0) - (at - F.floor(at))), (F.floor(at) + 1, at - F.floor(at))]
        else:
            points = [(F.least(F.floor(F.col("_n") * F.lit(float(q))), F.col("_n") - 1), F.lit(1.0))]
        wanted += [F.struct(F.lit(j).alias("q"), (r - F.col(f"_c{j}")).cast("bigint").alias("r"), w.alias("w")) for r, w in points]
    # a rank outside its bounds would be lost; the sketch's guarantee excludes it, and this makes sure
    known = F.array(*[F.col(f"_k{j}") for j in range(len(names))])
    inside = [(s["w"] <= 0) | ((s["r"] >= 0) & (s["r"] < F.element_at(known, s["q"] + 1))) for s in wanted]
    below = below.where(F.assert_true(reduce(operator.and_, inside), "a rank lies outside the sketch's bounds; use sketched=False").isNull())
    points = below.select(*key, F.explode(F.array(*wanted)).alias("_p")).where("_p.w > 0")
    points = points.groupBy(*key, F.col("_p.q").alias("_q")).agg(F.collect_list(F.struct("_p.r", "_p.w")).alias("_p"))
    hit = join_facts(ranks, points, [*key, "_q"], "inner").select(*key, "_q", "_v", "_m", "_to", F.explode("_p").alias("_p"))
    hit = hit.where((F.col("_p.r") < F.col("_to")) & (F.col("_p.r") >= F.col("_to") - F.col("_m")))
    out = hit.groupBy(*key).agg(*[F.sum(F.when(F.col("_q") == j, F.col("_v") * F.col("_p.w"))).alias(n) for j, n in enumerate(names)])
    return out.drop("_all")


def cumulative(df: DataFrame, key: Sequence[str], order: Sequence[str], size: str, name: str) -> DataFrame:
    """Running sum of ``size`` per key in the order of ``order``, over many partitions."""
    laid_out = ranged(df, key, order)
    parts = laid_out.groupBy(*key, "_part").agg(F.sum(size).alias("_own"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*key, "_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*key, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    rows = laid_out.withColumn(name, F.sum(size).over(inside))
    return join_facts(rows, base, [*key, "_part"], "inner").withColumn(name, F.col(name) + F.col("_base")).drop("_mid", "_part", "_base")
