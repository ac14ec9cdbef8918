"""Mix sources to target weights by weighted pivotal rounding (columns only).

A source's target divided by its size says how often each of its documents
should be taken, in general not a whole number.  Documents get the whole part;
the fractions are settled in pairs: of two documents with fractions strictly
between 0 and 1, words move from one to the other, in a direction drawn so that
both expectations stay, until one fraction is 0 or 1.  Sizes weigh the transfer,
so the number of words taken never changes.  What is left over in a pair meets
the next document.

The pairs form a tree.  Documents of a source are numbered in a random order
(by hash) and cut into blocks of 32; each block is settled in one fold and hands
one residual document up; blocks of residuals follow, until one document of each
source is left, which is rounded.  In a block large documents come first, so
that small ones are left over.  Every level is an aggregate on (source, block):
a source of any size is spread, and a level has 1/32 of the rows below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage, row_key, unused
from tracewell.operators.ordered import add_index, join_facts

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 32
CYCLE = (1, 2, 3)


def targets(sizes: DataFrame, limit: int = 3, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n).

    Sources in code point order, null last, weigh ``cycle`` in turn and share the
    sum of all sizes; a target stops at ``limit`` times its source's size and the
    excess is shared out again, until none is above.  Each round is one aggregate
    over the sources; only its sums reach the driver.
    """
    numbered = add_index(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    numbered = cut_lineage(numbered.select("source", "source_size", "n", weight.alias("weight")))
    cap = F.col("source_size") * limit
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        capped, weights = numbered.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (capped or 0)) / weights if weights else float("inf")
        if new <= level:
            break
        level = new
    share = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(level), cap.cast("double"))).otherwise(0.0)
    return numbered.select("source", "source_size", "n", share.alias("target"))


def _unit(*parts: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _doc(x: Column, fraction: Column) -> Column:
    return F.struct(x["size"].alias("size"), x["i"].alias("i"), x["doc_id"].alias("doc_id"), x["key"].alias("key"), x["whole"].alias("whole"), fraction.alias("x"))


def _settle(items: Column, seed: int, level: int) -> Column:
    """Fold one block: (left: the residual, done: documents whose fraction became 0 or 1)."""

    def step(state: Column, v: Column) -> Column:
        c = state["left"]
        a, b, p, q = c["size"], v["size"], c["x"], v["x"]
        up, down = F.least((1 - p) * a, q * b), F.least(p * a, (1 - q) * b)  # words that could move to c, and away from it
        rises = _unit(c["i"], v["i"], F.lit(seed), F.lit(level)) * (up + down) < down
        c_ends = F.when(rises, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        moved = F.when(rises, up).otherwise(-down)
        c_end = F.when(rises, 1.0).otherwise(0.0)
        ended = F.when(c_ends, _doc(c, c_end)).otherwise(_doc(v, 1 - c_end))
        left = F.when(c_ends, _doc(v, F.greatest(F.lit(0.0), F.least(F.lit(1.0), q - moved / b)))).otherwise(
            _doc(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + moved / a)))
        )
        return F.struct(left.alias("left"), F.concat(state["done"], F.array(ended)).alias("done"))

    first = F.element_at(items, 1)
    start = F.struct(_doc(first, first["x"]).alias("left"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit: int = 3, cycle: tuple[int, ...] = CYCLE, seed: int = 42) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, copies, taken): one row for every row of ``docs``.

    size is the number of words (null text: 0); copies, at most ``limit``, says how
    often the mix takes the document.  The words taken of a source differ from its
    target by less than one document.  Documents without words and sources
    without words get 0 copies.  Null is a source of its own.  The draw depends on
    ids, sizes and ``seed`` alone, so reruns agree; rows that repeat in full are
    drawn for each.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(doc_id, text).alias("key"),
    )
    rows = cut_lineage(rows.withColumn("h", F.xxhash64("key", F.lit(seed))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    facts = cut_lineage(targets(cut_lineage(sizes), limit, cycle))
    most = facts.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = facts.withColumn("whole", F.floor(ratio).cast("int")).withColumn("x", ratio - F.floor(ratio)).drop("n")
    now = join_facts(add_index(rows, ["source"], ["h", "doc_id", "size"]).drop("h"), facts.select("source", "whole", "x"), ["source"], "inner")
    open_ = (F.col("size") > 0) & (F.col("x") > 0)
    now = cut_lineage(now)
    out = [now.where(~open_).select("doc_id", "key", "source", "size", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))]
    now, level = now.where(open_), 0
    while True:
        blocks = now.groupBy("source", F.floor(F.col("i") / BLOCK).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("size", "i", "doc_id", "key", "whole", "x")), asc=False).alias("items")
        )
        settled = cut_lineage(blocks.select("source", "block", _settle(F.col("items"), seed, level).alias("s")))
        done = settled.select("source", F.explode("s.done").alias("d"))
        out.append(done.select("d.doc_id", "d.key", "source", "d.size", (F.col("d.whole") + F.col("d.x").cast("int")).alias("copies")))
        most = -(-most // BLOCK)
        left = settled.select("source", F.col("block").alias("i"), "s.left.doc_id", "s.left.key", "s.left.size", "s.left.whole", "s.left.x")
        if most <= 1:
            out.append(left.select("doc_id", "key", "source", "size", (F.col("whole") + (F.col("x") >= 0.5).cast("int")).alias("copies")))
            break
        now, level = left, level + 1
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    named = join_facts(union, facts.select("source", "source_size", "target"), ["source"], "inner")
    return named.select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    key, times = unused(docs, "row_key"), unused(docs, "times")
    copies = mix(docs, doc_id, text, source, limit, seed=seed).groupBy(F.col("key").alias(key)).agg(F.sum("copies").cast("int").alias(times))
    copies = cut_lineage(copies.where(F.col(times) > 0))
    # rows that repeat in full share their copies
    once = docs.withColumn(key, row_key(doc_id, text)).join(copies, key).dropDuplicates([key])
    return once.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times)
