"""One row of each group of near copies: SimHash tries propose, shared shingles decide.

Two 64-bit fingerprints of word pairs are made for every text, from one hash of each
pair and a mix of it.  The trie self-join of ``simhash`` links those at up to 7
differing bits; what hangs together is a candidate group, nothing more.

Inside a group a row goes if at least ``similarity`` of the different 5-word
shingles of both texts together are shared with an earlier row that stays (rows by
id).  So no row goes without a near copy that stays, and no two rows of a group
that stay are near copies.  Texts with the same set of shingles are one node.

A group of any size is dealt over blocks of nodes.  A round takes the first nodes
still open as candidates to stay, gives them to all blocks of their group, and each
block settles them among themselves, the same way everywhere, and then its own
nodes.  What is left goes into the next round, which takes twice as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import attach_sized, cut_lineage, matching, row_key, slices, text_of, utf8
from tracewell.llm.components import components
from tracewell.llm.simhash import SEED, links

WORDS = 5
SIMILARITY = 0.8
PAIRS = 2
ERRORS = 7
BLOCK = 256
FIRST = 32
MOST = 512


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """The hashes of all runs of ``words`` words, repeats included; fewer words are one run, none is empty."""
    n = max(1, len(parts) - words + 1) if parts else 0
    joined = memoryview(b" ".join(parts))
    length = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(length) - 1
    start = (end + 1 - length)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end[len(end) - n :].tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def mixed_hashes(h: np.ndarray) -> np.ndarray:
    """A second hash for each hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _nodes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, fps, first): one row for each different set of shingles; first is its row with the smallest id."""
    source = text_of(docs, doc_id, text).withColumn("key", row_key("doc_id", "text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            same, fps = [], []
            for data in utf8(batch.column("text")):
                parts = data.lower().split()
                same.append(xxhash.xxh3_128_digest(np.unique(shingle_hashes(parts, WORDS)).tobytes()))
                h = shingle_hashes(parts, PAIRS)
                fps.append([majority(h), majority(mixed_hashes(h))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(same, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "key", "same", "fps"]
            )

    rows = source.mapInArrow(kernel, f"doc_id {dict(source.dtypes)['doc_id']}, key long, same binary, fps array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    sets = rows.groupBy("same").agg(F.min("fps").alias("fps"), first)
    return cut_lineage(sets.select(F.monotonically_increasing_id().alias("node"), "fps", "first"))


def candidate_groups(nodes: DataFrame, errors: int = ERRORS, leaf: int = 20_000) -> DataFrame:
    """(node, grp) for the nodes that a chain of near fingerprints joins to another."""
    marks = cut_lineage(nodes.select("node", F.explode(F.array_distinct("fps")).alias("fp")))
    reps = cut_lineage(marks.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")))
    alike = attach_sized(marks, reps, ["fp"], "n").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = links(reps.select("fp"), errors, leaf)
    for side in "ab":
        near = near.join(reps.select(F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    return components(alike.unionByName(near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))).select("node", F.col("root").alias("grp"))


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles): the sorted different hashes for ``wanted`` (node, key)."""
    rows = text_of(docs, doc_id, text).withColumn("key", row_key("doc_id", "text")).join(wanted, "key").select("node", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(x.lower().split(), WORDS)).tobytes() for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(kernel, "node long, shingles binary").dropDuplicates(["node"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Do two sorted sets share ``similarity`` of all their members?  Two empty ones do."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b):
        return False
    if not len(b):
        return True
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared >= similarity * (len(a) + len(b) - shared)


def leaders(grouped: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, first: int = FIRST, most: int = MOST) -> DataFrame:
    """(node, leader): the first row each node is a near copy of, itself if it stays.

    ``grouped`` has (node, grp, first), where first orders the nodes of a group;
    ``sets`` has (node, shingles).  Both should be tables.
    """

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending")])  # leaders have places from 1, others come after
        place, node = table.column("place").to_pylist(), table.column("node").to_pylist()
        data = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        stay: list[int] = []
        out = []
        for i, p in enumerate(place):
            to = next((j for j in stay if alike(data[j], data[i], similarity)), None)
            if to is None and p <= most:
                stay.append(to := i)
            if to is not None:
                out.append((node[i], node[to]))
        return pa.table({"node": pa.array([x for x, _ in out], pa.int64()), "leader": pa.array([x for _, x in out], pa.int64())})

    done = None
    left = grouped
    while True:
        sizes = cut_lineage(left.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
        rows = cut_lineage(attach_sized(left, sizes, ["grp"], "n").withColumn("blocks", F.ceil(F.col("n") / block)))
        top = rows.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("first"))).where(F.col("place") <= first)
        top = cut_lineage(top.select("node", "grp", "blocks", "place"))
        others = rows.join(top.select("node"), "node", "left_anti")
        dealt = others.select("node", "grp", F.pmod(F.xxhash64("node"), "blocks").alias("part"), F.lit(most + 1).alias("place")).join(sets, "node")
        given = top.join(sets, "node").select("node", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), "place", "shingles")
        settled = cut_lineage(dealt.unionByName(given).groupBy("grp", "part").applyInArrow(settle, "node long, leader long").distinct())
        done = settled if done is None else done.unionByName(settled)
        left = cut_lineage(rows.join(settled.select("node"), "node", "left_anti").select(*grouped.columns))
        if not left.head(1):
            return done
        first = min(2 * first, most)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, errors: int = ERRORS) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies of an earlier row that stays.

    Null and empty texts have no shingles: the first of them stays.  A text of
    fewer than five words is one shingle.  Rows come by id, null ids last; of equal
    texts the smallest id stays, and rows that repeat in full become one.  Very
    long texts are compared whole.  Columns with any other name are carried along.
    An empty table gives an empty one.
    """
    nodes = _nodes(docs, doc_id, text)
    grouped = cut_lineage(candidate_groups(nodes, errors).join(nodes.select("node", "first"), "node").select("node", "grp", "first"))
    sets = cut_lineage(_sets(docs, grouped.select("node", F.col("first.key").alias("key")), doc_id, text))
    gone = leaders(grouped, sets, similarity).where("node <> leader")
    chosen = nodes.join(gone.select("node"), "node", "left_anti").select(F.col("first.key").alias("key"))
    return matching(docs, chosen, "left_semi", doc_id, text)
