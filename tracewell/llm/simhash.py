"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits, read from the highest bit, form a binary trie.  Two
nodes of the same depth are visited together; the bits in which their paths
differ are added up, and a pair of nodes is given up as soon as the sum is
above the error budget of that depth.

A budget of 4 at every depth leaves far too many pairs near the root.  The 64
bits are therefore read in eight cyclic rotations of 8 bits.  If the differing
bits of eight parts sum to at most e, some rotation has at most e * l / 8 of
them in its first l parts, for every l (cycle lemma).  Each rotation gets its
own trie and the budget floor(e * l / 8) after l parts; none of the links is
lost, and in the first 8 bits the two paths must agree.

Work is cut at node pairs.  A frontier of pairs, each with the number of
fingerprints below it, is refined by four bits at a time until every pair fits
a task; then the tasks go down the rest of the two tries.  Links inside a task
are kept as components, never as pairs: two nodes whose fingerprints already
lie in one component aren't visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage, matching, row_key, slices, text_of, utf8
from tracewell.llm.components import components

PARTS = 8
STEP = 4
SEED = 42


def fingerprint(data: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of one text: A-Z lower-cased, shingles of ``words`` words with repeats.

    A text with fewer words is one shingle; a text with none has fingerprint 0.
    """
    parts = data.lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = memoryview(b" ".join(parts))
    length = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(length) - 1
    start = (end + 1 - length)[:n].tolist()
    end = end[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, key, fp): one row per row of ``docs``; key is ``row_key``, fp holds the 64 bits as a signed long."""
    source = text_of(docs, doc_id, text).withColumn("key", row_key("doc_id", "text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(x, words) for x in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    return source.mapInArrow(kernel, f"doc_id {dict(source.dtypes)['doc_id']}, key long, fp long")


def budget(depth: int, errors: int) -> int:
    """How many bits two paths of a rotation may differ in after ``depth`` bits."""
    whole, rest = divmod(depth, 64 // PARTS)
    return errors * whole // PARTS if not rest else errors * (whole + 1) // PARTS


def descend(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Components among sorted distinct fingerprints below one node pair, as (member, its component's first).

    ``b`` is None for a node paired with itself.  Only members of components of
    two or more are returned.
    """
    values = a if b is None else np.concatenate([a, b])
    n = len(values)
    label = np.arange(n)

    def unite(x: np.ndarray, y: np.ndarray) -> None:
        x, y = label[x], label[y]
        linked = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        if not len(linked):
            return
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = parent.get(p, p)
                v = p
            return v

        for u, v in linked.tolist():
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        to = np.arange(n)
        for v in parent:
            to[v] = root(v)
        label[:] = to[label]

    near = np.flatnonzero(np.bitwise_count(values[1:] ^ values[:-1]) <= errors)
    unite(near, near + 1)
    half = len(a)
    one = np.ones(1, np.int64)
    lo1, hi1 = one * 0, one * half
    lo2, hi2 = (lo1, hi1) if b is None else (one * half, one * n)
    err = np.array([int(values[0] ^ values[half]) >> (64 - depth)], np.uint64) if b is not None and depth else np.zeros(1, np.uint64)
    err = np.bitwise_count(err).astype(np.int64)
    block = 1 << 18
    stack = [(depth, lo1, hi1, lo2, hi2, err)]
    while stack:
        depth, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > block:
            for i in range(0, len(lo1), block):
                stack.append((depth, *(x[i : i + block] for x in (lo1, hi1, lo2, hi2, err))))
            continue
        # nodes whose fingerprints are all in one component already
        turn = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        done = (turn[lo1] == turn[hi1 - 1]) & (turn[lo2] == turn[hi2 - 1]) & (label[lo1] == label[lo2])
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1) & ~done
        if single.any():
            x, y = lo1[single], lo2[single]
            hit = np.bitwise_count(values[x] ^ values[y]) <= errors
            unite(x[hit], y[hit])
        more = ~done & ~single
        if depth == 64 or not more.any():
            continue
        lo1, hi1, lo2, hi2, err = (x[more] for x in (lo1, hi1, lo2, hi2, err))
        bit = np.uint64(63 - depth)
        ones = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1))]).astype(np.int64)
        cut1, cut2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        left1, right1, left2, right2 = (lo1, cut1), (cut1, hi1), (lo2, cut2), (cut2, hi2)
        self_pair = lo1 == lo2
        out = []
        for (s1, e1), (s2, e2), add in ((left1, left2, 0), (right1, right2, 0), (left1, right2, 1), (right1, left2, 1)):
            keep = (e1 > s1) & (e2 > s2) & (err + add <= budget(depth + 1, errors))
            if add and s1 is cut1:
                keep &= ~self_pair
            # a node of one fingerprint paired with itself has no pair below it
            keep &= ~((s1 == s2) & (e1 - s1 == 1))
            out.append((s1[keep], e1[keep], s2[keep], e2[keep], (err + add)[keep]))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    size = np.bincount(label, minlength=n)
    member = np.flatnonzero(size[label] > 1)
    return values[member], values[label[member]]


def links(fps: DataFrame, errors: int = 4, leaf: int = 20_000) -> DataFrame:
    """(a, b): a forest that links distinct fingerprints ``fps.fp`` at ``errors`` or fewer differing bits.

    ``leaf``: node pairs with more fingerprints are refined before they become a task.
    """
    turned = fps.select(
        F.explode(F.array(*[F.struct(F.lit(r).alias("rot"), _rotated(r).alias("x")) for r in range(PARTS)])).alias("s")
    ).select("s.rot", "s.x")
    depth = 64 // PARTS
    nodes = turned.groupBy("rot", _node("x", depth).alias("u")).count().where("count > 1")
    frontier = nodes.select("rot", "u", F.col("u").alias("v"), F.col("count").alias("n"))
    leaves: list[DataFrame] = []
    while True:
        frontier = cut_lineage(frontier)
        small = frontier if depth == 64 else frontier.where(F.col("n") <= leaf)
        leaves.append(_members(turned, small, depth))
        large = frontier.where(F.col("n") > leaf)
        if depth == 64 or not large.head(1):
            break
        depth += STEP
        heavy = large.select("rot", F.explode(F.array("u", "v")).alias("up")).distinct()
        below = (
            turned.withColumn("up", _node("x", depth - STEP)).join(heavy, ["rot", "up"], "left_semi")
            .groupBy("rot", "up", _node("x", depth).alias("c")).count()
        )
        below = cut_lineage(below)
        one, two = (below.select("rot", F.col("up").alias(side), F.col("c").alias(f"c{side}"), F.col("count").alias(f"n{side}")) for side in "uv")
        pairs = large.drop("n").join(one, ["rot", "u"]).join(two, ["rot", "v"])
        err = F.bit_count(F.col("cu").bitwiseXOR(F.col("cv")))
        frontier = (
            pairs.where((F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv")))
            .where(err <= budget(depth, errors))
            .select("rot", F.col("cu").alias("u"), F.col("cv").alias("v"), F.when(F.col("cu") == F.col("cv"), F.col("nu")).otherwise(F.col("nu") + F.col("nv")).alias("n"))
            .where((F.col("u") != F.col("v")) | (F.col("n") > 1))
        )
    out = None
    for rows in leaves:
        out = rows if out is None else out.unionByName(rows)

    def kernel(table: pa.Table) -> pa.Table:
        rot, depth = table.column("rot")[0].as_py(), table.column("depth")[0].as_py()
        x = table.column("x").to_numpy().view(np.uint64)
        second = table.column("second").to_numpy(zero_copy_only=False)
        a, b = np.sort(x[~second]), np.sort(x[second])
        if not len(a) or len(x) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        member, first = descend(a, b if len(b) else None, depth, errors)
        back = lambda y: _turn(y, 64 - 8 * rot).view(np.int64)
        keep = member != first
        return pa.table({"a": back(member[keep]), "b": back(first[keep])})

    return out.groupBy("rot", "depth", "u", "v").applyInArrow(kernel, "a long, b long").distinct()


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _rotated(r: int):
    fp, by = F.col("fp"), r * (64 // PARTS)
    return fp if not r else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _node(x: str, depth: int):
    return F.col(x) if depth == 64 else F.shiftrightunsigned(F.col(x), 64 - depth)


def _members(turned: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """The fingerprints below both nodes of each pair."""
    sides = pairs.select(
        "rot", "u", "v",
        F.explode(F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("node"), F.lit(False).alias("second")))).otherwise(
            F.array(F.struct(F.col("u").alias("node"), F.lit(False).alias("second")), F.struct(F.col("v").alias("node"), F.lit(True).alias("second")))
        )).alias("s"),
    ).select("rot", "u", "v", "s.node", "s.second")
    return (
        turned.withColumn("node", _node("x", depth)).join(sides, ["rot", "node"])
        .select("rot", F.lit(depth).alias("depth"), "u", "v", "second", "x")
    )


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, errors: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) of the rows and (fp, root) of the fingerprints."""
    marked = cut_lineage(fingerprints(docs, doc_id, text, words))
    fps = cut_lineage(marked.select("fp").distinct())
    groups = components(links(fps, errors, leaf))
    named = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return marked, cut_lineage(named)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, errors: int = 4, leaf: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in ``errors`` or fewer bits are linked;
    component_id is the smallest doc_id that links reach, the row's own
    included.  Null and empty texts have fingerprint zero and are linked like
    any other.  Null ids don't count for the smallest, unless there is no other;
    rows with the same id are separate rows.  An empty table gives an empty one.
    """
    marked, named = _grouped(docs, doc_id, text, words, errors, leaf)
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("id")).join(named, "fp")
    lowest = first.groupBy("root").agg(F.min("id").alias("component_id"))
    by_fp = first.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, errors: int = 4, leaf: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group the row with the smallest id stays.

    Ids that are null come last; rows that repeat in full become one.
    """
    marked, named = _grouped(docs, doc_id, text, words, errors, leaf)
    lowest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")
    by_fp = marked.groupBy("fp").agg(lowest).join(named, "fp")
    chosen = by_fp.groupBy("root").agg(F.min("x").alias("x")).select("x.key")
    return matching(docs, chosen, "left_semi", doc_id, text)
