"""Repeated passages by merging the Burrows-Wheeler orders of shards around anchors.

A string of ``length`` bytes that starts twice makes its bytes repeated.  Sorting
all suffixes of a corpus isn't possible in bounded memory, and merging byte-wise
transforms takes as many passes over all bytes as the strings are long.  So the
order is built sparsely, and only where something repeats:

* The anchor of a start s is the place of the least hash among the SPAN 16-byte
  grams that begin at s, s + 1, ...  Equal strings have their anchor at the same
  distance, and neighbouring starts mostly share one, so that a text has an
  anchor for every hundred bytes or so.
* Every shard (task) gives its anchors with a hash of what all strings of the
  anchor have in common.  Anchors with the same hash are a block: an interval of
  the merged suffix order.  Blocks with one member hold no repeat and go.  Members
  with the same whole context repeat all their strings.
* In the blocks left, the orders of the shards are interleaved by the text right
  of the anchor, which also gives the common prefixes.  Then the interleaving is
  refined step by step to the left by the preceding byte (the transform's symbol):
  a stable distribution of the order so far, with the common prefixes carried
  along as minima over ranges.  No suffix is sorted again.  After t steps two
  neighbours with ``length`` bytes in common are a repeated string that starts t
  bytes before the anchor.
* A block with more than ``limit`` members is cut: the starts in two halves, which
  share longer texts, so that blocks split and equal members fold into one, until
  every block fits a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage, slices, text_of, utf8

LENGTH = 400
GRAM = 16
NONE = -(1 << 40)


def span_of(length: int) -> int:
    """Grams per start: the largest power of two that leaves the anchor 1/3 of the string."""
    return 1 << max(0, (length - length // 3 - GRAM).bit_length() - 1)


def _hash(view, seed: int = 0) -> int:
    x = xxhash.xxh3_64_intdigest(view, seed)
    return x - (1 << 64) if x >> 63 else x


def anchors(data: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of runs of ``starts`` (ascending) that share an anchor."""
    with np.errstate(over="ignore"):
        h = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64)[data]
        factor, m = np.uint64(0x9E3779B97F4A7C15), 1
        while m < GRAM:
            h = h[:-m] * factor + h[m:]
            factor, m = factor * factor, 2 * m
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while m < span:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return at[first], starts[first], starts[last]


def repeated(block: np.ndarray, context: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest t for which the string that starts t bytes before a member's anchor repeats in its block.

    ``context``: the texts of all strings of a member, ``anchor``: where the anchor
    lies in it, which is also its greatest t.  NONE where nothing repeats.
    """
    n = len(context)
    ahead = np.zeros((n, length), np.dtype(">u2"))
    behind = np.zeros((n, int(anchor.max()) + 1), np.uint16)
    reach = np.zeros(n, np.int64)
    for i, (x, a) in enumerate(zip(context, anchor.tolist(), strict=True)):
        right = np.frombuffer(x, np.uint8)[a : a + length]
        ahead[i, : len(right)] = right
        ahead[i, : len(right)] += 1
        reach[i] = len(right)
        behind[i, :a] = np.frombuffer(x, np.uint8)[:a][::-1]
    order = np.argsort(ahead.view(f"S{2 * length}")[:, 0], kind="stable")
    order = order[np.argsort(block[order], kind="stable")]
    same = ahead[order[1:]] == ahead[order[:-1]]
    common = np.where(same.all(1), length, same.argmin(1))
    common = np.minimum(common, np.minimum(reach[order[1:]], reach[order[:-1]]))
    lcp = np.concatenate([[NONE], np.where(block[order[1:]] == block[order[:-1]], common, NONE)])
    low, high = np.full(n, NONE), np.full(n, NONE)
    _, rank = np.unique(block, return_inverse=True)
    t = 0
    while True:
        most = np.maximum(lcp, np.append(lcp[1:], NONE))
        hit = order[most >= length]
        low[hit] = np.where(low[hit] == NONE, t, low[hit])
        high[hit] = t
        going = np.flatnonzero(anchor[order] > t)
        if len(going) < 2:
            return low, high
        key = rank[order[going]] * 256 + behind[order[going], t]
        turn = np.argsort(key, kind="stable")
        at, key = going[turn], key[turn]  # places in the old order, in the new one
        # common prefix of new neighbours: the least over the places between them, and the new byte
        table = [lcp]
        width = int((at[1:] - at[:-1])[key[1:] == key[:-1]].max(initial=1))
        while (1 << len(table)) <= width:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        new = np.full(len(at), NONE)
        pair = np.flatnonzero(key[1:] == key[:-1]) + 1
        a, b = at[pair - 1] + 1, at[pair]
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k, row in enumerate(table):
            own = level == k
            if own.any():
                new[pair[own]] = np.minimum(row[a[own]], row[b[own] - (1 << k) + 1]) + 1
        order, lcp, t = order[at], new, t + 1


def _anchor_rows(source: DataFrame, length: int) -> DataFrame:
    """(key, tie, block, member, p, low, high) of every anchor of ``source`` (tie, text)."""
    span = span_of(length)
    shared = length - span + 1
    names = ["key", "tie", "block", "member", "p", "low", "high"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            texts, ties = utf8(batch.column("text")), batch.column("tie").to_pylist()
            picked = [i for i, x in enumerate(texts) if len(x) >= length]
            if not picked:
                continue
            whole = b"".join(texts[i] for i in picked)
            sizes = np.array([len(texts[i]) for i in picked])
            ends = np.cumsum(sizes)
            n = sizes - length + 1
            starts = np.arange(int(n.sum())) + np.repeat(ends - sizes - np.cumsum(n) + n, n)
            p, first, last = anchors(np.frombuffer(whole, np.uint8), starts, span)
            view, doc = memoryview(whole), np.searchsorted(ends, p, side="right")
            keys = [_hash(texts[i]) for i in picked]
            high, low, begin = p - first, p - last, (ends - sizes)[doc]
            block = [_hash(view[a : a + shared]) for a in p.tolist()]
            member = [_hash(view[a : b + length], h) for a, b, h in zip(first.tolist(), last.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array([ties[picked[d]] for d in doc.tolist()], pa.int64()), pa.array(block, pa.int64()), pa.array(member, pa.int64()),
                 pa.array((p - begin).astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names,
            )

    return source.mapInArrow(kernel, "key long, tie long, block long, member long, p int, low int, high int")


def _packed(source: DataFrame) -> DataFrame:
    """(doc_id, tie, key, body): texts compressed for the shuffles to come."""
    kind = dict(source.dtypes)["doc_id"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            texts = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array([_hash(x) for x in texts], pa.int64()), pa.array([squeeze.compress(x) for x in texts], pa.binary())],
                ["doc_id", "tie", "key", "body"],
            )

    return source.mapInArrow(kernel, f"doc_id {kind}, tie long, key long, body binary")


def _contexts(packed: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """The text of each member (block, member, key, tie, p, low, high) from one document that has it."""
    places = members.groupBy("key", "tie").agg(F.collect_list(F.struct("block", "member", "p", "low", "high")).alias("at"))
    names = ["block", "member", "low", "high", "context"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for body, at in zip(batch.column("body").to_pylist(), batch.column("at").to_pylist(), strict=True):
                text = zstandard.ZstdDecompressor().decompress(body)
                for m in at:
                    row = (m["block"], m["member"], m["low"], m["high"], text[m["p"] - m["high"] : m["p"] - m["low"] + length])
                    for have, value in zip(out, row, strict=True):
                        have.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return packed.join(places, ["key", "tie"]).select("body", "at").mapInArrow(kernel, "block long, member long, low int, high int, context binary")


def _merge(rows: DataFrame, length: int, limit: int) -> DataFrame:
    """(block, member, low, high) for members that repeat in their block; many small blocks share a task."""
    tasks = max(1, -(-rows.count() // limit))

    def kernel(table: pa.Table) -> pa.Table:
        block, member = table.column("block").to_numpy(), table.column("member").to_numpy()
        # a member can come twice, from rows that repeat in full
        _, one = np.unique(np.stack([block, member], 1), axis=0, return_index=True)
        table = table.take(pa.array(one))
        block, member = block[one], member[one]
        context = table.column("context").to_pylist()
        low, high = repeated(block, context, table.column("high").to_numpy().astype(np.int64), length)
        hit = low != NONE
        return pa.table({"block": block[hit], "member": member[hit], "low": pa.array(low[hit].astype(np.int32)), "high": pa.array(high[hit].astype(np.int32))})

    columns = ["block", "member", "high", "context"]
    return rows.select(F.pmod("block", F.lit(tasks)).alias("task"), *columns).groupBy("task").applyInArrow(kernel, "block long, member long, low int, high int")


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Members of blocks that are too large, with their starts cut in two halves."""
    names = ["of_block", "of_member", "block", "member", "from", "to", "low", "high", "context"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                x, middle = r["context"], (r["from"] + r["to"]) // 2
                for a, b in ((r["from"], middle), (middle + 1, r["to"])):
                    low, high = max(r["low"], a), min(r["high"], b)
                    if a > b or low > high:
                        continue
                    own = x[r["high"] - high : r["high"] - low + length]
                    both = x[r["high"] - a : r["high"] - b + length]  # in all strings that start a to b bytes before the anchor
                    row = (r["block"], r["member"], _hash(both, a << 32 | b), _hash(own, low << 32 | high), a, b, low, high, own)
                    for have, value in zip(out, row, strict=True):
                        have.append(value)
            kinds = (*[pa.int64()] * 4, *[pa.int32()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    schema = "of_block long, of_member long, block long, member long, `from` int, `to` int, low int, high int, context binary"
    return rows.select("block", "member", "from", "to", "low", "high", "context").mapInArrow(kernel, schema)


def _folded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of ``rows`` once each, with how many there are (n) and the size of their block (m); and those that repeat whole."""
    once = rows.groupBy("block", "member").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*[c for c in rows.columns if c not in ("block", "member", "of_block", "of_member")])).alias("x"))
    once = cut_lineage(once.select("block", "member", "n", "x.*"))
    blocks = once.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).where("all > 1").select("block", "m")
    met = cut_lineage(once.join(blocks, "block"))
    return met, met.where("n > 1").select("block", "member", "low", "high")


def spans(source: DataFrame, packed: DataFrame, length: int, limit: int) -> DataFrame:
    """(key, spans): repeated byte ranges [from, to) of each text, by the hash of the text."""
    rows = cut_lineage(_anchor_rows(source, length))
    met, whole = _folded(rows)
    found = [whole]
    level = cut_lineage(_contexts(packed, met.where("m > 1"), length).join(met.select("block", "member", "m"), ["block", "member"]))
    level = level.withColumn("from", F.lit(0)).withColumn("to", F.lit(span_of(length) - 1))
    to_root: DataFrame | None = None
    while True:
        here = [_merge(level.where(F.col("m") <= limit), length, limit)] + ([] if to_root is None else [whole])
        part = here[0] if len(here) == 1 else here[0].unionByName(here[1])
        found.append(part if to_root is None else part.join(to_root, ["block", "member"]).select(F.col("root_block").alias("block"), F.col("root_member").alias("member"), "low", "high"))
        large = level.where(F.col("m") > limit)
        if not large.head(1):
            break
        halves = cut_lineage(_halved(large, length))
        links = halves.select("of_block", "of_member", "block", "member").distinct()
        if to_root is None:
            to_root = links.withColumnsRenamed({"of_block": "root_block", "of_member": "root_member"})
        else:
            up = to_root.withColumnsRenamed({"block": "of_block", "member": "of_member"})
            to_root = links.join(up, ["of_block", "of_member"]).select("root_block", "root_member", "block", "member").distinct()
        to_root = cut_lineage(to_root)
        level, whole = _folded(halves)
        level = level.where("m > 1")
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    best = cut_lineage(all_.groupBy("block", "member").agg(F.min("low").alias("least"), F.max("high").alias("most")))
    ranges = rows.join(best, ["block", "member"]).select("key", F.struct((F.col("p") - F.col("most")).alias("from"), (F.col("p") - F.col("least") + length).alias("to")).alias("r"))
    return ranges.distinct().groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, limit: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for every row of ``docs``.

    Every byte covered by a string of ``length`` bytes (UTF-8) that also starts
    anywhere else, in the same text or another, is removed; kept holds the other
    bytes.  Rows that repeat in full count as different places.  A null or short
    text loses nothing.  ``limit``: members a task compares.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    source = text_of(docs, doc_id, text).withColumn("tie", F.xxhash64("doc_id"))
    packed = _packed(source)
    known = spans(source.select("tie", "text"), packed, length, limit)
    kind = dict(source.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, left = [], [], [], []
            for body, at in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, end, kept, n, removed = zstandard.ZstdDecompressor().decompress(body), 0, [], 0, 0
                size.append(len(text))
                last = -1
                for r in at or ():
                    a, b = max(r["from"], end), r["to"]
                    if r["from"] > last:  # doesn't touch the run before
                        n += 1
                        kept.append(text[end : r["from"]])
                    removed += max(0, b - a)
                    end = max(end, b)
                    last = end
                kept.append(text[end:])
                gone.append(removed)
                runs.append(n)
                left.append(b"".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(left, pa.binary())], names)

    rows = packed.join(known, "key", "left").select("doc_id", "body", "spans")
    return rows.mapInArrow(kernel, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(rows: DataFrame) -> DataFrame:
    """The same rows with the hash of what is kept instead of its bytes."""
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """(bytes removed, runs, sha256 of the rest) by a table of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for x in texts:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for x in texts:
        cover = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = True
        rest = bytes(np.frombuffer(x, np.uint8)[~cover[:-1]])
        out.append((int(cover.sum()), int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out
