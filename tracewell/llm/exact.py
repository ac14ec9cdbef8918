"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every input partition (shard) sorts the 64-bit fingerprints of its texts, cuts
them by owner (their highest bits), and sends each owner the gaps in Golomb-Rice
code.  An owner meets the fingerprints of its range from all shards and answers
each message with a bitmap: which of the values sent were sent by others too.
Only rows that a bitmap marks are suspects, and only suspects' texts are
shuffled: they are grouped by their bytes, so no equal fingerprint is taken on
trust.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage, text_of

SPACE = r"[\x20\x09-\x0D]+"
OWNER_ROWS = 1 << 21


def golomb(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as a Golomb-Rice code of their gaps.

    Layout: count (8 bytes), first value (8), remainder width k (1), length of the
    unary part in bytes (8), unary quotients, remainders of k bits.
    """
    n = len(values)
    gaps = np.diff(values)
    mean = float(values[-1] - values[0]) / max(1, n - 1)
    k = max(0, min(56, int(math.log2(max(1.0, mean * math.log(2))))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(unary).tobytes()
    head = np.array([n], "<u8").tobytes() + values[:1].astype("<u8").tobytes() + bytes([k]) + np.array([len(packed)], "<u8").tobytes()
    return head + packed + np.packbits(low.ravel()).tobytes()


def ungolomb(code: bytes) -> np.ndarray:
    n, first = np.frombuffer(code, "<u8", 2, 0)
    k, size, n = code[16], int(np.frombuffer(code, "<u8", 1, 17)[0]), int(n)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 25)))[: n - 1]
    quotient = np.diff(stops, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(code, np.uint8, -1, 25 + size))[: (n - 1) * k].reshape(n - 1, k)
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    for j in range(k):
        gaps |= low[:, j].astype(np.uint64) << np.uint64(j)
    return np.concatenate([[first], first + np.cumsum(gaps, dtype=np.uint64)])


def normalised(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def _owner_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def suspects(rows: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(fp): fingerprints that occur more than once in ``rows.fp``, found by the exchange."""
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / owner_rows)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept, part = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, kept, part
            values, times = np.unique(np.concatenate(kept), return_counts=True)
            owner = _owner_of(values, bits)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for v, t in zip(np.split(values, cuts), np.split(times, cuts), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array(_owner_of(v[:1], bits)), pa.array([golomb(v)], pa.binary()), pa.array([np.packbits(t > 1).tobytes()], pa.binary())],
                    ["shard", "owner", "code", "twice"],
                )
            shard, kept, part = shard + 1, [], 0

        for batch in batches:
            kept.append(batch.column("fp").to_numpy().view(np.uint64))
            part += len(kept[-1])
            if part >= owner_rows:
                yield from flush()
        if part:
            yield from flush()

    def answer(table: pa.Table) -> pa.Table:
        codes, twice = table.column("code").to_pylist(), table.column("twice").to_pylist()
        sent = [ungolomb(x) for x in codes]
        values, times = np.unique(np.concatenate(sent), return_counts=True)
        repeated = values[times > 1]
        marks = [np.packbits(np.isin(v, repeated, assume_unique=True) | np.unpackbits(np.frombuffer(t, np.uint8))[: len(v)].astype(bool)).tobytes() for v, t in zip(sent, twice, strict=True)]
        return pa.table({"shard": table.column("shard"), "owner": table.column("owner"), "bitmap": pa.array(marks, pa.binary())})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, bitmap in zip(batch.column("code").to_pylist(), batch.column("bitmap").to_pylist(), strict=True):
                values = ungolomb(code)
                marked = values[np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(values)].astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(marked.view(np.int64))], ["fp"])

    messages = cut_lineage(rows.select("fp").mapInArrow(send, "shard long, owner long, code binary, twice binary"))
    bitmaps = messages.groupBy("owner").applyInArrow(answer, "shard long, owner long, bitmap binary")
    return messages.select("shard", "owner", "code").join(bitmaps, ["shard", "owner"]).select("code", "bitmap").mapInArrow(look_up, "fp long").distinct()


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for every row of ``docs``.

    Texts are equal when their bytes are after every run of white space became
    one space; null counts as empty.  Of equal texts the row with the smallest
    doc_id stays.  Rows with the same
    text and the same smallest doc_id all count as kept: kept says that the id
    stays.  A null id stays only when its text has no other id; then keep_id is null.  ``owner_rows`` bounds what an owner and a
    shard hold.
    """
    source = text_of(docs, doc_id, text)
    flat = source.select("doc_id", normalised(F.col("text")).alias("flat"))
    marks = cut_lineage(flat.select("doc_id", F.xxhash64("flat").alias("fp"), F.sha2(F.col("flat").cast("binary"), 256).alias("sha")))
    repeated = suspects(marks, owner_rows)
    met = flat.withColumn("fp", F.xxhash64("flat")).join(repeated, "fp", "left_semi")
    # rows with the same text come together here: the key is the whole text
    classes = met.groupBy("flat").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = cut_lineage(classes.select(F.sha2(F.col("flat").cast("binary"), 256).alias("sha"), "keep_id", "n"))
    named = marks.select("doc_id", "sha").join(classes.withColumn("met", F.lit(True)), "sha", "left")
    keep_id = F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("doc_id"))
    out = named.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
