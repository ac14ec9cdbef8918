"""What the text operators share: reading columns, Arrow batches, tables in the shared folder, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

__all__ = ["ascii_lower", "attach_sized", "cut_lineage", "matching", "read", "residue", "row_key", "slices", "text_of", "unused", "utf8"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text counts as empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def row_key(doc_id: str, text: str) -> Column:
    """One number for an id and a text; null counts as empty text."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matching(docs: DataFrame, keys: DataFrame, how: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Semi or anti join of ``docs`` with ``keys.key`` on ``row_key``; semi leaves rows that repeat in full once."""
    name = unused(docs, "row_key")
    rows = docs.withColumn(name, row_key(doc_id, text)).join(keys.select(F.col("key").alias(name)), name, how)
    return (rows.dropDuplicates([name]) if how == "left_semi" else rows).drop(name)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def residue(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


HOT = 1000


def attach_sized(rows: DataFrame, facts: DataFrame, on: list[str], size: str) -> DataFrame:
    """Join facts, one row per key with the number of its rows in ``size``, to the rows they were counted from.

    Keys with more than a thousandth of all rows are fewer than a thousand: they
    are broadcast, and no other key is large enough to burden a task.  ``facts``
    is read three times and ``rows`` twice, so they should be tables.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) * HOT > total
    marked = rows.join(F.broadcast(facts.where(often).withColumn("_often", F.lit(True))), on, "left")
    usual = marked.where("_often IS NULL").select(*rows.columns).join(facts.where(~often), on)
    return marked.where("_often").select(*usual.columns).unionByName(usual)
