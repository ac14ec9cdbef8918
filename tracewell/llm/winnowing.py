"""Benchmark decontamination by winnowing (columns only).

A window of ``window`` words has window - k + 1 shingles of k words; the least
of their hashes is its fingerprint.  Two equal windows have equal fingerprints
wherever they stand, so every shared window is met, and a text keeps few
different fingerprints, since neighbouring windows mostly share theirs.
Fingerprints of documents and benchmark are joined; in documents with a common
one the windows behind it are compared word for word.  A hit of any length is
the union of its windows.

Items with fewer words than a window are one short window each.  For the (at
most window - 1) lengths that occur, all shingles of that length are their own
fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, cut_lineage, matching, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingle_hashes(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n < k, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(words, i, k))))


def window_minima(hashes: Column, span: int) -> Column:
    n = F.size(hashes)
    return F.when(n < span, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), n - span + 1), lambda i: F.array_min(F.slice(hashes, i, span))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a name that projections can't expand again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prints(words: Column, n: int, window: int) -> Column:
    """The fingerprint of the window of n words at each position."""
    if n < window:
        return shingle_hashes(words, n)
    k = (window + 2) // 2
    return _let(shingle_hashes(words, k), lambda h: window_minima(h, window - k + 1))


def _windows(words: Column, hashes: Column, n: int) -> Column:
    """(len, at, h, win) of every window of n words."""
    return F.transform(hashes, lambda h, i: F.struct(F.lit(n).alias("len"), (i + 1).alias("at"), h.alias("h"), F.array_join(F.slice(words, i + 1, n), " ").alias("win")))


def _tagged(hashes: Column, n: int) -> Column:
    return F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(n).alias("len"), h.alias("h")))


def _met_windows(words: Column, met: Column, n: int, window: int) -> Column:
    """The windows of n words whose fingerprint is in ``met``."""
    at = lambda h, i: F.struct((i + 1).alias("at"), F.array_contains(met, F.struct(F.lit(n).alias("len"), h.alias("h"))).alias("is_met"))
    places = F.filter(F.transform(_prints(words, n, window), at), lambda s: s["is_met"])
    return F.transform(places, lambda s: F.struct(F.lit(n).alias("len"), s["at"].alias("at"), F.array_join(F.slice(words, s["at"], n), " ").alias("win")))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, key, n_words, n_hit, item_ids, contaminated): one row for every row of ``docs``; key is ``row_key``.

    n_hit counts the words inside any occurrence of a benchmark window; item_ids
    holds the ids, as text and sorted, of items with such a window.  A null text,
    or one without words, has no window.  Rows with one id and different texts are
    kept apart; rows that repeat in full get the same result each.  An item with a
    null id counts under the empty string; items with one id count once.  An empty
    benchmark hits nothing.
    """
    bench = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text)).alias("words"))
    bench = cut_lineage(bench.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window))))
    short = sorted(r["len"] for r in bench.select("len").distinct().collect() if r["len"] < window)  # at most window - 1 values
    lengths = [window, *short]
    wanted = None
    for n in lengths:
        rows = bench.where(F.col("len") == n)
        part = rows.select("item", F.explode(_windows(F.col("words"), _prints(F.col("words"), n, window), n)).alias("w")).select("item", "w.len", "w.h", "w.win")
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = cut_lineage(wanted.distinct())

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    spoken = _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*[_tagged(_prints(w, n, window), n) for n in lengths]).alias("prints")))
    picks = cut_lineage(source.select("doc_id", "key", spoken.alias("s")).select("doc_id", "key", "s.n_words", "s.prints"))
    met = (
        picks.select("key", F.explode("prints").alias("p")).select("key", "p.len", "p.h")
        .join(wanted.select("len", "h").distinct(), ["len", "h"])
        .groupBy("key").agg(F.collect_set(F.struct("len", "h")).alias("met"))
    )
    met = cut_lineage(met.withColumnRenamed("key", "of"))
    near = source.join(met, F.col("key") == F.col("of")).select("key", "met", "text").distinct()
    places = _let(words_of(F.col("text")), lambda w: F.concat(*[_met_windows(w, F.col("met"), n, window) for n in lengths]))
    placed = near.select("key", places.alias("places"))
    hits = placed.select("key", F.explode("places").alias("p")).select("key", "p.len", "p.at", "p.win").join(wanted.select("len", "win", "item"), ["len", "win"])
    spans = F.array_sort(F.collect_set(F.struct("at", "len")))
    found = hits.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["end"], s["at"]))).alias("n")),
        lambda a: a["n"],
    )
    found = found.select(F.col("key").alias("of"), covered.cast("long").alias("n_hit"), "item_ids")
    rows = picks.select("doc_id", "key", "n_words").join(found, F.col("key") == F.col("of"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs."""
    marked = contamination(docs, items, doc_id, text, window=window)
    return matching(docs, cut_lineage(marked.where("contaminated").select("key").distinct()), "left_anti", doc_id, text)
