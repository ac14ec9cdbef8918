"""How far the sources of a language differ, from joint tables of count levels.

A source's price for a term depends only on how often the term occurs there, its
count level.  So the distance of two sources is a sum over pairs of levels,
weighted by how many terms have the one level here and the other there.  These
joint tables come from one matrix: a row for each term, a column for each
(source, level) that occurs, one where the term has that level.  The matrix times
its transpose holds the joint tables of all sources at once.

On Spark: tasks count words before the shuffle.  Each kept term becomes one row
with its sources and levels; tasks take such rows in blocks with a bounded number
of columns, multiply the block's matrix with its transpose, and send on the
entries that aren't zero, which Spark adds up by pair of columns.  Level zero, by
far the most frequent, never enters a product: what it contributes follows from
the sizes of the levels.  Languages with many sources are cut into blocks of
sources too, and every two blocks meet in rows of their own.  All arithmetic is
in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage
from tracewell.operators.ordered import attach_facts, join_facts, with_salt, with_salt_copies

LEAST_DOCS = 10
TOP = 10
SOURCES = 256  # sources in a block of sources
COLUMNS = 512  # columns of a block of the matrix
TERMS = 256  # rows of a block of the matrix
HELD = 400_000  # counted terms that a task holds before it hands them on
PIECE = 1 << 22  # bytes of a text that are split at a time
UNIT = 1_000_000_000  # fixed value

# A-Z to a-z, other letters and all bytes beyond ASCII stay, the rest separates
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time."""
    spaced = text.translate(LETTERS)
    at = 0
    while at < len(spaced):
        end = len(spaced) if len(spaced) - at <= PIECE else spaced.find(b" ", at + PIECE)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group; a null term marks the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def flush(total: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        for (a, b), counts in total.items():
            terms = [None, *counts]
            n = [0, *counts.values()]
            inside = seen[a, b]
            found = [0, *[inside[t] for t in counts]]
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(part), pa.string()), pa.array([b] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array(n[at : at + (1 << 16)], pa.int64()), pa.array(found[at : at + (1 << 16)], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], Counter] = {}
        seen: dict[tuple[str, str], Counter] = {}
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            texts = batch.column("text").cast(pa.binary())
            for key, x in zip(groups, texts, strict=True):
                n, d = total.setdefault(key, Counter()), seen.setdefault(key, Counter())
                own: set[bytes] = set()
                for piece in words(x.as_py()):
                    n.update(piece)
                    own.update(piece)
                d.update(own)
            if sum(len(x) for x in total.values()) > HELD:
                yield from flush(total, seen)
                total, seen = {}, {}
        yield from flush(total, seen)

    parts = rows.mapInArrow(kernel, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); null where there are no terms."""
    above = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", above, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")) + 1


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of two prices."""
    apart = F.col(p) - F.col(q)
    return F.call_function("div", apart * apart, F.col(p) + F.col(q))


def products(term: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (a, b, n) with a < b of the one-hot matrix times its transpose; ``term`` is sorted.

    Blocks have at most ``TERMS`` rows, and fewer where more than ``COLUMNS``
    columns would meet.  The entries are whole numbers far below 2^24.
    """
    out = [np.empty((3, 0), np.int64)]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
    edge = np.append(first, len(term))
    at = 0
    while at < len(first):
        step = min(TERMS, len(first) - at)
        while step > 1 and len(np.unique(column[edge[at] : edge[at + step]])) > COLUMNS:
            step //= 2
        rows = slice(edge[at], edge[at + step])
        names, where = np.unique(column[rows], return_inverse=True)
        hot = np.zeros((step, len(names)), np.float32)
        hot[np.repeat(np.arange(step), np.diff(edge[at : at + step + 1])), where] = 1
        joint = np.triu(hot.T @ hot, 1)
        a, b = np.nonzero(joint)
        out.append(np.stack([names[a], names[b], joint[a, b].astype(np.int64)]))
        at += step
    a, b, n = np.concatenate(out, 1)
    pair, at = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    return pair[0], pair[1], np.bincount(at, n, pair.shape[1]).astype(np.int64)


def joint_levels(rows: DataFrame) -> DataFrame:
    """(lang, g, p, z, h, q, y, n): how many terms have price p in source g and q in source h, both of levels above zero.

    ``rows``: lang, term, source, p, z (the price of level zero), parts (blocks of
    sources of the language).  g is the source that comes first.
    """
    part = F.pmod(F.xxhash64("source"), F.col("parts")).cast("int")
    met = rows.select("lang", "term", "source", "p", "z", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    terms = met.groupBy("lang", "i", "j", "term").agg(F.collect_list(F.struct("source", "part", "p", "z")).alias("levels")).where(F.size("levels") > 1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("levels")
            each = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            level = lists.flatten()
            source = level.field("source").dictionary_encode()
            by_name = np.argsort(np.array(source.dictionary.to_pylist(), object), kind="stable")
            number = np.argsort(by_name)[source.indices.to_numpy()]
            part, p, z = (level.field(c).to_numpy() for c in ("part", "p", "z"))
            # a column of the matrix is a language, a block of sources, a source and a price
            lang = batch.column("lang").dictionary_encode()
            keys = np.stack([lang.indices.to_numpy()[each], number, p, part, z], 1)
            group = np.stack([keys[:, 0], batch.column("i").to_numpy()[each], batch.column("j").to_numpy()[each]], 1)
            blocks, at = np.unique(group, axis=0, return_inverse=True)
            for k in range(len(blocks)):
                mine = np.flatnonzero(at == k)
                names, column = np.unique(keys[mine], axis=0, return_inverse=True)
                # terms with few occurrences side by side: they share most of their columns
                top = np.zeros(batch.num_rows, np.int64)
                np.maximum.at(top, each[mine], p[mine])
                order = np.lexsort((each[mine], top[each[mine]]))
                a, b, n = products(each[mine][order], column[order])
                keep = (names[a, 3] != names[b, 3]) | (blocks[k, 1] == blocks[k, 2])
                a, b, n = names[a[keep]], names[b[keep]], n[keep]
                name = lambda x: source.dictionary.take(pa.array(by_name[x[:, 1]]))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(a[:, 0])), name(a), pa.array(a[:, 2]), pa.array(a[:, 4]), name(b), pa.array(b[:, 2]), pa.array(b[:, 4]), pa.array(n)],
                    ["lang", "g", "p", "z", "h", "q", "y", "n"],
                )

    schema = "lang string, g string, p long, z long, h string, q long, y long, n long"
    names = ["lang", "g", "p", "z", "h", "q", "y"]
    return terms.mapInArrow(kernel, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of a language apart.

    Part ``pair``: every other source of the language and its distance, over all
    terms in at least ``least`` documents of the language.  Part ``term``: the
    ``top`` terms that cost more here than in the whole language.  rank counts
    from 1, by value descending and item ascending.

    Null text, language and source count as empty.  A group without terms, and a
    language without kept terms, still have their pairs; a language of one source
    has none.  Rows that repeat count as often as they occur; texts of any length
    are split in pieces; other columns, whatever their names, are ignored; an
    empty table gives an empty one.
    """
    counts = cut_lineage(term_counts(docs, text, lang, source))
    groups = counts.where("term IS NULL").select("lang", "source")
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    used = cut_lineage(terms.drop("docs").join(kept, ["lang", "term"]))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("parts"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("all"))
    facts = groups.join(totals, ["lang", "source"], "left").join(sizes.join(whole, "lang", "left"), "lang")
    facts = facts.na.fill(0, ["total", "terms", "all"]).withColumn("z", price(F.lit(0), F.col("total"), F.col("terms")))
    facts = cut_lineage(facts)  # one row per source
    priced = attach_facts(used, facts, ["lang", "source"], few=True)
    priced = priced.withColumns({"p": price(F.col("n"), F.col("total"), F.col("terms")), "q": price(F.col("whole"), F.col("all"), F.col("terms"))})
    priced = cut_lineage(priced.select("lang", "source", "term", "p", "q", "z", "parts"))

    joint = joint_levels(priced.drop("q"))
    both = F.col("n") * (distance("p", "q") - distance("p", "y") - distance("z", "q") + distance("z", "y"))
    found = joint.select("lang", "g", "h", both.alias("value"))
    # level zero: all terms of a level meet level zero but for those counted above
    levels = priced.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("n"))
    other = facts.select("lang", F.col("source").alias("h"), F.col("z").alias("y"))
    beside = lambda rows: join_facts(with_salt(rows), with_salt_copies(other), ["lang", "_salt"], "inner").drop("_salt").where("g <> h")
    single = beside(levels.withColumnRenamed("source", "g")).select("lang", "g", "h", (F.col("n") * (distance("p", "y") - distance("z", "y"))).alias("value"))
    base = beside(facts.select("lang", F.col("source").alias("g"), "terms", "z"))
    base = base.select("lang", "g", "h", F.coalesce(F.col("terms") * distance("z", "y"), F.lit(0)).alias("value"))
    halves = found.unionByName(single)
    swapped = halves.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")
    pairs = halves.unionByName(swapped).unionByName(base).groupBy("lang", F.col("g").alias("source"), F.col("h").alias("item")).agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    dear = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))
    dear = dear.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(dear).select("lang", "source", "part", "item", "value", "rank")
