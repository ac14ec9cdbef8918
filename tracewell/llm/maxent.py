"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) * p(word | class).  The first factor is a
log-linear model over the classes: its features are the last word, the words two
and three back (skips), the last two words together and the last three classes,
each hashed to a row of one weight table.  The second is the log-linear model
whose only feature is the word itself; its maximum likelihood is known in closed
form (smoothed counts within the class).

Training is a round of distributed gradient updates: every task goes over its
documents in small batches with a copy of the weights and sends what it has
changed, with the number of tokens behind each row; changes are added up in two
levels and averaged row by row.  Scores come from sparse NumPy batches: five rows
of the table for a token.

Word counts are a table, not a dictionary in memory.  The ``top`` most frequent
words go to all tasks (a bounded table); the rest of a text's words are joined to
their counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut_lineage, residue, slices, text_of, utf8

END = b"\n"
CLASSES = 64
SINGLES = 24
ROWS = 1 << 14
BATCH = 2048
STRIP = 256
TOP = 1 << 17
LONGEST = 64
CACHE = 1 << 19
SMOOTH = 0.1
HELD = 10


def words_of(data: bytes) -> list[bytes]:
    """A-Z lower-cased words and the end token."""
    return [*data.lower().split(), END]


@dataclass
class Model:
    """What tasks need: the frequent words with their counts, classes, weights."""

    top: dict[bytes, int]  # word -> rank
    counts: np.ndarray  # by rank
    singles: dict[bytes, int]
    bias: np.ndarray
    weights: np.ndarray
    total: int = 0
    distinct: int = 0
    in_class: np.ndarray | None = None  # log10 of each class's denominator

    def class_of(self, word: bytes) -> int:
        """Its own class for a very frequent word, else one shared by words that end alike."""
        own = self.singles.get(word)
        return own if own is not None else SINGLES + zlib.crc32(word[-3:]) % (CLASSES - SINGLES)


class Packed(dict):
    """word -> rank + 1 (0: not in the table), class and hash in one integer."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: bytes) -> int:
        out = (self.model.top.get(word, -1) + 1) << 40 | self.model.class_of(word) << 32 | zlib.crc32(word)
        if len(self) < CACHE and len(word) <= LONGEST:
            self[word] = out
        return out


def features(texts: list[list[bytes]], packed: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the weight table by feature, classes, ranks) of all tokens of ``texts``, one after the other."""
    seq: list[int] = []
    for words in texts:
        seq += (0, 0, 0)
        seq += map(packed.__getitem__, words)
    x = np.array(seq, np.int64)
    sizes = np.array([len(w) for w in texts])
    at = np.arange(int(sizes.sum())) + 3 * np.repeat(np.arange(1, len(texts) + 1), sizes)
    word, cls = (x & 0xFFFFFFFF).view(np.uint64), (x >> 32 & 0xFF).view(np.uint64)

    def row(value: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (value + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)

    one, two, three = word[at - 1], word[at - 2], word[at - 3]
    shape = cls[at - 1] << np.uint64(16) | cls[at - 2] << np.uint64(8) | cls[at - 3]
    rows = np.stack([row(one, 1), row(two, 2 << 33), row(three, 3 << 33), row(one << np.uint64(31) ^ two, 5 << 33), row(shape, 7 << 33)])
    return rows, cls[at].astype(np.int64), x[at] >> 40


def log_classes(rows: np.ndarray, bias: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], 0)
    part = np.empty_like(z)
    for own in rows[1:]:
        z += weights.take(own, 0, part, "clip")
    z += bias
    z -= z.max(1, keepdims=True)
    np.exp(z, part)
    z -= np.log(part.sum(1, keepdims=True))
    return z


def sums_by_row(own: np.ndarray, g: np.ndarray, often: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, its number, sum of its gradients) for the rows of the weight table in ``own``.

    Most rows occur once or a few times in a batch: their k-th gradients are added
    at once for all of them, and only rows met more than ``often`` are summed alone.
    """
    order = own.astype(np.uint16).argsort(kind="stable")  # ROWS is below 2**16, which is sorted by radix
    ids = own[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    n = np.diff(first, append=len(order))
    total = g.take(order[first], 0)
    k, left = 1, np.flatnonzero((n > 1) & (n <= often))
    while len(left):
        total[left] += g.take(order[first[left] + k], 0)
        k += 1
        left = left[n[left] > k]
    for i in np.flatnonzero(n > often).tolist():
        g.take(order[first[i] : first[i] + n[i]], 0).sum(0, out=total[i])
    return ids[first], n, total


def learn(rows: np.ndarray, classes: np.ndarray, bias: np.ndarray, weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, rate: float) -> None:
    """One batch of gradient descent, in place; ``squares`` slows down rows that have moved much."""
    g = log_classes(rows, bias, weights)
    np.exp(g, g)
    g[np.arange(len(g)), classes] -= 1
    for own in rows:  # one feature after the other, on the same gradient
        ids, n, move = sums_by_row(own, g)
        squares[ids] += np.einsum("ij,ij->i", move, move) / CLASSES
        touched[ids] += n
        move *= (rate / np.sqrt(squares[ids]))[:, None]
        weights[ids] = np.subtract(weights.take(ids, 0), move, move)
    bias -= rate * 0.1 * g.mean(0)


def count_words(docs: DataFrame, limit: int = 1 << 19) -> DataFrame:
    """(word, c) over ``docs.text``; a task sends its counts whenever it holds ``limit`` different words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
        for batch in slices(batches, "text"):
            for data in utf8(batch.column("text")):
                seen.update(words_of(data))
                if len(seen) >= limit:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(kernel, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def prepare(counts: DataFrame, top: int = TOP) -> Model:
    """Frequent words, classes and their sizes from the table of counts; the weights are zero."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # a cut that at most ``top`` words pass: counts by eighths of an octave, then only what lies above
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("octave", F.floor(F.log2("c") * 8))
    cut, room = None, top
    for r in sorted(short.groupBy("octave").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        cut = r["octave"]
    rows = short.where(F.col("octave") >= cut).collect() if cut is not None else []
    rows.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in rows]
    model = Model({w: i for i, w in enumerate(words)}, np.array([r["c"] for r in rows], np.float64), {w: i for i, w in enumerate(words[:SINGLES])}, np.zeros(CLASSES, np.float32), np.zeros((ROWS, CLASSES), np.float32), total, distinct)
    singles = model.singles
    shared = counts.sparkSession.sparkContext.broadcast(Model({}, np.zeros(0), singles, model.bias, model.bias))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            own = np.array([shared.value.class_of(w) for w in utf8(batch.column("word"))], np.int64)
            n += np.bincount(own, batch.column("c").to_numpy(), CLASSES).astype(np.int64)
            v += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["class", "n", "v"])

    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(kernel, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    # a class of one frequent word has no unseen words
    unseen = np.where(np.arange(CLASSES) < len(singles), 0, 1)
    model.in_class = np.log10(np.maximum(n + SMOOTH * (v + unseen), SMOOTH))
    p = n + SMOOTH * (v + 1)
    model.bias = np.log(p / p.sum()).astype(np.float32)
    return model


def train(docs: DataFrame, model: Model, rounds: int = 1, rate: float = 0.5, fan: int = 64) -> Model:
    """``rounds`` passes of distributed updates over ``docs.text``; ``fan`` bounds what a first-level sum reads."""
    spark = docs.sparkSession

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            packed, bias, weights = Packed(own), own.bias.copy(), own.weights.copy()
            squares, touched = np.ones(ROWS, np.float32), np.zeros(ROWS, np.float32)
            for batch in slices(batches, "text", 1 << 20):
                rows, classes, _ = features([words_of(x) for x in utf8(batch.column("text"))], packed)
                for i in range(0, len(classes), BATCH):
                    learn(rows[:, i : i + BATCH], classes[i : i + BATCH], bias, weights, squares, touched, rate)
            if touched.any():
                change = (weights - own.weights) * touched[:, None]
                part = TaskContext.get().partitionId()
                for i in range(0, ROWS, STRIP):
                    n = touched[i : i + STRIP]
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part]), pa.array([n.tobytes()], pa.binary()), pa.array([change[i : i + STRIP].tobytes()], pa.binary())], ["strip", "part", "n", "change"])

        def add(table: pa.Table) -> pa.Table:
            total = [np.zeros(len(table.column(c)[0].as_py()) // 4, np.float32) for c in ("n", "change")]
            for have, c in zip(total, ("n", "change"), strict=True):
                for x in table.column(c):
                    have += np.frombuffer(x.as_buffer(), np.float32)
            return pa.table({"strip": [table.column("strip")[0].as_py()], "slot": [0], "n": pa.array([total[0].tobytes()], pa.binary()), "change": pa.array([total[1].tobytes()], pa.binary())})

        kind = "strip long, slot long, n binary, change binary"
        sent = docs.select("text").mapInArrow(kernel, "strip long, part long, n binary, change binary")
        once = sent.withColumn("slot", F.floor(F.col("part") / fan)).groupBy("strip", "slot").applyInArrow(add, kind)
        for r in once.groupBy("strip").applyInArrow(add, kind).select("strip", "n", "change").collect():  # the weight table, once
            n = np.frombuffer(r["n"], np.float32)
            change = np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
            model.weights[r["strip"] : r["strip"] + len(n)] += change / np.maximum(n, 1)[:, None]
    return model


def score(docs: DataFrame, counts: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    source = docs.select(F.col(doc_id).alias("doc_id"), (residue(doc_id, HELD) == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "known", "log_counts", "rest", "rare"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        packed, log_top = Packed(own), np.concatenate([[0.0], np.log10(own.counts + SMOOTH)])
        for batch in slices(batches, "text", 1 << 20):
            texts = [words_of(x) for x in utf8(batch.column("text"))]
            rows, classes, ranks = features(texts, packed)
            logs = np.empty(len(classes))
            for i in range(0, len(classes), BATCH):
                part = log_classes(rows[:, i : i + BATCH], own.bias, own.weights)
                logs[i : i + len(part)] = part[np.arange(len(part)), classes[i : i + len(part)]]
            logs = logs / np.log(10) - own.in_class[classes]
            end = np.cumsum([len(w) for w in texts])
            start = end - [len(w) for w in texts]
            rare: list[list[dict]] = []
            lost = np.flatnonzero(ranks == 0)
            cut = np.searchsorted(lost, np.concatenate([start, end[-1:]])).tolist()
            for d, words in enumerate(texts):
                here = Counter([words[i] for i in (lost[cut[d] : cut[d + 1]] - start[d]).tolist()])
                rare.append([{"word": w, "n": n} for w, n in here.items()])
            total = lambda x: np.add.reduceat(x, start)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(end - start), pa.array(total((ranks > 0).astype(np.int64))), pa.array(total(log_top[ranks])), pa.array(total(logs)),
                 pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))], names,
            )

    kind = dict(source.dtypes)["doc_id"]
    done = source.mapInArrow(kernel, f"doc_id {kind}, held_out boolean, n_tokens long, known long, log_counts double, rest double, rare array<struct<word: binary, n: long>>")
    done = cut_lineage(done.withColumn("row", F.monotonically_increasing_id()))
    rare = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    c = F.coalesce("c", F.lit(0))
    looked_up = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("met"))
    rows = done.drop("rare").join(looked_up, "row", "left")
    logs = F.col("log_counts") + F.coalesce("more", F.lit(0.0))
    bottom = float(np.log10(model.total + SMOOTH * (model.distinct + 1)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * bottom).alias("base_score"), (logs + F.col("rest")).alias("score"),
    )


def language_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 1, top: int = TOP) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 10 isn't 0, score all rows.

    A null or empty text is the end token alone.  With no rows to learn from, all
    words are unknown.  Rows that repeat are learned from and scored each.
    """
    learned = text_of(docs.where(residue(doc_id, HELD) != 0), doc_id, text)
    counts = cut_lineage(count_words(learned))
    model = train(learned, prepare(counts, top), rounds)
    return score(docs, counts, model, doc_id, text)
