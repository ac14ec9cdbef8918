"""Toxicity: a convolutional text classifier in NumPy.

Words are hashed, whole and by their first letters, into one embedding table.
Filters of several widths slide over the embedded text; each filter keeps its
highest answer in the whole text (max pooling), and a logistic layer adds them
up.  An embedding starts from how unevenly its word is spread over the two
labels (0 for words never met, so the length of a text alone moves nothing) and
is trained with the filters by gradient descent.

A threshold for each language is calibrated on rows kept out of the training;
the language is guessed from the words, so the score depends on the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import residue, slices, text_of

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
PREFIX = 5
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
ROWS = 6000
CACHE = 1 << 18


class Hashed(dict):
    """word -> bucket of the word, and of its first letters, in one integer."""

    def __missing__(self, word: str) -> int:
        whole = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        start = zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) % BUCKETS
        out = self[word] = whole * BUCKETS + start
        return out


_HASHED = Hashed()


def words(text: str) -> np.ndarray:
    """Buckets of the words of a text: two columns; a text without words is one unknown word."""
    if len(_HASHED) > CACHE:
        _HASHED.clear()
    both = np.array([_HASHED[w] for w in WORD.findall(text.lower())] or [0], np.int64)
    return np.stack([both // BUCKETS, both % BUCKETS], 1)


class Model:
    """Embeddings, filters, logistic layer, language guesser and thresholds."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS, DIM), np.float32)
        self.filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :])
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.base = np.float32(0.0)
        self.language = np.zeros((BUCKETS, 1), np.float32)
        self.threshold = np.zeros(1, np.float32)

    def table(self) -> np.ndarray:
        """embedding x filter for every width and place side by side, so that a convolution is a sum of rows."""
        out = np.empty((BUCKETS, sum(WIDTHS) * FILTERS), np.float32)
        for k, own in enumerate(f[j] for f in self.filters for j in range(len(f))):
            out[:, k * FILTERS : (k + 1) * FILTERS] = self.embed @ own
        return out

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The highest answer of every filter, and where it was."""
        best, place = [], []
        e = self.embed[x[:, 0]] + self.embed[x[:, 1]]
        for f in self.filters:
            n = max(1, len(x) - len(f) + 1)
            total = np.zeros((n, FILTERS), np.float32)
            for j in range(min(len(f), len(x) - n + 1)):  # words missing from a short text answer nothing
                total += e[j : j + n] @ f[j]
            where = total.argmax(0)
            best.append(total[where, np.arange(FILTERS)])
            place.append(where)
        return np.maximum(np.concatenate(best) + self.bias, 0), place

    def highest(self, x: np.ndarray, table: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """The same highest answers from ``table``, block by block for texts of any length."""
        most, reach = np.full(len(self.bias), -np.inf, np.float32), max(WIDTHS) - 1
        for i in range(0, max(1, len(x) - reach), block):
            part = x[i : i + block + reach]
            rows = table[part[:, 0]]
            rows += table[part[:, 1]]
            at = 0
            for k, w in enumerate(WIDTHS):
                n = max(1, len(part) - w + 1)
                total = rows[:n, at : at + FILTERS]
                for j in range(1, min(w, len(part) - n + 1)):
                    total = total + rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                own = most[k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, total.max(0), out=own)
                at += w * FILTERS
        return np.maximum(most + self.bias, 0)

    def guess(self, x: np.ndarray) -> int:
        return int(self.language[x[:, 0]].sum(0).argmax())

    def logit(self, x: np.ndarray, table: np.ndarray | None = None) -> float:
        h = self.pooled(x)[0] if table is None else self.highest(x, table)
        return float(h @ self.out + self.base)

    def score(self, x: np.ndarray, table: np.ndarray | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(x, table) - self.threshold[self.guess(x)], -60, 60))))


def train(rows: list[tuple[np.ndarray, int, str]], epochs: int = 6, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit on (words, label, language) rows; every fifth row calibrates the thresholds only.

    With one label only, the model answers that label for every text.
    """
    model, r = Model(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y, _ in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        model.out[:] = 0
        model.base = np.float32(3.0 if len(rows) and labels[0] else -3.0)
        return model
    fit = [i for i in range(len(rows)) if i % 5]
    if len({labels[i] for i in fit}) < 2:
        fit = list(range(len(rows)))
    # in how many documents of either label each bucket occurs
    seen = np.zeros((2, BUCKETS), np.float32)
    for i in fit:
        seen[int(labels[i])][np.unique(rows[i][0])] += 1
    share = labels[fit].mean()
    all_ = seen.sum(0)
    model.embed[:, 0] = np.clip((seen[1] - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1) / 5, -1, 2)
    model.base = np.float32(np.log(share / (1 - share)) - 1)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in r.permutation(fit):
            x, y, _ = rows[i]
            h, place = model.pooled(x)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.base, -30, 30)))
            g = np.float32((p - y) * weight[i] * step)
            back = g * model.out * (h > 0)
            model.out -= g * h
            model.base -= g
            model.bias -= back
            for k, f in enumerate(model.filters):
                own = back[k * FILTERS : (k + 1) * FILTERS]
                for j in range(min(len(f), len(x))):
                    at = x[np.minimum(place[k] + j, len(x) - 1)]
                    e = model.embed[at[:, 0]] + model.embed[at[:, 1]]
                    move = own[:, None] * f[j].T
                    f[j] -= e.T * own
                    np.subtract.at(model.embed, at[:, 0], move)
                    np.subtract.at(model.embed, at[:, 1], move)
    names = sorted({z for _, _, z in rows})
    counts = np.full((BUCKETS, len(names)), 0.05, np.float32)
    for x, _, z in rows:
        counts[:, names.index(z)] += np.bincount(x[:, 0], minlength=BUCKETS)
    model.language = np.log(counts / counts.sum(0)).astype(np.float32)
    model.language -= model.language.mean(1, keepdims=True)
    model.threshold = np.zeros(len(names), np.float32)
    held = [rows[i] for i in range(len(rows)) if i % 5 == 0]
    logits = np.array([model.logit(x) for x, _, _ in held])
    truth, tongue = np.array([y for _, y, _ in held]), np.array([model.guess(x) for x, _, _ in held])
    whole = _best_cut(logits, truth)
    for k in range(len(names)):
        own = tongue == k
        model.threshold[k] = _best_cut(logits[own], truth[own]) if truth[own].sum() >= 5 else whole
    return model


def _best_cut(logits: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the widest gap between logits that gives the best F1."""
    if not truth.any():
        return 0.0
    order = np.argsort(-logits)
    hit = np.cumsum(truth[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + truth.sum())
    sorted_ = logits[order]
    low = np.append(sorted_[1:], sorted_[-1] - 2)
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = good[(sorted_ - low)[good].argmax()]
    return float(np.float64(sorted_[k] + low[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", rows: int = ROWS) -> Model:
    """Train on labelled rows whose crc32(doc_id) mod 5 isn't 0.

    ``rows`` bounds the sample: at most half of it from either label, chosen by a
    hash of the id, each with its whole text.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(residue("id", 5) != 0).withColumn("h", F.xxhash64("id", F.lit(1)))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    chosen = source.join(picked, "id").select("id", "h", "y", "lang", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashed = pa.array([words(x).astype(np.int32).tobytes() for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "y", "lang")), hashed], ["id", "h", "y", "lang", "words"])
        _HASHED.clear()

    got = chosen.mapInArrow(kernel, f"id {dict(chosen.dtypes)['id']}, h long, y int, lang string, words binary").collect()
    got.sort(key=lambda r: (r["h"], zlib.crc32(r["words"])))
    return train([(np.frombuffer(r["words"], np.int32).reshape(-1, 2), r["y"], r["lang"]) for r in got])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, held_out, score, predicted): one row for every row of ``docs``.

    predicted is 1 from a score of 0.5 on.  A null text counts as empty; a text
    without words gets the score of an unknown word.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), *keep, (residue(doc_id, 5) == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep, "held_out"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in slices(batches, "_body"):
            scores = np.array([own.score(words(x), table) for x in batch.column("_body").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
            )
        _HASHED.clear()  # what follows in this worker needs the memory

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "_body")
    return source.mapInArrow(kernel, f"{schema}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in slices(batches, text):
            keep = [own.score(words(x or ""), table) < 0.5 for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        _HASHED.clear()

    return docs.mapInArrow(kernel, docs.schema)
