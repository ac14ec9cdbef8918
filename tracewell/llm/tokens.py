"""Token ids of a corpus in binary blocks: tokenise, count, code, write, read back.

Documents are put in ascending order by a range shuffle.  Each task tokenises
its range and packs the ids of consecutive documents into segments; the ids of
all segments give one table of frequencies, which every block is coded with (see
``rans``).  A segment is one row of the written table: the ids and lengths of
its documents, and its coded blocks.  Where a document starts in the corpus
follows from the sizes of the segments before its own.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import rans
from tracewell.llm.common import cut_lineage, slices, text_of

END = 0
SEGMENT = 1 << 18
KEPT = 1 << 18
LONGEST = 48
_WORDS: dict[str, "Words"] = {}


def _ranges(codes: list[int]) -> str:
    """The inside of a character class."""
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


# letters of Latin, Greek and Cyrillic are what every edition of the letter class agrees on
_LETTER = _ranges([c for c in range(0x530) if chr(c).isalpha()])
_SPACE = " \t\n\v\f\r"
WORD = re.compile(f" ?[{_LETTER}]+")
OTHER = re.compile(f"[^{_SPACE}!-~{_LETTER}]")
CUT = re.compile(f" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Ids (32-bit little-endian bytes) of pieces of text that were met before in this process.

    A text of ASCII and Latin, Greek or Cyrillic letters is cut by the
    pre-tokeniser's own rule.  Any other is cut before single spaces, where the
    pre-tokeniser splits too, when no space in it follows another.  Only pieces not
    met before go to the tokeniser; up to twice ``KEPT`` of those met last are
    kept.  A text that holds an added token of the file (<|endoftext|>) goes to
    the tokeniser whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.inside = [x for x in self.added if x == " " or WORD.fullmatch(x)]  # what a word can hold
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

        self.merge, self.bytes = self.tokenizer.model.tokenize, _byte_letters()

    def marked(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def cut(self, text: str) -> list[str]:
        if self.marked(text):
            return [text]
        if not OTHER.search(text):
            return CUT.findall(text)
        return text.replace(" ", "\0 ").split("\0") if "  " not in text and "\0" not in text else [text]

    def ids(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of each text; one word goes to the tokeniser's merges at once, anything else through all its steps."""
        single = [x for x in texts if WORD.fullmatch(x) and not (self.inside and self.marked(x))]
        spelt = "\n".join(single).encode().decode("latin1").translate(self.bytes).split(self.bytes[10])
        out = {x: array("I", [t.id for t in self.merge(y)]).tobytes() for x, y in zip(single, spelt)}
        other = [x for x in texts if x not in out]
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        return out | {x: array("I", e.ids).tobytes() for x, e in zip(other, found, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        flat: list[str] = []
        ends = []
        for x in texts:
            flat += self.cut(x)
            ends.append(len(flat))
        found = list(map(self.known.get, flat))
        lost = [i for i, x in enumerate(found) if x is None]
        new = {flat[i]: b"" for i in lost}
        for x in new:
            new[x] = self.before.get(x)
        unmet = [x for x, ids in new.items() if ids is None]
        for i in range(0, len(unmet), 4096):
            new |= self.ids(unmet[i : i + 4096])
        for i in lost:
            found[i] = new[flat[i]]
        for x, ids in new.items():
            if len(self.known) >= KEPT:
                self.before, self.known = self.known, {}
            if len(x) <= LONGEST:
                self.known[x] = ids
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]


def words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bytes]:
    """Encode ``docs`` with the tokeniser file ``path``; the written segments and the shared table of counts.

    Segments: part, seg (order), n_docs, n_tokens, doc_ids, lengths, payload.
    Null text counts as empty; every document ends with id 0.  Null ids come
    first; rows with one id follow each other in the order of their texts' hash.
    """
    size = vocabulary_size(path)
    kind, width = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"], "<u2" if size <= 1 << 16 else "<u4"
    laid = text_of(docs, doc_id, text).withColumn("tie", F.xxhash64("text"))
    laid = laid.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    names = ["part", "seg", "doc_ids", "lengths", "ids"]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seg = words(path), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        owners: list[pa.Array] = []
        end, total = np.array([END], "<u4").tobytes(), 0

        def flush() -> pa.RecordBatch:
            nonlocal seg, held, owners, total
            sizes = [len(x) // 4 for x in held]
            ids = np.frombuffer(b"".join(held), "<u4").astype(width).tobytes()
            keys = pa.concat_arrays(owners)
            row = [pa.array([part]), pa.array([seg]), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([sizes], pa.list_(pa.int64())), pa.array([ids], pa.binary())]
            seg, held, owners, total = seg + 1, [], [], 0
            return pa.RecordBatch.from_arrays(row, names)

        for batch in slices(batches, "text", 1 << 16):
            for x in known.encode(batch.column("text").to_pylist()):
                held.append(x + end)
                total += len(held[-1]) // 4
            owners.append(batch.column("doc_id"))
            if total >= SEGMENT:
                yield flush()
        if held:
            yield flush()

    segments = cut_lineage(laid.mapInArrow(tokenise, f"part long, seg long, doc_ids array<{kind}>, lengths array<long>, ids binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["symbol", "n"])

    # at most one row per id of the tokeniser
    counts = np.zeros(size, np.int64)
    for r in segments.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]
    table = docs.sparkSession.sparkContext.broadcast(counts.tobytes())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table(np.frombuffer(table.value, np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), width)
                blocks = [rans.encode_block(ids[k : k + rans.BLOCK].astype(np.int64), shared) for k in range(0, len(ids), rans.BLOCK)]
                head = np.array([len(blocks), *map(len, blocks)], "<u4").tobytes()
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("part"), one.column("seg"), pa.array([len(one.column("lengths")[0])]), pa.array([len(ids)]), one.column("doc_ids"), one.column("lengths"), pa.array([head + b"".join(blocks)], pa.binary())],
                    ["part", "seg", "n_docs", "n_tokens", "doc_ids", "lengths", "payload"],
                )

    coded = segments.mapInArrow(code, f"part long, seg long, n_docs long, n_tokens long, doc_ids array<{kind}>, lengths array<long>, payload binary")
    return cut_lineage(coded), counts.tobytes()


def read_tokens(files: DataFrame, counts: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the written segments."""
    kind = dict(files.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    table = files.sparkSession.sparkContext.broadcast(counts)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table(np.frombuffer(table.value, np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column("payload")[i].as_py()
                n = int(np.frombuffer(payload, "<u4", 1)[0])
                at = 4 + 4 * n
                parts = []
                for size in np.frombuffer(payload, "<u4", n, 4).tolist():
                    parts.append(rans.decode_block(payload[at : at + size], shared))
                    at += size
                ids = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                cut = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                same = lambda name: pa.array([batch.column(name)[i].as_py()] * len(cut), pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [same("part"), same("seg"), batch.column("doc_ids")[i].values, pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut, pa.binary())],
                    ["part", "seg", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
                )

    docs = files.select("part", "seg", "doc_ids", "lengths", "payload").mapInArrow(
        decode, f"part long, seg long, doc_id {kind}, within long, n_tokens long, ids_crc32 long, ids binary"
    )
    # one row per task of the writer, then the segments of each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    place = files.select("part", "seg", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own")).join(parts, "part")
    place = place.select("part", "seg", (F.col("own") + F.col("base")).alias("base"))
    return docs.join(place, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as token blocks and read them back: (doc_id, start, n_tokens, ids_crc32, ids)."""
    return read_tokens(*write_tokens(docs, path, doc_id, text))
