"""Near copies against a plain greedy pass over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewell.llm import nearcopies
from tracewell.llm.common import cut_lineage

SCHEMA = "doc_id long, text string, lang string, key int, first int, node int, grp int, place int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def greedy(sets):
    """Which sets stay, and the first that stays and is near each other one."""
    stay, to = [], []
    for i, s in enumerate(sets):
        to.append(next((j for j in stay if near(sets[j], s)), i))
        if to[-1] == i:
            stay.append(i)
    return to


def edited(seed=3, copies=30, length=(60, 300)):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    out = []
    for _ in range(8):
        base = [word() for _ in range(r.randint(*length))]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = word()
            out.append(" ".join(words).capitalize())
    r.shuffle(out)
    return out


EDGES = [(None, None), (None, "no id"), (900, None), (901, ""), (902, " \t\n"), (903, "no id"), (904, "four words and no"), (905, "x " * 40_000), (906, "X\t" * 40_000), (907, "y" * 70_000), (907, "y" * 70_000), (907, "other")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 7, 7, 7, 7) for i, t in rows], SCHEMA)


def test_one_of_each_stays(spark):
    rows = list(enumerate(edited())) + EDGES
    docs = table(spark, rows).repartition(3)
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()), key=str)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in ordered]
    stays = {i for i, j in enumerate(greedy(sets)) if i == j}
    have = [shingles(t) for *_, t in got]
    for i, s in enumerate(sets):  # nothing goes without a near copy that stays
        assert any(near(s, h) for h in have), ordered[i]
    gone, expected = len(rows) - len(have), len(rows) - len(stays)
    assert 0.95 * expected <= gone <= expected
    assert [r for r in got if r[1] >= 900] == [(False, 900, None), (False, 903, "no id"), (False, 904, "four words and no"), (False, 905, "x " * 40_000), (False, 907, "other"), (False, 907, "y" * 70_000)]


@pytest.mark.parametrize(("block", "first", "most"), [(256, 32, 512), (7, 4, 8)])
def test_leaders_are_the_greedy_choice(spark, block, first, most):
    sets = list(dict.fromkeys(shingles(t) for t in edited(5, 12, (20, 60))))
    packed = [(i, bytearray(np.unique(np.array([hash(x) for x in s], np.int64).view(np.uint64)).tobytes())) for i, s in enumerate(sets)]
    grouped = cut_lineage(spark.range(len(sets)).select(F.col("id").alias("node"), F.lit(3).cast("long").alias("grp"), F.col("id").alias("first")))
    stored = cut_lineage(spark.createDataFrame(packed, "node long, shingles binary"))
    got = {r.node: r.leader for r in nearcopies.leaders(grouped, stored, 0.8, block, first, most).collect()}
    assert got == dict(enumerate(greedy(sets)))


def test_similarity_at_the_bound():
    a = np.arange(8, dtype=np.uint64)
    assert nearcopies.alike(a, np.arange(10, dtype=np.uint64), 0.8)
    assert not nearcopies.alike(a, np.arange(11, dtype=np.uint64), 0.8)
    assert not nearcopies.alike(a, np.arange(100, 108, dtype=np.uint64), 0.8)
    assert nearcopies.alike(a[:0], a[:0], 0.8) and not nearcopies.alike(a[:0], a, 0.8)


def test_empty_table(spark):
    assert nearcopies.one_of_each(table(spark, [])).collect() == []
