"""Links of vectors, hard negatives and source divergence against brute force, with null, empty, tied and repeated rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewell.llm import divergence, lattice, negatives

NAN, INF = float("nan"), float("inf")
# extra columns with names that the operators use inside
VECTORS = "vec_id long, embedding array<double>, label int, node int, h int, n int, limits int, side int, row int, _salt int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[7] * 7) for r in rows], VECTORS)


def near(r, base, cosine):
    w = r.standard_normal(base.shape)
    w -= (w @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


EDGES = [
    (None, [1.0, 0.0, 0.0], 1), (5000, None, 1), (5001, [], 1), (5002, [0.0, 0.0, 0.0], 1), (5003, [1.0, None, 0.0], 1), (5004, [1.0, NAN, 0.0], 1),
    (5005, [INF, 1.0, 0.0], 1), (5006, [1.0, 0.0, 0.0], None), (5007, [2.0, 0.0, 0.0], 1), (5007, [2.0, 0.0, 0.0], 1), (5008, [1.0, 0.0, 0.0], 2), (5009, [1.0, 0.0], 1),
    (5010, [1e300, 1e299, 0.0], 1), (5011, [3e-300, 3e-301, 0.0], 1), (5012, [-0.0, 5.0, 0.0], 3), (5013, [0.0, 5.0, 0.0], 3),
]


def embedded(n=300, dim=64, seed=1):
    r = np.random.default_rng(seed)
    out, i = [], 0
    while i < n:
        base = r.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(int(r.integers(1, 9))):
            v = base if r.random() < 0.3 else near(r, base, r.choice([0.98001, 0.985, 0.97999, 0.995]))
            out.append((i, (v * r.choice([1.0, 3.0])).tolist(), int(r.integers(0, 2))))
            i += 1
    # one very common vector, and a chain whose ends aren't near
    out += [(1000 + k, [1.0] * dim, 0) for k in range(60)]
    v = np.eye(dim)[0]
    for k in range(8):
        out.append((1100 + k, v.tolist(), 1))
        v = near(np.random.default_rng(k), v, 0.985)
    return out


def plain_links(rows, least=0.98):
    good = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
    unit = [lattice.unit(np.array([v], float))[0] if good(v) and lab is not None else None for _, v, lab in rows]
    n, links = len(rows), defaultdict(set)
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least:
                links[a].add(b)
                links[b].add(a)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[x], *(root[y] for y in links[x])]) for x in range(n)]
        if new == root:
            break
        root = new
    least_id = defaultdict(list)
    for x in range(n):
        least_id[root[x]].append(rows[x][0])
    low = {k: min([i for i in v if i is not None], default=None) for k, v in least_id.items()}
    return Counter((rows[x][0], len(links[x]), low[root[x]], rows[x][0] == low[root[x]]) for x in range(n))


@pytest.mark.parametrize("block", [2048, 3])
def test_links(spark, block):
    rows = embedded(200 if block == 3 else 300) + EDGES
    got = lattice.vector_links(vectors(spark, rows).repartition(3), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == plain_links(rows)


def test_links_of_nothing(spark):
    assert lattice.vector_links(vectors(spark, [])).collect() == []
    lone = lattice.vector_links(vectors(spark, EDGES[:2])).collect()
    assert sorted(map(tuple, lone), key=str) == [(5000, 0, 5000, True), (None, 0, None, True)]


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.98 meet in some table, far ones hardly ever."""
    r = np.random.default_rng(3)
    a = [x / np.linalg.norm(x) for x in r.standard_normal((4000, 64))]
    b = [near(r, x, 0.98) for x in a]
    code = [lattice.cells(np.array(x), lattice.TABLES, lattice.PROBES, lattice.BLOCKS, lattice.SCALE).reshape(4000, lattice.TABLES, -1) for x in (a, b)]

    def met(x, y):
        return ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2)).mean()

    assert met(*code) > 0.995 and met(code[0][:-1], code[1][1:]) < 0.001


def test_decoded_points():
    """No lattice point is closer than the decoded one, and all points belong to the lattice."""
    x = np.random.default_rng(0).normal(0, 2, (2000, 8))
    p = lattice.decode(x)
    own = ((x - p) ** 2).sum(1)
    assert ((x[:, None] - p[:, None] - lattice.NEAR) ** 2).sum(2).min(1).min() >= 0 and (own[:, None] <= ((x[:, None] - p[:, None] - lattice.NEAR) ** 2).sum(2) + 1e-9).all()
    assert own.max() <= 1 + 1e-9 and len(lattice.NEAR) == 240  # the covering radius of E8 is 1
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all() and ((p % 1 == 0).all(1) | (p % 1 == 0.5).all(1)).all()


def plain_negatives(rows, anchor, positives=5, wanted=5):
    part = [(i, [int(np.floor(256.0 * x)) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = Counter()
    for k, (i, q, lab) in enumerate(part):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j, m, other) for m, (j, w, other) in enumerate(part) if len(w) == len(q))
        own = [(-s, j) for s, j, m, other in scored if other == lab and m != k][:positives]
        far = [(-s, j) for s, j, _, other in scored if other != lab]
        for p, j in own:
            window = [(s, x) for s, x in far if 80 * p <= 100 * s <= 100 * p]
            out.update((i, j, place + 1, x, p, s) for place, (s, x) in enumerate(window[:wanted]))
    return out


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_negatives(spark, monkeypatch, spread):
    # the smaller spread gives few different scores and so many ties
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    r = np.random.default_rng(7)
    rows = [(int(i), np.abs(r.normal(0, spread, 4)).tolist() if i % 3 else r.normal(0, spread, 4).tolist(), int(r.integers(0, 4)) if i % 2 else 0) for i in range(400)]
    rows += [(10, rows[0][1], 0), (2000, [0.5] * 4, 1), (2001, [0.5] * 4, 1)] + [(3000 + k, [0.5] * 4, 2) for k in range(20)] + [x for x in EDGES if x[0] not in (5010, 5011)]
    got = negatives.hard_negatives(vectors(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert Counter(map(tuple, got.collect())) == want and sum(want.values()) > 200


def test_negatives_of_large_numbers(spark):
    rows = [(0, [1e6] * 3, 1), (1, [1e6, 1e6, 1e6 + 1], 1), (2, [1e6, 1e6, 1e6 - 1], 2), (3, [2.0**40, -(2.0**40), 3e6], 2), (4, [1e300, 0.0, 0.0], 2)]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") == 0)
    want = {x for x in plain_negatives(rows, lambda i: i == 0) if x[3] != 4}
    assert set(map(tuple, got.collect())) == want and want


def test_negatives_of_nothing(spark):
    none = vectors(spark, [])
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(vectors(spark, EDGES), F.lit(False)).collect() == []


DOCUMENTS = "text string, lang string, source string, doc_id long, term int, n int, p int, q int, z int, part int, parts int, docs int, total int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *[7] * 10) for r in rows], DOCUMENTS)


def plain_divergence(rows, least=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    said = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(s, r[2]) for s, r in zip(said, rows, strict=True) if r[1] == lang]
        df = Counter(w for s, _ in mine for w in set(s))
        kept = sorted(w for w in df if df[w] >= least)
        counts = {src: Counter(w for s, x in mine if x == src for w in s if df[w] >= least) for src in {x for _, x in mine}}
        whole = sum(counts.values(), Counter())
        price = lambda c, w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for src, c in counts.items():
            pairs = [(o, sum(far(price(c, w), price(d, w)) for w in kept)) for o, d in counts.items() if o != src]
            terms = [(w, far(price(c, w), price(whole, w))) for w in kept if c[w] and price(c, w) > price(whole, w)]
            for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, src, part, item, v, k + 1) for k, (item, v) in enumerate(found[:top])]
    return Counter(out)


@pytest.mark.parametrize("sources", [256, 2])
def test_divergence(spark, monkeypatch, sources):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    r = np.random.default_rng(5)
    stock = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}é"[: 3 + i % 2] for i in range(120)]
    rows = []
    for _ in range(300):
        src = int(min(r.zipf(1.5), 7))
        words = [stock[int(x) % 120] for x in r.zipf(1.2 + src / 10, int(r.integers(0, 60)))]
        rows.append((r.choice([" ", "-", "\n", "1"]).join(words), "en" if r.random() < 0.7 else "fr", f"s{src}" if src < 6 else None))
    rows += [(None, "en", "s1"), (None, None, None), ("", "de", "a"), ("one two", "de", "b"), ("...", "xx", "lonely"), ("x" * 100_000 + " " + "Wa " * 50_000, "en", "s2"), ("WA wa Wa", "fr", "é")]
    rows += [("same text here", "it", "a")] * 12 + [("same text there", "it", "b")] * 12
    got = divergence.source_divergence(documents(spark, rows).repartition(4))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(documents(spark, [])).collect() == []


def test_products():
    r = np.random.default_rng(2)
    term = np.sort(r.integers(0, 700, 5000))
    column = np.array([int(c) for c in r.integers(0, 900, 5000)])
    term, column = np.unique(np.stack([term, column]), axis=1)
    want = Counter((int(a), int(b)) for t in np.unique(term) for a in column[term == t] for b in column[term == t] if a < b)
    a, b, n = divergence.products(term, column)
    assert Counter(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))) == want
    assert len(divergence.products(term[:0], column[:0])[0]) == 0


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 16)
    text = ("Ab c-dé " * 30 + "x" * 50 + " end").encode()
    assert [w for part in divergence.words(text) for w in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+".encode(), text.lower())
