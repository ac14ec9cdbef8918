"""Every text operator against brute force, and over null, empty, very long, repeated and missing rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tracewell.llm import exact, extraction, maxent, mixing, pii, rans, simhash, suffixes, tokens, toxicity, winnowing
from tracewell.llm.components import components

import corpus_pipeline

PATH = public_tokenizers.path("byte_bpe_50k.json")
# extra columns with names that operators use inside
EXTRA = ["fp", "key", "row_key", "times", "size", "score", "block", "part", "i", "tie", "word", "held_out", "_body", "body"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in EXTRA]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *[7] * len(EXTRA)) for r in rows], SCHEMA)


def made(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéf") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(r.randint(3, 120))) for _ in range(8)]
    rows = []
    for i in range(n):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words).capitalize(), r.choice(["en", "fr"]), r.choice(["a", "b", "c", None]), 1))
    return rows


EDGES = [
    (None, None, None, None, None),
    (None, "text without an id", "en", "a", 1),
    (100, None, "en", None, 0),
    (101, "", "en", "a", 0),
    (102, " \t\n ", None, "b", 3),
    (103, "one", "en", "b", 3),
    (104, "very long " * 30_000, "en", "b", 3),
    (105, "y" * 70_000, "en", "b", 3),
    (106, "same row", "en", "c", 8),
    (106, "same row", "en", "c", 8),
    (106, "same id, other text", "en", "c", 8),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, made() + EDGES).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return made() + EDGES


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 230)] + [(300, i) for i in range(301, 340)]
    want = roots(400, pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("leaf", [20_000, 4])
def test_simhash(docs, rows, leaf):
    fp = [plain_fingerprint(r[1]) for r in rows]
    part = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    least = {}
    for r, c in zip(rows, part, strict=True):
        least[c] = min([x for x in (least.get(c), r[0]) if x is not None], default=None)
    want = Counter((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fp, part, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs, leaf=leaf).collect())) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(part))


def test_simhash_refines_dense_nodes():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    v = base[r.integers(0, 6, 400)]
    for _ in range(5):
        v = v ^ np.where(r.random(400) < 0.6, np.uint64(1) << r.integers(0, 60, 400).astype(np.uint64), np.uint64(0))
    v = np.unique(v)
    want = roots(len(v), np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4).tolist())
    links, half = [], v >> np.uint64(56)
    for turn in range(8):  # the eight rotations together lose no link
        x = np.sort(simhash._turn(v, 8 * turn))
        for top in np.unique(x >> np.uint64(56)):
            member, first = simhash.descend(x[x >> np.uint64(56) == top], None, 8, 4)
            links += list(zip(simhash._turn(member, 64 - 8 * turn).tolist(), simhash._turn(first, 64 - 8 * turn).tolist(), strict=True))
    at = {int(x): i for i, x in enumerate(v)}
    assert len(half) and roots(len(v), [(at[a], at[b]) for a, b in links]) == want


def test_empty_tables(none):
    assert simhash.near_duplicates(none).collect() == [] and mixing.mix(none).collect() == []
    for rest in (simhash.one_of_each(none), mixing.mixed(none)):
        assert rest.columns == none.columns and rest.collect() == []


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if target[s] > 3 * total[s] + 1e-9}
        if not over:
            break
        capped |= over
    assert Counter((x.doc_id, x.size, x.source_size) for x in got) == Counter((r[0], n, total[r[3]]) for r, n in zip(rows, size, strict=True))
    for s in names:
        own = [x for x in got if x.source == s]
        assert all(abs(x.target - target[s]) < 1e-6 and 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size for x in own)
        ratio = target[s] / total[s] if total[s] else 0
        assert all(not x.size or math.floor(ratio) <= x.copies <= math.ceil(ratio) for x in own)
        assert abs(sum(x.taken for x in own) - target[s]) <= max((x.size for x in own), default=0)
    spread = mixing.mixed(docs)
    assert spread.columns == docs.columns and spread.count() == sum(x.copies for x in got)


def test_mixing_tree(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 40), "en", "s" if i % 3 else "t", 1) for i in range(3000)]
    got = mixing.mix(table(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(x.taken - x.target) <= 40 for x in got)


def test_extraction(spark):
    page = (
        '<html><head><title>No</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div>'
        "<article><h1>A&amp;B <i>tit</i>le</h1><p><b>First  paragraph,\nwith some words in it.<br><p>Second paragraph &copy; has words as well.</article>"
        '<div class="comments"><p>I disagree with every word of this.</p></div><footer>&copy; nobody</footer></body></html>'
    )
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (4, "u", page), (5, "u", "<p>" + "long text here. " * 20_000), (6, "u", "<<<>>> <!-- x"), (7, "u", "</p></div><article><p>cut")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    model = extraction.train(["Some sentences stand here. They are of the usual length, with commas.", "Others follow. They end at once.", "A third one has nothing to say, but it says so slowly and at length."])
    got = {x.page_id: x for x in extraction.extract(pages, model).collect()}
    assert got[1].text == "A&B title First paragraph, with some words in it. Second paragraph © has words as well." == got[4].text
    assert got[2].text == "" and got[None].n_chars == 0 and all(x.n_chars == len(x.text) for x in got.values())
    empty = pages.limit(0)
    assert extraction.extract(empty, extraction.fit(empty)).collect() == []


@pytest.mark.parametrize(("page", "want"), [
    ("<html><head><title>x</title><p>text one<p>text two", "text one text two"),
    ("<html><head><title>x</title><meta charset=a><style>s</style><script>c</script></head><body><p>text</body>", "text"),
    ("<head><title>x</title><body><p>text", "text"),
    ("<p>one<p><svg><path d=x>two<p>three", "one two three"),
    ("<p>one <svg><text>no</text></svg>two", "one two"),
    ("<p>one<p><math>two<p><object>three<p><noscript>four<p>five", "one two three four five"),
    ("<article><p>one <math>x+y</math> <object data=a>two</object> <noscript>three</noscript> four</article>", "one x+y two three four"),
    ("<p>one<p><iframe src=a>two<p><template>three<p><textarea>four<iframe>", "one two three four"),
    ("<p>one<script>no <p>no", "one"),
])
def test_skipped_elements(page, want):
    assert " ".join(t for _, t, _ in extraction.Page(page).runs) == want


def test_extraction_is_consistent():
    r = np.random.default_rng(2)
    texts = ["One sentence is here, with words. And one more.", "Short text.", "A longer text goes on for a while, it has several parts. They end."]
    model = extraction.train(texts)
    right = whole = 0
    for _ in range(100):
        page = extraction.Page(extraction.layout(r, texts))
        kept, truth = page.kept(model.decide(page.features())), page.truth()
        assert all(kept[page.parent[v]] for v in range(1, len(kept)) if kept[v])
        right += sum(len(t) for v, t, _ in page.runs if kept[v] == truth[v])
        whole += sum(len(t) for _, t, _ in page.runs)
    assert right / whole > 0.9


def test_toxicity(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [word() for _ in range(r.randint(5, 60))] + ["awfulword"] * bad
        r.shuffle(words)
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", 1))
        labels.append((i, 1, int(bad)))
    docs = table(spark, rows + EDGES)
    marks = spark.createDataFrame(labels + [(None, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600 and x.doc_id not in range(100, 107)]
    assert np.mean([x.predicted == (x.doc_id % 5 == 0) for x in held]) > 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted == 0 for x in got)
    nothing = toxicity.fit(docs.limit(0), marks.limit(0))
    assert {x.predicted for x in toxicity.score(docs, nothing).collect()} == {0} and toxicity.score(docs.limit(0), model).collect() == []


def test_table_of_a_model_is_built_in_place():
    model = toxicity.Model()
    model.embed[:] = np.random.default_rng(0).normal(size=model.embed.shape)
    tracemalloc.start()
    table = model.table()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * table.nbytes
    assert (table == np.concatenate([model.embed @ f[j] for f in model.filters for j in range(len(f))], 1)).all()


def test_long_texts_score_alike_in_blocks():
    model = toxicity.Model()
    model.embed[:] = np.random.default_rng(1).normal(0, 1, model.embed.shape)
    x = toxicity.words("alpha beta gamma delta " * 50)
    assert np.allclose(model.highest(x, model.table(), block=7), model.pooled(x)[0], atol=1e-4)
    for text in ("", "one", "one two"):
        assert np.allclose(model.highest(toxicity.words(text), model.table()), model.pooled(toxicity.words(text))[0], atol=1e-4)


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    want = [(r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    got = tokens.token_files(docs, PATH).orderBy("start").collect()
    keys = [(-1 if x.doc_id is None else x.doc_id) for x in got]
    assert keys == sorted(keys)
    start = 0
    for x in got:
        assert x.start == start and len(x.ids) == 4 * x.n_tokens and x.ids_crc32 == zlib.crc32(x.ids)
        start += x.n_tokens
    assert Counter((x.doc_id, tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in got) == Counter((k, tuple(v)) for k, v in want)
    assert tokens.token_files(docs.limit(0), PATH).collect() == []


def test_words_equal_the_tokenizer():
    known, r = tokens.Words(PATH), random.Random(2)
    parts = ["a", "B", "é", " ", "\n", ".", ",", "'s", "%%", "1", "23", "\t", "!", "語", "\0", "²", " \n", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert known.encode(texts) == want


def test_cuts_equal_the_pretokenizer():
    known, r = tokens.Words(PATH), random.Random(4)
    parts = ["a", "B", "é", "ж", "ώ", "ԯ", "ʰ", "ª", " ", "  ", "\n", "\t", "\r", "\v", "\f", ".", "!", "~", "_", "'", "'s", "'S", "'ll", "'tis", "1", "23"]
    for x in ("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)):
        assert tokens.CUT.findall(x) == [x[a:b] for _, (a, b) in known.tokenizer.pre_tokenizer.pre_tokenize_str(x)] and not tokens.OTHER.search(x)


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    known, r = tokens.Words(PATH), random.Random(5)
    texts = ["".join(r.choice([" of", " the", " no\u0301", " x" + str(r.random()), ".", "\n", " " + "ab" * 40]) for _ in range(20)) for _ in range(300)]
    want = [np.array(x.ids, "<u4").tobytes() for x in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [known.encode([x])[0] for x in texts] == want and known.encode(texts) == want
    assert 0 < len(known.known) + len(known.before) <= 100
    assert known.before and max(map(len, [*known.known, *known.before])) <= tokens.LONGEST


def test_added_tokens_equal_the_plain_tokenizer():
    from tokenizers import Tokenizer

    mark, r = "<|endoftext|>", random.Random(3)
    parts = ["a", "word", " ", "\n", ".", "|", "<|", "|>", "endoftext", "  ", "\0", mark, mark]
    texts = [f"a {mark} b", mark, f"a{mark}b.", f"one two {mark}", "long " * 50 + mark + " tail" * 50] + ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Words(PATH).encode(texts)] == want


def test_rans():
    ids = np.minimum(np.random.default_rng(0).zipf(1.2, 400_000), 50_000).astype(np.int64)
    shared = rans.Table(np.bincount(ids, minlength=50_257))
    assert int(shared.freq.sum()) == 1 << shared.bits
    for n in (0, 1, 5, 1023, 1024, 1025, 200_000, 400_000):
        block = rans.encode_block(ids[:n], shared)
        assert (rans.decode_block(block, shared) == ids[:n]).all()
    points = int(np.frombuffer(block, "<u4", 6)[3])
    assert points > 2
    at, part = rans.decode_from(block, shared, 2)
    assert at > 0 and (part == ids[at : at + len(part)]).all()
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), shared)


def plain_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_pii_spans():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("0123459@.+- ()ab%é\n") for _ in range(r.randint(0, 40)))
        want = plain_spans(text)
        assert {k: v for k, v in pii.spans(text).items() if k in want} == want, text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    found = pii.spans('token = "cb1a9fee807a05366fcb8b6c" IBAN DE89 3704 0044 0532 0130 00, https://me:pw@host.example/x')
    assert found["secret"] and found["account"] and found["url"]


def test_pii(spark, docs, rows):
    text = "Mail ann.b@mail.example.com or +1 (017) 555-7713, from 10.0.0.255 with 4111 1111 1111 1111."
    got = pii.personal_data(docs.unionByName(table(spark, [(200, text, "en", "a", 1)]))).collect()
    assert len(got) == len(rows) + 1
    x = next(x for x in got if x.doc_id == 200)
    listed = ",".join(f"{k}:{a}:{b}" for k, v in plain_spans(text).items() for a, b in v)
    assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == (1, 1, 1, 1) and x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and x.spans == listed
    assert all(x.spans == "" for x in got if x.doc_id in (None, 100, 101, 102))
    assert pii.personal_data(docs.limit(0)).collect() == []


def plain_hits(text, items, window=10):
    w = re.findall(winnowing.WORD, low(text))
    hit, names = set(), set()
    for name, item in items:
        b = re.findall(winnowing.WORD, low(item))
        n = min(window, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def test_decontamination(spark, docs, rows):
    texts = [r[1] for r in rows[:4]]
    items = [(1, texts[0][10:140]), (2, "Very LONG"), (3, None), (4, ""), (5, "one"), (10, " ".join(texts[1].split()[2:14])), (None, texts[2]), (2, "zzz"), (7, "very long " * 40)]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, words int")
    got = Counter((x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids), x.contaminated) for x in winnowing.contamination(docs, bench).collect())
    want = Counter((r[0], n, h, tuple(t), h > 0) for r in rows for n, h, t in [plain_hits(r[1], items)])
    assert got == want and any(x[4] for x in want)
    clean = winnowing.without_benchmark(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for x, n in want.items() if not x[4])
    assert winnowing.without_benchmark(docs, bench.limit(0)).count() == len(rows)
    assert winnowing.contamination(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize(("length", "limit"), [(64, 20_000), (64, 3), (400, 20_000)])
def test_repeats(spark, docs, rows, length, limit):
    r = random.Random(3)
    more = ["".join(r.choice("abc é") for _ in range(r.randint(0, 900))) for _ in range(6)]
    cut = [more[r.randrange(6)][r.randint(0, 300) :] + more[r.randrange(6)][: r.randint(0, 700)] for _ in range(20)]
    extra = [(300 + i, x, "en", "a", 1) for i, x in enumerate([*more, *cut, "a" * 700, "ab" * 300, "xyz " * 200])]
    rows = [x for x in rows if x[0] not in (104, 105)] + extra
    got = suffixes.digest(suffixes.remove_repeats(table(spark, rows).repartition(3), length=length, limit=limit)).collect()
    want = suffixes.brute_force([(x[1] or "").encode() for x in rows], length)
    assert Counter(map(tuple, got)) == Counter((x[0], len((x[1] or "").encode()), *w) for x, w in zip(rows, want, strict=True))


def test_repeats_in_long_texts(docs):
    got = {x.doc_id: x for x in suffixes.remove_repeats(docs).collect() if x.doc_id in (104, 105, None, 100)}
    assert got[104].n_removed == got[104].n_bytes == 300_000 and got[105].n_removed == 70_000 and got[100].n_bytes == 0
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("owner_rows", [1 << 21, 8])
def test_exact(docs, rows, owner_rows):
    flat = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, f in zip(rows, flat, strict=True):
        groups.setdefault(f, []).append(r[0])
    want = Counter()
    for r, f in zip(rows, flat, strict=True):
        own = groups[f]
        keep = min((x for x in own if x is not None), default=None)
        want[r[0], keep, len(own), hashlib.sha256(f.encode()).hexdigest()] += 1
    got = exact.exact_duplicates(docs, owner_rows=owner_rows).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    assert all(x.kept == (x.doc_id == x.keep_id) for x in got) and len({x.text_sha256 for x in got if x.kept}) == len(groups)
    assert exact.exact_duplicates(docs.limit(0)).collect() == []


def test_golomb():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 1000, 50_000):
        v = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (exact.ungolomb(exact.golomb(v)) == v).all()
    assert (exact.ungolomb(exact.golomb(np.array([0, 2**64 - 1], np.uint64))) == np.array([0, 2**64 - 1], np.uint64)).all()


@pytest.mark.parametrize("top", [maxent.TOP, 5])
def test_language_model(docs, rows, top):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    said = [[*re.findall(r"[^\x20\x09-\x0D]+", low(r[1])), "\n"] for r in rows]
    c = Counter(w for s, h in zip(said, held, strict=True) if not h for w in s)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), h, len(s), sum(c[w] > 0 for w in s), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), 4)) for r, s, h in zip(rows, said, held, strict=True))
    got = maxent.language_model(docs, top=top).collect()
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in got) == want
    assert sum(x.score for x in got) > sum(x.base_score for x in got)
    assert maxent.language_model(docs.limit(0)).collect() == []


def test_model_sums_to_one(spark, docs):
    """Over all known words and one unknown word of each shared class, probabilities add up to 1."""
    learned = docs.where("doc_id < 100").select("text")
    counts = maxent.count_words(learned)
    model = maxent.train(learned, maxent.prepare(counts))
    packed, known = maxent.Packed(model), {bytes(r.word): r.c for r in counts.collect()}
    history = sorted(known)[:3]
    rows_, _, _ = maxent.features([[*history, maxent.END]], packed)
    classes = np.exp(maxent.log_classes(rows_, model.bias, model.weights))[-1]
    inside = np.zeros(maxent.CLASSES)
    for w, c in known.items():
        inside[model.class_of(w)] += (c + maxent.SMOOTH) / 10 ** model.in_class[model.class_of(w)]
    inside[len(model.singles) :] += maxent.SMOOTH / 10 ** model.in_class[len(model.singles) :]
    assert abs(classes.sum() - 1) < 1e-4 and abs((classes * inside)[inside > 0].sum() + classes[inside == 0].sum() - 1) < 1e-3


def test_pipeline_stages(spark, tmp_path, docs):
    documents = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(documents).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this kind occurs in the documents at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == documents, name
        assert now.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name == "mix"
    done = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert done.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and done.count() == now.count()


def test_sums_by_row():
    """Rows met once, a few times, often and in every token of a batch."""
    assert maxent.ROWS <= 1 << 16
    r = np.random.default_rng(0)
    for own in (r.zipf(1.3, 2048) % maxent.ROWS, r.integers(0, maxent.ROWS, 2048), r.integers(0, 200, 2048), np.full(2048, maxent.ROWS - 1), np.array([5])):
        g = r.normal(size=(len(own), maxent.CLASSES)).astype(np.float32)
        want, wanted = np.zeros((maxent.ROWS, maxent.CLASSES)), np.bincount(own, minlength=maxent.ROWS)
        np.add.at(want, own, g.astype(np.float64))
        ids, n, total = maxent.sums_by_row(own, g)
        assert (ids == np.unique(own)).all() and (n == wanted[ids]).all() and np.abs(total - want[ids]).max() < 1e-3


def test_model_size():
    """64 classes, 24 of one word; the word three back is a feature even where the classes are the same."""
    assert (maxent.CLASSES, maxent.SINGLES) == (64, 24)
    packed = maxent.Packed(maxent.Model({}, np.zeros(0), {}, np.zeros(maxent.CLASSES), np.zeros(0)))
    a, b = (maxent.features([[first, b"two", b"one", b"now"]], packed)[0][:, 3] for first in (b"aending", b"bending"))
    assert len(a) == 5 and (a != b).sum() == 1
