"""Operators 11 to 13 against plain restatements of their contracts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from kokek.llm import divergence, simhash, vector_codes
from tests.llm.cases import ODD, SCHEMA, words


def plain_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """{row: smallest reachable row} by comparing every two fingerprints."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(fps)
    for k, i in enumerate(every):
        for j in every[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_fingerprint_equals_spark_hash(spark):
    rng = random.Random(3)
    texts = ["", "   ", "One", "one two", "ONE Two three", *(" ".join(rng.choice("aÉb cç\tdd\n eee 日本".split(" ")) for _ in range(n)) for n in (3, 7, 50, 400))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    one = spark.createDataFrame([("one two three",)], "t string").selectExpr("xxhash64(t) AS h").first().h
    assert simhash.fingerprint(b"One\t two THREE") == one % (1 << 64)
    assert simhash.fingerprint(None) == 0


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(5).choices(["alpha", "beta", "gamma" * 9, "x"], k=600))
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_gray_rank_is_a_walk_of_single_bits():
    codes = np.arange(2048, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert (simhash.gray_rank(codes) == np.arange(2048)).all()


@pytest.mark.parametrize("n", [1, 15, 16, 17, 700])
def test_tree_finds_all_neighbours(n):
    rng = np.random.default_rng(n)
    own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    own[n // 2 :] = own[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n - n // 2, dtype=np.uint64))
    own = own[np.argsort(simhash.gray_rank(own))]
    asked = own ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    tree = simhash.Tree(np.full(n, simhash._FULL), own)
    found = {(int(a), int(b)) for q, leaf in tree.near(asked, 2) for a, b in zip(q, leaf)}
    assert found == {(a, b) for a in range(n) for b in range(n) if int(asked[a] ^ own[b]).bit_count() <= 2}


@pytest.mark.parametrize("block,asked", [(4096, 4_000_000), (8, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, asked):
    rng = random.Random(7)
    rows, vocabulary = [], [f"w{k}" for k in range(300)]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 3, 40, 400]))]
        for _ in range(rng.choice([1, 1, 4])):
            text = list(base)
            if text and rng.random() < 0.7:
                text[rng.randrange(len(text))] = "changed"
            rows.append((len(rows), " ".join(text)))
    if block == 8:
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(simhash, "ROW", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, block=block, asked=asked).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert 0 < sum(want[i] != i for i in want) < len(rows) - 1


def test_links_between_many_blocks(spark):
    """A dense ball and random fingerprints, in blocks of 16, against all pairs."""
    rng = np.random.default_rng(1)
    ball = np.uint64(0xDEADBEEF12345678) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
    own = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long")
    blocks = simhash._blocks(nodes, 16).cache()
    links = simhash._links(blocks, simhash._questions(blocks, 2), 2, 40).collect()
    fps = {int(x): int(x) for x in own}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
        root[max(a, b)] = min(a, b)
    assert {x: find(x) for x in fps} == plain_components(fps)


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[3].component_id == by[2].component_id == 1
    assert by[6].component_id == 5
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def plain_audit(rows, least=30, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = Counter()
        for (la, s), c in counts.items():
            if la == lang:
                every.update(c)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        mine, q = p(counts[lang, source]), p(every)
        pairs = []
        for la, s in groups:
            if la == lang and s != source:
                other = p(counts[la, s])
                pairs.append((s, sum(abs(mine[t] - other[t]) for t in kept)))
        terms = [(t, mine[t] - q[t]) for t in kept if counts[lang, source][t] and mine[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 18, 1])
def test_audit_equals_brute_force(spark, monkeypatch, cells):
    rng = random.Random(2)
    vocabulary = ["the", "The", "ünï", "日本語", "a_b", "x1y", "É", "é", "z" * 300, "\U0001f600k", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))]
    rows = [(" ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", "z", None])) for _ in range(400)]
    rows += [(None, "xx", "a"), ("", "xx", None), ("rare words only", "yy", "a")]
    monkeypatch.setattr(divergence, "COUNTED", 50)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, cells=cells).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows)


def test_audit_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = sorted(tuple(r) for r in divergence.audit(docs, least=1).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit([(r[1], r[2], r[3]) for r in ODD], least=1)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_are_exact():
    rng = random.Random(9)
    for _ in range(200):
        total, terms = rng.randrange(1 << rng.randrange(1, 62)), rng.randrange(1, 1 << 20)
        counts = [rng.randrange(total + 1) for _ in range(5)] + [0, total]
        assert divergence.shares(np.array(counts, np.int64), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    first = {}
    for i, _, v in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def codes():
        return [[min(range(len(book[p])), key=lambda j: (far(cut(v, p), book[p][j]), j)) for p in range(parts)] for _, _, v in kept]

    for _ in range(rounds):
        own = codes()
        for p in range(parts):
            for j in range(len(book[p])):
                got = [cut(v, p) for c, (_, _, v) in zip(own, kept) if c[p] == j]
                if got:
                    book[p][j] = [sum(x) // len(got) for x in zip(*got)]
    own = codes()
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    error = [sum(far(cut(v, p), book[p][c[p]]) for p in range(parts)) for c, (_, _, v) in zip(own, kept)]
    by = defaultdict(int)
    for e, (_, label, _) in zip(error, kept):
        by[label] += e
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, by[label], sha) for c, e, (i, label, _) in zip(own, error, kept)), key=str)


def vectors(seed, n, spread, dims=32):
    rng = np.random.default_rng(seed)
    rows = [(int(i), np.float32(v).tolist(), int(rng.integers(0, 4)) if rng.random() < 0.9 else None) for i, v in zip(rng.permutation(n * 3)[:n], np.round(rng.normal(0, spread, (n, dims)), 3))]
    return rows + [rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3][1], None), (-5, None, 1), (-4, [None] + rows[0][1][1:], 1), (-3, [float("nan")] * dims, 1), (-2, [float("inf")] * dims, 2)]


@pytest.mark.parametrize("n,spread", [(300, 0.2), (300, 0.004), (40, 1.0), (150, 20_000.0)])
def test_codes_equal_brute_force(spark, n, spread):
    rows = vectors(n, n, spread)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == plain_codes(rows)


def test_nearest_resolves_what_float32_cannot():
    """Distances that float32 rounds to one value, and exact ties."""
    rng = np.random.default_rng(4)
    entries = rng.integers(-(1 << 25), 1 << 25, (1, 4)) + rng.integers(-3, 4, (64, 4))
    x = entries[rng.integers(0, 64, 500)] + rng.integers(-2, 3, (500, 4))
    want = ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (vector_codes.nearest(x, entries) == want).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, vec string"
    table = spark.createDataFrame([(1, [0.5] * 16, None, "x", "y"), (1, [0.5] * 16, None, "x", "y"), (2, None, 1, "x", "y")], schema)
    assert [(r.code, r.error, r.label_error) for r in vector_codes.compress(table).collect()] == [("00" * 16, 0, 0)] * 2
    assert vector_codes.compress(table.limit(0)).collect() == []
    assert vector_codes.compress(table.where("embedding IS NULL")).collect() == []
    nameless = table.selectExpr("CAST(NULL AS long) AS vec_id", "embedding", "label")
    assert len(vector_codes.compress(nameless).collect()) == 2
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 17, 1)], "vec_id long, embedding array<float>, label int"))
