import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import cases

from kokek.llm import blocks, lm_scores, near_dedup, substrings
from kokek.llm.queries import QUERIES
from kokek.llm.textkit import Words, flat

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(cases.ODD, cases.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def family(rng, words, n, share):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(int(share * words)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


def test_near_duplicates_against_brute_force(spark, rows):
    want, size, _ = cases.components(rows)
    got = by_id(QUERIES["op3_near_dedup"](spark, SF))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == size
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("limit", [near_dedup.REGION_SHINGLES, 3000])
def test_near_duplicates_of_dense_groups(spark, limit):
    """Stars of near copies around an original, also where regions must be split."""
    rng = random.Random(limit)
    texts = [t for n in (2, 3, 30, 60) for t in family(rng, 120, n, 0.02)] + list(family(rng, 400, 5, 0.001))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _, _ = cases.components(list(enumerate(texts)))
    got = by_id(near_dedup.near_duplicates(docs, 4, limit=limit))
    assert {i: r.component_id for i, r in got.items()} == want


def test_split_regions_lose_no_link(spark):
    """Every pair of different components at the threshold meets where regions are split, however
    few links the forest left."""
    rng = random.Random(5)
    texts = [t for n in (40, 25, 2, 2, 2) for t in family(rng, 150, n, 0.022)]
    sets = [(i, s) for i, s in enumerate(near_dedup.shingle_sets(pa.record_batch({"doc_id": list(range(len(texts))), "text": pa.array(texts)})))]
    split = spark.createDataFrame([(i, len(s)) for i, s in sets], "rep long, n_shingles long")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in sets], "rep long, shingles binary")
    none = spark.createDataFrame([], "a long, b long")
    for limit in (10**6, 2000):
        regions = {}
        for r in near_dedup.rarest(split, held, none, 80, limit).collect():
            regions.setdefault(r.region, set()).add(r.rep)
        own = {i: set(s.tolist()) for i, s in sets}
        met = {(a, b) for m in regions.values() for a in m for b in m if a < b}
        linked = {(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}
        assert linked and linked <= met
        assert limit > 10**5 or max(sum(len(own[i]) for i in m) for m in regions.values()) <= 2 * limit


def test_runs_are_cut_where_neighbours_share_least():
    rng = np.random.default_rng(1)
    values = np.array(sorted(map(tuple, np.concatenate([np.full((400, 3), 7), rng.integers(0, 3, (400, near_dedup.SORTED - 3))], axis=1).tolist())))
    shared, weight = near_dedup.common_prefixes(values), rng.integers(1, 9, 400)
    assert all(n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a)) for n, a, b in zip(shared[1:], values, values[1:]))
    for limit in (10**6, 300, 40, 1):
        parts = sorted(near_dedup.cut_run(shared, weight, limit))
        assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == 400
        for a, b, depth in parts:
            assert len({tuple(v[: min(depth, near_dedup.SORTED)]) for v in values[a:b]}) == 1
            assert weight[a:b].sum() <= limit or depth == near_dedup.SORTED + 1
        assert limit < 10**6 or parts == [(0, 400, near_dedup.LEAST)]


def test_near_duplicates_where_the_filter_and_runs_are_small(spark, monkeypatch):
    """The same components with a filter that passes almost all texts, shuffled joins, and short runs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _, _ = cases.components([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(near_dedup, "MOST_BITS", 1 << 13)
    monkeypatch.setattr(near_dedup, "RUN_ROWS", 3)
    monkeypatch.setattr(near_dedup.maybe_broadcast, "__defaults__", (2,))
    assert {i: r.component_id for i, r in by_id(near_dedup.near_duplicates(docs, 4)).items()} == want


def test_contract(spark):
    rng = random.Random(1)
    links = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b] + [(i + 1, i) for i in range(1000, 1060)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.a: r.b for r in near_dedup.contract(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_near_duplicates_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd, 4).collect()
    assert len(got) == len(cases.ODD)
    named = {r.doc_id: r for r in got}
    assert named[5].kept and not named[6].kept and named[6].component_id == 5
    assert named[1].n_shingles == 0 and named[1].kept and named[None].component_id is None and named[None].kept
    assert near_dedup.near_duplicates(none, 4).collect() == []
    cases.same_rows(odd, near_dedup.deduplicated(odd))
    assert near_dedup.deduplicated(none).collect() == []


def test_substrings_against_brute_force(spark, rows):
    want = cases.substring_dedup(rows)
    got = by_id(QUERIES["op7_substring_dedup"](spark, SF))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want


def test_substrings_in_many_small_groups(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = cases.substring_dedup(pairs)
    got = substrings.dedup(docs, group=500, block_bytes=30_000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:
        assert sum(b - a for a, b in r.repeats) == r.n_removed and len(cases.words(r.kept)) == r.n_words - r.n_removed


def test_trees_remove_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = cases.substring_dedup([(r.doc_id, r.text) for r in docs.collect()])
    got = substrings.dedup_by_trees(docs, group=2000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_maximal_repeats_against_all_pairs(spark):
    """Every repeat of 13 to 26 words that no common word extends on either side."""
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij")
    shared = [[word() for _ in range(n)] for n in (14, 17, 22, 13)]
    texts = []
    for _ in range(12):
        w = []
        for _ in range(3):
            w += [word() for _ in range(rng.randint(3, 9))] + rng.choice(shared)[: rng.randint(13, 22)]
        texts.append(w)
    spots = [(d, i) for d, w in enumerate(texts) for i in range(len(w))]
    want = Counter()
    pairs = {}
    for x, (d, i) in enumerate(spots):
        for e, j in spots[x + 1 :]:
            a, b = texts[d], texts[e]
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while n < 26 and i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= 13:
                pairs[tuple(a[i : i + n])] = True
    for gram in pairs:
        want[" ".join(gram)] = sum(tuple(w[i : i + len(gram)]) == gram for w in texts for i in range(len(w)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(99, None), (98, "a b")], "doc_id long, text string")
    got = {r.words: r.n for r in substrings.trees(docs, group=40).where("maximal").collect()}
    assert got == want and len(got) > 5
    assert substrings.trees(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("bins", "held"), [(16, 1 << 20), (1 << 20, 1 << 20), (1 << 20, 100)])
def test_heavy_prefixes_against_counters(spark, rows, monkeypatch, bins, held):
    """Also where a task touches few of very many bins, and where it sends its counters several times."""
    monkeypatch.setattr(substrings, "HELD", held)
    texts = [text or "" for _, text in rows[:200]]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    w = Words(*flat(batch.column(0)))
    h = w.hashes()
    _, keep = substrings.windows(h, w, substrings.WIDTH)
    heavy = substrings.heavy_prefixes(spark.createDataFrame([(t,) for t in texts], "text string"), bins, 2)
    every = np.arange(bins)
    for level in substrings.LEVELS:
        n = np.bincount(substrings._bins(h, w, level, keep, bins), minlength=bins)
        assert (heavy[level](every) == (n > 2)).all() and (n > 2).any()


def test_substrings_odd_rows(odd, none):
    got = substrings.dedup(odd).collect()
    assert len(got) == len(cases.ODD) and {r.n_removed for r in got} == {0}
    assert substrings.dedup(none).collect() == []


def lm(rows, order, least=1, alpha=0.4):
    """(log score, words scored below their highest order) from counts over the other documents."""
    split = [(i, cases.words(t)) for i, t in rows]
    grams = lambda w: Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    count = sum((grams(w) for _, w in split), Counter())
    words, out = sum(len(w) for _, w in split), {}
    for i, w in split:
        own = grams(w)

        def value(gram, n=len(w), own=own):
            if not gram:
                return 1 / words
            seen = count[gram] - own[gram]
            if seen >= (least if len(gram) > 1 else 1):
                return seen / (count[gram[:-1]] - own[gram[:-1]] if len(gram) > 1 else words - n)
            return alpha * value(gram[1:])

        whole = [tuple(w[max(0, k - order + 1) : k + 1]) for k in range(len(w))]
        out[i] = sum(math.log(value(g)) for g in whole), sum(count[g] - own[g] < (least if len(g) > 1 else 1) for g in whole)
    return out


@pytest.mark.parametrize("order,least", [(1, 1), (2, 2), (3, 1), (4, 1)])
def test_scores_against_brute_force(spark, order, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = lm([(r.doc_id, r.text) for r in docs.collect()], order, least)
    got = by_id(lm_scores.score(docs, order, min_count=least, block_bytes=100_000))
    assert all(got[i].n_backoff == n and abs(got[i].log_score - s) < 1e-5 * (1 + got[i].n_words) for i, (s, n) in want.items())


def test_scores_by_relational_operators(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"), allowMissingColumns=True)
    got, want = by_id(lm_scores.score_rows(docs)), by_id(lm_scores.score(docs))
    assert {i: tuple(r)[:3] for i, r in got.items()} == {i: tuple(r)[:3] for i, r in want.items()}
    assert all(abs(r.log_score - want[i].log_score) < 1e-5 for i, r in got.items())


def test_keys_survive_the_exchange():
    rng = np.random.default_rng(2)
    for bits in (56, 64):
        keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) >> np.uint64(64 - bits))
        bucket = blocks.in_range(keys, bits, 37)
        assert (np.diff(bucket) >= 0).all() and bucket.min() == 0 and bucket.max() == 36
        back, n = blocks.unpack(blocks.pack(keys, np.arange(len(keys), dtype=np.uint64)))
        assert (back == keys).all() and (n == np.arange(len(keys))).all()


def test_scores_odd_rows(odd, none):
    got = lm_scores.score(odd).collect()
    assert len(got) == len(cases.ODD)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_scores.score(none).collect() == []
