"""Cases that earlier forms of the operators got wrong, and branches that small tables do not reach."""

import random

import numpy as np
import pytest

import corpus_pipeline
from kokek.llm import media, mixing, near_dedup, quality
from tests.llm.cases import base_rules


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_keeps_rows_of_languages_without_text(spark):
    text = " ".join(f"word{k % 37} is number {k}" for k in range(40))
    rows = [(1, "en", text), (2, "xx", None), (3, None, ""), (4, "en", text[:200]), (5, "", text[::-1]), (6, "\0", text[5:]), (7, None, None)]
    for some in (rows, rows[1:3], [rows[1]], []):
        docs = spark.createDataFrame(some, "doc_id long, lang string, text string")
        got = by_id(quality.quality(docs))
        assert sorted(got) == [r[0] for r in some]
        for i, _, t in some:
            n, chars, symbols, lines, repeated, failed = base_rules(t)
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeated, failed)
            assert not r.kept if failed else r.kept
            assert t or r.perplexity == 1.0
        assert {r.doc_id for r in quality.passing(docs).collect()} == {i for i, r in got.items() if r.kept}
    # null, '' and a string that looks like null's own key are three languages
    names = {r.lang for r in quality.train(spark.createDataFrame([(k, lang, "some text") for k, lang in enumerate(["", None, "\0"])], "doc_id long, lang string, text string")).collect()}
    assert names == {"", "\0", "\0\0"} == {quality.lang_key(x) for x in ("", None, "\0")}


def test_quality_prunes_nothing_whatever_the_broadcast_holds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "xx", "")], "doc_id long, lang string, text string"), allowMissingColumns=True)
    rows = lambda: sorted(map(tuple, quality.quality(docs).collect()))
    want, kept = rows(), sorted(r.doc_id for r in quality.passing(docs).collect())
    assert kept == sorted(r[0] for r in want if r[7])
    kept_grams = quality.kept_grams  # pruning, as beyond MODEL_GRAMS, must not reach the verdicts
    monkeypatch.setattr(quality, "kept_grams", lambda grams, limit=0: kept_grams(grams, 1500))
    assert rows() == want
    for held in (0, 3000):  # n-grams whose scores are broadcast; all others are joined
        monkeypatch.setattr(quality, "HELD_SCORES", held)
        assert rows() == want
        assert sorted(r.doc_id for r in quality.passing(docs).collect()) == kept


def subset_sum(lengths, counts, budget):
    reach = {0}
    for length, n in zip(lengths, counts):
        reach = {s + k * length for s in reach for k in range(n + 1) if s + k * length <= budget}
    return max(reach)


def test_mixing_fits_long_texts_exactly():
    passes, take = mixing.plan(np.array([18_000, 19_000, 20_000]), np.array([3, 3, 3]), 56_000)
    assert passes == 0 and take @ [18_000, 19_000, 20_000] == 56_000
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 100_000), rng.randrange(1, 7)))
        counts = [rng.randrange(1, 4) for _ in lengths]
        total = sum(x * n for x, n in zip(lengths, counts))
        budget = rng.randrange(total)
        passes, take = mixing.plan(np.array([0, *lengths]), np.array([2, *counts]), budget)
        assert passes == 0 and take[0] == 0 and (take[1:] <= counts).all()
        assert int(take[1:] @ np.array(lengths)) == subset_sum(lengths, counts, budget)


@pytest.mark.parametrize("window", [1, 50])
def test_mixing_widens_its_window(monkeypatch, window):
    monkeypatch.setattr(mixing, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(150):
        unit = rng.choice([1, 1, 6])
        lengths = [unit * x for x in sorted(rng.sample(range(1, 60), rng.randrange(1, 6)))]
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(sum(x * n for x, n in zip(lengths, counts)))
        _, take = mixing.plan(np.array(lengths), np.array(counts), budget)
        assert (take <= counts).all() and int(take @ np.array(lengths)) == subset_sum(lengths, counts, budget)


def test_broken_images_are_error_rows(spark):
    rng = random.Random(8)
    files = [b"P2 2 2 255 1 2 3 99999999999999999999", b"P1 2 2 9", b"P3 1 1 255 1 2 -3", b"P5 99999999999 9999999999 255\n", b"BM" + b"\xff" * 60, b"P2 1 1 65536 1", b"P2\n#", b""]
    heads = [b"P%d 3 2 255\n" % k for k in range(1, 7)] + [b"P%d\n#c\n2\t2\n" % k for k in range(1, 7)] + [b"BM", media.encode_bmp(np.zeros((2, 3, 3), np.uint8))[:54], b""]
    files += [rng.choice(heads) + (rng.randbytes if rng.random() < 0.5 else lambda n: bytes(rng.choices(b"0123456789 \n#-.e\x0b\xff", k=n)))(rng.randrange(60)) for _ in range(3000)]
    good = media.encode_bmp(np.arange(60, dtype=np.uint8).reshape(4, 5, 3))
    files += [bytes(b ^ (rng.random() < 0.05) * rng.randrange(256) for b in good) for _ in range(500)]
    for data in files:
        assert len(media.described(data)) == 6
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(files[:8])], "doc_id long, media binary")
    got = media.media_columns(rows).collect()
    assert len(got) == 8 and all(r.error and r.tile is None for r in got)


def test_ids_are_told_apart_without_moving_texts(spark, monkeypatch):
    """Beyond the broadcast limit rows are judged in place, exactly, by bitmaps of ids."""
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(30)) for _ in range(120)]
    rows = [(k, base[k % 120] if k % 3 else base[k % 120] + " end", "x", k) for k in range(400)] + [(None, "no id", "x", 0), (7, base[7], "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a``b` string, spots long")
    want = sorted(map(tuple, near_dedup.deduplicated(docs).collect()), key=str)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(near_dedup, "MOST_BITS", 1 << 10)  # more than a quarter of the bits are set, so bitmaps follow bitmaps
    monkeypatch.setattr(near_dedup, "FILTER_BITS", 1)
    plan = near_dedup.deduplicated(docs)
    assert sorted(map(tuple, plan.collect()), key=str) == want
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text
    held = near_dedup._told_apart(spark.range(0, 3000, 2).toDF("rep"), spark.range(1, 3000, 2).toDF("rep"))
    assert held is None  # 1,500 ids in 1,024 bits
    moved = near_dedup.without(docs, spark.range(0, 3000, 2).toDF("rep"), spark.range(1, 3000, 2).toDF("rep"))
    assert sorted(map(tuple, moved.collect()), key=str) == sorted([r for r in rows if r[0] is None or r[0] % 2], key=str)


def test_mixing_with_a_back_tick_in_a_name(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", "x") for k in range(4)], "doc_id long, text string, source string, `a``b` string")
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == 4


def test_quality_stage_of_the_pipeline_prunes_nothing(spark, monkeypatch):
    """The stage keeps the same whole rows when all n-grams are joined, repeated and null rows and odd columns included."""
    rows = [(k, ["en", "de", None][k % 3], " ".join(f"w{(k * 7 + j * j) % 41} is {j}" for j in range(20 + k)), "x") for k in range(40)] + [(3, "en", None, "y"), (41, None, "", "y"), (42, "en", "zq" * 300 + " a" * 12, "y")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, lang string, text string, key string")
    kept = lambda: sorted(map(str, corpus_pipeline.quality_rules(spark, docs, "").collect()))
    want, kept_grams = kept(), quality.kept_grams
    monkeypatch.setattr(quality, "kept_grams", lambda grams, limit=0: kept_grams(grams, 50))
    assert kept() == want and 30 < len(want) < len(rows)
    for held in (0, 100):
        monkeypatch.setattr(quality, "HELD_SCORES", held)
        assert kept() == want
