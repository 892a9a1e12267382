"""Lookups by the dictionary's length profile, against every split of a word; the minimised form table."""

import random
import time

from pyspark.sql import functions as F

from kokek.functions import forms
from kokek.functions.lexicon import Lexicon
from kokek.operators import decompose as search

LISTED = "ev kitap burun gelmek beklemek mavi okul göz hał hal al almak gel araba demek güzel su ası aramak gitmek o ağaç renk".split()


def words_of(seed, n):
    rng = random.Random(seed)
    endings = ["", "ler", "lerimiz", "ım", "ü", "mas", "iyor", "de", "ğ", "g", "bı"]
    return sorted({rng.choice(["", "mas", "güp", "ap"]) + rng.choice([*LISTED, "kitab", "burn", "bekl", "ağac", "reng"]) + "".join(rng.choices(endings, k=rng.randrange(4))) for _ in range(n)} | {"", "o", "a", "x", "ev"})


def test_lookups_equal_a_search_of_every_split(spark):
    words = spark.createDataFrame([(w,) for w in words_of(1, 400)], "word string")
    lexicon = Lexicon(LISTED)
    flags = {r.word: r for r in lexicon.flags().collect()}
    root = lambda x: x in flags and (flags[x].noun or flags[x].verb)
    splits = [(r.word, r.split, r.root, r.rest) for r in search.prefix_splits(words).collect()]
    want = sorted((w, k, a, b, pos) for w, k, a, b in splits if root(a) for pos in ("noun", "verb") if flags[a][pos])
    got = search.root_lookup(words, lexicon).select("word", "split", "root", "rest", "pos").collect()
    assert sorted(map(tuple, got)) == want and want
    surfaces = {}
    for r in lexicon._table("surfaces")[0].collect():
        surfaces.setdefault(r.surface, []).append(r)
    assert not any(root(x) for x in surfaces)
    want = sorted((w, k, a, r.cand_ord, r.lemma, pos, r.lemma + b) for w, k, a, b in splits if not root(a) for r in surfaces.get(a, []) for pos in ("noun", "verb") if r[pos])
    got = search.altered_roots(words, lexicon).select("word", "split", "surface", "cand_ord", "lemma", "pos", "virtual_word").collect()
    assert sorted(map(tuple, got)) == want and want


def test_lookups_of_shuffled_tables(spark, monkeypatch):
    """The same rows where no dictionary table is small."""
    words = spark.createDataFrame([(w,) for w in words_of(2, 80)], "word string")
    small = Lexicon(LISTED)
    run = lambda lexicon: sorted(map(str, search.decompose(words, lexicon).collect()))
    want = run(small)
    monkeypatch.setattr("kokek.functions.lexicon.BROADCAST_WORDS", 3)
    assert run(Lexicon(LISTED)) == want and want


def test_a_token_of_a_million_letters(spark):
    lexicon = Lexicon(LISTED)
    spark.createDataFrame([("ev",)], "word string").transform(lambda w: search.decompose(w, lexicon)).count()
    words = spark.createDataFrame([("kitabı" + "mas" * 333_333,), ("ev" * 500_000,), ("mas" + "mavi" * 250_000,)], "word string")
    began = time.time()
    assert search.decompose(words, lexicon).count() == 0
    found = search.starts(words, lexicon).select("word", "root").distinct().select("root").collect()
    assert {r.root for r in found} == {"kitap", "ev", "mavi"}
    assert time.time() - began < 60


def test_keys_beside_columns_of_any_names(spark):
    names = ["less", "LESS_", "soft", "verb", "verb2", "head", "lengths", "__less", "__soft"]
    rows = spark.createDataFrame([tuple(["gel"] + ["x"] * len(names))], ["word", *names])
    lexicon = Lexicon(LISTED)
    plain = lexicon.keyed(rows.select("word"), "word").first().fkey
    keyed = lexicon.keyed(rows, "word")
    assert set(keyed.columns) == {"word", *names, "fkey"} and keyed.first().fkey == plain
    cuts = lexicon.prefixes(rows, "word", "root", "root")
    assert cuts.columns == ["word", *names, "split", "root"] and {r.root for r in cuts.collect()} >= {"gel"}
    assert [r.verb for r in keyed.select("verb").collect()] == ["x"]


def test_automaton_is_the_form_table_minimised(spark):
    nodes, arcs = forms.automaton()
    arcs_of = {}
    for node, *arc in arcs:
        arcs_of.setdefault(node, []).append(tuple(arc))
    rows = sorted((key, start, *arc) for key, start, node in nodes for arc in arcs_of[node])
    assert rows == sorted(forms.form_rows())
    assert len({tuple(sorted(a)) for a in arcs_of.values()}) == len(arcs_of) and len(arcs) * 6 < len(rows)


def test_words_of_a_table_are_read_once(spark):
    from kokek.plans import registry

    sf = "/root/testdata/sf0.001"
    held = registry.vocabulary(spark, sf)
    tokens = registry.tokens(spark, sf)
    assert {r.word for r in registry.words_in(held).collect()} == {r.token for r in tokens.select("token").distinct().collect()} | set(registry.WORDS)
    n = registry.docs(spark, sf).count()
    often = tokens.where(F.length("token") > 2).select("doc_id", "token").distinct().groupBy("token").count().where(F.col("count") * 20 >= n).collect()
    assert {r.word for r in registry.dictionary_in(spark, sf, held).collect()} == {r.token for r in often} | set(registry.LISTED)
