"""Deleting words through the log, against tables made of the words that are left."""

import os
import random

from pyspark.sql import functions as F

from kokek.functions.lexicon import MADE
from kokek.sources import dictionary as kept
from kokek.sources.dictionary import Dictionary

#: Roots that depend on each other: soft l, both infinitives of one stem, altered roots, vowel loss.
LISTED = (
    "ev kitap kitab burun burn gelmek gel hał hal halmak halmek al ał almak almek ağaç renk reng ara aramak ar mak mek ł l mavi"
    " bekle beklemek bekl oğul oğlu su o a at ad git gitmek gid da damak e emek"
).split()


def rows_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def as_set(table):
    return sorted(map(str, table.select(*sorted(table.columns)).collect()))


def fresh(spark, words):
    held = {}
    for name, make in MADE.items():
        held[name] = make(rows_of(spark, sorted(words)), dict(held))
    return {name: as_set(table) for name, table in held.items()}


def tables_of(dictionary):
    return {name: as_set(dictionary.table(name)) for name in MADE}


def test_tables_follow_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "LOG_PARTS", 3)
    rng, words = random.Random(1), set(LISTED)
    dictionary = Dictionary(spark, str(tmp_path / "d"))
    dictionary.create(rows_of(spark, LISTED))
    assert tables_of(dictionary) == fresh(spark, words)
    bases = set()
    for _ in range(4):
        gone = rng.sample(sorted(words), 7)
        assert dictionary.delete(rows_of(spark, [*gone, gone[0], "unknown", None])) == 7
        words -= set(gone)
        assert {r.word for r in dictionary.words().collect()} == words
        assert tables_of(dictionary) == fresh(spark, words)
        bases.add(dictionary.base())
    assert bases == {0, 1} and dictionary.version() == "1.0"  # the third log output was written into the tables
    assert dictionary.delete(rows_of(spark, ["unknown"])) == 0 and dictionary.version() == "1.0"


def test_a_soft_l_that_goes_changes_its_stem(spark, tmp_path):
    dictionary = Dictionary(spark, str(tmp_path / "d"))
    dictionary.create(rows_of(spark, ["hał", "halmak", "halmek"]))
    flag = lambda: dictionary.table("flags").where("word = 'hal'").select("noun", "verb", "soft").first()
    assert tuple(flag()) == (True, True, True)
    dictionary.delete(rows_of(spark, ["hał"]))
    assert tuple(flag()) == (False, True, False)  # halmak is its infinitive now
    dictionary.delete(rows_of(spark, ["halmak"]))
    assert flag() is None and tables_of(dictionary) == fresh(spark, {"halmek"})


def test_many_words_at_once_and_all_of_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "AT_ONCE", 3)
    dictionary = Dictionary(spark, str(tmp_path / "d"))
    dictionary.create(rows_of(spark, LISTED))
    assert dictionary.delete(rows_of(spark, LISTED[:10])) == 10 and dictionary.version() == "1.-1"
    assert tables_of(dictionary) == fresh(spark, set(LISTED[10:]))
    assert dictionary.delete(rows_of(spark, LISTED)) == len(LISTED) - 10
    assert dictionary.words().count() == 0 and not any(tables_of(dictionary).values())
    empty = Dictionary(spark, str(tmp_path / "none"))
    assert empty.words().count() == 0 and empty.delete(rows_of(spark, ["ev"])) == 0


def test_a_stopped_deletion_leaves_the_dictionary_as_it_was(spark, tmp_path):
    dictionary = Dictionary(spark, str(tmp_path / "d"))
    dictionary.create(rows_of(spark, LISTED))
    before = tables_of(dictionary)
    (tmp_path / "d" / "log" / "0" / "0" / "_temporary").mkdir(parents=True)  # no _SUCCESS
    (tmp_path / "d" / "tables" / "1" / "flags").mkdir(parents=True)
    assert tables_of(dictionary) == before and dictionary.version() == "0.-1"
    dictionary.delete(rows_of(spark, ["ev"]))
    assert tables_of(dictionary) == fresh(spark, set(LISTED) - {"ev"})
    dictionary.compact()
    assert dictionary.version() == "1.-1" and tables_of(dictionary) == fresh(spark, set(LISTED) - {"ev"})


def test_one_word_of_a_million(spark, tmp_path):
    """One deletion writes a few rows, none of the dictionary's own files, and shuffles no table."""
    dictionary = Dictionary(spark, str(tmp_path / "d"))
    made = spark.range(1_000_000).select(F.translate(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit("k")), "0123456789", "aeıioöuübç").alias("word"))
    dictionary.create(made.unionByName(rows_of(spark, ["kitap", "gelmek"])))
    assert dictionary.table("profile").count() > 0

    def files(part):
        return {(p, f, os.stat(os.path.join(p, f)).st_mtime_ns) for p, _, names in os.walk(tmp_path / "d" / part) for f in names}

    held = files("lexicon"), files("tables")
    n = {name: dictionary.table(name).count() for name in MADE}
    assert dictionary.delete(rows_of(spark, ["kitap"])) == 1
    assert (files("lexicon"), files("tables")) == held and dictionary.log().count() < 40
    assert dictionary.table("flags").count() == n["flags"] - 1 and dictionary.words().count() == 1_000_001
    assert dictionary.table("surfaces").where("lemma = 'kitap'").count() == 0
    plan = dictionary.table("flags")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
