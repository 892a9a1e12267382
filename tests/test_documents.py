"""Frequent tokens, files read in splits, rules that see stems, and the menu."""

import random

import pytest
from pyspark.sql import functions as F

from kokek.__main__ import menu
from kokek.functions.lexicon import Lexicon
from kokek.operators import decompose, render
from kokek.session import Session
from kokek.sources import text as source

LEXICON = "ev kitap gelmek okul".split()


def test_one_token_in_most_places_is_in_no_single_task(spark, monkeypatch):
    rng = random.Random(1)
    rare = [f"kitap{e}" for e in ("", "lar", "ta", "tan")] + [f"x{k}" for k in range(300)]
    rows = [(d, " ".join("evler" if rng.random() < 0.9 else rng.choice(rare) for _ in range(rng.randrange(200)))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.value for r in render.annotate(docs, Lexicon(LEXICON)).collect()}
    monkeypatch.setattr(render, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(render, "FREQUENT", 20)
    assert {r.doc_id: r.value for r in render.annotate(docs, Lexicon(LEXICON)).collect()} == want and "ev+plural_ler" in want[1]
    tokens = source.tokenize(docs)
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = spark.createDataFrame([("evler", "ev+plural_ler"), ("kitaplar", "kitap+plural_ler")], "token string, analysis string")
    dealt, rest = render._dealt(tokens, best, counts)
    n = tokens.count()
    assert dealt.count() == n and dealt.where("token = 'evler'").where("hot IS NULL").isEmpty()
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] * 20 < n  # no key has more than a twentieth of all places
    per_task = dealt.repartition(16, "key").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < n / 16 * 2


def test_documents_are_written_where_they_are(spark, monkeypatch):
    rows = [(1, "Evler, xyz geliyor."), (2, None), (3, ""), (4, " . "), (5, "ev"), (6, "x" * 70_000 + " evler")] + [(k, "ev kitaplar y " * (k % 9)) for k in range(7, 1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = render.annotate(docs, Lexicon(LEXICON))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()  # no text is shuffled
    got = {r.doc_id: r.value for r in made.collect()}
    assert got[1] == "ev+plural_ler\nxyz\ngel+continuous_iyor" and [got[k] for k in (2, 3, 4, 5)] == ["", "", "", "ev"] and got[6].endswith("\nev+plural_ler")
    monkeypatch.setattr(render, "BROADCAST_WORDS", 0)
    assert {r.doc_id: r.value for r in render.annotate(docs, Lexicon(LEXICON)).collect()} == got and len(got) == len(rows)
    assert {r.value for r in render.annotate(docs.where("doc_id IN (2, 3)"), Lexicon(LEXICON)).collect()} == {""}
    monkeypatch.undo()
    assert {r.value for r in render.annotate(docs.where("doc_id IN (2, 3)"), Lexicon(LEXICON)).collect()} == {""}


def test_a_file_is_read_in_splits_and_in_order(spark, tmp_path):
    rng = random.Random(2)
    words = [rng.choice(["Ev", "ev'ler", "x,y", "\n", "\n\n", "\r\n", "  ", "ığüş", "12"]) + rng.choice([" ", "\n"]) for _ in range(20_000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "0").write_text("".join(words))
    (tmp_path / "a" / "1").write_text("last word")
    text = "".join(words) + "\nlast word"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert source.read_lines(spark, str(tmp_path / "a")).rdd.getNumPartitions() > 3
        got = source.read_tokens(spark, str(tmp_path / "a")).orderBy("pos").collect()
        want = source.tokenize(spark.createDataFrame([(0, text)], "doc_id long, text string")).orderBy("pos").collect()
        assert [(r.pos, r.token) for r in got] == [(r.pos, r.token) for r in want] and len(want) > 10_000
        session = Session(spark, str(tmp_path / "s"), spark.createDataFrame([(w,) for w in LEXICON], "word string"))
        session.sample_file(str(tmp_path / "a"), str(tmp_path / "out"))
        best = {"ev": "ev", "evler": "ev+plural_ler"}
        lines = "\n".join(p.read_text().strip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size).split("\n")
        assert lines == [best.get(r.token, r.token) for r in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "none").write_text(" \n , \n")
    assert source.read_tokens(spark, str(tmp_path / "none")).collect() == []
    assert source.read_tokens(spark, str(tmp_path / "missing")).collect() == []


def test_a_rule_that_sees_the_stem(spark):
    """Of two stems with the same features only the one that ends in "tap" takes the form, by its letters."""
    words = spark.createDataFrame([("kitapqq",), ("bardakqq",), ("kitapqqq",), ("evler",)], "word string")
    listed = [*LEXICON, "bardak"]

    def rule(stem, features):
        assert features.tail == "h" or not stem.endswith("p")
        return ["qq"] if stem[-3:] == "tap" else ["q"] if stem.endswith("qq") else []

    lexicon = Lexicon(listed, rules={"plural_ler": rule})
    found = decompose.cut(decompose.decompose(words, lexicon))
    assert {(r.word, r.root, tuple(r.chain), tuple(r.forms)) for r in found.collect()} >= {("kitapqq", "kitap", ("plural_ler",), ("qq",))}
    assert {tuple(r.forms) for r in found.where("word = 'kitapqqq'").collect()} == {("qq", "q")}  # after a stem that the first form made
    assert {r.word for r in found.collect()} <= {"kitapqq", "kitapqqq", "evler"} and not found.where("word = 'evler' AND array_contains(chain, 'plural_ler')").count()
    shown = {r.word: r.suffixes_str for r in render.segments(found, lexicon).collect()}
    assert shown["kitapqq"] == "qq"
    gold = render.gold_rows(found, lexicon).where("word = 'kitapqq'").first()
    assert [(x.name, x.form) for x in gold.suffixes] == [("plural_ler", "qq")]
    # rules of one dictionary are no other's
    assert decompose.decompose(words, Lexicon(listed)).where("word = 'kitapqq'").isEmpty()
    same = Lexicon(listed, rules={"plural_ler": lambda stem, features: ["lar"] if features.harmony.startswith("BACK") else ["ler"]})
    texts = spark.createDataFrame([(w,) for w in ("evler", "kitaplar", "okullarda", "evlerde")], "word string")
    plain = lambda lexicon: sorted(map(str, decompose.decompose(texts, lexicon).collect()))
    assert plain(same) == plain(Lexicon(listed))
    with pytest.raises(KeyError):
        Lexicon(listed, rules={"no_such_suffix": rule})


def test_menu_asks_and_keeps_or_forgets(spark, tmp_path, capsys):
    session = Session(spark, str(tmp_path / "s"), spark.createDataFrame([(w,) for w in (*LEXICON, "evler")], "word string"))
    menu(session, ["evler", "1", "evler", "s", "xyz", "q", "n"])
    out = capsys.readouterr().out
    assert "numbers of the right ones" in out and "xyz: no analysis" in out and "keep what was learnt?" in out and "forgotten: 1" in out
    assert session.count() == 0 and session.snapshot() == -1
    menu(session, ["evler", "2", "save", "quit"])
    out = capsys.readouterr().out
    assert "saved: 0" in out and "keep what was learnt?" not in out and session.count() == 1
    menu(session, ["auto 2", "1", "1", "relearn", "q"])
    out = capsys.readouterr().out
    assert "auto mode summary" in out and "processed: 2" in out and "batch training complete" in out
