"""A session's modes one after another, in one folder."""

import pytest

from kokek.operators import decompose as search
from kokek.operators import neural, render
from kokek.session import Session
from kokek.sources import text as source


def words(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "word string")


def test_modes(spark, tmp_path):
    folder = str(tmp_path / "state")
    session = Session(spark, folder, words(spark, "ev", "evler", "kitap", "gelmek", "evlermek"))
    assert session.stats().first().asDict() == {"n_words": 0, "n_gold": 0, "latest": None, "best": None, "recent": None}
    found = session.analyze(words(spark, "evler")).collect()
    assert len(found) > 1 and all(r.score is None for r in found)
    wanted = next(r for r in found if r.root == "ev" and r.chain == ["conjugation_3pl"])
    asked = spark.createDataFrame([("evler", wanted.cand_ord), ("kitap", 0), ("xyz", 0), ("evlere", 999)], "word string, cand_ord int")
    assert {r.word: r.status for r in session.train(asked).collect()} == {"evler": "trained", "kitap": "unambiguous", "xyz": "no_analysis", "evlere": "unknown_choice"}
    gold = session.gold().collect()
    assert [(r.word, r.root, [s.name for s in r.suffixes], r.suffixes[0].form) for r in gold] == [("evler", "ev", ["conjugation_3pl"], "ler")]
    # evler is derived, so it and its infinitive leave the dictionary, in a new snapshot
    assert {r.word for r in session.words().collect()} == {"ev", "kitap", "gelmek"}
    assert sorted(r.word for r in Session(spark, folder).lexicon.flags().where("noun").collect()) == ["ev", "gelmek", "kitap"]
    best = session.evaluate(words(spark, "evler", "xyz")).collect()
    assert [(r.word, r.analysis, r.suffixes_str) for r in best] == [("evler", "ev+conjugation_3pl", "ler")] and best[0].score > 0
    assert session.relearn().first().asDict() == {"n_words": 1, "n_matched": 1, "n_skipped": 0}
    stats = session.stats().first()
    assert (stats.n_words, stats.n_gold) == (1, 1) and stats.best <= stats.latest and stats.recent is not None
    docs = spark.createDataFrame([(1, "Evler kitap xyz")], "doc_id long, text string")
    assert session.sample(docs).first().value == "ev+conjugation_3pl\nkitap\nxyz"
    assert {r.word for r in session.review(2, seed=3).collect()} <= {"ev", "kitap", "gel", "gelmek"}
    assert session.delete(words(spark, "nothing")) == 0


def test_an_empty_folder(spark, tmp_path):
    session = Session(spark, str(tmp_path / "none"))
    assert session.analyze(words(spark, "ev")).collect() == []
    assert session.relearn().first().n_words == 0


def test_commands_and_auto_mode(spark, tmp_path, capsys):
    from kokek.__main__ import HELP, menu, run

    session = Session(spark, str(tmp_path / "state"), words(spark, "ev", "evler", "kitap", "gelmek"))
    assert run(session, "") == run(session, "train evler") == HELP.splitlines()
    options = run(session, "OPTIONS evler")
    assert len(options) > 2 and options[0].startswith("1. 0.0000")
    assert run(session, "train evler 99") == ["no such choice", "examples so far: 0"]
    assert run(session, "train evler 2") == ["evler\ttrained", "examples so far: 1"]
    assert run(session, "eval evler")[0].startswith("evler\tev+")
    assert run(session, "relearn")[:2] == ["trained: 1", "skipped: 0"]
    (tmp_path / "in").write_text("Evler xyz")
    assert run(session, f"sample {tmp_path}/in {tmp_path}/out") == [f"written: {tmp_path}/out"]
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()][-1] == "xyz"
    assert run(session, "delete kitap nothing") == ["deleted: 1"]
    menu(session, ["stats", "Quit", "stats"])
    assert capsys.readouterr().out.count("n_gold: 1") == 1
    summary = session.auto(lambda found: found.where("root <> word").select("word", "cand_ord"), 5).first().asDict()
    left = session.words().count()
    assert summary["words_processed"] == left + summary["words_deleted"] and 0 <= summary["words_skipped"] <= summary["words_processed"]


def test_a_form_rule_of_the_user(spark):
    from kokek.functions.forms import set_rule
    from kokek.functions.lexicon import Lexicon
    from kokek.operators import decompose

    rows, lexicon = words(spark, "evzz"), Lexicon(["ev"])
    assert decompose.decompose(rows, lexicon).count() == 0
    set_rule("plural_ler", lambda suffix, stem: ["zz"] if stem.harmony.startswith("FRONT") else [])
    try:
        assert [r.chain for r in decompose.decompose(rows, lexicon).collect()] == [["plural_ler"]]
    finally:
        set_rule("plural_ler", None)
    assert decompose.decompose(rows, lexicon).count() == 0


SHAPE = dict(dim=16, layers=1, heads=2, positions=8)


def test_modes_with_the_neural_ranker(spark, tmp_path):
    folder, shape = str(tmp_path / "state"), neural.Shape(**SHAPE)
    session = Session(spark, folder, words(spark, "ev", "evler", "kitap", "gelmek"), ranker="neural", shape=shape)
    assert session.state() is None and session.scorer() is None and session.count() == 0
    found = session.analyze(words(spark, "evler"))
    wanted = next(r for r in found.collect() if r.root == "ev" and r.chain == ["conjugation_3pl"])
    for _ in range(3):
        session.train(spark.createDataFrame([("evler", wanted.cand_ord)], "word string, cand_ord int"), prune=False)
    assert session.count() == 3 and session.stats().first().latest is not None and session.weights() is None
    scores = {r.cand_ord: r.score for r in session.analyze(words(spark, "evler")).collect()}
    chains = {r.cand_ord: list(zip(r.sids, r.cids)) for r in neural._encoded(found).collect()}
    again = dict(zip(chains, neural.forward(session.state().weights, list(chains.values()), shape)))
    assert all(abs(scores[k] - again[k]) < 1e-9 for k in chains) and len(set(map(tuple, chains.values()))) > 1
    best = max(scores, key=lambda k: (scores[k], -k))
    shown = session.evaluate(words(spark, "evler")).first()
    assert (shown.cand_ord, shown.score) == (best, scores[best])
    text = shown.analysis
    assert session.sample(spark.createDataFrame([(1, "Evler xyz")], "doc_id long, text string")).first().value == f"{text}\nxyz"
    assert session.relearn().first().asDict() == {"n_words": 1, "n_matched": 1, "n_skipped": 0}
    assert session.state().optimiser.n > 0 and session.count() == 4
    # the other ranker of the same folder has learnt nothing, and a third does not exist
    assert Session(spark, folder).count() == 0 and Session(spark, folder).scorer() is None
    with pytest.raises(ValueError, match="no such ranker"):
        Session(spark, folder, ranker="other")


def test_a_stopped_training_leaves_one_whole_snapshot(spark, tmp_path, monkeypatch):
    shape = neural.Shape(**SHAPE, dropout=0.1)
    monkeypatch.setattr("kokek.session.ROUND", 1)
    monkeypatch.setattr(neural, "BATCH", 1)
    names = ["evler", "evleri", "kitapları", "evde", "kitaplar"]

    def opened(name):
        session = Session(spark, str(tmp_path / name), words(spark, "ev", "kitap"), ranker="neural", shape=shape)
        found = search.cut(search.decompose(words(spark, *names), session.lexicon))
        return session, found, found.where("cand_ord = 1").select("word", "cand_ord")

    one, found, labels = opened("one")
    one._learn(found, labels, 2, 2, 5)
    two, found, labels = opened("two")
    whole, calls = Session._save, []

    def stop(self, rows, **numbers):
        whole(self, rows, **numbers)
        calls.append(numbers)
        if len(calls) in (1, 3):
            raise InterruptedError

    monkeypatch.setattr(Session, "_save", stop)
    for _ in range(5):
        try:
            two._learn(found, labels, 2, 2, 5)
            break
        except InterruptedError:
            assert two.count() == 0 and two.state() is not None  # the counter goes up with the last snapshot alone
    assert len(calls) > 4 and "task" not in calls[-1]
    assert two.count() == one.count() == 5
    a, b = one.state(), two.state()
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights) and all((a.optimiser.means[k][1] == b.optimiser.means[k][1]).all() for k in a.weights)
    assert len(source.files_in(spark, f"{two.folder}/neural")) == 1
    # the next training begins at its first epoch again
    two._learn(found, labels.limit(2), 1, 1, 2)
    assert two.count() == 7 and two.state().epoch == 1 and two.state().optimiser.n > b.optimiser.n


def test_an_incomplete_snapshot_is_replaced(spark, tmp_path):
    session = Session(spark, str(tmp_path / "s"), words(spark, "ev", "kitap"))
    found = search.cut(search.decompose(words(spark, "evler"), session.lexicon))
    session._learn(found, found.where("cand_ord = 1"), 3, 1, 1)
    kept = session.weights().collect()
    (tmp_path / "s" / "linear" / "1" / "part=session").mkdir(parents=True)  # a run that died while writing
    assert session.count() == 1 and session.weights().collect() == kept
    session._learn(found, found.where("cand_ord = 1"), 3, 1, 1)
    assert session.count() == 2 and session.stats().first().latest is not None


def test_known_words_start_no_search(spark, tmp_path, monkeypatch):
    session = Session(spark, str(tmp_path / "state"), words(spark, "ev", "kitap"))
    docs = spark.createDataFrame([(1, "Evler kitap xyz"), (2, ""), (3, None)], "doc_id long, text string")
    first = {(r.doc_id, r.value) for r in session.sample(docs).collect()}
    assert {i for i, _ in first} == {1, 2, 3} and first == {(r.doc_id, r.value) for r in render.annotate(docs, session.lexicon).collect()}
    searched, whole = [], render.best_analyses

    def counted(new, *rest):
        searched.append(sorted(r.word for r in new.collect()))
        return whole(new, *rest)

    monkeypatch.setattr(render, "best_analyses", counted)
    assert {(r.doc_id, r.value) for r in session.sample(docs).collect()} == first and not searched
    # a stream of two batches: the second has one new word, which alone is searched
    source_dir = tmp_path / "in"
    docs.write.json(str(source_dir / "0"))
    spark.createDataFrame([(4, "evler evlerde xyz")], "doc_id long, text string").write.json(str(source_dir / "1"))
    read = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(f"{source_dir}/*")
    session.stream(read(), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert searched == [["evlerde"]]
    got = {r.doc_id: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[4].split("\n")[2] == "xyz" and got[1] == dict(first)[1]
    # another dictionary is another version
    session.delete(words(spark, "ev"))
    assert dict((r.doc_id, r.value) for r in session.sample(docs).collect())[1] == "evler\nkitap\nxyz"
    assert len(searched) == 2 and searched[1] == ["evler", "kitap", "xyz"]
