"""The neural ranker against finite differences, a plain forward pass, and on a small task."""

import gc
import math
import weakref

import numpy as np
import pytest

from kokek.functions.lexicon import Lexicon
from kokek.operators import decompose, neural, rank

SMALL = neural.Shape(suffixes=9, dim=16, layers=2, heads=4, positions=5, dropout=0.0)
CHAINS = [[(1, 1), (2, 2)], [(3, 1)], [], [(4, 2), (5, 1), (9, 1), (1, 1), (2, 1), (3, 2), (4, 1)]]


def plain(w, chain, shape):
    """One chain, unpadded, written with explicit loops over heads."""
    if not chain:
        x = np.zeros(shape.dim)
    else:
        x = np.stack([np.concatenate([w["suffix"][s], w["category"][c], w["position"][min(i, shape.positions - 1)]]) for i, (s, c) in enumerate(chain)]) @ w["input.w"] + w["input.b"]
        norm = lambda y, n: (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-5) * w[f"{n}.g"] + w[f"{n}.b"]
        for k in range(shape.layers):
            q, key, v = (x @ w[f"{k}.{n}.w"] + w[f"{k}.{n}.b"] for n in ("query", "key", "value"))
            size, out = shape.dim // shape.heads, []
            for h in range(shape.heads):
                s = slice(h * size, (h + 1) * size)
                p = np.exp(q[:, s] @ key[:, s].T / math.sqrt(size))
                out.append(p / p.sum(1, keepdims=True) @ v[:, s])
            x = norm(x + np.concatenate(out, 1) @ w[f"{k}.out.w"] + w[f"{k}.out.b"], f"{k}.first")
            y = x @ w[f"{k}.wide.w"] + w[f"{k}.wide.b"]
            x = norm(x + gelu(y) @ w[f"{k}.narrow.w"] + w[f"{k}.narrow.b"], f"{k}.second")
        x = x.mean(0)
    y = x @ w["head.0.w"] + w["head.0.b"]
    y = gelu((y - y.mean()) / np.sqrt(y.var() + 1e-5) * w["head.norm.g"] + w["head.norm.b"])
    return float((gelu(y @ w["head.1.w"] + w["head.1.b"]) @ w["head.2.w"] + w["head.2.b"])[0])


def gelu(y):
    return y * 0.5 * (1 + np.vectorize(math.erf)(y / math.sqrt(2)))


def shaken(shape, seed=3):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, 0.1, v.shape) for k, v in neural.begin(shape, seed).items()}


def test_scores_against_a_plain_forward_pass():
    w = shaken(SMALL)
    assert neural.forward(w, CHAINS, SMALL) == pytest.approx([plain(w, c, SMALL) for c in CHAINS], abs=1e-5)


def test_gradients_against_finite_differences():
    w, rng = shaken(SMALL), np.random.default_rng(0)
    labels, counts = np.array([0.0, 1, 0, 1]), [2, 2]
    value = lambda: neural.loss(neural.forward(w, CHAINS, SMALL), labels, counts)[0]
    tape = neural.Tape(w, SMALL)
    end = tape.scores(*neural.padded_batch(CHAINS))
    grads = tape.back(end, neural.loss(end[0][:, 0], labels, counts)[1][:, None])
    assert set(grads) == set(w)
    for name in w:
        for at in rng.integers(0, w[name].size, 3):
            spot = np.unravel_index(at, w[name].shape)
            if name in ("suffix", "category") and spot[0] == 0:
                continue
            old, step = w[name][spot], 1e-4
            w[name][spot] = old + step
            up = value()
            w[name][spot] = old - step
            slope, w[name][spot] = (up - value()) / (2 * step), old
            assert grads[name][spot] == pytest.approx(slope, abs=2e-4, rel=2e-2), name


def test_rates_and_clipped_steps():
    assert [round(neural.restarted_rate(k, 1.0), 4) for k in (0, 5, 10, 20, 30)] == [1.0, 0.505, 1.0, 0.505, 1.0]
    w = {"a": np.array([1.0, -1.0])}
    neural.AdamW(rate=0.1, decay=0.5).step(w, {"a": np.array([300.0, 400.0])})
    assert w["a"] == pytest.approx([1 * 0.95 - 0.1, -1 * 0.95 - 0.1], abs=1e-6)


def test_training_prefers_confirmed_analyses(spark, tmp_path):
    words = spark.createDataFrame([(w,) for w in ("evler", "kitaplar", "evlerimiz", "kitap", "xyz")], "word string")
    found = decompose.cut(decompose.decompose(words, Lexicon(["ev", "kitap"])))
    gold = found.where("get(chain, 0) = 'conjugation_3pl' AND word = 'evler'").select("word", "cand_ord")
    weights, last = neural.fit(found, gold, epochs=3)
    scored = neural.score(found, weights)
    assert scored.count() == found.count() and last < 1
    best = {r.word: r.cand_ord for r in rank.best_per_word(scored).collect()}
    assert best["evler"] == gold.first().cand_ord
    assert rank.margin_check(scored.join(gold.selectExpr("word", "cand_ord", "1 AS label"), ["word", "cand_ord"], "left").where("word = 'evler'").fillna(0)).first().ok
    neural.save(spark, weights, str(tmp_path / "w"))
    back = neural.load(spark, str(tmp_path / "w"))
    assert set(back) == set(weights) and all((back[k] == weights[k]).all() for k in back)
    assert neural.fit(found, gold.limit(0))[1] == 0.0
    assert neural.score(found.limit(0), weights).collect() == []


def labelled(spark):
    """Analyses of some words with labels for most of them."""
    names = [r + e for r in ("ev", "kitap", "okul", "göz", "araba", "su") for e in ("", "ler", "lar", "lerimiz", "larımız", "de", "da", "leri", "ları", "im", "ım")]
    words = spark.createDataFrame([(w,) for w in names], "word string")
    found = decompose.cut(decompose.decompose(words, Lexicon(["ev", "kitap", "okul", "göz", "araba", "su"])))
    return found, decompose.cut(found.where("cand_ord = pmod(xxhash64(word), 3)").select("word", "cand_ord"))


TINY = neural.Shape(dim=16, layers=1, heads=2, positions=8, dropout=0.2)


def far(a, b):
    return max(float(np.abs(a.weights[k] - b.weights[k]).max()) for k in a.weights)


def test_training_by_spark_equals_training_by_the_driver(spark, monkeypatch):
    found, labels = labelled(spark)
    monkeypatch.setattr(neural, "BATCH", 3)
    monkeypatch.setattr(neural, "PIECE", 100)
    run = lambda limit, width: neural.fit_state(found, labels, shape=TINY, steps=3, epochs=2, width=width, seed=5, limit=limit)
    for width in (2, 100):
        one, other = run(10_000, width), run(None, width)
        assert far(one, other) < 1e-9 and abs(one.loss - other.loss) < 1e-9
        assert one.optimiser.n == other.optimiser.n > 0 and far(one, neural.State(neural.begin(TINY))) > 1e-5
    assert neural.examples(found, labels, limit=4)[0].count() <= 4 < neural.examples(found, labels)[0].count()


def test_a_stopped_training_goes_on_to_the_same_weights(spark, tmp_path, monkeypatch):
    found, labels = labelled(spark)
    monkeypatch.setattr(neural, "BATCH", 6)
    fit = lambda **more: neural.fit_state(found, labels, shape=TINY, steps=2, epochs=2, width=2, seed=1, **more)
    whole = fit()
    saved = []

    def stop(state):
        path = str(tmp_path / f"{len(saved)}")
        neural.state_rows(spark, state).write.parquet(path)
        saved.append(path)
        if len(saved) % 2:
            raise InterruptedError

    state, stops = None, 0
    while stops < 20:
        try:
            done = fit(begun=state, save=stop)
            break
        except InterruptedError:
            stops += 1
            state = neural.state_of(spark.read.parquet(saved[-1]))
    assert stops > 1 and all((done.weights[k] == whole.weights[k]).all() for k in whole.weights)
    assert done.loss == whole.loss and done.optimiser.n == whole.optimiser.n
    assert neural.state_of(spark.createDataFrame([], neural._STATE)) is None


def test_each_row_has_the_score_of_its_own_chain(spark, monkeypatch):
    found, _ = labelled(spark)
    w = shaken(TINY)
    monkeypatch.setattr(neural, "BROADCAST_CHAINS", 2)
    got = {(r.word, r.cand_ord): r.score for r in neural.score(found, w, TINY).collect()}
    ids = {s.name: s.id for s in neural.SUFFIXES}
    rows = found.collect()
    assert len(got) == len(rows)
    for r in rows:
        chain = [(ids.get(c, 0), 2 if m == "verb" else 1) for c, m in zip(r.chain, r.makes)]
        assert got[r.word, r.cand_ord] == pytest.approx(plain(w, chain, TINY), abs=1e-5)


def test_distinct_chains_are_scored_by_several_tasks(spark, monkeypatch):
    """Chains are few bytes, so that Spark alone would make one task of them."""
    rows = [(f"w{k}", k % 3, ["plural_ler"] * (k % 7) + ["active_it"] * (k % 5), ["noun"] * (k % 7) + ["verb"] * (k % 5)) for k in range(200)]
    found = spark.createDataFrame(rows, "word string, cand_ord int, chain array<string>, makes array<string>")
    made, w, shape = [], shaken(neural.Shape(dim=16, layers=1, heads=2)), neural.Shape(dim=16, layers=1, heads=2)
    monkeypatch.setattr(neural, "cut", lambda df: made.append(df.localCheckpoint()) or made[-1])
    got = {(r.word, r.cand_ord): r.score for r in neural.score(found, w, shape).collect()}
    tasks = [n for n in made[0].rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(tasks) > 1 and sum(tasks) == 35
    for r in neural._encoded(found).collect():
        assert got[r.word, r.cand_ord] == pytest.approx(neural.forward(w, [list(zip(r.sids, r.cids))], shape)[0], abs=1e-9)


def test_a_tape_goes_once_it_has_run_back():
    """Else the arrays of many steps of training stay until Python looks for cycles."""
    tape = neural.Tape(shaken(SMALL), SMALL)
    end = tape.scores(*neural.padded_batch(CHAINS))
    gone = weakref.ref(tape)
    gc.disable()
    try:
        tape.back(end, np.ones((len(CHAINS), 1)))
        del tape
        assert gone() is None
    finally:
        gc.enable()


def test_the_query_trains_on_all_confirmed_words(spark, tmp_path, monkeypatch):
    """Its scores are those after training by the driver on every confirmed word, of which there are more than 64."""
    from kokek.plans import registry
    from kokek.session import ROUND

    roots, endings = "ev kitap okul göz araba su ağız oğul şehir renk".split(), "ler lar de da im ım leri ları lerde larda imiz ımız".split()
    spark.createDataFrame([(k, " ".join(r + e for e in endings)) for k, r in enumerate(roots)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept, made, fit_state = neural.examples, [], neural.fit_state
    monkeypatch.setattr(neural, "examples", lambda *a, **k: made.append(kept(*a, **k)) or made[-1])
    monkeypatch.setattr(neural, "fit_state", lambda *a, **k: fit_state(*a, **{"steps": 2} | k))
    got = {(r.word, r.cand_ord): r.score for r in registry.QUERIES["neural_score"](spark, str(tmp_path)).collect()}
    found = decompose.cut(decompose.decompose(*registry.words_and_dictionary(spark, str(tmp_path))))
    several = found.groupBy("word").count().where("count > 1").count()
    assert several > 64 and made[0][0].selectExpr("sum(times)").first()[0] == several
    weights = fit_state(found, registry.first_labels(found), steps=2, width=ROUND, limit=10_000).weights
    want = {(r.word, r.cand_ord): r.score for r in neural.score(found, weights).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_words_that_are_alike_count_as_often_as_there_are(monkeypatch):
    """Weights, and tapes by length and by number of candidates, give the sums of every word alone in one padded batch."""
    w, words = shaken(SMALL), [(CHAINS, [0, 1, 0, 0], 3), (CHAINS[:2], [1, 0], 1), (CHAINS[2:], [1, 1], 2)]
    each = [(chains, labels) for chains, labels, n in words for _ in range(n)]
    tape = neural.Tape(w, SMALL)
    end = tape.scores(*neural.padded_batch([c for chains, _ in each for c in chains]))
    value, g, _ = neural.loss(end[0][:, 0], np.array([y for _, labels in each for y in labels], float), [len(c) for c, _ in each])
    grads = tape.back(end, g[:, None] * 6)
    for most in (1, 6, 100):
        monkeypatch.setattr(neural, "LEARNT", most)
        total, n, _, own = neural.chunk_sums(w, words, SMALL, (0,))
        assert n == 6 and total == pytest.approx(value * 6, abs=1e-9) and set(own) == set(grads)
        assert all(np.abs(own[k] - grads[k]).max() < 1e-9 for k in grads)
