"""The search against hand-traced analyses and against all ways to cut a word's remainder into pieces."""

import math
import random
from collections import Counter
from itertools import pairwise, product

import pytest

from kokek.functions.forms import Stem, automaton, form_lists, forms
from kokek.functions.lexicon import Lexicon
from kokek.functions.suffixes import BY_NAME, INTENSIFIER, arcs, may_follow
from kokek.operators import decompose as d
from kokek.operators import rank

LISTED = set("ev kitap burun gelmek beklemek mavi okul göz hał al almak gel araba demek güzel su ası aramak".split())
LEXICON = Lexicon(LISTED)
SOFT = {w[:-1] + "l" for w in LISTED if w.endswith("ł")}
NOUNS = LISTED | SOFT
BACK, FRONT, CLOSE = "aıou", "eiöü", "ıiuü"
VERBS = {w[:-3] for w in LISTED if w[-3:] == ("mak" if [c for c in w[:-3] if c in BACK + FRONT][-1:] in map(list, BACK) else "mek")}
PIECES = {f for _, _, made in form_lists() for f in made if f}
NARROWING = ("iyor", "ıyor", "uyor", "üyor")
ENDINGS = {"past": [a + b for a in "dt" for b in CLOSE], "condition": ["se", "sa"], "negation": ["me", "ma"], "in": [c + "n" for c in CLOSE], "close": [*CLOSE], "open": [*"aoeö"], "n": "n", "l": "l", "r": "r", "hard": [*"fstkçşhp"]}


def stem(w):
    vowels = [c for c in w if c in BACK + FRONT]
    side = "FRONT" if w in SOFT or vowels and vowels[-1] in FRONT else "BACK"
    harmony = side + ("_ROUND" if vowels[-1] in "ouöü" else "_WIDE") if vowels else "NONE"
    return Stem(harmony, next((k for k, tails in ENDINGS.items() if w.endswith(tuple(tails))), "other"), len(w) > 2, w in VERBS, w[:-2] in VERBS)


def spellings(rest):
    """Ways in which the remainder may have been written with an a or e that -iyor swallowed."""
    spots = [i for i in range(len(rest)) if rest.startswith(NARROWING, i)]
    for lost in product(("", "a", "e"), repeat=len(spots)):
        at = dict(zip(spots, lost))
        text, ends = "", set()
        for i, c in enumerate(rest):
            if at.get(i):
                text += at[i]
                ends.add(len(text))
            text += c
        yield text, ends


def cuts(text, ends):
    """Cuts of the text into possible pieces, each swallowed vowel ending one."""
    for inner in product((False, True), repeat=max(0, len(text) - 1)):
        at = [0, *(i + 1 for i, x in enumerate(inner) if x), *([len(text)] if text else [])]
        pieces = [text[a:b] for a, b in pairwise(at)]
        if ends <= set(at) and all(p in PIECES for p in pieces):
            yield pieces


def readings(root, pos, rest):
    """Counter of (chain, final part of speech), one for each spelled length of a chain."""
    found = set()
    for text, ends in spellings(rest):
        for pieces in cuts(text, ends):
            stems = [root + "".join(pieces[:k]) for k in range(len(pieces))]
            fitting = [[(a, b, s) for a, b, _, s in arcs() if p in forms(s, stem(w))] for w, p in zip(stems, pieces)]
            for chosen in product(*fitting):
                names = [s.name for *_, s in chosen]
                kinds = [pos, *(b for _, b, _ in chosen)]
                joined = all(a == k for (a, _, _), k in zip(chosen, kinds)) and all(may_follow(x.group, y.group) for (*_, x), (*_, y) in pairwise(chosen))
                if joined and all(names.count(n) == 1 for n in names if BY_NAME[n].unique):
                    found.add((len(text), tuple(names), kinds[-1]))
    return Counter((names, final) for _, names, final in found)


def hidden(lemma):
    """Counter of the surfaces that a root may show, by how many rules lead from each back to it."""
    voiced = [lemma[:-1] + c for c in {"p": "b", "ç": "c", "t": "d", "k": "ğg"}.get(lemma[-1], "")] + [lemma] * (lemma[-1] not in "bcdğg")
    out = Counter(voiced)
    for whole in [*voiced, lemma]:
        if len(whole) > 3 and whole[-2] in CLOSE and len(whole) < 11 and whole[-1] not in BACK + FRONT:
            out[whole[:-2] + whole[-1]] += 1
    if lemma[-1] in "ae" and len(lemma) > 2:
        out[lemma[:-1]] += 1
    return out


def analyses(word):
    out = Counter()
    for root in sorted(NOUNS | VERBS):
        kinds = ["noun"] * (root in NOUNS) + ["verb"] * (root in VERBS)
        shown = {root: 1} | {s: n for s, n in hidden(root).items() if s not in NOUNS | VERBS}
        for surface, times in shown.items():
            if word.startswith(surface):
                for pos in kinds:
                    for (chain, final), n in readings(root, pos, word[len(surface) :]).items():
                        out[root, pos, chain, final] += n * times
    return out


WORDS = "kitap evler kitabı burnu geliyor bekliyor xyz evlerimizden okulumuzda gelmeyecek alıyorlar güzelleşiyor hali suyu gözlükçü arabadan evin diyor alabildi evdekiler bekleyen geldim".split()


def rows(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_against_all_cuts(spark):
    got = {}
    for r in d.decompose(rows(spark, WORDS), LEXICON).collect():
        if r.chain[:1] != [INTENSIFIER]:
            got.setdefault(r.word, Counter())[r.root, r.pos, tuple(r.chain), r.final_pos] += 1
        assert len(r.chain) == len(r.makes) == len(r.forms)
    for w in WORDS:
        assert got.get(w, Counter()) == analyses(w), w


def test_hand_traced(spark):
    got = {}
    for r in d.decompose(rows(spark, ["evler", "kitabı", "burnu", "masmavi", "arasında"]), LEXICON).orderBy("word", "cand_ord").collect():
        got.setdefault(r.word, []).append((r.root, r.pos, "+".join(r.chain), r.final_pos))
    assert got["evler"] == [("ev", "noun", "plural_ler", "noun"), ("ev", "noun", "conjugation_3pl", "noun"), ("ev", "noun", "aplicative_le+factative_ir", "noun")]
    assert got["burnu"] == [("burun", "noun", "posessive_3sg", "noun")] * 2
    assert got["masmavi"] == [("mavi", "noun", "pekistirme", "noun")]
    assert [x[2] for x in got["arasında"] if x[0] == "ası"][:2] == ["pekistirme+posessive_2sg+ablative_de", "pekistirme+ablative_de"]
    once = [r for r in d.decompose_distinct(rows(spark, ["burnu"]), LEXICON).collect()]
    assert len(once) == 1


@pytest.mark.parametrize("words", [[], ["", None]])
def test_nothing(spark, words):
    assert d.decompose(rows(spark, words), LEXICON).collect() == []


def test_a_long_word_is_searched_to_its_end(spark):
    word = "ev" + "leş" * 30 + "mek"
    assert any(len(r.chain) > 50 for r in d.decompose(rows(spark, [word]), LEXICON).collect())


def test_a_dictionary_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    from kokek.functions import lexicon

    want = sorted(map(str, d.decompose(rows(spark, WORDS), LEXICON).collect()))
    monkeypatch.setattr(lexicon, "BROADCAST_WORDS", 3)
    assert sorted(map(str, d.decompose(rows(spark, WORDS), Lexicon(rows(spark, sorted(LISTED)))).collect())) == want


def test_training_works_on_alike_words_once(spark):
    """Words whose candidates have the same features count as often as there are, in weights worked out here by dictionaries."""
    roots = [c + "e" + d for c in "bcdg" for d in "klmn"]
    words = spark.createDataFrame([(r + e,) for r in roots for e in ("ler", "lerde")] + [("evler",)], "word string")
    found = d.cut(d.decompose(words, Lexicon([*roots, "ev"])))
    labels = found.where("cand_ord = 0").select("word", "cand_ord")
    right = labels.selectExpr("word", "cand_ord", "1 AS label")
    kinds = rank.alike(found, right).select("word", "times").distinct().collect()
    n = found.select("word").distinct().count()
    assert len(kinds) * 4 < n == sum(r.times for r in kinds)
    used = {}
    for r in rank.features(found).collect():
        used.setdefault(r.word, {}).setdefault(r.cand_ord, []).append(r.feature)
    want = {f: 0.0 for cands in used.values() for fs in cands.values() for f in fs}
    for _ in range(3):
        slope = dict.fromkeys(want, 0.0)
        scores = [{k: sum(want[f] for f in fs) for k, fs in cands.items()} for cands in used.values()]
        if all(x[0] > max((s for k, s in x.items() if k), default=-math.inf) + rank.MARGIN for x in scores):
            break
        for cands in used.values():
            e = {k: math.exp(sum(want[f] for f in fs) / rank.TEMPERATURE) for k, fs in cands.items()}
            for k, fs in cands.items():
                for f in fs:
                    slope[f] += e[k] / sum(e.values()) - (k == 0)
        want = {f: w - 0.5 * slope[f] for f, w in want.items()}
    got = {r.feature: r.weight for r in rank.fit(found, labels, steps=3).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_root_keys_are_those_of_every_start(spark):
    lexicon = Lexicon("ev kitap gelmek hał hal al almak mavi".split())
    words = spark.createDataFrame([(w,) for w in ("evler", "kitabı", "geliyor", "halde", "masmavi", "alır")], "word string")
    begun = d.starts(words, lexicon)
    keys = {r.word: r.fkey for r in lexicon.root_keys().collect()}
    rows = lexicon.keyed(begun.select("root"), "root").collect()
    assert len(rows) > 5 and all(keys[r.root] == r.fkey for r in rows)


def test_texts_that_no_suffix_can_use_up_are_dropped_first(spark, monkeypatch):
    """The automaton of tails drops most states before the first level, and none that leads to an analysis."""
    rng = random.Random(5)
    forms = sorted({arc[-1] for arc in automaton()[1]})
    roots = ["gel", "bekle", "ev", "araba", "oku", "kitap", "su"]
    words = [rng.choice(roots) + "".join(rng.choice(forms) for _ in range(rng.randrange(4))) for _ in range(300)]
    words += [rng.choice(roots) + "".join(rng.choice("aeıiklmnrty") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    words += ["bekliyor", "bekliyorum", "gelmiyor", "gelmiyorlar", "okuyor", "arıyor", "masmavi", "bembeyazlar", "evwx", "geldi\n"]
    lexicon = Lexicon(["ev", "araba", "kitap", "su", "mavi", "beyaz", "gelmek", "beklemek", "okumak", "aramak"])
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    found = lambda: sorted(map(str, d.decompose(df, lexicon).collect()))
    begun = d.starts(df, lexicon)
    left, every = begun.where(d._usable()).count(), begun.count()
    got = found()
    monkeypatch.setattr(d, "_usable", lambda: "true")
    assert got == found() and len(got) > 90 and left < every
