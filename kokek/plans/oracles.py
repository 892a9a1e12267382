"""Phonology, dictionary tests and form rules written by hand in DuckDB's SQL.

Nothing here calls the engine: rules are restated word by word over a table ``lex`` (word), so that
a match between both sides says something about the rules. Fixed values are the rules' constants.
"""

from __future__ import annotations

_VOWEL = "('a', 'ı', 'o', 'u', 'e', 'i', 'ö', 'ü')"


def last_vowel(w: str) -> str:
    return f"list_filter(string_split({w}, ''), lambda c: c IN {_VOWEL})[-1]"


def ends_open(w: str) -> str:
    return f"right({w}, 1) IN {_VOWEL}"


def soft(w: str) -> str:
    return f"(suffix({w}, 'l') AND concat({w}[:-2], 'ł') IN (SELECT word FROM lex))"


def noun(w: str) -> str:
    return f"({w} <> '' AND ({w} IN (SELECT word FROM lex) OR {soft(w)}))"


def major(w: str) -> str:
    return f"CASE WHEN {soft(w)} THEN 'FRONT' ELSE CASE {last_vowel(w)} " + " ".join(f"WHEN '{c}' THEN '{k}'" for k, cs in (("BACK", "aıou"), ("FRONT", "eiöü")) for c in cs) + " END END"


def back(w: str) -> str:
    return f"({major(w)} IS NOT DISTINCT FROM 'BACK')"


def minor(w: str) -> str:
    side = f"CASE WHEN {back(w)} THEN 'BACK_' ELSE 'FRONT_' END"
    return f"CASE WHEN {last_vowel(w)} IN ('o', 'u', 'ö', 'ü') THEN concat({side}, 'ROUND') WHEN {last_vowel(w)} IS NOT NULL THEN concat({side}, 'WIDE') END"


def infinitive(w: str) -> str:
    return f"CASE WHEN {back(w)} THEN concat({w}, 'mak') ELSE concat({w}, 'mek') END"


def verb(w: str) -> str:
    return f"({w} NOT IN ('e', 'ha', 'da', 'ra', 'ço') AND {infinitive(w)} IN (SELECT word FROM lex))"


def apply_major(w: str, base: str) -> str:
    return f"CASE WHEN {back(w)} THEN replace(replace(replace(replace({base}, 'e', 'a'), 'i', 'ı'), 'ü', 'u'), 'ö', 'o') ELSE {base} END"


def apply_minor(w: str, base: str) -> str:
    return f"CASE {minor(w)} WHEN 'BACK_ROUND' THEN array_to_string(string_split({base}, 'ı'), 'u') WHEN 'FRONT_ROUND' THEN array_to_string(string_split({base}, 'i'), 'ü') ELSE {base} END"


_HARDER = "CASE left({x}, 1) WHEN 'g' THEN 'k' WHEN 'ğ' THEN 'k' WHEN 'd' THEN 't' WHEN 'c' THEN 'ç' ELSE left({x}, 1) END"
_SOFTER = "CASE right({x}, 1) WHEN 'k' THEN 'ğ' WHEN 'ç' THEN 'c' WHEN 'p' THEN 'b' WHEN 't' THEN 'd' ELSE right({x}, 1) END"
_UNSOFT = "CASE right({x}, 1) WHEN 'b' THEN 'p' WHEN 'c' THEN 'ç' WHEN 'd' THEN 't' WHEN 'ğ' THEN 'k' WHEN 'g' THEN 'k' ELSE right({x}, 1) END"
HARD = "('f', 's', 't', 'k', 'ç', 'ş', 'h', 'p')"


def harden(w: str, x: str) -> str:
    return f"CASE WHEN right({w}, 1) IN {HARD} THEN concat({_HARDER.format(x=x)}, substr({x}, 2)) ELSE {x} END"


def soften(x: str) -> str:
    return f"concat({x}[:-2], {_SOFTER.format(x=x)})"


def unsoften(x: str) -> str:
    return f"concat({x}[:-2], {_UNSOFT.format(x=x)})"


def root_candidates(w: str) -> list[tuple[str, str]]:
    """(condition, lemma) in order, for a stem ``w``."""
    known = lambda x: f"({noun(x)} OR {verb(x)})"
    out = [(f"{w} <> '' AND {known(unsoften(w))}", unsoften(w))]
    for vowel in "ıiuü":
        x = f"concat({w}[:-2], '{vowel}', right({w}, 1))"
        inside = f"length({w}) BETWEEN 3 AND 9 AND NOT {ends_open(w)}"
        out += [(f"{inside} AND {known(x)}", x), (f"{inside} AND {known(unsoften(x))}", unsoften(x))]
    return out + [(f"length({w}) > 1 AND NOT {noun(w)} AND {known(x)}", x) for x in (f"concat({w}, 'a')", f"concat({w}, 'e')")]


def stem_key(w: str) -> str:
    two, one = f"right({w}, 2)", f"right({w}, 1)"
    ending = (
        f"CASE WHEN regexp_full_match({two}, '[dt][iıuü]') THEN 'past' WHEN {two} IN ('se', 'sa') THEN 'condition' WHEN {two} IN ('me', 'ma') THEN 'negation'"
        f" WHEN regexp_full_match({two}, '[iıuü]n') THEN 'in' WHEN {one} IN ('ı', 'i', 'u', 'ü') THEN 'close' WHEN {ends_open(w)} THEN 'open'"
        f" WHEN {one} IN ('n', 'l', 'r') THEN {one} WHEN {one} IN {HARD} THEN 'hard' ELSE 'other' END"
    )
    return f"concat(coalesce({minor(w)}, 'NONE'), ':', {ending}, ':', CAST(length({w}) > 2 AS INTEGER), CAST({verb(w)} AS INTEGER), CAST({verb(f'{w}[:-3]')} AS INTEGER))"


def facts(w: str) -> str:
    """What the form rules ask of a stem, as columns."""
    two = f"right({w}, 2)"
    return (
        f"{back(w)} AS bk, {minor(w)} AS mi, {ends_open(w)} AS v, right({w}, 1) AS lc, right({w}, 1) IN {HARD} AS hd, length({w}) > 2 AS lng, {verb(w)} AS vb, {verb(f'{w}[:-3]')} AS vb2,"
        f" regexp_full_match({two}, '[dt][iıuü]') AS past, {two} IN ('se', 'sa') AS cond, {two} IN ('me', 'ma') AS neg, regexp_full_match({two}, '[iıuü]n') AS inn"
    )


def _h1(x: str) -> str:
    return f"(CASE WHEN major AND bk THEN translate({x}, 'eiüö', 'aıuo') ELSE {x} END)"


def _h(x: str) -> str:
    return f"(CASE WHEN minor AND mi = 'BACK_ROUND' THEN replace({_h1(x)}, 'ı', 'u') WHEN minor AND mi = 'FRONT_ROUND' THEN replace({_h1(x)}, 'i', 'ü') ELSE {_h1(x)} END)"


def _c(x: str) -> str:
    return f"(CASE WHEN hd THEN concat(translate(left({x}, 1), 'gdcğ', 'ktçk'), substr({x}, 2)) ELSE {x} END)"


def _s(x: str) -> str:
    return f"concat(left({x}, length({x}) - 1), translate(right({x}, 1), 'kçpt', 'ğcbd'))"


def _pre(letter: str, x: str) -> str:
    return f"[concat(CASE WHEN v THEN '{letter}' ELSE '' END, {x})]"


def _if(test: str, items: str) -> str:
    return f"(CASE WHEN {test} THEN {items} ELSE [] END)"


def _new(test: str, x: str) -> str:
    """``x`` where ``test`` holds and the list ``l`` does not have it yet."""
    return f"list_concat(l, CASE WHEN {test} AND NOT list_contains(l, {x}) THEN [{x}] ELSE [] END)"


def form_rules() -> dict[str, str]:
    """The list of forms of each rule, over the columns of ``facts`` and of a suffix (base, major, minor, buffer)."""
    b = _c(_h("base"))
    join = lambda *xs: "list_concat(" * (len(xs) - 1) + xs[0] + "".join(f", {x})" for x in xs[1:])
    tense = "lng AND (past OR cond)"
    twice = lambda x: f"[{x}, {_s(x)}]"
    cut = lambda x: f"substr({x}, 2)"
    also = lambda start, *more: _let(start, *more)
    future, ik, iş, i = _c(_h1("'ecek'")), _c(_h("'ik'")), _c(_h("'iş'")), _c(_h("'i'"))
    de, den = _c(_h("'de'")), _c(_h("'den'"))
    close = "lc IN ('ı', 'i', 'u', 'ü')"
    return {
        "default": f"flatten(list_transform(CASE WHEN v AND left({b}, 1) IN {_VOWEL} THEN CASE WHEN buffer THEN [concat('y', {b}), concat('ğ', {b})] WHEN length({b}) > 1 THEN [{cut(b)}] ELSE [] END ELSE [{b}] END,"
        f" lambda x: CASE WHEN {_s('x')} = x THEN [x] ELSE [x, {_s('x')}] END))",
        "conjugation_1sg": f"CASE WHEN lng AND (past OR cond OR neg) THEN ['m'] ELSE {_pre('y', _h(repr('im')))} END",
        "conjugation_2sg": join(_if(tense, "['n']"), f"[{_h(repr('sin'))}]", _pre("y", _h("'in'"))),
        "conjugation_3sg": f"CASE WHEN lng AND neg THEN [{_h(repr('sin'))}] WHEN vb THEN [{_h(repr('sin'))}, ''] ELSE [''] END",
        "conjugation_1pl": join(_if(tense, "['k']"), _pre("y", _h("'iz'"))),
        "conjugation_2pl": join(_if(tense, f"[{_h(repr('niz'))}]"), f"[{_h(repr('siniz'))}]", _if("vb OR lng AND neg", _pre("y", _h("'in'")))),
        "conjugation_3pl": join(f"[{_h(repr('ler'))}]", _if("vb OR neg", f"[{_h(repr('sinler'))}]")),
        "if_suffix": _pre("y", _h1("'se'")),
        "posessive_3sg": _pre("s", i),
        "confactuous_le": _pre("y", _c(_h("'le'"))),
        "approximative_si": f"[substr({_h(repr('imsi'))}, CASE WHEN v THEN 2 ELSE 1 END)]",
        "ablative_de": join(_if(close, f"[concat('n', {de})]"), f"[{de}]"),
        "locative_den": join(_if(close, f"[concat('n', {den})]"), f"[{den}]"),
        "pasttense_noundi": _pre("y", _c(_h("'di'"))),
        "abstractifier_iyat": "['iye', 'iyet', 'iyat', 'at', 'et']",
        "counting_er": _pre("ş", _h("'er'")),
        "dimunitive_cik": f"[{_c(_h(repr('cik')))}, {_c(_h(repr('cek')))}, {_c(_h1(repr('cağız')))}]",
        "when_ken": _pre("y", "'ken'"),
        "marking_ki": f"['ki', concat({_h(repr('ın'))}, 'ki'), 'kü']",
        "copula_mis": _pre("y", _h("'miş'")),
        "noun_compound_suffix": _pre("n", _h("'ın'")),
        "accusative": f"CASE WHEN v THEN [concat('n', {_h1(repr('i'))}), concat('y', {_h1(repr('i'))})] ELSE [{_h1(repr('i'))}] END",
        "verbifier_e": _if("NOT v", f"[{_h1(repr('e'))}]"),
        "continuous_iyor": f"[concat({_h(repr('i'))}, 'yor')]",
        "nounifier_ecek": join(twice(future), _if("v", join(twice(f"concat('y', {future})"), twice(cut(future))))),
        "factative_ir": also(join(_if("lng AND neg AND vb2", "['z']"), f"[{_c(_h(repr('ir')))}]"), ("true", _c(_h1("'er'"))), ("v", "'r'")),
        "toolative_ek": twice(_c(_h1("'ek'"))),
        "nounifier_iş": join(f"[{iş}]", _if("v", f"[concat('y', {iş}), concat('ğ', {iş}), {cut(iş)}]"), _if("lc = 'n'", f"[concat('ç', {iş})]")),
        "perfectative_ik": f"list_transform([{join(twice(ik), _if('neg', f'''[concat('y', {ik}), concat('y', {_s(ik)})]'''), _if('v', f'''[concat('y', {ik}), concat('y', {_s(ik)}), concat('ğ', {ik}), {cut(ik)}, {_s(cut(ik))}]'''))}],"
        " lambda l: list_concat(l, CASE WHEN lc IN ('n', 'r') AND NOT list_contains(l, 'k') THEN ['k', 'ğ'] ELSE [] END))[1]",
        "nounifier_i": join(f"[{i}]", _if("v", f"[concat('y', {i}), concat('ğ', {i})]")),
        "nounifier_inti": also(join(f"[{_c(_h(repr('inti')))}]", _if("v", f"[{cut(_c(_h(repr('inti'))))}]")), ("inn", _c(_h1("'ti'")))),
        "toolifier_geç": f"list_transform([{twice(_c(_h(repr('geç'))))}], lambda l: list_concat(l, CASE WHEN list_contains(l, {_c(_h(repr('eç')))}) THEN [] ELSE {twice(_c(_h(repr('eç'))))} END))[1]",
        "adverbial_erek": _pre("y", _c(_h("'erek'"))),
        "active_it": join(_if("NOT v", f"[{_c(_h(repr('it')))}]"), _if("v OR lc IN ('r', 'l')", "['t']")),
        "passive_il": f"CASE WHEN v THEN ['n', 'l'] WHEN lc = 'l' THEN [{_h(repr('in'))}] ELSE [{_c(_h(repr('il')))}] END",
        "active_ir": f"[{_h(repr('ir'))}, {_h(repr('er'))}]",
    }


def _let(start: str, *more: tuple[str, str]) -> str:
    """``start``, then each form whose test holds and which is new."""
    out = start
    for test, x in more:
        out = f"list_transform([{out}], lambda l: {_new(test, x)})[1]"
    return out


def forms_case() -> str:
    """The forms of a suffix after a stem, by its ``rule``."""
    return "CASE rule " + " ".join(f"WHEN '{name}' THEN CAST({rule} AS VARCHAR[])" for name, rule in form_rules().items()) + " END"
