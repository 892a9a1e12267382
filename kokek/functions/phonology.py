"""Phonology as SQL expressions.

Every function takes SQL text for a word and returns SQL text, so that expressions stay inside
code generation and compose freely. Where a rule asks the dictionary, it takes a boolean column of
the table joined by ``kokek.functions.lexicon`` instead of a word list.
"""

from __future__ import annotations

from collections.abc import Iterable

# Letter classes.
VOWELS = "aıoueiöü"
BACK = "aıou"
ROUND = "ouöü"
HARD = "fstkçşhp"
NEVER_VERBS = ("e", "ha", "da", "ra", "ço")


def listed(items: Iterable[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def last(w: str) -> str:
    return f"right({w}, 1)"


def cut_last(w: str) -> str:
    return f"substr({w}, 1, greatest(length({w}) - 1, 0))"


def is_in(c: str, letters: str) -> str:
    return f"({c} IN {listed(letters)})"


def first_vowel(w: str) -> str:
    """Zero-based place of the first vowel, -1 without one."""
    return f"(CASE WHEN regexp_extract({w}, '[{VOWELS}]', 0) = '' THEN -1 ELSE length(regexp_extract({w}, '^[^{VOWELS}]*', 0)) END)"


def ends_with_vowel(w: str) -> str:
    return is_in(last(w), VOWELS)


def ends_with_consonant(w: str) -> str:
    return f"(length({w}) > 0 AND NOT {ends_with_vowel(w)})"


def no_vowels(w: str) -> str:
    return f"(regexp_extract({w}, '[{VOWELS}]', 0) = '')"


def last_vowel(w: str) -> str:
    return f"regexp_extract({w}, '([{VOWELS}])[^{VOWELS}]*$', 1)"


def major(w: str, soft: str) -> str:
    """BACK or FRONT by the last vowel, null without one; a soft final l counts as front."""
    v = last_vowel(w)
    return f"(CASE WHEN {soft} THEN 'FRONT' WHEN {is_in(v, BACK)} THEN 'BACK' WHEN {v} <> '' THEN 'FRONT' END)"


def back(w: str, soft: str) -> str:
    return f"coalesce({major(w, soft)} = 'BACK', false)"


def minor(w: str, soft: str) -> str:
    v = last_vowel(w)
    return f"(CASE WHEN {v} = '' THEN NULL ELSE concat(CASE WHEN {back(w, soft)} THEN 'BACK' ELSE 'FRONT' END, CASE WHEN {is_in(v, ROUND)} THEN '_ROUND' ELSE '_WIDE' END) END)"


def infinitive(w: str, soft: str) -> str:
    return f"concat({w}, CASE WHEN {back(w, soft)} THEN 'mak' ELSE 'mek' END)"


def apply_major(w: str, base: str, soft: str) -> str:
    return f"(CASE WHEN {back(w, soft)} THEN translate({base}, 'eiüö', 'aıuo') ELSE {base} END)"


def apply_minor(w: str, base: str, soft: str) -> str:
    return f"(CASE {minor(w, soft)} WHEN 'BACK_ROUND' THEN replace({base}, 'ı', 'u') WHEN 'FRONT_ROUND' THEN replace({base}, 'i', 'ü') ELSE {base} END)"


def harden(w: str, suffix: str) -> str:
    hard = f"length({suffix}) > 0 AND {is_in(last(w), HARD)}"
    return f"(CASE WHEN {hard} THEN concat(translate(substr({suffix}, 1, 1), 'gdcğ', 'ktçk'), substr({suffix}, 2)) ELSE {suffix} END)"


def soften(x: str) -> str:
    return f"concat({cut_last(x)}, translate({last(x)}, 'kçpt', 'ğcbd'))"


def unsoften(x: str) -> str:
    return f"concat({cut_last(x)}, translate({last(x)}, 'bcdğg', 'pçtkk'))"


def restored(w: str, vowel: str) -> str:
    return f"concat({cut_last(w)}, '{vowel}', {last(w)})"


def root_candidates(w: str) -> list[tuple[str, str]]:
    """(condition, lemma) of each possible root behind a surface stem that is no root itself, in
    order; duplicates stay, and whether a lemma is in the dictionary is left to a join."""
    out = [(f"length({w}) > 0", unsoften(w))]
    middle = f"length({w}) > 2 AND length({w}) < 10 AND {ends_with_consonant(w)}"
    for vowel in "ıiuü":
        x = restored(w, vowel)
        out += [(middle, x), (middle, unsoften(x))]
    return out + [(f"length({w}) > 1", f"concat({w}, '{vowel}')") for vowel in "ae"]
