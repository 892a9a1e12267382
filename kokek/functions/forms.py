"""Surface forms of suffixes as a finite table.

What a suffix looks like depends only on a few features of the stem before it, so all forms are
tabulated once: the search then joins stems to forms by an equality on the stem's features.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

from kokek.functions.phonology import HARD, VOWELS, is_in, last, listed, minor
from kokek.functions.suffixes import BY_NAME, Suffix, arcs, may_follow

# Stem endings that some rules ask for.
PAST = ("di", "dı", "du", "dü", "ti", "tı", "tu", "tü")
CONDITION = ("se", "sa")
NEGATION = ("me", "ma")
IN_ENDINGS = ("in", "ın", "un", "ün")
CLOSE = "ıiuü"

HARMONIES = ("BACK_ROUND", "BACK_WIDE", "FRONT_ROUND", "FRONT_WIDE", "NONE")
#: Ending classes with the kind of their last letter: v vowel, c close vowel, h hard consonant, or the letter.
ENDINGS = {"past": "c", "close": "c", "condition": "v", "negation": "v", "open": "v", "in": "n", "n": "n", "l": "l", "r": "r", "hard": "h", "other": "o"}


@dataclass(frozen=True)
class Stem:
    """Features of a stem; ``verb`` and ``verb2``: it, and it without two letters, are verbs."""

    harmony: str
    ending: str
    long: bool
    verb: bool
    verb2: bool

    @property
    def key(self) -> str:
        return f"{self.harmony}:{self.ending}:{int(self.long)}{int(self.verb)}{int(self.verb2)}"

    @property
    def tail(self) -> str:
        return ENDINGS[self.ending]

    @property
    def vowel(self) -> bool:
        return self.tail in "vc"


def stem_key(w: str, soft: str, verb: str, verb2: str) -> str:
    """The same key of a word, as SQL; ``soft``, ``verb`` and ``verb2`` are its dictionary flags."""
    two = f"right({w}, 2)"
    ending = (
        f"CASE WHEN {two} IN {listed(PAST)} THEN 'past' WHEN {two} IN {listed(CONDITION)} THEN 'condition' WHEN {two} IN {listed(NEGATION)} THEN 'negation'"
        f" WHEN {two} IN {listed(IN_ENDINGS)} THEN 'in' WHEN {is_in(last(w), CLOSE)} THEN 'close' WHEN {is_in(last(w), VOWELS)} THEN 'open'"
        f" WHEN {is_in(last(w), 'nlr')} THEN {last(w)} WHEN {is_in(last(w), HARD)} THEN 'hard' ELSE 'other' END"
    )
    flag = lambda c: f"CASE WHEN {c} THEN '1' ELSE '0' END"
    return f"concat(coalesce({minor(w, soft)}, 'NONE'), ':', {ending}, ':', {flag(f'length({w}) > 2')}, {flag(verb)}, {flag(verb2)})"


def stems() -> Iterator[Stem]:
    for harmony, ending, a, b, c in product(HARMONIES, ENDINGS, (False, True), (False, True), (False, True)):
        yield Stem(harmony, ending, a, b, c)


_BACKED, _HARDENED = str.maketrans("eiüö", "aıuo"), str.maketrans("gdcğ", "ktçk")
_SOFTENED = str.maketrans("kçpt", "ğcbd")


def _soft(x: str) -> str:
    return x[:-1] + x[-1:].translate(_SOFTENED)


#: Form rules set by the user, by suffix name, and how often they changed.
_own: dict[str, Callable[[Suffix, Stem], list[str]]] = {}
_changes = [0]
_PROCESS = uuid.uuid4().hex


def set_rule(suffix: str, rule: Callable[[Suffix, Stem], list[str]] | None) -> None:
    """Gives a suffix a form rule of the user's, a function of suffix and stem features that returns
    its forms in order; None brings its own rule back. Later searches use the new forms."""
    if suffix not in BY_NAME:
        raise KeyError(suffix)
    _own.pop(suffix, None)
    if rule is not None:
        _own[suffix] = rule
    _changes[0] += 1
    form_rows.cache_clear()
    automaton.cache_clear()
    form_lists.cache_clear()


def rules() -> str:
    """A name for the rules in force, by which results can be kept: rules of the user's are functions, so
    what they give holds for this process only."""
    return f"own-{_PROCESS}-{_changes[0]}" if _own else "base"


def version() -> int:
    """Changes with every rule set, so that tables of forms can be kept until then."""
    return _changes[0]


#: A form rule of the user's that sees the stem itself: its text and features give the forms, in order.
StemRule = Callable[[str, Stem], list[str]]


def stem_of(key: str) -> Stem:
    """The features that a stem key names."""
    harmony, ending, flags = key.split(":")
    return Stem(harmony, ending, *(c == "1" for c in flags))


def forms(s: Suffix, stem: Stem) -> list[str]:
    """Forms of a suffix after a stem, in order."""
    if s.name in _own:
        return list(_own[s.name](s, stem))

    def wide(x: str) -> str:  # major harmony only
        return x.translate(_BACKED) if s.major and stem.harmony.startswith("BACK") else x

    def full(x: str) -> str:
        x = wide(x)
        if s.minor and stem.harmony == "BACK_ROUND":
            return x.replace("ı", "u")
        return x.replace("i", "ü") if s.minor and stem.harmony == "FRONT_ROUND" else x

    def hard(x: str) -> str:
        return x[:1].translate(_HARDENED) + x[1:] if stem.tail == "h" else x

    def after_vowel(letter: str, x: str) -> list[str]:
        return [letter + x if stem.vowel else x]

    def both(*xs: str) -> list[str]:
        return [y for x in xs for y in (x, _soft(x))]

    v, ending, base = stem.vowel, stem.ending, s.base
    plain = hard(full(base))
    tensed = stem.long and ending in ("past", "condition")
    negated = ending == "negation"

    def default() -> list[str]:
        if v and plain[:1] in tuple(VOWELS):
            found = ["y" + plain, "ğ" + plain] if s.buffer else [plain[1:]] if len(plain) > 1 else []
        else:
            found = [plain]
        return [y for x in found for y in dict.fromkeys((x, _soft(x)))]

    def first_singular() -> list[str]:
        return ["m"] if tensed or stem.long and negated else after_vowel("y", full("im"))

    def second_plural() -> list[str]:
        called = stem.verb or stem.long and negated
        return ([full("niz")] if tensed else []) + [full("siniz")] + (after_vowel("y", full("in")) if called else [])

    def third_singular() -> list[str]:
        if stem.long and negated:
            return [full("sin")]
        return [full("sin"), ""] if stem.verb else [""]

    def future() -> list[str]:
        b = hard(wide("ecek"))
        return both(b, *(["y" + b, b[1:]] if v else []))

    def aorist() -> list[str]:
        found = (["z"] if stem.long and negated and stem.verb2 else []) + [hard(full("ir"))]
        return list(dict.fromkeys([*found, hard(wide("er")), *(["r"] if v else [])]))

    def perfect() -> list[str]:
        b = hard(full("ik"))
        found = [b, _soft(b)] + (["y" + b, "y" + _soft(b)] if negated else [])
        if v:
            found += ["y" + b, "y" + _soft(b), "ğ" + b, b[1:], _soft(b[1:])]
        return found + (["k", "ğ"] if stem.tail in "nr" and "k" not in found else [])

    def verbal_noun() -> list[str]:
        b = hard(full("iş"))
        return [b] + (["y" + b, "ğ" + b, b[1:]] if v else []) + (["ç" + b] if stem.tail == "n" else [])

    def shortened() -> list[str]:
        b, more = hard(full("inti")), hard(wide("ti"))
        found = [b] + ([b[1:]] if v else [])
        return found + ([more] if ending == "in" and more not in found else [])

    def tool() -> list[str]:
        g, e = hard(full("geç")), hard(full("eç"))
        return both(g) + (both(e) if e not in both(g) else [])

    def causative() -> list[str]:
        return ([] if v else [hard(full("it"))]) + (["t"] if v or stem.tail in "rl" else [])

    def passive() -> list[str]:
        return ["n", "l"] if v else [full("in")] if stem.tail == "l" else [hard(full("il"))]

    rules = {
        "default": default,
        "conjugation_1sg": first_singular,
        "conjugation_2sg": lambda: (["n"] if tensed else []) + [full("sin")] + after_vowel("y", full("in")),
        "conjugation_3sg": third_singular,
        "conjugation_1pl": lambda: (["k"] if tensed else []) + after_vowel("y", full("iz")),
        "conjugation_2pl": second_plural,
        "conjugation_3pl": lambda: [full("ler")] + ([full("sinler")] if stem.verb or negated else []),
        "if_suffix": lambda: after_vowel("y", wide("se")),
        "posessive_3sg": lambda: after_vowel("s", hard(full("i"))),
        "confactuous_le": lambda: after_vowel("y", hard(full("le"))),
        "approximative_si": lambda: [full("imsi")[1:] if v else full("imsi")],
        "ablative_de": lambda: (["n" + plain] if stem.tail == "c" else []) + [plain],
        "locative_den": lambda: (["n" + plain] if stem.tail == "c" else []) + [plain],
        "pasttense_noundi": lambda: after_vowel("y", hard(full("di"))),
        "abstractifier_iyat": lambda: ["iye", "iyet", "iyat", "at", "et"],
        "counting_er": lambda: after_vowel("ş", full("er")),
        "dimunitive_cik": lambda: [hard(full("cik")), hard(full("cek")), hard(wide("cağız"))],
        "when_ken": lambda: after_vowel("y", "ken"),
        "marking_ki": lambda: ["ki", full("ın") + "ki", "kü"],
        "copula_mis": lambda: after_vowel("y", full("miş")),
        "noun_compound_suffix": lambda: after_vowel("n", full("ın")),
        "accusative": lambda: ["n" + wide("i"), "y" + wide("i")] if v else [wide("i")],
        "verbifier_e": lambda: [] if v else [wide("e")],
        "continuous_iyor": lambda: [full("i") + "yor"],
        "nounifier_ecek": future,
        "factative_ir": aorist,
        "toolative_ek": lambda: both(hard(wide("ek"))),
        "nounifier_iş": verbal_noun,
        "perfectative_ik": perfect,
        "nounifier_i": lambda: [hard(full("i"))] + (["y" + hard(full("i")), "ğ" + hard(full("i"))] if v else []),
        "nounifier_inti": shortened,
        "toolifier_geç": tool,
        "adverbial_erek": lambda: after_vowel("y", hard(full("erek"))),
        "active_it": causative,
        "passive_il": passive,
        "active_ir": lambda: [full("ir"), full("er")],
    }
    return rules[s.rule]()


@cache
def form_rows() -> list[tuple]:
    """(stem key, start, target, suffix id, name, group, unique, order among arcs, form order, form):
    every form that can match, the empty one aside."""
    out = []
    targets = {"noun": 0, "verb": 1}
    rows = arcs()
    for stem in stems():
        made = {name: forms(s, stem) for name, s in BY_NAME.items()}
        for start, target, k, s in rows:
            for j, form in enumerate(made[s.name]):
                if form:
                    out.append((stem.key, start, target, s.id, s.name, s.group, s.unique, targets[target] * 1000 + k, j, form))
    return out


@cache
def automaton() -> tuple[list[tuple], list[tuple]]:
    """The forms as a minimised finite-state table: (stem key, part of speech, node) and (node, target,
    suffix id, name, group, unique, order among arcs, form order, form). Stems of one node have equal
    forms; what a form leads to follows from the stem it makes."""
    arcs_of: dict[tuple, list[tuple]] = {}
    for key, start, *arc in form_rows():
        arcs_of.setdefault((key, start), []).append(tuple(arc))
    numbers: dict[tuple, int] = {}
    nodes = [(key, start, numbers.setdefault(tuple(sorted(own)), len(numbers) + 1)) for (key, start), own in arcs_of.items()]
    return nodes, [(node, *arc) for own, node in numbers.items() for arc in own]


@cache
def tails() -> tuple[str, list[list[int]], dict[str, int], int]:
    """A deterministic automaton of the texts that suffixes can use up after a root: its letters, the next state
    of each state by letter (0 is the state of no return), the first state of each part of speech, and the
    number up to which states from 1 accept. It follows parts of speech, groups and narrowed vowels, but neither
    the stems' features nor suffixes that may come only once: it accepts whatever a search can use up, and more."""
    nodes, rows = automaton()
    starts: dict[int, set[str]] = {}
    for _, at, node in nodes:
        starts.setdefault(node, set()).add(at)
    steps: dict[str, set[tuple]] = {}
    for node, target, _, _, group, _, _, _, form in rows:
        for at in starts[node]:
            own = steps.setdefault(at, set())
            own.add((target, group, form, False))
            if form[-1] in "ae":
                own.add((target, group, form[:-1], True))
    letters, wanted = "".join(sorted({c for own in steps.values() for *_, text, _ in own for c in text})), ("", CLOSE, "y", "o", "r")

    @cache
    def entered(at: str, last: int | None, due: int) -> frozenset[tuple]:
        """Where a text may be between two suffixes and within the next: part of speech, group, what is left of the form,
        whether it is narrowed, and which letter of iyor, that has to follow a narrowed vowel, is ``due`` (0: none)."""
        out, todo = {(at, last, "", False, due)}, [(at, last, due)]
        while todo:
            at, last, due = todo.pop()
            for target, group, text, narrow in steps[at]:
                here = (target, group, text, narrow, due) if text else (target, group, "", False, due or 1)  # a lone vowel takes no letter
                if (last is None or may_follow(last, group)) and here not in out:
                    out.add(here)
                    if not text:
                        todo.append((target, group, due or 1))
        return frozenset(out)

    def moved(state: frozenset[tuple], c: str) -> frozenset[tuple]:
        out: set[tuple] = set()
        for at, group, text, narrow, due in state:
            if text[:1] == c and (not due or c in wanted[due]):
                due = (due + 1) % 5 if due else 0
                out |= {(at, group, text[1:], narrow, due)} if len(text) > 1 else entered(at, group, due or int(narrow))
        return frozenset(out)

    begun = {at: entered(at, None, 0) for at in steps}
    found, todo = {frozenset(): [frozenset()] * len(letters)}, list(begun.values())
    while todo:
        state = todo.pop()
        if state not in found:
            found[state] = [moved(state, c) for c in letters]
            todo += found[state]
    accepts = {state for state in found if any(not text and not due for *_, text, _, due in state)}
    order = [frozenset(), *(s for s in found if s in accepts), *(s for s in found if s and s not in accepts)]
    number = {state: k for k, state in enumerate(order)}
    return letters, [[number[t] for t in found[s]] for s in order], {at: number[s] for at, s in begun.items()}, len(accepts)


@cache
def form_lists() -> list[tuple]:
    """(stem key, name, forms): all forms of every suffix after every stem, in order, empty ones too."""
    return [(stem.key, name, forms(s, stem)) for stem in stems() for name, s in BY_NAME.items()]
