"""Suffixes, their order, and which may follow which."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Suffix:
    id: int
    name: str
    list: str
    base: str
    comes_to: str
    makes: str
    group: int
    major: bool
    minor: bool
    buffer: bool
    unique: bool
    rule: str


# Name, list, base (- for none), what it comes to and makes, group, major harmony,
# minor harmony, y buffer, at most once in a word, form rule. Identifiers are places in the list.
_TABLE = """
approximative_imtrak n2n imtrak noun noun 15 N N - - default
temporative_leyin n2n leyin noun noun 15 Y Y - - default
adverbial_in n2n in noun noun 15 Y Y - - default
adverbial_cesine n2n cesine noun noun 15 Y N - - default
approximative_si n2n si noun noun 15 Y Y - - approximative_si
counting_er n2n er noun noun 10 Y N - - counting_er
cooperative_daş n2n daş noun noun 10 Y N - - default
relative_ce n2n ce noun noun 10 Y N - - default
relative_sel n2n sel noun noun 10 Y N - - default
dimunitive_cik n2n cik noun noun 10 Y Y - - dimunitive_cik
actor_ci n2n ci noun noun 10 Y Y - - default
ordinal_inci n2n inci noun noun 10 Y Y - - default
privative_siz n2n siz noun noun 10 Y Y - - default
philicative_cil n2n cil noun noun 10 Y Y - - default
composessive_li n2n li noun noun 10 Y Y - - default
suitative_lik n2n lik noun noun 10 Y Y - - default
abstractifier_iyat n2n iyat noun noun 10 N N - - abstractifier_iyat
ideologicative_izm n2n izm noun noun 10 N N - - default
scientist_olog n2n olog noun noun 10 N N - - default
familative_gil n2n gil noun noun 10 N N - - default
plural_ler n2n ler noun noun 10 Y N - - default
posessive_1sg n2n im noun noun 30 Y Y - - default
posessive_2sg n2n in noun noun 30 Y Y - - default
posessive_3sg n2n i noun noun 30 Y Y - - posessive_3sg
posessive_1pl n2n imiz noun noun 30 Y Y - - default
posessive_2pl n2n iniz noun noun 30 Y Y - - default
posessive_3pl n2n leri noun noun 30 Y Y - - default
noun_compound n2n in noun noun 35 Y Y - - noun_compound_suffix
accusative n2n i noun noun 40 Y Y Y - accusative
locative_den n2n den noun noun 40 Y N - - locative_den
dative_e n2n e noun noun 40 Y N Y - default
ablative_de n2n de noun noun 40 Y N - - ablative_de
confactuous_le n2n le noun noun 40 Y N - - confactuous_le
marking_ki n2n ki noun noun 45 Y Y - - marking_ki
when_ken n2n ken noun noun 45 N N - - when_ken
nounaorist_dir n2n dir noun noun 50 Y Y - - default
pasttense_noundi n2n di both noun 50 Y Y - - pasttense_noundi
if_suffix n2n se noun noun 50 Y N - - if_suffix
copula_mis n2n miş noun noun 50 Y Y - - copula_mis
conjugation_1sg n2n im both noun 60 Y Y - Y conjugation_1sg
conjugation_2sg n2n sin both noun 60 Y Y - Y conjugation_2sg
conjugation_3sg n2n - both noun 60 Y Y - Y conjugation_3sg
conjugation_1pl n2n iz both noun 60 Y Y - Y conjugation_1pl
conjugation_2pl n2n siniz both noun 60 Y Y - Y conjugation_2pl
conjugation_3pl n2n ler both noun 60 Y Y - Y conjugation_3pl
absentative_se n2v se noun verb 10 Y N - - default
onomatopea_de n2v de noun verb 10 Y N - - default
verbifier_e n2v e noun verb 10 Y N - - verbifier_e
aplicative_le n2v le noun verb 10 Y N - - default
infinitive_me v2n me verb noun 10 Y N - - default
infinitive_mek v2n mek verb noun 10 Y N - - default
factative_en v2n en verb noun 10 Y N Y - default
toolative_ek v2n ek verb noun 10 Y N - - toolative_ek
constofactative_gen v2n gen verb noun 10 Y N - - default
constofactative_gin v2n gin verb noun 10 Y Y - - default
nounifier_iş v2n iş verb noun 10 Y Y Y - nounifier_iş
perfectative_ik v2n ik verb noun 10 Y Y Y - perfectative_ik
nounifier_i v2n i verb noun 10 Y Y Y - nounifier_i
nounifier_gi v2n gi verb noun 10 Y Y - - default
nounifier_ge v2n ge verb noun 10 Y N - - default
nounifier_im v2n im verb noun 10 Y Y - - default
nounifier_in v2n in verb noun 10 Y Y - - default
nounifier_it v2n it verb noun 10 Y Y - - default
nounifier_inç v2n inç verb noun 10 Y Y - - default
nounifier_inti v2n inti verb noun 10 Y Y - - nounifier_inti
toolifier_geç v2n geç verb noun 10 Y Y - - toolifier_geç
nounifier_anak v2n anak verb noun 10 Y N - - default
nounifier_amak v2n amak verb noun 10 Y N - - default
nounifier_ce v2n ce verb noun 10 Y N - - default
subjectifier_men v2n men verb noun 10 Y N - - default
subjectifier_giç v2n giç verb noun 10 Y Y - - default
adjectifier_dik v2n dik verb noun 10 Y Y - - default
nounifier_ecek v2n ecek verb noun 10 Y N Y - nounifier_ecek
neverfactative_mez v2n mez verb noun 10 Y N - - default
factative_ir v2n ir verb noun 10 Y Y - - factative_ir
pastfactative_miş v2n miş verb noun 10 Y Y - - default
undoing_meden v2n meden verb noun 10 Y N - - default
wish_suffix v2n se noun noun 50 Y N - Y default
continuous_iyor v2n iyor verb noun 10 Y Y - - continuous_iyor
adverbial_erek v2n erek verb noun 10 Y N - - adverbial_erek
adverbial_ip v2n ip verb noun 15 Y Y - - default
adverbial_e v2n e verb noun 15 Y N Y - default
adverbial_esi v2n esi verb noun 10 Y N Y - default
adverbial_ince v2n ince verb noun 10 Y Y - - default
reflexive_is v2v iş verb verb 5 Y Y - - default
reflexive_ik v2v ik both verb 5 Y Y - - default
active_it v2v it verb verb 5 Y Y - - active_it
active_dir v2v dir verb verb 5 Y Y - - default
active_ir v2v ir verb verb 5 Y Y - - active_ir
passive_il v2v il verb verb 5 Y Y - - passive_il
reflexive_in v2v in verb verb 5 Y Y - - default
randomative_ele v2v ele verb verb 5 Y Y - - default
possibilitative_ebil v2v ebil verb verb 8 N N - Y default
negative_me v2v me verb verb 7 Y N - Y default
negative_consto v2v eme verb verb 7 Y N - Y default
"""

SUFFIXES = [
    Suffix(k, name, kind, "" if base == "-" else base, to, makes, int(group), major == "Y", minor == "Y", buffer == "Y", unique == "Y", rule)
    for k, (name, kind, base, to, makes, group, major, minor, buffer, unique, rule) in enumerate(map(str.split, _TABLE.strip().splitlines()), 1)
]
BY_NAME = {s.name: s for s in SUFFIXES}

# The levels of the suffix hierarchy.
GROUPS = (5, 7, 8, 10, 15, 30, 35, 40, 45, 50, 60)
VERBAL, COMPOUNDING, DERIVING, LOCKED, POSSESSIVE, COMPOUND, AFTER_CASE, PREDICATE, PERSON = 5, 8, 10, 15, 30, 35, 45, 50, 60
INTENSIFIER = "pekistirme"


def may_follow(last: int, following: int) -> bool:
    """Whether a suffix of group ``following`` may come right after one of group ``last``."""
    if last in (AFTER_CASE, DERIVING, COMPOUNDING) and following <= last:
        return True  # these levels may start over
    if last == COMPOUND or following == COMPOUND:
        return following == AFTER_CASE if last == COMPOUND else last in (DERIVING, AFTER_CASE, POSSESSIVE)
    if last == LOCKED:
        return following >= PREDICATE
    if last == PREDICATE:
        return following == PERSON
    return following > last or following == last == VERBAL


def arcs() -> list[tuple[str, str, int, Suffix]]:
    """(start part of speech, target, order, suffix); suffixes for both stand after a list's own."""
    own = {("noun", "noun"): "n2n", ("noun", "verb"): "n2v", ("verb", "noun"): "v2n", ("verb", "verb"): "v2v"}
    other = {"noun": "verb", "verb": "noun"}
    out = []
    for (start, target), kind in own.items():
        also = own[other[start], target]
        row = [s for s in SUFFIXES if s.list == kind] + [s for s in SUFFIXES if s.list == also and s.comes_to == "both"]
        out += [(start, target, k, s) for k, s in enumerate(row)]
    return out
