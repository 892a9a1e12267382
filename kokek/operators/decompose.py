"""All root-and-suffix analyses of words.

The search runs level by level: a state is a stem, the text after it and the chain so far. The forms
are one minimised finite-state table: a stem's features and part of speech name its node, and one
level joins states to the arcs on (node, next letter), keeps arcs whose form the remaining text starts
with, and drops states another path has reached already. Complete states stay where they are through an
arc of no letters, so that a few levels run between two checkpoints: words are dealt once for each of them,
and levels group the states of a word without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.functions import phonology as ph
from kokek.functions.forms import StemRule, automaton, stem_of, tails, version
from kokek.functions.lexicon import Lexicon
from kokek.functions.suffixes import GROUPS, INTENSIFIER, may_follow
from kokek.functions.suffixes import arcs as arcs_in_order

NARROWED = "(iyor|ıyor|uyor|üyor)"
#: Levels before the first checkpoint, which most words end in, and between later ones.
LEVELS, MORE = 2, 4
_ARC = "node int, target string, suffix_id int, suffix string, grp int, only_once boolean, arc int, form_ord int, form string"
_tables: dict[str, tuple[DataFrame, DataFrame]] = {}


def form_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """fkey, at, node; and the arcs of each node with ``head``, the letter the remaining text must begin
    with: the form's own or, for a lone narrowed vowel, that of what follows it. Node 0 is a complete
    state's, its one arc has no form. Both tables are of fixed size."""
    key = f"{spark.sparkContext.applicationId}:{version()}"
    if key not in _tables:
        nodes, arcs = automaton()
        rows = spark.createDataFrame(arcs, _ARC)
        heads = "explode(IF(form IN ('a', 'e'), array(form, 'ı', 'i', 'u', 'ü'), array(substr(form, 1, 1)))) AS head"
        stay = spark.createDataFrame([(0, None, None, None, None, None, None, None, None, "")], f"{_ARC}, head string")
        _tables[key] = cut(spark.createDataFrame(nodes, "fkey string, at string, node int").coalesce(1)), cut(rows.selectExpr("*", heads).unionByName(stay).coalesce(1))
    return _tables[key]


def prefix_splits(words: DataFrame) -> DataFrame:
    """word, split, root, rest for every prefix of every non-empty word."""
    cuts = words.where("length(word) > 0").select("word", F.explode(F.expr("sequence(1, length(word))")).alias("split"))
    return cuts.selectExpr("word", "split", "substr(word, 1, split) AS root", "substr(word, split + 1) AS rest")


_KINDS = "filter(array(if(noun, 'noun', null), if(verb, 'verb', null)), x -> x is not null)"


def root_lookup(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Prefixes that are dictionary roots, once for each part of speech."""
    found = lexicon.roots(lexicon.prefixes(words.select("word"), "word", "root", "root"), "root")
    return found.select("word", "split", "root", F.expr("substr(word, split + 1)").alias("rest"), F.explode(F.expr(_KINDS)).alias("pos"))


def altered_roots(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Lemmas behind prefixes that are no roots themselves: word, split, surface, cand_ord, lemma,
    pos, virtual_word. A lemma reached twice is listed twice."""
    found = lexicon.altered(lexicon.prefixes(words.select("word"), "word", "surface", "surface"), "surface")
    whole = F.expr("concat(lemma, substr(word, split + 1))").alias("virtual_word")
    return found.select("word", "split", "surface", "cand_ord", "lemma", F.explode(F.expr(_KINDS)).alias("pos"), whole)


def intensified(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """word, prefix, root of reduplicated intensifiers: the longest dictionary root after a copied
    first syllable closed by p, s, r or m (and a or e, where that alone gives no root)."""
    # One test that few words pass stands before the places, which Spark works out anew wherever they are named.
    copied = f"word RLIKE '^([^{ph.VOWELS}]*[{ph.VOWELS}])[psrm][ae]?\\\\1'"
    rows = words.where("length(word) >= 4").where(copied).select("word", F.expr(ph.first_vowel("word")).alias("v"))
    rows = rows.where("v >= 0 AND v + 1 < length(word) AND substr(word, v + 2, 1) IN ('p', 's', 'r', 'm')")
    extended = "IF(substr(word, v + 3, 1) IN ('a', 'e') AND v + 3 < length(word), array(v + 2, v + 3), array(v + 2))"
    tails = rows.select("word", "v", F.expr(f"explode({extended})").alias("p")).selectExpr("word", "v", "p", "substr(word, p + 1) AS tail")
    tails = tails.where("length(tail) > 1 AND startswith(tail, substr(word, 1, v + 1))").select("word", "p", "tail")
    roots = lexicon.roots(lexicon.prefixes(tails, "tail", "root", "root").where("split > 1"), "root").where("noun")
    return roots.groupBy("word").agg(F.max_by(F.struct("p", "root"), F.struct(-F.col("p"), "split")).alias("best")).selectExpr("word", "substr(word, 1, best.p) AS prefix", "best.root AS root")


def starts(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each search: word, start (its place in the order of analyses), pos, root, rest,
    intensified."""
    words = words.select("word").distinct()
    plain = root_lookup(words, lexicon).selectExpr("word", "array(1, split, 0, if(pos = 'noun', 0, 1)) AS start", "pos", "root", "rest", "false AS intensified")
    other = altered_roots(words, lexicon).selectExpr("word", "array(1, split, cand_ord, if(pos = 'noun', 0, 1)) AS start", "pos", "lemma AS root", "substr(virtual_word, length(lemma) + 1) AS rest", "false AS intensified")
    twice = intensified(words, lexicon).selectExpr("word", "array(0, 0, 0, 0) AS start", "'noun' AS pos", "root", "substr(word, length(prefix) + length(root) + 1) AS rest", "true AS intensified")
    return plain.unionByName(other).unionByName(twice)


def _allowed() -> str:
    pairs = [a * 100 + b for a in GROUPS for b in GROUPS if may_follow(a, b)]
    return f"(last_group IS NULL OR last_group * 100 + grp IN ({', '.join(map(str, pairs))}))"


def _stepped(states: DataFrame, lexicon: Lexicon, first: bool = False) -> DataFrame:
    """Open states with one suffix more, by every path, and complete ones as they are. The stems of the ``first``
    level are roots of the dictionary, whose keys are worked out once for each."""
    nodes, arcs = (F.broadcast(t) for t in form_tables(states.sparkSession))
    names = states.columns
    if first:
        keys = lexicon.root_keys().withColumnRenamed("word", "stem")
        keyed = states.join(keys, "stem", "left").join(nodes, ["fkey", "at"], "left")
    else:
        keyed = lexicon.keyed(states, "stem").join(nodes, ["fkey", "at"], "left")
    open_ = keyed.select(*names, F.expr("IF(rest = '', 0, node)").alias("node"), F.substring("rest", 1, 1).alias("head"), "fkey")
    whole = "startswith(rest, form)"
    narrow = f"right(form, 1) IN ('a', 'e') AND startswith(rest, substr(form, 1, length(form) - 1)) AND substr(rest, length(form), 4) RLIKE '^{NARROWED}$'"
    fits = f"{_allowed()} AND NOT (only_once AND array_contains(chain, suffix)) AND length(form) <= length(rest) AND ({whole} OR ({narrow}))"
    if lexicon.rules:
        own = open_arcs(open_.where("rest <> ''").select("stem", "fkey", "at").distinct(), lexicon.rules)
        closed = open_.join(arcs.where(F.col("suffix").isNull() | ~F.col("suffix").isin(list(lexicon.rules))), ["node", "head"])
        columns = [*names, *own.columns[2:]]
        met = closed.select(*columns).unionByName(open_.where("rest <> ''").join(own, ["stem", "at"]).select(*columns))
    else:
        met = open_.join(arcs, ["node", "head"])
    met = met.where(f"form IS NULL OR ({fits})")
    new = {
        "rest": f"IF({whole}, substr(rest, length(form) + 1), substr(rest, length(form)))", "at": "target", "stem": "concat(stem, form)", "last_group": "grp",
        "path": "concat(path, array(arc, form_ord))", "chain": "concat(chain, array(suffix))", "makes": "concat(makes, array(target))", "forms": "concat(forms, array(form))",
    }
    return met.selectExpr(*(f"IF(form IS NULL, {n}, {new[n]}) AS {n}" if n in new else n for n in names))


def open_arcs(stems: DataFrame, rules: dict[str, StemRule]) -> DataFrame:
    """Arcs whose forms are the user's: stem, at, and the columns of an arc, for distinct (stem, fkey, at)."""
    own = [(start, target, s.id, s.name, s.group, s.unique, {"noun": 0, "verb": 1}[target] * 1000 + k) for start, target, k, s in arcs_in_order() if s.name in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stem, key, at in zip(*(c.to_pylist() for c in batch.columns)):
                made: dict[str, list[str]] = {}
                for start, *arc in own:
                    if start == at:
                        if arc[2] not in made:
                            made[arc[2]] = list(rules[arc[2]](stem, stem_of(key)))
                        rows += [(stem, at, *arc, k, form) for k, form in enumerate(made[arc[2]]) if form]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            names = ["stem", "at", "target", "suffix_id", "suffix", "grp", "only_once", "arc", "form_ord", "form"]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    return stems.mapInArrow(run, f"stem string, at string, {_ARC.split(', ', 1)[1]}")


def _usable() -> str:
    """Whether suffixes can use up ``rest`` at all, by the automaton of ``tails``: most texts after a root have none that
    do, and need no level. Texts that pass may still fail at a level."""
    letters, moves, begun, accepting = tails()
    flat = ",".join(str(t) for row in moves for t in (0, *row))  # the first is of all other letters
    first = " ".join(f"WHEN '{at}' THEN {k}" for at, k in begun.items())
    state = f"get(CAST(split('{flat}', ',') AS array<int>), s * {len(letters) + 1} + instr('{letters}', c))"
    return f"rest = '' OR aggregate(split(rest, ''), CASE pos {first} END, (s, c) -> IF(s = 0, 0, {state})) BETWEEN 1 AND {accepting}"


def _once(step: DataFrame) -> DataFrame:
    """The first path (in search order) to a stem length, part of speech and chain stands for all."""
    same = step.groupBy("word", "start", "at", F.length("stem").alias("n"), "chain").agg(F.min_by(F.struct(*step.columns), "path").alias("s"))
    return same.select("s.*")


def suffix_chains(begun: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Complete chains of the searches in ``begun`` (columns as of ``starts``, roots being the dictionary's): word, start, root, pos,
    intensified, path, chain, makes, final_pos, forms."""
    none = lambda kind: f"CAST(array() AS array<{kind}>)"
    begun = begun if lexicon.rules else begun.where(_usable())  # rules of the user's can make any form
    states = begun.selectExpr("*", "pos AS at", "root AS stem", "CAST(NULL AS int) AS last_group", f"{none('int')} AS path", f"{none('string')} AS chain", f"{none('string')} AS makes", f"{none('string')} AS forms")
    # Most searches end at their first letter after the root, so that is looked at before words are dealt.
    states = _once(_stepped(states, lexicon, first=True).repartition("word"))
    levels, most = 1, None
    while True:
        states = states if levels == 1 else states.repartition("word")  # a checkpoint does not know how it is dealt
        for _ in range(LEVELS - 1 if levels == 1 else MORE):
            states, levels = _once(_stepped(states, lexicon)), levels + 1
        states = cut(states)
        left = states.where("rest <> ''").agg(F.max(F.length("rest"))).first()[0]
        if left is None:
            break
        # A form takes a letter at least, but for a lone narrowed vowel, whose next form takes four.
        most = levels + 2 * left + 2 if most is None else most
        if levels > most:
            raise RuntimeError("states remain beyond the longest possible chain")
    return states.selectExpr("word", "start", "root", "pos", "intensified", "path", "chain", "makes", "at AS final_pos", "forms")


def decompose(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """word, cand_ord, root, pos, chain, makes, forms, final_pos of every analysis, a bag in search
    order: intensifiers, then shorter roots, nouns before verbs, targets and suffixes in order."""
    found = suffix_chains(starts(words, lexicon), lexicon)
    full = found.selectExpr(
        "word", "start", "path", "root", "pos", f"IF(intensified, concat(array('{INTENSIFIER}'), chain), chain) AS chain",
        "IF(intensified, concat(array('noun'), makes), makes) AS makes", "IF(intensified, concat(array(''), forms), forms) AS forms", "final_pos",
    )
    listed = full.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "path", "root", "pos", "chain", "makes", "forms", "final_pos"))).alias("all"))
    return listed.select("word", F.posexplode("all").alias("cand_ord", "a")).selectExpr("word", "cand_ord", "a.root", "a.pos", "a.chain", "a.makes", "a.forms", "a.final_pos")


def decompose_distinct(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The analyses without repeats, renumbered."""
    once = decompose(words, lexicon).groupBy("word", "root", "pos", "chain", "final_pos").agg(F.min("cand_ord").alias("first"), F.min_by("makes", "cand_ord").alias("makes"), F.min_by("forms", "cand_ord").alias("forms"))
    listed = once.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("first", "root", "pos", "chain", "makes", "forms", "final_pos"))).alias("all"))
    return listed.select("word", F.posexplode("all").alias("cand_ord", "a")).selectExpr("word", "cand_ord", "a.root", "a.pos", "a.chain", "a.makes", "a.forms", "a.final_pos")
