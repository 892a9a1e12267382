"""A dictionary as tables that words are joined to.

``flags`` has one row for each text that is a root: whether it may be a noun, a verb, and whether
its final l is soft. ``surfaces`` lists, for each surface stem that is no root but that an altered root
can show, the roots behind it. Both have the size of the dictionary and are computed from it once, so
looking a word up is an equi-join: broadcast while the table is counted to be small, shuffled beyond
that. ``profile`` has the lengths of roots and of surfaces by their first two letters: of a word, only
prefixes that some entry could be are made, so that a long word costs no more than its letters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.functions import phonology as ph
from kokek.functions.forms import StemRule, stem_key
from kokek.functions.suffixes import BY_NAME

#: Rows of a dictionary table (a short word and three flags each) up to which it is broadcast.
BROADCAST_WORDS = 1_000_000


def _flag_table(words: DataFrame) -> DataFrame:
    """word, noun, verb, soft. Verbs are listed as infinitives, ``ł`` writes a soft final l."""
    listed = words.select(F.trim("word").alias("word")).where("word <> ''").distinct()
    softened = listed.where("word LIKE '%ł'").select(F.expr(f"concat({ph.cut_last('word')}, 'l')").alias("word"))
    stems = listed.where("word LIKE '%mak' OR word LIKE '%mek'").select(F.expr("substr(word, 1, length(word) - 3)").alias("stem"), "word")
    soft = softened.select(F.col("word").alias("stem"), F.lit(True).alias("soft"))
    named = stems.join(soft, "stem", "left").withColumn("soft", F.coalesce("soft", F.lit(False)))
    verbs = named.where(f"{ph.infinitive('stem', 'soft')} = word AND stem NOT IN {ph.listed(ph.NEVER_VERBS)}").select(F.col("stem").alias("word"))
    kinds = {"noun": listed.unionByName(softened), "verb": verbs, "soft": softened}
    rows = [df.select("word", *(F.lit(k == name).alias(k) for k in kinds)) for name, df in kinds.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("word").agg(*(F.bool_or(k).alias(k) for k in kinds))


def _shown(roots: DataFrame) -> DataFrame:
    """surface: what the roots in ``word``, altered, can show, and those roots themselves."""
    tail = ph.last("word")
    voiced = roots.selectExpr(
        f"explode(concat(array(word), transform(split(CASE {tail} WHEN 'p' THEN 'b' WHEN 'ç' THEN 'c' WHEN 't' THEN 'd' WHEN 'k' THEN 'ğ,g' ELSE '' END, ','),"
        f" c -> concat({ph.cut_last('word')}, c)))) AS surface"
    ).where("surface <> ''")
    dropped = voiced.where(f"length(surface) > 2 AND substr(surface, -2, 1) IN {ph.listed('ıiuü')}").selectExpr(f"concat(substr(surface, 1, length(surface) - 2), {ph.last('surface')}) AS surface")
    shorter = roots.where(f"{tail} IN ('a', 'e')").selectExpr(f"{ph.cut_last('word')} AS surface")
    return voiced.unionByName(dropped).unionByName(shorter).where("surface <> ''").distinct()


def _candidates(surfaces: DataFrame) -> DataFrame:
    """surface, cand_ord, lemma: every text that a surface may stand for, be it a root or not."""
    made = ", ".join(f"CASE WHEN {ok} THEN named_struct('cand_ord', {k}, 'lemma', {lemma}) END" for k, (ok, lemma) in enumerate(ph.root_candidates("surface")))
    return surfaces.selectExpr("surface", f"explode(filter(array({made}), x -> x IS NOT NULL)) AS c").select("surface", "c.*")


def _led(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """The candidates that are roots, of surfaces that are none."""
    known = flags.where("noun OR verb")
    led = candidates.join(known.select(F.col("word").alias("surface")), "surface", "left_anti")
    return led.join(known.select(F.col("word").alias("lemma"), "noun", "verb"), "lemma").select("surface", "cand_ord", "lemma", "noun", "verb")


def _surface_table(flags: DataFrame) -> DataFrame:
    """surface, cand_ord, lemma, noun, verb: what a stem that is no root may stand for. The surfaces
    that can lead to a root are made from it; what each leads to follows the rules forwards."""
    return _led(_candidates(_shown(flags.where("(noun OR verb) AND length(word) > 0").select("word"))), flags)


def _profile_table(flags: DataFrame, surfaces: DataFrame) -> DataFrame:
    """kind (root or surface), head (the first two letters, or the only one), lengths."""
    texts = flags.where("(noun OR verb) AND word <> ''").selectExpr("'root' AS kind", "word AS text")
    texts = texts.unionByName(surfaces.selectExpr("'surface' AS kind", "surface AS text"))
    return texts.groupBy("kind", F.substring("text", 1, 2).alias("head")).agg(F.array_sort(F.collect_set(F.length("text"))).alias("lengths"))


#: The tables, what makes each of the words and the tables before it, and the columns that name its rows.
MADE: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = {
    "flags": lambda words, made: _flag_table(words),
    "surfaces": lambda words, made: _surface_table(made["flags"]),
    "profile": lambda words, made: _profile_table(made["flags"], made["surfaces"]),
}
KEYS = {"flags": ["word"], "surfaces": ["surface"], "profile": ["kind", "head"]}


def overlaid(table: DataFrame, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` in place of those of its rows that ``keys``, a small table, names."""
    return table.join(F.broadcast(keys), keys.columns, "left_anti").unionByName(rows)


def changes(left: DataFrame, gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What the tables of a dictionary become when the words in ``gone`` leave it and those in ``left``
    stay: for each table the keys whose rows may change, and those keys' new rows. Both are as small as
    ``gone``, and are broadcast: ``left`` and ``tables`` are read, but neither shuffled nor written.

    A word decides on itself, on the stem that it is the infinitive of and on the text that it writes with a
    soft l; each text on the surfaces that it can show; and both on the lengths under their first letters.
    """
    near = lambda table, keys: table.join(F.broadcast(keys), keys.columns, "left_semi")
    decided = f"filter(array(word, CASE WHEN word LIKE '%ł' THEN concat({ph.cut_last('word')}, 'l') END, CASE WHEN word LIKE '%mak' OR word LIKE '%mek' THEN substr(word, 1, length(word) - 3) END), x -> x IS NOT NULL)"
    texts = cut(gone.selectExpr(f"explode({decided}) AS word").distinct())
    asked = texts.selectExpr(f"explode(array(word, concat(word, 'mak'), concat(word, 'mek'), CASE WHEN word LIKE '%l' THEN concat({ph.cut_last('word')}, 'ł') ELSE word END)) AS word").distinct()
    flags = cut(near(_flag_table(near(left, asked)), texts))
    now = {"flags": overlaid(tables["flags"], texts, flags)}

    written = texts.where("word <> ''")
    shown = cut(_shown(written).unionByName(written.select(F.col("word").alias("surface"))).distinct())
    candidates = cut(_candidates(shown))
    met = shown.select(F.col("surface").alias("word")).unionByName(candidates.select(F.col("lemma").alias("word"))).distinct()
    surfaces = cut(_led(candidates, cut(near(now["flags"], met))))
    now["surfaces"] = overlaid(tables["surfaces"], shown, surfaces)

    head = lambda text: F.substring(text, 1, 2).alias("head")
    heads = written.select(F.lit("root").alias("kind"), head("word")).unionByName(shown.select(F.lit("surface").alias("kind"), head("surface")))
    heads = cut(heads.distinct())
    own = {"flags": "word", "surfaces": "surface"}
    under = [near(now[name].withColumn("head", head(text)), heads.select("head").distinct()).drop("head") for name, text in own.items()]
    return {"flags": (texts, flags), "surfaces": (shown, surfaces), "profile": (heads, near(_profile_table(*under), heads))}


def _free(rows: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Lexicon:
    """The tables of a dictionary given as words or as a DataFrame with a column ``word``; they are
    made when first asked for and kept as checkpoints for the running application.

    ``rules`` are form rules of the user's by suffix name, which see the stem itself: functions of its text
    and features that give its forms in order. Searches and rendering with this dictionary ask them, in
    Arrow batches over distinct stems, in place of the suffixes' own rules; so they have to be functions
    that can be sent to the executors.

    ``tables`` gives a table by its name where it is kept elsewhere; it is then not made here.
    """

    def __init__(self, words: Iterable[str] | DataFrame, rules: dict[str, StemRule] | None = None, tables: Callable[[str], DataFrame] | None = None):
        unknown = set(rules or {}) - set(BY_NAME)
        if unknown:
            raise KeyError(", ".join(sorted(unknown)))
        self.rules = dict(rules or {})
        #: By what name results under these rules can be kept.
        self.rules_name = f"stems-{uuid.uuid4().hex}" if rules else "closed"
        self._words = words if isinstance(words, DataFrame) else sorted({w.strip() for w in words if w.strip()})
        self._tables = tables
        self._held: dict[tuple[str, str], tuple[DataFrame, bool]] = {}

    def _table(self, name: str) -> tuple[DataFrame, bool]:
        """A table and whether it is small enough for a broadcast."""
        frame = isinstance(self._words, DataFrame)
        spark = self._words.sparkSession if frame else SparkSession.getActiveSession()
        key = spark.sparkContext.applicationId, name
        if key not in self._held:
            if self._tables is not None:
                made = self._tables(name)
            else:
                before = {k: self._table(k)[0] for k in list(MADE)[: list(MADE).index(name)]}
                made = cut(MADE[name](self._words if frame else spark.createDataFrame([(w,) for w in self._words], "word string"), before))
            self._held[key] = made, made.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
        return self._held[key]

    def flags(self) -> DataFrame:
        return self._table("flags")[0]

    def root_keys(self) -> DataFrame:
        """word, fkey of every root, marked for a broadcast while there are few."""
        flags, small = self._table("flags")
        key = flags.sparkSession.sparkContext.applicationId, "keys"
        if key not in self._held:
            self._held[key] = cut(self.keyed(flags.where("noun OR verb").select("word"), "word")), small
        return F.broadcast(self._held[key][0]) if small else self._held[key][0]

    def _side(self, name: str) -> DataFrame:
        table, small = self._table(name)
        return F.broadcast(table) if small else table

    def marked(self, rows: DataFrame, column: str, *kinds: str) -> DataFrame:
        """``rows`` with a boolean column for each kind (noun, verb, soft) of the text in ``column``."""
        side = self._side("flags").select(F.col("word").alias(column), *kinds)
        return rows.join(side, column, "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in kinds})

    def roots(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose text in ``column`` is a root, with noun and verb."""
        return rows.join(self._side("flags").where("noun OR verb").select(F.col("word").alias(column), "noun", "verb"), column)

    def altered(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose text in ``column`` is no root but shows altered ones, with cand_ord, lemma, noun and verb."""
        return rows.join(self._side("surfaces").withColumnRenamed("surface", column), column)

    def prefixes(self, rows: DataFrame, column: str, kind: str, name: str) -> DataFrame:
        """``rows`` with split and ``name``, the first split letters of the text in ``column``, for every
        length that an entry of this kind (root or surface) with the same first letters has."""
        head, lengths = _free(rows, "head", "lengths")
        side = self._side("profile").where(F.col("kind") == kind).select(F.col("head").alias(head), F.col("lengths").alias(lengths))
        heads = rows.withColumn(head, F.explode(F.expr(f"IF(length({column}) > 1, array(substr({column}, 1, 1), substr({column}, 1, 2)), array({column}))")))
        cuts = heads.join(side, head).select(*rows.columns, F.explode(F.expr(f"filter({lengths}, n -> n <= length({column}))")).alias("split"))
        return cuts.withColumn(name, F.expr(f"substr({column}, 1, split)"))

    def keyed(self, rows: DataFrame, column: str, name: str = "fkey") -> DataFrame:
        """``rows`` with the form key of the stem in ``column``: its last letters and dictionary flags."""
        side = self._side("flags")
        less, soft, verb, verb2 = _free(rows, "less", "soft", "verb", "verb2")
        first = side.select(F.col("word").alias(column), F.col("soft").alias(soft), F.col("verb").alias(verb))
        second = side.where("verb").select(F.col("word").alias(less), F.lit(True).alias(verb2))
        met = rows.withColumn(less, F.expr(f"substr({column}, 1, greatest(length({column}) - 2, 0))")).join(first, column, "left").join(second, less, "left")
        key = stem_key(column, f"coalesce({soft}, false)", f"coalesce({verb}, false)", f"coalesce({verb2}, false)")
        return met.withColumn(name, F.expr(key)).drop(less, soft, verb, verb2)
