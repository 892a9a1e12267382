"""Analyses as text, and whole texts annotated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.functions.forms import StemRule, form_lists, stem_of, version
from kokek.functions.lexicon import BROADCAST_WORDS, Lexicon
from kokek.functions.suffixes import INTENSIFIER
from kokek.operators import decompose as search
from kokek.operators import rank
from kokek.sources.text import files_in, fresh, read_tokens, tokenize, tokens_of, write_ordered


def format_analysis(root: Column, chain: Column) -> Column:
    """root+name+name"""
    return F.concat_ws("+", F.concat(F.array(root), chain))


_tables: dict[str, DataFrame] = {}


def list_table(spark: SparkSession) -> DataFrame:
    """fkey, suffix, opts: all forms of each suffix after each kind of stem (a table of fixed size)."""
    key = f"{spark.sparkContext.applicationId}:{version()}"
    if key not in _tables:
        _tables[key] = cut(spark.createDataFrame(form_lists(), "fkey string, suffix string, opts array<string>"))
    return _tables[key]


def _offered(rows: DataFrame, lexicon: Lexicon, k: int) -> DataFrame:
    """Adds ``suffix``, the ``k``-th of the chain, and ``opts``, all its forms after ``stem``."""
    met = lexicon.keyed(rows, "stem").withColumn("suffix", F.expr(f"get(chain, {k})")).join(F.broadcast(list_table(rows.sparkSession)), ["fkey", "suffix"], "left")
    if lexicon.rules:
        own = open_forms(met.where(F.col("suffix").isin(list(lexicon.rules))).select("stem", "fkey", "suffix").distinct(), lexicon.rules)
        met = met.join(own, ["stem", "suffix"], "left").withColumn("opts", F.coalesce("own", "opts")).drop("own")
    return met.withColumn("opts", F.expr(f"CASE WHEN suffix = '{INTENSIFIER}' THEN array(suffix) ELSE coalesce(opts, CAST(array() AS array<string>)) END"))


def open_forms(stems: DataFrame, rules: dict[str, StemRule]) -> DataFrame:
    """stem, suffix, own: what the user's rules give for distinct (stem, fkey, suffix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [list(rules[suffix](stem, stem_of(key))) for stem, key, suffix in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.string()))], ["stem", "suffix", "own"])

    return stems.mapInArrow(run, "stem string, suffix string, own array<string>")


def _longest(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("chain"))).first()[0] or 0


def gold_rows(analyses: DataFrame, lexicon: Lexicon) -> DataFrame:
    """word, cand_ord, root, suffixes (name, form, makes), final_pos: confirmed analyses as they are
    logged. A form is the suffix's first one after the stem so far, whatever the word shows; it
    is empty where the suffix has none."""
    rows = cut(analyses.selectExpr("word", "cand_ord", "root", "chain", "makes", "final_pos", "root AS stem", "CAST(array() AS array<string>) AS made"))
    for k in range(_longest(rows)):
        met = _offered(rows, lexicon, k).withColumn("form", F.expr("coalesce(get(opts, 0), '')"))
        rows = met.selectExpr("word", "cand_ord", "root", "chain", "makes", "final_pos", "concat(stem, form) AS stem", f"IF(size(chain) > {k}, array_append(made, form), made) AS made")
    suffixes = "transform(chain, (c, i) -> named_struct('name', c, 'form', made[i], 'makes', upper(makes[i]))) AS suffixes"
    return rows.selectExpr("word", "cand_ord", "root", suffixes, "final_pos")


def _step(k: int) -> dict[str, str]:
    """How the ``k``-th suffix of a chain is found in the word: its first form at the cursor; before a
    later -iyor, one without its last a or e; one that starts a letter earlier; else a guess."""
    rest = "substr(word, cursor + 1)"
    here = lambda form: f"cursor <= length(word) AND startswith({rest}, {form})"
    short = "substr(f, 1, length(f) - 1)"
    narrowed = f"transform(filter(opts, f -> right(f, 1) IN ('a', 'e') AND {here(short)}), f -> {short})"
    return {
        "exact": f"get(filter(opts, f -> {here('f')}), 0)",
        "narrowed": f"IF(exists(slice(chain, {k + 2}, size(chain)), s -> contains(s, 'iyor')), get({narrowed}, 0), NULL)",
        "earlier": "get(filter(opts, f -> f <> '' AND startswith(substr(word, cursor), f)), 0)",
        "guess": "get(opts, 0)",
    }


def segments(analyses: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The surface pieces of each analysis: word, cand_ord, root_str, final_pos, has_chain,
    suffixes_str, names_str, formation_str.

    Forms are found anew along the written word, which may differ from the searched one where the
    root is altered. A form of no letters shows as (ø), a guessed one with a question mark, and
    a suffix without any form not at all. Without a chain the pieces are empty.
    """
    at = "instr(word, root)"
    rows = analyses.withColumn("twice", F.expr(f"size(chain) > 0 AND chain[0] = '{INTENSIFIER}' AND {at} > 1")).selectExpr(
        "word", "cand_ord", "root", "pos", "final_pos", "chain", "IF(twice, 1, 0) AS begin",
        f"length(root) + IF(twice, {at} - 1, 0) AS cursor", f"IF(twice, concat(substr(word, 1, {at} - 1), root), root) AS stem",
        f"IF(twice, array(substr(word, 1, {at} - 1)), CAST(array() AS array<string>)) AS shown", "IF(twice, array(chain[0]), CAST(array() AS array<string>)) AS names",
        "concat(root, IF(pos = 'verb', '-', '')) AS bare", f"IF(twice, array(concat(substr(word, 1, {at} - 1), root)), CAST(array() AS array<string>)) AS made",
    )
    rows = cut(rows)
    carried = [c for c in rows.columns if c not in ("cursor", "stem", "shown", "names", "made")]
    for k in range(_longest(rows)):
        met = _offered(rows, lexicon, k)
        if k == 0:  # an altered root may be written with up to two letters less
            fits = "i -> length(root) > i AND exists(opts, f -> startswith(substr(word, length(root) - i + 1), f))"
            met = met.withColumn("cursor", F.expr(f"IF(begin > 0 OR startswith(word, root), cursor, length(root) - coalesce(get(filter(array(0, 1, 2), {fits}), 0), 0))"))
        met = met.withColumns({name: F.expr(e) for name, e in _step(k).items()})
        met = met.withColumn("found", F.expr("coalesce(exact, narrowed, earlier)")).withColumn("taken", F.expr("coalesce(found, guess)"))
        on = f"size(chain) > {k} AND begin <= {k}"
        rows = met.selectExpr(
            *carried,
            f"IF({on}, cursor - IF(exact IS NULL AND narrowed IS NULL AND earlier IS NOT NULL, 1, 0) + length(coalesce(taken, '')), cursor) AS cursor",
            f"IF({on}, concat(stem, coalesce(taken, '')), stem) AS stem",
            f"IF({on} AND taken IS NOT NULL, array_append(shown, CASE WHEN found IS NULL THEN concat(guess, '?') WHEN found = '' THEN '(ø)' ELSE found END), shown) AS shown",
            f"IF({on} AND taken IS NOT NULL, array_append(names, suffix), names) AS names",
            f"IF({on} AND found IS NOT NULL, array_append(made, concat(stem, found)), made) AS made",
        )
    return rows.selectExpr(
        "word", "cand_ord", "concat(root, ' (', pos, ')') AS root_str", "final_pos", "size(chain) > 0 AS has_chain", "array_join(shown, ' + ') AS suffixes_str",
        "array_join(names, ' + ') AS names_str", "IF(size(chain) > 0, array_join(concat(array(bare), made), ' → '), concat(bare, ' (no suffixes)')) AS formation_str",
    )


def parse_choices(line: Column, most: int | Column) -> Column:
    """Chosen numbers in order, once each; null if any part is no number from 1 to ``most``."""
    parts = F.filter(F.split(F.translate(line, ",-/", "   "), r"\s+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("int"))
    bad = F.exists(numbers, lambda x: x.isNull() | (x < 1) | (x > most))
    return F.when((F.size(parts) > 0) & ~bad, F.array_distinct(numbers))


def option_view(scored: DataFrame) -> DataFrame:
    return rank.rank_candidates(scored).select("word", "cand_ord", F.format_string("%d. %.4f", F.col("shown"), F.col("score")).alias("line"))


#: Weights of the linear ranker, or a function that scores candidates (word, cand_ord, score).
Scorer = DataFrame | Callable[[DataFrame], DataFrame] | None


def best_analyses(words: DataFrame, lexicon: Lexicon, weights: Scorer = None) -> DataFrame:
    """word, n, analysis: one analysis for each word that has any; only ambiguous words are ranked."""
    found = cut(search.decompose(words, lexicon))
    text = format_analysis(F.col("root"), F.col("chain")).alias("analysis")
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:  # all scores tie, so the first candidate wins
        return counts.join(found.where("cand_ord = 0").select("word", text), "word")
    many = found.join(counts.where("n > 1").select("word"), "word", "left_semi")
    best = rank.best_per_word(weights(many) if callable(weights) else rank.score(many, weights)).select("word", "cand_ord")
    single = counts.where("n = 1").select("word", F.lit(0).alias("cand_ord"))
    return counts.join(found.join(best.unionByName(single), ["word", "cand_ord"]).select("word", text), "word")


class Known:
    """Best analyses of words that have been searched before, kept in a folder shared by all executors.

    ``version`` names what they depend on (dictionary, ranker, form rules); another version has a folder of
    its own. Words without analysis are kept too. Every search adds files and changes none, so a reader
    never loses what it began with; a word that two searches added at once counts once.
    """

    SCHEMA = "word string, analysis string"

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.path = spark, f"{folder}/{version}"

    def table(self) -> DataFrame:
        found = files_in(self.spark, self.path)
        return self.spark.read.schema(self.SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], self.SCHEMA)

    def best(self, words: DataFrame, search_new: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """word, analysis of the ``words`` that have one; ``search_new`` (word, analysis) is asked for words
        that are not kept yet, and not at all if there are none."""
        words = cut(words.select("word").distinct())
        new = cut(words.join(self.table(), "word", "left_anti"))
        if not new.isEmpty():
            found = search_new(new).select("word", "analysis")
            new.join(found, "word", "left").select("word", "analysis").write.parquet(f"{self.path}/{fresh('words')}")
        return self.table().join(words, "word", "left_semi").dropDuplicates(["word"]).where("analysis IS NOT NULL")


#: A token with at least one of so many places is frequent: there are at most as many such tokens.
FREQUENT = 1000


def _dealt(tokens: DataFrame, best: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens with ``hot`` (the analysis of a frequent one) and ``key``, by which the others are joined, and
    the analyses of the others. A frequent token takes its analysis from a broadcast of at most FREQUENT
    rows, and a key of its own at every place, so that no task gets all of its places."""
    least = counts.agg(F.coalesce(F.sum("n"), F.lit(0)) / FREQUENT).first()[0]
    often = cut(counts.where(F.col("n") >= least).select("token").join(best, "token", "left").select(F.col("token").alias("named"), F.col("analysis").alias("hot"), F.lit(True).alias("often")))
    met = tokens.join(F.broadcast(often), F.col("token") == F.col("named"), "left")
    key = F.when(F.col("often"), F.concat(F.lit("\0"), F.xxhash64(*tokens.columns).cast("string"))).otherwise(F.col("token"))
    return met.select(*tokens.columns, "hot", key.alias("key")), best.select(F.col("token").alias("key"), "analysis")


def lines_of(tokens: DataFrame, lexicon: Lexicon, weights: Scorer = None, known: Known | None = None) -> DataFrame:
    """The rows of ``tokens`` with ``line``, the best analysis of the token or itself. Each distinct token is
    analysed once, and one that is ``known`` not again."""
    counts = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    met = _analysed(counts.select(F.col("token").alias("word")), lexicon, weights, known)
    # Only tokens that have an analysis are joined; few of a text's words, and broadcast while few.
    if met.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        return tokens.join(F.broadcast(met), "token", "left").withColumn("line", F.coalesce("analysis", "token")).select(*tokens.columns, "line")
    return _joined(tokens, met, counts)


def _analysed(words: DataFrame, lexicon: Lexicon, weights: Scorer, known: Known | None) -> DataFrame:
    """token, analysis of the ``words`` that have any."""
    best = known.best(words, lambda new: best_analyses(new, lexicon, weights)) if known else best_analyses(words, lexicon, weights)
    return cut(best.select(F.col("word").alias("token"), "analysis"))


def _joined(tokens: DataFrame, met: DataFrame, counts: DataFrame) -> DataFrame:
    dealt, rest = _dealt(tokens, met, counts)
    return dealt.join(rest, "key", "left").select(*tokens.columns, F.coalesce("hot", "analysis", "token").alias("line"))


#: Documents in one Arrow batch.
ARROW_DOCS = 512


def _written(docs: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, value of every document, from a broadcast of the few analyses: no text is shuffled."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_DOCS))
    held = met.toArrow().combine_chunks()  # BROADCAST_WORDS at most
    shared = spark.sparkContext.broadcast([pa.concat_arrays(held.column(name).chunks or [pa.array([], pa.string())]) for name in ("token", "analysis")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, analyses = shared.value
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten()
            lines = pc.coalesce(analyses.take(pc.index_in(tokens, words)), tokens)
            ends = pc.cumulative_sum(pc.list_value_length(lists))
            at = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(pa.ListArray.from_arrays(at, lines), "\n")], ["doc_id", "value"])

    rows = docs.select("doc_id", F.coalesce(tokens_of(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, value string")


def annotate(docs: DataFrame, lexicon: Lexicon, weights: Scorer = None, known: Known | None = None, words: DataFrame | None = None) -> DataFrame:
    """doc_id, value: every token by its best analysis (or itself), newline-joined in token order; a document
    without tokens has an empty value. ``words`` are the documents' distinct tokens, and perhaps others, where
    they are at hand."""
    if words is None:
        words = cut(docs.select(F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("word")).distinct())
    met = _analysed(words, lexicon, weights, known)
    if met.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        return _written(docs, met)
    tokens = tokenize(docs)
    lines = _joined(tokens, met, cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("value"))
    bare = docs.where(F.coalesce(F.size(tokens_of(F.col("text"))), F.lit(0)) <= 0).select("doc_id", F.lit("").alias("value"))
    return texts.unionByName(bare)


def annotate_file(spark: SparkSession, path: str, out: str, lexicon: Lexicon, weights: Scorer = None, known: Known | None = None) -> None:
    """Writes the tokens of a text file of any size by their best analyses, one a line, in order."""
    lines = lines_of(read_tokens(spark, path), lexicon, weights, known)
    write_ordered(lines.select("pos", F.col("line").alias("value")), out)
