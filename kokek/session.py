"""A working session: a dictionary, confirmed analyses and a ranker kept in one folder.

Every mode takes and gives DataFrames. The dictionary is kept as numbered outputs that are never
overwritten (``kokek.sources.dictionary``), so that running queries and lost tasks can read what they began
with. So is the ranker: weights, the optimiser's moments, how far training has come, the loss and the counter of examples are one
output of one job, which counts once it is complete, so that no failure leaves them apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kokek.checkpoints import cut
from kokek.functions import phonology as ph
from kokek.functions.forms import StemRule
from kokek.functions.forms import rules as rules_in_force
from kokek.functions.lexicon import Lexicon
from kokek.operators import decompose as search
from kokek.operators import neural, rank, render
from kokek.sources import text as source
from kokek.sources.dictionary import Dictionary
from kokek.streaming.annotate import annotate_stream

#: Passes of ``relearn`` over all logged words, and chunks of words between two steps of the neural ranker.
EPOCHS, ROUND = 5, 64
_ROWS = "name string, shape array<int>, data binary, number double"


def gold_match(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """gold_ord, word, cand_ord: each gold row (gold_ord, word, root, names) with the first candidate of
    the same root and suffix names that no earlier one has taken."""
    keys = ["word", "root", "names"]

    def numbered(df: DataFrame, by: str) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))

    known = candidates.select("word", "root", F.col("chain").alias("names"), "cand_ord")
    return numbered(gold, "gold_ord").join(numbered(known, "cand_ord"), [*keys, "k"]).select("gold_ord", "word", "cand_ord")


def pruned(words: DataFrame, gone: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The dictionary words that go with the words in ``gone``: those it has, and their infinitives."""
    there = gone.select("word").join(words, "word", "left_semi").distinct()
    also = lexicon.marked(there, "word", "soft").selectExpr(f"{ph.infinitive('word', 'soft')} AS word")
    return words.select("word").join(there.unionByName(also), "word", "left_semi")


class Session:
    """State under ``folder`` (shared by all executors): lexicon/, tables/, log/, gold/, known/, and linear/ or neural/."""

    def __init__(self, spark: SparkSession, folder: str, words: DataFrame | None = None, ranker: str = "linear", shape: neural.Shape = neural.Shape(), rules: dict[str, StemRule] | None = None):
        """Opens a folder; ``words`` (column word) becomes the first dictionary of a new one. Every mode uses
        the ranker named, ``linear`` or ``neural``; the two keep their snapshots apart. ``rules`` are form
        rules of the user's, as ``Lexicon`` takes them."""
        if ranker not in ("linear", "neural"):
            raise ValueError(f"no such ranker: {ranker}")
        self.spark, self.folder, self.ranker, self.shape, self.rules = spark, folder, ranker, shape, rules
        self.dictionary = Dictionary(spark, folder)
        if words is not None:
            self.dictionary.create(words)
        self.reload()

    def _last(self, part: str) -> int:
        """The number of the newest complete snapshot, -1 without one."""
        return source.last_output(self.spark, f"{self.folder}/{part}")

    def words(self) -> DataFrame:
        return self.dictionary.words()

    def reload(self) -> None:
        """Reads the newest dictionary."""
        self.lexicon = self.dictionary.lexicon(self.rules)

    def _snapshot(self) -> DataFrame | None:
        """The newest snapshot of the ranker: part, name, shape, data, number."""
        k = self._last(self.ranker)
        return None if k < 0 else self.spark.read.schema(f"{_ROWS}, part string").parquet(f"{self.folder}/{self.ranker}/{k}")

    def _save(self, rows: DataFrame, **numbers: float | None) -> None:
        """Writes a snapshot of the ranker's ``rows`` and the session's own ``numbers``."""
        k = self._last(self.ranker) + 1
        own = self.spark.createDataFrame([("session", name, [k], None, float(x)) for name, x in numbers.items() if x is not None], f"part string, {_ROWS}")
        # What a failed run has left under this number is not complete, and is replaced.
        rows.unionByName(own).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{self.ranker}/{k}")

    def _number(self, name: str) -> float | None:
        rows = self._snapshot()
        row = rows.where(F.col("part").eqNullSafe("session") & (F.col("name") == name)).first() if rows is not None else None
        return row.number if row else None

    def weights(self) -> DataFrame | None:
        """feature, weight of the linear ranker, None before any training."""
        rows = self._snapshot() if self.ranker == "linear" else None
        return None if rows is None else rows.where("part = 'feature'").select(F.col("name").alias("feature"), F.col("number").alias("weight"))

    def state(self) -> neural.State | None:
        """The neural ranker's state, None before any training."""
        rows = self._snapshot() if self.ranker == "neural" else None
        return None if rows is None else neural.state_of(rows)

    def scorer(self) -> Callable[[DataFrame], DataFrame] | None:
        """A function that scores candidates (word, cand_ord, score), None before any training."""
        if self.ranker == "neural":
            state = self.state()
            return None if state is None else lambda found: neural.score(found, state.weights, self.shape)
        weights = self.weights()
        return None if weights is None else lambda found: rank.score(found, weights)

    def known(self) -> render.Known:
        """Best analyses kept for the present dictionary, ranker and form rules."""
        version = f"lexicon-{self.dictionary.version()}-{self.ranker}-{self._last(self.ranker)}-{rules_in_force()}-{self.lexicon.rules_name}"
        return render.Known(self.spark, f"{self.folder}/known", version)

    def gold(self) -> DataFrame:
        return source.read_gold(self.spark, f"{self.folder}/gold")

    def analyze(self, words: DataFrame) -> DataFrame:
        """Every analysis with its score (null before any training)."""
        found = search.cut(search.decompose(words, self.lexicon))
        scorer = self.scorer()
        if scorer is None:
            return found.withColumn("score", F.lit(None).cast("double"))
        return found.join(scorer(found), ["word", "cand_ord"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

    def evaluate(self, words: DataFrame) -> DataFrame:
        """word, analysis, score, and the surface pieces of each word's best analysis."""
        scored = self.analyze(words).withColumn("score", F.coalesce("score", F.lit(0.0)))
        best = rank.best_per_word(scored).select("word", "cand_ord")
        shown = render.segments(scored, self.lexicon).drop("final_pos", "has_chain")
        chosen = scored.join(best, ["word", "cand_ord"]).select("word", "cand_ord", render.format_analysis(F.col("root"), F.col("chain")).alias("analysis"), "score")
        return chosen.join(shown, ["word", "cand_ord"])

    def _loss(self, scored: DataFrame, labels: DataFrame) -> float:
        """The loss over the words that have labels."""
        right = labels.select("word", "cand_ord", F.lit(1).alias("label")).distinct()
        own = scored.join(labels.select("word").distinct(), "word", "left_semi").join(right, ["word", "cand_ord"], "left")
        return rank.listwise_loss(own.withColumn("label", F.coalesce("label", F.lit(0)))).first().loss

    def _learn(self, found: DataFrame, labels: DataFrame, steps: int, epochs: int, more: int) -> None:
        """Trains on ``labels`` and saves a snapshot in which the counter is ``more`` higher. The neural ranker
        saves after every round too: the same training, asked for again after it was stopped, goes on from
        there. Those snapshots go once the last one is complete."""
        count = self.count() + more
        if self.ranker == "linear":
            weights = cut(rank.fit(found, labels, steps * epochs, begun=self.weights()))
            rows = weights.select(F.lit("feature").alias("part"), F.col("feature").alias("name"), F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("binary").alias("data"), F.col("weight").alias("number"))
            self._save(rows, count=count, loss=self._loss(rank.score(found, weights), labels))
            return
        task = labels.agg(F.coalesce(F.bit_xor(F.xxhash64("word", "cand_ord")), F.lit(0))).first()[0] * 31 + steps * 7 + epochs
        state, since, task = self.state(), self._last(self.ranker) + 1, task % (1 << 52)  # which a double holds
        if state is not None and self._number("task") == task:
            since = int(self._number("since"))
        elif state is not None:
            state.epoch = state.round = 0

        def save(now: neural.State) -> None:
            self._save(neural.state_rows(self.spark, now), count=count - more, task=task, since=since)

        done = neural.fit_state(found, labels, state, self.shape, steps, epochs, width=ROUND, save=save)
        self._save(neural.state_rows(self.spark, done), count=count, loss=self._loss(neural.score(found, done.weights, self.shape), labels))
        for k in range(since, self._last(self.ranker)):
            source.remove(self.spark, f"{self.folder}/{self.ranker}/{k}")

    def train(self, choices: DataFrame, prune: bool = True) -> DataFrame:
        """Takes confirmed analyses (word, cand_ord) of ambiguous words: logs them, trains on them, and
        drops confirmed derived words from the dictionary. Returns word, status: no_analysis,
        unambiguous, unknown_choice or trained. Logged forms are each suffix's first, as ``gold_rows`` says."""
        asked = search.cut(choices.select("word", "cand_ord").distinct())
        found = search.cut(search.decompose(asked.select("word").distinct(), self.lexicon))
        counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        taken = search.cut(asked.join(counts.where("n > 1"), "word").join(found, ["word", "cand_ord"]))
        n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(False))
        status = F.when(n == 0, "no_analysis").when(n == 1, "unambiguous").when(ok, "trained").otherwise("unknown_choice")
        outcome = search.cut(
            asked.select("word").distinct().join(counts, "word", "left").join(taken.select("word", F.lit(True).alias("ok")).distinct(), "word", "left").select("word", status.alias("status"))
        )
        if taken.isEmpty():
            return outcome
        source.append_gold(render.gold_rows(taken, self.lexicon).drop("cand_ord"), f"{self.folder}/gold")
        self._learn(found, taken, rank.STEPS, 1, taken.select("word").distinct().count())
        if prune:
            self.delete(taken.where("root <> word").select("word").distinct(), infinitives=True)
        return outcome

    def delete(self, gone: DataFrame, infinitives: bool = False) -> int:
        """Takes the words in ``gone`` that the dictionary has (and those words' infinitives) out of it and
        returns by how many it is smaller. Only rows that depend on them are written."""
        n = self.dictionary.delete(pruned(self.words(), gone, self.lexicon) if infinitives else gone)
        if n:
            self.reload()
        return n

    def relearn(self, epochs: int = EPOCHS) -> DataFrame:
        """Trains on all logged analyses again; one row: n_words, n_matched, n_skipped."""
        order = F.struct("word", "root", "suffixes.name")
        rows = self.gold().select("word", "root", F.col("suffixes.name").alias("names"), F.row_number().over(Window.partitionBy("word").orderBy(order)).alias("gold_ord"))
        rows = search.cut(rows)
        found = search.cut(search.decompose(rows.select("word").distinct(), self.lexicon))
        labels = search.cut(gold_match(found, rows).select("word", "cand_ord"))
        if not labels.isEmpty():
            self._learn(found, labels, *((epochs, 1) if self.ranker == "linear" else (1, epochs)), labels.count())
        all_, hit = rows.agg(F.countDistinct("word").alias("n_words")), labels.agg(F.countDistinct("word").alias("n_matched"))
        return all_.join(F.broadcast(hit), F.lit(True)).withColumn("n_skipped", F.col("n_words") - F.col("n_matched"))  # one row each

    def review(self, n: int, seed: int = 0) -> DataFrame:
        """Scored analyses of ``n`` random dictionary words, for choosing."""
        drawn = search.cut(source.draw_words(self.words(), n, seed))
        return self.analyze(drawn)

    def sample(self, docs: DataFrame) -> DataFrame:
        """doc_id, value: texts annotated by the best analyses; words that were searched before are not again."""
        return render.annotate(docs, self.lexicon, self.scorer(), self.known())

    def sample_file(self, path: str, out: str) -> None:
        """Annotates a text file, or all files of a folder, of any size: one token a line, in order."""
        render.annotate_file(self.spark, path, out, self.lexicon, self.scorer(), self.known())

    def stream(self, docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
        """Annotates a stream of documents as ``sample`` does, with the dictionary and ranker it begins with."""
        return annotate_stream(docs, self.lexicon, path, checkpoint, self.scorer(), self.known())

    def count(self) -> int:
        """How many examples the ranker has been trained on."""
        return int(self._number("count") or 0)

    def snapshot(self) -> int:
        """The number of the ranker's newest snapshot, -1 before any training."""
        return self._last(self.ranker)

    def discard(self, number: int) -> int:
        """Removes the ranker's snapshots after ``number``, so that what was learnt since is forgotten, and
        returns how many there were. Logged analyses and the dictionary stay."""
        gone = range(number + 1, self.snapshot() + 1)
        for k in reversed(gone):  # the newest first: those that are left are whole at any moment
            source.remove(self.spark, f"{self.folder}/{self.ranker}/{k}")
        return len(gone)

    def auto(self, choose: Callable[[DataFrame], DataFrame], n: int, seed: int = 0) -> DataFrame:
        """Draws ``n`` dictionary words, trains on what ``choose`` picks (word, cand_ord) of their scored
        analyses, and returns one row: words_processed, words_deleted, words_skipped. Words that
        ``choose`` leaves out or that cannot be trained on are skipped."""
        drawn = search.cut(self.analyze(search.cut(source.draw_words(self.words(), n, seed))))
        before, asked = self.words().count(), min(n, self.words().count())
        outcome = self.train(choose(drawn))
        trained = outcome.where("status = 'trained'").count()
        gone = before - self.words().count()
        return self.spark.createDataFrame([(asked, gone, asked - trained)], "words_processed long, words_deleted long, words_skipped long")

    def stats(self) -> DataFrame:
        """One row: words and analyses logged, and the latest, best and recent mean (of 20) loss."""
        gold = self.gold().agg(F.countDistinct("word").alias("n_words"), F.count(F.lit(1)).alias("n_gold"))
        done = [path for path in source.files_in(self.spark, f"{self.folder}/{self.ranker}")]
        if not done:
            none = F.lit(None).cast("double")
            return gold.select("*", none.alias("latest"), none.alias("best"), none.alias("recent"))
        losses = self.spark.read.schema(_ROWS).parquet(*(f"{path}/part=session" for path in done)).where("name = 'loss'").select(F.get("shape", 0).alias("step"), F.col("number").alias("loss"))
        return gold.join(F.broadcast(rank.loss_stats(losses)), F.lit(True)).select("n_words", "n_gold", "latest", "best", "recent")  # one row each
