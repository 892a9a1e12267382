"""Encoding, ranking and training on candidate analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.functions.suffixes import SUFFIXES

TEMPERATURE, MARGIN, STEPS = 0.7, 0.5, 20


def encode_chain(chain: Column, makes: Column, compat: bool = False) -> Column:
    """(suffix id, category id) pairs; 0 is an unknown suffix. ``compat`` keeps all categories 0."""
    known = F.create_map(*[F.lit(x) for s in SUFFIXES for x in (s.name, s.id)])
    kind = (lambda m: F.lit(0)) if compat else (lambda m: F.when(m == "verb", 1).otherwise(0))
    return F.zip_with(chain, makes, lambda c, m: F.struct(F.coalesce(F.element_at(known, c), F.lit(0)).alias("sid"), kind(m).alias("cid")))


def pad_batch(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Right-pads id arrays with 0 to the longest one, with the mask of padded places."""
    wide, missing = _widened(rows, ids), F.col("missing")
    mask = F.concat(F.array_repeat(F.lit(False), F.size(ids)), F.array_repeat(F.lit(True), missing))
    return wide.withColumns({"padded": F.concat(F.col(ids), F.array_repeat(F.lit(0), missing)), "mask": mask}).drop("missing")


def _widened(rows: DataFrame, ids: str) -> DataFrame:
    """``rows`` with ``missing``, how many places an id array has less than the longest one."""
    longest = rows.agg(F.coalesce(F.max(F.size(ids)), F.lit(0)).alias("width"))
    wide = rows.crossJoin(F.broadcast(longest))  # one row
    return wide.withColumn("missing", (F.col("width") - F.size(ids)).cast("int")).drop("width")


def pad_text(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """The padded ids as text (``padded``, comma-joined) and the number of padded places (``n_masked``): what
    ``pad_batch`` gives, written without an array of the full width for each row."""
    zeros = F.expr("repeat(',0', missing)")
    text = F.when(F.size(ids) > 0, F.concat(F.array_join(F.col(ids).cast("array<string>"), ","), zeros)).otherwise(F.substring(zeros, 2, 2**31 - 1))
    return _widened(rows, ids).withColumns({"padded": text, "n_masked": F.col("missing").cast("long")}).drop("missing")


def best_per_word(scored: DataFrame) -> DataFrame:
    """The first candidate of the highest score."""
    best = F.max_by(F.struct("cand_ord", "score"), F.struct("score", -F.col("cand_ord")))
    return scored.groupBy("word").agg(best.alias("b")).select("word", "b.cand_ord", "b.score")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Ranks for choosing (score descending) and for display (ascending), earlier candidates first."""
    w = Window.partitionBy("word")
    return scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "cand_ord")), "shown": F.row_number().over(w.orderBy("score", "cand_ord"))})


def _soft(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("word")
    top = F.max("score").over(w)
    e = F.exp((F.col("score") - top) / TEMPERATURE)
    return scored.withColumn("p", e / F.sum(e).over(w))


def listwise_loss(scored: DataFrame) -> DataFrame:
    """One row: mean over words of -log(probability of the labelled candidate + 1e-8)."""
    return word_losses(scored).agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def word_losses(scored: DataFrame) -> DataFrame:
    """word, loss: -log(probability of the labelled candidates + 1e-8)."""
    return _soft(scored).groupBy("word").agg((-F.log(F.sum(F.col("p") * F.col("label")) + F.lit(1e-8))).alias("loss"))


def loss_stats(losses: DataFrame, recent: int = 20) -> DataFrame:
    """One row over (step, loss): how many, the latest, the best, and the mean of the last ``recent``
    ones; nulls where there are none. Steps do not repeat."""
    newest = losses.orderBy(F.desc("step")).limit(recent).agg(F.max_by("loss", "step").alias("latest"), F.avg("loss").alias("recent"))
    return losses.agg(F.count(F.lit(1)).alias("n"), F.min("loss").alias("best")).join(F.broadcast(newest), F.lit(True)).select("n", "latest", "best", "recent")  # one row each


def margin_check(scored: DataFrame) -> DataFrame:
    """word, good, other, ok: the labelled score beats every other by the margin."""
    good, other = F.max(F.when(F.col("label") == 1, F.col("score"))), F.max(F.when(F.col("label") == 0, F.col("score")))
    rows = scored.groupBy("word").agg(good.alias("good"), other.alias("other"))
    return rows.withColumn("ok", F.coalesce(F.col("good") > F.col("other") + MARGIN, F.col("good").isNotNull()))


def masked_mean(rows: DataFrame) -> DataFrame:
    """Mean of unmasked values per group, the divisor being at least 1."""
    live = F.when(~F.col("masked"), F.col("value"))
    return rows.groupBy("word").agg((F.coalesce(F.sum(live), F.lit(0.0)) / F.greatest(F.count(live), F.lit(1))).alias("mean"))


def _features() -> Column:
    pairs = F.expr("transform(slice(chain, 2, greatest(size(chain) - 1, 0)), (c, i) -> concat('2:', chain[i], '+', c))")
    return F.concat(F.transform("chain", lambda c: F.concat(F.lit("1:"), c)), pairs, F.array(F.concat(F.lit("n:"), F.size("chain").cast("string")), F.concat(F.lit("r:"), F.length("root").cast("string"))))


def features(candidates: DataFrame) -> DataFrame:
    """word, cand_ord, feature: suffixes, adjacent suffix pairs, chain and root lengths."""
    return candidates.select("word", "cand_ord", F.explode(_features()).alias("feature"))


def alike(candidates: DataFrame, right: DataFrame) -> DataFrame:
    """word, times, cand_ord, label, features: one word (the least) for all ``times`` words whose candidates have the
    same features and labels in the same order, as training sees no more of them. ``right`` has word, cand_ord, label."""
    rows = candidates.select("word", "cand_ord", _features().alias("features")).join(right, ["word", "cand_ord"], "left")
    own = F.array_sort(F.collect_list(F.struct("cand_ord", F.coalesce("label", F.lit(0)).alias("label"), "features")))
    same = rows.groupBy("word").agg(own.alias("own")).groupBy("own").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("times"))
    return same.select("word", "times", F.explode("own").alias("c")).select("word", "times", "c.*")


def score(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """word, cand_ord, score: the sum of a candidate's feature weights (0 where unknown)."""
    return features(candidates).join(weights, "feature", "left").groupBy("word", "cand_ord").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"))


def fit(candidates: DataFrame, labels: DataFrame, steps: int = STEPS, rate: float = 0.5, begun: DataFrame | None = None) -> DataFrame:
    """feature, weight after gradient steps on the listwise loss, ended when all margins hold.
    Training goes on from the weights in ``begun`` where it is given.

    ``labels`` has word and cand_ord of the right candidates; one step is one aggregate. Words that are ``alike``
    are worked on once and count as often as there are.
    """
    right = labels.select("word", "cand_ord", F.lit(1).alias("label")).distinct()
    rows = cut(alike(candidates.join(labels.select("word").distinct(), "word", "left_semi"), right))
    used = cut(rows.select("word", "cand_ord", "times", "label", F.explode("features").alias("feature")))
    weights = used.select("feature").distinct().withColumn("weight", F.lit(0.0))
    if begun is not None:
        weights = cut(weights.unionByName(begun).groupBy("feature").agg(F.sum("weight").alias("weight")))
    for _ in range(steps):
        scored = cut(used.join(weights, "feature").groupBy("word", "cand_ord", "label").agg(F.sum("weight").alias("score")))
        if margin_check(scored).where("not ok").isEmpty():
            break
        slope = _soft(scored).select("word", "cand_ord", (F.col("p") - F.col("label")).alias("g"))
        step = used.join(slope, ["word", "cand_ord"]).groupBy("feature").agg(F.sum(F.col("g") * F.col("times")).alias("g"))
        weights = cut(weights.join(step, "feature", "left").select("feature", (F.col("weight") - rate * F.coalesce("g", F.lit(0.0))).alias("weight")))
    return weights


def save_weights(weights: DataFrame, path: str) -> None:
    """A checkpoint of the ranker; ``path`` has to be new, as old weights may still be read."""
    weights.select("feature", "weight").write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, weight double").parquet(path)
