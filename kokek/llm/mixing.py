"""Mixing sources to target weights by subset-sum fitting of word budgets.

Each source's budget is whole passes over its documents plus one partial pass. The partial pass
is planned on the histogram of exact document lengths: a proportional share of every length,
then bounded-knapsack dynamic programming for what remains. Documents of a length are then
chosen in the order of a seeded hash. Only lengths, counts and hashes are shuffled, never texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kokek.llm.common import cut, maybe_broadcast, prepare, whole

WORDS = r"[^\x20\x09-\x0D]++"
MAX_EPOCHS = 3
#: Words of the remaining budget that the dynamic programme takes at first, and (in units of the lengths'
#: common divisor) at most: sums that two bit sets of 8 MB can hold. Every budget up to that is fitted exactly.
WINDOW, WIDEST = 16_384, 1 << 26
#: Hash ranges into which the documents of one source and length are split.
RANGES = 4096


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Words of each source: weights 1, 2, 3, repeating in code point order (null last), share
    the total; shares above MAX_EPOCHS times a source are cut and the excess shared anew."""
    names = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(size.values())), list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > MAX_EPOCHS * size[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = float(MAX_EPOCHS * size[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _powers(lengths: list[int], counts: list[int], budget: int) -> list[tuple[int, int]]:
    """(length, copies) items, each to be taken or left: counts are split into powers of two and a rest."""
    items = []
    for length, n in sorted(zip(lengths, counts)):
        n, step = min(n, budget // length), 1
        while n > 0:
            k = min(step, n)
            items.append((length, k))
            n, step = n - k, step * 2
    return items


def _reach(items: list[tuple[int, int]], budget: int) -> int:
    """Bit b says that b is a sum of some items."""
    reach, mask = 1, (1 << (budget + 1)) - 1
    for length, k in items:
        reach |= (reach << (k * length)) & mask
    return reach


def _chosen(items: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """Items whose sum is ``at``, which some items reach: halves are searched for the two parts of it, so
    that no more than two reaches of a half are held."""
    if at == 0 or len(items) == 1:
        return items if at else []
    middle = len(items) // 2
    left, right = items[:middle], items[middle:]
    both = _reach(left, at) & _turned(_reach(right, at), at + 1)  # bit s: left reaches s, right the rest
    s = both.bit_length() - 1
    return _chosen(left, s) + _chosen(right, at - s)


def _turned(x: int, bits: int) -> int:
    """The lowest ``bits`` bits in the opposite order."""
    size = -(-bits // 8)
    flat = np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little")[:bits]
    return int.from_bytes(np.packbits(flat[::-1], bitorder="little").tobytes(), "little")


def knapsack(budget: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """Copies of each length whose sum is the largest reachable one up to ``budget``, by bounded-knapsack
    dynamic programming; lengths are divided by their greatest common divisor first."""
    if not lengths:
        return {}
    unit = math.gcd(*lengths)
    lengths, budget = [n // unit for n in lengths], budget // unit
    items, taken = _powers(lengths, counts, budget), {}
    reach, mask, used = 1, (1 << (budget + 1)) - 1, 0
    while used < len(items) and not reach >> budget & 1:
        reach |= (reach << (items[used][0] * items[used][1])) & mask
        used += 1
    for length, k in _chosen(items[:used], reach.bit_length() - 1):
        taken[length * unit] = taken.get(length * unit, 0) + k
    return taken


def _partial(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """Documents of each length (all above 0): a proportional share, longest ones until at most ``window``
    words are left, and dynamic programming for these."""
    take = (counts * (max(0, budget - window) / max(1, int(lengths @ counts)))).astype(np.int64)
    rest = budget - int(lengths @ take)
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= window:
            break
        length = int(lengths[i])
        k = min(int(counts[i] - take[i]), rest // length, -((window - rest) // length))
        take[i] += k
        rest -= k * length
    fits = (lengths <= rest) & (counts > take)
    chosen = knapsack(rest, lengths[fits].tolist(), (counts - take)[fits].tolist())
    return take + np.array([chosen.get(int(n), 0) for n in lengths], np.int64)


def plan(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each length a partial pass adds: the largest sum up to the
    budget. A small window nearly always meets the budget (rounded down to the lengths' common divisor), which
    no sum can exceed; where it does not, the window is widened, up to the whole budget."""
    total, out = int(lengths @ counts), np.zeros(len(lengths), np.int64)
    if total == 0:
        return 0, out
    passes = min(MAX_EPOCHS, int(target // total))
    budget = 0 if passes == MAX_EPOCHS else max(0, min(total, round(target - passes * total)))
    some = lengths > 0
    own, n = lengths[some], counts[some]
    best, window, unit = np.zeros(len(own), np.int64), WINDOW, int(np.gcd.reduce(own))
    while True:
        take = _partial(own, n, budget, window)
        if own @ take > own @ best:
            best = take
        if own @ best == budget // unit * unit or window >= min(budget, WIDEST * unit):
            break
        window *= 64
    out[some] = best
    return passes, out


def sizes_of(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def _digest(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and a seeded hash of each row (identical rows hash alike)."""
    place = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    return docs.select("doc_id", "source", sizes_of(docs).alias("size"), place.alias("h"))


def _planned(rows: DataFrame) -> DataFrame:
    """source, size, source_size, target, passes, take: one row for each source and length.

    One plan reads one source's histogram: k different lengths need at least k(k-1)/2 words, so it
    has at most about the square root of the source's words as rows.
    """
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = [(r.source, r.words) for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    goal, total = targets(totals), dict(totals)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        source = None if pd.isna(source) else source
        pdf = pdf.sort_values("size")
        passes, take = plan(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), goal[source])
        return pdf.assign(source=source, source_size=total[source], target=goal[source], passes=passes, take=take)[["source", "size", "source_size", "target", "passes", "take"]]

    return histogram.groupBy("source").applyInPandas(fitted, "source string, size long, source_size long, target double, passes long, take long")


def _ranked(rows: DataFrame) -> DataFrame:
    """Each row's rank by hash among its source and length, the first rank of its hash, and how many
    rows share that. A group is first split into hash ranges whose counts give the offsets, so
    that no task sorts more than a RANGES-th of it."""
    rows = rows.withColumn("part", F.shiftrightunsigned("h", 64 - RANGES.bit_length() + 1))
    keys = ["source", "size"]
    counts = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*keys, "part", (F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).alias("offset"))
    group = Window.partitionBy(*keys, "part")
    alike = F.count(F.lit(1)).over(group.orderBy("h").rangeBetween(0, 0))
    within = rows.withColumns({"rank": F.row_number().over(group.orderBy("h", "doc_id")), "begin": F.rank().over(group.orderBy("h")), "alike": alike})
    a, b = within.alias("a"), offsets.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, same).select("a.doc_id", "a.source", "a.size", "a.h", (F.col("rank") + F.col("offset")).alias("rank"), (F.col("begin") + F.col("offset")).alias("begin"), "alike")


def _decided(docs: DataFrame, seed: int) -> DataFrame:
    rows = cut(_digest(docs, seed))
    a, b = _ranked(rows).alias("a"), maybe_broadcast(cut(_planned(rows))).alias("b")  # one row for each length
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    times = (F.col("passes") + (F.col("rank") <= F.col("take")).cast("long")).alias("times")
    return a.join(b, same).select("a.doc_id", "a.source", "a.size", "a.h", "source_size", "target", times, "take", "begin", "alike")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Null texts have size 0 and take 0 words; a null source is a source of its own, the last.
    Repeated rows count each; equal hashes are ordered by doc_id, and rows alike in both are
    interchangeable. An empty table gives an empty one; other columns are not read.
    """
    prepare(docs.sparkSession)
    return _decided(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns of any names.

    The choice is stated as one hash limit for each source and length, so that texts are not
    shuffled while those limits are few. Where rows alike in id and text lie on a limit, only some
    of them may go in: such rows are added up, equal ones before the shuffle, and get their number
    by running sums, so that copies agree with ``mix``. Texts without words go in once for each
    whole pass over their source.
    """
    prepare(docs.sparkSession)
    # Ranges and ranks go by unsigned hash, so limits compare as unsigned too.
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    chosen = _decided(docs, seed).withColumn("h", flip(F.col("h")))
    last = F.max_by(F.struct(F.col("h").alias("limit"), "take", "begin", "alike"), F.struct("times", "h")).alias("last")
    span = chosen.groupBy("source", "size").agg(F.min("times").alias("low"), F.max("times").alias("high"), last).select("source", "size", "low", "high", "last.*")
    # Of the rows of the last hash that is taken more often, ``some`` are; where not all, they are tied.
    tied = (F.col("low") < F.col("high")) & (F.col("take") < F.col("begin") + F.col("alike") - 1)
    limits = cut(span.select("source", "size", "low", "high", "limit", (F.col("take") - F.col("begin") + 1).alias("some"), tied.alias("tied")))
    ties, limits = not limits.where("tied").isEmpty(), maybe_broadcast(limits)

    own = docs.select(whole(docs).alias("row"), F.col("source").alias("own"), sizes_of(docs).alias("n"), flip(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))).alias("place"))
    met = own.join(limits, F.col("own").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")))
    split = F.col("tied") & (F.col("place") == F.col("limit"))
    plain = met.where(~split).select("row", F.when(F.col("place") <= F.col("limit"), F.col("high")).otherwise(F.col("low")).alias("copies"))
    every = plain
    if ties:
        equal = met.where(split).groupBy("source", "size", "place", F.sha2(F.to_json("row"), 256).alias("key")).agg(
            F.first("row").alias("row"), F.count(F.lit(1)).alias("m"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("some").alias("some")
        )
        before = F.sum("m").over(Window.partitionBy("source", "size", "place").orderBy("key")) - F.col("m")
        more = F.least(F.greatest(F.col("some") - before, F.lit(0)), F.col("m"))
        every = plain.unionByName(equal.select("row", (F.col("low") * F.col("m") + (F.col("high") - F.col("low")) * more).alias("copies")))
    return every.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k")).select("row.*")
