"""Stupid back-off scores of documents from n-gram counts over all other documents.

A document's own n-grams do not count: else every one of them would have been seen, and nothing
would ever back off. ``score`` keeps the count tables partitioned by n-gram hash, joins each block's
distinct n-grams to them and sums log scores for each document. ``score_rows`` says the same with
one row for each n-gram, in DataFrame operators alone; it shuffles many times the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kokek.llm import blocks
from kokek.llm.common import prepare
from kokek.llm.textkit import Words, flat, mix, per_row, slices, windows

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 1
#: Logarithms are rounded to multiples of 1 / GRID, so that sums are exact in any order.
GRID = 1 << 20


def _grams(part: pa.RecordBatch, order: int, bits: int) -> tuple[Words, list[np.ndarray]]:
    """Hashes of the n-grams of each order that end at each word (0 where none does)."""
    w = Words(*flat(part.column("text")))
    h = w.hashes()
    out = []
    for k in range(1, order + 1):
        g, at = windows(h, w, k) if k > 1 else (h, np.arange(len(h)))
        ends = np.zeros(len(h), np.uint64)
        ends[at + k - 1] = np.maximum(mix(g ^ np.uint64(k << 56)) >> np.uint64(64 - bits), 1)
        out.append(ends)
    return w, out


def _own(doc: np.ndarray, spot: np.ndarray, n: int) -> np.ndarray:
    """How often each word's n-gram (by its index below ``n``) occurs in its document."""
    _, inverse, times = np.unique(doc * n + spot, return_inverse=True, return_counts=True)
    return times[inverse]


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored below the highest order their place allows), log_score
    (sum of natural logarithms), mean_log_score of every row.

    All counts are of the other rows. A word scores count(n-gram) / count(its context), or ``backoff``
    times the score of the next shorter one while the n-gram's count is below ``min_count``; a single
    word scores its share of the others' words, and one that they do not have ``backoff`` times the
    share of one word among all. Null and blank texts have no words, score 0 and a null mean. Repeated
    rows are documents of their own; null ids stay null; other columns are not read; an empty table
    gives an empty one.
    """
    prepare(docs.sparkSession)
    dealt, words = blocks.deal(docs, block_bytes)
    buckets, bits = max(1, -(-words * order // blocks.BUCKET_KEYS)), blocks.key_bits(words * order)

    def keys_of(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        parts = [_grams(p, order, bits) for batch in table.to_batches() for p in slices(batch, "text")]
        every = [g[g > 0] for _, grams in parts for g in grams]
        keys, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        return parts, keys, n

    def split(keys: np.ndarray):
        return blocks.by_bucket(keys, blocks.in_range(keys, bits, buckets))

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, keys, n = keys_of(table.combine_chunks())
        for bucket, k in split(keys):
            yield bucket, blocks.pack(keys[k], n[k].astype(np.uint64))

    def answer(bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        asked = [blocks.unpack(b) for b in bodies]
        keys, place = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
        total = np.bincount(place, np.concatenate([n for _, n in asked]).astype(np.float64), len(keys)).astype(np.uint64)
        for i, (k, _) in enumerate(asked):
            yield i, blocks.squeeze(blocks.planes(total[np.searchsorted(keys, k)]))

    def values(w: Words, grams: list[np.ndarray], keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log score and number of back-offs of each word."""
        place = np.arange(len(w.start)) - w.first[:-1][w.doc]
        seen = []
        for k, g in enumerate(grams, 1):
            spot = np.searchsorted(keys, g)
            seen.append(np.where(g > 0, counts[np.minimum(spot, len(keys) - 1)] - _own(w.doc, np.where(g > 0, spot, 0), len(keys)), 0))
        most = np.minimum(place + 1, order)
        value, lost, open_ = np.full(len(place), -np.log(max(words, 1))), most.copy(), np.ones(len(place), bool)
        for k in range(order, 0, -1):
            context = words - w.count[w.doc] if k == 1 else np.concatenate([[1], seen[k - 2][:-1]])
            hit = open_ & (seen[k - 1] >= (min_count if k > 1 else 1)) & (place >= k - 1)
            value[hit] = np.log(seen[k - 1][hit] / context[hit])
            lost[hit] = most[hit] - k
            open_ &= ~hit
        return np.round((value + lost * math.log(backoff)) * GRID) / GRID, lost

    def finish(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        table = table.combine_chunks()
        parts, keys, _ = keys_of(table)
        counts = np.zeros(len(keys), np.int64)
        for bucket, k in split(keys):
            counts[k] = blocks.unplanes(blocks.unsqueeze(replies[bucket]))
        n_words, n_back, sums = [], [], []
        for w, grams in parts:
            value, lost = values(w, grams, keys, counts) if len(w.start) else (np.zeros(0), np.zeros(0, np.int64))
            total = np.concatenate([[0.0], np.cumsum(value)])
            n_words.append(w.count)
            n_back.append(per_row(lost > 0, w.first))
            sums.append(total[w.first[1:]] - total[w.first[:-1]])
        n, back, s = (np.concatenate(x) if x else np.zeros(0) for x in (n_words, n_back, sums))
        mean = np.divide(s, n, out=np.zeros(len(s)), where=n > 0)
        return pa.Table.from_arrays(
            [table.column("doc_id"), pa.array(n, pa.int64()), pa.array(back, pa.int64()), pa.array(np.round(s, 6)), pa.array(np.round(mean, 6), mask=n == 0)],
            names=["doc_id", "n_words", "n_backoff", "log_score", "mean_log_score"],
        )

    return blocks.exchange(dealt, buckets, ask, answer, finish, "doc_id long, n_words long, n_backoff long, log_score double, mean_log_score double")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used in lambdas."""
    return F.transform(F.array(value), use)[0]


def _runs(words: Column, order: int) -> Column:
    """The distinct n-grams of one document: gram (hash), k (words), places (all it ends at)."""

    def of_hashes(h: Column) -> Column:
        def ending(k: int) -> Column:
            def at(x: Column, i: Column) -> Column:
                parts = [F.get(h, i - j) for j in range(k - 1, 0, -1)]
                return F.struct(F.xxhash64(F.lit(k), *parts, x).alias("gram"), F.lit(k).alias("k"), i.alias("place"))

            return F.filter(F.transform(h, at), lambda g: g.place >= k - 1)

        return F.sort_array(F.concat(*(ending(k) for k in range(1, order + 1))))

    def of_sorted(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i - 1).gram != F.get(s, i).gram))

        def run(starts: Column) -> Column:
            def one(a: Column, j: Column) -> Column:
                places = F.transform(F.slice(s, a + 1, F.coalesce(F.get(starts, j + 1), F.size(s)) - a), lambda e: e.place)
                return F.struct(F.get(s, a).gram.alias("gram"), F.get(s, a).k.alias("k"), places.alias("places"))

            return F.transform(starts, one)

        return _let(first, run)

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes), of_sorted)


def score_rows(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """The same rows as ``score`` by relational operators: n-gram count tables partitioned by hash,
    joined to the exploded n-grams, summed for each document. Rows must differ in ``doc_id``.

    A document explodes to its distinct n-grams with the places that each ends at, so that it is
    counted within itself before anything is shuffled. Only n-grams that others have come back to
    their document, and single words. An n-gram that most documents have is a skewed key of the
    join, which adaptive execution splits.
    """
    split = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w"))
    rows = split.select("doc_id", F.size("w").alias("n"), F.inline(_runs(F.col("w"), order)))
    own = F.size("places")
    total = rows.groupBy("gram").agg(F.sum(own).alias("total"))
    words = split.agg(F.sum(F.size("w")).alias("words"))  # one row
    met = rows.join(total.hint("shuffle_merge"), "gram").withColumn("c", F.col("total") - own).where("c > 0 OR k = 1")
    placed = met.select("doc_id", "n", "k", "c", "places").repartition("doc_id").select("doc_id", "n", "k", "c", F.explode("places").alias("place"))
    at = placed.groupBy("doc_id", "n", "place").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(1, order + 1)))
    before = Window.partitionBy("doc_id").orderBy("place")
    near = at.withColumns({f"b{k}": F.lag(f"c{k}").over(before) for k in range(1, order)} | {"most": F.least(F.col("place") + 1, F.lit(order))}).join(F.broadcast(words))
    value, lost = -F.log("words"), F.col("most")
    for k in range(1, order + 1):
        context = F.col("words") - F.col("n") if k == 1 else F.col(f"b{k - 1}")
        hit = F.col(f"c{k}") >= (min_count if k > 1 else 1)
        value, lost = F.when(hit, F.log(F.col(f"c{k}") / context)).otherwise(value), F.when(hit, F.col("most") - k).otherwise(lost)
    one = near.select("doc_id", value.alias("v"), lost.alias("lost")).select("doc_id", "lost", (F.round((F.col("v") + F.col("lost") * math.log(backoff)) * GRID) / GRID).alias("v"))
    summed = one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("lost") > 0).alias("n_backoff"), F.sum("v").alias("s"))
    scored = summed.select("doc_id", "n_words", "n_backoff", F.round("s", 6).alias("log_score"), F.round(F.col("s") / F.col("n_words"), 6).alias("mean_log_score"))
    none = split.where(F.size("w") == 0).select("doc_id", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0.0), F.lit(None).cast("double"))
    return scored.union(none)
