"""Audit of how the sources of a language differ in their words, by integer-dictionary encoding.

One pass over the texts counts terms for each language and source, summed in every task before
anything is shuffled. The counts are sorted by language and term over the whole cluster; a task cuts
its range into chunks, each a sorted array of kept terms. A term's id is its place in that array, found
by binary search, and one ``bincount`` of ids and group numbers gives the chunk's dense counts of every
source. Ids follow the UTF-8 order of the terms, so that ties need no look at the texts again.

A chunk has a bounded number of cells at every size of the corpus, and what leaves it is small: sums over
its terms for pairs of sources, and each source's own best terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kokek.llm.common import cut, maybe_broadcast, prepare

#: Letters are A-Z, a-z and every byte of a code point beyond ASCII, so bytes split where code points do.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task counts before it hands its counts on.
COUNTED = 400_000
#: Cells (terms times sources) of a chunk.
CELLS = 1 << 18


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8 bytes), n (occurrences), docs (rows that have it); nulls read as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in held.items():
                m, terms = len(n), list(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(terms, pa.binary()),
                        pa.array(list(n.values()), pa.int64()), pa.array(list(map(rows.__getitem__, terms)), pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = TERM.findall(text.lower())  # lower() of bytes changes A-Z alone
                n, rows = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(own)
                rows.update(set(own))
            if sum(len(n) for n, _ in held.values()) > COUNTED:
                yield from handed()
        yield from handed()

    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counted = read.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_CHUNK = "lang string, n_terms long, terms binary, ends binary, sources array<string>, counts binary"


def encoded(lang: str, rows: pa.Table) -> pa.RecordBatch:
    """A chunk of _CHUNK from rows (source, term, n) of kept terms of one language."""
    terms, sources, n = (rows.column(c).combine_chunks() for c in ("term", "source", "n"))
    words = np.array(terms.to_pylist(), object)
    kept, (groups, group) = np.unique(words), np.unique(np.array(sources.to_pylist(), object), return_inverse=True)
    cell = group * len(kept) + np.searchsorted(kept, words)
    cells = np.zeros(len(groups) * len(kept), np.int64)
    # Counts go in as two halves, as bincount adds floats: sums below 2^53 are exact.
    for part, unit in zip(np.divmod(np.asarray(n), 1 << 26), (1 << 26, 1)):
        cells += np.bincount(cell, weights=part, minlength=len(cells)).astype(np.int64) * unit
    ends = np.cumsum([len(t) for t in kept], dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang]), pa.array([len(kept)], pa.int64()), pa.array([b"".join(kept)], pa.binary()), pa.array([ends.tobytes()], pa.binary()),
            pa.array([groups.tolist()], pa.list_(pa.string())), pa.array([cells.tobytes()], pa.binary()),
        ],
        ["lang", "n_terms", "terms", "ends", "sources", "counts"],
    )


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    flat = column.combine_chunks()
    return np.concatenate([[True], np.asarray(pc.not_equal(flat[1:], flat[:-1]))]) if len(flat) else np.zeros(0, bool)


def chunks(counts: DataFrame, least: int, widest: int, cells: int = CELLS) -> DataFrame:
    """lang, n_terms, terms (joined) with ends, sources, counts (sources x terms, int64): the kept terms of
    each language in chunks of about ``cells`` cells; ``widest`` is the most sources of a language."""
    most = max(64, cells // max(1, widest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, lang, kept, n = None, None, [], 0  # rows of a term that may go on; kept rows of a language

        def taken(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of whole terms."""
            nonlocal lang, kept, n
            fresh = _changes(rows.column("lang")) | _changes(rows.column("term"))
            at = np.flatnonzero(fresh)
            enough = np.add.reduceat(np.asarray(rows.column("docs")), at) >= least
            number = np.cumsum(fresh) - 1
            rows, number = rows.filter(pa.array(enough[number])), number[enough[number]]
            if not rows.num_rows:
                return
            begin = np.concatenate([[True], number[1:] != number[:-1]])
            group, place = np.cumsum(_changes(rows.column("lang"))), np.cumsum(begin) - 1
            place -= place[np.searchsorted(group, group)]  # among the kept terms of its language here
            if rows.column("lang")[0].as_py() == lang:
                place[group == 1] += n
            elif kept:
                yield encoded(lang, pa.concat_tables(kept))
                kept = []
            spot = group * (1 << 40) + place // most
            cuts = [0, *(np.flatnonzero(np.diff(spot)) + 1).tolist(), len(spot)]
            for a, b in zip(cuts, cuts[1:]):
                own = rows.column("lang")[a].as_py()
                if kept and (own != lang or place[a] % most == 0):
                    yield encoded(lang, pa.concat_tables(kept))
                    kept = []
                lang, n = own, int(place[b - 1]) + 1
                kept.append(rows.slice(a, b - a).select(["source", "term", "n"]))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if open_ is None else pa.concat_tables([open_, rows])
            if not rows.num_rows:
                continue
            last = int(np.flatnonzero(_changes(rows.column("lang")) | _changes(rows.column("term")))[-1])
            open_ = rows.slice(last)
            if last:
                yield from taken(rows.slice(0, last))
        if open_ is not None:
            yield from taken(open_)
        if kept:
            yield encoded(lang, pa.concat_tables(kept))

    # Rows of one term of a language are as many as its sources and are in one range.
    ordered = counts.repartitionByRange(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.select("lang", "source", "term", "n", "docs").mapInArrow(run, _CHUNK)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    divisor = total + SMOOTH * terms
    if divisor >= 1 << 53:
        return np.array([1 + UNIT * (int(c) + SMOOTH) // divisor for c in counts], np.int64)
    found, rest = np.divmod(counts + SMOOTH, divisor)
    for _ in range(3):  # a thousand at a time, so that no product leaves 64 bits
        more, rest = np.divmod(rest * 1000, divisor)
        found = found * 1000 + more
    return 1 + found


def _measured(top: int):
    """Of chunks beside their language's totals: sums of differences for each two sources, and each
    source's ``top`` terms of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, terms, ends, own, counts, vocabulary, sources, totals in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.frombuffer(ends, np.int64)
                held = np.zeros((len(sources), len(ends)), np.int64)
                held[np.searchsorted(np.array(sources, object), np.array(own, object))] = np.frombuffer(counts, np.int64).reshape(len(own), -1)
                p = np.stack([shares(row, total, vocabulary) for row, total in zip(held, totals)])
                q = shares(held.sum(axis=0), sum(totals), vocabulary)
                out = []
                for k, source in enumerate(sources):
                    apart = np.abs(p - p[k]).sum(axis=1)
                    out += [(lang, source, "pair", other.encode(), int(x)) for j, (other, x) in enumerate(zip(sources, apart)) if j != k]
                    more = np.flatnonzero((held[k] > 0) & (p[k] > q))
                    f = p[k][more] - q[more]
                    best = np.lexsort((more, -f))[:top]
                    out += [(lang, source, "term", terms[(ends[i - 1] if i else 0) : ends[i]], int(x)) for i, x in zip(more[best].tolist(), f[best])]
                names = ["lang", "source", "part", "item", "value"]
                kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 5, kinds)], names)

    return run


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's words are from the other sources
    of its language (part ``pair``, every other source), and which words it has more of than its language
    (part ``term``, at most ``top``).

    Null lang, source and text read as ''. Terms are runs of ASCII letters and code points beyond ASCII,
    A-Z lower-cased; a language keeps those that ``least`` of its rows or more have. Repeated rows count
    each. Equal values are ordered by UTF-8. A language with one source has no pairs, one without kept
    terms has pairs of value 0 and no terms. Other columns are not read; an empty table gives none.
    The result has a row for each two sources of a language, so sources are taken to be few: totals are
    joined to chunks as one row for each language.
    """
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    blank = F.lit("")
    groups = cut(docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source")).distinct())
    widest = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    held = cut(chunks(cut(term_counts(docs)), least, widest, cells))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, counts in zip(*(c.to_pylist() for c in batch.columns)):
                totals = np.frombuffer(counts, np.int64).reshape(len(sources), -1).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sources)), pa.array(sources, pa.string()), pa.array(totals)], ["lang", "source", "total"])

    totals = held.select("lang", "sources", "counts").mapInArrow(summed, "lang string, source string, total long").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    listed = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("own"))
    sizes = held.groupBy("lang").agg(F.sum("n_terms").alias("vocabulary"))
    known = cut(listed.join(sizes, "lang").select("lang", "vocabulary", F.col("own.source").alias("every"), F.col("own.total").alias("totals")))
    found = held.join(maybe_broadcast(known), "lang").select("lang", "terms", "ends", "sources", "counts", "vocabulary", "every", "totals")
    rows = cut(found.mapInArrow(_measured(top), "lang string, source string, part string, item binary, value long"))

    none = groups.alias("a").join(groups.alias("b"), F.col("a.lang") == F.col("b.lang")).where("a.source <> b.source")
    pairs = none.select("a.lang", "a.source", F.lit("pair").alias("part"), F.encode("b.source", "UTF-8").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = pairs.unionByName(rows.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = rows.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    every = pairs.withColumn("rank", rank).unionByName(terms)
    return every.select("lang", "source", "part", F.decode("item", "UTF-8").alias("item"), "value", "rank")
