"""Removal of word sequences that an earlier document also has.

``trees`` is the method in full: suffixes (word positions) are split by word prefixes of variable
length into groups that fit one task (a one-word prefix where its suffixes are few enough, else
two, four or all 13 words), each group's suffixes are sorted by their words, and the intervals of
their longest common prefixes are the internal nodes of a subtree. Nodes of 13 words and more are
repeats; those with different words before them are maximal ones. It ships every suffix's words,
many times the text.

``dedup`` asks the same groups only what removal needs, the least document of every node at 13 words.
There a node is told by a 63-bit hash of its words, which are not compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.llm import blocks
from kokek.llm.common import prepare
from kokek.llm.textkit import Words, flat, mix, slices, windows

WIDTH = 13
LEVELS = (1, 2, 4)
#: Suffixes of one group; heavier prefixes are made longer.
GROUP = 1_000_000
#: Counters of prefixes that a task holds at once.
HELD = 1 << 20
NEVER = (1 << 63) - 1

_MASK = np.uint64((1 << 63) - 1)


def _bins(h: np.ndarray, w: Words, level: int, keep: np.ndarray, bins: int) -> np.ndarray:
    g, k = windows(h, w, level) if level > 1 else (h, np.arange(len(h)))
    out = np.zeros(len(h), np.int64)
    out[k] = (mix(g ^ np.uint64(level)) & np.uint64(bins - 1)).astype(np.int64)
    return out[keep]


class Heavy:
    """Which hashed prefixes of each length have more suffixes than a group may: a bit for each bin, sent to
    the tasks by a broadcast (12 MB where 10^13 words have 2^25 bins)."""

    def __init__(self, spark: SparkSession, bits: dict[int, np.ndarray]):
        self.shared = spark.sparkContext.broadcast(bits)

    def __getitem__(self, level: int) -> Callable[[np.ndarray], np.ndarray]:
        bits = self.shared.value[level]
        return lambda bins: ((bits[bins >> 3] >> (7 - (bins & 7)).astype(np.uint8)) & 1) > 0


def heavy_prefixes(docs: DataFrame, bins: int, group: int = GROUP) -> Heavy:
    """For each prefix length, whether the suffixes of a hashed prefix are too many for a group. Tasks add up
    the bins that their texts touch and send them once they hold ``HELD``; no task has a counter for every bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(*flat(part.column(0)))
                h = w.hashes()
                _, keep = windows(h, w, WIDTH)
                # Bins of all levels in one numbering.
                own = np.concatenate([_bins(h, w, level, keep, bins) + k * bins for k, level in enumerate(LEVELS)])
                new, first = np.unique(own, return_counts=True)
                at, where = np.unique(np.concatenate([at, new]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, first]), len(at)).astype(np.int64)
                if len(at) > HELD:
                    yield counted(at, n)
                    at, n = at[:0], n[:0]
        yield counted(at, n)

    def counted(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(LEVELS)[at // bins]), pa.array(at % bins), pa.array(n)], ["level", "bin", "n"])

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "level long, bin long, n long")
    # At most the number of words divided by ``group`` are heavy, for each level.
    found = counts.groupBy("level", "bin").agg(F.sum("n").alias("n")).where(F.col("n") > group).select("level", "bin").toArrow()
    level, at = (np.asarray(found.column(c).combine_chunks()) for c in ("level", "bin"))
    out = {}
    for k in LEVELS:
        marked = np.zeros(bins, bool)
        marked[at[level == k]] = True
        out[k] = np.packbits(marked)
    return Heavy(docs.sparkSession, out)


class _Block:
    """Window hashes, groups and documents of one block."""

    def __init__(self, table: pa.Table, heavy: Heavy, bins: int):
        self.table = table.combine_chunks()
        ids = self.table.column("doc_id").to_pylist()
        self.ids = np.array([NEVER if i is None else i for i in ids], np.int64)
        hashes, groups, docs, at, self.words, row = [], [], [], [], [], 0
        base = 0
        for batch in self.table.to_batches():
            for part in slices(batch, "text"):
                w = Words(*flat(part.column("text")))
                h = w.hashes()
                g, keep = windows(h, w, WIDTH)
                group = np.full(len(keep), -1, np.int64)
                for level in LEVELS:
                    own = _bins(h, w, level, keep, bins)
                    group = np.where((group < 0) & ~heavy[level](own), own * 8 + level % 8, group)
                last = (g & np.uint64(bins - 1)).astype(np.int64) * 8 + 7
                hashes.append(g & _MASK)
                groups.append(np.where(group < 0, last, group))
                docs.append(w.doc[keep] + row)
                at.append(keep + base)
                self.words.append(w)
                row += part.num_rows
                base += len(h)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hash, self.group = join(hashes, np.uint64), join(groups, np.int64)
        self.doc, self.at, self.total = join(docs, np.int64), join(at, np.int64), base
        order = np.lexsort((self.ids[self.doc], self.hash))
        first = np.ones(len(order), bool)
        first[1:] = self.hash[order][1:] != self.hash[order][:-1]
        self.keys = self.hash[order][first]  # distinct, ascending
        self.least = self.ids[self.doc[order][first]]
        self.key_group = self.group[order][first]


_SUFFIX = "group long, doc_id long, pos long, before string, words string"
_NODE = "doc_id long, pos long, least long, depth long, n long, maximal boolean, words string"


def subtree(words: list[list[str]], before: list[str | None]) -> list[tuple[int, int, int, bool]]:
    """(from, to, depth, maximal) of the internal nodes of sorted suffixes: intervals whose neighbours share
    at least ``depth`` words and some no more; maximal ones do not all have one and the same word before."""
    shared = [0]
    for a, b in zip(words, words[1:]):
        shared.append(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
    out, open_ = [], [(0, 0)]
    for i, depth in enumerate([*shared[1:], -1], 1):
        start = i - 1
        while open_ and open_[-1][1] > depth:
            start, own = open_.pop()
            differ = len({*before[start:i]}) > 1 or before[start] is None
            out.append((start, i, own, differ))
        if depth >= 0 and (not open_ or open_[-1][1] < depth):
            open_.append((start, depth))
    return [n for n in out if n[1] - n[0] > 1]


def trees(docs: DataFrame, width: int = WIDTH, deep: int = 2 * WIDTH, group: int = GROUP // 8) -> DataFrame:
    """One row for each suffix in a node of ``width`` words or more: doc_id, pos, least (the smallest
    doc_id of its outermost such node; nodes are read to ``deep`` words); and for each suffix that is
    first in a maximal repeat: depth, n (its occurrences), maximal and words of that node.

    Rows without id and texts of fewer words have none; ids are taken to be different.
    """
    prepare(docs.sparkSession)
    words = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")))).first()[0] or 0
    bins = 1 << max(4, (2 * words // group).bit_length())
    heavy = heavy_prefixes(docs, bins, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                w = Words(*flat(part.column("text")))
                h = w.hashes()
                g, keep = windows(h, w, WIDTH)
                own = np.full(len(keep), -1, np.int64)
                for level in LEVELS:
                    prefix = _bins(h, w, level, keep, bins)
                    own = np.where((own < 0) & ~heavy[level](prefix), prefix * 8 + level % 8, own)
                own = np.where(own < 0, (g & np.uint64(bins - 1)).astype(np.int64) * 8 + 7, own)
                data = w.raw.tobytes()
                text = [data[a:b].decode() for a, b in zip(w.start.tolist(), w.end.tolist())]
                first, row = w.first.tolist(), w.doc[keep].tolist()
                ids = part.column("doc_id").to_pylist()
                cols = (
                    own, [ids[r] for r in row], [k - first[r] for k, r in zip(keep.tolist(), row)], [text[k - 1] if k > first[r] else None for k, r in zip(keep.tolist(), row)],
                    [" ".join(text[k : min(k + deep, first[r + 1])]) for k, r in zip(keep.tolist(), row)],
                )
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["group", "doc_id", "pos", "before", "words"])

    def nodes(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip((w.split(" ") for w in table.column("words").to_pylist()), table.column("doc_id").to_pylist(), table.column("pos").to_pylist(), table.column("before").to_pylist()), key=lambda r: r[:3])
        found = [n for n in subtree([r[0] for r in rows], [r[3] for r in rows]) if n[2] >= width]
        least: dict[int, int] = {}
        for a, b, _, _ in sorted(found, key=lambda n: n[0] - n[1]):  # outermost nodes first
            low = min(r[1] for r in rows[a:b]) if a not in least else None
            for i in range(a, b):
                if low is not None:
                    least.setdefault(i, low)
        out = [(rows[i][1], rows[i][2], low, None, None, None, None) for i, low in least.items()]
        out += [(rows[a][1], rows[a][2], None, depth, b - a, True, " ".join(rows[a][0][:depth])) for a, b, depth, maximal in found if maximal]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds)], names=["doc_id", "pos", "least", "depth", "n", "maximal", "words"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, _SUFFIX).groupBy("group").applyInArrow(nodes, _NODE)


def dedup_by_trees(docs: DataFrame, group: int = GROUP // 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 as of ``dedup``, by ``trees``; ids are taken to be different."""
    late = trees(docs, deep=WIDTH, group=group).where("least < doc_id").groupBy("doc_id").agg(F.collect_list("pos").alias("late"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                words = [w.decode() for w in re.findall(rb"[^ \t-\r]+", text.encode())]
                gone = {k + j for k in at or () for j in range(WIDTH)}
                kept = " ".join(w for k, w in enumerate(words) if k not in gone)
                out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(late, "doc_id", "left")
    return named.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, width: int = WIDTH, group: int = GROUP, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the remaining text), repeats (runs of removed words
    as first and end word positions; ``trees`` gives maximal repeats) of every row.

    A word goes when a window of 13 words over it also starts in a document with a smaller id.
    Null and short texts keep all; rows with one id never remove from each other; a null id counts
    as the largest, so such rows lose to all others and to none of their kind. Windows are told
    apart by 63-bit hashes. Other columns are not read; an empty table gives an empty one.
    """
    if width != WIDTH:
        raise ValueError("windows have 13 words")
    prepare(docs.sparkSession)
    dealt, words = blocks.deal(docs, block_bytes)
    bins = 1 << max(4, (2 * words // group).bit_length())
    heavy = heavy_prefixes(docs, bins, group)

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        b = _Block(table, heavy, bins)
        for bucket, k in blocks.by_bucket(b.keys, b.key_group):
            # The smallest id of the row group stands in front, ids follow as distances from it.
            low = int(b.least[k].min())
            yield bucket, low.to_bytes(8, "little", signed=True) + blocks.pack(b.keys[k], (b.least[k] - low).astype(np.uint64))

    def answer(bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        keys, ids, owner = [], [], []
        for k, body in enumerate(bodies):
            key, far = blocks.unpack(body[8:])
            keys.append(key)
            ids.append(far.astype(np.int64) + int.from_bytes(body[:8], "little", signed=True))
            owner.append(np.full(len(key), k, np.int32))
        key, i, who = np.concatenate(keys), np.concatenate(ids), np.concatenate(owner)
        order = np.lexsort((i, key))
        key, i, who = key[order], i[order], who[order]
        begin = np.ones(len(key), bool)
        begin[1:] = key[1:] != key[:-1]
        least = i[begin][np.cumsum(begin) - 1]  # a node's smallest id
        late = np.flatnonzero(least < i)
        for k, at in blocks.by_bucket(key[late], who[late]):
            low = int(least[late[at]].min())
            yield k, low.to_bytes(8, "little", signed=True) + blocks.pack(key[late[at]], (least[late[at]] - low).astype(np.uint64))

    def finish(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        b = _Block(table, heavy, bins)
        least = b.least.copy()
        for body in replies.values():
            key, far = blocks.unpack(body[8:])
            least[np.searchsorted(b.keys, key)] = far.astype(np.int64) + int.from_bytes(body[:8], "little", signed=True)
        late = b.at[least[np.searchsorted(b.keys, b.hash)] < b.ids[b.doc]] if len(b.hash) else b.at
        cover = np.zeros(b.total + 1, np.int64)
        np.add.at(cover, late, 1)
        np.subtract.at(cover, late + WIDTH, 1)
        gone = np.cumsum(cover[:-1]) > 0
        counts, removed, kept, repeats, base = [], [], [], [], 0
        for w in b.words:
            data = w.raw.tobytes()
            for k in range(len(w.count)):
                s = slice(w.first[k], w.first[k + 1])
                out = gone[base + s.start : base + s.stop]
                stay = np.flatnonzero(~out) + s.start
                kept.append(b" ".join([data[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
                counts.append(len(out))
                removed.append(int(out.sum()))
                edge = np.flatnonzero(np.diff(out, prepend=False, append=False))
                repeats.append([[x, y] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
            base += len(w.start)
        return pa.Table.from_arrays(
            [
                b.table.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode() for x in kept], pa.string()),
                pa.array(repeats, pa.list_(pa.list_(pa.int64()))),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "repeats"],
        )

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<array<long>>"
    return blocks.exchange(dealt, bins, ask, answer, finish, ddl)
