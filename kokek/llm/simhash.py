"""SimHash near-duplicate groups by a hierarchical index over fingerprints in Gray order.

Distinct fingerprints are sorted by their Gray rank over the whole cluster, so that neighbours share
most bits. Runs of neighbours are blocks; what all members of a block share is its pattern under a
mask, and blocks are grouped into upper nodes in the same way. A fingerprint walks this tree from the
root and adds up the bits in which it differs from each node's own masked pattern; a node at more than
the allowed number of differences is left out with everything below it. A block that remains gets the
fingerprint sent, once for each pair of blocks, and looks it up in the same kind of tree over its own
members, whose leaves account for all bits, so that the sum is the Hamming distance itself.

Blocks are the unit of work: they hold distinct fingerprints, so copies of one text weigh as one, and a
dense region only has more blocks. A block that is asked more than one task should answer is held by
several tasks, between which its questions are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kokek.llm.common import BROADCAST_ROWS, cut, prepare
from kokek.llm.near_dedup import contract

WIDTH, SEED, DISTANCE = 3, 42, 2
#: Children of a node.
FAN = 16
#: Fingerprints of a block, while there are at most BLOCKS blocks; beyond, blocks grow instead. The table
#: of blocks (three integers each) is therefore at most 2 MB, but for one more block a partition.
BLOCK, BLOCKS = 4096, 65_536
#: Fingerprints in one row of an exchange.
ROW = 8192
#: Questions that one task answers for a block.
ASKED = 4_000_000
#: Bytes of a text that are split into words at once, and differences held at once in a search.
PIECE, HELD = 1 << 20, 1 << 20
#: Tasks among which the rows of one fingerprint are dealt where they are joined by a shuffle.
SALTS = 32

_FULL = np.uint64((1 << 64) - 1)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64 bits, each set where more than half of the hashes of all runs of ``width`` words have it set
    (A-Z lower-cased; fewer words are one run; no words give 0)."""
    ones, n, before = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or b"").lower()):
        words = before + words
        joined = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begin = np.concatenate([[0], end[:-1] + 1]) if len(words) else end
        spans = zip(begin[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans] if len(words) >= width else [], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        before = words[len(words) - width + 1 :] if len(words) >= width else words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(batch.column(1)[i].as_py(), width) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _common(mask: np.ndarray, pattern: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that all nodes between successive offsets share."""
    some = np.bitwise_or.reduceat(pattern, at)
    every = np.bitwise_and.reduceat(pattern | ~mask, at)
    fixed = np.bitwise_and.reduceat(mask, at) & ~(some ^ every)
    return fixed, every & fixed


class Tree:
    """Nodes over leaves (mask, pattern) in Gray order, FAN children each. A node keeps only the part
    of its mask that its parent has not accounted for."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        levels = [(mask, pattern)]
        while len(levels[-1][0]) > FAN:
            own = levels[-1]
            levels.append(_common(*own, np.arange(0, len(own[0]), FAN)))
        self.levels = []
        for k, (m, p) in enumerate(levels):
            over = np.repeat(levels[k + 1][0], FAN)[: len(m)] if k + 1 < len(levels) else np.zeros(len(m), np.uint64)
            self.levels.append((m & ~over, p & m & ~over))
        self.levels.reverse()

    def near(self, asked: np.ndarray, most: int, mask: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, leaf) wherever their differing bits, under the leaf's mask (and the question's own,
        if given), are ``most`` or fewer. Questions are taken in portions that keep differences bounded."""
        top = len(self.levels[0][0])
        waiting = [(0, np.repeat(np.arange(a, min(len(asked), a + HELD // top)), top)) for a in range(0, len(asked), HELD // top)]
        waiting = [(0, q, np.tile(np.arange(top), len(q) // top), np.zeros(len(q), np.uint8)) for _, q in waiting]
        while waiting:
            level, q, node, sum_ = waiting.pop()
            own, pattern = self.levels[level]
            differ = (asked[q] ^ pattern[node]) & own[node]
            sum_ = sum_ + np.bitwise_count(differ if mask is None else differ & mask[q])
            live = sum_ <= most
            q, node, sum_ = q[live], node[live], sum_[live]
            if level + 1 == len(self.levels):
                if len(q):
                    yield q, node
                continue
            n = len(self.levels[level + 1][0])
            for a in range(0, len(q), HELD // FAN):
                b = slice(a, a + HELD // FAN)
                child = (node[b, None] * FAN + np.arange(FAN)).ravel()
                there = child < n
                waiting.append((level + 1, np.repeat(q[b], FAN)[there], child[there], np.repeat(sum_[b], FAN)[there]))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """block (its first member), mask, pattern, fps: runs of neighbours in Gray order, in rows of at
    most ROW members; only a block's first row has mask and pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made(fps: np.ndarray) -> pa.RecordBatch:
            mask, pattern = _common(np.full(len(fps), _FULL), fps, np.array([0]))
            parts = [fps[a : a + ROW].tobytes() for a in range(0, len(fps), ROW)]
            none = [None] * (len(parts) - 1)
            return pa.RecordBatch.from_arrays(
                [
                    _longs(np.repeat(fps[:1], len(parts))), pa.array([int(mask.view(np.int64)[0]), *none], pa.int64()),
                    pa.array([int(pattern.view(np.int64)[0]), *none], pa.int64()), pa.array(parts, pa.binary()),
                ],
                ["block", "mask", "pattern", "fps"],
            )

        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            n += batch.num_rows
            if n >= size:
                fps = np.concatenate(held)
                yield from (made(fps[a : a + size]) for a in range(0, n - n % size, size))
                held, n = [fps[n - n % size :]], n % size
        if n:
            yield made(np.concatenate(held))

    spark = nodes.sparkSession
    ranked = nodes.select("fp").mapInArrow(_ranked, "fp long, rank long")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ranked.repartitionByRange(partitions, "rank").sortWithinPartitions("rank").select("fp")
    return ordered.mapInArrow(run, "block long, mask long, pattern long, fps binary")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, rank: the Gray rank, moved so that signed integers sort like it."""
    for batch in batches:
        rank = gray_rank(np.asarray(batch.column(0)).view(np.uint64)) ^ np.uint64(1 << 63)
        yield pa.RecordBatch.from_arrays([batch.column(0), _longs(rank)], ["fp", "rank"])


def _questions(blocks: DataFrame, most: int) -> DataFrame:
    """block, n, fps: the members of each block that another block (or itself) has to look up. Of two
    blocks only the later one in Gray order is asked."""
    named = blocks.where("mask IS NOT NULL").select("block", "mask", "pattern").toPandas()  # BLOCKS of them
    fp, mask, pattern = (named[c].to_numpy(np.int64).view(np.uint64) for c in ("block", "mask", "pattern"))
    order = np.argsort(gray_rank(fp))
    shared = blocks.sparkSession.sparkContext.broadcast((fp[order], mask[order], pattern[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, masks, patterns = shared.value
        tree, ranks = Tree(masks, patterns), gray_rank(names)
        for batch in batches:
            for block, data in zip(np.asarray(batch.column(0)).view(np.uint64), batch.column(1)):
                fps = np.frombuffer(data.as_py(), np.uint64)
                # The group as a whole first: bits that all of it shares, against each upper node.
                mask, pattern = _common(np.full(len(fps), _FULL), fps, np.array([0]))
                found = [leaf for _, leaf in tree.near(pattern, most, mask)]
                leaves = np.concatenate(found) if found else np.zeros(0, np.int64)
                to, n, sent = [], [], []
                for leaf in leaves[ranks[leaves] >= gray_rank(np.array([block]))[0]]:
                    near = fps[np.bitwise_count((fps ^ patterns[leaf]) & masks[leaf]) <= most]
                    if len(near):
                        to.append(names[leaf])
                        n.append(len(near))
                        sent.append(near.tobytes())
                yield pa.RecordBatch.from_arrays([_longs(np.array(to, np.uint64)), pa.array(n, pa.int64()), pa.array(sent, pa.binary())], ["block", "n", "fps"])

    return blocks.select("block", "fps").mapInArrow(run, "block long, n long, fps binary")


def _spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints into the same groups: each one with its group's least."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = np.flatnonzero(low != np.arange(len(names)))
    return names[own], names[low[own]]


def _links(blocks: DataFrame, questions: DataFrame, most: int, asked: int) -> DataFrame:
    """a, b: links that join all fingerprints at ``most`` differing bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members, tree = None, [], None
        for batch in batches:
            for block, part, ask, data in zip(*(c.to_pylist() for c in batch.columns)):
                fps = np.frombuffer(data, np.uint64)
                if (block, part) != name:
                    name, members, tree = (block, part), [], None
                if not ask:
                    members.append(fps)
                    continue
                if tree is None:
                    own = np.concatenate(members)
                    own = own[np.argsort(gray_rank(own))]
                    tree, members = Tree(np.full(len(own), _FULL), own), []
                for q, leaf in tree.near(fps, most):
                    a, b = fps[q].view(np.int64), own[leaf].view(np.int64)
                    a, b = _spanned(a[a != b], b[a != b])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([_longs(a), _longs(b)], ["a", "b"])

    # How many tasks hold a block: one row for each of at most about BLOCKS blocks.
    parts = F.broadcast(cut(questions.groupBy("block").agg(F.ceil(F.sum("n") / asked).cast("int").alias("parts"))))
    dealt = questions.join(parts, "block").select("block", F.pmod(F.xxhash64("fps"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("ask"), "fps")
    holding = blocks.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("ask"), "fps")
    rows = holding.unionByName(dealt).repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "part").sortWithinPartitions("block", "part", "ask")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, most: int = DISTANCE, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Fingerprints that differ in ``most`` bits or fewer are linked, and a component is named by its
    smallest id; no candidate is left out at any size. Null, empty and blank texts have fingerprint
    0, which is linked like any other; very long texts are read in pieces. Repeated rows are linked
    with each other; a row without id is linked with nothing and has no component. Other columns
    are not read; an empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = cut(fingerprints(docs, width))
    nodes = cut(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    blocks = cut(_blocks(nodes, max(block, -(-nodes.count() // BLOCKS))))
    groups = contract(_links(blocks, cut(_questions(blocks, most)), most, asked))
    joined = nodes.join(groups.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("b", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component"), F.sum("n").alias("members"))
    # A document that is linked with nothing needs no join; the rows of a hot fingerprint are salted.
    many = cut(joined.join(least.where("members > 1"), "root").select("fp", "component"))
    if many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(many), "fp", "left")
    else:
        side = many.select("fp", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(side.hint("shuffle_merge"), ["fp", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), component.alias("component_id"))
