"""Near-duplicate groups by a MinHash LSH forest, confirmed on full shingle sets.

A document's signature is read in several orders, the trees of the forest. In each order all
signatures are sorted over the whole cluster; neighbours are compared by their longest common
prefix, and runs of neighbours that share LEAST values or more are candidate regions. A run too
heavy for one task is cut where neighbours share less, level by level, so that depth adapts to
each region. Inside a region, exact Jaccard tests along a breadth-first search join documents into
stars; the stars' links are then contracted to components. Equal sets are one node from the
start, so copies never form pairs.

Longer prefixes lose candidates, so members of cut runs are searched once more without loss:
similar sets share one of their rarest shingles, and only members of different components meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kokek.llm.common import BROADCAST_ROWS, cut, maybe_broadcast, prepare
from kokek.llm.textkit import Words, flat, mix, slices, windows

SHINGLE, PERCENT = 4, 80
#: Orders of the forest, and the values neighbours have to share; a pair at similarity 0.8 misses all
#: orders with (1 - 0.8^3)^16 = 1e-5.
TREES, LEAST = 16, 3
HASHES = TREES * LEAST
#: Values of an order that are sorted and compared.
SORTED = 8
#: Shingles of a region's sets that one task may hold; heavier runs are cut.
REGION_SHINGLES = 1_000_000
#: Neighbours of one run that a task holds while it decides where to cut it; longer runs are cut there.
RUN_ROWS = 500_000
#: Rows of sorted orders in one partition, once there are many.
ORDER_ROWS = 1_000_000
#: Bits of the filter of candidates' ids for each of them, and at most (128 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 30

_STEPS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD6E8FEB86659FD93 * (k + 7)) % (1 << 64) | 1 for k in range(HASHES)], np.uint64)
_S32 = np.uint64(32)


def shingle_sets(part: pa.RecordBatch, width: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct hashes of each row's shingles (A-Z lower-cased); a row of fewer words
    has its whole sequence as one."""
    raw, at = flat(part.column("text"))
    w = Words(raw, at, lower=True)
    h = w.hashes()
    g, k = windows(h, w, width)
    cuts = np.searchsorted(k, w.first)
    out = []
    for i, n in enumerate(w.count.tolist()):
        if n >= width:
            out.append(np.unique(g[cuts[i] : cuts[i + 1]]))
        elif n:
            own = Words(w.raw[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
            out.append(windows(h[w.first[i] : w.first[i + 1]], own, n)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of HASHES multiplicative permutations for each non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, HASHES), np.uint32)
    at = np.cumsum([0, *map(len, full)])[:-1]
    x = mix(np.concatenate(full))
    return np.stack([np.minimum.reduceat((x * a >> _S32).astype(np.uint32), at) for a in _STEPS], axis=1)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, null where empty), sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part, width)
                sig = iter(signatures(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "sig"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, node binary, sig binary")


def _orders(nodes: DataFrame) -> DataFrame:
    """rep, n_shingles, tree, key of nodes: the first SORTED values of each tree's order as big-endian
    bytes, which sort like the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
            for tree in range(TREES):
                own = sig[:, (np.arange(SORTED) + LEAST * tree) % HASHES].astype(">u4")
                key = pa.Array.from_buffers(pa.binary(4 * SORTED), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.full(len(own), tree, np.int32)), key], ["rep", "n_shingles", "tree", "key"])

    return nodes.select("rep", "n_shingles", "sig").mapInArrow(run, "rep long, n_shingles long, tree int, key binary")


def common_prefixes(values: np.ndarray) -> np.ndarray:
    """How many values each row shares with the one before it (0 for the first)."""
    same = np.logical_and.accumulate(values[1:] == values[:-1], axis=1).sum(axis=1)
    return np.concatenate([[0], same])


def cut_run(shared: np.ndarray, weight: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, depth) of the regions of a run of sorted neighbours: the whole run where it is light
    enough, else its parts of neighbours that share one value more, and so on. A part that shares
    all values and is still too heavy is given with depth SORTED + 1, to be sliced by the caller."""
    total = np.concatenate([[0], np.cumsum(weight)])
    waiting = [(0, len(weight), LEAST)]
    while waiting:
        a, b, depth = waiting.pop()
        if total[b] - total[a] <= limit or depth > SORTED:
            yield a, b, depth
            continue
        at = [a, *(np.flatnonzero(shared[a + 1 : b] <= depth) + a + 1).tolist(), b]
        waiting += [(x, y, depth + 1) for x, y in zip(at, at[1:])]


def _once(found: DataFrame) -> DataFrame:
    """rep, region of regions with equal members once."""
    lists = found.groupBy("region").agg(F.array_sort(F.collect_set("rep")).alias("reps")).where(F.size("reps") > 1).select("reps").distinct()
    return lists.select(F.sha2(F.array_join("reps", ","), 256).alias("region"), F.explode("reps").alias("rep"))


def candidates(nodes: DataFrame, limit: int = REGION_SHINGLES) -> tuple[DataFrame, DataFrame | None]:
    """rep, region: memberships of the regions to be searched; and rep, n_shingles of the members of
    runs that had to be cut, if any.

    Every order is sorted by ranges of its values, so a run that many documents share spreads over as
    many partitions as its deeper values allow. The parts of a light run that lies across two
    partitions have one name and meet; where a part is cut, all parts of the run count as cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        opened = True  # the first run may have begun in the partition before

        def regions(rows: list[tuple[np.ndarray, ...]], whole: bool) -> Iterator[pa.RecordBatch]:
            rep, n, tree, values = (np.concatenate(c) for c in zip(*rows))
            shared = common_prefixes(values)
            out, split = [], []
            run_name = hashlib.blake2b(values[0, :LEAST].tobytes() + bytes([int(tree[0])]), digest_size=8).hexdigest()
            for a, b, depth in cut_run(shared, n, limit):
                cut_here = depth > LEAST or len(n) >= RUN_ROWS
                if b - a > 1 or cut_here or not whole:
                    part = np.zeros(b - a, np.int64)
                    if depth > SORTED:  # equal in all values: slices of bounded weight
                        part = (np.cumsum(n[a:b]) - 1) // max(1, limit)
                    name = hashlib.blake2b(values[a, : min(depth, SORTED)].tobytes() + bytes([int(tree[a])]), digest_size=6).hexdigest()
                    name = f"{run_name}:{name}:{rep[a]}" if cut_here else run_name
                    out += [(int(rep[i]), f"{name}:{p}") for i, p in zip(range(a, b), part.tolist())]
                    if part.any():  # every slice has the smallest member
                        least = int(rep[a:b].min())
                        out += [(least, f"{name}:{p}") for p in range(1, int(part[-1]) + 1)]
                    split += [cut_here] * (len(out) - len(split))
            ids, names = zip(*out) if out else ((), ())
            weights = dict(zip(rep.tolist(), n.tolist()))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([weights[i] for i in ids], pa.int64()), pa.array(names, pa.string()), pa.array([run_name] * len(ids), pa.string()), pa.array(split, pa.bool_())],
                ["rep", "n_shingles", "region", "run", "split"],
            )

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(-1, SORTED).astype(np.uint32)
            rep, n, tree = (np.asarray(batch.column(k)).astype(np.int64) for k in range(3))
            before = held[-1] if held else None
            first = np.ones(len(rep), bool)
            first[1:] = (tree[1:] != tree[:-1]) | (values[1:, :LEAST] != values[:-1, :LEAST]).any(axis=1)
            if before is not None:
                first[0] = tree[0] != before[2][-1] or (values[0, :LEAST] != before[3][-1, :LEAST]).any()
            at = [0, *np.flatnonzero(first[1:]) + 1, len(rep)]
            for k, (a, b) in enumerate(zip(at, at[1:])):
                if held and (k or first[0]):
                    if size > 1 or opened:
                        yield from regions(held, not opened)
                    held, size, opened = [], 0, False
                held.append((rep[a:b], n[a:b], tree[a:b], values[a:b]))
                size += b - a
                if size >= RUN_ROWS:
                    yield from regions(held, False)
                    held, size, opened = [], 0, True
        if held:
            yield from regions(held, False)  # the last run may go on in the next partition

    spark = nodes.sparkSession
    rows = cut(_orders(nodes))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ORDER_ROWS)
    ordered = rows.repartitionByRange(partitions, "tree", "key").sortWithinPartitions("tree", "key", "rep")
    found = cut(ordered.mapInArrow(run, "rep long, n_shingles long, region string, run string, split boolean"))
    cut_runs = found.where("split").select("run").distinct()
    if cut_runs.isEmpty():
        return _once(found), None
    return _once(found), found.join(cut_runs, "run", "left_semi").select("rep", "n_shingles").distinct()


def _sliced(members: DataFrame, limit: int) -> DataFrame:
    """rep, region: every pair of members (rep, n_shingles, component, region) of different
    components meets in a region of bounded weight, made of two slices. Components heavier than
    a slice have slices of their own, which do not meet each other."""
    half = max(1, limit // 2)
    own = members.groupBy("region", "component").agg(F.sum("n_shingles").alias("weight"))
    light = own.where(F.col("weight") <= half).groupBy("region").agg(F.sum("weight").alias("light"))
    count = F.ceil(F.when(F.col("weight") > half, F.col("weight")).otherwise(2 * F.col("light")) / half).cast("long")
    sized = own.join(light, "region", "left").select("region", "component", F.when(F.col("weight") > half, F.col("component")).alias("pure"), count.alias("count"))
    share = F.pmod(F.xxhash64(F.when(F.col("pure").isNull(), F.col("component")).otherwise(F.col("rep"))), F.col("count"))
    placed = cut(members.join(sized, ["region", "component"]).select("rep", "region", "pure", F.xxhash64("region", F.coalesce("pure", F.lit(-1).cast("long")), share).alias("slice")))
    slices_ = placed.select("region", "slice", "pure").distinct()
    other = slices_.select("region", F.col("slice").alias("slice2"), F.col("pure").alias("pure2"))
    pairs = slices_.join(other, "region").where("slice <= slice2 AND NOT coalesce(pure = pure2, false)")
    sides = pairs.select("region", F.xxhash64("slice", "slice2").alias("pair"), F.explode(F.array_distinct(F.array("slice", "slice2"))).alias("slice"))
    return placed.join(sides, ["region", "slice"]).select("rep", F.col("pair").alias("region"))


def rarest(split: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, limit: int) -> DataFrame:
    """rep, region: regions in which each two members of ``split`` at similarity ``percent`` or more
    and of different components (``groups``) meet. With the shingles of all sets in one order,
    rarest first, such sets share one of the first size - ceil(size * percent / 100) + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, n, component, s in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(s, np.int64)
                same = [pa.array(np.full(len(own), x, np.int64)) for x in (rep, n, component)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(own)], ["rep", "n_shingles", "component", "shingle"])

    fullest = split.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"))  # rows with one id
    named = fullest.join(groups.withColumnRenamed("a", "rep"), "rep", "left").select("rep", "n_shingles", F.coalesce("b", "rep").alias("component"))
    own = maybe_broadcast(cut(named)).join(sets, "rep").where("octet_length(shingles) = 8 * n_shingles").dropDuplicates(["rep"])
    rows = cut(own.select("rep", "n_shingles", "component", "shingles").mapInArrow(run, "rep long, n_shingles long, component long, shingle long"))
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("n", "shingle"))
    first = rows.join(common, "shingle").withColumn("place", place).where(f"n > 1 AND place <= n_shingles - ceil(n_shingles * {percent} / 100) + 1")
    members = cut(first.select("rep", "n_shingles", "component", F.col("shingle").alias("region")))
    weights = members.groupBy("region").agg(F.sum("n_shingles").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    light = members.join(weights.where(F.col("weight") <= limit).select("region"), "region", "left_semi").select("rep", "region")
    heavy = members.join(weights.where(F.col("weight") > limit).select("region"), "region", "left_semi")
    return _once(light.unionByName(_sliced(heavy, limit)))


def stars(reps: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (document, smallest of its group) by exact tests: a breadth-first search over posting
    lists, in which documents already reached are no longer compared."""
    order = np.argsort(reps)
    reps, sets = reps[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    ids, flat_ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat_ids, np.cumsum(size)[:-1])
    open_ = np.ones(len(sets), bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(open_)
        if not len(live):
            return np.zeros(len(ids) + 1, np.int64), np.zeros(0, np.int64)
        token = np.concatenate([own[i] for i in live])
        by = np.argsort(token, kind="stable")
        return np.searchsorted(token[by], np.arange(len(ids) + 1)), np.repeat(live, size[live])[by]

    (at, who), built, links = postings(), len(sets), []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue and open_.any():
            i = queue.pop()
            if open_.sum() * 2 < built:
                (at, who), built = postings(), int(open_.sum())
            spans = [who[at[t] : at[t + 1]] for t in own[i].tolist()]
            shared = np.bincount(np.concatenate(spans), minlength=len(sets)) if spans else np.zeros(len(sets), np.int64)
            new = np.flatnonzero(open_ & (shared > 0) & (100 * shared >= percent * (size[i] + size - shared)))
            open_[new] = False
            links += [(int(reps[j]), int(reps[root])) for j in new]
            queue += new.tolist()
    return links


def _filter(wanted: DataFrame, seed: int = 0) -> tuple[int, bytes]:
    """A bitmap of the hashes of ids in ``rep``, of bounded size: ids that it lacks are not wanted."""
    n = wanted.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (FILTER_BITS * n).bit_length()))
    pieces = max(1, min(4096, bits >> 13))
    spot = _spot(F.col("rep"), bits, seed)
    size = bits // pieces

    def piece(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(size, np.uint8)
        own[np.asarray(rows.column("spot")) % size] = 1
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    rows = wanted.select(spot.alias("spot")).distinct().withColumn("piece", F.floor(F.col("spot") / size).cast("long"))
    held = bytearray(bits // 8)
    for r in rows.groupBy("piece").applyInArrow(piece, "piece long, bits binary").toLocalIterator():
        held[r.piece * size // 8 : (r.piece + 1) * size // 8] = r.bits
    return bits, bytes(held)


def _spot(name: Column, bits: int, seed: int) -> Column:
    place = F.xxhash64(name.cast("long")) if not seed else F.xxhash64(F.lit(seed), name.cast("long"))
    return F.pmod(place, F.lit(bits)).cast("long")


def _set(known: bytes, spot: np.ndarray) -> np.ndarray:
    """Whether the bit of each spot is set."""
    return (np.frombuffer(known, np.uint8)[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)


def _told_apart(out: DataFrame, other: DataFrame) -> list[tuple[int, object]] | None:
    """Bitmaps (bits, broadcast) by which every id of ``out`` is told from every one of ``other`` (column
    rep of both): ids in the first that are not out are in the second, those among them that are out after
    all in the third, and so on until none is left. None where the ids are too many for bitmaps of bounded
    size to tell apart."""
    held: list[tuple[int, object]] = []
    wanted, rest, before = cut(out), cut(other), None
    while True:
        bits, known = _filter(wanted, len(held) + 1)
        shared = out.sparkSession.sparkContext.broadcast(known)
        held.append((bits, shared))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_set(shared.value, np.asarray(batch.column(1))))).select([0])

        wrong = cut(rest.select("rep", _spot(F.col("rep"), bits, len(held)).alias("spot")).mapInArrow(run, "rep long"))
        n = wrong.count()
        if not n:
            return held
        if before is not None and n > before // 2:
            return None
        wanted, rest, before = wrong, wanted, n


def without(docs: DataFrame, out: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``out``; ``other`` has all other ids that there are (column
    rep). While ids can be told apart by bitmaps of bounded size, rows are judged where they are and no
    text is shuffled; beyond that they are joined."""
    held = _told_apart(out, other)
    if held is None:
        return docs.join(out.hint("shuffle_merge"), docs["doc_id"] == out["rep"], "left_anti")
    spots = F.array(*(_spot(F.col("doc_id"), bits, k + 1) for k, (bits, _) in enumerate(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds whether a row stays: it goes if it is in an odd number of bitmaps before the first that lacks it."""
        for batch in batches:
            spot = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(-1, len(held))
            inside, live = np.zeros(len(spot), np.int64), np.asarray(pc.is_valid(batch.column(batch.schema.get_field_index("doc_id"))))
            for k, (_, shared) in enumerate(held):
                live = live & _set(shared.value, spot[:, k])
                inside += live
            yield batch.filter(pa.array(inside % 2 == 0)).select(list(range(batch.num_columns - 1)))

    own = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    named = docs.toDF(*("doc_id" if c == "doc_id" else o for c, o in zip(docs.columns, own)))
    return named.withColumn("spots", spots).mapInArrow(run, named.schema).toDF(*docs.columns)


def _links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, limit: int) -> DataFrame:
    """a, b (a > b): links between representatives, contracted to the smallest of each component."""
    found, split = candidates(nodes, limit)
    members = cut(found)
    wanted = members.select("rep") if split is None else members.select("rep").unionByName(split.select("rep"))
    bits, held = _filter(cut(wanted.distinct()))
    shared = docs.sparkSession.sparkContext.broadcast(held)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _spot(F.col("doc_id"), bits, 0).alias("spot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets of candidates only: texts stay where they are, and only these sets are shuffled."""
        for batch in batches:
            batch = batch.filter(pa.array(_set(shared.value, np.asarray(batch.column(2))) & np.asarray(pc.is_valid(batch.column(0)))))
            for part in slices(batch, "text") if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part, width)], pa.binary())], ["rep", "shingles"])

    def search(key: tuple, region: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for rep, s in zip(region.column("rep").to_pylist(), region.column("shingles").to_pylist()):
            s = np.frombuffer(s, np.uint64)
            if rep not in sets or len(s) > len(sets[rep]):  # rows with one id: the fuller set
                sets[rep] = s
        found = stars(np.array(list(sets)), list(sets.values()), percent) if len(sets) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def searched(members: DataFrame) -> DataFrame:
        return members.join(sets, "rep").groupBy("region").applyInArrow(search, "a long, b long").distinct()

    sets = cut(named.mapInArrow(run, "rep long, shingles binary"))
    groups = contract(searched(members))
    if split is None:
        return groups
    again = rarest(split, sets, groups, percent, limit)
    more = cut(searched(maybe_broadcast(cut(again))))
    return groups if more.isEmpty() else contract(groups.unionByName(more))


def contract(links: DataFrame) -> DataFrame:
    """a, b: each linked node with the smallest one it reaches, by alternating large and small
    stars; every round keeps at most one row for each link."""
    links, state = cut(links), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = cut(small.where("a != b").distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            return links
        state = now


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, limit: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Sets whose similarity is ``percent`` or more are linked; a component is named by its smallest
    id and keeps that document. Null, empty and blank texts have no shingles and stand alone;
    equal sets, of any number of copies, are linked. Rows sharing an id are one document; a row
    without id is linked with nothing and kept. Other columns are not read; an empty table gives
    an empty one.
    """
    prepare(docs.sparkSession)
    rows = cut(sketch(docs, width))
    some = rows.where("node is not null and doc_id is not null")
    nodes = cut(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")))
    groups = _links(docs, nodes, width, percent, limit)
    named = nodes.join(groups.withColumnRenamed("a", "rep"), "rep", "left").select("node", "rep", "n", F.coalesce("b", "rep").alias("component"))
    # Nodes of one document that is linked with nothing need no join, nor do rows without a node.
    moved = maybe_broadcast(cut(named.where("n > 1 or component != rep").select("node", "component")))
    own = rows.select("doc_id", "n_shingles", "node")
    joined = own.where("node IS NOT NULL").join(moved, "node", "left").unionByName(own.where("node IS NULL").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of kept documents, with all their columns: texts without words and rows without id
    stay; rows of one id stay or go together; no rows give none."""
    found = cut(near_duplicates(docs, width, percent).select(F.col("doc_id").alias("rep"), "kept").distinct())
    out = cut(found.where("not kept").select("rep"))
    if out.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(out), docs["doc_id"] == out["rep"], "left_anti")
    return without(docs, out, found.where("kept AND rep IS NOT NULL").select("rep"))
