"""Compression of vectors to codes of their parts, learnt and assigned in integers.

Components become integers, vectors are cut into equal parts, and each position of a part has a
codebook of at most ``ENTRIES`` entries. The nearest entry is found in two steps: one float32 matrix
product screens all entries, with an interval around each distance that rounding cannot leave, and
entries whose interval overlaps the best one are measured again in int64, ties going to the lower
index. Codebooks are of fixed size and are sent along with each round; a round's sums are made in the
tasks, and only they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kokek.llm.common import cut, maybe_broadcast, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances that are screened at once.
HELD = 1 << 20
#: Vectors that reach a task at once.
BATCH = 4096
_U = 2.0**-24


def whole_vector(column: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of each component, a row for each vector. Scaling by a power of two is exact in
    float64; a component whose squared distances could not be written as a long raises ValueError."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = np.floor(flat * SCALE).reshape(len(column), -1)
    if x.size and np.abs(x).max() >= 2.0 ** (29 - x.shape[1].bit_length() // 2):
        raise ValueError("components are too large for exact errors in 64 bits")
    return x.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of the entry at the smallest squared distance from each row, the lowest of equal ones."""
    out = np.empty(len(x), np.int64)
    width, own = x.shape[1], entries.astype(np.float32)
    square, norm = (entries * entries).sum(axis=1).astype(np.float64), np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
    # A product of n terms errs by at most gamma(n) times the sum of its terms' sizes, in any order of summing;
    # two roundings more turn integers into float32. Sizes are bounded by norms; the rest is float64's share.
    gamma = (width + 3) * _U / (1 - (width + 3) * _U)
    step = max(1, HELD // len(entries))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        sizes = np.sqrt((part * part).sum(axis=1).astype(np.float64))
        middle = square - 2.0 * (part.astype(np.float32) @ own.T).astype(np.float64)
        error = 2.0 * gamma * sizes[:, None] * norm * (1 + 1e-6) + 1e-12 * (square + np.abs(middle))
        open_ = middle - error <= (middle + error).min(axis=1, keepdims=True)
        best = open_.argmax(axis=1)
        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(unsure):
            row, entry = np.nonzero(open_[unsure])
            exact = ((part[unsure][row] - entries[entry]) ** 2).sum(axis=1)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.repeat(np.minimum.reduceat(exact, begin), np.diff(np.append(begin, len(row))))
            hit = np.flatnonzero(exact == least)
            best[unsure] = entry[hit[np.searchsorted(row[hit], np.arange(len(unsure)))]]
        out[a : a + step] = best
    return out


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


def _least(rows: list[tuple[int | None, list[float]]], entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, the smaller vector of each; without any id the least vector."""
    by: dict[int, list[float]] = {}
    for name, vec in rows:
        if name is not None:
            by[name] = min(by.get(name, vec), vec)
    return [by[name] for name in sorted(by)[:entries]] or [min(vec for _, vec in rows)] if rows else []


def _seen(entries: int):
    """Of each task the vectors that may begin a codebook, and the smallest and largest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spans = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0).cast(pa.int64())
            size = np.asarray(pc.list_value_length(batch.column(1)))
            spans += [int(size.min()), int(size.max())]
            some = np.asarray(pc.is_valid(name))
            ids = np.asarray(name.fill_null(0))
            limit = np.partition(np.unique(ids[some]), entries - 1)[entries - 1] if len(np.unique(ids[some])) > entries else np.iinfo(np.int64).max
            pick = np.flatnonzero(some & (ids <= limit)) if some.any() else np.arange(len(ids))
            held += list(zip([x if ok else None for x, ok in zip(ids[pick].tolist(), some[pick])], batch.column(1).take(pa.array(pick)).to_pylist()))
            named = [(n, v) for n, v in held if n is not None]
            last = sorted({n for n, _ in named})[:entries]
            least = dict(zip(last, _least(named, entries))) if named else {}
            held = list(least.items()) if named else [(None, min(v for _, v in held))]
        if held:
            ids, vecs = zip(*held)
            bounds = [pa.array([x] * len(ids), pa.int32()) for x in (min(spans), max(spans))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64())), *bounds], ["vec_id", "vec", "low", "high"])

    return run


def _summed(codebooks: np.ndarray):
    """Sums and counts of the parts nearest to each entry, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = codebooks.shape
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = _split(integers(batch.column(0)), parts)
            for p in range(parts):
                code = nearest(x[:, p], codebooks[p])
                counts[p] += np.bincount(code, minlength=k)
                np.add.at(sums[p], code, x[:, p])
        spot = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(counts.ravel()[spot]), pa.array(sums.reshape(-1, width)[spot].tolist(), pa.list_(pa.int64()))], ["spot", "n", "sums"])

    return run


def learnt(vectors: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) after ``rounds`` of assigning all vectors and replacing
    entries by the floors of their parts' means; entries without parts stay."""
    parts, k, width = codebooks.shape
    for _ in range(rounds):
        rows = vectors.select("vec").mapInArrow(_summed(codebooks), "spot long, n long, sums array<long>")
        # A sum over all tasks may leave 64 bits; the driver gets one row for each entry.
        total = rows.groupBy("spot").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)))
        codebooks = codebooks.copy()
        for r in total.collect():
            codebooks[divmod(r.spot, k)] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return codebooks


def fingerprint(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is whole.

    Codebooks begin with the vectors of the smallest ids (of rows with one id, the smaller vector);
    with fewer vectors they have fewer entries. Rows without vector, or with a null or non-finite
    component, go; a null id takes part but begins no entry; null labels are one label; repeated rows
    stay. Of a table without whole vectors nothing is returned. Vectors must have one length, a
    multiple of ``parts``, else ValueError, as there are no equal parts. Other columns are not read.
    """
    spark = prepare(table.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    vectors = table.select(table[id_column].alias("vec_id"), table[column].alias("vec"), table[label].alias("label")).where(whole_vector(F.col("vec")))
    seen = vectors.mapInArrow(_seen(entries), "vec_id long, vec array<double>, low int, high int").collect()  # a few rows of each task
    names = "vec_id long, label string, code string, error long"
    low, high = min((r.low for r in seen), default=0), max((r.high for r in seen), default=0)
    if seen and (low != high or low % parts or not low):
        raise ValueError(f"vectors of {low} to {high} components cannot be cut into {parts} equal parts")
    first = _least([(r.vec_id, r.vec) for r in seen], entries)
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    begun = integers(pa.array(first, pa.list_(pa.float64())))
    codebooks = learnt(vectors, _split(begun, parts).transpose(1, 0, 2).copy(), rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _split(integers(batch.column(2)), parts)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                own = nearest(x[:, p], codebooks[p])
                codes[:, p] = own
                error += ((x[:, p] - codebooks[p][own]) ** 2).sum(axis=1)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    rows = cut(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "vec").mapInArrow(coded, names))
    by = cut(rows.groupBy(F.col("label").alias("named")).agg(F.sum("error").alias("label_error")))
    met = rows.join(maybe_broadcast(by), rows["label"].eqNullSafe(by["named"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
