"""Exchange between blocks of documents and buckets of hashed keys.

Documents are dealt into blocks of bounded text; each task packs what it sends to a block into one
compressed body. A block asks every bucket about its distinct keys only, so a key that a third of
all rows share costs one entry for each block. Buckets are ranges of keys, so that what a block asks
is one ascending list of numbers, sent by their differences. A bucket merges what all blocks know
of its keys and answers each of them; the block then finishes its documents. Every exchange has as
many partitions as there is work, so that tasks stay alike at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, keys in a bucket, and bytes a task packs at once: what a task holds.
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 1_000_000
PACK_BYTES = 24 << 20
#: Most partitions of one exchange; beyond it a task takes several blocks or buckets in turn.
PARTITIONS = 20_000
ASK = pa.schema([("block", pa.int32()), ("bucket", pa.int64()), ("body", pa.binary())])
ASK_DDL = "block int, bucket long, body binary"
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Non-negative 64-bit integers, one byte plane after another."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack(sorted_keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending keys by their differences, and further columns of the same length."""
    first = planes(np.diff(sorted_keys, prepend=np.uint64(0)))
    return squeeze(len(more).to_bytes(1, "little") + first + b"".join(planes(m) for m in more))


def unpack(data: bytes) -> list[np.ndarray]:
    data = unsqueeze(data)
    n = data[0] + 1
    size = (len(data) - 1) // n
    cols = [unplanes(data[1 + k * size : 1 + (k + 1) * size]) for k in range(n)]
    return [np.cumsum(cols[0], dtype=np.uint64), *cols[1:]]


def key_bits(keys: int) -> int:
    """Bits of a hashed key: with 24 more than it takes to number all keys, one in 2^24 shares its
    hash with another; from 56 bits, where a difference of keys saves bytes, to 64."""
    return min(64, max(56, 24 + max(1, keys).bit_length()))


def in_range(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bucket of each key of ``bits`` bits: equal ranges, in order."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def deal(docs: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """block, body (its packed documents), dealt by block; and the total of words. Null texts are empty."""
    size, words = docs.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")))).first()
    n = max(1, -(-(size or 0) // (block_bytes or BLOCK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > PACK_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        rows = list(by_bucket(*[np.asarray(table.column("block"))] * 2))
        bodies = [written(table.select(["doc_id", "text"]).take(pa.array(k))) for _, k in rows]
        return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array(bodies, pa.binary())], ["block", "body"])

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), block)
    return rows.mapInArrow(run, "block int, body binary").repartition(min(n, PARTITIONS), "block"), words or 0


def written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(bodies: pa.ChunkedArray) -> pa.Table:
    """doc_id, text of a block's bodies."""
    tables = [pa.ipc.open_stream(b).read_all() for b in bodies.to_pylist()]
    return pa.concat_tables(tables).cast(DOCS) if tables else DOCS.empty_table()


def exchange(
    dealt: DataFrame,
    buckets: int,
    ask: Callable[[pa.Table], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], Iterator[tuple[int, bytes]]],
    finish: Callable[[pa.Table, dict[int, bytes]], pa.Table],
    result: str,
) -> DataFrame:
    """``ask`` gives (bucket, body) of a block; ``answer`` gets one bucket's bodies and gives (index
    of the body, reply); ``finish`` gets a block with the replies by bucket."""

    def table(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, ASK)], schema=ASK)

    def asking(key: tuple, block: pa.Table) -> pa.Table:
        return table([(key[0].as_py(), bucket, body) for bucket, body in ask(unpacked(block.column("body")))])

    def answering(key: tuple, asks: pa.Table) -> pa.Table:
        blocks = asks.column("block").to_pylist()
        return table([(blocks[k], key[0].as_py(), body) for k, body in answer(asks.column("body").to_pylist())])

    def finishing(block: pa.Table, replies: pa.Table) -> pa.Table:
        return finish(unpacked(block.column("body")), dict(zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist())))

    asks = dealt.groupBy("block").applyInArrow(asking, ASK_DDL)
    answers = asks.repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(answering, ASK_DDL)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finishing, result)


def by_bucket(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with the indices of their keys, in the order of the keys."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part
