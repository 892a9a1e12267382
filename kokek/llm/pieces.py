"""SentencePiece encoding and decoding.

``encode_units`` is the relational lattice: bounded substrings of distinct units are joined to
the piece table, edges are grouped by unit, and a higher-order ``aggregate`` folds them. A Viterbi
fold gives the wrong pieces for a BPE model, whose scores are merge priorities and not log
probabilities, so the fold merges by priority there. ``encode`` does the same merging for whole
documents in Arrow batches, remembering units, because joining every unit back to its place in
every document would shuffle several times the input.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kokek.llm.common import prepare

MARK = "▁"
#: A unit: blanks with the word after them; no piece of the supported models goes beyond one.
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNKNOWN, BYTE, BPE = 1, 2, 6, 2
#: Symbols up to which pairs are searched in a list; their cost if they are no piece.
SHORT, NEVER = 48, float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class PieceTable:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @classmethod
    def parse(cls, model: bytes) -> PieceTable:
        """Reads a .model file; only BPE models with an identity normaliser and a dummy prefix."""
        table, trainer, normal = cls([], [], []), {}, {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                table.pieces.append(own[1].decode())
                table.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                table.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != BPE or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1):
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in table.pieces):
            raise ValueError("pieces that hold blanks after letters are not supported")
        return table


class Encoder(dict):
    """Maps a unit to its piece ids as little-endian 32-bit bytes; computes and remembers what it has
    not seen. Units live in two generations, so that frequent ones stay when the older one goes."""

    def __init__(self, table: PieceTable, remember: int = 150_000):
        super().__init__()
        self.table, self.remember, self.older = table, remember, {}
        self.rank = {p: (-s, i) for i, (p, s, k) in enumerate(zip(table.pieces, table.scores, table.kinds)) if k == NORMAL}
        self.cost, self.index = {p: c for p, (c, _) in self.rank.items()}, {p: i for p, (_, i) in self.rank.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(table.pieces, table.kinds)) if k == BYTE}
        self.unknown = table.kinds.index(UNKNOWN)
        self.plain = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else b"" for p, k in zip(table.pieces, table.kinds)]

    def fallback(self, symbol: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in symbol.encode()] if self.byte else [self.unknown]

    def merge(self, unit: str) -> list[int]:
        """Merges the adjacent pair of the best score (leftmost first) until none is a piece."""
        n, sym, rank = len(unit), list(unit), self.rank
        if n <= SHORT:
            return self.merge_short(sym)
        heap = [(s[0], i, 2) for i in range(n - 1) if (s := rank.get(unit[i : i + 2]))]
        heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, size = heappop(heap)
            j = right[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i], sym[j] = sym[i] + sym[j], None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if s := rank.get(sym[i] + sym[k]):
                    heappush(heap, (s[0], i, len(sym[i]) + len(sym[k])))
            h = left[i]
            if h >= 0 and (s := rank.get(sym[h] + sym[i])):
                heappush(heap, (s[0], h, len(sym[h]) + len(sym[i])))
        out = []
        for x in sym:
            if x is not None:
                out += [rank[x][1]] if x in rank else self.fallback(x)
        return out

    def merge_short(self, sym: list[str]) -> list[int]:
        """The same for few symbols: the costs of all pairs are kept in a list, without a heap."""
        cost, index = self.cost.get, self.index
        pair = [cost(a + b, NEVER) for a, b in zip(sym, sym[1:])]
        while pair:
            best = min(pair)
            if best == NEVER:
                break
            i = pair.index(best)
            sym[i] += sym.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = cost(sym[i - 1] + sym[i], NEVER)
            if i < len(pair):
                pair[i] = cost(sym[i] + sym[i + 1], NEVER)
        out = []
        for x in sym:
            k = index.get(x)
            out += self.fallback(x) if k is None else (k,)
        return out

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            merged = self.merge(unit)
            ids = struct.pack(f"<{len(merged)}i", *merged)
        if len(unit) <= 64:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join([self[u] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.plain[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_encoders: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(PieceTable.parse(model))
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), round_trip, and ids if asked for.

    ``round_trip`` says that the decoded ids are the text, with its plain form of the blank mark.
    Null and empty texts have no pieces. Texts are encoded whole; repeated rows alike; null ids
    stay null; other columns are not read; an empty table gives an empty one. The model (a fixed
    file below a few MB) is read on the driver and broadcast.
    """
    with open(model_path, "rb") as file:
        shared = prepare(docs.sparkSession).sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [own.encode(t) for t in texts]
            cols = [
                batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                pa.array([own.decode(x) == t.replace(MARK, " ") for x, t in zip(found, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(found, pa.list_(pa.int32()))] if ids else [])], ["doc_id", "n_pieces", "ids_sha256", "round_trip", *(["ids"] if ids else [])])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of rows with ids; null ids give null."""
    with open(model_path, "rb") as file:
        shared = prepare(encoded.sparkSession).sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_units(units: DataFrame, model_path: str) -> DataFrame:
    """unit, pieces (array of piece strings; a symbol outside the table stands for its bytes) of the
    distinct units in column ``unit``, by relational operators alone.

    Fit for units of ordinary length: the fold takes one step for each symbol and looks through
    all edges of its unit. Null and empty units are dropped.
    """
    with open(model_path, "rb") as file:
        table = PieceTable.parse(file.read())
    rows = [(p, float(s)) for p, s, k in zip(table.pieces, table.scores, table.kinds) if k == NORMAL]
    longest = max(len(p) for p, _ in rows)
    known = F.broadcast(units.sparkSession.createDataFrame(rows, "piece string, score double"))  # a fixed vocabulary
    distinct = units.select("unit").where("length(unit) > 0").distinct().withColumn("n", F.length("unit"))
    starts = distinct.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("n - s > 1")
    ends = starts.withColumn("e", F.explode(F.expr(f"sequence(s + 2, least(n, s + {longest}))")))
    edges = ends.withColumn("piece", F.expr("substring(unit, s + 1, e - s)")).join(known, "piece")
    lattice = edges.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "s", "e"))).alias("edges"))
    both = distinct.join(lattice, "unit", "left").withColumn("edges", F.coalesce("edges", F.expr("array()").cast("array<struct<cost:double,s:int,e:int>>")))
    fold = """aggregate(if(n > 1, sequence(1, n - 1), array()), sequence(0, n), (b, step) ->
      transform(array(get(filter(edges, x -> array_position(b, x.e) - array_position(b, x.s) = 2 and array_position(b, x.s) > 0), 0)),
        best -> if(best is null, b, filter(b, x -> x <= best.s or x >= best.e)))[0])"""
    cut = both.withColumn("b", F.expr(fold))
    return cut.select("unit", F.expr("transform(sequence(1, size(b) - 1), i -> substring(unit, b[i - 1] + 1, b[i] - b[i - 1]))").alias("pieces"))


def encode_by_lattice(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 as of ``encode``, by relational operators alone: units are exploded,
    the distinct ones encoded by ``encode_units``, and joined back to their places. Ids have to differ."""
    with open(model_path, "rb") as file:
        table = PieceTable.parse(file.read())
    own = Encoder(table)
    spark = docs.sparkSession
    text = F.concat(F.lit(MARK), F.replace("text", F.lit(" "), F.lit(MARK)))
    placed = docs.where("length(text) > 0").select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(f"({MARK}*[^{MARK}]+|{MARK}+)"), F.lit(1))).alias("place", "unit"))
    known = F.broadcast(spark.createDataFrame([(p, i) for p, (_, i) in own.rank.items()], "piece string, id int"))  # a fixed vocabulary
    spelled = F.array(*(F.lit(own.byte.get(b, own.unknown)) for b in range(256))) if own.byte else F.array_repeat(F.lit(own.unknown), 256)
    size = "octet_length(piece)" if own.byte else "1"
    # A single unit's pieces, each with its id or, outside the vocabulary, with those of its bytes.
    each = encode_units(placed.select("unit"), model_path).select("unit", F.posexplode("pieces").alias("k", "piece")).join(known, "piece", "left")
    each = each.withColumn("spelled", spelled).withColumn("ids", F.expr(f"IF(id IS NOT NULL, array(id), transform(sequence(1, {size}), i -> spelled[int(conv(hex(substring(encode(piece, 'utf-8'), i, 1)), 16, 10))]))"))
    units = each.groupBy("unit").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("ids"))
    found = placed.join(units, "unit").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x.ids)).alias("ids"))
    hexed = F.transform("ids", lambda x: F.lpad(F.hex(x), 8, "0"))
    little = F.array_join(F.transform(hexed, lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))), "")
    every = docs.select("doc_id").join(found, "doc_id", "left").withColumn("ids", F.coalesce("ids", F.expr("CAST(array() AS array<int>)")))
    return every.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.unhex(little), 256).alias("ids_sha256"))
