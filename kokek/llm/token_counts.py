"""Token counts of byte-level BPE vocabularies without producing identifiers.

A text's count is a sum over its blank-delimited units, and a unit's count is its initial byte
symbols minus the merges a heap over a doubly linked list performs, so no token is ever built.
Counts of units are remembered in each worker up to a bounded number of entries.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from kokek.llm.common import prepare

#: The pre-tokenisation pattern of byte-level BPE and the Unicode blanks it names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "\t-\r \x85\xa0  -     　"

_UNIT = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
_INNER = regex.compile(PATTERN)
_BITS = 17


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Maps a unit to its number of tokens; computes and remembers what it has not seen."""

    def __init__(self, vocabulary: bytes, remember: int = 800_000):
        super().__init__()
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        ids = model["vocab"]
        self.byte_id = [ids[c] for c in byte_letters()]
        self.table = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.table.setdefault(ids[a] << _BITS | ids[b], rank << _BITS | ids[a + b])
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.remember = remember

    def merged(self, data: bytes) -> int:
        """Symbols left after popping the lowest-rank adjacent pair (leftmost first) until none is in the table."""
        n = len(data)
        if n < 2:
            return n
        table, sym = self.table, [self.byte_id[b] for b in data]
        heap = []
        for i in range(n - 1):
            v = table.get(sym[i] << _BITS | sym[i + 1])
            if v is not None:
                heap.append((v, i))
        heapify(heap)
        right, left, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            v, i = heappop(heap)
            j = right[i]
            if sym[i] < 0 or j >= n or table.get(sym[i] << _BITS | sym[j]) != v:
                continue
            sym[i], sym[j] = v & ((1 << _BITS) - 1), -1
            k = right[i] = right[j]
            merges += 1
            if k < n:
                left[k] = i
                w = table.get(sym[i] << _BITS | sym[k])
                if w is not None:
                    heappush(heap, (w, i))
            h = left[i]
            if h >= 0:
                w = table.get(sym[h] << _BITS | sym[i])
                if w is not None:
                    heappush(heap, (w, h))
        return n - merges

    def __missing__(self, unit: str) -> int:
        word = unit[1:] if unit[0] == " " else unit
        pieces = [unit] if word.isalpha() else _INNER.findall(unit)
        n = self.merged(unit.encode()) if len(pieces) == 1 else sum(map(self.__getitem__, pieces))
        if len(unit) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.__getitem__, _UNIT.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, _UNIT.findall(p))) for p in parts)


_counters: dict[int, MergeCounter] = {}


def counter(vocabulary: bytes) -> MergeCounter:
    """One counter for each vocabulary and worker process."""
    key = hash(vocabulary)
    if key not in _counters:
        _counters[key] = MergeCounter(vocabulary)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts have no bytes and no tokens. Repeated rows give repeated rows, a null
    doc_id stays null, other columns are not read, an empty table gives an empty one. Texts of
    any length are processed whole; the heap keeps one unit's merging near n log n. The
    vocabulary (a fixed file of a few MB) is read on the driver and broadcast.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(shared.value).count
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = np.fromiter((tokens(t) if t else 0 for t in (x.as_py() for x in batch.column(1))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
