"""Quality rules: fixed rules on words and lines, and perplexity bands of a character model.

The model is an interpolated modified Kneser-Ney model of order 4 over characters, one for each
language. Spark counts the n-grams of all documents and works out all probabilities relationally,
so that no task holds a language's table. Documents are scored by the model of their own counts, which
has every n-gram they show: HELD_SCORES of the most frequent ones are looked up in a broadcast, and the
places of rarer ones, if there are more, by a join. Both take the same numbers from the same table, so a
document's score depends on no size. ``train`` gives a model as sorted arrays, for other texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kokek.llm.common import cut, maybe_broadcast, prepare
from kokek.llm.textkit import Words, flat, mix, per_row, slices, windows

#: A character takes 16 bits of a code: its code point, or one of 2,048 surrogates for those beyond the basic plane.
ORDER, BITS = 4, 16
ALPHABET = 1 << BITS
LINE = 10
#: A limit for the n-grams (of all orders) in a language's model that ``train`` may be given; the verdicts have none.
MODEL_GRAMS = 3_000_000
#: Scores of n-grams (12 bytes each, of all languages) that are broadcast; the others are joined.
HELD_SCORES = 4_000_000
#: Different n-grams a task holds before it hands on what it has counted.
HELD_GRAMS = 2_000_000
#: Whiskers of the bands, in interquartile ranges of a language's log perplexities.
WHISKERS = 3.0
#: Log probabilities are multiples of 1 / GRID, so that sums are exact in any order of rows.
GRID = 1 << 16
#: Decimals of the log perplexities whose quartiles are taken: bounds the distinct ones held.
DECIMALS = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def gram_codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the 4-grams ending at each character, and where each text's begin. Every text
    is preceded by line ends, so its first characters have contexts too."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin = per_row((raw & 0xC0) != 0x80, at)
    first = np.concatenate([[0], np.cumsum(begin)])
    c = np.where(points < ALPHABET, points, 0xD800 + points % 2048).astype(np.uint64)
    code = c.copy()
    place = np.arange(len(c)) - np.repeat(first[:-1], begin)
    for k in range(1, ORDER):
        back = np.empty_like(c)
        back[k:] = c[:-k] if len(c) > k else 0
        back[place < k] = LINE
        code |= back << np.uint64(BITS * k)
    return code, first


def lang_key(lang: str | None) -> str:
    """A language's name among the models: null has one of its own, apart from every string."""
    return "\0" if lang is None else "\0" + lang if lang.startswith("\0") else lang


def _lang_key(lang: F.Column | None = None) -> F.Column:
    lang, mark = F.col("lang") if lang is None else lang, F.lit("\0")
    return F.when(lang.isNull(), mark).when(F.startswith(lang, mark), F.concat(mark, lang)).otherwise(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, code, n of 4-grams over all documents; a task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def settle() -> int:
            for lang, codes in fresh.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], code])
                    code, place = np.unique(both, return_inverse=True)
                    n = np.bincount(place, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = code, n
            fresh.clear()
            return sum(len(code) for code, _ in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (code, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column(0).to_pylist()
                code, first = gram_codes(*flat(part.column(1)))
                for lang in sorted(set(langs)):
                    rows = np.repeat(np.array([x == lang for x in langs]), np.diff(first))
                    fresh.setdefault(lang, []).append(code[rows])
                waiting += len(code)
                if waiting > HELD_GRAMS // 2:
                    waiting = 0
                    if settle() > HELD_GRAMS:
                        yield from out()
        settle()
        yield from out()

    named = docs.select(_lang_key().alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _lower(order: int) -> F.Column:
    """The code of an n-gram without its first character."""
    return F.col("code").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, ord, code, ctx (its context's code), n, p, lower_p, spare of every seen n-gram: modified
    Kneser-Ney, where shorter n-grams count their different left neighbours. ``spare`` is the share
    that the context leaves to the shorter n-gram."""
    held, levels = counts.withColumn("ord", F.lit(ORDER)), []
    for order in range(ORDER, 0, -1):
        levels.insert(0, held)
        held = held.groupBy("lang", _lower(order).alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("ord", F.lit(order - 1))
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    rows = cut(rows.withColumn("ctx", F.shiftrightunsigned("code", BITS)))
    n = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]
    of_counts = rows.groupBy("lang", "ord").agg(*n)
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    discount = [
        F.least(F.greatest(F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5 * k), F.lit(k * 0.05)), F.lit(k - 0.05)).alias(f"d{k}")
        for k in (1, 2, 3)
    ]
    discounts = maybe_broadcast(cut(of_counts.select("lang", "ord", *discount)))
    many = [F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b"), F.count_if(F.col("n") > 2).alias("c")]
    contexts = rows.groupBy("lang", "ord", "ctx").agg(F.sum("n").alias("total"), *many).join(discounts, ["lang", "ord"])
    contexts = contexts.withColumn("spare", (F.col("a") * F.col("d1") + F.col("b") * F.col("d2") + F.col("c") * F.col("d3")) / F.col("total"))
    contexts = cut(contexts.select("lang", "ord", "ctx", "total", "d1", "d2", "d3", "spare"))
    every, shorter = None, None
    for order in range(1, ORDER + 1):
        level = rows.where(F.col("ord") == order).join(contexts.where(F.col("ord") == order).drop("ord"), ["lang", "ctx"])
        level = level.withColumn("low", _lower(order))
        if shorter is None:
            level = level.withColumn("lower_p", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(shorter.select("lang", F.col("code").alias("low"), F.col("p").alias("lower_p")), ["lang", "low"])
        cost = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = (F.col("n") - cost) / F.col("total") + F.col("spare") * F.col("lower_p")
        shorter = cut(level.select("lang", "ord", "code", "ctx", "n", p.alias("p"), "lower_p", "spare"))
        every = shorter if every is None else every.unionByName(shorter)
    return every


def kept_grams(grams: DataFrame, limit: int) -> DataFrame:
    """The n-grams of a model whose user asked for a limit: of a language with more than ``limit``, those of orders 3 and 4 whose
    count is above the least bound (a power of 2^(1/4)) that leaves few enough. Orders 1 and 2 stay."""
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = grams.groupBy("lang", (F.col("ord") < 3).alias("short"), step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred rows a language
    bounds = []
    for lang in sorted({r.lang for r in steps}):
        left = limit - sum(r.n for r in steps if r.lang == lang and r.short)
        for r in sorted((r for r in steps if r.lang == lang and not r.short), key=lambda r: -r.step):
            left -= r.n
            if left < 0:
                bounds.append((lang, r.step + 1))
                break
    if not bounds:
        return grams
    least = maybe_broadcast(grams.sparkSession.createDataFrame(bounds, "lang string, bound int"))
    return grams.join(least, "lang", "left").where((F.col("ord") < 3) | (step >= F.coalesce("bound", F.lit(-1)))).drop("bound")


def gram_hash(order: int, code: np.ndarray, context: bool = False) -> np.ndarray:
    return mix(code.astype(np.uint64) ^ mix(np.array([order << 1 | int(context)], np.uint64)))


class Model:
    """Sorted hash arrays of one language, read by binary search; a direct-mapped table of the last codes
    seen in each of its slots stands before it."""

    SLOTS = 18

    def __init__(self, keys: bytes, values: bytes):
        self.keys, self.values = np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32)
        self.code, self.log = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, np.nan)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return hit, np.where(hit, self.values[at], np.float32(0)).astype(float)

    def _learn(self, codes: np.ndarray) -> np.ndarray:
        out, rest = np.zeros(len(codes)), np.ones(len(codes), bool)
        for order in range(ORDER, 0, -1):
            own = codes & np.uint64((1 << BITS * order) - 1)
            hit, p = self._find(gram_hash(order, own))
            out += np.where(rest & hit, p, 0)
            rest &= ~hit
            out += np.where(rest, self._find(gram_hash(order, own >> np.uint64(BITS), True))[1], 0)
        return np.round((out - np.where(rest, math.log(ALPHABET), 0)) * GRID) / GRID

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """The log probability of each 4-gram's last character after the others."""
        slot = (mix(codes) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.log[slot]
        new = np.flatnonzero((self.code[slot] != codes) | np.isnan(out))
        if len(new):
            own, place = np.unique(codes[new], return_inverse=True)
            learnt = self._learn(own)
            out[new] = learnt[place]
            slot = (mix(own) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            _, one = np.unique(slot, return_index=True)  # two codes of one slot: the first stays
            self.code[slot[one]], self.log[slot[one]] = own[one], learnt[one]
        return out


class Held(Model):
    """Grid steps of one language's n-grams by their codes; an n-gram that it lacks has the log probability 1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        super().__init__(b"", b"")
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def _learn(self, codes: np.ndarray) -> np.ndarray:
        hit, step = self._find(codes)
        return np.where(hit, step / GRID, 1.0)


def train(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """lang, keys, vals (sorted arrays as bytes), size: one row for each language. All n-grams are in it, unless
    there are more than a ``limit``: then the rarest are pruned, and back-off weights follow."""
    prepare(docs.sparkSession)
    grams = probabilities(cut(count_grams(docs)))
    grams = grams if limit is None else kept_grams(grams, limit)
    # What a context leaves to shorter n-grams: its spare share, or more where n-grams of it were pruned.
    left = (1 - F.sum("p")) / (1 - F.sum("lower_p"))
    weights = grams.groupBy("lang", "ord", "ctx").agg(F.greatest(F.first("spare"), left, F.lit(1e-9)).alias("p"))
    rows = grams.select("lang", "ord", "code", F.col("p"), F.lit(False).alias("context")).unionByName(weights.select("lang", "ord", F.col("ctx").alias("code"), "p", F.lit(True).alias("context")))

    def stored(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, values = [], []
        for (order, context), part in pdf.groupby(["ord", "context"]):
            keys.append(gram_hash(order, part["code"].to_numpy(np.int64).view(np.uint64), context))
            values.append(np.log(part["p"].to_numpy()))
        keys, values = np.concatenate(keys), np.concatenate(values).astype(np.float32)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "keys": [keys.tobytes()], "vals": [values.tobytes()], "size": [keys.nbytes + values.nbytes]})

    return cut(rows.groupBy("lang").applyInPandas(stored, "lang string, keys binary, vals binary, size long"))


def learnt(docs: DataFrame) -> DataFrame:
    """lang, code, n, step of every 4-gram in the documents: its log probability is ``step`` / GRID."""
    grams = probabilities(cut(count_grams(docs))).where(F.col("ord") == ORDER)
    return cut(grams.select("lang", "code", "n", F.rint(F.log("p") * GRID).cast("int").alias("step")))


def shares(grams: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The n-grams whose scores are broadcast, at most HELD_SCORES by the least bound of their counts (a power of
    2^(1/4)), and the others, which are the rarer ones; None if there are no others."""
    level = F.floor(F.log2("n") * 4).cast("int")
    left, bound = HELD_SCORES, None
    for r in sorted(grams.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):  # 252 levels at most
        left -= r.n
        if left < 0:
            bound = r.level + 1
            break
    return (grams, None) if bound is None else (grams.where(level >= bound), grams.where(level < bound))


_loaded: dict[str, dict[str, Held]] = {}


def _metrics(texts: pa.Array, langs: list[str], models: dict[str, Held]) -> dict[str, pa.Array]:
    """The rules' figures of each text, its characters, the sum of the log probabilities that its language's
    broadcast has, and the codes that it lacks, at every place."""
    raw, at = flat(texts)
    w = Words(raw, at)
    h = w.hashes()
    solid = np.zeros(len(raw) + 1, np.int64)
    solid[w.start] += 1
    np.subtract.at(solid, w.end, 1)
    inside = np.cumsum(solid[:-1]) > 0
    chars = per_row(inside & ((raw & 0xC0) != 0x80), at)
    symbols = per_row(_SYMBOL[raw], at)
    g, k = windows(h, w, 5)
    g = mix(g ^ w.doc[k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    s = np.sort(g)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    covered = np.zeros(len(h) + 1, np.int64)
    if len(twice):
        spot = k[twice[np.minimum(np.searchsorted(twice, g), len(twice) - 1)] == g]
        np.add.at(covered, spot, 1)
        np.subtract.at(covered, spot + 5, 1)
    repeated = per_row(np.cumsum(covered[:-1]) > 0, w.first)
    lines = np.zeros(len(at) - 1, np.int64)
    data = raw.tobytes()
    for i in range(len(lines)):
        own = [x for x in data[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        lines[i] = len(own) - len(set(own))
    code, first = gram_codes(raw, at)
    log = np.ones(len(code))
    for lang in set(langs):
        model = models.get(lang)
        if model is not None:
            own = np.repeat(np.array([x == lang for x in langs]), np.diff(first))
            log[own] = model.logs(code[own])
    lacks = log > 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(lacks, 0, log))])
    rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lacks)])[first].astype(np.int32)), pa.array(code[lacks].view(np.int64)))
    n = w.count
    found = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated,
        "base_failed": (n < 10) | (100 * repeated > 20 * n), "n_chars": np.diff(first), "total": sums[first[1:]] - sums[first[:-1]],
    }
    return {name: pa.array(x) for name, x in found.items()} | {"rest": rest}


def _scorer(held: DataFrame) -> Callable[[], dict[str, Held]]:
    """A function for tasks that gives the scores in ``held`` by language."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code, step = batch.column(0).dictionary_encode(), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            place = np.asarray(names.indices)
            own = [place == k for k in range(len(names.dictionary))]
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.array([code[x].tobytes() for x in own], pa.binary()), pa.array([step[x].tobytes() for x in own], pa.binary())], ["lang", "keys", "vals"])

    rows = held.select("lang", "code", "step").mapInArrow(packed, "lang string, keys binary, vals binary").collect()  # HELD_SCORES at most
    name = uuid.uuid4().hex
    shared = held.sparkSession.sparkContext.broadcast([(r["lang"], bytes(r["keys"]), bytes(r["vals"])) for r in rows])

    def loaded() -> dict[str, Held]:
        if name not in _loaded:
            parts: dict[str, tuple[list[bytes], list[bytes]]] = {}
            for lang, keys, values in shared.value:
                own = parts.setdefault(lang, ([], []))
                own[0].append(keys)
                own[1].append(values)
            _loaded.clear()
            _loaded[name] = {lang: Held(np.frombuffer(b"".join(k), np.uint64), np.frombuffer(b"".join(v), np.int32)) for lang, (k, v) in parts.items()}
        return _loaded[name]

    return loaded


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_RULES = [x.split()[0] for x in _FIGURES.split(", ")]


def _text_key(docs: DataFrame) -> F.Column:
    """A name for a row's language and text, on which alone its verdict depends."""
    return F.md5(F.concat(F.md5(_lang_key(docs["lang"])), F.coalesce(docs["text"], F.lit(""))))


def score(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, lang (as ``lang_key`` writes it), key (of ``_text_key``), the rules' figures and log_perplexity of
    every row, by the ``learnt`` n-grams of the same documents; texts without characters have log perplexity 0."""
    held, others = shares(grams)
    loaded, names = _scorer(held), [*_RULES, "n_chars", "total", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = _metrics(part.column("text"), part.column("lang").to_pylist(), loaded())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(m[x] for x in names)], ["doc_id", "lang", "key", *names])

    key = F.lit("") if others is None else _text_key(docs)  # asked for only where rows cannot be judged in place
    named = docs.select("doc_id", _lang_key().alias("lang"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = named.mapInArrow(run, f"doc_id long, lang string, key string, {_FIGURES}, n_chars long, total double, rest array<long>")
    if others is not None:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        late = rows.select("row", "lang", F.explode("rest").alias("code")).groupBy("row", "lang", "code").agg(F.count(F.lit(1)).alias("times"))
        late = late.join(others.select("lang", "code", "step"), ["lang", "code"]).groupBy("row").agg(F.sum(F.col("times") * F.col("step")).alias("late"))
        rows = rows.join(late, "row", "left").withColumn("total", F.col("total") + F.coalesce("late", F.lit(0)) / GRID)
    return rows.select("doc_id", "lang", "key", *_RULES, (-F.col("total") / F.greatest("n_chars", F.lit(1))).alias("log_perplexity"))


def bands(scored: DataFrame, whiskers: float = WHISKERS) -> DataFrame:
    """lang, low, high: exact quartiles of the documents that pass the rules, widened by whiskers;
    the same for any order and partitioning of the rows."""
    q = F.percentile(F.round("log_perplexity", DECIMALS), [0.25, 0.75])
    quarter = scored.where("not base_failed").groupBy("lang").agg(q.alias("q"))
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.02)) * whiskers
    return quarter.select("lang", (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))


def quality(docs: DataFrame, whiskers: float = WHISKERS) -> DataFrame:
    """doc_id, the rules' figures, base_failed, kept, perplexity of every row.

    A document is kept when it passes the rules (10 words or more, at most a fifth of its words
    in repeated 5-word windows) and its perplexity lies in its language's band. Null texts have no
    words and fail, also in a language that has no other texts; a null language is a
    language of its own, apart from ''. Repeated rows are judged alike; a language without a passing document has no band and rejects nothing more. Other columns
    are not read; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    scored = cut(score(docs, learnt(docs)))
    limits = cut(bands(scored, whiskers))
    joined = scored.join(maybe_broadcast(limits), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), F.round(F.exp("log_perplexity"), 6).alias("perplexity"),
    )


def passing(docs: DataFrame, whiskers: float = WHISKERS) -> DataFrame:
    """The kept rows with all their columns; judged in place, so that texts are not shuffled, while all n-grams
    fit the broadcast; beyond, rejected texts are taken out by a join. Rows without text go; repeated rows
    stay or go together; no rows give none. Without a column ``lang`` or ``text`` this is an error of
    Spark's, as the rules ask for both."""
    prepare(docs.sparkSession)
    grams = learnt(docs)
    held, others = shares(grams)
    if others is not None:
        scored = cut(score(docs, grams))
        inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
        judged = scored.join(maybe_broadcast(cut(bands(scored, whiskers))), "lang", "left")
        gone = cut(judged.where(F.col("base_failed") | ~inside).select("key").distinct())
        return docs.join(maybe_broadcast(gone), _text_key(docs) == gone["key"], "left_anti")
    band = {r["lang"]: (r["low"], r["high"]) for r in bands(score(docs, grams), whiskers).collect()}
    loaded = _scorer(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs = [lang_key(x) for x in part.column("lang").to_pylist()]
                m = {name: np.asarray(x) for name, x in _metrics(part.column("text"), langs, loaded()).items() if name in ("base_failed", "n_chars", "total")}
                lo, hi = np.array([band.get(x, (-np.inf, np.inf)) for x in langs], dtype=float).T
                log = -m["total"] / np.maximum(m["n_chars"], 1)
                yield part.filter(pa.array(~m["base_failed"] & (log >= lo) & (log <= hi)))

    return docs.mapInArrow(run, docs.schema)
