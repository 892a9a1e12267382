"""The neural ranker: a transformer encoder over suffix chains, in numpy.

Scoring runs in Arrow batches on the executors with broadcast weights (about 1 M numbers), once for
each distinct chain. Training takes labelled words in chunks, and some chunks a round: each of a few tasks sums
the gradients of its chunks, and the driver, which holds the weights and the optimiser's moments, adds those
sums and takes one step. Words that training sees no difference between are worked on once, with their number
as weight. A few labelled words are trained on where the driver is, by the same rounds. The gradients come
from a small tape: every step of the forward pass notes how to run it backwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut
from kokek.functions.suffixes import SUFFIXES
from kokek.operators.rank import MARGIN, STEPS, TEMPERATURE, encode_chain

#: Most labelled words (with all their candidates) that ``fit`` takes to the driver, in the order of a hash.
TRAIN_WORDS = 2_000
#: Candidates scored together, candidates trained on together (a word's stay together), and labelled words of one chunk on average.
SCORED, LEARNT, BATCH = 512, 128, 16
#: Chunks of a round that a task takes, and most tasks of a round: each sends as many numbers to the driver as there are weights.
DEALT, TASKS = 8, 16
#: Numbers in one row of gradients, and distinct chains up to which their scores are broadcast.
PIECE, BROADCAST_CHAINS = 8192, 500_000

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Hyper-parameters; places beyond the last position share its embedding."""

    suffixes: int = len(SUFFIXES)
    categories: int = 2
    dim: int = 128
    layers: int = 4
    heads: int = 8
    positions: int = 50
    dropout: float = 0.1


def begin(shape: Shape = Shape(), seed: int = 0) -> Weights:
    """Fresh weights: uniform by fan-in and fan-out for embeddings, normal by fan-in for other matrices,
    zero biases, unit scales. Index 0 of suffixes and categories is padding."""
    rng, d = np.random.default_rng(seed), shape.dim
    out: Weights = {}

    def matrix(name: str, a: int, b: int) -> None:
        out[f"{name}.w"], out[f"{name}.b"] = rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)

    def scale(name: str) -> None:
        out[f"{name}.g"], out[f"{name}.b"] = np.ones(d), np.zeros(d)

    for name, n in (("suffix", shape.suffixes + 1), ("category", shape.categories + 1), ("position", shape.positions)):
        out[name] = rng.uniform(-1, 1, (n, d)) * math.sqrt(6 / (n + d))
    matrix("input", 3 * d, d)
    for k in range(shape.layers):
        for part in ("query", "key", "value", "out"):
            matrix(f"{k}.{part}", d, d)
        matrix(f"{k}.wide", d, 4 * d)
        matrix(f"{k}.narrow", 4 * d, d)
        scale(f"{k}.first")
        scale(f"{k}.second")
    matrix("head.0", d, d)
    scale("head.norm")
    matrix("head.1", d, d // 2)
    matrix("head.2", d // 2, 1)
    return out


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by a rational approximation (absolute error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * 1.061405429
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):  # in place, as these arrays are the largest
        poly += c
        poly *= t
    np.multiply(x, x, out=t)
    poly *= np.exp(np.negative(t, out=t), out=t)
    return np.multiply(np.sign(x), np.subtract(1, poly, out=poly), out=poly)


@dataclass
class Tape:
    """A forward pass over ``weights``; ``back`` gives the gradients of all of them, if the pass is to ``learn``."""

    weights: Weights
    shape: Shape
    rng: np.random.Generator | None = None
    steps: list[Callable[[], None]] = field(default_factory=list)
    grads: Weights = field(default_factory=dict)
    learn: bool = True

    def note(self, value: np.ndarray, backwards: Callable[[np.ndarray], None]) -> list:
        """A node (value, gradient) whose ``backwards`` runs once its gradient is complete."""
        if not self.learn:
            return [value]
        node = [value, np.zeros_like(value)]
        self.steps.append(lambda: backwards(node[1]))
        return node

    def add_grad(self, name: str, g: np.ndarray) -> None:
        self.grads[name] = self.grads[name] + g if name in self.grads else g

    def linear(self, x: list, name: str) -> list:
        w, b = self.weights[f"{name}.w"], self.weights[f"{name}.b"]
        rows = x[0].reshape(-1, x[0].shape[-1])  # one product for all chains: numpy would take one for each

        def backwards(g: np.ndarray) -> None:
            flat = g.reshape(-1, g.shape[-1])
            self.add_grad(f"{name}.w", rows.T @ flat)
            self.add_grad(f"{name}.b", flat.sum(axis=0))
            x[1] += (flat @ w.T).reshape(x[0].shape)

        return self.note((rows @ w + b).reshape(*x[0].shape[:-1], w.shape[1]), backwards)

    def plus(self, x: list, y: list) -> list:
        def backwards(g: np.ndarray) -> None:
            x[1] += g
            y[1] += g

        return self.note(x[0] + y[0], backwards)

    def norm(self, x: list, name: str) -> list:
        g, b = self.weights[f"{name}.g"], self.weights[f"{name}.b"]
        middle = x[0] - x[0].mean(axis=-1, keepdims=True)
        spread = np.sqrt((middle**2).mean(axis=-1, keepdims=True) + 1e-5)
        unit = middle / spread

        def backwards(d: np.ndarray) -> None:
            self.add_grad(f"{name}.g", (d * unit).reshape(-1, unit.shape[-1]).sum(axis=0))
            self.add_grad(f"{name}.b", d.reshape(-1, unit.shape[-1]).sum(axis=0))
            e = d * g
            x[1] += (e - e.mean(axis=-1, keepdims=True) - unit * (e * unit).mean(axis=-1, keepdims=True)) / spread

        return self.note(unit * g + b, backwards)

    def gelu(self, x: list) -> list:
        below = 0.5 * (1 + erf(x[0] / math.sqrt(2)))

        def backwards(g: np.ndarray) -> None:
            x[1] += g * (below + x[0] * np.exp(-0.5 * x[0] ** 2) / math.sqrt(2 * math.pi))

        return self.note(x[0] * below, backwards)

    def drop(self, x: list) -> list:
        if self.rng is None or not self.shape.dropout:
            return x
        stay = (self.rng.random(x[0].shape) >= self.shape.dropout) / (1 - self.shape.dropout)

        def backwards(g: np.ndarray) -> None:
            x[1] += g * stay

        return self.note(x[0] * stay, backwards)

    def attend(self, q: list, k: list, v: list, padded: np.ndarray) -> list:
        n, length, d = q[0].shape
        heads = self.shape.heads
        split = lambda x: x.reshape(n, length, heads, d // heads).transpose(0, 2, 1, 3)
        join = lambda x: x.transpose(0, 2, 1, 3).reshape(n, length, d)
        a, b, c = split(q[0]), split(k[0]), split(v[0])
        score = a @ b.transpose(0, 1, 3, 2) / math.sqrt(d // heads) + np.where(padded, -1e9, 0.0)[:, None, None, :]
        p = np.exp(score - score.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)

        def backwards(g: np.ndarray) -> None:
            g = split(g)
            dp = g @ c.transpose(0, 1, 3, 2)
            ds = p * (dp - (dp * p).sum(axis=-1, keepdims=True)) / math.sqrt(d // heads)
            q[1] += join(ds @ b)
            k[1] += join(ds.transpose(0, 1, 3, 2) @ a)
            v[1] += join(p.transpose(0, 1, 3, 2) @ g)

        return self.note(join(p @ c), backwards)

    def scores(self, suffix: np.ndarray, category: np.ndarray, padded: np.ndarray) -> list:
        """Scores of a padded batch of chains; a chain without suffixes is pooled to zeros."""
        place = np.broadcast_to(np.minimum(np.arange(suffix.shape[1]), self.shape.positions - 1), suffix.shape)
        looked = {"suffix": suffix, "category": category, "position": place}

        def embedded(g: np.ndarray) -> None:
            for part, (name, ids) in zip(np.split(g, 3, axis=-1), looked.items()):
                grad = np.zeros_like(self.weights[name])
                np.add.at(grad, ids, part)
                if name != "position":
                    grad[0] = 0  # padding is not trained
                self.add_grad(name, grad)

        x = self.note(np.concatenate([self.weights[name][ids] for name, ids in looked.items()], axis=-1), embedded)
        x = self.linear(x, "input")
        for k in range(self.shape.layers):
            held = self.attend(self.linear(x, f"{k}.query"), self.linear(x, f"{k}.key"), self.linear(x, f"{k}.value"), padded)
            x = self.norm(self.plus(x, self.drop(self.linear(held, f"{k}.out"))), f"{k}.first")
            wide = self.drop(self.gelu(self.linear(x, f"{k}.wide")))
            x = self.norm(self.plus(x, self.drop(self.linear(wide, f"{k}.narrow"))), f"{k}.second")
        share = ~padded / np.maximum((~padded).sum(axis=1, keepdims=True), 1)

        def pooled(g: np.ndarray) -> None:
            x[1] += g[:, None, :] * share[:, :, None]

        y = self.note((x[0] * share[:, :, None]).sum(axis=1), pooled)
        y = self.drop(self.gelu(self.norm(self.linear(y, "head.0"), "head.norm")))
        return self.linear(self.drop(self.gelu(self.linear(y, "head.1"))), "head.2")

    def back(self, end: list, g: np.ndarray) -> Weights:
        end[1] += g
        while self.steps:
            self.steps.pop()()  # what a step holds goes with it: steps and tape hold each other, and would stay for long
        return self.grads


def padded_batch(chains: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix ids, category ids and padding of chains of (suffix id, category id), at least one place wide."""
    width = max(1, max(map(len, chains), default=0))
    ids = np.zeros((2, len(chains), width), np.int64)
    padded = np.ones((len(chains), width), bool)
    for i, chain in enumerate(chains):
        for j, (s, c) in enumerate(chain):
            ids[:, i, j] = s, c
        padded[i, : len(chain)] = False
    return ids[0], ids[1], padded


def forward(weights: Weights, chains: list[list[tuple[int, int]]], shape: Shape = Shape()) -> np.ndarray:
    return Tape(weights, shape, learn=False).scores(*padded_batch(chains))[0][:, 0]


def loss(scores: np.ndarray, labels: np.ndarray, counts: list[int], times: list[int] | None = None) -> tuple[float, np.ndarray, bool]:
    """Mean over words, each of which stands for ``times``, of -log(probability of the labelled candidates + 1e-8),
    its gradient, and whether every labelled score beats the others of its word by the margin."""
    total, g, held, at = 0.0, np.zeros_like(scores), True, 0
    times = [1] * len(counts) if times is None else times
    words = max(1, sum(times))
    for n, k in zip(counts, times):
        s, y = scores[at : at + n], labels[at : at + n]
        p = np.exp((s - s.max()) / TEMPERATURE)
        p /= p.sum()
        right = float(p @ y)
        total -= k * math.log(right + 1e-8)
        g[at : at + n] = -(p * y - p * right) / (right + 1e-8) / TEMPERATURE * k / words
        held &= bool(y.any()) and (y.all() or s[y > 0].max() > s[y == 0].max() + MARGIN)
        at += n
    return total / words, g, held


def restarted_rate(epoch: int, rate: float = 1e-4, first: int = 10, times: int = 2, least: float = 0.01) -> float:
    """The learning rate under cosine annealing with warm restarts."""
    while epoch >= first:
        epoch, first = epoch - first, first * times
    return rate * (least + (1 - least) * (1 + math.cos(math.pi * epoch / first)) / 2)


@dataclass
class AdamW:
    rate: float = 1e-4
    decay: float = 0.01
    clip: float = 1.0
    n: int = 0
    means: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def step(self, weights: Weights, grads: Weights) -> None:
        """One step in place, after the gradients' common norm is cut to ``clip``."""
        size = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        cut = min(1.0, self.clip / (size + 1e-6))
        self.n += 1
        for name, g in grads.items():
            a, b = self.means.get(name, (np.zeros_like(g), np.zeros_like(g)))
            a, b = 0.9 * a + 0.1 * cut * g, 0.999 * b + 0.001 * (cut * g) ** 2
            self.means[name] = a, b
            weights[name] *= 1 - self.rate * self.decay
            weights[name] -= self.rate * (a / (1 - 0.9**self.n)) / (np.sqrt(b / (1 - 0.999**self.n)) + 1e-8)


@dataclass
class State:
    """What training goes on from: weights, the optimiser with its moments, the last loss, and the epoch
    and round that come next."""

    weights: Weights
    optimiser: AdamW = field(default_factory=AdamW)
    loss: float = 0.0
    epoch: int = 0
    round: int = 0

    def copy(self) -> State:
        own = replace(self.optimiser, means={k: (a.copy(), b.copy()) for k, (a, b) in self.optimiser.means.items()})
        return replace(self, weights={k: v.copy() for k, v in self.weights.items()}, optimiser=own)


#: Chains of all candidates of a word, their labels, and for how many words it stands.
Example = tuple[list, list[int], int]
#: Sum of the losses of some words, their number, whether all margins hold, and the sum of gradients.
Sums = tuple[float, int, bool, Weights]


def chunk_sums(weights: Weights, words: list[Example], shape: Shape, seeds: tuple[int, ...]) -> Sums:
    """Of the words of one chunk, whose dropout is drawn from its own seeds, wherever it is worked on. Words are taken
    together up to LEARNT candidates, as a tape holds much for each."""
    rng = np.random.default_rng(seeds)

    def parts() -> Iterator[Sums]:
        part: list[Example] = []
        for word in words:
            if part and sum(len(w[0]) for w in (*part, word)) > LEARNT:
                yield _part_sums(weights, part, shape, rng)
                part = []
            part.append(word)
        if part:
            yield _part_sums(weights, part, shape, rng)

    return _added(parts())


def _part_sums(weights: Weights, words: list[Example], shape: Shape, rng: np.random.Generator) -> Sums:
    """Each tape takes the candidates of like lengths, so that little is padded; a word's probabilities need the scores of all."""
    chains = [c for own, _, _ in words for c in own]
    labels, counts, times = np.array([y for _, ys, _ in words for y in ys], float), [len(own) for own, _, _ in words], [n for *_, n in words]
    scores, runs, lengths = np.zeros(len(chains)), [], np.array([(len(c) + 1) // 2 for c in chains])
    for length in np.unique(lengths):
        at, tape = np.flatnonzero(lengths == length), Tape(weights, shape, rng)
        end = tape.scores(*padded_batch([chains[i] for i in at]))
        scores[at] = end[0][:, 0]
        runs.append((at, tape, end))
    value, g, held = loss(scores, labels, counts, times)
    grads: Weights = {}
    while runs:
        at, tape, end = runs.pop(0)
        for name, own in tape.back(end, g[at, None] * sum(times)).items():
            grads[name] = grads[name] + own if name in grads else own
    return value * sum(times), sum(times), held, grads


def _added(parts: Iterator[Sums]) -> Sums:
    total, n, held, grads = 0.0, 0, True, {}
    for value, k, ok, g in parts:
        total, n, held = total + value, n + k, held and ok
        grads = {name: grads[name] + g[name] if name in grads else g[name] for name in g}
    return total, n, held, grads


def trained(state: State, rounds: int, gather: Callable[[State, int], Sums], steps: int = STEPS, epochs: int = 1, rate: float = 1e-4, save: Callable[[State], None] | None = None) -> State:
    """Goes on from ``state``, in place, to the end of ``epochs``: each round takes up to ``steps`` steps and is
    ended when all margins hold. ``save`` gets the state after each round; a run that goes on from a saved
    state ends with the same weights as one that was never stopped."""
    while state.epoch < epochs:
        state.optimiser.rate = restarted_rate(state.epoch, rate)
        while state.round < rounds:
            for step in range(steps):
                total, n, held, grads = gather(state, step)
                if not n:
                    break
                state.loss = total / n
                if held:
                    break
                state.optimiser.step(state.weights, {name: g / n for name, g in grads.items()})
            state.round += 1
            if save:
                save(state)
        state.epoch, state.round = state.epoch + 1, 0
    return state


def _encoded(candidates: DataFrame) -> DataFrame:
    code = encode_chain(F.col("chain"), F.col("makes"))
    return candidates.select("word", "cand_ord", F.transform(code, lambda x: x.sid).alias("sids"), F.transform(code, lambda x: x.cid + 1).alias("cids"))


def examples(candidates: DataFrame, labels: DataFrame, limit: int | None = None) -> tuple[DataFrame, int]:
    """chunk, word, own (sids, cids, label of all its candidates in order), times: one word (the least) for all ``times``
    words of ``labels`` (word, cand_ord of right candidates) with the same chains and labels in the same order, as
    training sees no more of them. And how many chunks of about BATCH words there are. Words with no or one
    candidate teach nothing. With ``limit``, the examples of that many words by hash."""
    chosen = labels.select("word").distinct()
    chosen = F.broadcast(chosen.orderBy(F.md5("word"), "word").limit(limit)) if limit is not None else chosen
    right = labels.select("word", "cand_ord", F.lit(1).alias("label")).distinct()
    rows = _encoded(candidates.join(chosen, "word", "left_semi")).join(right, ["word", "cand_ord"], "left")
    own = F.array_sort(F.collect_list(F.struct("cand_ord", "sids", "cids", F.coalesce("label", F.lit(0)).alias("label"))))
    seen = F.transform(own, lambda c: F.struct(c.sids.alias("sids"), c.cids.alias("cids"), c.label.alias("label")))
    words = cut(rows.groupBy("word").agg(seen.alias("own")).where(F.size("own") > 1).groupBy("own").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("times")))
    chunks = -(-words.count() // BATCH)
    return words.select(F.pmod(F.xxhash64("word"), F.lit(max(1, chunks))).cast("long").alias("chunk"), "word", "own", "times"), chunks


def _read(own: list, times: int) -> Example:
    """An example from the candidates of a row, as rows or as dictionaries."""
    return [list(zip(r["sids"], r["cids"])) for r in own], [int(r["label"]) for r in own], times


def local_rounds(words: DataFrame, chunks: int, shape: Shape, width: int, seed: int) -> Callable[[State, int], Sums]:
    """The rounds of bounded ``words`` where the driver is."""
    held: dict[int, list[Example]] = {}
    for r in words.orderBy("chunk", "word").collect():
        held.setdefault(r.chunk, []).append(_read(r.own, r.times))

    def gather(state: State, step: int) -> Sums:
        own = [c for c in range(state.round * width, (state.round + 1) * width) if c in held]
        return _added(chunk_sums(state.weights, held[c], shape, (seed, state.epoch, step, c)) for c in own)

    return gather


def spark_rounds(words: DataFrame, chunks: int, shape: Shape, width: int, seed: int) -> Callable[[State, int], Sums]:
    """The rounds of any number of words: a job for each step, in which a few tasks, as many as ``width`` asks for, sum the
    gradients of their chunks. The driver adds their sums in a fixed order. Chunks are dealt by their number alone, so
    that sums are the same in every run and under every setting, and nothing is shuffled between steps."""
    session = words.sparkSession
    tasks = max(1, min(TASKS, -(-min(width, chunks) // DEALT)))
    rows = cut(words.repartitionById(tasks, F.pmod("chunk", F.lit(tasks)).cast("int")).sortWithinPartitions("chunk", "word"))

    def gather(state: State, step: int) -> Sums:
        names = sorted(state.weights)
        shared = session.sparkContext.broadcast(state.weights)
        key, first, last = (seed, state.epoch, step), state.round * width, (state.round + 1) * width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def grouped() -> Iterator[tuple[int, list[Example]]]:
                number, held = None, []
                for batch in batches:
                    for chunk, own, times in zip(*(c.to_pylist() for c in batch.columns)):
                        if held and chunk != number:
                            yield number, held
                            held = []
                        number = chunk
                        held.append(_read(own, times))
                if held:
                    yield number, held

            begun: list[int] = []

            def sums() -> Iterator[Sums]:
                for number, held in grouped():
                    begun.append(number)
                    yield chunk_sums(shared.value, held, shape, (*key, number))

            total, n, ok, grads = _added(sums())
            if not n:
                return
            flat = np.concatenate([grads[name].ravel() for name in names])
            parts = [np.array([total, n, float(ok)]).tobytes(), *(flat[a : a + PIECE].tobytes() for a in range(0, len(flat), PIECE))]
            yield pa.RecordBatch.from_arrays([pa.array([min(begun)] * len(parts), pa.int64()), pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array(parts, pa.binary())], ["place", "piece", "data"])

        own = rows.where((F.col("chunk") >= first) & (F.col("chunk") < last)).select("chunk", "own", "times")
        sent = own.mapInArrow(run, "place long, piece int, data binary").toArrow()  # of at most TASKS tasks
        shared.destroy()
        total, n, ok, flat = 0.0, 0, True, np.zeros(sum(w.size for w in state.weights.values()))
        places, pieces, data = (sent.column(k) for k in range(3))
        for k in np.lexsort((np.asarray(pieces), np.asarray(places))):
            piece, numbers = pieces[int(k)].as_py(), np.frombuffer(data[int(k)].as_buffer(), "<f8")
            if piece < 0:
                total, n, ok = total + float(numbers[0]), n + int(numbers[1]), ok and bool(numbers[2])
            else:
                flat[piece * PIECE : piece * PIECE + len(numbers)] += numbers
        grads, at = {}, 0
        for name in names if n else ():
            size = state.weights[name].size
            grads[name] = flat[at : at + size].reshape(state.weights[name].shape)
            at += size
        return total, n, ok, grads

    return gather


def fit_state(
    candidates: DataFrame, labels: DataFrame, begun: State | None = None, shape: Shape = Shape(), steps: int = STEPS, epochs: int = 1,
    width: int = 1, seed: int = 0, limit: int | None = None, save: Callable[[State], None] | None = None,
) -> State:
    """The state after training on the words of ``labels`` (word, cand_ord of right candidates), ``width``
    chunks a round. With ``limit`` the driver takes that many words by hash; without, all words take part
    and stay on the executors."""
    words, chunks = examples(candidates, labels, limit)
    gather = (spark_rounds if limit is None else local_rounds)(words, chunks, shape, width, seed)
    state = begun.copy() if begun else State(begin(shape))
    return trained(state, -(-chunks // width), gather, steps, epochs, save=save)


def fit(candidates: DataFrame, labels: DataFrame, begun: Weights | None = None, shape: Shape = Shape(), steps: int = STEPS, epochs: int = 1, limit: int = TRAIN_WORDS) -> tuple[Weights, float]:
    """Weights and last loss (0 without words) after training on at most ``limit`` words where the driver is."""
    state = fit_state(candidates, labels, State(begun) if begun else None, shape, steps, epochs, limit=limit)
    return state.weights, state.loss


def score(candidates: DataFrame, weights: Weights, shape: Shape = Shape()) -> DataFrame:
    """word, cand_ord, score of every candidate. Candidates with one encoded chain share its score, so each
    distinct chain is scored once and joined back, by a broadcast while there are few. Chains are few bytes and
    much work, so they are dealt once more (by a key that ``distinct`` does not deal by, or Spark leaves it out) to tasks
    that are not put together by their size; a task takes chains of like lengths together, so that little is padded."""
    shared = candidates.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(pc.list_value_length(batch.column(0)), kind="stable")))
            for at in range(0, batch.num_rows, SCORED):
                part = batch.slice(at, SCORED)
                chains = [list(zip(s, c)) for s, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(forward(shared.value, chains, shape))], ["sids", "cids", "score"])

    rows = _encoded(candidates)
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut(rows.select("sids", "cids").distinct().repartition(tasks, F.xxhash64("cids", "sids")).mapInArrow(run, "sids array<int>, cids array<int>, score double"))
    known = F.broadcast(known) if known.limit(BROADCAST_CHAINS + 1).count() <= BROADCAST_CHAINS else known
    return rows.join(known, ["sids", "cids"]).select("word", "cand_ord", "score")


_STATE = "part string, name string, shape array<int>, data binary, number double"


def state_rows(spark: SparkSession, state: State) -> DataFrame:
    """A state as rows of fixed number: part (weight, mean, spread or meta), name, shape, data, number."""
    rows = [("weight", name, list(w.shape), w.astype("<f8").tobytes(), None) for name, w in state.weights.items()]
    for name, pair in state.optimiser.means.items():
        rows += [(part, name, list(m.shape), m.astype("<f8").tobytes(), None) for part, m in zip(("mean", "spread"), pair)]
    o = state.optimiser
    meta = {"n": o.n, "rate": o.rate, "decay": o.decay, "clip": o.clip, "loss": state.loss, "epoch": state.epoch, "round": state.round}
    return spark.createDataFrame(rows + [("meta", name, None, None, float(x)) for name, x in meta.items()], _STATE)


def state_of(rows: DataFrame) -> State | None:
    """The state that ``state_rows`` wrote, None without one."""
    held: dict[str, dict] = {"weight": {}, "mean": {}, "spread": {}, "meta": {}}
    for r in rows.where(F.col("part").isin(*held)).collect():  # fixed size
        held[r.part][r.name] = r.number if r.part == "meta" else np.frombuffer(bytes(r.data), "<f8").reshape(r["shape"]).copy()
    if not held["weight"]:
        return None
    m = held["meta"]
    optimiser = AdamW(m["rate"], m["decay"], m["clip"], int(m["n"]), {k: (held["mean"][k], held["spread"][k]) for k in held["mean"]})
    return State(held["weight"], optimiser, m["loss"], int(m["epoch"]), int(m["round"]))


def save(spark: SparkSession, weights: Weights, path: str) -> None:
    """Writes weights as rows (name, shape, data); ``path`` has to be new."""
    rows = [(name, list(w.shape), w.astype("<f8").tobytes()) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").write.parquet(path)


def load(spark: SparkSession, path: str) -> Weights:
    return {r.name: np.frombuffer(bytes(r.data), "<f8").reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}  # fixed size
