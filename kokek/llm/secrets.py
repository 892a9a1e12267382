"""Secret scanning: candidate strings judged by a random forest trained on labelled findings."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kokek.llm.common import prepare
from kokek.llm.textkit import flat, slices

#: Most labelled findings a forest is trained on.
TRAIN_ROWS = 20_000
TREES, DEPTH, THRESHOLD = 30, 9, 0.5
SHORTEST = 16
NEAR = 48

_RUN = re.compile(rf"[A-Za-z0-9+/_=\-]{{{SHORTEST},}}")
_WORD = re.compile(r"[A-Za-z]+")
QUOTES = "\"'`"
_ASSIGNED = re.compile(r"[=:]+>?")
_NAME = re.compile(r"[A-Za-z](?:[A-Za-z0-9_\-]|\.(?=[A-Za-z]))*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Closing quotes, marks and an "is" before a value; then a quoted string or all up to a blank.
_VALUE = re.compile(r"[\"'`)\]]?\s*(?:(?:[=:]+>?|is\b)\s*)?(?:" + "|".join(f"{q}([^{q}\n]*){q}" for q in QUOTES) + r"|[\"'`]?([^\s\"'`]+))")

# Words that speak for or against a secret near a candidate, and a small dictionary.
FOR = frozenset("token secret password passwd pwd key apikey api auth bearer credential credentials private access client jwt session".split())
AGAINST = frozenset("sha sha1 sha256 md5 hash digest checksum commit rev revision uuid guid id etag integrity version example sample dummy placeholder test fixture".split())
QUIET_PATH = frozenset("test tests spec example examples sample fixture fixtures doc docs lock min vendor".split())
DICTIONARY = frozenset("""about access account action after again another application array async before between button change
class client code color column config connection content context count create current data database date default
delete description dictionary document element error event example field file filter first format function get group
handler header height image index input instance interface internal item label layer layout length level line list
load local main manager message method model module name network node number object option output page parameter
parent path placeholder point position private process property provider public query random record release remove
report request resource response result return sample schema script search select server service session setting
source start state status storage stream string style system table target template test text thread time title tree
type update user util value vector version view width window with word worker write your""".split())


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """Length, character make-up and transitions, dictionary coverage, path and neighbours."""
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
    share = [kinds.count(k) / n for k in "duls"]
    change = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    counts = Counter(candidate)
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    low = candidate.lower()
    letters = [c for c in low if c.isalpha()]
    vowel = sum(c in "aeiouy" for c in letters) / max(1, len(letters))
    swing = sum((a in "aeiouy") != (b in "aeiouy") for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()) / max(1, n - 1)
    again = sum(a == b for a, b in zip(low, low[1:])) / max(1, n - 1)
    covered, at = 0, 0
    while at < n:
        size = next((k for k in range(min(12, n - at), 2, -1) if low[at : at + k] in DICTIONARY), 0)
        covered += size
        at += size or 1
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    close = near[-1] if near else ""
    mark = before.rstrip(" \"'`")[-1:]
    hexed = all(c in "0123456789abcdef" for c in low)
    where = set(re.findall("[a-z]+", path.lower()))
    return [
        n, *share, change, entropy, vowel, swing, again, covered / n, float(hexed), candidate.count("-") / n, candidate.count("/") / n,
        float(bool(FOR & set(near))), float(close in FOR), float(bool(AGAINST & set(near))), float(close in AGAINST),
        float(bool(AGAINST & {w.lower() for w in _WORD.findall(after)[:2]})), float(mark == "="), float(mark == ":"), float(before[-1:] in "\"'`" and before != ""),
        float(before[-1:] in "/.#" and before != ""), float(bool(where & QUIET_PATH)), len(set(candidate)) / n,
    ]


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            inner = self.feature[at] >= 0
            down = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.cut[at]
            at = np.where(inner, np.where(down, self.left[at], self.right[at]), at)
        return self.value[at]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        own = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == DEPTH or len(rows) < 4 or y[rows].min() == y[rows].max():
            return own
        best = (1e18, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
            v = x[rows, f]
            for c in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 13))):
                low = v <= c
                n, p = low.sum(), y[rows][low].sum()
                m, q = len(rows) - n, y[rows].sum() - p
                if n and m:
                    gini = p * (n - p) / n + q * (m - q) / m
                    best = min(best, (gini, int(f), float(c)))
        if best[1] < 0:
            return own
        low = x[rows, best[1]] <= best[2]
        a, b = split(rows[low], depth + 1), split(rows[~low], depth + 1)
        nodes[own][:4] = [best[1], best[2], a, b]
        return own

    split(rng.integers(0, len(x), len(x)), 0)
    cols = list(zip(*nodes))
    return Tree(np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4]))


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [_grow(x, y, rng) for _ in range(trees)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label) drawn from templates of what scanners report; stands
    in where a corpus has no labelled findings of its own."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    words = lambda k: "".join(w.title() if rng.random() < 0.5 else w for w in rng.sample(sorted(DICTIONARY), k))
    prose = lambda: " ".join(rng.sample(sorted(DICTIONARY), 4))

    def password() -> str:
        """A word with digits and marks in it, or random characters."""
        if rng.random() < 0.5:
            return rng.choice(sorted(DICTIONARY)).title().replace("o", "0").replace("e", "3") + rng.choice("!@#$%&*.") + pick(alnum[52:], 1, 4)
        return pick(alnum, 3, 8) + rng.choice("!@#$%&*.") + pick(alnum, 2, 6) + pick(alnum[52:], 1, 2)

    out = []
    for _ in range(n):
        assign = rng.choice(['{} = "', "{}: ", '"{}": "', "{}=", "export {}='", "Authorization {} "])
        path = rng.choice(["src/main.py", "config/settings.yml", "app.env", "docs/readme", "tests/fixture.json", "src3", "lib/data.lock"])
        if rng.random() < 0.5:
            secret = rng.choice([lambda: pick("0123456789abcdef", 32, 64), lambda: pick(alnum, 20, 48), lambda: pick(alnum + "+/", 40, 64) + "==", lambda: "AKIA" + pick(alnum[:26] + "0123456789", 16, 16), lambda: "gh" + "p_" + pick(alnum, 36, 36), lambda: pick(alnum[:52], 24, 48), lambda: pick(alnum[52:], 16, 32), lambda: ".".join(pick(alnum, 8, 15) for _ in range(3)), password, password])()
            out.append((secret, prose() + " " + assign.format(rng.choice(sorted(FOR))), rng.choice(['" ', "' ", " "]) + prose(), path, 1))
        else:
            hexed = lambda: pick("0123456789abcdef", 32, 64)
            uuid = lambda: "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))
            kind = rng.randrange(12)
            if kind == 0:
                row = (hexed(), prose() + " " + assign.format(rng.choice(sorted(AGAINST))))
            elif kind == 1:
                row = (uuid(), prose() + " " + assign.format(rng.choice(["id", "uuid", "name", "key"])))
            elif kind == 2:
                row = (words(3) + pick("0123456789", 1, 3), prose() + " " + assign.format(rng.choice(["name", "class", "token", "value"])))
            elif kind == 3:
                row = ("/".join(rng.sample(sorted(DICTIONARY), 4)) + pick("0123456789", 1, 2), prose() + " ")
            elif kind == 4:
                row = (rng.choice(["your", "example", "test", "dummy"]) + rng.choice("-_") + words(2) + rng.choice("-_") + "0123456789"[: rng.randint(1, 10)], prose() + " " + assign.format(rng.choice(sorted(FOR))))
            elif kind in (5, 6):
                row = (rng.choice(sorted(DICTIONARY)) + rng.choice(["", "", ".", "s", "ing"]), prose() + rng.choice([" ", ": ", " = "]))
            elif kind in (7, 8):
                row = (rng.choice(sorted(DICTIONARY)) + rng.choice(["", "", ".", "s", "ing"]), prose() + " " + rng.choice(sorted(FOR)) + rng.choice([" ", " ", ": ", " is ", "="]))
            elif kind == 9:
                row = (pick(alnum[52:], 1, 8), prose() + rng.choice([" = ", ": ", "="]))
            elif kind == 10:
                row = ("//www." + words(2).lower() + rng.choice([".com", ".org", ".net"]) + "/" + rng.choice(["", words(1).lower()]), prose() + " https:")
            else:
                row = (rng.choice("x0A") * rng.randint(15, 40) + "1", prose() + " " + assign.format(rng.choice(sorted(FOR))))
            out.append((*row, rng.choice(['" ', " "]) + prose(), path, 0))
    return out


FINDING = "candidate string, before string, after string, path string, label int"


def bounded_findings(findings: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[str, str, str, str, int]]:
    """At most ``limit`` rows of a table of labelled findings (columns as in FINDING), the same ones in
    every run: repeated rows count once, rows without candidate or label not at all, other nulls are empty."""
    known = findings.where("candidate <> '' AND label IS NOT NULL")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")]
    rows = known.select("candidate", *texts, (F.col("label") > 0).cast("int").alias("label")).distinct()
    key = F.md5(F.to_json(F.struct("candidate", "before", "after", "path", "label")))
    return [tuple(r) for r in rows.orderBy(key).limit(limit).collect()]


def train(findings: DataFrame | list[tuple[str, str, str, str, int]] | None = None, limit: int = TRAIN_ROWS) -> Forest:
    """A forest on labelled findings, of which at most ``limit`` (by hash) are used; without any, or
    with none in the table, on findings drawn from templates."""
    rows = bounded_findings(findings, limit) if isinstance(findings, DataFrame) else findings
    rows = sorted(rows or labelled_findings(), key=lambda r: hashlib.md5(repr(r).encode()).digest())[:limit]
    return Forest(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float))


def candidates(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, string, text before, text after), in order and once each: runs of key characters, and
    whatever follows an assignment or a name with a credential word in it."""
    spans = {m.span() for m in _RUN.finditer(text)}
    after = [m.end() for m in _ASSIGNED.finditer(text)]
    after += [m.end() for m in _NAME.finditer(text) if FOR & {w.lower() for w in _PART.findall(m[0])} or FOR & {w.lower() for w in _WORD.findall(m[0])}]
    for at in after:
        m = _VALUE.match(text, at)
        if m:
            a, b = m.span(m.lastindex)
            while m.lastindex == len(QUOTES) + 1 and b > a and text[b - 1] in ",;":
                b -= 1
            if b > a:
                spans.add((a, b))
    for a, b in sorted(spans):
        yield a, b, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings ("start:end:score" of each secret, comma-joined).

    ``source`` serves as the path. Candidates are runs of 16 or more key characters and all strings
    after an assignment or a credential word, in whole texts. Null and empty texts have none; a null source is an empty path; repeated rows
    are found alike; null ids stay null; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = flat(part.column(1))
                data, paths = raw.tobytes(), part.column(2).to_pylist()
                rows, found = [], []
                for i in range(part.num_rows):
                    for c in candidates(data[at[i] : at[i + 1]].decode("utf-8", "replace")):
                        rows.append(i)
                        found.append(c)
                score = shared.value.predict(np.array([features(c[2], c[3], c[4], paths[i] or "") for i, c in zip(rows, found)])) if rows else np.zeros(0)
                every, hits = [0] * part.num_rows, [[] for _ in range(part.num_rows)]
                for i, c, s in zip(rows, found, score):
                    every[i] += 1
                    if s >= threshold:
                        hits[i].append(f"{c[0]}:{c[1]}:{s:.3f}")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(every, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array([",".join(h) for h in hits], pa.string())],
                    ["doc_id", "n_candidates", "n_secrets", "findings"],
                )

    return docs.select("doc_id", "text", "source").mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, findings string")
