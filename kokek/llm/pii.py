"""Personal data: exact base patterns, and further spans by aggregated weak labels.

Base spans (email, ip, card, phone) follow fixed patterns. Beyond them, candidate spans (numbers,
accounts, spelled-out addresses, names) get votes from regex, gazetteer and context labelers, as
do the base spans. Votes form a bounded number of patterns, so Spark counts them over every
document; expectation maximisation on those counts, with the base spans known to be right,
estimates each labeler's reliability. The soft labels train a logistic span classifier on what the
labelers do not see: make-up of the span and the words around it. It decides every candidate.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from heapq import heappushpop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kokek.llm.common import cut, prepare

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("account", "contact", "name", "number")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + EXTRA_KINDS)}

#: Different spans of one vote pattern that train the classifier (those of the least hashes); votes
#: are counted over all documents.
SAMPLE = 64
#: Least chance of a candidate to be taken.
THRESHOLD = 0.6
#: Classes into which words near a span are hashed.
NEAR = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Every ip, card and phone lies inside one maximal run of these characters.
_NUMERIC = re.compile(r"[+0-9][0-9 .()+\-]{5,}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @, in time linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        found, after = _DOMAIN.match(text, at + 1), at + 1
        if found:
            start = at
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, found.end()
                low = after = found.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, ordered by start, then kind."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    for run in _NUMERIC.finditer(text):
        part, at = run[0], run.start()
        for m in _IP.finditer(part) if "." in part else ():
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((at + m.start(), "ip", at + m.end()))
        for m in _CARD.finditer(part):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at + m.start(), "card", at + m.end()))
        for m in _PHONE.finditer(part) if "+" in part else ():
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((at + m.start(), "phone", at + m.end()))
    out.sort(key=lambda s: (s[0], ORDER[s[1]]))
    return out


# Small gazetteers and context words in English, German, French and Spanish.
FIRST_NAMES = frozenset("""anna anne carlos charlotte claire david elena emma francisco hans heinrich isabel james jean
john jose juan jürgen karl klaus laura lucas luis maria marie martin michael michel miguel nicolas olivia
paul pedro peter philippe pierre robert sabine sophie stefan susan thomas ursula wolfgang""".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle monsieur madame señor señora sr sra".split())
DIALLING = ("0049", "0033", "0034", "0044", "001")
FOR = frozenset("""call phone tel telephone telefon téléphone teléfono mobile handy fax contact kontakt ssn passport
iban account konto compte cuenta id ausweis dni nif email mail courriel correo name nom nombre address""".split())
AGAINST = frozenset("isbn issn version invoice order page total price eur usd sha token commit build port chapter".split())

_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_CONTACT = re.compile(r"\b[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra)\.? [A-ZÀ-Þ][a-zß-ÿ]{1,30}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,30})?")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\(?[0-9](?:[ .()-]{0,2}[0-9]){6,14}")


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def candidates(text: str, base: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, int, tuple[int, ...]]]:
    """(start, kind, end, votes) of spans outside the base ones; a vote is 1 for, -1 against, 0 none."""
    found = []
    if " at " in text or "(at)" in text or "[at]" in text:
        found += [(m.start(), "contact", m.end()) for m in _CONTACT.finditer(text)]
    found += [(m.start(), "account", m.end()) for m in _ACCOUNT.finditer(text)]
    found += [(m.start(), "name", m.end()) for m in _NAME.finditer(text)]
    for run in _NUMERIC.finditer(text):
        found += [(run.start() + m.start(), "number", run.start() + m.end()) for m in _NUMBER.finditer(run[0])]
    found.sort(key=lambda s: (s[0], ORDER[s[1]]))
    k, reach, last = 0, 0, 0
    for start, kind, end in found:
        while k < len(base) and base[k][0] < end:
            reach, k = max(reach, base[k][2]), k + 1
        if start < max(reach, last):
            continue
        last = end
        yield start, kind, end, votes(text, start, kind, end)


def votes(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """Labelers: strict regex, gazetteer, words before, words against, form."""
    span = text[start:end]
    before = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-4:]}
    after = {w.lower() for w in _WORD.findall(text[end : end + 24])[:2]}
    inside = {w.lower() for w in _WORD.findall(span)}
    digits = _NOT_DIGIT.sub("", span)
    glued = (start and (text[start - 1].isalnum() or text[start - 1] in "_\"'=/")) or (end < len(text) and (text[end].isalnum() or text[end] in "_\"'=/"))
    strict = {"number": bool(_NATIONAL.fullmatch(span) or _GROUPED.fullmatch(span)), "account": kind == "account" and mod97(span), "contact": "(" in span or "[" in span, "name": span.count(" ") == 2}.get(kind, True)
    listed = {"number": digits.startswith(DIALLING), "name": bool(inside & FIRST_NAMES), "account": span[:2] in ("DE", "FR", "ES", "GB", "IT", "NL"), "contact": bool(inside & FIRST_NAMES)}.get(kind, digits.startswith(DIALLING))
    return (
        1 if strict else -1,
        1 if listed else 0,
        1 if before & FOR else 0,
        -1 if (before | after) & AGAINST else 0,
        -1 if glued or len(set(digits)) <= 2 and kind in ("number", "account") else 0,
    )


def features(text: str, start: int, kind: str, end: int, v: tuple[int, ...]) -> np.ndarray:
    """Votes, kind, make-up of the span, and hashed words before and after it."""
    span = text[start:end]
    out = np.zeros(WIDTH, np.float32)
    n = max(1, len(span))
    digits, letters, upper = (sum(map(f, span)) / n for f in (str.isdigit, str.isalpha, str.isupper))
    own = [1.0, *v, digits, letters, upper, len(span) / 20, min(4, len(re.findall(r"[^\W_]+", span))) / 4, "+" in span, "-" in span, "." in span, "(" in span, len(set(span)) / n, start == 0 or text[start - 1] == "\n"]
    out[: len(own)] = own
    out[SHAPE + ORDER[kind]] = 1
    near = [(0, w) for w in _WORD.findall(text[max(0, start - 40) : start])[-3:]] + [(1, w) for w in _WORD.findall(text[end : end + 24])[:2]]
    for side, w in near:
        out[SHAPE + len(ORDER) + zlib.crc32(f"{side}{w.lower()}".encode()) % NEAR] = 1
    return out


SHAPE = 17
WIDTH = SHAPE + len(ORDER) + NEAR


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> np.ndarray:
    """Probabilities of each (kind, votes, count) pattern by expectation-maximisation of the labelers'
    reliabilities; patterns of base kinds are right."""
    v = np.array([p[1] for p in patterns]) + 1
    n = np.array([p[2] for p in patterns], dtype=float)
    base = np.array([p[0] in BASE_KINDS for p in patterns])
    soft = np.where(base, 1.0, 1 / (1 + np.exp(-(2.0 * (v - 1).sum(axis=1) - 1))))
    for _ in range(rounds):
        # Base spans teach what right spans get as votes, not how many candidates are right.
        prior = (n[~base] @ soft[~base] + 1) / (n[~base].sum() + 4)
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for k in range(v.shape[1]):
            # Pseudo-counts keep a labeler's vote from turning against its sense on few spans; base
            # spans say nothing of the first labeler, whose vote they have by their making.
            use = n * ~base if k == 0 else n
            yes = np.bincount(v[:, k], use * soft, 3) + np.array([1.0, 4.0, 5.0])
            no = np.bincount(v[:, k], use * (1 - soft), 3) + np.array([5.0, 4.0, 1.0])
            odds += np.log(yes / yes.sum())[v[:, k]] - np.log(no / no.sum())[v[:, k]]
        soft = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return soft


def fit(patterns: list[tuple[str, tuple[int, ...], int]], spans: list[tuple[str, np.ndarray]], rounds: int = 300) -> np.ndarray:
    """Weights of the span classifier: logistic regression of the patterns' probabilities on sampled
    spans (pattern key, features), each pattern weighing as often as it occurs, to the power 1/2."""
    if not patterns or not spans:
        return np.zeros(WIDTH)
    soft = {_key(k, q): (p, n) for (k, q, n), p in zip(patterns, reliabilities(patterns))}
    held: dict[str, int] = {}
    for key, _ in spans:
        held[key] = held.get(key, 0) + 1
    x = np.array([f for _, f in spans], float)
    y = np.array([soft[key][0] for key, _ in spans])
    weight = np.array([soft[key][1] ** 0.5 / held[key] for key, _ in spans])
    weight /= weight.sum()
    w = np.zeros(WIDTH)
    for _ in range(rounds):  # Newton steps would need few rounds, but this is never singular
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - y)) + 1e-4 * w)
    return w


def _key(kind: str, v: tuple[int, ...]) -> str:
    return kind + ":" + "".join("-0+"[x + 1] for x in v)


def train(docs: DataFrame) -> np.ndarray:
    """Counts vote patterns (at most 8 kinds x 3^5) over all documents, samples spans of each, and
    fits the classifier. A span's place in the sample goes by a hash of what it is and stands in."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        kept: dict[str, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                marked = [(a, k, b, votes(text, a, k, b)) for a, k, b in base]
                for a, kind, b, v in [*marked, *candidates(text, base)]:
                    key = _key(kind, v)
                    counts[key] = counts.get(key, 0) + 1
                    held, place = kept.setdefault(key, []), zlib.crc32(text[max(0, a - 60) : b + 30].encode())
                    if len(held) < SAMPLE or -held[0][0] >= place:
                        item = -place, features(text, a, kind, b, v).tobytes()
                        if item not in held:
                            heappush(held, item) if len(held) < SAMPLE else heappushpop(held, item)
        rows = [(key, n, None, None) for key, n in counts.items()] + [(key, 0, -p, f) for key, held in kept.items() for p, f in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["pattern", "n", "place", "features"])

    found = cut(docs.select("text").mapInArrow(run, "pattern string, n long, place long, features binary"))
    patterns = sorted((r.pattern.split(":")[0], tuple("-0+".index(c) - 1 for c in r.pattern.split(":")[1]), r.n) for r in found.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    offered = found.where("place IS NOT NULL").select("pattern", "place", "features").distinct()
    first = offered.withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("place", "features"))).where(F.col("k") <= SAMPLE)
    spans = sorted((r.pattern, bytes(r.features)) for r in first.select("pattern", "features").collect())
    return fit(patterns, [(k, np.frombuffer(f, np.float32)) for k, f in spans])


def chances(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.array(rows, float) @ weights, -30, 30)))


def all_spans(text: str, model: np.ndarray, threshold: float) -> tuple[list, list]:
    """Base spans, and they with the candidates that some labeler is for and the classifier accepts."""
    base = base_spans(text)
    backed = [(a, kind, b, v) for a, kind, b, v in candidates(text, base) if max(v) > 0]
    if not backed:
        return base, base
    p = chances(model, [features(text, *c) for c in backed])
    more = [(a, kind, b) for (a, kind, b, _), x in zip(backed, p) if x >= threshold]
    return base, sorted(base + more, key=lambda s: (s[0], ORDER[s[1]])) if more else base


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find_pii(docs: DataFrame, model: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts and spans of every row; trains on the same documents without a model.

    Null and empty texts have no spans. Offsets are code points of the whole text. Repeated rows
    are found alike, null ids stay null, other columns are not read.
    """
    model = train(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", model, threshold)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list) -> str:
    """Replaces each span (overlapping ones together) by its first kind in angle brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, kind, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b, k = max(b, spans[k][2]), k + 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text`` (and ``n_chars``, where
    there is one, set to the new length). Null texts stay null; repeated rows are treated alike; no
    rows give none; without a model it trains on the same documents."""
    model = train(docs) if model is None else model
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = names.index("text")
            old = batch.column(k)
            new = [None if t is None else redact_text(t, all_spans(t, model, threshold)[1]) for t in old.to_pylist()]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(new, old.type))
            if "n_chars" in names:
                c = names.index("n_chars")
                sizes = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(batch.column(c).type)
                batch = batch.set_column(c, batch.schema.field(c), sizes)
            yield batch

    return docs.mapInArrow(run, docs.schema)
