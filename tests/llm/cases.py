"""Rows that every operator must bear, and plain brute-force versions of the contracts."""

import hashlib
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, __size long"

ODD = [
    (1, None, "en", "a", None, "x", 1), (2, "", None, None, 0, None, None), (3, "   \n\t ", "en", "a", 6, "x", 1),
    (4, "one", "en", "a", 3, "x", 1), (5, "one two", "de", "b", 7, "x", 1), (6, "one two", "de", "b", 7, "x", 1),
    (7, "word " * 3000, "fr", "b", 15000, "x", 1), (8, "a" * 20000, "es", None, 20000, "x", 1),
    (9, "Ünï cödé 日本語 😀 \x00 z", None, "c", 20, "x", 1), (9, "Ünï cödé 日本語 😀 \x00 z", None, "c", 20, "x", 1),
    (None, "no id here at all", "en", "c", 17, "x", 1), (10, "9" * 5000 + "@x", "en", "c", 5002, "x", 1),
]

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_rules(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base_pii(text):
    text, out = text or "", []
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x[-9:]) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def spans_sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())


def components(rows):
    """{doc_id: component} by comparing every two sets that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    done = set()
    for i, s in sets.items():
        shared = Counter(j for g in s for j in having[g] if j > i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}, done


def substring_dedup(rows, width=13):
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in split:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def same_rows(before, after, but=()):
    """Every row of ``after`` is one of ``before`` in all columns (``but`` some), values included."""
    assert after.columns == before.columns
    plain = lambda df: [tuple(v for c, v in r.asDict().items() if c not in but) for r in df.collect()]
    assert set(plain(after)) <= set(plain(before))
