"""The search for analyses as one recursive statement in DuckDB's SQL.

It states the search a second time: a breadth-first recursion without dropping states on the way,
whose repeats are removed at the end by the first path. Dictionary tests and stem keys are the
hand-written ones of ``oracles``; of the engine it takes only the table of forms, which the query
``suffix_forms`` holds against hand-written rules.
"""

from __future__ import annotations

from kokek.functions.forms import form_lists, form_rows
from kokek.functions.suffixes import GROUPS, INTENSIFIER, may_follow
from kokek.plans import oracles as o

_ENDINGS = ("iyor", "ıyor", "uyor", "üyor")


def starts_sql() -> str:
    """word, start, pos, root, rest, twice over ``words`` and ``lex``."""
    noun, verb = o.noun, o.verb
    options = o.root_candidates("root")
    altered = " UNION ALL ".join(f"SELECT word, split, rest, {k} AS k, {lemma} AS lemma FROM cuts WHERE NOT {noun('root')} AND NOT {verb('root')} AND {ok}" for k, (ok, lemma) in enumerate(options))
    both = lambda root: (("noun", 0, noun(root)), ("verb", 1, verb(root)))
    plain = " UNION ALL ".join(f"SELECT word, [1, split, 0, {n}] AS start, '{pos}' AS pos, root, rest, false AS twice FROM cuts WHERE {ok}" for pos, n, ok in both("root"))
    other = " UNION ALL ".join(f"SELECT word, [1, split, k, {n}] AS start, '{pos}' AS pos, lemma AS root, rest, false AS twice FROM altered WHERE {ok}" for pos, n, ok in both("lemma"))
    return f"""cuts AS MATERIALIZED (SELECT word, CAST(split AS INTEGER) AS split, substr(word, 1, split) AS root, substr(word, split + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS split FROM words) x),
altered AS ({altered}),
first_syllable AS (SELECT word, length(regexp_extract(word, '^[^aıoueiöü]*')) AS v FROM words WHERE length(word) >= 4 AND regexp_matches(word, '[aıoueiöü]')),
copied AS (
  SELECT word, v + 2 AS p, v FROM first_syllable WHERE v >= 0 AND substr(word, v + 2, 1) IN ('p', 's', 'r', 'm')
  UNION ALL SELECT word, v + 3, v FROM first_syllable WHERE v >= 0 AND substr(word, v + 2, 1) IN ('p', 's', 'r', 'm') AND substr(word, v + 3, 1) IN ('a', 'e')),
doubled AS (
  SELECT word, p, substr(word, p + 1, n) AS root, row_number() OVER (PARTITION BY word ORDER BY p, n DESC) AS k
  FROM (SELECT *, unnest(generate_series(2, length(word))) AS n FROM copied) x
  WHERE p + n <= length(word) AND starts_with(substr(word, p + 1), substr(word, 1, v + 1)) AND {noun("substr(word, p + 1, n)")}),
begun AS ({plain} UNION ALL {other}
  UNION ALL SELECT word, [0, 0, 0, 0], 'noun', root, substr(word, p + length(root) + 1), true FROM doubled WHERE k = 1)"""


def search_sql(words: str, ask: str) -> str:
    """``ask``, a SELECT over ``chains`` or ``analyses``; ``words`` are the common tables before it,
    among them ``words`` (word) and ``lex`` (word)."""
    pairs = ", ".join(str(a * 100 + b) for a in GROUPS for b in GROUPS if may_follow(a, b))
    met: dict[tuple, list[str]] = {}
    for key, *rest in form_rows():
        met.setdefault(tuple(rest), []).append(key)
    numbers = {key: k for k, key in enumerate(sorted({key for keys in met.values() for key in keys}), 1)}
    rows = ", ".join(f"({[numbers[key] for key in keys]}, '{start}', '{target}', '{name}', {group}, {str(once).lower()}, {arc}, {k}, '{form}')" for (start, target, _, name, group, once, arc, k, form), keys in met.items())
    endings = "(" + ", ".join(f"'{e}'" for e in _ENDINGS) + ")"
    short = "right(form, 1) IN ('a', 'e') AND starts_with(rest, left(form, length(form) - 1)) AND length(form) <= length(rest)"
    return f"""WITH RECURSIVE {words}, {starts_sql()},
listed AS (SELECT * FROM (VALUES {rows}) f(keys, source, target, suffix, grp, once, arc, k, form)),
form AS (SELECT unnest(keys) AS fkey, source, target, suffix, grp, once, arc, k, form FROM listed),
walk AS (
  SELECT word, start, pos, root, rest, twice, pos AS kind, root AS stem, CAST(NULL AS INTEGER) AS was, CAST([] AS INTEGER[]) AS path, CAST([] AS VARCHAR[]) AS chain, CAST([] AS VARCHAR[]) AS makes, CAST([] AS VARCHAR[]) AS forms FROM begun
  UNION ALL
  SELECT word, start, pos, root, CASE WHEN starts_with(rest, form) THEN substr(rest, length(form) + 1) ELSE substr(rest, length(form)) END, twice, target, concat(stem, form), grp,
    list_concat(path, [arc, k]), list_append(chain, suffix), list_append(makes, target), list_append(forms, form)
  FROM (SELECT *, list_position({list(numbers)}, {o.stem_key("stem")}) AS own FROM walk WHERE rest <> '') w JOIN form ON fkey = own AND source = kind
  WHERE (was IS NULL OR was * 100 + grp IN ({pairs})) AND NOT (once AND list_contains(chain, suffix))
    AND (starts_with(rest, form) OR ({short} AND substr(rest, length(form), 4) IN {endings}))),
chains AS (
  SELECT word, start, kind AS final_pos, chain, min(path) AS path, arg_min(root, path) AS root, arg_min(pos, path) AS pos, bool_or(twice) AS intensified, arg_min(makes, path) AS makes, arg_min(forms, path) AS forms
  FROM walk WHERE rest = '' GROUP BY word, start, kind, length(stem), chain),
analyses AS (
  SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY start, path, root, pos, chain) - 1 AS INTEGER) AS cand_ord, root, pos, final_pos,
    CASE WHEN intensified THEN list_concat(['{INTENSIFIER}'], chain) ELSE chain END AS chain, CASE WHEN intensified THEN list_concat(['noun'], makes) ELSE makes END AS makes,
    CASE WHEN intensified THEN list_concat([''], forms) ELSE forms END AS forms FROM chains)
{ask}"""


def _lists_sql() -> tuple[str, str]:
    """``lists`` (fkey, suffix, opts) of all forms, and the key in it of a ``stem``."""
    same: dict[tuple, list[int]] = {}
    numbers: dict[str, int] = {}
    for key, name, forms in form_lists():
        same.setdefault((name, *forms), []).append(numbers.setdefault(key, len(numbers) + 1))
    same[(INTENSIFIER, INTENSIFIER)] = list(numbers.values())
    rows = ", ".join(f"({keys}, '{name}', CAST({forms} AS VARCHAR[]))" for (name, *forms), keys in same.items())
    return f"lists AS (SELECT unnest(keys) AS fkey, suffix, opts FROM (VALUES {rows}) v(keys, suffix, opts))", f"list_position({list(numbers)}, {o.stem_key('stem')})"


def gold_ask() -> str:
    """Every one of ``analyses`` as a logged JSON line, to be asked of ``search_sql``."""
    lists, own = _lists_sql()
    item = """concat('{"name":"', chain[i], '","form":"', made[i], '","makes":"', upper(makes[i]), '"}')"""
    return f""", {lists},
fold AS (
  SELECT word, cand_ord, root, final_pos, chain, makes, 0 AS k, root AS stem, CAST([] AS VARCHAR[]) AS made FROM analyses
  UNION ALL
  SELECT word, cand_ord, root, final_pos, chain, makes, k + 1, concat(stem, coalesce(opts[1], '')), list_append(made, coalesce(opts[1], ''))
  FROM (SELECT *, {own} AS own FROM fold WHERE k < len(chain)) w JOIN lists ON fkey = own AND suffix = chain[k + 1])
SELECT word, cand_ord, concat('{{"word":"', word, '","root":"', root, '","suffixes":[', array_to_string(list_transform(generate_series(1, len(chain)), lambda i: {item}), ','), '],"final_pos":"', final_pos, '"}}') AS line
FROM fold WHERE k = len(chain)"""


def segments_ask() -> str:
    """The surface pieces of ``analyses`` as a recursion over chains, to be asked of ``search_sql``."""
    lists, own = _lists_sql()
    first = lambda test, what="opts": f"list_filter({what}, lambda f: {test})[1]"
    here = "c <= length(word) AND starts_with(substr(word, c + 1), {})"
    less = "left(f, length(f) - 1)"
    offsets = " ".join(f"WHEN length(root) > {i} AND len(list_filter(opts, lambda f: starts_with(substr(word, length(root) - {i} + 1), f))) > 0 THEN length(root) - {i}" for i in range(3))
    return f""", {lists},
fold AS (
  SELECT word, cand_ord, root, pos, final_pos, chain, CASE WHEN front <> '' THEN 1 ELSE 0 END AS k, length(front) + length(root) AS cursor, concat(front, root) AS stem,
    CASE WHEN front <> '' THEN [front] ELSE CAST([] AS VARCHAR[]) END AS shown, CASE WHEN front <> '' THEN [chain[1]] ELSE CAST([] AS VARCHAR[]) END AS names,
    list_concat([concat(root, CASE WHEN pos = 'verb' THEN '-' ELSE '' END)], CASE WHEN front <> '' THEN [concat(front, root)] ELSE CAST([] AS VARCHAR[]) END) AS made
  FROM (SELECT *, CASE WHEN coalesce(chain[1], '') = '{INTENSIFIER}' AND strpos(word, root) > 1 THEN left(word, strpos(word, root) - 1) ELSE '' END AS front FROM analyses) a
  UNION ALL
  SELECT word, cand_ord, root, pos, final_pos, chain, k + 1,
    c - CASE WHEN exact IS NULL AND narrow IS NULL AND early IS NOT NULL THEN 1 ELSE 0 END + length(coalesce(exact, narrow, early, opts[1], '')), concat(stem, coalesce(exact, narrow, early, opts[1], '')),
    CASE WHEN coalesce(exact, narrow, early) IS NOT NULL THEN list_append(shown, coalesce(nullif(coalesce(exact, narrow, early), ''), '(ø)')) WHEN len(opts) > 0 THEN list_append(shown, concat(opts[1], '?')) ELSE shown END,
    CASE WHEN coalesce(exact, narrow, early, opts[1]) IS NOT NULL THEN list_append(names, chain[k + 1]) ELSE names END,
    CASE WHEN coalesce(exact, narrow, early) IS NOT NULL THEN list_append(made, concat(stem, coalesce(exact, narrow, early))) ELSE made END
  FROM (
    SELECT *, {first(here.format("f"))} AS exact, {first("f <> '' AND starts_with(substr(word, c), f)")} AS early,
      CASE WHEN len(list_filter(chain[k + 2:], lambda s: contains(s, 'iyor'))) > 0 THEN (list_transform(list_filter(opts, lambda f: right(f, 1) IN ('a', 'e') AND {here.format(less)}), lambda f: {less}))[1] END AS narrow
    FROM (SELECT w.*, opts, CASE WHEN k > 0 OR starts_with(word, root) THEN cursor {offsets} ELSE cursor END AS c
      FROM (SELECT *, {own} AS own FROM fold WHERE k < len(chain)) w JOIN lists ON fkey = own AND suffix = chain[k + 1]) x) y)
SELECT word, cand_ord, concat(root, ' (', pos, ')') AS root_str, final_pos, len(chain) > 0 AS has_chain, array_to_string(shown, ' + ') AS suffixes_str, array_to_string(names, ' + ') AS names_str,
  CASE WHEN len(chain) > 0 THEN array_to_string(made, ' → ') ELSE concat(made[1], ' (no suffixes)') END AS formation_str FROM fold WHERE k = len(chain)"""
