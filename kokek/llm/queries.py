"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kokek.llm import divergence, lm_scores, media, mixing, near_dedup, pieces, pii, quality, secrets, simhash, substrings, token_counts, vector_codes
from kokek.llm.common import documents

#: Where the public vocabulary files are; see ``vocabulary``.
VOCABULARIES = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """A file of the installed vocabulary package, or of VOCABULARIES without it."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{VOCABULARIES}/{name}"
    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(documents(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir)).drop("media", "tile")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), ids=False)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_lm_scores": op4_lm_scores,
    "op5_media_columns": op5_media_columns,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}

def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rounds written out: components as rows, distances by joining them to the entries' ones."""
    text = f"""WITH vec AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (SELECT r, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS i, x FROM (SELECT r, len(e) AS n, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vec) y),
book0 AS (SELECT p, j, i, x AS c FROM comp JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM vec ORDER BY vec_id LIMIT {entries}) f USING (r))"""
    for k in range(rounds + 1):
        text += f""",
far{k} AS (SELECT r, p, j, sum((x - c) * (x - c)) AS d FROM comp JOIN book{k} USING (p, i) GROUP BY ALL),
code{k} AS MATERIALIZED (SELECT r, p, arg_min(j, d * {entries} + j) AS j, min(d) AS d FROM far{k} GROUP BY 1, 2)"""
        if k < rounds:
            text += f""",
sum{k} AS (SELECT p, j, i, sum(x) AS s, count(*) AS n FROM comp JOIN code{k} USING (r, p) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT p, j, i, CAST(coalesce((s - ((s % n) + n) % n) // n, c) AS BIGINT) AS c FROM book{k} LEFT JOIN sum{k} USING (p, j, i))"""
    return text + f""",
named AS (SELECT r, vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM code{rounds} JOIN vec USING (r) GROUP BY 1, 2, 3)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, j, i)) FROM book{rounds}) AS codebooks_sha256 FROM named"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * pair.n >= 80 * (x.n + y.n - pair.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM named LEFT JOIN sized USING (doc_id)""",
    "op4_lm_scores": rf"""
WITH split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM split),
gram AS (
  SELECT doc_id, n, k, w AS g1, concat(lag(w) OVER d, ' ', w) AS g2, concat(lag(w, 2) OVER d, ' ', lag(w) OVER d, ' ', w) AS g3
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
total AS (SELECT count(*) AS n FROM word),
one AS (SELECT g1, sum(n) AS t, map_from_entries(list((doc_id, n))) AS own FROM (SELECT doc_id, g1, count(*) AS n FROM gram GROUP BY 1, 2) x GROUP BY 1),
two AS (SELECT g2, sum(n) AS t, map_from_entries(list((doc_id, n))) AS own FROM (SELECT doc_id, g2, count(*) AS n FROM gram WHERE k > 1 GROUP BY 1, 2) x GROUP BY 1),
three AS (SELECT g3, sum(n) AS t, map_from_entries(list((doc_id, n))) AS own FROM (SELECT doc_id, g3, count(*) AS n FROM gram WHERE k > 2 GROUP BY 1, 2) x GROUP BY 1),
held AS (
  SELECT doc_id, n, k, CAST(one.t - one.own[doc_id] AS DOUBLE) AS c1, CAST(two.t - two.own[doc_id] AS DOUBLE) AS c2, CAST(three.t - three.own[doc_id] AS DOUBLE) AS c3
  FROM gram JOIN one USING (g1) LEFT JOIN two ON gram.k > 1 AND two.g2 = gram.g2 LEFT JOIN three ON gram.k > 2 AND three.g3 = gram.g3),
near AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2, least(k, 3) AS most FROM held WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
scored AS (
  SELECT doc_id, most - CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS lost,
    CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) WHEN c1 > 0 THEN ln(c1 / (total.n - near.n)) ELSE -ln(total.n) END AS s
  FROM near CROSS JOIN total),
summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (lost > 0) AS back, sum(round((s + lost * ln(0.4)) * 1048576) / 1048576) AS s FROM scored GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(back, 0) AS BIGINT) AS n_backoff,
  round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_log_score
FROM documents d LEFT JOIN summed USING (doc_id)""",
    "op7_substring_dedup": rf"""
WITH split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
start AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM split WHERE len(w) >= 13),
win AS (SELECT doc_id, k, array_to_string(w[k:k+12], ' ') AS g FROM start),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM late CROSS JOIN range(0, 13) AS r(j)),
word AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM split),
kept AS (
  SELECT word.doc_id, count(*) AS n, count(gone.k) AS removed, coalesce(string_agg(w, ' ' ORDER BY word.k) FILTER (gone.k IS NULL), '') AS rest
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op12_source_divergence": r"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
own AS (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
part AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY 1, 2),
cell AS (
  SELECT lang, source, term, coalesce(own.n, 0) AS c, CAST(1 + 1000000000 * CAST(coalesce(own.n, 0) + 5 AS HUGEINT) // (coalesce(part.n, 0) + 5 * size.v) AS BIGINT) AS p,
    CAST(1 + 1000000000 * CAST(kept.n + 5 AS HUGEINT) // (size.n + 5 * size.v) AS BIGINT) AS q
  FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN part USING (lang, source) LEFT JOIN own USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM cell x JOIN cell y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d ON d.lang = a.lang AND s = a.source AND t = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM cell WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM (SELECT * FROM pair UNION ALL SELECT * FROM more) x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 50""",
    "op13_vector_codes": _codes_sql(),
}
