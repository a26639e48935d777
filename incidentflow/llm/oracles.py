"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, w[i:i + 2] AS g FROM win),
often AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN often USING (doc_id, g)) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN cover USING (doc_id)),
more AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS capitals,
         length(text) - length(replace(text, '!', '')) AS marks,
         length(text) - length(regexp_replace(text, '[!-+\-/-@\[-`{{-\x7F\x00-\x08\x0E-\x1F]', '', 'g')) AS others
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 100 * capitals > 50 * word_chars OR 5 * marks > n_words
            OR 100 * others > 50 * word_chars) AS kept
FROM more"""


def _codes(rounds: int = 4) -> str:
    """Rounds of assignment and floored means, one pair of CTEs each."""
    steps = ["""
k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, list_slice(v, part * (len(v) // 4) + 1, (part + 1) * (len(v) // 4)) AS x
  FROM k, (SELECT unnest([0, 1, 2, 3]) AS part)),
b0 AS MATERIALIZED (
  SELECT part, e, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p) WHERE e < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 256 + e) AS best FROM (
    SELECT p.vec_id, p.part, b.e, CAST(list_sum(list_transform(list_zip(p.x, b.x),
           lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN b{r} b ON b.part = p.part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, best % 256 AS e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT p.part, a.best, unnest(p.x) AS c, unnest(range(len(p.x))) AS i
    FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY part, best % 256, i),
n{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY part, e),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.e = b.e)""")
    return "WITH" + ",".join(steps) + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN k USING (vec_id) GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, label_error, h AS codebooks_sha256
FROM coded JOIN k USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM k.label, books"""


CODES = _codes()

PHRASES = f"""
WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE d < doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM pos ANTI JOIN hit USING (doc_id, p)
         GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op3_quality_rules": QUALITY, "op12_vector_codes": CODES, "op13_phrase_dedup": PHRASES}
