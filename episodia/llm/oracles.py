"""DuckDB SQL for the dealt queries that SQL can express."""

from __future__ import annotations

from .decontam import WINDOW
from .licenses import CONTAINMENT, LETTERS, NAMES, PHRASES, TEMPLATES

ORACLES: dict[str, str] = {}

_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, pos, '{label}' AS label FROM words WHERE "
    + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(phrase.split())) for phrase, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', '{text}', '{NAMES.get(label, '')}')" for label, text in TEMPLATES.items())
ORACLES["op5_license_scan"] = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}') t FROM documents),
split AS (SELECT doc_id, regexp_extract_all(t, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') ws FROM texts),
placed AS (SELECT doc_id, unnest(ws) w0, generate_subscripts(ws, 1) - 1 pos FROM split),
words AS (
  SELECT *, lead(w0, 1) OVER o w1, lead(w0, 2) OVER o w2, lead(w0, 3) OVER o w3
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
hits AS ({_PHRASES}),
base AS (
  SELECT doc_id, count(*) n_base, min(pos) first_word, max(pos) last_word, list_distinct(list(label)) labels
  FROM hits GROUP BY doc_id),
templates AS (
  SELECT label, name, list_distinct(regexp_extract_all(lower(t), '[0-9a-z]+')) tokens
  FROM (VALUES {_TEMPLATES}) AS x(label, t, name)),
blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) tokens
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM texts)),
held AS (
  SELECT doc_id, label, len(list_intersect(b.tokens, t.tokens)) / len(t.tokens) score
  FROM blocks b, templates t WHERE len(list_intersect(b.tokens, t.tokens)) >= {CONTAINMENT} * len(t.tokens) - 1e-9
    AND (name = '' OR list_contains(b.tokens, name))),
more AS (SELECT doc_id, list_distinct(list(label)) labels, max(score) score FROM held GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, more.labels))), ','), '') AS labels,
       CAST(coalesce(more.score, 0) AS DOUBLE) AS score
FROM split s LEFT JOIN base ON base.doc_id = s.doc_id LEFT JOIN more ON more.doc_id = s.doc_id
"""

ORACLES["op10_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id query_id, c.vec_id vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), '" + LETTERS + "', '" + LETTERS.lower()
          + "'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')")
ORACLES["op13_benchmark_decontamination"] = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') item, {_WORDS} ws FROM benchmark),
starts AS (
  SELECT item, ws, least(len(ws), {WINDOW}) n, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) k
  FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') phrase FROM starts),
split AS (SELECT row_number() OVER () row, doc_id, {_WORDS} ws FROM documents),
placed AS (SELECT row, ws, unnest(range(1, len(ws) + 1)) k FROM split),
runs AS (
  SELECT row, k, n, array_to_string(ws[k:k + n - 1], ' ') phrase
  FROM placed, (SELECT DISTINCT n FROM windows) AS widths WHERE k + n - 1 <= len(ws)),
found AS (SELECT row, k, n, item FROM runs JOIN windows USING (n, phrase)),
hit AS (SELECT row, count(*) n_hit FROM (SELECT DISTINCT row, unnest(range(k, k + n)) FROM found) GROUP BY row),
held AS (SELECT row, list_sort(list(DISTINCT item)) items FROM found GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM split LEFT JOIN hit USING (row) LEFT JOIN held USING (row)
"""
