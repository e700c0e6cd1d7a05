"""DuckDB SQL with the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from textloom.llm import quality_rules, topk
from textloom.llm.chat import TEMPLATE

_SPLIT = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

TOPK = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAMS = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
d AS MATERIALIZED (SELECT a, b FROM c UNION SELECT b, a FROM c),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT d.b, reach.root FROM reach JOIN d ON reach.doc_id = d.a)
SELECT r.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r JOIN s ON r.doc_id = s.doc_id
"""

# The rules' predicates in this dialect; tests hold both against each other on the driver's tables.
_RULES = r"""10 * n_symbols > n_words
  OR (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * len(lines))
  OR word_chars < 2 * n_words OR word_chars > 14 * n_words
  OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
  OR 5 * length(regexp_replace(t, '[^!?]+', '', 'g')) > n_words
  OR len(list_distinct(w)) * len(list_distinct(w)) < n_words"""

QUALITY = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM h, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_RULES}) AS kept FROM b
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in TEMPLATE.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\e{c[1:]}')"
    return out


CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TEMPLATE.start) + len(TEMPLATE.sep) + len(TEMPLATE.end)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM c GROUP BY conv_id
"""

ORACLES = {"op1_topk_search": TOPK, "op4_ngram_join": NGRAMS, "op7_quality_rules": QUALITY, "op10_chat_formatting": CHAT}
