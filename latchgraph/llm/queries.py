"""The queries of this subpackage and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_jaccard_join import op1
from .op2_lm_scoring import op2
from .op3_packing import op3
from .op4_url_filters import op4
from .op5_html_extraction import op5
from .op6_mixing import op6
from .op7_substring_dedup import op7
from .op8_exact_topk import op8
from .op9_fingerprints import op9
from .op10_language_id import op10
from .op11_conversation_trie import op11
from .op12_piece_encoding import op12
from .op13_source_divergence import op13

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE lists AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS pos, len(w) AS n FROM lists),
runs AS (SELECT doc_id, a, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c, pos, n FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
sets AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS s FROM runs WHERE c IS NOT NULL OR (n < 3 AND pos = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

OP7 = rf"""
WITH lists AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM lists),
windows AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM words),
whole AS (SELECT doc_id, pos, k, min(doc_id * 100000000 + pos) OVER (PARTITION BY k) AS first FROM windows WHERE pos <= n - 19),
covered AS (SELECT DISTINCT doc_id, pos + i AS pos FROM whole, (SELECT unnest(range(20)) AS i) t WHERE first < doc_id * 100000000 + pos),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS text, count(*) AS n FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.pos = w.pos WHERE c.pos IS NULL GROUP BY w.doc_id)
SELECT l.doc_id, len(l.w) AS n_words, len(l.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM lists l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = """
WITH turns AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, ''))::BIGINT AS len,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM sizes),
taken AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(s.n, 0)) AS k FROM heads h LEFT JOIN sizes s ON s.conv_id = h.base),
paths AS (SELECT t.conv_id, b.pos AS d, b.k, b.len FROM taken t JOIN turns b ON b.conv_id = t.base AND b.pos <= t.k
  UNION ALL SELECT t.conv_id, o.pos - t.h + t.k, o.k, o.len FROM taken t JOIN turns o ON o.conv_id = t.conv_id AND o.pos > t.h),
keyed AS (SELECT conv_id, d, len, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM paths UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
ends AS (SELECT conv_id, max_by(key, d) AS key FROM keyed GROUP BY conv_id),
lists AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ends GROUP BY key),
nodes AS (SELECT key, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(len) AS len, left(key, greatest(length(key) - 64, 0)) AS up FROM keyed GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
sums AS (SELECT x.key, sum((y.n_convs - 1) * y.len)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM nodes x JOIN nodes y ON starts_with(y.key, x.key) LEFT JOIN kids k ON k.key = y.key GROUP BY x.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN lists l ON l.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.up
"""

OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT i, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ps AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cells),
qs AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, v, sum(n) AS n FROM cells GROUP BY ALL)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM ps JOIN qs USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1,
        "op2_lm_scoring": op2,
        "op3_packing": op3,
        "op4_url_filters": op4,
        "op5_html_extraction": op5,
        "op6_source_mixing": op6,
        "op7_substring_dedup": op7,
        "op8_exact_topk": op8,
        "op9_fingerprints": op9,
        "op10_language_id": op10,
        "op11_conversation_trie": op11,
        "op12_piece_encoding": op12,
        "op13_source_divergence": op13,
    }


def oracle_sql() -> dict[str, str]:
    """Of the rest, hash order, tokenizers and trained models have no SQL; tests hold them against plain versions."""
    return {"op1_ngram_jaccard_join": OP1, "op7_substring_dedup": OP7, "op8_exact_topk": OP8, "op11_conversation_trie": OP11, "op13_source_divergence": OP13}
