"""The queries of this subpackage, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, cover_tree, decontaminate, jaccard_join, language_id, sentence_pieces, sharding, suffix_dedup, token_files, warc

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

#: Words as operator 4 takes them: A-Z lower-cased, cut at ASCII characters that are neither digits nor letters.
_OP4 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cut AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT cut.r, cut.i, cut.n, win.item_id FROM cut JOIN win USING (n, s)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def queries() -> dict[str, Callable]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_token_files": token_files.op2_token_files,
        "op3_warc": warc.op3_warc,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language_id": language_id.op5_language_id,
        "op6_sentencepiece": sentence_pieces.op6_sentencepiece,
        "op7_jaccard": jaccard_join.op7_jaccard,
        "op8_cover_tree": cover_tree.op8_cover_tree,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_chat": chat.op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.ORACLE, "op3_warc": _OP3, "op4_decontaminate": _OP4, "op7_jaccard": jaccard_join.ORACLE, "op8_cover_tree": cover_tree.ORACLE, "op9_suffix_dedup": suffix_dedup.ORACLE, "op10_chat": chat.ORACLE}
