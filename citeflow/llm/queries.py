"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from citeflow.llm.alignment import op13
from citeflow.llm.bpe import op7
from citeflow.llm.jaccard_join import op8
from citeflow.llm.licences import op12
from citeflow.llm.licences import sql as licence_sql
from citeflow.llm.line_dedup import op2
from citeflow.llm.masked_lm import op4
from citeflow.llm.mixing import op1
from citeflow.llm.quality import op5
from citeflow.llm.secrets import op3
from citeflow.llm.syncmers import op6
from citeflow.llm.token_counts import op9
from citeflow.llm.warc_zip import SQL as WARC_SQL
from citeflow.llm.warc_zip import op10
from citeflow.llm.whitening import op11

QUERIES = {
    "op1_mixing": op1,
    "op2_line_dedup": op2,
    "op3_secret_scan": op3,
    "op4_lm_scoring": op4,
    "op5_quality_rules": op5,
    "op6_fingerprints": op6,
    "op7_bpe": op7,
    "op8_jaccard_join": op8,
    "op9_token_counts": op9,
    "op10_warc": op10,
    "op11_whitening": op11,
    "op12_licence_scan": op12,
    "op13_alignment": op13,
}

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.k + y.k - c)
), both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT d.doc_id, CAST(coalesce(max(n.k), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLE_SQL = {"op8_jaccard_join": JACCARD_SQL, "op10_warc": WARC_SQL, "op12_licence_scan": licence_sql()}
