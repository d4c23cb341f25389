"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pulsegrid.llm.byte_bpe import op8_byte_bpe
from pulsegrid.llm.fingerprint import op10_fingerprints
from pulsegrid.llm.langid import op2_language_id
from pulsegrid.llm.media import op4_iso_media
from pulsegrid.llm.neardup import op7_near_duplicates
from pulsegrid.llm.packing import op6_packing
from pulsegrid.llm.pylm import op9_pitman_yor
from pulsegrid.llm.quality import op3_quality
from pulsegrid.llm.sharding import op5_uniform_shards
from pulsegrid.llm.token_store import op1_token_store

QUERIES = {f.__name__: f for f in (op1_token_store, op2_language_id, op3_quality, op4_iso_media, op5_uniform_shards, op6_packing, op7_near_duplicates, op8_byte_bpe, op9_pitman_yor, op10_fingerprints)}
QUERIES["pipeline"] = corpus_pipeline.run

#: Shingle sets, links and components by plain SQL; quadratic in the size of a group, so for small tables only.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN k ON k.x = doc_id"""
ORACLES: dict[str, str] = {"op7_near_duplicates": NEAR_DUPLICATES}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
