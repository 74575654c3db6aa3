"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .jaccard import op6_jaccard_join
from .language import op10_language_id
from .licenses import op7_license_scan
from .manifest import op13_merkle_manifest
from .passages import op11_passage_quality
from .pieces import op1_sentencepiece
from .pii import op9_personal_data
from .quality import op4_line_quality
from .token_store import op2_token_ids
from .toxicity import op5_toxicity
from .warc import op8_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_ids": op2_token_ids,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_quality": op4_line_quality,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_warc": op8_warc,
    "op9_personal_data": op9_personal_data,
    "op10_language_id": op10_language_id,
    "op11_passage_quality": op11_passage_quality,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bw AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
 g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM bw)),
 dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
 h AS (SELECT doc_id, item_id, i, dg.m FROM dg JOIN g ON dg.m = g.m AND dg.gram = g.gram),
 p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS pos FROM h) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
 r(id, hop) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.y FROM r JOIN l ON r.hop = l.x),
 m AS (SELECT id, min(hop) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT page_id, h, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS UBIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) for i in range(32)], '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 2 = 1 AS shown FROM documents),
 e AS (SELECT doc_id, source, shown, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS body, replace(text, chr(10), '') AS cut FROM d),
 l AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN shown THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE body END) AS given,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM e),
 t(source, level, i, n, h) AS (SELECT source, 0, i, n, leaf FROM l UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, level, i // 3, n),
 s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
 u(level, i, n, h) AS (SELECT 0, i, n, subroot FROM s UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3, n),
 f(doc_id, source, level, i, n, h, proof) AS (SELECT doc_id, source, 0, i, n, given, '' FROM l UNION ALL
  SELECT doc_id, f.source, f.level + 1, f.i // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)), proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> f.i), '')
  FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.i // 3 = f.i // 3 WHERE f.n > 1 GROUP BY doc_id, f.source, f.level, f.i, f.n, proof),
 g(doc_id, level, i, n, h, proof) AS (SELECT doc_id, 0, s.i, s.n, h, proof FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1 UNION ALL
  SELECT doc_id, g.level + 1, g.i // 3, (g.n + 2) // 3, sha256(string_agg(CASE WHEN u.i = g.i THEN g.h ELSE u.h END, '' ORDER BY u.i)), proof || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> g.i), '')
  FROM g JOIN u ON u.level = g.level AND u.i // 3 = g.i // 3 WHERE g.n > 1 GROUP BY doc_id, g.level, g.i, g.n, proof)
SELECT l.doc_id, leaf, subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN g ON g.doc_id = l.doc_id AND g.n = 1 JOIN (SELECT h FROM u WHERE n = 1) r ON true""",
}
