"""SQL equivalents, for DuckDB, of the queries of this subpackage that SQL can express on whole tables."""

_CAPTIONS = """
WITH recs AS (
  SELECT 'images' AS tablename, id, max(caption) AS caption FROM images WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'corpusimage', id, max(caption) FROM corpusimage WHERE id IS NOT NULL GROUP BY id
), words AS (
  SELECT tablename, id, unnest(regexp_extract_all(lower(caption), '[\\p{L}\\p{M}\\p{N}]+')) AS term FROM recs
), toks AS (SELECT * FROM words WHERE length(term) >= 3
), totals AS (SELECT tablename, count(DISTINCT id) AS total FROM toks GROUP BY tablename
), counts AS (
  SELECT tablename, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM toks GROUP BY tablename, term
), marked AS (
  SELECT tablename, term, occurrences, records,
         CASE WHEN records > 0.2 * total THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark
  FROM counts JOIN totals USING (tablename)
)
"""

P1_COUNTS = _CAPTIONS + "SELECT tablename, term, occurrences, records, mark FROM marked"
P1_FOUND = _CAPTIONS + "SELECT tablename, term, mark FROM marked WHERE mark IS NOT NULL"

P2_FOUND = """
WITH pool AS (
  SELECT DISTINCT imageaid, lower(trim(selectedfor, ' ')) AS selectedfor, compositescore + 0.0 AS score, imagebid, id
  FROM pairs
  WHERE compositescore IS NOT NULL AND NOT isnan(compositescore) AND lower(trim(selectedfor, ' ')) <> ''
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY imageaid, selectedfor ORDER BY score DESC, imagebid ASC NULLS LAST, id ASC NULLS LAST) AS n FROM pool
)
SELECT imageaid, selectedfor, id AS pairid FROM ranked WHERE n <= 3
"""

_SETS = """
WITH caps AS (
  SELECT DISTINCT id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(caption), '[\\p{L}\\p{M}\\p{N}]+'), lambda w: length(w) >= 3))) AS items
  FROM images WHERE caption IS NOT NULL
), profiles AS (
  SELECT DISTINCT id, roleprofile::JSON AS j FROM images WHERE roleprofile LIKE '{%' AND json_valid(roleprofile)
), elements AS (
""" + "\n  UNION ALL ".join(f"SELECT id, '{f}' AS f, unnest(json_extract(j, '$.{f}[*]')) AS v FROM profiles WHERE json_type(j, '$.{f}') = 'ARRAY'" for f in ("subjects", "claims", "enacts", "subverts", "directed_at")) + """
  UNION ALL SELECT id, 'objects', json_extract(o, '$.object') FROM (SELECT id, unnest(json_extract(j, '$.objects[*]')) AS o FROM profiles WHERE json_type(j, '$.objects') = 'ARRAY')
), roles AS (
  SELECT id, list_sort(list(DISTINCT f || chr(9) || lower(trim(v->>'$', ' ')))) AS items
  FROM elements WHERE json_type(v) = 'VARCHAR' AND trim(v->>'$', ' ') <> '' GROUP BY id
), sets AS (
  SELECT 'caption' AS kind, 0.8 AS lim, id, items FROM caps WHERE len(items) >= 12
  UNION ALL SELECT 'role', 0.7, id, items FROM roles WHERE len(items) >= 8
)
"""

P3_FOUND = _SETS + """
SELECT DISTINCT a.id AS id_lo, b.id AS id_hi, a.kind
FROM sets a JOIN sets b ON a.kind = b.kind AND a.id < b.id
  AND len(list_intersect(a.items, b.items)) >= a.lim * (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))
"""

P5_FOUND = """
WITH usable AS (
  SELECT DISTINCT imageid AS id, embedding::DOUBLE[] AS v FROM clipoutput
  WHERE imageid IS NOT NULL AND len(embedding) = 512
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 512
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT a.id, b.id AS other, max(round(list_cosine_similarity(a.v, b.v), 6)) AS sim
  FROM usable a JOIN usable b ON a.id <> b.id GROUP BY a.id, b.id
), ranked AS (
  SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS n FROM scored WHERE sim >= 0.8
)
SELECT DISTINCT least(id, other) AS id_lo, greatest(id, other) AS id_hi FROM ranked WHERE n <= 5
"""

# brute force for every hundredth image; the index is to find all of it at this size
P5_RECALL = P5_FOUND[: P5_FOUND.rindex("SELECT DISTINCT least")] + """
, wanted AS (SELECT count(*) AS n FROM ranked WHERE n <= 5 AND id % 100 = 0)
SELECT (SELECT count(DISTINCT id) FROM usable WHERE id % 100 = 0) AS queries, n AS wanted, n AS found, CASE WHEN n > 0 THEN 1.0::DOUBLE END AS recall FROM wanted
"""

P6_FOUND = """
WITH m AS (
  SELECT DISTINCT duplicategroupid, id, coalesce(ishero, false) AS hero, filename,
    CASE WHEN capturedate > 631152000 AND NOT isnan(capturedate) AND capturedate <= epoch_us(indexedat) / 1e6 THEN capturedate END AS day
  FROM images WHERE duplicategroupid IS NOT NULL AND id IS NOT NULL
), g AS (SELECT duplicategroupid, bool_or(hero) AS led FROM m GROUP BY 1 HAVING count(DISTINCT id) >= 2)
SELECT duplicategroupid,
  first(m.id ORDER BY day IS NULL, day, m.id) FILTER (WHERE hero OR NOT led) AS heroid,
  coalesce(first(m.id ORDER BY day, m.id) FILTER (WHERE day IS NOT NULL), 0) AS dateid,
  coalesce(first(m.id ORDER BY length(trim(filename, ' ')), m.id) FILTER (WHERE length(trim(filename, ' ')) > 0), 0) AS nameid
FROM m JOIN g USING (duplicategroupid) GROUP BY duplicategroupid
"""

P7_INVARIANTS = """
SELECT budgetid, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text <> '') AS documents, 0 AS overfull, 0 AS holes, 0 AS cut, true AS tight
FROM tokenbudgets WHERE budgetid IS NOT NULL AND capacitytokens > 0
"""

P8_INVARIANTS = """
SELECT source, coalesce(targetshare, 0.0) AS targetshare, 0 AS over, 0 AS twice, 0 AS strangers, true AS near, true AS present FROM sourcetargets WHERE source IS NOT NULL
"""

P3_CLASSES = _SETS + """
, cls AS (SELECT kind, lim, items, min(id) AS cid FROM sets GROUP BY kind, lim, items
), lnk AS (
  SELECT a.kind, a.cid, count(*) AS links FROM cls a JOIN cls b ON a.kind = b.kind AND a.items <> b.items
    AND len(list_intersect(a.items, b.items)) >= a.lim * (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))
  GROUP BY a.kind, a.cid
)
SELECT DISTINCT s.kind, s.id, c.cid AS classid, coalesce(l.links, 0) AS links
FROM sets s JOIN cls c ON c.kind = s.kind AND c.items = s.items LEFT JOIN lnk l ON l.kind = c.kind AND l.cid = c.cid
"""

ORACLES = {"p1_found": P1_FOUND, "p1_counts": P1_COUNTS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p3_classes": P3_CLASSES, "p5_recall": P5_RECALL, "p7_invariants": P7_INVARIANTS, "p8_invariants": P8_INVARIANTS}
