"""SQL equivalents of the core queries for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

from tandem.functions import vocab


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


IMG = "img AS (SELECT DISTINCT * FROM images WHERE id IS NOT NULL)"
PRS = "prs AS (SELECT DISTINCT id, imageaid AS a, imagebid AS b FROM pairs WHERE id IS NOT NULL AND imageaid IS NOT NULL AND imagebid IS NOT NULL)"
_F = "CASE WHEN {0} IS NOT NULL AND isfinite({0}) THEN {0} ELSE 0.0 END"
SCO = f"""sco AS (SELECT DISTINCT id, imageaid AS a, imagebid AS b, {_F.format('aestheticscore')} AS aesthetic, {_F.format('geometricscore')} AS geometric,
  {_F.format('thematicscore')} AS thematic, {_F.format('compositescore')} AS composite, aestheticsubmode, geometricsubmode, lower(trim(selectedfor, ' ')) AS selectedfor
  FROM pairs WHERE id IS NOT NULL AND imageaid IS NOT NULL AND imagebid IS NOT NULL)"""
META = """meta AS (SELECT id, max(folderid) AS folderid, max(capturedate) AS date, coalesce(max(filename), '') AS filename, coalesce(max(caption), '') AS caption,
  coalesce(lower(trim(max(colorprofile), ' ')) = 'bw', false) AS bw, max(gazedirectionx) AS gaze, (id * 7) % 24 * 15 + 7.5 AS hue, (id * 11) % 75 / 100.0 + 0.25 AS sat,
  (id * 13) % 100 / 100.0 AS x, (id * 29) % 100 / 100.0 AS y FROM images WHERE id IS NOT NULL GROUP BY id)"""
META = META.replace("(id * 7) % 24 * 15 + 7.5 AS hue", "((id * 7) % 24 * 15 + 7.5)::DOUBLE AS hue").replace("(id * 11) % 75 / 100.0 + 0.25 AS sat", "((id * 11) % 75)::DOUBLE / 100 + 0.25::DOUBLE AS sat").replace("(id * 13) % 100 / 100.0 AS x", "((id * 13) % 100)::DOUBLE / 100 AS x").replace("(id * 29) % 100 / 100.0 AS y", "((id * 29) % 100)::DOUBLE / 100 AS y")
_TOKENS = f"""list_transform(list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({_list(vocab.STOP_WORDS)})),
  lambda w: regexp_replace(w, '^(.{{{{4,}}}}?)({'|'.join(vocab.SUFFIXES)})$', '\\1'))"""


def tokens(col: str) -> str:
    return _TOKENS.format(col)


def _clusters() -> str:
    groups: dict[str, dict[int, list[str]]] = {}
    for c, g, k in vocab.default_rows():
        groups.setdefault(c, {}).setdefault(g, []).append(k)
    each = ", ".join("CASE WHEN " + " AND ".join(f"list_has_any(tok, [{_list(w)}])" for w in gs.values()) + f" THEN '{c}' END" for c, gs in sorted(groups.items()))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


TOK = f"tok AS (SELECT id, {tokens(chr(99) + 'aption')} AS tok FROM meta)"
CLU = f"clu AS (SELECT id, {_clusters()} AS cl FROM tok)"
_STRONG = [c for c, w in vocab.CLUSTER_WEIGHTS.items() if w >= vocab.MEANINGFUL]
_W = "CASE " + " ".join(f"WHEN n IN ({_list([c for c, x in vocab.CLUSTER_WEIGHTS.items() if x == w])}) THEN {w}" for w in (1.0, 0.75, 0.2)) + " ELSE 0.5 END"


def weight(col: str) -> str:
    return f"coalesce(list_sum(list_transform({col}, lambda n: ({_W})::DOUBLE)), 0.0)"


def strong(col: str) -> str:
    return f"list_intersect({col}, [{_list(_STRONG)}])"


def _dice(a: str, b: str) -> str:
    both = f"list_intersect({a}, {b})"
    return f"CASE WHEN len({strong(both)}) = 0 THEN 0.1 WHEN {weight(a)} + {weight(b)} > 0 THEN 2 * {weight(both)} / ({weight(a)} + {weight(b)}) ELSE 0.0 END"


def _bonus(a: str, b: str) -> str:
    each = [f"CASE WHEN (list_contains({a}, '{x}') AND list_contains({b}, '{y}')) OR (list_contains({a}, '{y}') AND list_contains({b}, '{x}')) THEN {v} ELSE 0.0 END" for x, y, v in vocab.AXIS_PAIRS]
    return f"greatest({', '.join(each)})::DOUBLE"


FEAT = """usable AS (SELECT imageid AS id, min(embedding) AS v FROM clipoutput WHERE imageid IS NOT NULL AND len(embedding) = 512
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 512 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY imageid),
raw AS (SELECT id, v::DOUBLE[] AS e, list_transform(v::DOUBLE[], lambda x: abs(x)) AS m FROM usable),
norms AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len2, list_sum(m[1:32]) AS s1, list_sum(m[65:128]) AS s2 FROM raw),
feat AS (SELECT id, list_transform(e, lambda x: x / len2) AS clip, list_transform(m[1:32], lambda x: x / s1) AS edge, list_transform(m[33:64], lambda x: least(x * 8, 1.0)) AS grid,
  list_transform(m[65:128], lambda x: x / s2) AS hist, list_transform(e[129:146], lambda x: x / len2 * 1000) AS palette FROM norms),
dev AS (SELECT *, least(list_max(edge) * 32 / 4.0, 1.0) AS peak, list_avg(grid[1:16]) AS mean, list_position(edge, list_max(edge)) - 1 AS bin FROM feat),
ftr AS (SELECT *, least(sqrt(list_sum(list_transform(grid[1:16], lambda x: (x - mean) * (x - mean))) / 16) / 0.20, 1.0) AS var, (bin % 16)::DOUBLE AS fold FROM dev)"""
_COS = "greatest(0.0, least(1.0, (list_dot_product(x.{0}, y.{0}) / (sqrt(list_dot_product(x.{0}, x.{0})) * sqrt(list_dot_product(y.{0}, y.{0}))) + 1) / 2))"
VIS = f"""vis AS (SELECT p.id, p.a, p.b, (list_dot_product(x.clip, y.clip) + 1) / 2 AS clip,
  list_sum(list_transform(list_zip(x.hist, y.hist), lambda z: least(z[1], z[2]))) AS harmony,
  least(list_sum(list_transform([1, 4, 7, 10, 13, 16], lambda i: list_sum(list_transform([1, 4, 7, 10, 13, 16], lambda j:
    sqrt((x.palette[i] - y.palette[j]) * (x.palette[i] - y.palette[j]) + (x.palette[i + 1] - y.palette[j + 1]) * (x.palette[i + 1] - y.palette[j + 1]) + (x.palette[i + 2] - y.palette[j + 2]) * (x.palette[i + 2] - y.palette[j + 2])))))) / 36 / 100, 1.0) AS contrast,
  {_COS.format('edge')} AS edge, {_COS.format('grid')} AS grid, x.peak AS pa, y.peak AS pb, x.var AS va, y.var AS vb,
  CASE WHEN x.peak >= 0.25 AND y.peak >= 0.25 AND abs(sin(x.fold * pi() / 8)) >= 0.5 AND abs(sin(y.fold * pi() / 8)) >= 0.5
    THEN sin(least(abs(x.fold - y.fold), 16 - abs(x.fold - y.fold)) * pi() / 16) * sqrt(x.peak * y.peak) ELSE 0.0 END AS orientation
  FROM prs p JOIN ftr x ON x.id = p.a JOIN ftr y ON y.id = p.b)"""
_GAP = "abs(x.date - y.date)"
_PEN = "CASE WHEN {0} <= 30 THEN 0.40 WHEN {0} <= 60 THEN 0.55 WHEN {0} <= 120 THEN 0.75 WHEN {0} <= 300 THEN 0.90 ELSE 1.0 END"
_ECHO = """CASE WHEN x.hue IS NULL OR y.hue IS NULL THEN 0.0 ELSE
  (CASE WHEN least(abs(x.hue - y.hue), 360 - abs(x.hue - y.hue)) <= 10 THEN 1.0 WHEN least(abs(x.hue - y.hue), 360 - abs(x.hue - y.hue)) <= 30 THEN (30 - least(abs(x.hue - y.hue), 360 - abs(x.hue - y.hue))) / 20 ELSE 0.0 END)
  * sqrt(x.sat * y.sat) * (CASE WHEN x.hue BETWEEN 15 AND 35 OR y.hue BETWEEN 15 AND 35 THEN least(greatest((least(x.sat, y.sat) - 0.45) / 0.20, 0.0), 1.0) ELSE 1.0 END) END"""


def _base(n: str) -> str:
    strip = lambda s: f"regexp_replace({s}, '^\\d+-', '')"
    tail = lambda s: f"regexp_replace({s}, '-\\d+(\\.\\w+)$', '\\1')"
    return f"[lower({n}), {strip(f'lower({n})')}, {tail(f'lower({n})')}, {tail(strip(f'lower({n})'))}]"


_VAR = f"(lower(x.filename) <> lower(y.filename) AND x.filename <> '' AND y.filename <> '' AND list_has_any({_base('x.filename')}, {_base('y.filename')}))"
_N = "least(greatest({0} / 0.30, -1.0), 1.0)"
_AHEAD = f"greatest(0.0, ({_N.format('x.gaze')} - {_N.format('y.gaze')}) / 2)"
_BACK = f"greatest(0.0, ({_N.format('y.gaze')} - {_N.format('x.gaze')}) / 2)"
_KNOWN = "x.gaze IS NOT NULL AND y.gaze IS NOT NULL"
FULL = f"""one AS (SELECT v.*, x.caption <> '' AND y.caption <> '' AS captions, cx.cl AS ca, cy.cl AS cb, {_VAR} AS variants, {_GAP} AS gap, {_PEN.format(_GAP)} AS penalty, {_ECHO} AS echo,
    CASE WHEN x.bw AND y.bw THEN 0.65 ELSE 1.0 END AS scale,
    CASE WHEN greatest(va, vb) >= 0.1 THEN (abs(x.x - y.x) * 0.70 + abs(x.y - y.y) * 0.30) * sqrt(least(va, 1.0) * least(vb, 1.0)) ELSE 0.0 END AS centroid,
    CASE WHEN {_KNOWN} THEN greatest({_AHEAD}, {_BACK}) ELSE 0.0 END AS talk, ({_KNOWN}) AND {_BACK} > {_AHEAD} AS back, ({_KNOWN}) AND {_AHEAD} > {_BACK} AS ahead,
    (edge * (CASE WHEN abs(pa - pb) > 0.5 THEN greatest(pow(pa * pb, 0.4), pow(greatest(pa, pb), 0.4) * 0.6) ELSE pow(pa * pb, 0.4) END) + grid * pow(va * vb, 0.4)) / 2 AS structural
  FROM vis v JOIN meta x ON x.id = v.a JOIN meta y ON y.id = v.b JOIN clu cx ON cx.id = v.a JOIN clu cy ON cy.id = v.b),
two AS (SELECT *, CASE WHEN echo > harmony * scale AND echo > contrast * scale THEN echo ELSE greatest(harmony, contrast) * scale END AS aesthetic,
    CASE WHEN echo > harmony * scale AND echo > contrast * scale THEN 'accent_echo' WHEN harmony * scale >= contrast * scale THEN 'harmony' ELSE 'contrast' END AS aestheticmode,
    structural * 0.50 + greatest(centroid, talk, orientation) * 0.25 + abs(va - vb) * 0.25 AS geometric,
    CASE WHEN greatest(centroid, talk, orientation) <= structural THEN 'structural' WHEN talk >= centroid AND talk >= orientation THEN 'gaze_conversation' WHEN orientation >= centroid THEN 'opposing_diagonals' ELSE 'directional_complement' END AS geometricmode,
    CASE WHEN clip < 0.30 THEN 1.35 WHEN clip < 0.60 THEN 1.0 WHEN clip < 0.88 THEN 0.75 ELSE 1.0 END AS diversity,
    {weight('list_intersect(ca, cb)')} > 5.0 AS full_,
    len({strong('list_filter(ca, lambda c: NOT list_contains(cb, c))')}) = 0 OR len({strong('list_filter(cb, lambda c: NOT list_contains(ca, c))')}) = 0 AS lopsided,
    {_dice('ca', 'cb')} AS dice, {_bonus('ca', 'cb')} AS bonus FROM one),
three AS (SELECT *, CASE WHEN full_ OR lopsided THEN 0.0 ELSE dice END AS score FROM two),
four AS (SELECT *, CASE WHEN captions THEN least(1.0, (score + CASE WHEN full_ OR score > 0.10 THEN 0.0 ELSE bonus END) * diversity) ELSE clip END AS thematic FROM three),
five AS (SELECT *, CASE WHEN captions AND thematic >= 0.20 AND thematic >= greatest(aesthetic, geometric * 0.8) THEN aesthetic * 0.25 + geometric * 0.15 + thematic * 0.60
    WHEN NOT captions AND thematic > 0.80 THEN (aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4) * 0.45 ELSE aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4 END AS base FROM four),
six AS (SELECT *, CASE WHEN variants THEN 0.0 ELSE base * (CASE WHEN clip > 0.88 THEN 0.40 WHEN clip > 0.75 AND thematic < 0.20 THEN 0.65 ELSE 1.0 END) * penalty END AS composite FROM five)"""
DEC = """ranked AS (SELECT pairid, lower(trim(decision, ' ')) AS decision, row_number() OVER (PARTITION BY pairid ORDER BY decidedat IS NOT NULL DESC, decidedat DESC, id DESC) AS n
  FROM (SELECT * FROM userdecisions WHERE pairid IS NOT NULL AND decision IS NOT NULL)),
dec AS (SELECT pairid, decision FROM ranked WHERE n = 1
  UNION ALL SELECT DISTINCT pairid, NULL FROM userdecisions WHERE pairid IS NOT NULL AND pairid NOT IN (SELECT pairid FROM ranked))"""
DEC = """ranked AS (SELECT pairid, lower(trim(decision, ' ')) AS decision, row_number() OVER (PARTITION BY pairid ORDER BY decidedat IS NOT NULL DESC, decidedat DESC, id DESC) AS n
  FROM userdecisions WHERE pairid IS NOT NULL),
dec AS (SELECT pairid, decision FROM ranked WHERE n = 1)"""
VIEW = """view_ AS (SELECT s.*, x.filename AS fa, y.filename AS fb, x.folderid AS foa, y.folderid AS fob, x.capturedate AS da, y.capturedate AS db, lower(trim(x.colorprofile, ' ')) AS coa,
  lower(trim(y.colorprofile, ' ')) AS cob, x.isactive AS acta, y.isactive AS actb, coalesce(g.displayname, '') AS na, coalesce(h.displayname, '') AS nb, d.decision
  FROM sco s JOIN img x ON x.id = s.a JOIN img y ON y.id = s.b JOIN folders g ON g.id = x.folderid JOIN folders h ON h.id = y.folderid LEFT JOIN dec d ON d.pairid = s.id)"""
_TONE = "CASE WHEN coalesce(coa = 'bw', false) AND coalesce(cob = 'bw', false) THEN 'bothBW' WHEN NOT coalesce(coa = 'bw', false) AND NOT coalesce(cob = 'bw', false) THEN 'bothColor' ELSE 'mixed' END"
_AXIS = "0.6 * greatest(aesthetic, geometric * 0.8, thematic) + 0.4 * (aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4)"
_BAND = " ".join(f"WHEN composite < {b} THEN {i}" for i, b in enumerate(vocab.BAND_BOUNDS))
EDG = "edg AS (SELECT id, a, b, composite, thematic, geometric, aesthetic, coalesce(lower(trim(geometricsubmode, ' ')) = 'structural', false) AS structural FROM sco WHERE a <> b)"


def w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def top(expr: str, n: int = 500, where: str = "") -> str:
    return w(SCO) + f"SELECT id, round({expr}, 6) AS score FROM sco {where} ORDER BY score DESC, id LIMIT {n}"


def _pool(label: int, score: str, k: int, cond: str = "true") -> str:
    return f"(SELECT id, image, {label} AS p, structural FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {score} DESC, a, b, id) AS n FROM ends WHERE {cond}) WHERE n <= {k})"


POOLED = f"""pos AS (SELECT * FROM edg WHERE composite > 0), ends AS (SELECT *, a AS image FROM pos UNION ALL SELECT *, b FROM pos),
geo AS {_pool(2, 'geometric', 5)}, bon AS {_pool(2, 'geometric', 1, 'NOT structural')},
allp AS (SELECT id, p FROM {_pool(0, 'composite', 50)} UNION ALL SELECT id, p FROM {_pool(1, 'thematic', 30, 'thematic >= 0.20')}
  UNION ALL SELECT id, p FROM geo UNION ALL SELECT id, p FROM bon WHERE image NOT IN (SELECT image FROM geo WHERE NOT structural)
  UNION ALL SELECT id, p FROM {_pool(3, 'aesthetic', 5, 'aesthetic >= 0.55')})"""
_HASH = "hsh AS (SELECT DISTINCT id, ('0x' || dhash)::UBIGINT AS h FROM images WHERE id IS NOT NULL AND regexp_full_match(dhash, '[0-9a-fA-F]{1,16}'))"
_HASH40 = "hsh AS (SELECT h, min(id) AS id FROM (SELECT id, ('0x' || dhash)::UBIGINT >> 24 AS h FROM images WHERE id IS NOT NULL AND regexp_full_match(dhash, '[0-9a-fA-F]{1,16}')) GROUP BY h)"
_NEAR = "near AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h)) AS distance FROM hsh x JOIN hsh y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 8)"
_COMP = f"""dated AS (SELECT DISTINCT id, capturedate, filename FROM images WHERE id IS NOT NULL AND dhash <> '' AND filename <> '' AND NOT isnan(capturedate)),
link AS (SELECT a, b FROM near UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM dated x JOIN dated y ON x.id <> y.id AND x.capturedate = y.capturedate AND {_VAR}),
reach AS (SELECT a AS id, a AS other FROM link UNION SELECT b, b FROM link UNION SELECT r.id, CASE WHEN n.a = r.other THEN n.b ELSE n.a END FROM reach r JOIN link n ON n.a = r.other OR n.b = r.other),
grp AS (SELECT id, min(other) AS groupid FROM reach GROUP BY id)"""
PROF = """raw_p AS (SELECT id, max(roleprofile)::JSON AS j FROM images WHERE id IS NOT NULL AND roleprofile LIKE '{%' AND json_valid(roleprofile) AND ishero AND isactive GROUP BY id),
arr AS (SELECT id, f, json_extract(j, '$.' || f) AS v FROM raw_p, (SELECT unnest(['claims', 'enacts', 'subverts', 'phenomena', 'objects']) AS f)),
el AS (SELECT id, f, unnest(json_extract(v, '$[*]')) AS x, generate_subscripts(json_extract(v, '$[*]'), 1) AS i FROM arr WHERE json_type(v) = 'ARRAY'),
badf AS (SELECT DISTINCT id, f FROM el WHERE CASE WHEN f IN ('phenomena', 'objects') THEN json_type(x) <> 'OBJECT' OR (f = 'phenomena' AND ((x->>'$.phenomenon') IS NULL OR (x->>'$.role') IS NULL)) ELSE json_type(x) <> 'VARCHAR' END),
ok AS (SELECT e.* FROM el e ANTI JOIN badf b ON b.id = e.id AND b.f = e.f),
words AS (SELECT id, f, i, x->>'$' AS s, unnest(regexp_extract_all(lower(x->>'$'), '\\p{L}+')) AS t FROM ok WHERE f IN ('claims', 'enacts', 'subverts')),
conc AS (SELECT DISTINCT id, t AS key FROM words WHERE length(t) > 2 AND t NOT IN (""" + _list(vocab.ROLE_STOP_WORDS) + """)),
frq AS (SELECT 'phenomenon' AS kind, key, count(*) AS df FROM (SELECT DISTINCT id, CASE WHEN (x->>'$.phenomenon') IN ('speech', 'music') THEN 'sound' ELSE x->>'$.phenomenon' END AS key FROM ok WHERE f = 'phenomena') GROUP BY key
  UNION ALL SELECT 'concept', key, count(*) FROM conc GROUP BY key
  UNION ALL SELECT 'object', lower(x->>'$.object'), count(*) FROM ok WHERE f = 'objects' AND coalesce(x->>'$.object', '') <> '' GROUP BY 2
  UNION ALL SELECT 'category', lower(x->>'$.category'), count(*) FROM ok WHERE f = 'objects' AND coalesce(x->>'$.category', '') <> '' GROUP BY 2)"""
_CAP = "lower(coalesce(caption, ''))"

ORACLES = {
    "clip_cosine": w(PRS, FEAT) + "SELECT p.id, round((list_dot_product(x.clip, y.clip) + 1) / 2, 6) AS clip FROM prs p JOIN feat x ON x.id = p.a JOIN feat y ON y.id = p.b",
    "visual_kernels": w(PRS, FEAT, VIS) + "SELECT id, round(harmony, 6) AS harmony, round(contrast, 6) AS contrast, round(edge, 6) AS edge, round(grid, 6) AS grid, round(orientation, 6) AS orientation FROM vis",
    "accent_echo": w(PRS, META) + f"SELECT p.id, round({_ECHO}, 6) AS echo FROM prs p JOIN meta x ON x.id = p.a JOIN meta y ON y.id = p.b",
    "gaze_conversation": w(PRS, META) + f"SELECT p.id, round(CASE WHEN {_KNOWN} THEN greatest({_AHEAD}, {_BACK}) ELSE 0.0 END, 6) AS talk, ({_KNOWN}) AND {_BACK} > {_AHEAD} AS flipped FROM prs p JOIN meta x ON x.id = p.a JOIN meta y ON y.id = p.b",
    "pair_scores": w(PRS, FEAT, VIS, META, TOK, CLU, FULL) + """SELECT id, CASE WHEN geometricmode = 'gaze_conversation' AND (CASE WHEN a < b THEN back ELSE ahead END) THEN greatest(a, b) ELSE least(a, b) END AS leftid,
        round(aesthetic, 6) AS aesthetic, round(geometric, 6) AS geometric, round(thematic, 6) AS thematic, round(composite, 6) AS composite, aestheticmode, geometricmode FROM six""",
    "pair_rationale": w(PRS, FEAT, VIS, META, TOK, CLU, FULL) + f"""SELECT id, CASE WHEN coalesce(gap <= 30, false) THEN 'sequential'
        WHEN captions AND thematic >= 0.20 THEN CASE WHEN len({strong('list_intersect(ca, cb)')}) > 0 THEN 'shared:' || (list_sort(list_transform({strong('list_intersect(ca, cb)')}, lambda n: [CASE WHEN ({_W}) = 1.0 THEN '0' ELSE '1' END, n])))[1][2]
          ELSE coalesce({', '.join(f"CASE WHEN (list_contains(ca, '{x}') AND list_contains(cb, '{y}')) OR (list_contains(ca, '{y}') AND list_contains(cb, '{x}')) THEN 'axis:{x}/{y}' END" for x, y, _ in vocab.AXIS_PAIRS)}, 'contrast') END
        WHEN thematic >= greatest(aesthetic, geometric) THEN CASE WHEN thematic >= 0.75 THEN 'semantic' ELSE 'thematic' END WHEN aesthetic >= geometric THEN aestheticmode ELSE geometricmode END AS reason FROM six""",
    "temporal_penalty": w(PRS, META, TOK, CLU) + f"""SELECT p.id, ({_PEN.format(_GAP)})::DOUBLE AS penalty, {_VAR} AS variants, coalesce({_GAP} <= 300, false) OR {_VAR} AS burst, coalesce({_GAP} <= 10, false) AS sequential,
        (CASE WHEN {_GAP} > 300 AND {_GAP} <= 21600 AND list_has_any({strong('cx.cl')}, {strong('cy.cl')}) THEN CASE WHEN {_GAP} <= 1800 THEN 0.70 WHEN {_GAP} <= 7200 THEN 0.80 ELSE 0.90 END ELSE 1.0 END)::DOUBLE AS event
        FROM prs p JOIN meta x ON x.id = p.a JOIN meta y ON y.id = p.b JOIN clu cx ON cx.id = p.a JOIN clu cy ON cy.id = p.b""",
    "tokenize_stem": w(META, TOK) + "SELECT id, stem, count(*) AS n FROM (SELECT id, unnest(tok) AS stem FROM tok) GROUP BY id, stem",
    "match_clusters": w(META, TOK, CLU) + "SELECT id, unnest(cl) AS cluster FROM clu",
    "representative_cluster": w(META, TOK, CLU) + f"SELECT id, first(n ORDER BY ({_W}) DESC, n) AS cluster FROM (SELECT id, unnest(cl) AS n FROM clu) GROUP BY id",
    "weighted_dice": w(PRS, META, TOK, CLU) + f"SELECT p.id, round({_dice('x.cl', 'y.cl')}, 6) AS dice, {_bonus('x.cl', 'y.cl')} AS bonus FROM prs p JOIN clu x ON x.id = p.a JOIN clu y ON y.id = p.b",
    "caption_overlap": w(PRS, META, f"wrd AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(caption), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda z: length(z) > 3 AND z NOT IN ({_list(vocab.OVERLAP_STOP_WORDS)}))) AS ws FROM meta)")
    + "SELECT p.id, round(CASE WHEN len(x.ws) > 0 AND len(y.ws) > 0 THEN len(list_intersect(x.ws, y.ws))::DOUBLE / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) ELSE 0.0 END, 6) AS overlap FROM prs p JOIN wrd x ON x.id = p.a JOIN wrd y ON y.id = p.b",
    "keyword_firing": w(META, TOK, "voc(cluster, grp, keyword) AS (VALUES " + ", ".join(f"('{c}', {g}, '{k}')" for c, g, k in vocab.default_rows()) + ")",
        "hit AS (SELECT DISTINCT id, cluster, grp, keyword FROM (SELECT id, unnest(tok) AS keyword FROM tok) JOIN voc USING (keyword))",
        "per AS (SELECT *, count(*) OVER (PARTITION BY id, cluster, grp) AS k FROM hit)",
        "fir AS (SELECT id, cluster FROM hit GROUP BY id, cluster HAVING count(DISTINCT grp) = (SELECT count(DISTINCT v.grp) FROM voc v WHERE v.cluster = hit.cluster))")
    + """SELECT v.cluster, v.grp, v.keyword, count(p.id) AS captions, round(count(p.id) * 100.0::DOUBLE / any_value(t.n), 6) AS percent, count(f.id) FILTER (WHERE p.k = 1) AS sole FROM voc v LEFT JOIN per p USING (cluster, grp, keyword)
        LEFT JOIN fir f ON f.id = p.id AND f.cluster = p.cluster LEFT JOIN (SELECT cluster, count(*) AS n FROM fir GROUP BY cluster) t ON t.cluster = v.cluster GROUP BY v.cluster, v.grp, v.keyword""",
    "cluster_distribution": w(SCO, META, TOK, CLU) + "SELECT cluster, " + ", ".join(f"count(*) FILTER (WHERE selectedfor = '{s}') AS {s}" for s in ("composite", "thematic", "geometric", "aesthetic"))
    + " FROM (SELECT s.selectedfor, unnest(list_intersect(x.cl, y.cl)) AS cluster FROM sco s JOIN clu x ON x.id = s.a JOIN clu y ON y.id = s.b) GROUP BY cluster",
    "flagged_captions": w(IMG) + "SELECT DISTINCT id FROM img WHERE (caption ILIKE '%gaze%' OR caption ILIKE '%looking%' OR caption ILIKE '%eyes%') AND NOT caption ILIKE '%sign reads%'",
    "hamming_pairs": w(_HASH40, _NEAR) + "SELECT a, b, distance FROM near",
    "dup_components": w(_HASH, _NEAR, _COMP) + "SELECT id, groupid FROM grp",
    "dup_heroes": w(_HASH, _NEAR, _COMP) + "SELECT groupid, first(id ORDER BY date IS NULL, date, id) AS heroid FROM grp JOIN (SELECT id, min(capturedate) AS date FROM images GROUP BY id) USING (id) GROUP BY groupid",
    "pool_labels": w(SCO, EDG, POOLED) + "SELECT id, (['composite', 'thematic', 'geometric', 'aesthetic'])[min(p) + 1] AS label FROM allp GROUP BY id",
    "pool_composite": w(SCO, EDG) + "SELECT image, id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY composite DESC, a, b, id) AS n FROM (SELECT *, a AS image FROM edg WHERE composite > 0 UNION ALL SELECT *, b FROM edg WHERE composite > 0)) WHERE n <= 10",
    "pool_geometric": w(SCO, EDG) + "SELECT image, id FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY geometric DESC, a, b, id) AS n FROM (SELECT *, a AS image FROM edg WHERE NOT structural UNION ALL SELECT *, b FROM edg WHERE NOT structural)) WHERE n <= 1",
    "stratified_queue": w(SCO) + f"SELECT id, bucket, rank FROM (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rank FROM (SELECT id, CASE WHEN aestheticsubmode = 'accent_echo' THEN 9 {_BAND} ELSE 8 END AS bucket FROM sco)) WHERE rank <= (SELECT_SLOTS)[bucket + 1]",
    "role_frequency": w(PROF) + "SELECT kind, key, df FROM frq",
    "generic_concepts": w(PROF) + "SELECT key, df FROM frq WHERE kind = 'concept' AND df > 0.10 * (SELECT count(*) FROM raw_p)",
    "latest_decision": w(DEC) + "SELECT pairid, decision FROM dec",
    "decision_counts": w(DEC) + "SELECT decision, count(*) AS pairs FROM dec GROUP BY decision",
    "display_scores": w(IMG, SCO, DEC, VIEW) + f"""SELECT id, CASE WHEN selectedfor = 'thematic' THEN 'thematic' WHEN selectedfor = 'aesthetic' THEN 'aesthetic' WHEN thematic >= 0.25 AND thematic > geometric THEN 'thematic' WHEN geometric >= aesthetic THEN 'geometric' ELSE 'aesthetic' END AS modality,
        round((aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4) * ({_PEN.format('abs(da - db)')}), 6) AS shown,
        round(greatest(aesthetic, geometric * 0.8, thematic) * ({_PEN.format('abs(da - db)')}) * 0.6 + (aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4) * ({_PEN.format('abs(da - db)')}) * 0.4, 6) AS axis, {_TONE} AS tone FROM view_ WHERE acta AND actb""",
    "display_geometric": w(PRS, FEAT, VIS) + """SELECT id, round((edge * (CASE WHEN abs(pa - pb) > 0.5 THEN greatest(pow(pa * pb, 0.4), pow(greatest(pa, pb), 0.4) * 0.6) ELSE pow(pa * pb, 0.4) END) * (CASE WHEN greatest(pa, pb) * 4.0 < 2.2 THEN 0.40 ELSE 1.0 END)
        + grid * pow(va * vb, 0.4) * (CASE WHEN greatest(va, vb) * 0.20 < 0.12 THEN 0.50 ELSE 1.0 END)) / 2, 6) AS geometric FROM vis""",
    "sort_axis": top(f"greatest(composite, {_AXIS})"),
    "sort_composite": top("greatest(composite, aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4)"),
    "sort_thematic": top("thematic"),
    "sort_geometric": top("geometric"),
    "sort_aesthetic": top("aesthetic"),
    "anchor_top": top(_AXIS, 500, "WHERE a = 1 OR b = 1"),
    "page": w(SCO) + "SELECT id, round(composite, 6) AS score FROM sco ORDER BY score DESC, id LIMIT 150 OFFSET 300",
    "pairs_by_folder": w(IMG, SCO, DEC, VIEW) + "SELECT foa AS folderid, count(*) AS pairs, round(max(composite), 6) AS best FROM view_ WHERE foa = fob GROUP BY foa",
    "text_search": w(IMG, SCO, DEC, VIEW) + "SELECT id FROM view_ WHERE contains(lower(coalesce(fa, '')), 'copy') OR contains(lower(coalesce(fb, '')), 'copy') OR contains(lower(na), 'copy') OR contains(lower(nb), 'copy')",
    "color_tone": w(IMG, SCO, DEC, VIEW) + f"SELECT {_TONE} AS tone, count(*) AS pairs FROM view_ GROUP BY 1",
    "liked_pairs": w(SCO, DEC) + "SELECT id FROM sco WHERE EXISTS (SELECT 1 FROM dec d WHERE d.pairid = sco.id AND d.decision = 'liked')",
    "grid_filters": w(IMG, SCO, DEC, VIEW) + "SELECT id FROM view_ WHERE acta AND actb AND coalesce(decision, '') NOT IN ('rejected', 'deleted') AND NOT coalesce(abs(da - db) <= 10, false) AND composite >= 0.3",
    "orphan_pairs": w(IMG, PRS) + "SELECT id FROM prs WHERE a NOT IN (SELECT id FROM img WHERE isactive) OR b NOT IN (SELECT id FROM img WHERE isactive)",
    "dead_images": w(IMG, PRS) + """SELECT DISTINCT id FROM img WHERE NOT isactive AND id NOT IN (SELECT unnest([a, b]) FROM prs WHERE a IN (SELECT id FROM img WHERE isactive) AND b IN (SELECT id FROM img WHERE isactive))""",
    "image_pair_counts": w(PRS) + "SELECT image, sum(n)::BIGINT AS pairs FROM (SELECT a AS image, count(*) AS n FROM prs GROUP BY a UNION ALL SELECT b, count(*) FROM prs GROUP BY b) GROUP BY image",
    "folder_summary": w(IMG, PRS) + """SELECT f.id AS folderid, count(i.id) AS images, coalesce((SELECT count(*) FROM prs p JOIN img x ON x.id = p.a JOIN img y ON y.id = p.b WHERE x.isactive AND y.isactive AND x.folderid = f.id AND y.folderid = f.id), 0) AS pairs
        FROM folders f LEFT JOIN img i ON i.folderid = f.id AND i.isactive GROUP BY f.id""",
    "group_members": w(IMG) + """SELECT m.duplicategroupid, m.members, m.ids, m.members - g.membercount AS "off" FROM (SELECT duplicategroupid, count(*) AS members, string_agg(id::VARCHAR, ', ' ORDER BY id) AS ids FROM (SELECT DISTINCT id, duplicategroupid FROM img) WHERE duplicategroupid IS NOT NULL GROUP BY 1) m
        LEFT JOIN (SELECT DISTINCT id, membercount FROM duplicategroups) g ON g.id = m.duplicategroupid""",
    "submode_routes": w(SCO) + """SELECT lower(trim(aestheticsubmode, ' ')) AS route, count(*) AS pairs, round(max(aesthetic), 6) AS best FROM sco WHERE lower(trim(aestheticsubmode, ' ')) IN ('accent_echo', 'harmony', 'contrast') GROUP BY 1
        UNION ALL SELECT lower(trim(geometricsubmode, ' ')), count(*), round(max(geometric), 6) FROM sco WHERE lower(trim(geometricsubmode, ' ')) IN ('gaze_conversation', 'opposing_diagonals') GROUP BY 1""",
    "gaze_impact": w(IMG, PRS, "fl AS (SELECT DISTINCT id FROM img WHERE (caption ILIKE '%gaze%' OR caption ILIKE '%looking%' OR caption ILIKE '%eyes%') AND NOT caption ILIKE '%sign reads%')")
    + """SELECT 'images' AS metric, count(*) AS n FROM fl UNION ALL SELECT 'ends', count(*) FROM prs JOIN fl ON fl.id = prs.a OR fl.id = prs.b AND prs.a <> prs.b WHERE false
        UNION ALL SELECT 'pairs', count(DISTINCT prs.id) FROM prs JOIN fl ON fl.id = prs.a OR fl.id = prs.b""",
    "rank_shift": w(SCO, "e AS (SELECT id, a, b, aesthetic * 0.4 + geometric * 0.2 + thematic * 0.4 AS s1, aesthetic * 0.4 + geometric * 0.2 + thematic * 0.8 AS s2 FROM sco WHERE a <> b)", "ends AS (SELECT *, a AS image FROM e UNION ALL SELECT *, b FROM e)",
                    "r AS (SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY s1 DESC, a, b, id) AS r1, row_number() OVER (PARTITION BY image ORDER BY s2 DESC, a, b, id) AS r2 FROM ends)")
    + "SELECT image, count(*) FILTER (WHERE (CASE WHEN r1 <= 10 THEN r1 END) IS DISTINCT FROM (CASE WHEN r2 <= 10 THEN r2 END)) AS changed FROM r WHERE r1 <= 10 OR r2 <= 10 GROUP BY image",
    "score_bands": w(SCO) + f"SELECT CASE {_BAND} ELSE {len(vocab.BAND_BOUNDS)} END AS band, count(*) AS pairs, round(avg(aesthetic), 6) AS aesthetic FROM sco GROUP BY 1",
    "work_queue": w(IMG) + """SELECT DISTINCT id, coalesce(trim(caption, ' '), '') = '' AS caption, coalesce(trim(roleprofile, ' '), '') = '' AS profile, id NOT IN (SELECT imageid FROM clipoutput WHERE imageid IS NOT NULL AND embedding IS NOT NULL) AS vector FROM img
        WHERE isactive AND (coalesce(trim(caption, ' '), '') = '' OR coalesce(trim(roleprofile, ' '), '') = '' OR id NOT IN (SELECT imageid FROM clipoutput WHERE imageid IS NOT NULL AND embedding IS NOT NULL))""",
    "upsert_images": """WITH o AS (SELECT id, max(caption) AS c, true AS o FROM images WHERE id IS NOT NULL GROUP BY id), n AS (SELECT id, max(caption) AS c, true AS n FROM corpusimage WHERE id IS NOT NULL GROUP BY id)
        SELECT CASE WHEN o.o IS NULL THEN 'inserted' WHEN n.n IS NULL THEN 'untouched' WHEN o.c IS NOT DISTINCT FROM n.c THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS rows FROM o FULL JOIN n ON o.id = n.id GROUP BY 1""",
    "soft_delete_folder": w(IMG) + "SELECT folderid, count(*) FILTER (WHERE isactive AND NOT coalesce(folderid <= 3, false)) AS active, count(*) AS images FROM (SELECT DISTINCT id, folderid, isactive FROM img) GROUP BY folderid",
    "scoped_delete": w(IMG, PRS) + "SELECT CASE n WHEN 2 THEN 'intra' WHEN 1 THEN 'cross' ELSE 'outside' END AS scope, count(*) AS pairs FROM (SELECT (a IN (SELECT id FROM img WHERE folderid = 4))::INT + (b IN (SELECT id FROM img WHERE folderid = 4))::INT AS n FROM prs) GROUP BY 1",
    "cascade_delete": w(IMG, PRS) + """SELECT lower(trim(decision, ' ')) AS decision, count(*) AS n FROM userdecisions u WHERE pairid IS NOT NULL
        AND pairid NOT IN (SELECT id FROM prs WHERE a NOT IN (SELECT id FROM img WHERE isactive) OR b NOT IN (SELECT id FROM img WHERE isactive)) GROUP BY 1""",
}
ORACLES["gaze_impact"] = w(IMG, PRS, "fl AS (SELECT DISTINCT id FROM img WHERE (caption ILIKE '%gaze%' OR caption ILIKE '%looking%' OR caption ILIKE '%eyes%') AND NOT caption ILIKE '%sign reads%')") + """
SELECT 'images' AS metric, count(*) AS n FROM fl
UNION ALL SELECT 'ends', (SELECT count(*) FROM prs WHERE a IN (SELECT id FROM fl)) + (SELECT count(*) FROM prs WHERE b IN (SELECT id FROM fl))
UNION ALL SELECT 'pairs', count(*) FROM prs WHERE a IN (SELECT id FROM fl) OR b IN (SELECT id FROM fl)
UNION ALL SELECT 'partners', count(*) FROM (SELECT b FROM prs WHERE a IN (SELECT id FROM fl) UNION SELECT a FROM prs WHERE b IN (SELECT id FROM fl))"""


def _slot_list() -> str:
    from tandem.operators.mutations import slots

    return "[" + ", ".join(map(str, slots(750))) + "]"


ORACLES["stratified_queue"] = ORACLES["stratified_queue"].replace("(SELECT_SLOTS)", f"({_slot_list()})")
ORACLES["folder_best_pairs"] = w(IMG, FEAT, "own AS (SELECT DISTINCT i.folderid, f.id, f.clip FROM img i JOIN feat f ON f.id = i.id WHERE i.folderid IS NOT NULL AND i.ishero AND i.isactive)") + """
SELECT folderid, id, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY folderid, id ORDER BY s DESC, other) AS rank
  FROM (SELECT x.folderid, x.id, y.id AS other, round(list_dot_product(x.clip, y.clip), 9) AS s FROM own x JOIN own y ON x.folderid = y.folderid AND x.id <> y.id)) WHERE rank <= 10"""
_OPEN = "^(The (photograph|image) (captures|depicts|shows|features|portrays|presents) |This (photograph|image) (captures|depicts|shows|features|portrays) |The scene (unfolds with|unfolds in|unfolds on|unfolds|captures|depicts|shows) |This scene (captures|depicts|shows) )"
ORACLES["caption_clean"] = w(IMG) + f"""SELECT DISTINCT id, CASE WHEN r <> c AND length(r) >= 20 THEN upper(r[1]) || r[2:] ELSE c END AS caption
FROM (SELECT id, c, regexp_replace(c, '{_OPEN}', '') AS r FROM (SELECT id, trim(split_part(caption, '<|im_', 1), ' ') AS c FROM img WHERE caption IS NOT NULL))"""
ORACLES["evidence_normalize"] = w(IMG) + """SELECT DISTINCT id, trim(regexp_replace(translate(lower(caption), '‘’“”', chr(39) || chr(39) || chr(34) || chr(34)), '\\s+', ' ', 'g'), ' ') AS caption FROM img WHERE caption IS NOT NULL"""

_UNI = "uni AS (SELECT id, max(folderid) AS folderid FROM images WHERE id IS NOT NULL AND folderid IS NOT NULL AND ishero AND isactive GROUP BY id)"
_ALL = _UNI + ", prs AS (SELECT x.id || '-' || y.id AS id, x.id AS a, y.id AS b FROM uni x JOIN uni y ON x.folderid = y.folderid AND x.id < y.id)"
_CROSS = _UNI + ", prs AS (SELECT x.id || '-' || y.id AS id, x.id AS a, y.id AS b FROM uni x JOIN uni y ON x.id < y.id AND (x.folderid = 4) <> (y.folderid = 4))"
_LIB = POOLED.replace("pos AS (SELECT * FROM edg WHERE composite > 0)", "pos AS (SELECT * REPLACE (round(composite, 9) AS composite, round(thematic, 9) AS thematic, round(geometric, 9) AS geometric, round(aesthetic, 9) AS aesthetic, geometricmode = 'structural' AS structural) FROM six WHERE composite > 0 AND NOT (variants OR coalesce(gap <= 300, false)))")
for _name, _pairs in (("library_pairs", _ALL), ("cross_folder_pairs", _CROSS)):
    ORACLES[_name] = w(_pairs, FEAT, VIS, META, TOK, CLU, FULL, _LIB) + """
SELECT a, b, CASE WHEN geometricmode = 'gaze_conversation' AND back THEN b ELSE a END AS leftid, label, floor(aesthetic * 1e6 + 0.5) / 1e6 AS aesthetic, floor(geometric * 1e6 + 0.5) / 1e6 AS geometric, floor(thematic * 1e6 + 0.5) / 1e6 AS thematic,
  floor(composite * 1e6 + 0.5) / 1e6 AS composite, aestheticmode, geometricmode FROM pos JOIN (SELECT id, (['composite', 'thematic', 'geometric', 'aesthetic'])[min(p) + 1] AS label FROM allp GROUP BY id) USING (id)"""
_UNIT = "least(greatest({0}, 0.0), 1.0)"
ORACLES["gaze_clarity"] = w(SCO, META, f"""cla AS (SELECT s.id, 0.60 + 0.35 * (0.5 * {_UNIT.format("(coalesce(greatest(abs(x.gaze), abs(y.gaze)), 0.0) - 0.22) / 0.38")} + 0.5 * {_UNIT.format("abs(y.x - 0.5) / 0.45")}) AS c
  FROM sco s JOIN meta x ON x.id = s.a JOIN meta y ON y.id = s.b WHERE s.selectedfor = 'gaze')""") + "SELECT id, round(c, 6)::DOUBLE AS clarity, round(least(greatest(0.50 + (c - 0.60) / 0.35 * 0.26, 0.50), 0.76), 6)::DOUBLE AS geometric FROM cla"


# --- roles: each rule as a join of the profiles' parts, the first rule and place that connects a pair counts ---

_RWORDS = f"list_filter(regexp_extract_all(lower({{0}}), '\\p{{{{L}}}}+'), lambda z: length(z) > 2 AND z NOT IN ({_list(vocab.ROLE_STOP_WORDS)}))"
_PART = "CASE WHEN json_type(x, '$.{0}') = 'VARCHAR' THEN x->>'$.{0}' END"
_CATS = "CASE " + " ".join(f"WHEN z = '{k}' THEN '{v}'" for k, v in vocab.CLAIM_CATEGORY.items()) + " END"
_BRIDGE = " OR ".join(f"(lower(c.s) = '{x}' AND lower(e.s) = '{y}')" for x, y in vocab.CLAIM_BRIDGE)
_TURN = "least(c.id, {0}.id) AS a, greatest(c.id, {0}.id) AS b, {1} AS pr, CASE WHEN c.id < {0}.id THEN 0 ELSE 1 END AS o1, c.i AS o2"
RULES = f"""phe AS (SELECT id, i, {_PART.format('role')} AS role, CASE WHEN (x->>'$.phenomenon') IN ('speech', 'music') THEN 'sound' ELSE x->>'$.phenomenon' END AS p FROM ok WHERE f = 'phenomena'),
cla AS (SELECT id, i, x->>'$' AS s, {_RWORDS.format("x->>'$'")} AS ws FROM ok WHERE f = 'claims'),
emb AS (SELECT id, x->>'$' AS s, {_RWORDS.format("x->>'$'")} AS ws FROM ok WHERE f IN ('enacts', 'subverts')),
obj AS (SELECT *, {_RWORDS.format('o')} AS ws FROM (SELECT id, i, {', '.join(f"lower(coalesce({_PART.format(n)}, '')) AS {n[0]}" for n in ('object', 'register', 'category'))} FROM ok WHERE f = 'objects')),
sub AS (SELECT DISTINCT id FROM ok WHERE f = 'subverts'),
hits AS (
  SELECT x.id AS a, y.id AS b, 1 AS pr, x.i AS o1, 0 AS o2, 0 AS o3, 'phenomenon' AS kind, x.p AS key FROM phe x JOIN phe y ON x.p = y.p AND x.id < y.id
    WHERE x.p <> 'gaze' AND ((x.role = 'source' AND y.role = 'receiver' AND y.id IN (FROM sub)) OR (x.role = 'receiver' AND y.role = 'source' AND x.id IN (FROM sub)))
  UNION ALL SELECT {_TURN.format('e', 2)}, 0, 'concept', c.s FROM cla c JOIN emb e ON c.id <> e.id AND (list_has_any(c.ws, e.ws) OR {_BRIDGE})
  UNION ALL SELECT x.id, y.id, 3, x.i, y.i, 0, CASE WHEN x.o <> '' AND x.o = y.o THEN 'object' ELSE 'category' END, CASE WHEN x.o <> '' AND x.o = y.o THEN x.o ELSE x.c END FROM obj x JOIN obj y ON x.id < y.id
    AND ((x.o <> '' AND x.o = y.o) OR (x.c = y.c AND x.c IN ({_list(vocab.CATEGORY_WHITELIST)})))
    AND ((x.r = 'real' AND y.r IN ({_list(vocab.ALTERNATIVE_REGISTERS)})) OR (y.r = 'real' AND x.r IN ({_list(vocab.ALTERNATIVE_REGISTERS)})))
  UNION ALL SELECT {_TURN.format('o', 4)}, o.i, CASE WHEN o.c <> '' THEN 'category' ELSE 'object' END, CASE WHEN o.c <> '' THEN o.c ELSE o.o END FROM cla c JOIN obj o ON c.id <> o.id
    AND ((o.c <> '' AND list_contains(list_transform(c.ws, lambda z: {_CATS}), o.c)) OR (o.o <> '' AND list_has_any(c.ws, o.ws)))),
con AS (SELECT a, b, pr AS priority, kind, key FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY pr, o1, o2, o3) AS n FROM hits) WHERE n = 1),
rar AS (SELECT kind, key, max(s) AS specificity FROM (SELECT k.kind, k.key, CASE WHEN k.one IS NULL THEN 0.0 ELSE ln(((SELECT count(*) FROM raw_p) + 1)::DOUBLE / (coalesce(q.df, 0) + 1)) END AS s
  FROM (SELECT kind, key, unnest(CASE WHEN kind <> 'concept' THEN [key] WHEN len({_RWORDS.format('key')}) = 0 THEN [NULL] ELSE {_RWORDS.format('key')} END) AS one FROM (SELECT DISTINCT kind, key FROM con)) k LEFT JOIN frq q ON q.kind = k.kind AND q.key = k.one) GROUP BY kind, key),
rat AS (SELECT a, b, priority, specificity FROM con JOIN rar USING (kind, key))"""
ORACLES["role_join"] = w(PROF, RULES) + "SELECT a, b, priority, kind, key FROM con"
ORACLES["role_specificity"] = w(PROF, RULES) + "SELECT a, b, priority, round(specificity, 6) AS specificity FROM rat"

# --- greedy loops, one step a row: ord has pos (from 1), the capacity keys of both ends and their caps ---


def _greedy(name: str, source: str) -> str:
    """The loop over ``source`` (pos, ka, kb, capa, capb) with the keys taken so far as its state."""
    free = "len(list_filter(used, lambda u: u = ka)) < capa AND len(list_filter(used, lambda u: u = kb)) < capb"
    step = f"SELECT o.pos, CASE WHEN o.free THEN list_concat(o.used, [o.ka, o.kb]) ELSE o.used END, o.free FROM (SELECT s.pos, used, ka, kb, {free} AS free FROM {name} t JOIN {source} s ON s.pos = t.pos + 1) o"
    return f"{name}(pos, used, free) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL {step})"


ORACLES["role_admission"] = w(
    PROF, RULES, "ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY priority, specificity DESC, a, b) AS pos, a, b, priority, a * 10 + priority AS ka, b * 10 + priority AS kb, ([8, 8, 5, 12])[priority] AS capa, ([8, 8, 5, 12])[priority] AS capb FROM rat)", _greedy("run", "ord")
) + "SELECT a, b, priority FROM run JOIN ord USING (pos) WHERE free"
ORACLES["cap2_grid"] = w(
    SCO, "ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY composite DESC, id) AS pos, id, a AS ka, b AS kb, 1 AS capa, 1 AS capb FROM sco WHERE a <> b AND composite > 0)", _greedy("one", "ord"),
    "seen AS MATERIALIZED (SELECT unnest([ka, kb]) AS v FROM one JOIN ord USING (pos) WHERE free)", "rest AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS pos, id, ka, kb, 1 AS capa, 1 AS capb FROM ord WHERE ka NOT IN (FROM seen) OR kb NOT IN (FROM seen))", _greedy("two", "rest"),
) + "SELECT id, 1 AS turn FROM one JOIN ord USING (pos) WHERE free UNION ALL SELECT id, 2 FROM two JOIN rest USING (pos) WHERE free"
# a looker stops at four partners in all and a target at three, whichever side either was on before
ORACLES["gaze_nominate"] = w("""per AS (SELECT DISTINCT id, folderid, gazedirectionx AS gaze, ((id * 13) % 100)::DOUBLE / 100 AS x, capturedate AS date, facecount AS faces, least(facecount, 2) AS humans, ((id * 17) % 100)::DOUBLE / 100 AS dominance
  FROM images WHERE id IS NOT NULL AND folderid IS NOT NULL AND ishero AND isactive),
meet AS (SELECT l.folderid, l.id AS lid, t.id AS tid, l.gaze, CASE WHEN l.gaze > 0 THEN 0.5 - t.x ELSE -(0.5 - t.x) END AS coh FROM per l JOIN per t ON l.folderid = t.folderid AND l.id <> t.id
  WHERE abs(l.gaze) >= 0.22 AND l.faces = 1 AND coalesce(l.humans, 99) <= 1 AND t.x IS NOT NULL AND coalesce(t.dominance, 0) >= 0.55 AND NOT coalesce(abs(l.date - t.date) <= 300, false)),
ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY folderid, abs(gaze) DESC, lid, coh DESC, tid) AS pos, * FROM meet WHERE coh >= 0.05),
run(pos, used, met, free) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], false UNION ALL
  SELECT o.pos, CASE WHEN o.free THEN list_concat(o.used, [o.lid, o.tid]) ELSE o.used END, CASE WHEN o.free THEN list_append(o.met, o.duo) ELSE o.met END, o.free FROM (SELECT s.pos, used, met, lid, tid, least(lid, tid) || '-' || greatest(lid, tid) AS duo,
    len(list_filter(used, lambda u: u = lid)) < 4 AND len(list_filter(used, lambda u: u = tid)) < 3 AND NOT list_contains(met, least(lid, tid) || '-' || greatest(lid, tid)) AS free FROM run t JOIN ord s ON s.pos = t.pos + 1) o)""") + """
SELECT CASE WHEN gaze > 0 THEN lid ELSE tid END AS leftid, CASE WHEN gaze > 0 THEN tid ELSE lid END AS rightid, lid AS lookerid, round(coh, 6) AS coherence FROM run JOIN ord USING (pos) WHERE free"""
_SHARE = ", ".join(f"({i}, {x})" for i, x in enumerate([*vocab.BAND_WEIGHTS, vocab.ECHO_TAIL_WEIGHT]))
# proportional slots of at least one; what is too much is taken back one by one from the bands in turn that have more than one
ORACLES["slot_allocation"] = w(SCO, "n AS (SELECT count(*) AS budget FROM sco WHERE selectedfor = 'role')", f"wts(bucket, weight) AS (VALUES {_SHARE})",
    "raw AS (SELECT bucket, CASE WHEN budget <= 0 THEN 0 WHEN budget < 10 THEN (bucket < budget)::INT ELSE greatest(1, floor(weight::DOUBLE / (SELECT sum(weight) FROM wts) * budget + 0.5))::INT END AS s, budget FROM wts, n)",
    "spare AS (SELECT bucket, k, row_number() OVER (ORDER BY k, bucket) AS turn FROM (SELECT bucket, unnest(range(1, s)) AS k FROM raw))",
) + "SELECT bucket, (s - (SELECT count(*) FROM spare p WHERE p.bucket = raw.bucket AND p.turn <= greatest((SELECT sum(s) FROM raw) - budget, 0)))::INT AS slots FROM raw"

# --- texts, left joins, reports and loads ---

_RAT = lambda n: "'" + vocab.RATIONALES[n].replace("'", "''") + "'"
_MODES = lambda col: f"CASE {col} " + " ".join(f"WHEN '{n}' THEN {_RAT(n)}" for n in vocab.RATIONALES) + " END"
_THEME = f"(list_sort(list_transform(list_filter(list_intersect(ca, cb), lambda n: n IS NOT NULL), lambda n: [printf('%.2f', 9 - ({_W})), n])))[1][2]"
ORACLES["caption_rationale"] = w(PRS, FEAT, VIS, META, TOK, CLU, FULL) + f"""SELECT id, CASE WHEN len(list_intersect(ca, cb)) > 0 THEN '{vocab.SHARED_THEME.split('{}')[0]}' || replace({_THEME}, '_', ' ') || '{vocab.SHARED_THEME.split('{}')[1]}'
  WHEN thematic < 0.15 THEN {_RAT('apart')} WHEN thematic >= greatest(aesthetic, geometric) THEN CASE WHEN thematic >= 0.75 THEN {_RAT('semantic')} ELSE {_RAT('thematic')} END
  WHEN aesthetic >= geometric THEN {_MODES('aestheticmode')} ELSE {_MODES('geometricmode')} END AS rationale FROM six"""
ORACLES["effective_thematic"] = w(SCO, META, TOK, CLU) + f"""SELECT s.id, round((CASE WHEN s.id % 3 = 0 THEN CASE WHEN selectedfor = 'role' THEN thematic ELSE 0.0 END WHEN s.id % 2 = 0 THEN CASE WHEN selectedfor = 'role' AND composite * 2 = 0 THEN thematic ELSE composite * 2 END ELSE thematic END)
  * (CASE WHEN {_GAP} > 300 AND {_GAP} <= 21600 AND list_has_any({strong('cx.cl')}, {strong('cy.cl')}) THEN CASE WHEN {_GAP} <= 1800 THEN 0.70 WHEN {_GAP} <= 7200 THEN 0.80 ELSE 0.90 END ELSE 1.0 END), 6)::DOUBLE AS thematic
  FROM sco s JOIN meta x ON x.id = s.a JOIN meta y ON y.id = s.b JOIN clu cx ON cx.id = s.a JOIN clu cy ON cy.id = s.b"""
_NAMED = "named AS (SELECT DISTINCT i.id, f.displayname AS folder FROM img i LEFT JOIN folders f ON f.id = i.folderid)"
ORACLES["gaze_pairs"] = w(IMG, SCO, _NAMED) + "SELECT s.id, x.folder AS afolder, y.folder AS bfolder FROM sco s LEFT JOIN named x ON x.id = s.a LEFT JOIN named y ON y.id = s.b WHERE s.selectedfor = 'gaze'"
ORACLES["pair_paths"] = w(PRS) + """SELECT p.id, CASE WHEN y.path IS NOT NULL THEN x.path END AS apath, CASE WHEN x.path IS NOT NULL THEN y.path END AS bpath FROM prs p
  LEFT JOIN (SELECT DISTINCT id, path FROM images) x ON x.id = p.a LEFT JOIN (SELECT DISTINCT id, path FROM images) y ON y.id = p.b"""
ORACLES["top_five"] = top("composite", 5)
ORACLES["role_candidates"] = w(SCO) + "SELECT id, a, b FROM sco WHERE selectedfor = 'role' ORDER BY id LIMIT 500"
ORACLES["group_report"] = "SELECT duplicategroupid, count(*) AS members FROM (SELECT DISTINCT id, duplicategroupid FROM images WHERE id IS NOT NULL AND duplicategroupid IS NOT NULL) GROUP BY 1 ORDER BY members DESC, duplicategroupid LIMIT 10"
ORACLES["stage_throughput"] = "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS ms, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1"
_SCAN = """img AS (SELECT DISTINCT id, path, filename, contenthash FROM images WHERE id IS NOT NULL),
scan AS (SELECT DISTINCT CASE WHEN id % 5 = 0 OR id % 11 = 0 THEN '/later' || path ELSE path END AS path, CASE WHEN id % 11 = 0 THEN 'new-' || filename ELSE filename END AS filename, CASE WHEN id % 7 = 0 THEN 'x' || contenthash ELSE contenthash END AS contenthash FROM img)"""
ORACLES["upsert_files"] = w(_SCAN) + """SELECT CASE WHEN h.id IS NOT NULL THEN h.id ELSE (SELECT min(i.id) FROM img i WHERE i.filename = s.filename AND i.contenthash = s.contenthash) END AS id, s.path,
  CASE WHEN h.id IS NOT NULL THEN CASE WHEN h.contenthash = s.contenthash THEN 'touched' ELSE 'changed' END
    WHEN EXISTS (SELECT 1 FROM img i WHERE i.filename = s.filename AND i.contenthash = s.contenthash) THEN 'moved' ELSE 'inserted' END AS outcome
  FROM scan s LEFT JOIN (SELECT path, min(id) AS id, first(contenthash ORDER BY id, contenthash) AS contenthash FROM img GROUP BY path) h ON h.path = s.path WHERE s.path IS NOT NULL"""
ORACLES["caption_write"] = """WITH o AS (SELECT id, max(caption) AS c, max(roleprofile) AS r FROM images WHERE id IS NOT NULL GROUP BY id), n AS (SELECT id, max(caption) AS c FROM corpusimage WHERE id IS NOT NULL AND caption IS NOT NULL GROUP BY id)
SELECT coalesce(n.c, o.c) IS NOT NULL AS captioned, o.r IS NOT NULL AND (n.c IS NULL OR n.c IS NOT DISTINCT FROM o.c) AS profiled, count(*) AS images FROM o LEFT JOIN n USING (id) GROUP BY 1, 2"""


def _merged(candidates: str, pairs: str) -> str:
    return f"""SELECT c.a, c.b, p.id, CASE WHEN p.id IS NULL THEN 'inserted' ELSE 'tagged' END AS outcome FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({candidates})) c
  LEFT JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b, min(id) AS id FROM ({pairs}) GROUP BY 1, 2) p USING (a, b)"""


ORACLES["gaze_insert"] = _merged(f"SELECT leftid AS a, rightid AS b FROM ({ORACLES['gaze_nominate']})", w(SCO) + "SELECT id, a, b FROM sco WHERE coalesce(selectedfor, '') <> 'gaze'")
ORACLES["role_insert"] = _merged(ORACLES["role_admission"], w(PRS) + "SELECT id, a, b FROM prs")

# --- nested profiles: the text opened where it is a string or stands inside other text, the outermost object with a
# profile field found level by level, its members spelled alike, then elements, then parts as deep as they go ---

_PROFILE = ("subjects", "phenomena", "claims", "enacts", "subverts", "objects", "directed_at", "stance")
_NORM = "replace(lower({0}), '_', '')"
_CODES = "MAP {" + ", ".join(f"'{f.replace('_', '')}': '{f}'" for f in _PROFILE) + "}"
NODES = f"""txt AS (SELECT DISTINCT id, trim(roleprofile) AS t FROM images WHERE id IS NOT NULL AND contains(roleprofile, '{{')),
opened AS (SELECT id, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'VARCHAR' THEN (CASE WHEN json_valid(t) THEN t END)::JSON->>'$' ELSE t END AS t FROM txt),
cut AS (SELECT id, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '(?s)\\{{.*\\}}') END AS t FROM opened),
whole AS (SELECT id, t::JSON AS j FROM cut WHERE json_valid(t)),
look(id, level, j) AS (SELECT id, 0, j FROM whole UNION ALL
  SELECT id, level + 1, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END FROM (
    SELECT id, level, unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: json_extract(j, '$."' || k || '"')) ELSE json_extract(j, '$[*]') END) AS v FROM look
    WHERE json_type(j) IN ('OBJECT', 'ARRAY') AND NOT (json_type(j) = 'OBJECT' AND list_has_any(list_transform(json_keys(j), lambda k: {_NORM.format('k')}), map_keys({_CODES})))) WHERE json_type(v) IN ('OBJECT', 'ARRAY', 'VARCHAR')),
prof AS (SELECT id, first(j ORDER BY level) AS j FROM look WHERE json_type(j) = 'OBJECT' AND list_has_any(list_transform(json_keys(j), lambda k: {_NORM.format('k')}), map_keys({_CODES})) GROUP BY id),
member AS (SELECT id, {_CODES}[{_NORM.format('k')}] AS f, last(json_extract(j, '$."' || k || '"') ORDER BY n) AS v FROM (SELECT id, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS n FROM prof) WHERE {_NORM.format('k')} IN (SELECT unnest(map_keys({_CODES}))) GROUP BY 1, 2),
elem AS (SELECT id, f, unnest(CASE WHEN json_type(v) = 'ARRAY' AND f <> 'stance' THEN json_extract(v, '$[*]') ELSE [v] END) AS v, unnest(CASE WHEN json_type(v) = 'ARRAY' AND f <> 'stance' THEN range(0, json_array_length(v)::BIGINT) ELSE [0] END) AS n FROM member),
node(id, f, n, depth, path, parent, v) AS (
  SELECT id, f, n, 1, CASE WHEN f = 'stance' THEN f ELSE f || '[' || n || ']' END, '$', v FROM elem
  UNION ALL SELECT id, 'parts', n, depth + 1, path || '.parts[' || n || ']', path, v FROM (
    SELECT id, depth, path, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN json_extract(p, '$[*]') ELSE [p] END) AS v, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN range(0, json_array_length(p)::BIGINT) ELSE [0] END) AS n FROM (
      SELECT id, depth, path, list_last(list_transform(list_filter(json_keys(v), lambda k: {_NORM.format('k')} = 'parts'), lambda k: json_extract(v, '$."' || k || '"'))) AS p FROM node WHERE f IN ('objects', 'parts') AND json_type(v) = 'OBJECT') WHERE p IS NOT NULL)),
kept AS (SELECT * FROM node WHERE json_type(v) <> 'NULL' AND v::VARCHAR NOT IN ('{{}}', '[]') AND NOT (json_type(v) = 'VARCHAR' AND trim(v->>'$', ' ' || chr(9) || chr(10) || chr(13)) = ''))"""
_ATTR = "CASE json_type(v, '$.{0}') WHEN 'VARCHAR' THEN v->>'$.{0}' WHEN 'NULL' THEN NULL ELSE (v->'$.{0}')::VARCHAR END"


def _child(fields: tuple[str, ...], attributes: tuple[str, ...], text_as: str) -> str:
    attr = {a: f"CASE WHEN json_type(v) = 'OBJECT' THEN {_ATTR.format(a)} END" for a in attributes}
    attr[text_as] = f"CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE {attr[text_as]} END"
    return w(NODES) + f"SELECT id AS imageid, path AS nodepath, parent AS parentpath, n::INT AS element, depth, {', '.join(f'{x} AS {a}' for a, x in attr.items())} FROM kept WHERE f IN ({_list(fields)})"


ORACLES["p4_found"] = w(NODES) + "SELECT id AS imageid, path AS nodepath, parent AS parentpath FROM kept"
ORACLES["p4_objects"] = _child(("objects", "parts"), ("object", "register", "category"), "object")
ORACLES["p4_phenomena"] = _child(("phenomena",), ("phenomenon", "role"), "phenomenon")
ORACLES["p4_texts"] = f"SELECT *, regexp_extract(nodepath, '^([a-z_]+)', 1) AS field FROM ({_child(('subjects', 'claims', 'enacts', 'subverts', 'directed_at'), ('value',), 'value')})"
