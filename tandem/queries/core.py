"""Queries of the pair engine's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions import clusters as C
from tandem.functions import evidence
from tandem.functions import kernels as K
from tandem.functions import text as X
from tandem.functions import vocab
from tandem.operators import dupes, features, gaze, greedy, mutations, nested, pools, roles
from tandem.operators.features import finite
from tandem.operators.scan import ranged_positions
from tandem.plans import blocked, scoring
from tandem.queries.sql import ORACLES
from tandem.runtime import release, stage, stored_bytes, table, tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(col):
    return F.round(col, 6)


# --- views -------------------------------------------------------------------------------------------


def pairs_once(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(id, a, b, *more) of the pairs, copies once; pairs without id or image are left out."""
    return table(spark, d, "pairs").filter("id IS NOT NULL AND imageaid IS NOT NULL AND imagebid IS NOT NULL").select("id", F.col("imageaid").alias("a"), F.col("imagebid").alias("b"), *more).distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with finite scores (missing, NaN and infinite ones 0) and cleaned labels."""
    p = pairs_once(spark, d, "aestheticscore", "geometricscore", "thematicscore", "compositescore", "aestheticsubmode", "geometricsubmode", "selectedfor", "rationale", "scoredat")
    return p.select("id", "a", "b", *(finite(F.col(f"{s}score")).alias(s) for s in ("aesthetic", "geometric", "thematic", "composite")), "aestheticsubmode", "geometricsubmode", F.lower(F.trim("selectedfor")).alias("selectedfor"), "rationale")


def images_once(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "images").filter("id IS NOT NULL").select("id", *cols).distinct()


def heroes_of(images: DataFrame) -> DataFrame:
    """Ids of the images that take part in pairing: active heroes (a null flag is neither)."""
    return images.filter("id IS NOT NULL AND ishero AND isactive").select("id").distinct()


#: Staged image tables of up to this many bytes are sent to all executors; larger ones are joined by a shuffle.
HELD = 48 << 20


def with_images(p: DataFrame, img: DataFrame, staged: bool = False) -> DataFrame:
    """Pairs joined with the columns of both images as a_<column> and b_<column>.  Wide columns of a small ``staged``
    table are broadcast, so that they are not shuffled once per pair; its size is checked."""
    if staged and stored_bytes(img) <= HELD:
        # the pairs are few bytes and much work: they keep all cores busy
        img, p = F.broadcast(img), p.repartition(3 * p.sparkSession.sparkContext.defaultParallelism)
    side = lambda s: img.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in img.columns if c != "id"))
    return p.join(side("a"), "a").join(side("b"), "b")


def visual(spark: SparkSession, d: str) -> DataFrame:
    # both sides of the join read the features, so they are worked out once
    return with_images(pairs_once(spark, d), stage(features.features(table(spark, d, "clipoutput")), "features"), True)


def meta(spark: SparkSession, d: str) -> DataFrame:
    return features.surrogate_scalars(table(spark, d, "images"))


# --- pair kernels ------------------------------------------------------------------------------------


@query
def clip_cosine(spark, d):
    """Rescaled cosine of every pair's embeddings."""
    f = features.features(table(spark, d, "clipoutput")).select("id", "clip")
    return with_images(pairs_once(spark, d), f).select("id", r6(K.clip_similarity(F.col("a_clip"), F.col("b_clip"))).alias("clip"))


def _visual_scores(spark, d):
    v = visual(spark, d)
    c = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    return v.select(
        "id", "a", "b",
        K.clip_similarity(*c("clip")).alias("clip"),
        K.histogram_intersection(*c("hist")).alias("harmony"),
        K.palette_contrast(*c("palette")).alias("contrast"),
        K.cosine01(*c("edge")).alias("edge"),
        K.cosine01(*c("grid")).alias("grid"),
        F.col("a_peak").alias("pa"), F.col("b_peak").alias("pb"), F.col("a_var").alias("va"), F.col("b_var").alias("vb"),
        K.orientation_opposition(*c("line"), *c("peak")).alias("orientation"),
    )


@query
def visual_kernels(spark, d):
    """Histogram intersection, palette contrast, edge and grid cosine, orientation opposition."""
    return _visual_scores(spark, d).select("id", *(r6(F.col(c)).alias(c) for c in ("harmony", "contrast", "edge", "grid", "orientation")))


def _full_scores(spark, d):
    v = _visual_scores(spark, d)
    img = meta(spark, d).select("id", "folderid", "date", "filename", "caption", "bw", "gaze", "hue", "sat", "x", "y", C.caption_clusters(F.col("caption"), vocab.rows(spark)).alias("cl"))
    m = with_images(v, stage(img, "meta"))
    col = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    echo = K.accent_echo(F.col("a_hue"), F.col("a_sat"), F.col("b_hue"), F.col("b_sat"))
    aes, amode = K.aesthetic(F.col("harmony"), F.col("contrast"), echo, F.col("a_bw") & F.col("b_bw"))
    structural = (F.col("edge") * K.edge_multiplier(F.col("pa"), F.col("pb")) + F.col("grid") * K.variance_multiplier(F.col("va"), F.col("vb"))) / 2
    centroid = K.directional_complement(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"), F.col("va"), F.col("vb"))
    ahead, back = K.gaze_conversation(*col("gaze")), K.gaze_conversation(F.col("b_gaze"), F.col("a_gaze"))
    m = m.select(
        "*", echo.alias("echo"), aes.alias("aesthetic"), amode.alias("aestheticmode"), structural.alias("structural"), centroid.alias("centroid"),
        F.coalesce(F.greatest(ahead, back), F.lit(0.0)).alias("talk"), F.coalesce(back > ahead, F.lit(False)).alias("flipped"),
        ((F.col("a_caption") != "") & (F.col("b_caption") != "")).alias("captions"),
    )
    geo, gmode = K.geometric(F.col("structural"), F.col("centroid"), F.col("talk"), F.col("orientation"), F.col("va"), F.col("vb"))
    them = C.thematic(F.col("a_cl"), F.col("b_cl"), F.col("clip"), F.col("captions"), K.diversity(F.col("clip")))
    m = m.select("*", geo.alias("geometric"), gmode.alias("geometricmode"), them.alias("thematic"))
    comp = K.composite(F.col("aesthetic"), F.col("geometric"), F.col("thematic"), F.col("clip"), F.col("captions"), X.filename_variants(*col("filename")), *col("date"))
    return m.select("*", comp.alias("composite"))


@query
def accent_echo(spark, d):
    m = with_images(pairs_once(spark, d), meta(spark, d).select("id", "hue", "sat"))
    return m.select("id", r6(K.accent_echo(F.col("a_hue"), F.col("a_sat"), F.col("b_hue"), F.col("b_sat"))).alias("echo"))


@query
def gaze_conversation(spark, d):
    m = with_images(pairs_once(spark, d), meta(spark, d).select("id", "gaze"))
    ahead, back = K.gaze_conversation(F.col("a_gaze"), F.col("b_gaze")), K.gaze_conversation(F.col("b_gaze"), F.col("a_gaze"))
    return m.select("id", r6(F.coalesce(F.greatest(ahead, back), F.lit(0.0))).alias("talk"), F.coalesce(back > ahead, F.lit(False)).alias("flipped"))


@query
def pair_scores(spark, d):
    """The whole pair kernel: aesthetic, geometric, thematic and composite score with submodes; the image that
    looks right comes first in gaze conversations."""
    s = _full_scores(spark, d)
    turn = F.col("flipped") & (F.col("geometricmode") == "gaze_conversation")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    swapped = F.when(F.col("a") < F.col("b"), turn).otherwise(F.coalesce(~F.col("flipped"), F.lit(False)) & (F.col("geometricmode") == "gaze_conversation") & (F.col("talk") > 0))
    return s.select("id", F.when(swapped, hi).otherwise(lo).alias("leftid"), *(r6(F.col(c)).alias(c) for c in ("aesthetic", "geometric", "thematic", "composite")), "aestheticmode", "geometricmode")


@query
def pair_rationale(spark, d):
    """Why a pair was made: burst, shared cluster, axis, contrast, or the strongest score."""
    s = _full_scores(spark, d)
    shared = C.representative(C.meaningful(F.array_intersect("a_cl", "b_cl")))
    has = F.array_contains
    axis = F.coalesce(*(F.when((has("a_cl", x) & has("b_cl", y)) | (has("a_cl", y) & has("b_cl", x)), F.lit(f"{x}/{y}")) for x, y, _ in vocab.AXIS_PAIRS))
    top = F.greatest("aesthetic", "geometric", "thematic")
    plain = F.when(F.col("thematic") == top, F.when(F.col("thematic") >= 0.75, "semantic").otherwise("thematic")).when(F.col("aesthetic") == top, F.col("aestheticmode")).otherwise(F.col("geometricmode"))
    themed = F.when(shared.isNotNull(), F.concat(F.lit("shared:"), shared)).when(axis.isNotNull(), F.concat(F.lit("axis:"), axis)).otherwise("contrast")
    burst = F.coalesce(F.abs(F.col("a_date") - F.col("b_date")) <= 30, F.lit(False))
    return s.select("id", F.when(burst, "sequential").when(F.col("captions") & (F.col("thematic") >= 0.20), themed).otherwise(plain).alias("reason"))


@query
def caption_rationale(spark, d):
    """The sentence shown for a pair: its shared theme, a contrast, or its strongest score."""
    s = _full_scores(spark, d)
    theme = C.representative(F.array_intersect("a_cl", "b_cl"))
    texts = F.create_map(*(F.lit(x) for kv in vocab.RATIONALES.items() for x in kv))
    top = F.greatest("aesthetic", "geometric", "thematic")
    strongest = F.when(F.col("thematic") == top, F.when(F.col("thematic") >= 0.75, "semantic").otherwise("thematic")).when(F.col("aesthetic") == top, F.col("aestheticmode")).otherwise(F.col("geometricmode"))
    before, after = vocab.SHARED_THEME.split("{}")
    themed = F.concat(F.lit(before), F.replace(theme, F.lit("_"), F.lit(" ")), F.lit(after))
    return s.select("id", F.when(theme.isNotNull(), themed).when(F.col("thematic") < 0.15, texts[F.lit("apart")]).otherwise(texts[strongest]).alias("rationale"))


@query
def effective_thematic(spark, d):
    """The thematic score that counts.  The tables have no judged score: every third pair's is 0, every second's of
    the others twice its composite, and role pairs have a hypothesis."""
    p = scored(spark, d).select("id", "a", "b", "thematic", "composite", "selectedfor")
    m = with_images(p, meta(spark, d).select("id", "date", C.meaningful(C.caption_clusters(F.col("caption"), vocab.rows(spark))).alias("cl")))
    judged = F.when(F.col("id") % 3 == 0, F.lit(0.0)).when(F.col("id") % 2 == 0, F.col("composite") * 2)
    event = K.event_factor(F.col("a_date"), F.col("b_date"), F.arrays_overlap("a_cl", "b_cl"))
    return m.select("id", r6(K.effective_thematic(F.col("thematic"), judged, F.when(F.col("selectedfor") == "role", "role"), event)).alias("thematic"))


@query
def temporal_penalty(spark, d):
    """Time factor, burst and sequence flags, and the event factor of every pair."""
    m = with_images(pairs_once(spark, d), meta(spark, d).select("id", "date", "filename", C.meaningful(C.caption_clusters(F.col("caption"), vocab.rows(spark))).alias("cl")))
    t = (F.col("a_date"), F.col("b_date"))
    variants = X.filename_variants(F.col("a_filename"), F.col("b_filename"))
    return m.select("id", K.temporal_penalty(*t).alias("penalty"), variants.alias("variants"), K.is_burst(*t, variants).alias("burst"), F.coalesce(F.abs(t[0] - t[1]) <= 10, F.lit(False)).alias("sequential"), K.event_factor(*t, F.arrays_overlap("a_cl", "b_cl")).alias("event"))


# --- text --------------------------------------------------------------------------------------------


@query
def tokenize_stem(spark, d):
    rows = images_once(spark, d, "caption").select("id", F.explode(X.tokenize(F.col("caption"))).alias("stem"))
    return rows.groupBy("id", "stem").agg(F.count("*").alias("n"))


@query
def match_clusters(spark, d):
    return images_once(spark, d, "caption").select("id", F.explode(C.caption_clusters(F.col("caption"), vocab.rows(spark))).alias("cluster")).distinct()


@query
def representative_cluster(spark, d):
    return images_once(spark, d, "caption").select("id", C.representative(C.caption_clusters(F.col("caption"), vocab.rows(spark))).alias("cluster")).filter("cluster IS NOT NULL")


@query
def weighted_dice(spark, d):
    m = with_images(pairs_once(spark, d), meta(spark, d).select("id", C.caption_clusters(F.col("caption"), vocab.rows(spark)).alias("cl")))
    return m.select("id", r6(C.weighted_dice(F.col("a_cl"), F.col("b_cl"))).alias("dice"), C.axis_bonus(F.col("a_cl"), F.col("b_cl")).alias("bonus"))


@query
def caption_overlap(spark, d):
    """Jaccard overlap of the captions' words of more than three letters, stop-words left out."""
    words = F.array_distinct(F.filter(X.terms(F.col("caption"), 4), lambda w: ~w.isin(*vocab.OVERLAP_STOP_WORDS)))
    m = with_images(pairs_once(spark, d), meta(spark, d).select("id", words.alias("w")))
    union = F.size(F.array_union("a_w", "b_w"))
    return m.select("id", r6(F.when((F.size("a_w") > 0) & (F.size("b_w") > 0), F.size(F.array_intersect("a_w", "b_w")) / union).otherwise(F.lit(0.0))).alias("overlap"))


@query
def keyword_firing(spark, d):
    """How many captions each keyword of all groups occurs in, in percent of its cluster's captions, and in how many its
    cluster fires by it alone."""
    return C.keyword_audit(images_once(spark, d, "caption"), vocab.rows(spark))


@query
def cluster_distribution(spark, d):
    """Pairs by shared cluster and selection pool, as a pivot."""
    s = scored(spark, d).select("id", "a", "b", "selectedfor")
    m = with_images(s, meta(spark, d).select("id", C.caption_clusters(F.col("caption"), vocab.rows(spark)).alias("cl")))
    both = m.select("selectedfor", F.explode(F.array_intersect("a_cl", "b_cl")).alias("cluster"))
    return both.groupBy("cluster").pivot("selectedfor", ["composite", "thematic", "geometric", "aesthetic"]).count().na.fill(0)


@query
def flagged_captions(spark, d):
    """Captions that speak of looking, case ignored, without the phrase that explains it."""
    c = F.col("caption")
    return images_once(spark, d, "caption").filter((c.ilike("%gaze%") | c.ilike("%looking%") | c.ilike("%eyes%")) & ~c.ilike("%sign reads%")).select("id")


# --- duplicates --------------------------------------------------------------------------------------


@query
def hamming_pairs(spark, d):
    """Classes of equal hashes, named by their smallest id, at most 8 bits apart.  The hashes are cut to their first 40
    bits here: whole ones are further apart in the test tables, which would leave nothing to compare."""
    images = table(spark, d, "images").filter(F.col("dhash").rlike("^[0-9a-fA-F]{1,16}$")).select("id", F.substring(F.lpad("dhash", 16, "0"), 1, 10).alias("dhash"))
    return dupes.hamming_pairs(dupes.hash_classes(images)[0], 8).select("a", "b", "distance")


@query
def dup_components(spark, d):
    """Groups by near hashes or by equal dates with file name variants."""
    return dupes.duplicate_groups(table(spark, d, "images"), 8)


@query
def dup_heroes(spark, d):
    return _heroes(spark, d, dup_components(spark, d))


def _heroes(spark, d, groups):
    dates = images_once(spark, d, "capturedate").groupBy("id").agg(F.min("capturedate").alias("date"))
    return dupes.heroes(groups.join(dates, "id"))


# --- selection ---------------------------------------------------------------------------------------


def _edges(spark, d):
    return scored(spark, d).filter("a <> b").select("id", "a", "b", "composite", "thematic", "geometric", "aesthetic", F.coalesce(F.lower(F.trim("geometricsubmode")) == "structural", F.lit(False)).alias("structural"))


@query
def pool_labels(spark, d):
    return pools.select_pools(_edges(spark, d))


@query
def pool_composite(spark, d):
    best = pools.best_of(pools.both_ends(_edges(spark, d).filter("composite > 0")), "composite", 10)
    return best.select("image", "id", "rank")


@query
def pool_geometric(spark, d):
    best = pools.best_of(pools.both_ends(_edges(spark, d)), "geometric", 1, ~F.col("structural"))
    return best.select("image", "id")


def _ordered(spark, d):
    s = scored(spark, d).filter("a <> b AND composite > 0")
    ranked = stage(s.select("id", "a", "b", "composite"), "ranked")
    return ranged_positions(ranked.withColumn("g", F.lit(0)), ["g"], [F.col("composite").desc(), F.col("id").asc()], label="order").select("id", "a", "b", F.col("position").alias("pos"))


@query
def cap2_grid(spark, d):
    """The grid: pairs in score order, each image at most once per pass."""
    e = _ordered(spark, d)
    return greedy.cap_two(e).join(e.select("pos", "id"), "pos").select("id", "turn")


@query
def stratified_queue(spark, d):
    """Per score band the first pairs by id, as many as the band's slots."""
    s = scored(spark, d)
    band = F.when(F.col("aestheticsubmode") == "accent_echo", len(vocab.BAND_WEIGHTS))
    for i, bound in enumerate(vocab.BAND_BOUNDS):
        band = band.when(F.col("composite") < bound, i)
    rows = s.select("id", band.otherwise(len(vocab.BAND_WEIGHTS) - 1).alias("bucket"))
    slots = F.array(*map(F.lit, mutations.slots(750)))
    w = Window.partitionBy("bucket").orderBy("id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 750).filter(F.col("rank") <= slots[F.col("bucket")])


@query
def slot_allocation(spark, d):
    """Slots of each band for a budget equal to the number of pairs marked for roles."""
    n = scored(spark, d).filter("selectedfor = 'role'").count()
    return spark.createDataFrame([(i, s) for i, s in enumerate(mutations.slots(n))], "bucket int, slots int")


@query
def folder_best_pairs(spark, d):
    """All pairs of active heroes inside each folder by cosine: every image's ten best partners."""
    img = images_once(spark, d, "folderid", "ishero", "isactive").filter("folderid IS NOT NULL AND ishero AND isactive").select("id", F.col("folderid").cast("string").alias("scope"))
    vec = features.features(table(spark, d, "clipoutput")).select("id", F.col("clip").alias("vec"))
    best = blocked.best_pairs(img.join(vec, "id"), 10)
    return best.select(F.col("scope").cast("long").alias("folderid"), "id", "other", "rank")


def _prepared(spark, d):
    img = meta(spark, d).filter("folderid IS NOT NULL").join(heroes_of(table(spark, d, "images")), "id", "left_semi")
    both = features.features(table(spark, d, "clipoutput")).join(img, "id").withColumn("scope", F.col("folderid").cast("string"))
    return scoring.prepare(both, vocab.rows(spark), "folderid")


def _pooled(edges):
    tiles, edges = edges, stage(edges, "edges")
    # the images that the tiles were made of, and their shuffle files
    release(tiles)
    tidy(edges.sparkSession)
    edges = edges.withColumn("id", F.concat_ws("-", "a", "b"))
    picked = pools.select_pools(edges.withColumn("structural", F.col("geometricmode") == "structural"))
    first = F.when(F.col("flipped"), F.col("b")).otherwise(F.col("a"))
    # scores come at 9 decimals: halves are sent up by hand, as engines round them differently
    half_up = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return edges.join(picked, "id").select("a", "b", first.alias("leftid"), "label", *(half_up(c).alias(c) for c in ("aesthetic", "geometric", "thematic", "composite")), "aestheticmode", "geometricmode")


@query
def library_pairs(spark, d):
    """Indexing a library: all pairs of active heroes inside each folder scored by the whole kernel, bursts left out, and
    the edges the four pools admit, with the pool that did."""
    return _pooled(scoring.score_library(_prepared(spark, d)))


@query
def cross_folder_pairs(spark, d):
    """A new folder (4) against all others: the whole kernel between its active heroes and those of every other folder,
    and the edges the four pools admit."""
    return _pooled(scoring.score_cross(_prepared(spark, d), F.col("folderid") == 4))


@query
def judge_verdicts(spark, d):
    """Verdicts of findings that quote the first sentences of both captions, one for every pair with captions."""
    m = with_images(pairs_once(spark, d), meta(spark, d).select("id", "caption").filter("caption <> ''"))
    first = lambda c: F.regexp_extract(c, r"^[^.!?]*", 0)
    kinds = F.array(*map(F.lit, evidence.KINDS))
    f = m.select(
        F.col("id").alias("pairid"), F.lit(0).alias("pos"), kinds[F.pmod("id", F.lit(5)).cast("int")].alias("kind"), first(F.col("a_caption")).alias("quoteA"), first(F.col("b_caption")).alias("quoteB"),
        (F.col("id") % 2 == 0).alias("explicitA"), (F.col("id") % 3 == 0).alias("explicitB"), F.lit("").alias("note"), F.col("a_caption").alias("captionA"), F.col("b_caption").alias("captionB"),
    )
    return evidence.verdicts(evidence.verify(f))


@query
def caption_clean(spark, d):
    """Captions without control marks and openings."""
    c = evidence.strip_opener(evidence.clean_caption(F.col("caption")))
    return images_once(spark, d, "caption").filter("caption IS NOT NULL").select("id", c.alias("caption")).distinct()


@query
def evidence_normalize(spark, d):
    return images_once(spark, d, "caption").filter("caption IS NOT NULL").select("id", X.normalize_evidence(F.col("caption")).alias("caption")).distinct()


# --- roles and gaze ----------------------------------------------------------------------------------


def _profiled(spark, d):
    return table(spark, d, "images").filter("ishero AND isactive")


@query
def role_frequency(spark, d):
    return roles.frequencies(stage(roles.profiles(_profiled(spark, d)), "profiles"))


@query
def role_join(spark, d):
    """All pairs of profiled images that a role rule connects, stored as pairs or not."""
    return roles.connect_all(stage(roles.profiles(_profiled(spark, d)), "profiles"))


def _rated(spark, d):
    prof = stage(roles.profiles(_profiled(spark, d)), "profiles")
    return roles.connect_all(prof, roles.frequencies(prof), prof.count(), digits=6)


@query
def role_specificity(spark, d):
    return _rated(spark, d).select("a", "b", "priority", "specificity")


@query
def role_admission(spark, d):
    """Role connections of all pairs admitted rarest first within priorities, under the degree cap of each priority."""
    prof = stage(roles.profiles(_profiled(spark, d)), "profiles")
    got = roles.admit(prof, roles.frequencies(prof), prof.count(), {1: 8, 2: 8, 3: 5, 4: 12})
    return got.select("a", "b", F.col("kind").alias("priority"))


@query
def generic_concepts(spark, d):
    """Concepts in more than a tenth of the profiles."""
    prof = stage(roles.profiles(_profiled(spark, d)), "profiles")
    f = roles.frequencies(prof).filter("kind = 'concept'")
    return f.filter(F.col("df") > 0.10 * prof.count()).select("key", "df")


@query
def gaze_nominate(spark, d):
    h = F.col("id")
    rows = table(spark, d, "images").filter("id IS NOT NULL AND folderid IS NOT NULL AND ishero AND isactive").select("id", "folderid", F.col("gazedirectionx").alias("gaze"), ((h * 13) % 100 / 100).alias("x"), F.col("capturedate").alias("date"), F.col("facecount").alias("faces"), F.least(F.col("facecount"), F.lit(2)).alias("humans"), ((h * 17) % 100 / 100).alias("dominance")).distinct()
    got = gaze.nominate_by(rows, "folderid")
    return got.select("leftid", "rightid", "lookerid", r6(F.col("coherence")).alias("coherence"))


@query
def gaze_clarity(spark, d):
    m = with_images(scored(spark, d).filter("selectedfor = 'gaze'").select("id", "a", "b"), meta(spark, d).select("id", "gaze", "x"))
    g = F.coalesce(F.greatest(F.abs("a_gaze"), F.abs("b_gaze")), F.lit(0.0))
    c = K.gaze_clarity(g, F.abs(F.col("b_x") - 0.5))
    return m.select("id", r6(c).alias("clarity"), r6(K.clarity_to_geometric(c)).alias("geometric"))


# --- display and query layer -------------------------------------------------------------------------


def pair_view(spark, d):
    """Pairs with both images and folders and the latest decision."""
    img = images_once(spark, d, "filename", "folderid", "capturedate", "colorprofile", "isactive")
    folders = table(spark, d, "folders").select(F.col("id").alias("folderid"), F.coalesce("displayname", F.lit("")).alias("folder"))
    img = img.join(folders, "folderid")
    return with_images(scored(spark, d), img).join(_latest(spark, d).withColumnRenamed("pairid", "id"), "id", "left")


def _latest(spark, d):
    u = table(spark, d, "userdecisions").filter("pairid IS NOT NULL").select("pairid", "id", "decidedat", F.lower(F.trim("decision")).alias("decision"))
    newest = F.struct(F.col("decidedat").isNotNull().alias("known"), "decidedat", "id")
    return u.groupBy("pairid").agg(F.max_by("decision", newest).alias("decision"))


@query
def latest_decision(spark, d):
    """The newest decision on each pair; undated ones are older than all others, equal times by id."""
    return _latest(spark, d)


@query
def decision_counts(spark, d):
    return _latest(spark, d).groupBy("decision").agg(F.count("*").alias("pairs"))


@query
def display_scores(spark, d):
    """Modality, display composite, axis score and colour tone of every pair of active images."""
    v = pair_view(spark, d).filter("a_isactive AND b_isactive")
    pen = K.temporal_penalty(F.col("a_capturedate"), F.col("b_capturedate"))
    shown, axis = K.axis_score(F.col("aesthetic"), F.col("geometric"), F.col("thematic"), pen)
    return v.select("id", K.modality(F.col("selectedfor"), F.col("aesthetic"), F.col("geometric"), F.col("thematic")).alias("modality"), r6(shown).alias("shown"), r6(axis).alias("axis"), K.color_tone(F.lower(F.trim("a_colorprofile")), F.lower(F.trim("b_colorprofile"))).alias("tone"))


@query
def display_geometric(spark, d):
    s = _visual_scores(spark, d)
    peak, var = F.greatest("pa", "pb") * 4.0, F.greatest("va", "vb") * 0.20
    g = K.display_geometric(F.col("edge"), F.col("grid"), K.edge_multiplier(F.col("pa"), F.col("pb")), K.variance_multiplier(F.col("va"), F.col("vb")), peak, var, F.lit(0.0))
    return s.select("id", r6(g).alias("geometric"))


def _top(df: DataFrame, expr, n: int = 500) -> DataFrame:
    return df.select("id", r6(expr).alias("score")).orderBy(F.col("score").desc(), "id").limit(n)




@query
def sort_axis(spark, d):
    return _top(scored(spark, d), F.greatest(F.col("composite"), F.greatest(F.col("aesthetic"), F.col("geometric") * 0.8, F.col("thematic")) * 0.6 + (F.col("aesthetic") * 0.4 + F.col("geometric") * 0.2 + F.col("thematic") * 0.4) * 0.4))


@query
def sort_composite(spark, d):
    return _top(scored(spark, d), F.greatest(F.col("composite"), F.col("aesthetic") * 0.4 + F.col("geometric") * 0.2 + F.col("thematic") * 0.4))


@query
def sort_thematic(spark, d):
    return _top(scored(spark, d), F.col("thematic"))


@query
def sort_geometric(spark, d):
    return _top(scored(spark, d), F.col("geometric"))


@query
def sort_aesthetic(spark, d):
    return _top(scored(spark, d), F.col("aesthetic"))


@query
def anchor_top(spark, d):
    """The 500 best pairs of image 1 on either side."""
    return _top(scored(spark, d).filter("a = 1 OR b = 1"), F.greatest(F.col("aesthetic"), F.col("geometric") * 0.8, F.col("thematic")) * 0.6 + (F.col("aesthetic") * 0.4 + F.col("geometric") * 0.2 + F.col("thematic") * 0.4) * 0.4)


@query
def page(spark, d):
    """The third page of 150 in composite order."""
    return scored(spark, d).select("id", r6(F.col("composite")).alias("score")).orderBy(F.col("score").desc(), "id").offset(300).limit(150)


@query
def pairs_by_folder(spark, d):
    v = pair_view(spark, d).filter("a_folderid = b_folderid")
    return v.groupBy(F.col("a_folderid").alias("folderid")).agg(F.count("*").alias("pairs"), r6(F.max("composite")).alias("best"))


@query
def text_search(spark, d):
    """Pairs with a file or folder name that holds a piece of text, case ignored."""
    cols = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("a_filename", "b_filename", "a_folder", "b_folder")]
    hit = cols[0].contains("copy") | cols[1].contains("copy") | cols[2].contains("copy") | cols[3].contains("copy")
    return pair_view(spark, d).filter(hit).select("id")


@query
def color_tone(spark, d):
    v = pair_view(spark, d)
    return v.groupBy(K.color_tone(F.lower(F.trim("a_colorprofile")), F.lower(F.trim("b_colorprofile"))).alias("tone")).agg(F.count("*").alias("pairs"))


@query
def gaze_pairs(spark, d):
    """Left joins: gaze pairs with the folder names of both ends, null where an image or folder is unknown."""
    f = table(spark, d, "folders").select(F.col("id").alias("folderid"), F.col("displayname").alias("folder"))
    img = images_once(spark, d, "folderid").join(f, "folderid", "left").select("id", "folder")
    g = scored(spark, d).filter("selectedfor = 'gaze'").select("id", "a", "b")
    for end in ("a", "b"):
        g = g.join(img.select(F.col("id").alias(end), F.col("folder").alias(f"{end}folder")), end, "left")
    return g.select("id", "afolder", "bfolder")


@query
def pair_paths(spark, d):
    """The paths of both images of every pair, or none if one is missing."""
    m = pairs_once(spark, d)
    for end in ("a", "b"):
        m = m.join(images_once(spark, d, "path").select(F.col("id").alias(end), F.col("path").alias(f"{end}path")), end, "left")
    both = F.col("apath").isNotNull() & F.col("bpath").isNotNull()
    return m.select("id", F.when(both, F.col("apath")).alias("apath"), F.when(both, F.col("bpath")).alias("bpath"))


@query
def top_five(spark, d):
    """The five best pairs by composite score."""
    return _top(scored(spark, d), F.col("composite"), 5)


@query
def role_candidates(spark, d):
    """The first 500 role pairs by id."""
    return scored(spark, d).filter("selectedfor = 'role'").select("id", "a", "b").orderBy("id").limit(500)


@query
def group_report(spark, d):
    """The ten largest duplicate groups, equal ones by id."""
    return group_members(spark, d).select("duplicategroupid", "members").orderBy(F.col("members").desc(), "duplicategroupid").limit(10)


@query
def stage_throughput(spark, d):
    """Calls and total and mean time of every stage, from a log of timed events."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum("value").alias("ms"))
    return e.select("stage", "calls", F.round("ms", 4).alias("ms"), F.round(F.col("ms") / F.col("calls"), 6).alias("mean"))


@query
def liked_pairs(spark, d):
    """Semi-join: pairs whose latest decision is liked."""
    return scored(spark, d).join(_latest(spark, d).filter("decision = 'liked'").withColumnRenamed("pairid", "id"), "id", "left_semi").select("id")


@query
def grid_filters(spark, d):
    """Pairs the grid shows: active, not rejected or deleted, not sequential, confident enough."""
    v = pair_view(spark, d).filter("a_isactive AND b_isactive AND coalesce(decision, '') NOT IN ('rejected', 'deleted')")
    v = v.filter(~F.coalesce(F.abs(F.col("a_capturedate") - F.col("b_capturedate")) <= 10, F.lit(False)) & (F.col("composite") >= 0.3))
    return v.select("id")


@query
def orphan_pairs(spark, d):
    """Anti-join: pairs with an end that is no active image."""
    act = images_once(spark, d, "isactive").filter("isactive").select("id")
    p = pairs_once(spark, d)
    lost = lambda c: p.join(act.withColumnRenamed("id", c), c, "left_anti").select("id")
    return lost("a").union(lost("b")).distinct()


@query
def dead_images(spark, d):
    """Inactive images that no pair refers to once the orphan pairs are gone, which are swept first."""
    p = pairs_once(spark, d).join(orphan_pairs(spark, d), "id", "left_anti")
    used = p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id"))).distinct()
    return images_once(spark, d, "isactive").filter("NOT isactive").select("id").join(used, "id", "left_anti")


@query
def image_pair_counts(spark, d):
    return pairs_once(spark, d).select("id", F.explode(F.array("a", "b")).alias("image")).groupBy("image").agg(F.count("*").alias("pairs"))


@query
def folder_summary(spark, d):
    """Folders with the number of their active images and of the pairs inside them."""
    img = images_once(spark, d, "folderid", "isactive").filter("isactive")
    n = img.groupBy("folderid").agg(F.count("id").alias("images"))
    inside = with_images(pairs_once(spark, d), img.select("id", "folderid")).filter("a_folderid = b_folderid").groupBy(F.col("a_folderid").alias("folderid")).agg(F.count("*").alias("pairs"))
    f = table(spark, d, "folders").select(F.col("id").alias("folderid"))
    return f.join(n, "folderid", "left").join(inside, "folderid", "left").select("folderid", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query
def group_members(spark, d):
    """Duplicate groups with their member ids in order and how far the stored count is off."""
    img = images_once(spark, d, "duplicategroupid").filter("duplicategroupid IS NOT NULL")
    agg = img.groupBy("duplicategroupid").agg(F.count("*").alias("members"), F.concat_ws(", ", F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))).alias("ids"))
    g = table(spark, d, "duplicategroups").select(F.col("id").alias("duplicategroupid"), "membercount").distinct()
    return agg.join(g, "duplicategroupid", "left").select("duplicategroupid", "members", "ids", (F.col("members") - F.col("membercount")).alias("off"))


@query
def submode_routes(spark, d):
    """Pairs and best score of every submode route."""
    s = scored(spark, d)
    aes = s.filter(F.lower(F.trim("aestheticsubmode")).isin("accent_echo", "harmony", "contrast")).groupBy(F.lower(F.trim("aestheticsubmode")).alias("route")).agg(F.count("*").alias("pairs"), r6(F.max("aesthetic")).alias("best"))
    geo = s.filter(F.lower(F.trim("geometricsubmode")).isin("gaze_conversation", "opposing_diagonals")).groupBy(F.lower(F.trim("geometricsubmode")).alias("route")).agg(F.count("*").alias("pairs"), r6(F.max("geometric")).alias("best"))
    return aes.union(geo)


@query
def gaze_impact(spark, d):
    """Metric rows by UNION ALL: flagged images, pairs on either end of one, distinct pairs and partners."""
    flagged = flagged_captions(spark, d)
    p = pairs_once(spark, d)
    a, b = p.join(flagged.withColumnRenamed("id", "a"), "a", "left_semi"), p.join(flagged.withColumnRenamed("id", "b"), "b", "left_semi")
    either = a.select("id").union(b.select("id"))
    m = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    return m("images", flagged).union(m("ends", either)).union(m("pairs", either.distinct())).union(m("partners", a.select(F.col("b").alias("x")).union(b.select(F.col("a").alias("x"))).distinct()))


@query
def rank_shift(spark, d):
    """How many pairs change their place among an image's best ten when the thematic weight is doubled."""
    e = scored(spark, d).filter("a <> b").select("id", "a", "b", (F.col("aesthetic") * 0.4 + F.col("geometric") * 0.2 + F.col("thematic") * 0.4).alias("before"), (F.col("aesthetic") * 0.4 + F.col("geometric") * 0.2 + F.col("thematic") * 0.8).alias("after"))
    ends = pools.both_ends(e)
    x, y = pools.best_of(ends, "before", 10).select("image", "id", F.col("rank").alias("r1")), pools.best_of(ends, "after", 10).select("image", "id", F.col("rank").alias("r2"))
    j = x.join(y, ["image", "id"], "full_outer")
    return j.groupBy("image").agg(F.count_if(~F.col("r1").eqNullSafe(F.col("r2"))).alias("changed"))


@query
def score_bands(spark, d):
    s = scored(spark, d)
    band = F.when(F.col("composite") < vocab.BAND_BOUNDS[0], 0)
    for i, bound in enumerate(vocab.BAND_BOUNDS[1:], 1):
        band = band.when(F.col("composite") < bound, i)
    return s.groupBy(band.otherwise(len(vocab.BAND_BOUNDS)).alias("band")).agg(F.count("*").alias("pairs"), r6(F.avg("aesthetic")).alias("aesthetic"))


@query
def work_queue(spark, d):
    """Active images that still need a caption, profile or vector."""
    img = table(spark, d, "images").filter("id IS NOT NULL AND isactive").select("id", (F.coalesce(F.trim("caption"), F.lit("")) == "").alias("caption"), (F.coalesce(F.trim("roleprofile"), F.lit("")) == "").alias("profile")).distinct()
    have = table(spark, d, "clipoutput").filter("imageid IS NOT NULL AND embedding IS NOT NULL").select(F.col("imageid").alias("id"), F.lit(True).alias("have")).distinct()
    j = img.join(have, "id", "left").withColumn("vector", F.col("have").isNull())
    return j.filter("caption OR profile OR vector").select("id", "caption", "profile", "vector")


# --- mutations ---------------------------------------------------------------------------------------


@query
def upsert_images(spark, d):
    """Outcome of loading the exported captions into the images: inserted, changed, unchanged, untouched."""
    img = images_once(spark, d, "caption").groupBy("id").agg(F.max("caption").alias("caption"))
    exp = table(spark, d, "corpusimage").filter("id IS NOT NULL").groupBy("id").agg(F.max("caption").alias("caption"))
    return mutations.upsert(img, exp, ["id"]).groupBy("outcome").agg(F.count("*").alias("rows"))


def _scan(spark, d):
    """A scan of the images' files a while later: some moved, some changed, some new."""
    i = F.col("id")
    moved, changed, new = i % 5 == 0, i % 7 == 0, i % 11 == 0
    return images_once(spark, d, "path", "filename", "contenthash").select(
        F.when(moved | new, F.concat(F.lit("/later"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(new, F.concat(F.lit("new-"), "filename")).otherwise(F.col("filename")).alias("filename"),
        F.when(changed, F.concat(F.lit("x"), "contenthash")).otherwise(F.col("contenthash")).alias("contenthash"),
    )


@query
def upsert_files(spark, d):
    """Scanned files against the stored images: touched, changed, moved or inserted, with the image they go to."""
    return mutations.upsert_files(images_once(spark, d, "path", "filename", "contenthash"), _scan(spark, d)).select("id", "path", "outcome")


@query
def caption_write(spark, d):
    """Loading the exported captions: which images have a caption and a profile afterwards."""
    img = images_once(spark, d, "caption", "roleprofile").groupBy("id").agg(F.max("caption").alias("caption"), F.max("roleprofile").alias("roleprofile"))
    after = mutations.write_captions(img, table(spark, d, "corpusimage"))
    return after.groupBy(F.col("caption").isNotNull().alias("captioned"), F.col("roleprofile").isNotNull().alias("profiled")).agg(F.count("*").alias("images"))


@query
def gaze_insert(spark, d):
    """Nominated pairs against the stored ones that are no gaze pairs: those that exist are tagged, others inserted."""
    stored = scored(spark, d).filter("coalesce(selectedfor, '') <> 'gaze'").select("id", "a", "b")
    got = mutations.merge_candidates(stored, gaze_nominate(spark, d).select(F.col("leftid").alias("a"), F.col("rightid").alias("b")))
    return got.select("a", "b", "id", "outcome")


@query
def role_insert(spark, d):
    """Admitted role connections against the stored pairs: tagged where the pair exists, else inserted."""
    return mutations.merge_candidates(pairs_once(spark, d), role_admission(spark, d).select("a", "b"))


@query
def soft_delete_folder(spark, d):
    """Active images left per folder once the first three folders are removed."""
    gone = table(spark, d, "folders").filter("id <= 3").select(F.col("id").alias("folderid"))
    img = mutations.soft_delete(images_once(spark, d, "folderid", "isactive"), gone, "folderid")
    return img.groupBy("folderid").agg(F.count_if("isactive").alias("active"), F.count("*").alias("images"))


@query
def scoped_delete(spark, d):
    """Pairs inside, across and outside the scope of one folder."""
    batch = images_once(spark, d, "folderid").filter("folderid = 4").select("id")
    return mutations.scope_of(pairs_once(spark, d), batch).groupBy("scope").agg(F.count("*").alias("pairs"))


@query
def cascade_delete(spark, d):
    """Decisions left on pairs once pairs of inactive images are deleted."""
    dead = orphan_pairs(spark, d).withColumnRenamed("id", "pairid")
    kept = table(spark, d, "userdecisions").filter("pairid IS NOT NULL").join(dead, "pairid", "left_anti")
    return kept.groupBy(F.lower(F.trim("decision")).alias("decision")).agg(F.count("*").alias("n"))


# --- nested records ----------------------------------------------------------------------------------


@query
def p4_found(spark, d):
    return nested.flatten_profiles(table(spark, d, "images"), "id", "roleprofile").select("imageid", "nodepath", "parentpath")


@query
def p4_objects(spark, d):
    """Objects and their parts as a flat table with their keys."""
    nodes = nested.flatten_profiles(table(spark, d, "images"), "id", "roleprofile")
    return nested.node_table(nodes, ["objects", "parts"], "object string, register string, category string", "object")


@query
def p4_phenomena(spark, d):
    nodes = nested.flatten_profiles(table(spark, d, "images"), "id", "roleprofile")
    return nested.node_table(nodes, ["phenomena"], "phenomenon string, role string", "phenomenon")


@query
def p4_texts(spark, d):
    """The plain text fields, one row per element."""
    nodes = nested.flatten_profiles(table(spark, d, "images"), "id", "roleprofile")
    got = nested.node_table(nodes, ["subjects", "claims", "enacts", "subverts", "directed_at"], "value string", "value")
    return got.withColumn("field", F.regexp_extract("nodepath", r"^([a-z_]+)", 1))
