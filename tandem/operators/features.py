"""Per-image feature columns for the pair kernels, from the stored embeddings.

The library stores one embedding per image; colour, edge and grid features are derived from stretches of
it, so that the pair kernels run on real vectors of the right shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import kernels as K


def finite(col):
    """A score for arithmetic: null, NaN and infinite ones count as 0."""
    return F.when(col.isNotNull() & (F.abs(col) < F.lit(float("inf"))) & ~F.isnan(col), col).otherwise(F.lit(0.0))


def features(clip: DataFrame) -> DataFrame:
    """(id, clip, edge, grid, hist, palette, peak, var, line) for every image with a usable 512-value embedding
    (copies once): the vectors, and what the pair kernels need of each image alone."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    rows = clip.filter(F.col("imageid").isNotNull() & (F.size("embedding") == 512)).filter(ok)
    one = rows.groupBy(F.col("imageid").alias("id")).agg(F.min("embedding").alias("e"))
    absolute = lambda start, n: F.transform(F.slice("e", start, n), lambda x: F.abs(x.cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # a divisor inside a lambda would be computed again for every element: it is repeated as an array instead
    over = lambda a, by, n: F.zip_with(a, F.array_repeat(by, n), lambda x, y: x / y)
    share = lambda start, n: over(absolute(start, n), total(absolute(start, n)), n)
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    got = one.select(
        "id",
        over(F.transform("e", lambda x: x.cast("double")), length, 512).alias("clip"),
        share(1, 32).alias("edge"),
        F.transform(absolute(33, 32), lambda x: F.least(x * 8, F.lit(1.0))).alias("grid"),
        share(65, 64).alias("hist"),
        F.transform(over(F.transform(F.slice("e", 129, 18), lambda x: x.cast("double")), length, 18), lambda x: x * 1000).alias("palette"),
    )
    return got.select("*", K.norm_peak(F.col("edge")).alias("peak"), K.norm_variance(F.col("grid")).alias("var"), K.dominant_line(F.col("edge")).alias("line"))


def surrogate_scalars(images: DataFrame) -> DataFrame:
    """(id, folderid, date, filename, caption, bw, gaze, hue, sat, x, y): image columns plus accent and centroid
    values that are fixed functions of the id, the library having no column for them.  Copies count once."""
    h = F.col("id")
    return images.filter("id IS NOT NULL").groupBy("id").agg(
        *(F.max(c).alias(c) for c in ("folderid", "capturedate", "filename", "caption", "colorprofile", "gazedirectionx"))
    ).select(
        "id", "folderid", F.col("capturedate").alias("date"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("caption", F.lit("")).alias("caption"),
        F.coalesce(F.lower(F.trim("colorprofile")) == "bw", F.lit(False)).alias("bw"), F.col("gazedirectionx").alias("gaze"),
        ((h * 7) % 24 * 15 + 7.5).alias("hue"), ((h * 11) % 75 / 100 + 0.25).alias("sat"), ((h * 13) % 100 / 100).alias("x"), ((h * 29) % 100 / 100).alias("y"),
    )
