"""Selection pools: every image keeps its best edges by several scores; an edge keeps its first pool's label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOLS = ("composite", "thematic", "geometric", "aesthetic")


def both_ends(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every edge under both of its images (column ``image``); a loop comes once."""
    return edges.withColumn("image", F.explode(F.array_distinct(F.array(a, b))))


def best_of(ends: DataFrame, score: str, k: int, where: Column | None = None) -> DataFrame:
    """The k best edges of each image: score descending, then a, b, id.

    The rank filter is pushed below the shuffle as a group limit, so an image with any share of all edges
    sends at most k rows per map task."""
    w = Window.partitionBy("image").orderBy(F.col(score).desc(), "a", "b", "id")
    rows = ends if where is None else ends.filter(where)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def select_pools(edges: DataFrame, k: int = 50, thematic_floor: float = 0.20, aesthetic_floor: float = 0.55, few: int = 5) -> DataFrame:
    """(id, label) of the edges any pool admits.

    ``edges``: id, a, b, composite, thematic, geometric, aesthetic (no nulls or NaN), structural (boolean).
    Edges with a composite of 0 or less are not considered.  An image whose best geometric edges are
    all structural also keeps its best one that is not."""
    ends = both_ends(edges.filter("composite > 0"))
    comp = best_of(ends, "composite", k).select("id", F.lit(0).alias("p"))
    them = best_of(ends, "thematic", max(30, k // 3), F.col("thematic") >= thematic_floor).select("id", F.lit(1).alias("p"))
    top = best_of(ends, "geometric", few)
    rich = top.filter("NOT structural").select("image").distinct()
    bonus = best_of(ends, "geometric", 1, ~F.col("structural")).join(rich, "image", "left_anti")
    geo = top.select("id").unionByName(bonus.select("id")).select("id", F.lit(2).alias("p"))
    aes = best_of(ends, "aesthetic", few, F.col("aesthetic") >= aesthetic_floor).select("id", F.lit(3).alias("p"))
    first = comp.unionByName(them).unionByName(geo).unionByName(aes).groupBy("id").agg(F.min("p").alias("p"))
    return first.select("id", F.element_at(F.array(*map(F.lit, POOLS)), F.col("p") + 1).alias("label"))
