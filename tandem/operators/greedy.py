"""Greedy admission of edges under capacities of their ends, equal to the sequential loop.

An edge that is among the first c remaining edges at both ends, c being what is left of the ends'
capacities, cannot be blocked by an earlier one; so whole rounds of such edges are admitted at
once.  When few edges are left (a documented bound) the sequential loop finishes the rest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.runtime import release, stage


def _loop(rows: pd.DataFrame, capacity: dict[int, int], left: dict, scoped: bool) -> list[int]:
    out = []
    for r in rows.itertuples(index=False):
        ka, kb = ((r.a, r.kind), (r.b, r.kind)) if scoped else (r.a, r.b)
        cap = capacity[r.kind]
        if left.get(ka, cap) > 0 and left.get(kb, cap) > 0:
            left[ka], left[kb] = left.get(ka, cap) - 1, left.get(kb, cap) - 1
            out.append(r.pos)
    return out


def capped_greedy(edges: DataFrame, capacity: dict[int, int], finish: int = 100_000) -> DataFrame:
    """The edges a loop in order of ``pos`` would admit.

    ``edges``: pos (unique, long), a, b (different), kind (int).  Each image takes part in at most
    ``capacity[kind]`` admitted edges of a kind.  ``finish``: once no more edges than this are open, the
    loop itself decides them on the driver; above it only rounds run, so its memory is bounded."""
    spark = edges.sparkSession
    caps = F.create_map(*(F.lit(int(x)) for kv in capacity.items() for x in kv))
    most = max(capacity.values())
    open_ = stage(edges.select("pos", "a", "b", "kind"), "greedy")
    taken = spark.createDataFrame([], edges.select("pos", "a", "b", "kind").schema)
    while True:
        used = taken.select(F.explode(F.array("a", "b")).alias("v"), "kind").groupBy("v", "kind").agg(F.count("*").alias("n"))
        if open_.limit(finish + 1).count() <= finish:
            left = {(r.v, r.kind): capacity[r.kind] - r.n for r in used.join(open_.select(F.explode(F.array("a", "b")).alias("v"), "kind").distinct(), ["v", "kind"]).collect()}
            rest = _loop(open_.toPandas().sort_values("pos"), capacity, left, True)
            last = spark.createDataFrame(pd.DataFrame({"pos": pd.Series(rest, dtype="int64")}), "pos long")
            return taken.select("pos").unionByName(last).join(edges, "pos")
        w = Window.partitionBy("v", "kind").orderBy("pos")
        ends = open_.withColumn("v", F.explode(F.array("a", "b")))
        # at most the largest capacity of an image's edges can be admitted now: limited before the shuffle
        near = ends.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
        room = near.join(used, ["v", "kind"], "left").filter(F.col("rank") <= caps[F.col("kind")] - F.coalesce("n", F.lit(0)))
        now = stage(room.groupBy("pos", "a", "b", "kind").count().filter("count = 2").drop("count"), "greedy")
        taken = stage(taken.unionByName(now), "greedy")
        degree = taken.select(F.explode(F.array("a", "b")).alias("v"), "kind").groupBy("v", "kind").agg(F.count("*").alias("n"))
        full = stage(degree.filter(F.col("n") >= caps[F.col("kind")]).select("v", "kind"), "greedy")
        alive = open_.join(now.select("pos"), "pos", "left_anti")
        alive = alive.join(full.withColumnRenamed("v", "a"), ["a", "kind"], "left_anti").join(full.withColumnRenamed("v", "b"), ["b", "kind"], "left_anti")
        open_, before = stage(alive.select("pos", "a", "b", "kind"), "greedy"), open_
        release(before, full)


def cap_two(edges: DataFrame, finish: int = 100_000) -> DataFrame:
    """``edges`` (pos, a, b) admitted by two passes, with ``turn``: first edges between two unseen images; then,
    among edges with an end the first pass left unseen, again each image at most once."""
    one = capped_greedy(edges.withColumn("kind", F.lit(1)), {1: 1}, finish)
    seen = stage(one.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "seen")
    marked = edges.join(seen.select(F.col("v").alias("a"), F.lit(True).alias("sa")), "a", "left").join(seen.select(F.col("v").alias("b"), F.lit(True).alias("sb")), "b", "left")
    rest = marked.filter("sa IS NULL OR sb IS NULL").select("pos", "a", "b")
    two = capped_greedy(rest.withColumn("kind", F.lit(1)), {1: 1}, finish)
    pick = lambda d, n: d.select("pos", "a", "b", F.lit(n).alias("turn"))
    return pick(one, 1).unionByName(pick(two, 2))
