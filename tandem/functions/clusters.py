"""Concept clusters of captions: which fire, how two sets compare, which name stands for a set."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import vocab
from tandem.functions.text import tokenize


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once: a lambda variable is bound to it instead of its text being
    repeated at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fired(tokens: Column, rows: Iterable[tuple[str, int, str]]) -> Column:
    """Sorted names of the clusters whose every keyword group meets the tokens."""
    groups: dict[str, dict[int, list[str]]] = {}
    for c, g, k in rows:
        groups.setdefault(c, {}).setdefault(g, []).append(k)
    meets = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, sorted(words))))
    each = [F.when(reduce(lambda x, y: x & y, [meets(w) for w in gs.values()]), F.lit(name)) for name, gs in sorted(groups.items())]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def caption_clusters(caption: Column, rows: Iterable[tuple[str, int, str]]) -> Column:
    """Clusters of a caption under a vocabulary of (cluster, group, keyword); none for a null or empty one."""
    rows = list(rows)
    return let(tokenize(caption), lambda t: fired(t, rows))


def _weights() -> Column:
    return F.create_map(*(F.lit(x) for kv in vocab.CLUSTER_WEIGHTS.items() for x in kv))


def weight_of(name: Column, otherwise: float) -> Column:
    return F.coalesce(_weights()[name], F.lit(otherwise))


def weight_sum(names: Column) -> Column:
    return F.aggregate(names, F.lit(0.0), lambda acc, n: acc + weight_of(n, 0.5))


def meaningful(names: Column) -> Column:
    strong = F.array(*(F.lit(n) for n, w in vocab.CLUSTER_WEIGHTS.items() if w >= vocab.MEANINGFUL))
    return F.array_intersect(names, strong)


def weighted_dice(a: Column, b: Column) -> Column:
    """Weighted Dice; 0.1 where no meaningful cluster is shared."""
    both = F.array_intersect(a, b)
    total = weight_sum(a) + weight_sum(b)
    return F.when(F.size(meaningful(both)) == 0, F.lit(0.1)).otherwise(F.when(total > 0, weight_sum(both) * 2 / total).otherwise(F.lit(0.0)))


def axis_bonus(a: Column, b: Column) -> Column:
    has = F.array_contains
    each = [F.when((has(a, x) & has(b, y)) | (has(a, y) & has(b, x)), F.lit(bonus)).otherwise(F.lit(0.0)) for x, y, bonus in vocab.AXIS_PAIRS]
    return F.greatest(*each)


def thematic(a: Column, b: Column, clip: Column, captions: Column, diversity: Column) -> Column:
    """Thematic score of two cluster sets; the rescaled cosine where a caption is missing."""
    both = F.array_intersect(a, b)
    lopsided = (F.size(meaningful(F.array_except(a, b))) == 0) | (F.size(meaningful(F.array_except(b, a))) == 0)
    full = weight_sum(both) > 5.0
    score = F.when(full | lopsided, F.lit(0.0)).otherwise(weighted_dice(a, b))
    bonus = F.when(full | (score > 0.10), F.lit(0.0)).otherwise(axis_bonus(a, b))
    return F.when(captions, F.least(F.lit(1.0), (score + bonus) * diversity)).otherwise(clip)


def representative(names: Column) -> Column:
    """The heaviest cluster, equal weights by name; null for none."""
    ranked = F.array_sort(F.transform(names, lambda n: F.struct((-weight_of(n, 0.0)).alias("w"), n.alias("n"))))
    return F.try_element_at(ranked, F.lit(1))["n"]


def keyword_audit(captions: DataFrame, rows: Iterable[tuple[str, int, str]]) -> DataFrame:
    """(cluster, grp, keyword, captions, percent, sole) of every keyword of all groups, also those that never occur: in how
    many captions it occurs, that number in percent of the captions its cluster fires in (null where it fires in none), and
    in how many the cluster would not fire without it, being alone in its group while every other group is met.  Needs id
    and caption."""
    rows = list(rows)
    groups: dict[str, set[int]] = {}
    for c, g, _ in rows:
        groups.setdefault(c, set()).add(g)
    spark = captions.sparkSession
    words = spark.createDataFrame([(c, g, k, len(groups[c])) for c, g, k in sorted(set(rows))], "cluster string, grp int, keyword string, need int")
    tok = captions.select("id", F.array_distinct(tokenize(F.col("caption"))).alias("t"))
    toks = tok.select("id", F.explode("t").alias("keyword")).distinct()
    hits = toks.join(F.broadcast(words), "keyword")  # the vocabulary is a fixed list
    met = hits.groupBy("id", "cluster", "need", "grp").agg(F.count("*").alias("k"), F.min("keyword").alias("keyword"))
    fires = met.groupBy("id", "cluster", "need").agg(F.collect_list(F.struct("grp", "keyword", "k")).alias("by")).filter(F.size("by") == F.col("need"))
    sole = fires.select("cluster", F.inline("by")).filter("k = 1").groupBy("cluster", "grp", "keyword").agg(F.count("*").alias("sole"))
    on = ["cluster", "grp", "keyword"]
    fired_in = fires.groupBy("cluster").agg(F.count("*").alias("fired"))
    got = words.drop("need").join(hits.groupBy(on).agg(F.count("*").alias("captions")), on, "left").join(sole, on, "left").join(fired_in, "cluster", "left").na.fill(0, ["captions", "sole"])
    return got.select(*on, "captions", F.round(F.col("captions") * 100 / F.col("fired"), 6).alias("percent"), "sole")
