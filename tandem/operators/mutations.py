"""Incremental maintenance as functions of tables: merges, scopes, soft deletes, slot arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import vocab


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The merged table with ``outcome``: inserted, changed, unchanged or untouched.

    One row per key on either side.  The incoming row wins whole where it has a row; columns the incoming
    side lacks keep their value."""
    shared = [c for c in incoming.columns if c not in keys]
    old = current.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in current.columns if c not in keys), F.lit(True).alias("_in_old"))
    new = incoming.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in shared), F.lit(True).alias("_in_new"))
    j = old.join(new, keys, "full_outer")
    same = F.lit(True)
    for c in shared:
        if c in current.columns:
            same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    outcome = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "untouched").when(same, "unchanged").otherwise("changed")
    value = lambda c: F.when(F.col("_in_new").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")) if c in shared else F.col(f"_old_{c}")
    return j.select(*keys, *(value(c).alias(c) for c in current.columns if c not in keys), outcome.alias("outcome"))


def upsert_files(current: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, path, filename, contenthash, outcome) of every scanned file against the table's images.

    By path first: ``touched`` with the same hash, ``changed`` with another (its vectors must go).  Then by file name
    and hash: ``moved``, the smallest id of several.  All others are ``inserted``, with a null id.  Repeated rows on
    either side count once; of several images on one path the smallest id is taken; null hashes are never equal."""
    files = scanned.select("path", "filename", "contenthash").filter("path IS NOT NULL").distinct()
    here = current.filter("path IS NOT NULL AND id IS NOT NULL").groupBy("path").agg(F.min(F.struct("id", "contenthash")).alias("own"))
    named = current.filter("filename IS NOT NULL AND contenthash IS NOT NULL AND id IS NOT NULL").groupBy("filename", "contenthash").agg(F.min("id").alias("same"))
    known = files.join(here, "path", "left")
    found = known.filter("own IS NOT NULL").select(F.col("own.id").alias("id"), "path", "filename", "contenthash", F.when(F.col("own.contenthash") == F.col("contenthash"), "touched").otherwise("changed").alias("outcome"))
    rest = known.filter("own IS NULL").join(named, ["filename", "contenthash"], "left")
    return found.unionByName(rest.select(F.col("same").alias("id"), "path", "filename", "contenthash", F.when(F.col("same").isNotNull(), "moved").otherwise("inserted").alias("outcome")))


def write_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """``images`` with new captions by id; a caption that changes takes the role profile made from the old one away."""
    new = captions.filter("id IS NOT NULL AND caption IS NOT NULL").groupBy("id").agg(F.max("caption").alias("_new"))
    joined = images.join(new, "id", "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("caption"))
    return joined.withColumn("roleprofile", F.when(changed, F.lit(None)).otherwise(F.col("roleprofile"))).withColumn("caption", F.coalesce("_new", "caption")).drop("_new")


def merge_candidates(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, id, outcome) of candidate edges (a, b) against the pairs (id, a, b), whichever end comes first: ``tagged``
    where the pair exists, with its id, else ``inserted``."""
    key = lambda df, *more: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)
    have = key(pairs, "id").groupBy("a", "b").agg(F.min("id").alias("id"))
    return key(candidates).distinct().join(have, ["a", "b"], "left").select("a", "b", "id", F.when(F.col("id").isNotNull(), "tagged").otherwise("inserted").alias("outcome"))


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: incoming rows whose key exists are left out; repeated incoming keys insert once."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The parents without ``gone`` and every child table without the rows that refer to them."""
    out = {"": parents.join(gone.select(key), key, "left_anti")}
    for name, (child, ref) in children.items():
        out[name] = child.join(gone.select(F.col(key).alias(ref)), ref, "left_anti")
    return out


def soft_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``isactive`` false where the key is in ``gone``; other rows as they are."""
    hit = gone.select(key, F.lit(True).alias("_gone")).distinct()
    return rows.join(hit, key, "left").withColumn("isactive", F.when(F.col("_gone"), False).otherwise(F.col("isactive"))).drop("_gone")


def scope_of(pairs: DataFrame, batch: DataFrame) -> DataFrame:
    """``pairs`` (id, a, b) with ``scope``: intra (both ends in the batch), cross (one) or outside."""
    ids = batch.select("id").distinct()
    a, b = ids.select(F.col("id").alias("a"), F.lit(1).alias("ia")), ids.select(F.col("id").alias("b"), F.lit(1).alias("ib"))
    n = F.coalesce("ia", F.lit(0)) + F.coalesce("ib", F.lit(0))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("id", "a", "b", F.when(n == 2, "intra").when(n == 1, "cross").otherwise("outside").alias("scope"))


def replace_scope(pairs: DataFrame, batch: DataFrame, fresh: DataFrame, scope: str) -> DataFrame:
    """Re-index: the pairs of one scope are exchanged for ``fresh``."""
    kept = scope_of(pairs.select("id", "a", "b"), batch).filter(F.col("scope") != scope).select("id")
    return pairs.join(kept, "id", "left_semi").unionByName(fresh)


def slots(budget: int) -> list[int]:
    """Slots of the score bands and the echo tail for a budget: in proportion, at least one each, halves up;
    what is too much is taken back one at a time, first band first.  Budgets below the number of bands fill
    the first bands with one each."""
    weights = [*vocab.BAND_WEIGHTS, vocab.ECHO_TAIL_WEIGHT]
    if budget <= 0:
        return [0] * len(weights)
    if budget < len(weights):
        return [int(i < budget) for i in range(len(weights))]
    out = [max(1, int(w / sum(weights) * budget + 0.5)) for w in weights]
    over, i = sum(out) - budget, 0
    while over > 0:
        if out[i] > 1:
            out[i] -= 1
            over -= 1
        i = (i + 1) % len(out)
    return out
