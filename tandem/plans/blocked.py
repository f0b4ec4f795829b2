"""Blocked all-pairs scoring inside scopes: square tiles of vectors, survivors only.

A scope's images are cut into blocks of bounded size; a tile is a pair of blocks, so that a scope of
any size spreads evenly over tasks and no task holds more than two blocks.  Each tile multiplies its
blocks, applies the filter and keeps the best partners of every image it holds; the best of the tiles'
best are exact.  Only those survivors leave a task: pairs are never written out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.runtime import heavy_groups

OUT = "scope string, id long, other long, score double"


def best_pairs(vectors: DataFrame, k: int, floor: float = -2.0, block: int = 2048, only_new: bool = False) -> DataFrame:
    """(scope, id, other, score, rank): of every image its k partners of highest dot product in its scope, equal
    ones by id, above ``floor``.  ``vectors``: id, scope (text), vec; with ``only_new`` also isnew, and then
    only pairs of a new and an old image count.  Repeated ids count once; null vectors take no part."""
    new = F.col("isnew") if only_new else F.lit(True)
    rows = vectors.filter("vec IS NOT NULL AND id IS NOT NULL AND scope IS NOT NULL").select("id", "scope", "vec", new.alias("isnew")).dropDuplicates(["id", "scope"])
    if only_new:
        # new blocks are numbered first, old ones after them, and only tiles of one with the other are made
        n = lambda c: F.ceil(F.count_if(c) / block).cast("int")
        sizes = rows.groupBy("scope").agg(n(F.col("isnew")).alias("fresh"), n(~F.col("isnew")).alias("rest")).filter("fresh > 0 AND rest > 0")
        hashed, is_new = F.xxhash64("id"), F.col("isnew")
        placed = rows.join(sizes, "scope").withColumn("own", F.when(is_new, F.pmod(hashed, F.col("fresh"))).otherwise(F.pmod(hashed, F.col("rest")) + F.col("fresh")).cast("int"))
        partners = F.when(is_new, F.sequence(F.col("fresh"), F.col("fresh") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("fresh") - 1))
        tiles = placed.withColumn("with", F.explode(partners))
    else:
        sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        placed = rows.join(sizes, "scope").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        # each block takes part in the tiles (i, j), i <= j, on its row and column
        tiles = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = tiles.select("scope", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "vec", "isnew")

    def tile(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        scope = t.column("scope")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own, ids, fresh = (t.column(c).to_numpy() for c in ("own", "id", "isnew"))
        vec = t.column("vec").combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        a, b = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        a, b = a[np.argsort(ids[a])], b[np.argsort(ids[b])]
        s = np.round(x[a] @ x[b].T, 9)
        s[ids[a][:, None] == ids[b][None, :]] = -9.0
        if only_new:
            s[fresh[a][:, None] == fresh[b][None, :]] = -9.0
        s[s <= floor] = -9.0
        got = []
        for m, rows_, cols in ((s, a, b), (s.T, b, a)) if i != j else ((s, a, b),):
            take = min(k, m.shape[1])
            if not take or not m.shape[0]:
                continue
            # stable sort on ids in order: equal scores go to the smaller id
            top = np.argsort(-m, axis=1, kind="stable")[:, :take]
            val = np.take_along_axis(m, top, 1)
            r, c = np.nonzero(val > -9.0)
            got.append((ids[rows_][r], ids[cols][top[r, c]], val[r, c]))
        left, right, score = (np.concatenate(z) for z in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"scope": pa.array([scope] * len(left), pa.string()), "id": pa.array(left, pa.int64()), "other": pa.array(right, pa.int64()), "score": pa.array(score, pa.float64())})

    found = heavy_groups(keyed, "scope", "i", "j").applyInArrow(tile, OUT)
    w = Window.partitionBy("scope", "id").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
