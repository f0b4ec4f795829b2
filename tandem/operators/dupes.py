"""Near-duplicate images: hash pairs within a Hamming radius, components, heroes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.kernels import hamming
from tandem.functions.text import filename_bases
from tandem.runtime import heavy_groups, release, stage


def hash_classes(images: DataFrame, id_col: str = "id", hash_col: str = "dhash") -> tuple[DataFrame, DataFrame]:
    """(classes, members): images of equal hash share a class named by the smallest id.  Null and malformed
    hashes belong to none."""
    ok = images.filter(F.col(hash_col).rlike("^[0-9a-fA-F]{1,16}$") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(hash_col).alias("dhash"))
    classes = stage(ok.groupBy("dhash").agg(F.min("id").alias("cid")), "hashes")
    return classes, ok.distinct().join(classes, "dhash").select("id", "cid")


def bands(width: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """((shift, bits) of each band, r): values of ``width`` bits that are at most ``radius`` bits apart differ by at most
    r bits in some band.  Of all even cuts into bands of at most 14 bits, the one that leaves the fewest pairs to compare."""
    best = None
    for m in range(max(1, math.ceil(width / 14)), max(width, 1) + 1):
        cuts = [round(i * width / m) for i in range(m + 1)]
        got, r = [(x, y - x) for x, y in zip(cuts, cuts[1:])], radius // m
        share = sum(min(1.0, sum(math.comb(n, k) for k in range(r + 1)) / 2**n) for _, n in got)
        if best is None or share < best[0]:
            best = share, got, r
    return best[1], best[2]


def _near(p: np.ndarray, q: np.ndarray, width: int, radius: int, room: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of p, rows of q) of all pairs of values at most ``radius`` bits apart, each once."""
    if len(p) * len(q) <= room:
        yield np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= radius)
        return
    cuts, r = bands(width, radius)
    part = lambda v, band: (v >> np.uint64(band[0])) & np.uint64((1 << band[1]) - 1)
    for b, band in enumerate(cuts):
        kp, kq = (part(v, band).astype(np.int64) for v in (p, q))
        op, oq = np.argsort(kp, kind="stable"), np.argsort(kq, kind="stable")
        ends = np.arange((1 << band[1]) + 1)
        sp, sq = np.searchsorted(kp[op], ends), np.searchsorted(kq[oq], ends)
        masks = np.array([sum(1 << i for i in c) for k in range(min(r, band[1]) + 1) for c in combinations(range(band[1]), k)], np.int64)
        for key in np.nonzero(np.diff(sp))[0]:
            near = key ^ masks
            n = sq[near + 1] - sq[near]
            total = int(n.sum())
            if not total:
                continue
            other = oq[np.repeat(sq[near] - np.cumsum(n) + n, n) + np.arange(total)]
            step, width_ = max(1, room // total), min(total, room)
            for at in range(sp[key], sp[key + 1], step):
                mine = op[at : min(at + step, sp[key + 1])]
                for to in range(0, total, width_):
                    some = other[to : to + width_]
                    x, y = np.nonzero(np.bitwise_count(p[mine][:, None] ^ q[some][None, :]) <= radius)
                    x, y = mine[x], some[y]
                    first = np.ones(len(x), bool)  # not met in an earlier band
                    for before in cuts[:b]:
                        first &= np.bitwise_count(part(p[x] ^ q[y], before)) > r
                    yield x[first], y[first]


def hamming_pairs(classes: DataFrame, radius: int = 8, block: int = 131_072) -> DataFrame:
    """(a, b, distance), a < b, of different hashes at most ``radius`` bits apart.

    Hashes are cut into blocks and every two blocks are one task, so that the table is sent once per block and no
    candidate leaves a task.  Inside it the bits that the hashes use are cut into bands; near hashes differ in few bits
    of some band, so only such buckets are compared: no near pair can be missed."""
    spark = classes.sparkSession
    rows = classes.select(F.col("cid").cast("long").alias("cid"), F.conv("dhash", 16, -10).cast("long").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.bit_or("v").alias("bits")).first()
    width = 64 if (size.bits or 0) < 0 else (size.bits or 0).bit_length()
    blocks = max(1, min(6, math.ceil(size.n / 2048)), math.ceil(size.n / block))
    own = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = own.select("cid", "v", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def tile(t: pa.Table) -> pa.Table:
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_numpy()
        cid, v = t.column("cid").to_numpy(), t.column("v").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(cid, kind="stable")
        mine, other = order[own[order] == i], order[own[order] == j]
        a, b, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for x, y in _near(v[mine], v[other], width, radius):
            x, y = mine[x], other[y]
            if i == j:
                x, y = x[cid[x] < cid[y]], y[cid[x] < cid[y]]
            a.append(np.minimum(cid[x], cid[y]))
            b.append(np.maximum(cid[x], cid[y]))
            d.append(np.bitwise_count(v[x] ^ v[y]).astype(np.int32))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "distance": np.concatenate(d)})

    return heavy_groups(tiles, "i", "j").applyInArrow(tile, "a long, b long, distance int")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge: the smallest id it is connected with.

    Alternating star contractions: each round links neighbours to the smallest id around them; the number
    of rounds grows with the logarithm of the longest chain.  Each round is written to the shared folder."""
    e = stage(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v").distinct(), "components")
    mark = None
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        e, before = stage(small.select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components"), e
        release(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots).distinct()


def variant_edges(images: DataFrame, id_col: str = "id", hash_col: str = "dhash", date_col: str = "capturedate", name_col: str = "filename") -> DataFrame:
    """(a, b): images of equal date whose different names share a base form, each linked to the smallest id of its
    date and form; only images with a hash.

    All names under a date and form are variants of each other or of the same other one, so linking them to one
    image connects what all their pairs connect, and a frequent name costs its rows and not their square."""
    ok = images.filter((F.col(hash_col) != "") & F.col(id_col).isNotNull() & (F.col(name_col) != "") & ~F.isnan(date_col))
    rows = ok.select(F.col(id_col).alias("id"), F.col(date_col).alias("date"), F.lower(name_col).alias("name")).distinct()
    forms = rows.withColumn("form", F.explode(filename_bases(F.col("name"))))
    lead = forms.groupBy("date", "form").agg(F.min("id").alias("b"), (F.min("name") < F.max("name")).alias("many")).filter("many").drop("many")
    return forms.join(lead, ["date", "form"]).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def duplicate_groups(images: DataFrame, radius: int = 8) -> DataFrame:
    """(id, groupid): images connected by near hashes, or by equal dates together with file name variants; only
    groups of two or more, named by their smallest id.  Needs id and dhash, for the second branch also capturedate
    and filename; a table without those two columns has only the first."""
    classes, members = hash_classes(images)
    edges = hamming_pairs(classes, radius).select("a", "b").unionByName(members.select(F.col("id").alias("a"), F.col("cid").alias("b")))
    if {"capturedate", "filename"} <= set(images.columns):
        edges = edges.unionByName(variant_edges(images))
    return components(edges.filter("a <> b")).select("id", F.col("root").alias("groupid"))


def heroes(members: DataFrame) -> DataFrame:
    """(groupid, heroid): earliest date, unknown dates last, then smallest id.  Needs id, groupid, date."""
    rank = F.struct(F.col("date").isNull().alias("none"), "date", "id")
    return members.groupBy("groupid").agg(F.min(rank)["id"].alias("heroid"))


__all__ = ["components", "duplicate_groups", "hamming", "hamming_pairs", "hash_classes", "heroes", "variant_edges"]
