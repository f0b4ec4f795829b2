"""All pairs of set-valued records above a Jaccard limit, by multi-index one-bit sketches.

Each distinct set becomes a code of one-bit minhashes: two codes agree in a bit with probability
(1 + J) / 2.  The code is cut into segments; a pair of sets at the limit leaves at least one segment
free of errors with a probability that the number of segments is calibrated to.  Sets that share a
segment meet in one shuffle by segment, pass a Hamming test on a packed part of the code within a radius
calibrated the same way, and are then verified on the original sets.  Tables of several kinds of sets,
each with a limit of its own, go through one pass (column ``kind``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.runtime import shuffle_partitions, spread, stage

PACKED = 64


@dataclass(frozen=True)
class SketchParams:
    """limit: Jaccard limit; width: bits of a segment (None: fitted to the number of sets); miss: chance, at the
    limit itself, that no segment agrees, and again that the Hamming test fails (both fall fast above the
    limit); hash_ns, row_ns, pair_ns: cost of one hashed item and bit, of one segment row, and of one
    candidate, for the fit."""

    limit: float
    width: int | None = None
    miss: float = 5e-4
    seed: int = 11
    hash_ns: float = 1.4
    row_ns: float = 1500.0
    pair_ns: float = 2000.0

    def fitted(self, sets: int, items: float) -> SketchParams:
        """With the width of least cost: wider segments need more hashes, narrower ones let more chance pairs meet.
        The best width grows with the logarithm of the number of sets, so chance pairs do not grow with its square."""
        if self.width is not None:
            return self

        def cost(w: int) -> float:
            p = replace(self, width=w)
            return sets * p.segments * (items * w * self.hash_ns + self.row_ns) + sets * sets / 2 ** (w + 1) * p.segments * self.pair_ns

        return replace(self, width=min(range(8, 41), key=cost))

    @property
    def segments(self) -> int:
        clean = ((1 + self.limit) / 2) ** self.width
        return max(math.ceil(math.log(self.miss) / math.log(1 - clean)), math.ceil(PACKED / self.width))

    @property
    def radius(self) -> int:
        """The least Hamming radius on the packed bits that keeps a pair at the limit with chance 1 - miss."""
        p, left = (1 - self.limit) / 2, self.miss
        tail = [math.comb(PACKED, k) * p**k * (1 - p) ** (PACKED - k) for k in range(PACKED + 1)]
        for r in range(PACKED, 0, -1):
            left -= tail[r]
            if left < 0:
                return r
        return 0


def _bits(p: SketchParams):
    """A function from sets, as items laid end to end with their lengths, to one-bit minhashes (sets x bits)."""
    n = p.segments * p.width
    mult = np.random.default_rng(p.seed).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def code(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty((len(lengths), n), bool)
        first = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 64):
            # sets of about equal length form a matrix; shorter ones repeat their last item, which changes no minimum
            rows = order[at : at + 64]
            size = lengths[rows]
            x = flat[first[rows][:, None] + np.minimum(np.arange(int(size.max()))[None, :], (size - 1)[:, None])]
            least = x[:, 0, None] * mult[None, :]
            other = np.empty_like(least)
            for j in range(1, x.shape[1]):
                np.multiply(x[:, j, None], mult[None, :], out=other)
                np.minimum(least, other, out=least)
            least *= np.uint32(0x9E3779B1)
            out[rows] = (least >> np.uint32(15)) & np.uint32(1)
        return out

    return code


def _sketcher(params: dict[int, SketchParams]):
    """(keys, cid, code) of every set: its segments as numbers that also hold kind and place, and the packed code."""

    def run(batches):
        codes = {k: _bits(p) for k, p in params.items()}
        pack = np.uint64(1) << np.arange(PACKED, dtype=np.uint64)
        for batch in batches:
            kinds, lengths = batch.column(0).to_numpy(), np.asarray(batch.column(2).value_lengths(), np.int64)
            flat = (batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            first = np.cumsum(lengths) - lengths
            for kind in np.unique(kinds):
                p = params[int(kind)]
                every = np.nonzero(kinds == kind)[0]
                weight = np.int64(1) << np.arange(p.width, dtype=np.int64)
                place = (np.int64(kind) << 56) | (np.arange(p.segments, dtype=np.int64) << p.width)
                for cut in range(0, len(every), 2048):
                    rows = every[cut : cut + 2048]
                    c = codes[int(kind)](np.concatenate([flat[first[r] : first[r] + lengths[r]] for r in rows]), lengths[rows])
                    n = len(rows)
                    keys = c.reshape(n, p.segments, p.width) @ weight + place[None, :]
                    packed = (c[:, :PACKED] * pack).sum(1, dtype=np.uint64).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p.segments + 1, p.segments, dtype=np.int32)), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([lists, batch.column(1).take(pa.array(rows)), pa.array(packed)], names=["keys", "cid", "code"])

    return run


SKETCH = "keys array<long>, cid long, code long"
#: Sets that share one segment, above which their pairs are made by tiles of many tasks instead of where they meet.
HOT = 2048


def _meet(radius: dict[int, int]):
    """(key, a, b, code): the pairs a < b of the ids of each key whose codes lie within the radius, rows coming sorted
    by key; of a key with more than ``HOT`` ids its ids and codes instead, with b null."""
    names = ["key", "a", "b", "code"]
    most = np.array([radius.get(k, 0) for k in range(max(radius) + 1)])

    def table(keys, a, b=None, code=None):
        null = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(a), null if b is None else pa.array(b), null if code is None else pa.array(code)], names=names)

    def pairs(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray):
        start = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        size = np.diff(np.concatenate([start, [len(keys)]]))
        for n in np.unique(size[size > 1]):
            which = start[size == n]
            if n > HOT:
                at = (which[:, None] + np.arange(n)[None, :]).ravel()
                yield table(keys[at], ids[at], None, codes[at])
                continue
            i, j = np.triu_indices(int(n), 1)
            step = max(1, 200_000 // len(i))
            for cut in range(0, len(which), step):
                at = which[cut : cut + step, None]
                x, y, k = (at + i[None, :]).ravel(), (at + j[None, :]).ravel(), np.repeat(keys[at[:, 0]], len(i))
                keep = (ids[x] != ids[y]) & (np.bitwise_count((codes[x] ^ codes[y]).view(np.uint64)) <= most[k >> 56])
                x, y = ids[x[keep]], ids[y[keep]]
                yield table(k[keep], np.minimum(x, y), np.maximum(x, y))

    def run(batches):
        none = np.zeros(0, np.int64)
        held_key, held, hot = None, (none, none), None
        for b in batches:
            keys, ids, codes = (b.column(i).to_numpy() for i in range(3))
            if hot is not None and len(keys):
                # a hot key goes on: its ids are passed through
                n = int(np.searchsorted(keys, hot, side="right"))
                if n:
                    yield table(keys[:n], ids[:n], None, codes[:n])
                    keys, ids, codes = keys[n:], ids[n:], codes[n:]
                hot = hot if not len(keys) else None
            if not len(keys):
                continue
            if len(held[0]):
                keys, ids, codes = np.concatenate([np.full(len(held[0]), held_key), keys]), np.concatenate([held[0], ids]), np.concatenate([held[1], codes])
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last:
                yield from pairs(keys[:last], ids[:last], codes[:last])
            held_key, held = keys[-1], (ids[last:], codes[last:])
            if len(held[0]) > HOT:
                yield table(np.full(len(held[0]), held_key), held[0], None, held[1])
                hot, held = held_key, (none, none)
        if len(held[0]):
            yield from pairs(np.full(len(held[0]), held_key), *held)

    return run


def all_pairs(groups: DataFrame, key: list[str], member: str, block: int = 512) -> DataFrame:
    """(*key, a, b): every pair a < b of different members of a group, in tiles of two blocks, so that a group of any
    size spreads over many tasks."""
    sizes = groups.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).filter("_blocks > 0")
    own = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")
    side = groups.join(sizes, key).withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = side.select(*key, F.col(member).alias("_m"), "_own", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"))
    x, y = side.filter("_own = _i").select(*key, "_i", "_j", F.col("_m").alias("x")), side.filter("_own = _j").select(*key, "_i", "_j", F.col("_m").alias("y"))
    # inside a diagonal tile both orders of a pair meet, in any other just one
    met = x.join(y, [*key, "_i", "_j"]).filter("x <> y AND (_i <> _j OR x < y)")
    return met.select(*key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def set_classes(df: DataFrame, id_col: str, items_col: str, least: int | dict[int, int], kind_col: str | None = None, text_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, members): equal sets of a kind share a class named by its smallest record id.

    classes (kind, cid, n, items sorted), members (kind, id, cid, text: a hash of ``text_col``, by which exact
    copies of the stored text are known; the set itself where there is none).  Nulls and repeated items inside
    a set do not count; sets of fewer than ``least`` items (of the kind) and null sets or ids take no part.
    Rows of one id with different sets are members of both classes."""
    kind = F.col(kind_col).cast("int") if kind_col else F.lit(0)
    floor = F.lit(least) if isinstance(least, int) else F.create_map(*(F.lit(x) for kv in least.items() for x in kv))[F.col("kind")]
    # items are compared as 64-bit hashes for the sketches and as values in the verification
    sets = (
        df.select(kind.alias("kind"), F.col(id_col).cast("long").alias("id"), F.array_sort(F.array_distinct(F.filter(items_col, lambda x: x.isNotNull()))).alias("items"), (F.xxhash64(text_col) if text_col else F.lit(0).cast("long")).alias("text"))
        .filter(F.col("id").isNotNull() & (F.size("items") >= floor))
        .withColumn("ka", F.xxhash64("items"))
        .withColumn("kb", F.xxhash64(F.lit(1), F.col("items")))
    )
    staged = stage(sets, "sets")
    # a group of copies of any size shrinks to one row per map task before it is shuffled
    heads = staged.groupBy("kind", "ka", "kb").agg(F.min("id").alias("cid"), F.first("items").alias("items"))
    classes = stage(heads.select("kind", "ka", "kb", "cid", F.size("items").alias("n"), "items"), "setclasses")
    members = staged.select("kind", "id", "text", "ka", "kb").distinct().join(classes.select("kind", "ka", "kb", "cid"), ["kind", "ka", "kb"])
    return classes.select("kind", "cid", "n", "items"), members.select("kind", "id", "cid", "text")


def similar_classes(classes: DataFrame, params: SketchParams | dict[int, SketchParams]) -> DataFrame:
    """(kind, a, b, similarity), a < b: pairs of different sets of a kind with Jaccard similarity of at least the limit."""
    params = params if isinstance(params, dict) else {0: params}
    spark = classes.sparkSession
    sizes = {r.kind: (r.sets, r.items) for r in classes.groupBy("kind").agg(F.count("*").alias("sets"), F.avg("n").alias("items")).collect()}  # a row a kind
    fitted = {k: p.fitted(*sizes.get(k, (1, 1.0))) for k, p in params.items()}
    hashed = classes.select("kind", "cid", F.transform("items", lambda w: F.xxhash64(w)).alias("h"))
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    keyed = spread(hashed).mapInArrow(_sketcher(fitted), SKETCH).select(F.explode("keys").alias("key"), "cid", "code").repartition(n, "key").sortWithinPartitions("key")
    met = stage(keyed.mapInArrow(_meet({k: p.radius for k, p in fitted.items()}), "key long, a long, b long, code long"), "met")
    by_kind = lambda v: F.create_map(*(F.lit(x) for k, p in fitted.items() for x in (k, v(p))))[F.col("kind")]
    kind = F.shiftright("key", 56).cast("int").alias("kind")
    tiles = all_pairs(met.filter("b IS NULL").select("key", F.struct(F.col("a").alias("id"), "code").alias("m")), ["key"], "m").withColumn("kind", kind)
    tiles = tiles.filter((F.col("a.id") < F.col("b.id")) & (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= by_kind(lambda p: p.radius)))
    cand = met.filter("b IS NOT NULL").select(kind, "a", "b").unionByName(tiles.select("kind", F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()
    of = lambda end: classes.select("kind", F.col("cid").alias(end), F.col("items").alias(f"items{end}"))
    both = cand.join(of("a"), ["kind", "a"]).join(of("b"), ["kind", "b"])
    common = F.size(F.array_intersect("itemsa", "itemsb"))
    sim = common / (F.size("itemsa") + F.size("itemsb") - common)
    return both.select("kind", "a", "b", sim.alias("similarity")).filter(F.col("similarity") >= by_kind(lambda p: p.limit))


def expand(pairs: DataFrame, members: DataFrame, whole: int = 64) -> DataFrame:
    """(kind, id_lo, id_hi) of records: every pair between the members of linked classes and inside a class.

    Of a class of more than ``whole`` members, exact copies of one stored text are not multiplied out: each is
    paired with the smallest id of that text, which stands for it in all other pairs.  Members with different
    texts always are, in tiles, however large the class."""
    size = members.groupBy("kind", "cid").agg(F.count_distinct("id").alias("k"))
    sized = stage(members.join(size, ["kind", "cid"]).groupBy("kind", "cid", "k", "text", "id").agg(F.lit(1).alias("one")).drop("one"), "members")
    big = sized.filter(F.col("k") > whole)
    heads = big.groupBy("kind", "cid", "text").agg(F.min("id").alias("head"))
    kept = sized.filter(F.col("k") <= whole).select("kind", "cid", "id").unionByName(heads.select("kind", "cid", F.col("head").alias("id"))).distinct()
    a, b = kept.select("kind", F.col("id").alias("x"), F.col("cid").alias("a")), kept.select("kind", F.col("id").alias("y"), F.col("cid").alias("b"))
    between = pairs.select("kind", "a", "b").join(a, ["kind", "a"]).join(b, ["kind", "b"]).select("kind", "x", "y")
    several = kept.join(size.filter("k > 1").select("kind", "cid"), ["kind", "cid"], "left_semi")
    inside = all_pairs(several, ["kind", "cid"], "id").select("kind", F.col("a").alias("x"), F.col("b").alias("y"))
    star = big.join(heads, ["kind", "cid", "text"]).select("kind", F.col("head").alias("x"), F.col("id").alias("y"))
    every = between.unionByName(inside).unionByName(star).filter("x <> y")
    return every.select("kind", F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi")).distinct()
