"""Mixing sources to target shares of the total size.

Every source is put in a random order and cut into blocks of equal size.  The block quotas that meet
the targets are split over the output shards by a binary tree of multivariate hypergeometric draws,
so every shard is a fair sample of the mixture and the totals stay exact; each shard then takes its
own stretch of each source's permuted blocks and shuffles what they hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.scan import ranged_positions
from tandem.runtime import stage


@dataclass(frozen=True)
class MixParams:
    """total: size of the mixture (None: the largest at which every source reaches its share); block: size of
    a block; per_shard: blocks aimed at per shard, however large the mixture; shards: least number of shards; fill: items
    of each source and magnitude that the rest of a quota is filled from."""

    total: int | None = None
    block: int = 2048
    per_shard: int = 256
    shards: int = 8
    fill: int = 64
    seed: int = 17


@dataclass(frozen=True)
class Quota:
    source: str
    target: float
    share: float
    repeats: int
    held: int
    quota: int


def quotas(held: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> list[Quota]:
    """Each source's size in the mixture.  Sources without any size keep a quota of 0 and the others' shares
    grow in proportion; a source whose allowed repeats do not reach its share gives what it can."""
    live = {s: t for s, t in targets.items() if held.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    norm = sum(t[0] for t in live.values())
    if total is None:
        total = min((math.floor(held[s] * r * norm / w) for s, (w, r) in live.items()), default=0)
    out = []
    for s, (w, r) in sorted(targets.items()):
        share = w / norm if s in live else 0.0
        out.append(Quota(s, w, share, r, held.get(s, 0), min(round(share * total), held.get(s, 0) * r) if s in live else 0))
    return out


class SplitTree:
    """The block quotas of all shards as a tree: each node draws the blocks of its left half without replacement.

    A node's draw depends on the seed and its place alone, so every task works out the few nodes it needs, and the
    table of all shards never exists."""

    def __init__(self, blocks: list[int], shards: int, seed: int):
        self.blocks, self.shards, self.seed = np.asarray(blocks, np.int64), shards, seed
        self.draw = lru_cache(100_000)(self._draw)

    def __reduce__(self):
        return SplitTree, (self.blocks.tolist(), self.shards, self.seed)

    def _draw(self, lo: int, hi: int, have: tuple[int, ...]) -> tuple[int, ...]:
        rng, n, mid = np.random.default_rng([self.seed, lo, hi]), sum(have), (lo + hi) // 2
        left = round(n * (mid - lo) / (hi - lo))
        if not n:
            return have
        # the generator takes fewer than 10^9 blocks: above that they are drawn in lots, and the difference is made up in order
        lot = n // 500_000_000 + 1
        lots = np.array(have, np.int64) // lot
        drawn = rng.multivariate_hypergeometric(lots, min(round(left / lot), int(lots.sum())), method="marginals") * lot
        for i, h in enumerate(have):
            off = left - int(drawn.sum())
            drawn[i] += min(off, h - int(drawn[i])) if off > 0 else -min(-off, int(drawn[i]))
        return tuple(drawn.tolist())

    def shard_of(self, source: int, place: int) -> int:
        """The shard that holds a source's block of this place in its permuted order."""
        lo, hi, have = 0, self.shards, tuple(self.blocks.tolist())
        while hi - lo > 1:
            mid, left = (lo + hi) // 2, self.draw(lo, hi, have)
            if place < left[source]:
                hi, have = mid, left
            else:
                place -= left[source]
                lo, have = mid, tuple(h - l for h, l in zip(have, left))
        return lo

    def table(self) -> np.ndarray:
        """(shards x sources) block counts, for tests."""
        out = np.zeros((self.shards, len(self.blocks)), np.int64)

        def halve(lo: int, hi: int, have: tuple[int, ...]) -> None:
            if hi - lo == 1:
                out[lo] = have
                return
            left = self.draw(lo, hi, have)
            halve(lo, (lo + hi) // 2, left)
            halve((lo + hi) // 2, hi, tuple(h - l for h, l in zip(have, left)))

        halve(0, self.shards, tuple(self.blocks.tolist()))
        return out


def fill_rest(rest: dict[str, int], candidates: list[tuple[str, int, object]]) -> list[object]:
    """Of the candidates (source, size, item) those that fill what is left of each source's quota, larger ones first."""
    out, room = [], dict(rest)
    for source, size, item in sorted(candidates, key=lambda c: (c[0], -c[1], str(c[2]))):
        if size <= room.get(source, 0):
            room[source] -= size
            out.append(item)
    return out


def _stride(n: int, seed: int) -> tuple[int, int]:
    """Multiplier and shift of a permutation of range(n)."""
    rng = np.random.default_rng([seed, n])
    a = int(rng.integers(1, max(2, min(n, 2**31))))
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1, int(rng.integers(0, n))


def mix(items: DataFrame, targets: dict[str, tuple[float, int]], p: MixParams | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).  ``items`` has doc_id, source and tokens; ``targets`` gives each source its target
    share and the most times any of its items may come.

    mixture: (shard, slot, source, doc_id, repeat, tokens), slot being the order in the shard.  report: a
    row per target source with its target, the share it was due among the sources present, and the share
    and size it reached.  Items of other or no source, without id, or of no size (null, 0) take no part;
    a repeated id is one more item.  An item that would go over a source's quota stays out, and the rest is
    filled with later items that fit; a shard holds about ``per_shard`` blocks however large the mixture is."""
    p = p or MixParams()
    spark = items.sparkSession
    if not targets:
        none = spark.createDataFrame([], "shard int, slot int, source string, doc_id long, repeat int, tokens long")
        return none, spark.createDataFrame([], "source string, targetshare double, dueshare double, share double, maxrepeats int, repeats int, items long, tokens long, due long, available long")
    wanted = items.filter(F.col("source").isin(*targets) & F.col("doc_id").isNotNull() & (F.col("tokens") > 0)).select("source", "doc_id", "tokens")
    rows = stage(wanted, "sources")
    held = {r.source: r.held for r in rows.groupBy("source").agg(F.sum("tokens").alias("held")).collect()}  # one row a target
    plan = quotas(held, targets, p.total)
    blocks = [math.ceil(q.quota / p.block) for q in plan]
    shards = max(p.shards, math.ceil(sum(blocks) / p.per_shard))
    shared = spark.sparkContext.broadcast((SplitTree(blocks, shards, p.seed), {q.source: (i, q.held, q.quota, n, *(_stride(n, p.seed + i) if n else (1, 0))) for i, (q, n) in enumerate(zip(plan, blocks))}))
    rounds = F.create_map(*(F.lit(x) for q in plan for x in (q.source, math.ceil(q.quota / q.held) if q.held else 0)))
    turns = rows.withColumn("n", rounds[F.col("source")]).filter("n > 0").select("source", "tokens", "doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("repeat"))
    dice = turns.withColumn("dice", F.xxhash64("doc_id", "repeat", F.lit(p.seed)))
    placed = ranged_positions(dice, ["source", "repeat"], [F.col("dice").asc(), F.col("doc_id").asc(), F.col("tokens").asc()], value="tokens", label="order")

    def assign(batches):
        tree, plans = shared.value
        found = lru_cache(100_000)(tree.shard_of)
        for b in batches:
            source, rep, size = np.array(b.column("source").to_pylist(), object), b.column("repeat").to_numpy(), b.column("tokens").to_numpy()
            start = b.column("running").to_numpy() - size
            shard = np.full(len(b), -2, np.int64)
            for s, (i, held, quota, n, mul, add) in plans.items():
                at = np.nonzero(source == s)[0]
                if not n or not len(at):
                    continue
                begin = start[at] + rep[at].astype(np.int64) * held
                inside = begin + size[at] <= quota
                block, back = np.unique(np.minimum(begin[inside] // p.block, n - 1), return_inverse=True)
                shard[at[inside]] = np.array([found(i, (int(x) * mul + add) % n) for x in block], np.int64)[back] if len(block) else 0
                # of what stays out, the smallest items of each magnitude may fill the rest
                out = at[~inside]
                out = out[np.lexsort((b.column("doc_id").to_numpy(zero_copy_only=False)[out], size[out]))]
                of = np.log2(size[out]).astype(int)
                shard[out[np.arange(len(out)) - np.searchsorted(of, of) < p.fill]] = -1
            ok = pa.array(shard >= -1)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), b.column("source"), b.column("doc_id"), b.column("repeat"), b.column("tokens"), b.column("dice")], names=["shard", "source", "doc_id", "repeat", "tokens", "dice"]).filter(ok)

    schema = f"shard int, source string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, repeat int, tokens long, dice long"
    first = stage(placed.mapInArrow(assign, schema), "drawn")
    taken = {r.source: r.n for r in first.filter("shard >= 0").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    # a bounded number of items of each magnitude and source
    by_size = Window.partitionBy("source", F.floor(F.log2("tokens"))).orderBy("tokens", "doc_id", "repeat")
    best = first.filter("shard = -1").withColumn("n", F.row_number().over(by_size)).filter(F.col("n") <= p.fill).collect()
    more = fill_rest({q.source: q.quota - taken.get(q.source, 0) for q in plan}, [(r.source, r.tokens, (r.dice % shards, r.source, r.doc_id, r.repeat, r.tokens, r.dice)) for r in best])
    drawn = stage(first.filter("shard >= 0").unionByName(spark.createDataFrame(more, first.schema)), "drawn") if more else first.filter("shard >= 0")
    # a shard holds a bounded number of blocks, so it may be ordered in one task
    order = Window.partitionBy("shard").orderBy(F.xxhash64("dice", "shard"), "source", "doc_id", "repeat")
    mixture = drawn.withColumn("slot", F.row_number().over(order) - 1).select("shard", "slot", "source", "doc_id", "repeat", "tokens")
    due = spark.createDataFrame([(q.source, float(q.target), float(q.share), int(q.repeats), int(q.held), int(q.quota)) for q in plan], "source string, targetshare double, dueshare double, maxrepeats int, available long, due long")
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), (F.max("repeat") + 1).alias("repeats"))
    whole = drawn.agg(F.sum("tokens")).first()[0] or 1
    none = lambda c: F.coalesce(c, F.lit(0))
    report = due.join(got, "source", "left").select(
        "source", "targetshare", F.round("dueshare", 6).alias("dueshare"), F.round(none("tokens") / whole, 6).alias("share"), "maxrepeats",
        none("repeats").alias("repeats"), none("items").alias("items"), none("tokens").alias("tokens"), "due", "available",
    )
    return mixture, report
