"""Filling containers of fixed capacity with items of varying length.

Packing looks at lengths only: the lengths that occur up to the capacity, with their counts, are a
histogram whose size the capacity bounds.  From it a plan of patterns is made (lengths that fill one
container, and how many such containers); items then find their container by their exact position
among the items of equal length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.scan import ranged_positions
from tandem.runtime import stage

Pattern = tuple[tuple[int, ...], int]


def _pair(avail: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths of at most ``most`` that add up to ``total``, the larger as large as possible."""
    hi, lo = min(most, total - 1), (total + 1) // 2
    if hi < lo:
        return None
    a = np.arange(hi, lo - 1, -1)
    ok = (avail[a] > 0) & (avail[total - a] > np.where(a * 2 == total, 1, 0))
    at = int(np.argmax(ok))
    return (int(a[at]), int(total - a[at])) if ok[at] else None


class _PairSums:
    """Sums of two available lengths as one bit set; lengths only run out, so an old set errs on the safe side."""

    def __init__(self, avail: np.ndarray):
        self.refresh(avail)

    def refresh(self, avail: np.ndarray) -> None:
        one = int.from_bytes(np.packbits(avail > 0, bitorder="little").tobytes(), "little")
        two = 0
        for a in np.nonzero(avail)[0]:
            two |= one << int(a)
        self.size = 2 * len(avail)
        raw = np.frombuffer(two.to_bytes(self.size // 8 + 2, "little"), np.uint8)
        self.bits = np.unpackbits(raw, bitorder="little")[: self.size].astype(bool)


def pack_histogram(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that place every item: ``counts[l]`` items of each length 1..capacity.

    From the longest length on, containers are completed exactly with one, two or three further
    lengths, as many at once as the counts allow; what finds no exact complement goes, longest first,
    into the open container with the least sufficient room."""
    avail = np.zeros(capacity + 1, np.int64)
    avail[: len(counts)] = counts[: capacity + 1]
    avail[0] = 0
    plan: list[Pattern] = []
    rest = np.zeros(capacity + 1, np.int64)
    sums = _PairSums(avail)

    def take(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        n = min(int(avail[l]) // k for l, k in need.items())
        for l, k in need.items():
            avail[l] -= n * k
        plan.append((lengths, n))

    def complement(anchor: int) -> tuple[int, ...] | None:
        gap = capacity - anchor
        avail[anchor] -= 1  # the anchor itself is taken
        try:
            if gap == 0:
                return ()
            if gap <= anchor and avail[gap] > 0:
                return (gap,)
            two = _pair(avail, gap, anchor)
            if two:
                return two
            for fresh in (False, True):
                a = np.arange(min(anchor, gap - 2), 0, -1)
                a = a[(avail[a] > 0) & sums.bits[gap - a]]
                if not len(a):
                    return None
                for x in a[:64] if not fresh else a:
                    avail[x] -= 1
                    two = _pair(avail, gap - int(x), int(x))
                    avail[x] += 1
                    if two:
                        return (int(x), *two)
                if not fresh:
                    sums.refresh(avail)
            return None
        finally:
            avail[anchor] += 1

    for anchor in range(capacity, 0, -1):
        while avail[anchor] > 0:
            found = complement(anchor)
            if found is None:
                rest[anchor], avail[anchor] = avail[anchor], 0
            else:
                take((anchor, *found))
    plan += _best_fit(rest, capacity)
    return plan


def _best_fit(rest: np.ndarray, capacity: int) -> list[Pattern]:
    open_: dict[int, list[Pattern]] = {}  # room left -> containers with it
    room = np.zeros(capacity + 1, bool)

    def put(left: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            open_.setdefault(left, []).append((lengths, n))
            room[left] = True

    for length in range(capacity, 0, -1):
        todo = int(rest[length])
        while todo:
            fits = np.nonzero(room[length:])[0]
            if not len(fits):
                break
            left = length + int(fits[0])
            lengths, n = open_[left].pop()
            if not open_[left]:
                room[left] = False
            used = min(n, todo)
            put(left, lengths, n - used)
            put(left - length, (*lengths, length), used)
            todo -= used
        each = capacity // length
        put(capacity - each * length, (length,) * each, todo // each)
        if todo % each:
            put(capacity - (todo % each) * length, (length,) * (todo % each), 1)
    return [p for held in open_.values() for p in held]


@dataclass(frozen=True)
class _Plan:
    """For each length the first positions of its stretches, with their first container and share per container."""

    starts: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    share: dict[int, np.ndarray]
    containers: int


def _lay_out(patterns: list[Pattern]) -> _Plan:
    used: Counter[int] = Counter()
    cols: dict[int, list[tuple[int, int, int]]] = {}
    at = 0
    for lengths, n in patterns:
        for length, k in sorted(Counter(lengths).items()):
            cols.setdefault(length, []).append((used[length], at, k))
            used[length] += n * k
        at += n
    pick = lambda i: {l: np.array([c[i] for c in v], np.int64) for l, v in cols.items()}
    return _Plan(pick(0), pick(1), pick(2), at)


def pack(items: DataFrame, capacities: dict[int, int], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(budgetid, containerid, id, piece, size): every item's place for each budget (id: capacity).

    An item longer than the capacity is cut into full pieces, which fill a container each, and a rest
    that is packed like an item (``piece`` counts from 0; whole items have piece 0).  Items of size 0 or
    null need no room and give no row, as do rows without id; a repeated id is one more item.
    Containers of a budget are numbered from 0 without holes."""
    spark = items.sparkSession
    if not capacities:
        return spark.createDataFrame([], "budgetid int, containerid long, doc_id long, piece long, size long")
    rows = items.filter(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).select(F.col(id_col).alias("doc_id"), F.col(size_col).cast("long").alias("size"))
    # the budgets are a fixed, small list of capacities
    budgets = F.array(*(F.struct(F.lit(int(b)).alias("budgetid"), F.lit(int(c)).cast("long").alias("cap")) for b, c in sorted(capacities.items())))
    each = rows.select("doc_id", "size", F.inline(budgets)).withColumn("full", F.floor(F.col("size") / F.col("cap"))).withColumn("len", F.col("size") % F.col("cap"))
    each = each.select("budgetid", "cap", "doc_id", F.when(F.col("len") == 0, F.col("full") - 1).otherwise(F.col("full")).alias("full"), F.when(F.col("len") == 0, F.col("cap")).otherwise(F.col("len")).alias("len"))
    items_ = stage(each, "items")
    hist = items_.groupBy("budgetid", "len").count().toPandas()  # bounded by the capacities
    plans: dict[int, _Plan] = {}
    for b, cap in capacities.items():
        own = hist[hist.budgetid == b]
        counts = np.zeros(cap + 1, np.int64)
        counts[own.len.to_numpy()] = own["count"].to_numpy()
        plans[b] = _lay_out(pack_histogram(counts, cap))
    shared = spark.sparkContext.broadcast(plans)
    placed = ranged_positions(items_.select("budgetid", "len", "doc_id", "full"), ["budgetid", "len"], [F.col("doc_id").asc()], label="lengths")

    def locate(batches):
        for batch in batches:
            b, length, pos = (batch.column(c).to_numpy() for c in ("budgetid", "len", "position"))
            out = np.zeros(len(batch), np.int64)
            order = np.lexsort((length, b))
            cut = np.nonzero(np.concatenate([[True], (b[order][1:] != b[order][:-1]) | (length[order][1:] != length[order][:-1])]))[0] if len(batch) else []
            for s, e in zip(cut, [*cut[1:], len(batch)]):
                at = order[s:e]
                plan, l = shared.value[int(b[at[0]])], int(length[at[0]])
                k = np.searchsorted(plan.starts[l], pos[at] - 1, side="right") - 1
                out[at] = plan.base[l][k] + (pos[at] - 1 - plan.starts[l][k]) // plan.share[l][k]
            yield pa.RecordBatch.from_arrays([batch.column("budgetid"), pa.array(out), batch.column("doc_id"), batch.column("full"), batch.column("len")], names=["budgetid", "containerid", "doc_id", "piece", "size"])

    schema = f"budgetid int, containerid long, doc_id {items_.schema['doc_id'].dataType.simpleString()}, piece long, size long"
    ends = placed.select("budgetid", "len", "doc_id", "full", "position").mapInArrow(locate, schema)
    # the full pieces of long items, each a container of its own, numbered after the packed ones
    long_ = ranged_positions(items_.filter("full > 0").select("budgetid", "cap", "doc_id", "full"), ["budgetid"], [F.col("doc_id").asc()], value="full", label="pieces")
    first = F.create_map(*(F.lit(x) for b, p in plans.items() for x in (int(b), p.containers)))
    cut = long_.select("budgetid", "cap", "doc_id", "full", "running", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    pieces = cut.select("budgetid", (first[F.col("budgetid")].cast("long") + F.col("running") - F.col("full") + F.col("piece")).alias("containerid"), "doc_id", "piece", F.col("cap").alias("size"))
    return ends.unionByName(pieces)


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(budgetid, containers, items, size, fill): how full the containers are; ``fill`` is between 0 and 1."""
    cap = F.create_map(*(F.lit(int(x)) for kv in capacities.items() for x in kv))
    whole = packed.groupBy("budgetid").agg((F.max("containerid") + 1).alias("containers"), F.count("*").alias("items"), F.sum("size").alias("size"))
    return whole.withColumn("fill", F.round(F.col("size") / (F.col("containers") * cap[F.col("budgetid")]), 6))
