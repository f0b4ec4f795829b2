"""Exact positions and running sums inside groups of any size, without a task per group.

Rows are range-partitioned and sorted on (group, order), so a huge group spreads over many
partitions.  One streaming pass numbers the rows of each (partition, group); the totals of the
groups that touch a partition border - at most two rows a partition - are prefix-summed and
added to the first group of the following partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.runtime import shuffle_partitions, stage

MARKS = (("pid", T.IntegerType()), ("local", T.LongType()), ("run", T.LongType()), ("head", T.BooleanType()), ("tail", T.BooleanType()), ("open", T.BooleanType()))


def _differs(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """For rows 1.. of the batch: does any of the columns differ from the row before."""
    out = np.zeros(max(len(batch) - 1, 0), bool)
    for name in names:
        col = batch.column(name)
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        ne = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= ne | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def _number(group: list[str], copies: list[str], value: str | None, keep: int | None, tag: str):
    """The streaming pass.  A row is held back until the next is known, so that the last row of each
    group can be marked; the row in hand travels in front of the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        local = total = 0
        first_group = True

        def emit(batch: pa.RecordBatch, breaks: np.ndarray, last: bool):
            """breaks[i]: row i+1 begins a new group; the rows come with held's counters before row 0."""
            nonlocal local, total, first_group
            n = len(batch)
            begin = np.concatenate([[local == 0], breaks])[:n]
            vals = np.ones(n, np.int64) if value is None else pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            gid = np.cumsum(begin) - begin[0]
            starts = np.nonzero(np.concatenate([[True], begin[1:]]))[0]
            pos = np.arange(n) - starts[gid] + 1
            cum = np.cumsum(vals)
            run_ = cum - np.concatenate([[0], cum])[starts][gid]
            pos[gid == 0] += local
            run_[gid == 0] += total
            head = np.full(n, first_group) & (gid == 0)
            tail = np.concatenate([breaks, [last]])[:n].astype(bool)
            ends = bool(tail[-1])
            if (gid[-1] > 0 or ends) and first_group:
                first_group = False
            local, total = (0, 0) if ends else (int(pos[-1]), int(run_[-1]))
            opened = np.zeros(n, bool)
            if last:
                opened[gid == gid[-1]] = True
            cols = [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(pos.astype(np.int64)), pa.array(run_.astype(np.int64)), pa.array(head), pa.array(tail), pa.array(opened)]
            out = pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *(tag + m for m, _ in MARKS)])
            if keep is not None:
                out = out.filter(pa.array((pos <= keep) | tail))
            return out

        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if copies:
                same = ~_differs(batch, copies)
                if same.any():
                    batch = batch.filter(pa.array(np.concatenate([[True], ~same])))
            breaks = _differs(batch, group)
            if len(batch) > 1:
                yield emit(batch.slice(0, len(batch) - 1), breaks, False)
            held = batch.slice(len(batch) - 1)
        if held is not None:
            yield emit(held, np.zeros(0, bool), True)

    return run


def ranged_positions(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    *,
    value: str | None = None,
    copies: list[str] | None = None,
    keep: int | None = None,
    label: str = "positions",
) -> DataFrame:
    """``df`` with ``position`` (1-based, in ``order`` inside ``group``) and, with ``value`` (a whole
    number, null counts as 0), ``running`` (the sum up to and with the row).

    ``copies``: columns; adjacent rows equal in all of them count as one, so ``order`` must bring
    copies together.  ``keep``: only positions up to it come out.  Nulls in the group form a group.
    Columns of the input that are called ``position`` or ``running`` are replaced; all others stay."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    df = df.drop(*(c for c in ("position", "running") if c in df.columns and c not in group and c != value))
    tag = "_"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag += "_"
    keys = [*(F.col(c).asc_nulls_first() for c in group), *order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, *(T.StructField(tag + m, t) for m, t in MARKS)])
    passed = stage(ranged.mapInArrow(_number(group, copies or [], value, keep, tag), schema), label)
    mark = lambda m: F.col(tag + m)
    # Groups that end inside their partition and begin there need nothing.  A partition's last group
    # is open: it may go on in the next one.  Its total is added to the head group of later partitions.
    border = passed.filter(mark("tail") & (mark("head") | mark("open"))).select(*group, *(mark(m) for m in ("pid", "local", "run", "head")))
    before = Window.partitionBy(*group).orderBy(mark("pid")).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        border.select(mark("pid").alias(tag + "hpid"), mark("head"), F.sum(mark("local")).over(before).alias(tag + "local0"), F.sum(mark("run")).over(before).alias(tag + "run0"))
        .filter(mark("head") & mark("local0").isNotNull())
        .drop(tag + "head")
    )
    # at most one row a partition, so the broadcast is bounded by the number of partitions
    joined = passed.join(F.broadcast(shift), mark("head") & (mark("pid") == mark("hpid")), "left")
    out = joined.withColumn("position", mark("local") + F.coalesce(mark("local0"), F.lit(0)))
    if keep is not None:
        out = out.filter(F.col("position") <= keep)
    names = [*(F.col(f"`{c}`") for c in df.columns), "position"]
    if value is not None:
        out = out.withColumn("running", mark("run") + F.coalesce(mark("run0"), F.lit(0)))
        names.append("running")
    return out.select(*names)
