"""The k most similar vectors of every vector, by sharded robust-pruned graphs.

Equal vectors share a class.  Class vectors are cut into shards around centroids of a bounded
sample, and shards that are still large around centroids of their own, as often as it takes.  Each
shard builds its graph over projected vectors and beam-searches the vectors it is the nearest shard
of, or nearly the nearest; survivors are re-ranked with exact double cosine.  A pair that one end's
search finds counts for both ends.  Shards are searched in waves: copies of the vectors are only on disk
for the shards of one wave.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import graph as G
from tandem.operators.scan import ranged_positions
from tandem.runtime import heavy_groups, release, stage, stored_bytes, tidy

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")


@dataclass(frozen=True)
class NeighbourParams:
    """k: neighbours wanted; limit: least cosine; dims: projected size of the graphs; cell: vectors aimed at
    per shard; largest: shards of more than so many times that are split again; margin: a vector also asks
    the next nearest shards, ``probes`` in all, whose centroids are less than this much less similar;
    most_cells: bound of one centroid table; sample, local: bounds of the vectors that the first and all further tables are fitted
    on; chunk: queries handled by one task; refine: candidates per neighbour kept that are re-ranked
    exactly; slack: by how much a projected cosine may be below the limit for that; wave: copies of vectors that
    are sent to shards at a time, or a quarter as many as there are vectors, if that is more.  The index holds every
    vector; what margin, probes, refine and slack cost is in the recall, which ``recall`` measures."""

    size: int = 512
    k: int = 5
    limit: float = 0.8
    dims: int = 64
    cell: int = 1500
    largest: float = 4.0
    margin: float = 0.2
    probes: int = 4
    most_cells: int = 8192
    sample: int = 16384
    local: int = 4096
    rounds: int = 6
    chunk: int = 16384
    refine: int = 4
    slack: float = 0.35
    wave: int = 65536
    seed: int = 5
    graph: G.GraphParams = field(default_factory=G.GraphParams)


def usable(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(id, vec) of rows with an id and a vector of exactly ``size`` finite values, not all zero."""
    finite = F.forall(vec_col, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v))
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == size) & finite & F.exists(vec_col, lambda v: v != 0)
    return df.filter(F.col(id_col).isNotNull()).filter(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def _projection(p: NeighbourParams) -> np.ndarray:
    return (np.random.default_rng(p.seed).standard_normal((p.size, p.dims)) / math.sqrt(p.dims)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest value first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(x: np.ndarray) -> pa.Array:
    """Each row's floats as bytes, the upper halves first and the lower ones only where one is not 0, so that vectors
    of short floats take half the room."""
    n, size = x.shape
    halves = np.ascontiguousarray(x, np.dtype("<f4")).view("<u2").reshape(n, size, 2)
    whole = np.concatenate([halves[:, :, 1], halves[:, :, 0]], 1).view(np.uint8)
    ends = np.where(halves[:, :, 0].any(1), 4 * size, 2 * size)
    data = whole[np.arange(4 * size) < ends[:, None]]
    offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(col: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """The floats that ``_packed`` was given, row by row."""
    parts = []
    for c in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            data = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            halves = np.zeros((len(c), 4 * size), np.uint8)
            halves[np.arange(4 * size) < np.diff(offsets)[:, None]] = data
            halves = halves.view("<u2").reshape(len(c), 2, size)
            parts.append(np.ascontiguousarray(halves[:, ::-1].transpose(0, 2, 1)).reshape(len(c), -1).view("<f4"))
    return np.concatenate(parts) if parts else np.zeros((0, size), np.float32)


def _project(x: np.ndarray, proj: np.ndarray) -> np.ndarray:
    y = _unit(x).astype(np.float32) @ proj
    return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)


def _sample(reps: DataFrame, p: NeighbourParams) -> np.ndarray:
    """A bounded, repeatable sample of class vectors at length 1: the smallest hashes of their ids."""
    # ids are sorted alone: every task would send its own first vectors, which are all of them
    first = reps.select("cid", F.xxhash64("cid").alias("h")).distinct().orderBy("h", "cid").limit(p.sample)
    rows = reps.join(F.broadcast(first), "cid").select("h", "cid", "vec").toArrow().sort_by([("h", "ascending"), ("cid", "ascending")])
    return _unit(_matrix(rows.column("vec").combine_chunks()[: p.sample], p.size)).astype(np.float32)


def _centroids(sample: np.ndarray, cells: int, p: NeighbourParams) -> np.ndarray:
    cells = min(cells, len(sample))
    rng = np.random.default_rng(p.seed)
    c = sample[np.sort(rng.permutation(len(sample))[:cells])].copy()
    for _ in range(p.rounds if cells > 1 else 0):
        home = np.concatenate([np.argmax(sample[a : a + 2048] @ c.T, axis=1) for a in range(0, len(sample), 2048)])
        order = np.argsort(home, kind="stable")
        present, start = np.unique(home[order], return_index=True)
        c[present] = np.add.reduceat(sample[order], start, axis=0)
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def _closest(vecs: np.ndarray, cent: np.ndarray, p: NeighbourParams) -> tuple[np.ndarray, np.ndarray]:
    """(the ``probes`` nearest centroids, nearest first; which of them are to be asked) of each vector."""
    s = _unit(vecs).astype(np.float32) @ cent.T
    n = min(p.probes, s.shape[1])
    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    sims = np.take_along_axis(s, near, 1)
    ask = sims > sims[:, :1] - p.margin
    ask[:, 0] = True
    return near, ask


DEALT = "shard long, cid long, held boolean, asks boolean, vec binary"
#: Shards of one split at most; a shard's number is its parent's times this, plus its own from 1.
SPLIT = 1024


def _emit(base, cid: pa.Array, held, asks, vecs: np.ndarray, cent: np.ndarray, p: NeighbourParams):
    """Rows for the nearest shard, and as a query only for the others that are asked."""
    for at in range(0, len(vecs), 2048):
        cut = slice(at, at + 2048)
        near, ask = _closest(vecs[cut], cent, p)
        row, place = np.nonzero(ask[:, 1:] & asks[cut][:, None])
        idx = pa.array(np.concatenate([np.arange(len(near)), row]))
        shard = base + np.concatenate([near[:, 0], near[row, place + 1]]).astype(np.int64)
        none = np.zeros(len(row), bool)
        yield pa.RecordBatch.from_arrays([pa.array(shard), cid.slice(at, 2048).take(idx), pa.array(np.concatenate([held[cut], none])), pa.array(np.concatenate([asks[cut], ~none])), _packed(vecs[cut]).take(idx)], names=["shard", "cid", "held", "asks", "vec"])


def _split(rows: DataFrame, sizes: DataFrame, p: NeighbourParams) -> DataFrame:
    """The rows (as ``DEALT``) of shards that are too large, dealt to shards of their own around centroids fitted on a
    bounded sample of each.  ``sizes``: shard, home, total."""
    near_first = Window.partitionBy("shard").orderBy(F.xxhash64("cid"), "cid")
    sample = rows.filter("held").withColumn("n", F.row_number().over(near_first)).filter(F.col("n") <= p.local).join(sizes, "shard").select("shard", "home", "vec")

    def fit(t: pa.Table) -> pa.Table:
        x = _unit(_unpacked(t.column("vec"), p.size)).astype(np.float32)
        cells = max(2, min(SPLIT - 1, len(x) // 4, math.ceil(t.column("home")[0].as_py() / p.cell)))
        c = _centroids(x, cells, p)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()] * len(c), pa.int64()), "sub": pa.array(np.arange(len(c)), pa.int64()), "vec": pa.array(list(c), pa.list_(pa.float32()))})

    cents = stage(heavy_groups(sample, "shard").applyInArrow(fit, "shard long, sub long, vec array<float>"), "centroids")
    parts = sizes.select("shard", F.ceil(F.col("total") / p.chunk).cast("int").alias("parts"))
    left = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts")
    right = cents.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sub", "vec")

    def deal(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.schema([("shard", pa.int64()), ("cid", pa.int64()), ("held", pa.bool_()), ("asks", pa.bool_()), ("vec", pa.binary())]).empty_table()
        if not len(a):
            return none
        b = b.sort_by("sub")
        cent = _matrix(b.column("vec").combine_chunks(), p.size)
        held, asks = a.column("held").to_numpy(), a.column("asks").to_numpy()
        base = a.column("shard")[0].as_py() * SPLIT + 1
        return pa.Table.from_batches(list(_emit(base, a.column("cid").combine_chunks(), held, asks, _unpacked(a.column("vec"), p.size), cent, p)))

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(deal, DEALT)


def _waves(asked: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges (first, end) of consecutive shards that ``most`` copies go to at a time; a larger shard is one of its own."""
    out, first, held = [], 0, 0
    for shard, n in enumerate(asked.tolist()):
        if held and held + n > most:
            out, first, held = [*out, (first, shard)], shard, 0
        held += n
    return [*out, (first, len(asked))] if held else out


def class_neighbours(reps: DataFrame, p: NeighbourParams) -> DataFrame:
    """(cid, nid, sim): for every class its most similar other classes among those its shards hold.

    ``reps`` is a staged table, which is deleted once its vectors have their shards."""
    spark = reps.sparkSession
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "cid long, nid long, sim double")
    cells = int(min(p.most_cells, max(1, math.ceil(n / p.cell))))
    # the centroid table has at most most_cells vectors (16 MB)
    shared = spark.sparkContext.broadcast(_centroids(_sample(reps, p), cells, p))

    def place(batches):
        """The shards that each vector asks, its own first."""
        for b in batches:
            for at in range(0, len(b), 2048):
                cut = b.slice(at, 2048)
                near, ask = _closest(_matrix(cut.column(1), p.size), shared.value, p)
                ends = np.concatenate([[0], np.cumsum(ask.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(near[ask].astype(np.int32))), cut.column(1)], names=["cid", "shards", "vec"])

    placed = stage(reps.select("cid", "vec").mapInArrow(place, "cid long, shards array<int>, vec array<float>"), "placed")
    release(reps)
    tidy(spark)
    counted = placed.select(F.posexplode("shards")).groupBy("col").agg(F.count_if(F.col("pos") == 0).alias("home"), F.count("*").alias("asked"))
    # one row a shard, at most most_cells
    sizes = stage(counted.select(F.col("col").cast("long").alias("shard"), "home", "asked"), "sizes")
    asked = np.zeros(cells, np.int64)
    for r in sizes.collect():
        asked[r.shard] = r.asked
    ways: list[DataFrame] = []
    for first, end in _waves(asked, max(p.wave, n // 4)):
        kept = [sizes.filter(F.col("shard").between(first, end - 1))]
        ways.append(stage(_search(placed, first, end, kept, p), "ways"))
        release(*kept[1:])
        kept.clear()
        tidy(spark)
    release(placed, sizes)
    found = ways[0]
    for part in ways[1:]:
        found = found.unionByName(part)
    return found


def _search(placed: DataFrame, first: int, end: int, kept: list[DataFrame], p: NeighbourParams) -> DataFrame:
    """(cid, nid, sim) of the shards from ``first`` to before ``end``.  ``kept``: the sizes of these shards; gets what is staged."""

    def deal(batches):
        for b in batches:
            for at in range(0, len(b), 2048):
                cut = b.slice(at, 2048)
                shards = cut.column(1)
                flat, count = shards.flatten().to_numpy(), pa.compute.list_value_length(shards).to_numpy()
                row, place = np.repeat(np.arange(len(cut)), count), np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
                here = (flat >= first) & (flat < end)
                idx = pa.array(row[here])
                yield pa.RecordBatch.from_arrays([pa.array(flat[here].astype(np.int64)), cut.column(0).take(idx), pa.array(place[here] == 0), pa.array(np.ones(len(idx), bool)), _packed(_matrix(cut.column(2), p.size)).take(idx)], names=["shard", "cid", "held", "asks", "vec"])

    rows = placed.filter(F.exists("shards", lambda s: (s >= first) & (s < end))).select("cid", "shards", "vec").mapInArrow(deal, DEALT)
    sizes, done = kept[0], []
    large = F.col("home") > p.largest * p.cell
    while sizes.filter(large).limit(1).count():
        big = sizes.filter(large).select("shard", "home", F.col("asked").alias("total"))
        done.append(rows.join(F.broadcast(big), "shard", "left_anti").select("shard", "cid", "held", "asks", "vec"))
        whole = stage(rows.join(F.broadcast(big.select("shard")), "shard", "left_semi"), "dealt")
        rows = stage(_split(whole, big, p), "dealt")
        release(whole)
        tidy(rows.sparkSession)
        sizes = stage(rows.groupBy("shard").agg(F.count_if("held").alias("home"), F.count_if("asks").alias("asked")), "sizes")
        kept += [rows, sizes]
    for part in done:
        rows = rows.unionByName(part)
    # a shard that very many vectors ask is searched by several tasks, each with the whole shard and its own queries
    if sizes.filter(F.col("asked") > p.chunk).limit(1).count() or done:
        asked = rows.groupBy("shard").agg(F.ceil(F.count_if("asks") / p.chunk).cast("int").alias("chunks")).filter("chunks > 1")
        own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
        split = rows.join(asked, "shard", "left").withColumn("chunk", F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(F.col("held"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own)))
        mine = F.col("chunks").isNull() | (F.col("chunk") == own)
        rows = split.withColumn("chunk", F.explode("chunk")).select((F.col("shard") * SPLIT + F.col("chunk")).alias("shard"), "cid", "held", (F.col("asks") & mine).alias("asks"), "vec")
    out = T.StructType([T.StructField("cid", T.LongType()), T.StructField("nid", T.LongType()), T.StructField("sim", T.DoubleType())])
    return heavy_groups(rows, "shard").applyInArrow(_search_shard(p), out)


def _search_shard(p: NeighbourParams):
    proj, keep = _projection(p), p.k + 3

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        get = lambda name: t.column(name).to_numpy()
        cid, held, asks = get("cid"), get("held"), get("asks")
        order = np.argsort(cid, kind="stable")
        vecs = _unpacked(t.column("vec"), p.size)
        cid, held, asks, vecs = cid[order], held[order], asks[order], vecs[order]
        mine = np.nonzero(held)[0]
        empty = pa.table({"cid": pa.array([], pa.int64()), "nid": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        if len(mine) == 0:
            return empty
        x, names = _project(vecs[mine], proj), cid[mine]
        g, entries = G.build(x, p.graph, p.seed)
        exact = _unit(vecs[mine])
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        quest = np.nonzero(asks)[0]
        for at in range(0, len(quest), 512):
            rows = quest[at : at + 512]
            ids, approx = G.beam_search(x, g, entries, _project(vecs[rows], proj), p.graph.beam, p.graph.expand)
            ids = ids[:, : p.refine * keep]
            q = _unit(vecs[rows])
            r, c = np.nonzero((ids >= 0) & (names[ids] != cid[rows][:, None]) & (approx[:, : ids.shape[1]] >= p.limit - p.slack))
            # exact cosines of the likely candidates only, in blocks
            sims = np.concatenate([np.einsum("ij,ij->i", q[r[a : a + 4096]], exact[ids[r, c][a : a + 4096]]) for a in range(0, len(r), 4096)]) if len(r) else np.zeros(0)
            sims = np.round(sims, 6)
            good = sims >= p.limit
            got.append((cid[rows][r[good]], names[ids[r, c][good]], sims[good]))
        if not got:
            return empty
        a, b, s = (np.concatenate(z) for z in zip(*got))
        rank = np.lexsort((b, -s, a))
        a, b, s = a[rank], b[rank], s[rank]
        start = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(start, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
        top = place < keep
        return pa.table({"cid": a[top], "nid": b[top], "sim": s[top]})

    return run


#: Bytes of a stored table of keys that is sent to every executor at most.
SENT = 16_000_000


def nearest(df: DataFrame, id_col: str, vec_col: str, p: NeighbourParams | None = None) -> DataFrame:
    """(id, neighbour, sim): for every usable vector its up to ``k`` most similar others, cosine in double
    rounded to 6 decimals and at least ``limit``, equal ones by smaller id.

    Null, short, long, non-finite and all-zero vectors and rows without id take no part.  Repeated rows
    count once.  Equal vectors are handled as one class, so a group of copies of any size costs one
    search; of its members only the ``k`` + 1 smallest ids can be anyone's neighbour."""
    p = p or NeighbourParams()
    rows = usable(df, id_col, vec_col, p.size).withColumn("ka", F.xxhash64("vec")).withColumn("kb", F.xxhash64(F.lit(1), F.col("vec")))
    keyed = stage(rows.select("ka", "kb", "id"), "keys")
    named = stage(keyed.groupBy("ka", "kb").agg(F.min("id").alias("cid"), F.count("*").alias("n")), "classes")
    # Vectors that come once go on as they are; only repeated ones are shuffled, one row per map task.  The table
    # of repeated keys has a known size, by which the planner broadcasts or shuffles it.
    many = stage(named.filter("n > 1").select("ka", "kb"), "repeated")
    # up to a million keys or so go to every executor, so that vectors aren't shuffled for them
    dealt = F.broadcast(many) if stored_bytes(many) <= SENT else many
    single = rows.join(dealt, ["ka", "kb"], "left_anti").select(F.col("id").alias("cid"), "vec")
    merged = rows.join(dealt, ["ka", "kb"], "left_semi").groupBy("ka", "kb").agg(F.min("id").alias("cid"), F.first("vec").alias("vec")).select("cid", "vec")
    reps = stage(single.unionByName(merged), "vectors")
    few = ranged_positions(keyed.join(many, ["ka", "kb"], "left_semi"), ["ka", "kb"], [F.col("id").asc()], copies=["ka", "kb", "id"], keep=p.k + 1, label="copies")
    twins = few.join(named, ["ka", "kb"]).select("cid", F.col("id").alias("member"))
    heads = stage(named.filter("n = 1").select("cid", F.col("cid").alias("member")).unionByName(twins), "heads")
    ways = class_neighbours(reps.select("cid", "vec"), p)
    # what one end's search finds holds for the other end as well; a class that many find keeps its best ones only
    either = ways.unionByName(ways.select(F.col("nid").alias("cid"), F.col("cid").alias("nid"), "sim")).distinct()
    best_first = Window.partitionBy("cid").orderBy(F.col("sim").desc(), "nid")
    links = either.withColumn("n", F.row_number().over(best_first)).filter(F.col("n") <= p.k + 1).drop("n")
    # each class's list: members of the near classes and, at similarity 1, of its own if it has several
    shared = heads.groupBy("cid").agg(F.count("*").alias("k")).filter("k > 1").select("cid")
    near = links.join(heads.withColumnRenamed("cid", "nid"), "nid").select("cid", "member", "sim")
    own = heads.join(shared, "cid").select("cid", "member", F.lit(1.0).alias("sim"))
    # shards, probes and k bound the list of a class, whatever the size of the data
    ranked = near.unionByName(own).groupBy("cid").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("s"), "member"))), 1, p.k + 1).alias("best"))
    members = keyed.distinct().join(named, ["ka", "kb"]).select("id", "cid")
    mine = members.join(ranked, "cid").select("id", F.slice(F.filter("best", lambda b: b["member"] != F.col("id")), 1, p.k).alias("best"))
    return mine.select("id", F.inline("best")).select("id", F.col("member").alias("neighbour"), (-F.col("s")).alias("sim"))


def recall(df: DataFrame, id_col: str, vec_col: str, every: int = 100, p: NeighbourParams | None = None, block: int = 2048) -> DataFrame:
    """One row (queries, wanted, found, recall): the operator against brute force, for all rows whose id is
    divisible by ``every`` as queries, against all rows.

    Queries are cut into blocks and rows into parts; a task multiplies one block with one part and keeps the k
    best of each query, so neither side and no list of neighbours is ever in one place."""
    p = p or NeighbourParams()
    rows = stage(usable(df, id_col, vec_col, p.size).dropDuplicates(["id"]), "exact")
    total = rows.count()
    asked = rows.filter(F.col("id") % every == 0)
    queries = asked.count()
    blocks, parts = max(1, math.ceil(queries / block)), max(1, math.ceil(total / (4 * block)))
    spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).withColumn("part", spread_over(parts))
    right = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).withColumn("block", spread_over(blocks))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        b = b.sort_by("id")
        qid, bid = a.column("id").to_numpy(), b.column("id").to_numpy()
        s = np.round(_unit(_matrix(a.column("vec").combine_chunks(), p.size)) @ _unit(_matrix(b.column("vec").combine_chunks(), p.size)).T, 6)
        s[qid[:, None] == bid[None, :]] = -9
        top = np.argsort(-s, axis=1, kind="stable")[:, : p.k]
        sim = np.take_along_axis(s, top, 1)
        r, c = np.nonzero(sim >= p.limit)
        return pa.table({"id": qid[r], "neighbour": bid[top[r, c]], "sim": sim[r, c]})

    truth = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(best, "id long, neighbour long, sim double")
    order = Window.partitionBy("id").orderBy(F.col("sim").desc(), "neighbour")
    wanted = truth.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= p.k).select("id", "neighbour")
    found = nearest(df, id_col, vec_col, p).select("id", "neighbour", F.lit(1).alias("hit"))
    joined = wanted.join(found, ["id", "neighbour"], "left")
    return joined.agg(F.lit(queries).cast("long").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.try_divide(F.count("hit"), F.count("*")), 4).alias("recall"))
