"""The whole pair kernel over all pairs of a scope, in tiles, fused with pool selection.

The column expressions of ``functions.kernels`` score a table of given pairs.  Here the pairs do not
exist as rows: a tile multiplies two blocks of images out in numpy, scores them with the same formulas,
and returns only the edges that some pool of one of their ends could still admit.  The best of the
tiles' best are the best of all, so the pools over the returned edges are exact."""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import clusters, vocab
from tandem.functions.text import filename_bases
from tandem.runtime import heavy_groups, release, stage, tidy

NAMES = sorted(vocab.CLUSTER_WEIGHTS)
OUT = "a long, b long, aesthetic double, geometric double, thematic double, composite double, aestheticmode string, geometricmode string, flipped boolean"
SCALARS = ("date", "gaze", "hue", "sat", "x", "y")


def prepare(images: DataFrame, vocabulary, *keep: str) -> DataFrame:
    """Adds what a tile needs per image once: fired clusters as flags, hashed base forms of the file name.

    ``images``: id, scope, clip, hist, palette, edge, grid, date, filename, caption, bw, gaze, hue, sat, x, y."""
    # the clusters stay a column of their own: used once inside a lambda they would be worked out per element
    images = images.withColumn("cl", clusters.caption_clusters(F.col("caption"), vocabulary))
    flags = F.transform(F.array(*map(F.lit, NAMES)), lambda n: F.array_contains("cl", n).cast("double"))
    bases = F.transform(F.when(F.col("filename") != "", filename_bases(F.col("filename"))).otherwise(F.array().cast("array<string>")), lambda s: F.xxhash64(s))
    four = F.slice(F.concat(bases, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: -F.col("id") * 8 - i)), 1, 4)
    return images.select(
        "id", "scope", *(F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("clip", "hist", "palette", "edge", "grid")), *(F.col(c).cast("double").alias(c) for c in SCALARS),
        F.coalesce("bw", F.lit(False)).alias("bw"), (F.coalesce("caption", F.lit("")) != "").alias("captioned"), flags.alias("flags"), four.alias("bases"), F.xxhash64(F.lower("filename")).alias("name"), "cl", *keep,
    )


class Block:
    """One block's columns as arrays, with the per-image parts of the kernels."""

    def __init__(self, t: pa.Table, rows: np.ndarray):
        part = t.take(pa.array(rows))
        wide = lambda c: part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        self.id = part.column("id").to_numpy()
        self.clip, self.hist, self.palette, self.edge, self.grid, self.flags, self.bases = map(wide, ("clip", "hist", "palette", "edge", "grid", "flags", "bases"))
        for c in SCALARS:
            setattr(self, c, part.column(c).to_numpy(zero_copy_only=False).astype(np.float64))
        self.bw, self.captioned = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("bw", "captioned"))
        self.name = part.column("name").to_numpy()
        self.peak = np.minimum(self.edge.max(1) * 32 / 4.0, 1.0)
        self.var = np.minimum(self.grid[:, :16].std(1) / 0.20, 1.0)
        # rows with the same flags: the first of each kind, and each row's kind
        _, self.kinds, self.kind = np.unique(self.flags @ 2.0 ** np.arange(self.flags.shape[1]), return_index=True, return_inverse=True)
        self.fold = (self.edge.argmax(1) % 16).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum of the 36 distances between the six colours of each row of ``p`` and of each of ``q``."""
    total, room = np.zeros((len(p), len(q))), np.empty((len(p), len(q)))
    one = lambda m: np.ones((len(m), 1))
    square = lambda m: (m * m).sum(1, keepdims=True)
    others = [np.ascontiguousarray(np.hstack([y, one(y), square(y)]).T) for y in (q[:, j : j + 3] for j in range(0, 18, 3))]
    for i in range(0, 18, 3):
        x = p[:, i : i + 3]
        left = np.hstack([-2 * x, square(x), one(x)])
        for j, right in enumerate(others):
            np.matmul(left, right, out=room)
            if room.min() < 1:  # near colours, where the difference of the squares is not exact
                a, b = np.nonzero(room < 1)
                room[a, b] = ((x[a] - q[b, 3 * j : 3 * j + 3]) ** 2).sum(1)
            total += np.sqrt(room, out=room)
    return total


def _themes(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dice or axis bonus of every row of flags in ``p`` with every one in ``q``."""
    c, r = (lambda v: v[:, None]), (lambda v: v[None, :])
    w = np.array([vocab.CLUSTER_WEIGHTS[n] for n in NAMES])
    strong = (w >= vocab.MEANINGFUL).astype(float)
    shared, meaningful = (p * w) @ q.T, (p * strong) @ q.T
    lopsided = (c(p @ strong) - meaningful < 0.5) | (r(q @ strong) - meaningful < 0.5)
    total = c(p @ w) + r(q @ w)
    dice = np.where(meaningful < 0.5, 0.1, 2 * shared / np.where(total > 0, total, 1))
    full = shared > 5.0
    score = np.where(full | lopsided, 0.0, dice)
    bonus = np.zeros_like(score)
    at = {n: i for i, n in enumerate(NAMES)}
    for x, y, v in vocab.AXIS_PAIRS:
        i, j = at[x], at[y]
        meets = (c(p[:, i]) * r(q[:, j]) + c(p[:, j]) * r(q[:, i])) > 0
        bonus = np.where(meets, np.maximum(bonus, v), bonus)
    return score + np.where(full | (score > 0.10), 0.0, bonus)


def score_tile(p: Block, q: Block, weights=(0.4, 0.2, 0.4)) -> dict[str, np.ndarray]:
    """All score matrices of two blocks; ``p`` has the rows."""
    c, r = (lambda v: v[:, None]), (lambda v: v[None, :])
    clip = (p.clip @ q.clip.T + 1) / 2
    harmony, room = np.zeros_like(clip), np.empty_like(clip)
    for x, y in zip(np.ascontiguousarray(p.hist.T), np.ascontiguousarray(q.hist.T)):
        harmony += np.minimum(c(x), y, out=room)
    contrast = np.minimum(_distances(p.palette, q.palette) / 36 / 100, 1)
    cos = lambda m, n: np.clip((_unit(m) @ _unit(n).T + 1) / 2, 0, 1)
    edge, grid = cos(p.edge, q.edge), cos(p.grid, q.grid)
    # aesthetic
    gap = np.abs(c(p.hue) - r(q.hue))
    gap = np.minimum(gap, 360 - gap)
    hue = np.clip((30 - gap) / 20, 0, 1)
    warm = c((p.hue >= 15) & (p.hue <= 35)) | r((q.hue >= 15) & (q.hue <= 35))
    ramp = np.where(warm, np.clip((np.minimum(c(p.sat), r(q.sat)) - 0.45) / 0.20, 0, 1), 1.0)
    echo = np.nan_to_num(hue * (c(np.sqrt(p.sat)) * r(np.sqrt(q.sat))) * ramp)
    scale = np.where(c(p.bw) & r(q.bw), 0.65, 1.0)
    h, k = harmony * scale, contrast * scale
    wins = (echo > h) & (echo > k)
    aesthetic = np.where(wins, echo, np.maximum(h, k))
    amode = np.where(wins, 2, np.where(h >= k, 0, 1))
    # geometric
    pa_, pb, va, vb = c(p.peak), r(q.peak), c(p.var), r(q.var)
    ea, eb = c(p.peak**0.4), r(q.peak**0.4)
    product = ea * eb
    emult = np.where(np.abs(pa_ - pb) > 0.5, np.maximum(product, 0.6 * np.maximum(ea, eb)), product)
    structural = (edge * emult + grid * (c(p.var**0.4) * r(q.var**0.4))) / 2
    spread = np.abs(c(p.x) - r(q.x)) * 0.70 + np.abs(c(p.y) - r(q.y)) * 0.30
    centroid = np.where(np.maximum(va, vb) >= 0.1, np.nan_to_num(spread) * (c(np.sqrt(p.var)) * r(np.sqrt(q.var))), 0.0)
    ga, gb = c(np.clip(p.gaze / 0.30, -1, 1)), r(np.clip(q.gaze / 0.30, -1, 1))
    ahead, back = np.nan_to_num(np.maximum(0, (ga - gb) / 2)), np.nan_to_num(np.maximum(0, (gb - ga) / 2))
    talk = np.maximum(ahead, back)
    slant = lambda f: np.abs(np.sin(f * np.pi / 8)) >= 0.5
    turn = np.abs(np.arange(16.0)[:, None] - np.arange(16.0))
    sines = np.sin(np.minimum(turn, 16 - turn) * np.pi / 16)[p.fold.astype(int)][:, q.fold.astype(int)]
    lines = (pa_ >= 0.25) & (pb >= 0.25) & c(slant(p.fold)) & r(slant(q.fold))
    orientation = np.where(lines, sines * (c(np.sqrt(p.peak)) * r(np.sqrt(q.peak))), 0.0)
    directional = np.maximum(np.maximum(centroid, talk), orientation)
    geometric = structural * 0.50 + directional * 0.25 + np.abs(va - vb) * 0.25
    gmode = np.where(directional <= structural, 0, np.where((talk >= centroid) & (talk >= orientation), 1, np.where(orientation >= centroid, 2, 3)))
    # thematic
    # images with the same clusters share a row or column
    themes = _themes(*(x.flags[x.kinds] for x in (p, q)))[p.kind][:, q.kind]
    diversity = np.where(clip < 0.30, 1.35, np.where(clip < 0.60, 1.0, np.where(clip < 0.88, 0.75, 1.0)))
    captions = c(p.captioned) & r(q.captioned)
    thematic = np.where(captions, np.minimum(1.0, themes * diversity), clip)
    # composite
    base = weights[0] * aesthetic + weights[1] * geometric + weights[2] * thematic
    base = np.where(~captions & (thematic > 0.80), base * 0.45, base)
    boosted = captions & (thematic >= 0.20) & (thematic >= np.maximum(aesthetic, geometric * 0.8))
    base = np.where(boosted, 0.25 * aesthetic + 0.15 * geometric + 0.60 * thematic, base)
    base = np.where(clip > 0.88, base * 0.40, np.where((clip > 0.75) & (thematic < 0.20), base * 0.65, base))
    apart = np.abs(c(p.date) - r(q.date))
    near = apart <= 300
    at = np.nonzero(near)
    gaps = apart[at]
    base[at] *= np.select([gaps <= 30, gaps <= 60, gaps <= 120], [0.40, 0.55, 0.75], 0.90)
    variants = np.zeros_like(captions)
    some = np.nonzero(np.isin(p.bases, q.bases).any(1))[0]
    for i in range(4):
        for j in range(4):
            variants[some] |= c(p.bases[some, i]) == r(q.bases[:, j])
    variants &= c(p.name) != r(q.name)
    burst = near | variants
    composite = np.where(variants, 0.0, base)
    return {"aesthetic": aesthetic, "geometric": geometric, "thematic": thematic, "composite": composite, "amode": amode, "gmode": gmode, "back": back > ahead, "ahead": ahead > back, "burst": burst}


class _Best:
    """The scores of the k best edges seen so far of every node of a side, for one pool.

    Partners must come in the order of their ids: of equal edges the earlier ones stay, as the pools take the smaller id."""

    def __init__(self, nodes: int, k: int):
        self.k, self.top, self.least = k, np.full((nodes, k), -np.inf), np.full(nodes, -np.inf)

    def admit(self, at: slice, score: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Mask of the allowed entries that are now among their row's k best; the rows are the nodes ``at``."""
        hit = ok & (score > self.least[at][:, None])
        count = hit.sum(1)
        many = np.nonzero(count > self.k)[0]
        if len(many):
            # scores come at 9 decimals, so that the place among equals fits in below them
            n = score.shape[1]
            key = np.where(hit[many], np.rint(score[many] * 1e9).astype(np.int64) * n + np.arange(n)[::-1], np.iinfo(np.int64).min)
            hit[many] = key >= np.partition(key, n - self.k, axis=1)[:, n - self.k][:, None]
            count[many] = self.k
        rows = np.nonzero(count)[0]
        if len(rows):
            r, c = np.nonzero(hit[rows])
            new = np.full((len(rows), int(count.max())), -np.inf)
            new[r, np.arange(len(r)) - (np.cumsum(count[rows]) - count[rows])[r]] = score[rows[r], c]
            own = at.start + rows
            both = np.concatenate([self.top[own], new], 1)
            self.top[own] = best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            self.least[own] = best.min(1)
        return hit


AMODES, GMODES = ("harmony", "contrast", "accent_echo"), ("structural", "gaze_conversation", "opposing_diagonals", "directional_complement")


def _best(nodes: np.ndarray, score: np.ndarray, partner: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best entries of each node, equal ones by the partner's id."""
    order = np.lexsort((partner, -score, nodes))
    n = nodes[order]
    start = np.nonzero(np.diff(n, prepend=-1))[0]
    out = np.zeros(len(nodes), bool)
    out[order] = np.arange(len(n)) - np.repeat(start, np.diff(start, append=len(n))) < k
    return out


def _prune(e: dict[str, np.ndarray], pools) -> dict[str, np.ndarray]:
    """Of scored edges (ends x and y, numbered apart where they are of different blocks) those that some pool could admit."""
    keep = np.zeros(len(e["x"]), bool)
    for name, where, n in pools(e):
        at = np.nonzero(where)[0]
        best = _best(np.concatenate([e["x"][at], e["y"][at]]), np.tile(e[name][at], 2), np.concatenate([e["y"][at], e["x"][at]]), n)
        keep[at] |= best[: len(at)] | best[len(at) :]
    return {c: v[keep] for c, v in e.items()}


#: Images of the square parts that a tile is scored in, and edges it holds before they are pruned.
PART, HELD = 256, 2_000_000
#: Images of a block at most.  Every block meets all others of its scope, so larger ones are sent less often.
MOST = 8192


def _block(pairs: float, cores: int, least: int) -> int:
    """The size of the blocks that make some tiles per core of ``pairs`` pairs, within bounds."""
    return int(min(max(math.sqrt(pairs / (4 * cores)), least), max(MOST, least)))


def _reuse_memory() -> None:
    """Has glibc keep freed arrays of some megabytes for the next ones, as new pages cost as much as the sums done in them."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


def _tile(k: int, thematic_floor: float, aesthetic_floor: float, few: int):
    """Scores one tile (blocks i and j of a group) in parts and returns the edges that some pool could still admit."""
    names, kinds = zip(*(x.split(" ") for x in OUT.split(", ")))
    kind = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def tile(t: pa.Table) -> pa.Table:
        _reuse_memory()
        t = t.combine_chunks()
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_numpy()
        ids = t.column("id").to_numpy()
        first, second = (at[np.argsort(ids[at], kind="stable")] for at in (np.nonzero(own == n)[0] for n in (i, j)))
        cut = lambda rows: [(at, Block(t, rows[at : at + PART])) for at in range(0, len(rows), PART)]
        p = cut(first)
        q = p if i == j else cut(second)
        held: list[dict[str, np.ndarray]] = []
        rows = [_Best(len(first), n) for n in sizes]
        cols = rows if i == j else [_Best(len(second), n) for n in sizes]
        number, most = 0, HELD
        for x0, x in p:
            for y0, y in q:
                if i != j or x0 <= y0:
                    e = part(x, y, rows, cols, x0, y0)
                    # the ends are numbered through the tile
                    e["x"], e["y"] = e["x"] + x0, e["y"] + y0 + (0 if i == j else len(first))
                    held.append(e)
                    number += len(e["x"])
                    if number > most:
                        held = [still(merge(held), rows, cols, 0 if i == j else len(first))]
                        number = len(held[0]["x"])
                        most = max(HELD, 2 * number)
        if not held:
            return pa.table({n: pa.array([], kind[x]) for n, x in zip(names, kinds)})
        e = _prune(still(merge(held), rows, cols, 0 if i == j else len(first)), pools)
        cols = [e["a"], e["b"], *(e[n] for n in ("aesthetic", "geometric", "thematic", "composite")), pa.array(AMODES).take(pa.array(e["amode"])), pa.array(GMODES).take(pa.array(e["gmode"])), e["flipped"]]
        return pa.table({n: c if isinstance(c, pa.Array) else pa.array(c) for n, c in zip(names, cols)})

    def merge(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([e[c] for e in parts]) for c in parts[0]}

    #: Edges kept of an image by each of ``pools``.
    sizes = (k, max(30, k // 3), few, 1, few)

    def still(e: dict[str, np.ndarray], rows: list[_Best], cols: list[_Best], offset: int) -> dict[str, np.ndarray]:
        """Without the edges that have since fallen below the best ones of both ends."""
        keep = np.zeros(len(e["x"]), bool)
        for (name, where, _), b, d in zip(pools(e), rows, cols):
            keep |= where & ((e[name] >= b.least[e["x"]]) | (e[name] >= d.least[e["y"] - offset]))
        return {c: v[keep] for c, v in e.items()}

    def pools(s: dict[str, np.ndarray], ok=True) -> list[tuple[str, np.ndarray, int]]:
        """(score, edges it counts for, edges kept of an image) of every pool."""
        return [
            ("composite", ok & (s["composite"] > 0), k), ("thematic", ok & (s["thematic"] >= thematic_floor), max(30, k // 3)), ("geometric", ok & (s["composite"] > 0), few),
            ("geometric", ok & (s["gmode"] != 0), 1), ("aesthetic", ok & (s["aesthetic"] >= aesthetic_floor), few),
        ]

    def part(p: Block, q: Block, rows: list[_Best], cols: list[_Best], x0: int, y0: int) -> dict[str, np.ndarray]:
        s = score_tile(p, q)
        for n in ("aesthetic", "geometric", "thematic", "composite"):
            s[n] = np.round(s[n], 9)  # equal images tie, whatever their place in a matrix product
        ok = (s["composite"] > 0) & ~s["burst"] & (p.id[:, None] != q.id[None, :])
        keep = np.zeros_like(ok)
        for (name, where, _), b, d in zip(pools(s, ok), rows, cols):
            keep |= b.admit(slice(x0, x0 + len(p.id)), s[name], where)
            if p is not q:
                keep |= d.admit(slice(y0, y0 + len(q.id)), np.ascontiguousarray(s[name].T), np.ascontiguousarray(where.T)).T
        if p is q:
            keep = np.triu(keep | keep.T, 1)
        x, y = np.nonzero(keep)
        up = p.id[x] < q.id[y]
        flipped = np.where(up, s["back"][x, y], s["ahead"][x, y]) & (s["gmode"][x, y] == 1)
        scores = {n: s[n][x, y] for n in ("aesthetic", "geometric", "thematic", "composite", "amode", "gmode")}
        return {"x": x, "y": y, "a": np.minimum(p.id[x], q.id[y]), "b": np.maximum(p.id[x], q.id[y]), **scores, "flipped": flipped}

    return tile


def score_library(prepared: DataFrame, k: int = 50, block: int = 512, thematic_floor: float = 0.20, aesthetic_floor: float = 0.55, few: int = 5) -> DataFrame:
    """Scored edges (a < b; ``flipped``: in a gaze conversation b looks right) of all pairs inside each scope that a
    pool of ``select_pools`` with the same parameters could admit.

    Edges of a burst (300 s or variants of one file name) or with a composite of 0 or less never come.
    ``prepared`` must have one row per id; null scopes and vectors take no part."""
    rows = stage(prepared.filter("scope IS NOT NULL AND clip IS NOT NULL"), "prepared")
    tidy(prepared.sparkSession)
    counts = stage(rows.groupBy("scope").agg(F.count("*").alias("n")), "sizes")
    block = _block(counts.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0, prepared.sparkSession.sparkContext.defaultParallelism, block)
    sizes = counts.select("scope", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, "scope").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = tiles.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("with", "blocks", "cl")
    return heavy_groups(keyed, "scope", "i", "j").applyInArrow(_tile(k, thematic_floor, aesthetic_floor, few), OUT)


def score_cross(prepared: DataFrame, new: Column, k: int = 50, block: int = 512, thematic_floor: float = 0.20, aesthetic_floor: float = 0.55, few: int = 5) -> DataFrame:
    """As ``score_library``, for all pairs of a new image (where ``new`` is true) with an old one, over all scopes.

    Only tiles of a new with an old block are made, so the work is the batch times the rest and not its square.
    Images with a null vector take no part; a null ``new`` is old."""
    rows = stage(prepared.filter("clip IS NOT NULL").withColumn("fresh", F.coalesce(new, F.lit(False))), "prepared")
    tidy(prepared.sparkSession)
    n = {r.fresh: r.n for r in rows.groupBy("fresh").agg(F.count("*").alias("n")).collect()}
    block = _block(float(n.get(True, 0)) * n.get(False, 0), prepared.sparkSession.sparkContext.defaultParallelism, block)
    n = {fresh: math.ceil(c / block) for fresh, c in n.items()}
    mine, other = n.get(True, 0), n.get(False, 0)
    if not mine or not other:
        release(rows)
        return prepared.sparkSession.createDataFrame([], OUT)
    blocks, partners = F.when(F.col("fresh"), mine).otherwise(other), F.when(F.col("fresh"), other).otherwise(mine)
    # new blocks are numbered from 0 and old ones after them
    own = (F.pmod(F.xxhash64("id"), blocks) + F.when(F.col("fresh"), 0).otherwise(mine)).cast("int")
    first = F.when(F.col("fresh"), mine).otherwise(0)
    tiles = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(first, first + partners - 1))).withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
    return heavy_groups(tiles.drop("with", "cl", "fresh"), "i", "j").applyInArrow(_tile(k, thematic_floor, aesthetic_floor, few), OUT)
