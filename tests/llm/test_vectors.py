from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import graph as G
from tandem import runtime
from tandem.llm.neighbours import NeighbourParams, _packed, _unpacked, _waves, nearest, recall


def clustered(n, d, rng, families=12):
    mids = rng.standard_normal((n // families + 1, d))
    return (mids[np.arange(n) // families] + 0.45 * rng.standard_normal((n, d))).astype(np.float32)


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = clustered(1500, 48, rng)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = G.GraphParams()
    g, entries = G.build(x, p)
    assert (g < 1500).all() and all((g[i] != i).all() for i in range(1500))
    ids, sims = G.beam_search(x, g, entries, x[:300], p.beam, p.expand)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:12]) & set(b)) / 6 for a, b in zip(ids, truth)]) > 0.95 and (np.diff(sims, axis=1) <= 0).all()
    one, e1 = G.build(x[:1], p)
    assert G.beam_search(x[:1], one, e1, x[:2], 40, 4)[0].tolist() == [[0], [0]]


def brute(ids, x, k, limit):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(ids)):
        c = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= limit)
        out |= {(ids[i], j) for _, j in c[:k]}
    return out


@pytest.mark.parametrize("cell", [5000, 150])
def test_nearest_equals_brute_force(spark, cell):
    rng = np.random.default_rng(1)
    x = clustered(700, 64, rng)
    x[600:640] = x[5]
    ids = [int(i) for i in rng.permutation(10_000)[:700]]
    rows = [(i, v.tolist(), "a", 1.0) for i, v in zip(ids, x)]
    bad = [(20_000, None), (20_001, []), (20_002, [1.0] * 63), (20_003, [0.0] * 64), (20_004, [float("nan")] * 64), (20_005, [float("inf")] + [1.0] * 63), (20_006, [None] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows + rows[:30] + [(i, v, "a", 1.0) for i, v in bad], "imageid long, embedding array<float>, cid string, sim double")
    p = NeighbourParams(size=64, dims=32, cell=cell, chunk=100)
    got = {(r.id, r.neighbour) for r in nearest(df, "imageid", "embedding", p).collect()}
    want = brute(ids, x, 5, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    hot = sorted([ids[5], *ids[600:640]])
    for i in hot:
        assert sorted(b for a, b in got if a == i) == [h for h in hot if h != i][:5]
    assert nearest(df.limit(0), "imageid", "embedding", p).count() == 0
    r = recall(df, "imageid", "embedding", 10, p).first()
    assert r.recall >= 0.95 and r.queries == len([i for i in ids if i % 10 == 0])


def test_large_shards_are_split_until_none_is_left(spark):
    rng = np.random.default_rng(2)
    x = clustered(900, 64, rng)
    ids = list(range(1, 901))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "imageid long, embedding array<float>")
    # two centroids at most a table: the shards of about 25 vectors take several splits
    p = NeighbourParams(size=64, dims=32, cell=25, most_cells=2, largest=2.0, local=128, chunk=64)
    got = {(r.id, r.neighbour) for r in nearest(df, "imageid", "embedding", p).collect()}
    want = brute(ids, x, 5, 0.8)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_families_cut_by_many_shards_stay_whole(spark):
    rng = np.random.default_rng(3)
    x = clustered(1600, 64, rng, families=800)
    # pairs of neighbours inside two wide families, which 80 centroids cut to pieces
    x[800:] = x[:800] + 0.25 * rng.standard_normal((800, 64)).astype(np.float32)
    ids = list(range(1, 1601))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "imageid long, embedding array<float>")
    p = NeighbourParams(size=64, dims=48, k=3, cell=20, limit=0.97)
    got = {tuple(sorted((r.id, r.neighbour))) for r in nearest(df, "imageid", "embedding", p).collect()}
    want = {tuple(sorted(e)) for e in brute(ids, x, 3, 0.97)}
    assert len(want) > 100 and len(got & want) >= 0.995 * len(want) and len(got - want) <= 0.01 * len(want)


def test_packed_vectors_come_back():
    x = np.random.default_rng(4).standard_normal((9, 6)).astype(np.float32)
    x[::2] = (x[::2].view(np.uint32) & 0xFFFF0000).view(np.float32)
    col = _packed(x)
    assert (_unpacked(col, 6) == x).all() and (_unpacked(pa.chunked_array([col.slice(2, 3), col.take(pa.array([0]))]), 6) == x[[2, 3, 4, 0]]).all()
    assert len(col[0].as_py()) == 12 and len(col[1].as_py()) == 24 and _unpacked(col.slice(0, 0), 6).shape == (0, 6)


def test_waves_cover_every_shard_once():
    asked = np.array([0, 3, 3, 9, 0, 2, 2, 2, 0])
    waves = _waves(asked, 6)
    assert [s for a, b in waves for s in range(a, b)] == list(range(9)) and all(asked[a:b].sum() <= 6 or (asked[a:b] > 0).sum() == 1 for a, b in waves)
    assert not _waves(np.zeros(3, int), 6)


def test_waves_find_the_same_and_leave_no_vectors_behind(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    x = clustered(900, 64, rng)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "imageid long, embedding array<float>")
    p = NeighbourParams(size=64, dims=32, cell=30, local=128, chunk=64, largest=2.0)
    got = []
    for wave in (10**6, 1):
        shared = tmp_path / str(wave)
        monkeypatch.setattr(runtime, "shared_folder", lambda spark, at=shared: f"file://{at}")
        found = nearest(df, "imageid", "embedding", replace(p, wave=wave))
        assert len(list(shared.glob("ways-*"))) == 1 if wave > 1 else len(list(shared.glob("ways-*"))) > 1
        assert not [f for n in ("vectors", "placed", "dealt") for f in shared.glob(f"{n}-*")]
        got.append({(r.id, r.neighbour) for r in found.collect()})
    assert got[0] == got[1] and len(got[0]) > 1000
