"""Tiles scored in parts: the same edges as in one part, and no more of them than one part has."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tandem import runtime
from tandem.plans import scoring
from tandem.queries import core

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("blocks", (1, 2))
def test_parts_give_the_edges_of_the_whole(spark, monkeypatch, blocks):
    t = core._prepared(spark, DATA).drop("cl").toArrow()
    own = pa.array(np.arange(len(t)) % blocks, pa.int32())
    t = t.append_column("own", own).append_column("i", pa.array([0] * len(t), pa.int32())).append_column("j", pa.array([blocks - 1] * len(t), pa.int32()))
    edges = lambda r: sorted(zip(r["a"].to_pylist(), r["b"].to_pylist()))
    one = edges(scoring._tile(2, 0.2, 0.55, 1)(t))
    for part, held in ((5, 1), (8, 60), (8, 10**6)):
        monkeypatch.setattr(scoring, "PART", part)
        monkeypatch.setattr(scoring, "HELD", held)
        assert edges(scoring._tile(2, 0.2, 0.55, 1)(t)) == one
    assert len(set(one)) == len(one) > 20


def test_blocks_grow_with_the_work():
    assert scoring._block(1e4, 6, 512) == 512 and scoring._block(5e9, 6, 512) == scoring.MOST and 512 < scoring._block(1e8, 6, 512) < scoring.MOST


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("part", (7, 512))
def test_a_tile_keeps_no_more_than_its_pools_take(spark, monkeypatch, part):
    t = core._prepared(spark, DATA).drop("cl").toArrow()
    monkeypatch.setattr(scoring, "PART", part)
    zero = pa.array([0] * len(t), pa.int32())
    got = scoring._tile(3, 0.2, 0.55, 2)(t.append_column("own", zero).append_column("i", zero).append_column("j", zero))
    b = scoring.Block(t, np.argsort(t.column("id").to_numpy()))
    s = {n: np.round(v, 9) if v.dtype == float else v for n, v in scoring.score_tile(b, b).items()}
    ok = (s["composite"] > 0) & ~s["burst"] & ~np.eye(len(b.id), dtype=bool)
    want = set()
    for name, where, n in (("composite", ok, 3), ("thematic", ok & (s["thematic"] >= 0.2), 30), ("geometric", ok, 2), ("geometric", ok & (s["gmode"] != 0), 1), ("aesthetic", ok & (s["aesthetic"] >= 0.55), 2)):
        for x in range(len(b.id)):
            at = np.nonzero(where[x])[0]
            want |= {tuple(sorted((int(b.id[x]), int(b.id[y])))) for y in at[np.lexsort((b.id[at], -s[name][x, at]))][:n]}
    assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist())) == sorted(want) and len(want) > 100


def test_near_colours_are_measured_exactly():
    rng = np.random.default_rng(1)
    p, q = rng.normal(0, 60, (9, 18)), rng.normal(0, 60, (5, 18))
    q[0], q[1] = p[0], p[1] + 1e-7
    want = [[sum(np.linalg.norm(x[i : i + 3] - y[j : j + 3]) for i in range(0, 18, 3) for j in range(0, 18, 3)) for y in q] for x in p]
    assert np.abs(scoring._distances(p, q) - want).max() < 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ("library_pairs", "cross_folder_pairs"))
def test_images_of_the_tiles_go_when_the_edges_are_staged(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(runtime, "shared_folder", lambda spark: f"file://{tmp_path}")
    pairs = core.QUERIES[name](spark, DATA)
    assert list(tmp_path.glob("edges-*")) and not list(tmp_path.glob("prepared-*"))
    assert pairs.count() > 0 or name != "library_pairs"
