"""Role connections by tiles of profile blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_role_pairs import TEXTS, every_pair

from tandem.operators import roles
from tandem.runtime import stage


def some_profiles(spark, n, seed):
    rng = random.Random(seed)
    parts = [json.loads(t) for t in TEXTS[:8]]
    field = lambda name: [x for p in rng.sample(parts, 4) for x in rng.sample(p.get(name, []), len(p.get(name, [])))]
    texts = [json.dumps({n: field(n) for n in ("phenomena", "claims", "enacts", "subverts", "objects") if rng.random() < 0.6}) for _ in range(n)]
    rows = [(rng.randrange(-(10**6), 10**6), t) for t in texts + TEXTS]
    return stage(roles.profiles(spark.createDataFrame(rows, "id long, roleprofile string")), "profiles")


def above_the_tiles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return [w for w in ("Exchange", "Join", "Aggregate") if w in plan.split("MapInArrow")[0]]


@pytest.mark.parametrize("block, task_pairs", ((7, 30), (1 << 15, 500_000)))
def test_tiles_equal_every_pair_and_connections_are_not_shuffled(spark, block, task_pairs, monkeypatch):
    monkeypatch.setattr(roles, "BLOCK", block)
    monkeypatch.setattr(roles, "TASK_PAIRS", task_pairs)
    prof = some_profiles(spark, 120, block)
    got = roles.connect_all(prof)
    assert got.columns == ["a", "b", "priority", "kind", "key"] and not above_the_tiles(got)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in every_pair(prof).select(*got.columns).collect())
    assert {r[2] for r in rows} == {1, 2, 3, 4}


def test_no_profiles_and_one_profile(spark):
    prof = some_profiles(spark, 0, 0)
    for few in (prof.filter("false"), prof.limit(1)):
        assert roles.connect_all(stage(few, "profiles")).count() == 0


def test_specificity_is_found_in_the_tiles_and_rounded_once_a_key(spark):
    prof = some_profiles(spark, 120, 3)
    freq, total = stage(roles.frequencies(prof), "frequencies"), prof.count()
    got = roles.connect_all(prof, freq, total, digits=6)
    assert not above_the_tiles(got)
    assert "round" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    want = roles.with_specificity(every_pair(prof).select("a", "b", "priority", "kind", "key"), freq, total).withColumn("specificity", F.round("specificity", 6))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in want.select(*got.columns).collect())
    assert len({r[-1] for r in rows}) > 5
