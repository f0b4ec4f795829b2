"""Role connections over all pairs of profiles."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.operators import roles
from tandem.queries import core
from tandem.runtime import stage

DATA = "/root/testdata/sf0.001"
TEXTS = [
    '{"phenomena":[{"phenomenon":"heat","role":"source"},{"phenomenon":"music","role":"source"}],"claims":["danger", "hold on"],"subverts":["calm"]}',
    '{"phenomena":[{"phenomenon":"sound","role":"receiver"},{"phenomenon":"heat","role":"receiver"}],"subverts":["noise"]}',
    '{"phenomena":[{"phenomenon":"sound","role":"receiver"},{"phenomenon":"gaze","role":"source"}]}',
    '{"objects":[{"object":"cup","register":"real","category":"dish"},{"object":"Gun","register":"real","category":"weapon"},{"object":"rifle","register":"toy","category":"weapon"}]}',
    '{"objects":[{"object":"rifle","register":"real","category":"weapon"},{"object":"gun","register":"toy","category":"weapon"},{"object":"danger sign","register":"real","category":""}]}',
    '{"claims":["Smile please", "Miss"], "enacts":["danger", "a calm smile"]}', '{"claims":["smile", "calm noise"], "enacts":["Tenderness", "please hold"]}',
    '{"claims":["gun danger"], "subverts":["smile"], "objects":[{"object":"please sign","register":"depicted","category":"sign"}]}', '{}', None,
]


def every_pair(prof):
    ids = prof.select(F.col("id").alias("a")).join(prof.select(F.col("id").alias("b")), F.col("a") < F.col("b")).withColumn("id", F.concat_ws("-", "a", "b"))
    return roles.connect(ids, prof)


@pytest.mark.parametrize("task_pairs", (1, 500_000))
def test_equals_every_pair_tried(spark, task_pairs, monkeypatch):
    monkeypatch.setattr(roles, "TASK_PAIRS", task_pairs)
    rows = list(enumerate(TEXTS)) + [(100 - i, t) for i, t in enumerate(TEXTS)]
    prof = stage(roles.profiles(spark.createDataFrame(rows, "id long, roleprofile string")), "profiles")
    cols = ("a", "b", "priority", "kind", "key")
    want = sorted(tuple(r) for r in every_pair(prof).select(*cols).collect())
    assert {r[2] for r in want} == {1, 2, 3, 4}
    assert sorted(tuple(r) for r in roles.connect_all(prof).select(*cols).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_query_has_pairs_that_are_not_stored(spark):
    prof = stage(roles.profiles(core.table(spark, DATA, "images").filter("ishero AND isactive")), "profiles")
    hits = every_pair(prof)
    want = sorted(tuple(r) for r in hits.select("a", "b", "priority", "kind", "key").collect())
    got = core.role_join(spark, DATA).select("a", "b", "priority", "kind", "key")
    assert sorted(tuple(r) for r in got.collect()) == want
    stored = {(min(r.a, r.b), max(r.a, r.b)) for r in core.pairs_once(spark, DATA).collect()}
    assert {r[:2] for r in want} - stored
    rated = roles.with_specificity(hits, roles.frequencies(prof), prof.count())
    spec = {(r.a, r.b): (r.priority, round(r.specificity, 6)) for r in rated.collect()}
    assert {(r.a, r.b): (r.priority, r.specificity) for r in core.role_specificity(spark, DATA).collect()} == spec
    caps, used, admitted = {1: 8, 2: 8, 3: 5, 4: 12}, {}, set()
    for r in sorted(rated.collect(), key=lambda r: (r.priority, -r.specificity, r.a, r.b)):
        ends = [(r.a, r.priority), (r.b, r.priority)]
        if all(used.get(v, 0) < caps[r.priority] for v in ends):
            admitted.add((r.a, r.b, r.priority))
            used.update({v: used.get(v, 0) + 1 for v in ends})
    assert {(r.a, r.b, r.priority) for r in core.role_admission(spark, DATA).collect()} == admitted


@pytest.mark.parametrize("cap", (1, 3, 100))
def test_admission_equals_the_loop_over_all_connections(spark, cap):
    rng = random.Random(cap)
    parts = [json.loads(t) for t in TEXTS[:8]]
    field = lambda n: [x for p in rng.sample(parts, 4) for x in p.get(n, [])]
    texts = [json.dumps({n: field(n) for n in ("phenomena", "claims", "enacts", "subverts", "objects") if rng.random() < 0.6}) for _ in range(150)]
    prof = stage(roles.profiles(spark.createDataFrame([(rng.randrange(10**6), t) for t in texts + TEXTS], "id long, roleprofile string")), "profiles")
    freq, total = roles.frequencies(prof), prof.count()
    caps, used, want = {1: cap, 2: cap + 1, 3: cap, 4: 2 * cap}, Counter(), set()
    rated = roles.connect_all(prof, freq, total).collect()
    for r in sorted(rated, key=lambda r: (r.priority, -r.specificity, r.a, r.b)):
        ends = [(r.a, r.priority), (r.b, r.priority)]
        if all(used[v] < caps[r.priority] for v in ends):
            want.add((r.a, r.b, r.priority))
            used.update(ends)
    got = [tuple(r) for r in roles.admit(prof, freq, total, caps).collect()]
    assert set(got) == want and len(got) == len(want) and {k for _, _, k in got} == {1, 2, 3, 4}
    assert len({r.specificity for r in rated}) > 5
