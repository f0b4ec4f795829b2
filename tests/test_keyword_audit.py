"""Every keyword of the cluster vocabulary with the group condition."""

import os

import pytest
from pyspark.sql import functions as F

from tandem.functions import clusters as C
from tandem.functions import vocab
from tandem.functions.text import tokenize
from tandem.queries import core

DATA = "/root/testdata/sf0.01"


def test_groups_and_sole_keywords(spark):
    rows = [("one", 0, "dog"), ("one", 0, "cat"), ("two", 0, "crow"), ("two", 0, "mob"), ("two", 1, "alone"), ("two", 1, "lone")]
    texts = ["dog cat", "dog dog", "crow", "crow alone", "crow mob alone", "mob alone lone", "alone", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, caption string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in C.keyword_audit(df, [*rows, ("two", 1, "adrift"), ("never", 0, "yak")]).collect()}
    third = 33.333333
    assert got == {("one", 0, "dog"): (2, 100.0, 1), ("one", 0, "cat"): (1, 50.0, 0), ("two", 0, "crow"): (3, 100.0, 1), ("two", 0, "mob"): (2, 2 * third + 1e-6, 1), ("two", 1, "alone"): (4, 4 * third + 1e-6, 2), ("two", 1, "lone"): (1, third, 0), ("two", 1, "adrift"): (0, 0.0, 0), ("never", 0, "yak"): (0, None, 0)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_equals_removal_of_each_keyword(spark):
    caps = core.images_once(spark, DATA, "caption").select("id", tokenize(F.col("caption")).alias("t")).collect()
    captions = {(r.id, frozenset(r.t)) for r in caps}
    want = {}
    for c, g, k in vocab.default_rows():
        by: dict = {}
        for x, h, w in vocab.default_rows():
            if x == c:
                by.setdefault(h, set()).add(w)
        fires = lambda t, by=by: all(t & w for w in by.values())
        have = [t for _, t in captions if k in t]
        want[c, g, k] = (len(have), sum(fires(t) and not fires(t - {k}) for t in have))
    assert any(g == 1 and n[0] for (_, g, _), n in want.items())
    assert {tuple(r)[:3]: (r.captions, r.sole) for r in core.keyword_firing(spark, DATA).collect()} == want
