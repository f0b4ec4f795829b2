import random

from pyspark.sql import functions as F

from tandem.operators.scan import ranged_positions


def expected(rows, keep=None):
    groups = {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        groups.setdefault(g, []).append((o, v))
    out = []
    for g, members in groups.items():
        run = 0
        for n, (o, v) in enumerate(members, 1):
            run += v or 0
            if keep is None or n <= keep:
                out.append((g, o, v, n, run))
    return sorted(out, key=str)


def test_positions_and_sums_over_hot_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = ranged_positions(df, ["g"], [F.col("o").asc()], value="v")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    top = ranged_positions(df, ["g"], [F.col("o").asc()], value="v", keep=3)
    assert sorted(map(tuple, top.collect()), key=str) == expected(rows, 3)


def test_copies_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", 1, 9, 7)] * 5 + [("x", 2, 9, 7)], "g string, o int, position int, _pid int")
    got = ranged_positions(df, ["g"], [F.col("o").asc()], copies=["g", "o"])
    assert sorted((r.o, r.position, r["_pid"]) for r in got.collect()) == [(1, 1, 7), (2, 2, 7)]
    assert ranged_positions(df.limit(0), ["g"], [F.col("o").asc()], value="o").count() == 0
