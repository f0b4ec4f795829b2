"""Duplicate groups by date and file name variants, and near hashes that do meet."""

from tandem.operators import dupes


def test_variants_join_groups(spark):
    far = ["0000000000000000", "00000000ffffffff", "ffffffff00000000", "ffffffffffffffff", "0f0f0f0f0f0f0f0f", "f0f0f0f0f0f0f0f0", "00ff00ff00ff00ff"]
    names = ["63-20250504-a.jpg", "20250504-A.jpg", "20250504-a-2.jpg", "20250504-a.jpg", "b.jpg", "b.jpg", "7-b.jpg"]
    dates = [5.0, 5.0, 5.0, 6.0, 5.0, 5.0, None]
    df = spark.createDataFrame(list(zip(range(7), far, names, dates)), "id long, dhash string, filename string, capturedate double")
    assert {(r.id, r.groupid) for r in dupes.duplicate_groups(df).collect()} == {(0, 0), (1, 0), (2, 0)}
    both = df.unionByName(spark.createDataFrame([(7, far[3], "1-b.jpg", 5.0), (8, None, "2-b.jpg", 5.0)], df.schema))
    got = {(r.id, r.groupid) for r in dupes.duplicate_groups(both).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (7, 3)}


def test_near_hashes_join_groups(spark):
    rows = [(1, "00ff00ff00ff00ff"), (2, "00ff00ff00ff0000"), (3, "00ff00ff00000000"), (4, "ffffffffffffffff"), (5, "ffffffffffffffff"), (6, "zz"), (7, None)]
    got = {(r.id, r.groupid) for r in dupes.duplicate_groups(spark.createDataFrame(rows, "id long, dhash string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
