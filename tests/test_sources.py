import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import pixels as P
from tandem.sources import scan as S
from tandem.streaming import ingest


def ppm(rgb):
    a = np.round(np.asarray(rgb) * 255).astype(np.uint8)
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


@pytest.fixture(scope="module")
def picture():
    y, x = np.mgrid[0:40, 0:60]
    return np.stack([x / 59, y / 39, np.full(x.shape, 0.2)], 2)


def test_scan(spark, tmp_path):
    for name in ("a.jpg", "b.jpeg", "c.JPG", "d.txt", ".hidden.jpg", "sub/e.png", "skip/f.tif", ".dir/g.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    got = {r.filename: r.fileformat for r in S.scan_images(spark, str(tmp_path), ("skip",)).collect()}
    assert got == {"a.jpg": "JPEG", "b.jpeg": "JPEG", "c.JPG": "JPEG", "e.png": "PNG"}
    one = S.scan_images(spark, str(tmp_path)).filter("filename = 'a.jpg'").first()
    assert one.contenthash == f"5_{int(os.path.getmtime(tmp_path / 'a.jpg'))}"
    assert [r[0] for r in spark.createDataFrame([("2024:01:02 03:04:05",), ("nonsense",), (None,)], "t string").select(S.capture_seconds(F.col("t"))).collect()] == [1704164645.0, None, None]


def test_features(spark, picture):
    f = P.image_features(ppm(picture))
    assert (len(f["hsl"]), len(f["palette"]), len(f["edge"]), len(f["grid"])) == (1152, 18, 32, 32)
    assert sum(f["hsl"]) == pytest.approx(1) and sum(f["edge"]) == pytest.approx(1, abs=1e-9) or sum(f["edge"]) == 0
    assert f == P.image_features(ppm(picture)) and f["colorprofile"] == "color" and len(f["dhash"]) == 16
    assert P.image_features(ppm(np.full((8, 8, 3), 0.5)))["colorprofile"] == "bw"
    assert P.dhash(np.repeat(np.linspace(0, 1, 9)[None, :, None], 8, 0).repeat(3, 2)) == "f" * 16
    v = P.hsl(np.array([[[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.5, 0.5]]]))
    assert np.allclose(v[:3, 0], [0, 1 / 3, 2 / 3]) and np.allclose(v[3], [0, 0, 0.5])
    assert np.allclose(P.lab(np.array([[[1.0, 1, 1]]])), [[100, 0, 0]], atol=0.02)
    e = P.mock_embedding(60, 40)
    assert np.linalg.norm(e) == pytest.approx(1) and (e == P.mock_embedding(60, 40)).all() and (e != P.mock_embedding(61, 40)).any()
    assert np.allclose(P.from_blob(P.to_blob([1.5, -2])), [1.5, -2])
    assert P.centroid([(0.1, 0.1, 0.2, 0.2, 0.9)], []) == pytest.approx((0.2, 0.8)) and P.centroid([], []) is None
    assert P.gaze([0, 1], 0.75, [0, 1], 0.75) == 0.5 and P.gaze([0, 0.01], 0, [0, 1], 0) is None
    heat = np.zeros((9, 9))
    heat[4, 4] = 1
    assert P.dominance(heat) == 1.0 and P.dominance(heat * 0) is None
    rows = spark.createDataFrame([("a", bytearray(ppm(picture))), ("b", bytearray(b"bad")), ("c", None)], "path string, content binary")
    got = {r.path: r.dhash for r in P.extract(rows).collect()}
    assert got == {"a": f["dhash"], "b": None, "c": None}


def test_accent():
    red = np.full((10, 10, 3), 0.5)
    red[:2] = [0.9, 0.1, 0.1]
    assert P.accent(red)[0] == 7.5 and P.accent(np.full((4, 4, 3), 0.5)) is None


def test_sinks(spark, tmp_path):
    df = spark.range(50).withColumn("p", F.col("id") % 2)
    path = f"file://{tmp_path}/t"
    t = S.BucketTable(spark, path, "id", 4)
    replace = lambda old, new: new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new)
    assert t.read() is None and t.merge(df.limit(0), replace) == 0
    assert t.merge(df, replace) == 1 and S.BucketTable(spark, path, "id").read().count() == 50
    before = t.state()[1]
    one = df.filter("id = 7").withColumn("p", F.lit(9).cast("long"))
    assert t.merge(one, replace) == 2 and sum(before[b] != f for b, f in t.state()[1].items()) == 1
    assert {r.id: r.p for r in t.read().collect()} == {i: 9 if i == 7 else i % 2 for i in range(50)}
    S.overwrite_scope(df, f"{path}2", "p")
    S.overwrite_scope(df.filter("id = 1"), f"{path}2", "p")
    assert spark.read.parquet(f"{path}2").count() == 26
    assert [len(c) for c in S.in_chunks(df.coalesce(1), 20)] == [20, 20, 10]
    S.write_report(df.limit(3), f"{path}3")
    assert S.read_report(spark, f"{path}3", "id long, p long").count() == 3
    out, v = S.migrate(df, 1, {1: None, 2: lambda d: d.withColumn("q", F.lit(1)), 3: lambda d: d.drop("p")})
    assert out.columns == ["id", "q"] and v == 3


def test_streaming_upserts(spark, tmp_path):
    schema = "id long, caption string, indexedat long"
    src, dst = str(tmp_path / "in"), f"file://{tmp_path}/table"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(src)
    seen = []
    for rows in ([(2, "B", 2), (2, "late", 1), (3, "c", None)], []):
        q = ingest.stream_upserts(spark, src, schema, dst, str(tmp_path / "cp"), lambda b, e: seen.append(e))
        q.awaitTermination()
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    assert {r.id: r.caption for r in S.BucketTable(spark, dst, "id").read().collect()} == {1: "a", 2: "B", 3: "c"} and len(seen) == 2
    ingest.merge_batch(spark.createDataFrame([(1, "a", 1)], schema), dst)
    assert S.BucketTable(spark, dst, "id").read().count() == 3


def test_cross_scores_only_between_new_and_old(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    new = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.8, 0.6])], "id long, vec array<double>")
    got = {(r.id, r.other) for r in ingest.cross_score(new, old, 1).collect()}
    assert got == {(1, 3), (2, 4), (3, 1), (4, 1)}
