import pandas as pd
from pyspark.sql import functions as F

from tandem.functions import plugins as P


def test_models_failures_and_batches(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", "old") for i in range(200)], "id long, caption string, said string").coalesce(1)

    def down(batch: pd.DataFrame):
        if batch.caption.iloc[0] == "c1":
            raise ConnectionError
        return batch.caption.str.upper()

    got = P.with_model(df, ["caption"], down, "said", "string", rows=1)
    said = {r.id: r.said for r in got.collect()}
    assert len(said) == 200 and said[0] == "C0" and said[1] is None and said[2] == "C2"
    always = P.with_model(df, ["caption"], lambda b: (_ for _ in ()).throw(TimeoutError()), "said", "string", rows=8)
    assert always.filter("said IS NOT NULL").count() == 0
    assert P.with_model(df.limit(0), ["caption"], P.no_caption, "said", "string").count() == 0
    once = P.once_per(df, "caption", ["id"], lambda b: [len(b)] * len(b), "n", "int")
    assert once.count() == 200 and once.filter("n IS NULL").count() == 0
    e = P.with_model(spark.createDataFrame([(60, 40)], "width int, height int"), ["width", "height"], P.mock_embeddings, "v", "array<double>").first().v
    assert len(e) == 512


def test_probes_lookers_and_json(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    yes, no = F.array(F.lit("Yes "), F.lit("yes")), F.array(F.lit("yes"), F.lit(None))
    assert one(P.all_pass(yes), P.all_pass(no), P.all_pass(F.lit(None).cast("array<string>"))) == (True, False, False)
    k = F.lit("source_receiver")
    assert one(P.probed_confidence(F.lit(0.6), k, F.lit(True), F.lit(True)), P.probed_confidence(F.lit(0.9), k, F.lit(True), F.lit(False)), P.probed_confidence(F.lit(0.9), k, F.lit(False), F.lit(True))) == (0.95, 0.75, 0.0)
    left = lambda *v: one(P.looker_is_left(*(F.lit(x).cast("double") for x in v)))[0]
    assert left(0.3, 1, 0.9, 2) and not left(0.1, 1, 0.3, 1) and left(0.3, 1, 0.3, 1) and left(None, None, None, None)
    fix = lambda t: one(P.repaired_json(F.lit(t), "a int, b string"))[0]
    assert fix('```json\n{"a": 1, "b": "x"}\n``` done') == (1, "x") and fix('{"a": 1, "b": "cut o').a == 1 and fix("none") is None
