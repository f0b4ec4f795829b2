import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.functions import clusters as C
from tandem.functions import evidence as E
from tandem.functions import kernels as K
from tandem.functions import text as X
from tandem.functions import vocab
from tandem.operators import dupes, gaze, greedy, mutations, roles
from tandem.plans.blocked import best_pairs


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize(
    "ha,sa,hb,sb,want",
    [(7.5, 0.71, 7.5, 0.61, math.sqrt(0.71 * 0.61)), (22.5, 0.82, 22.5, 0.37, 0), (22.5, 0.82, 22.5, 0.84, math.sqrt(0.82 * 0.84)), (22.5, 0.80, 22.5, 0.55, math.sqrt(0.44) * 0.5), (202.5, 0.9, 202.5, 0.4, math.sqrt(0.36)), (22.5, 0.4, 7.5, 0.9, 0), (None, 0.4, 7.5, 0.9, 0)],
)
def test_accent_echo(spark, ha, sa, hb, sb, want):
    got = one(spark, K.accent_echo(*(F.lit(x).cast("double") for x in (ha, sa, hb, sb))))[0]
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("a,b,want", [("63-foo.jpg", "foo.jpg", True), ("foo-2.jpg", "FOO.jpg", True), ("00-20250504-_R017085.jpg", "20250504-_R017085.jpg", True), ("foo.jpg", "foo.jpg", False), ("", "foo.jpg", False), (None, "foo.jpg", False), ("a.jpg", "b.jpg", False)])
def test_filename_variants(spark, a, b, want):
    assert one(spark, X.filename_variants(F.lit(a).cast("string"), F.lit(b).cast("string")))[0] is want


@pytest.mark.parametrize("gap,penalty,burst", [(0, 0.4, True), (30, 0.4, True), (31, 0.55, True), (120, 0.75, True), (300, 0.9, True), (301, 1.0, False), (3600, 1.0, False), (None, 1.0, False)])
def test_time_kernels(spark, gap, penalty, burst):
    a, b = F.lit(1000.0), F.lit(None if gap is None else 1000.0 + gap).cast("double")
    assert one(spark, K.temporal_penalty(a, b), K.is_burst(a, b, F.lit(False))) == (penalty, burst)


@pytest.mark.parametrize("gap,want", [(300, 1.0), (301, 0.7), (1800, 0.7), (1801, 0.8), (7200, 0.8), (7201, 0.9), (21600, 0.9), (21601, 1.0), (None, 1.0)])
def test_event_factor(spark, gap, want):
    b = F.lit(None if gap is None else float(gap)).cast("double")
    assert one(spark, K.event_factor(F.lit(0.0), b, F.lit(True)), K.event_factor(F.lit(0.0), b, F.lit(False))) == (want, 1.0)


def test_cosine_and_hamming(spark):
    e0, e1 = F.array(*lit(1.0, 0.0)), F.array(*lit(0.0, 1.0))
    assert one(spark, K.clip_similarity(e0, e1), K.cosine01(e0, e0), K.clip_similarity(e0, F.array(F.lit(1.0))), K.cosine01(e0, F.array(*lit(0.0, 0.0)))) == (0.5, 1.0, 0.0, 0.0)
    assert one(spark, K.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000000")), K.hamming(F.lit("ff"), F.lit("FE")), K.hamming(F.lit("zz"), F.lit("00")), K.hamming(F.lit(None).cast("string"), F.lit("00"))) == (64, 1, 64, 64)


def test_gaze_kernels(spark):
    c = [one(spark, K.gaze_clarity(F.lit(g), F.lit(0.2)))[0] for g in (0.22, 0.3, 0.5, 0.9)]
    assert c == sorted(c) and min(c) >= 0.60 and max(c) <= 0.95
    assert one(spark, K.gaze_conversation(F.lit(0.3), F.lit(-0.3)), K.gaze_conversation(F.lit(-0.3), F.lit(0.3))) == (1.0, 0.0)


def test_clusters(spark, tmp_path):
    rows = vocab.default_rows()
    assert len(vocab.CLUSTER_WEIGHTS) == 30 and {c for c, _, _ in rows} == set(vocab.CLUSTER_WEIGHTS) and len(set(rows)) == len(rows) <= 200
    assert len(vocab.AXIS_PAIRS) == 9 and len(vocab.SUFFIXES) == 18 and {c for c, g, _ in rows if g} == set(vocab.TWO_SIGNAL)
    fire = lambda s: one(spark, C.caption_clusters(F.lit(s).cast("string"), rows))[0]
    assert fire("a bench of regret near the street") == ["grief_sorrow", "urban_street"]
    assert fire("orchard yawns") == ["nature_landscape", "stillness_rest"]
    assert fire("so much humor") == [] and fire("humor of the absurdity") == ["humor_absurdity"] and fire(None) == [] and fire("") == []
    (tmp_path / "voc.tsv").write_text("tea\t0\tpot\ntea\t1\tcup\n")
    spark.conf.set(vocab.CONF, str(tmp_path / "voc.tsv"))
    try:
        assert vocab.rows(spark) == (("tea", 0, "pot"), ("tea", 1, "cup"))
    finally:
        spark.conf.unset(vocab.CONF)
    assert vocab.rows(spark) == rows
    dice = lambda a, b: one(spark, C.weighted_dice(F.array(*lit(*a)), F.array(*lit(*b))))[0]
    assert dice(["community_gathering", "grief_sorrow"], ["grief_sorrow", "urban_street"]) == pytest.approx(2 / 2.4)
    assert dice(["urban_street"], ["urban_street"]) == 0.1
    own = [("mine", 0, "teapot")]
    assert one(spark, C.caption_clusters(F.lit("A teapot"), own))[0] == ["mine"]


def test_stem(spark):
    words = ["running", "nation", "celebration", "cats", "gentle", "ties", "played", "a" * 300_000]
    got = one(spark, F.transform(F.array(*lit(*words)), X.stem))[0]
    assert got[:7] == ["runn", "nation", "celebr", "cats", "gentle", "ties", "play"]


def loop_cap2(edges):
    seen, first, second = set(), [], []
    for p, a, b in edges:
        if a not in seen and b not in seen:
            first.append(p)
            seen |= {a, b}
    used = set()
    for p, a, b in edges:
        if (a not in seen or b not in seen) and a not in used and b not in used:
            second.append(p)
            used |= {a, b}
    return {(p, 1) for p in first} | {(p, 2) for p in second}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    edges = [(i, a, b) for i in range(300) if (a := rng.randrange(40)) != (b := rng.choice([0, rng.randrange(40)]))]
    df = spark.createDataFrame(edges, "pos long, a long, b long")
    for finish in (0, 100_000):
        assert {(r.pos, r.turn) for r in greedy.cap_two(df, finish).collect()} == loop_cap2(edges)
    caps, left, want = {1: 3, 2: 1}, {}, set()
    for p, a, b in edges:
        k = 1 + p % 2
        if left.get((a, k), caps[k]) > 0 and left.get((b, k), caps[k]) > 0:
            want.add(p)
            left[a, k], left[b, k] = left.get((a, k), caps[k]) - 1, left.get((b, k), caps[k]) - 1
    kinds = df.withColumn("kind", (1 + F.col("pos") % 2).cast("int"))
    for finish in (0, 100_000):
        assert {r.pos for r in greedy.capped_greedy(kinds, caps, finish).collect()} == want


def test_hamming_pairs_and_components(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = base + [h ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 10))) % 2**64 for h in base for _ in range(3)]
    rows = [(i, f"{h % 2**64:016x}") for i, h in enumerate(hashes)] + [(500, None), (501, "nohash"), (0, f"{hashes[0]:016x}")]
    df = spark.createDataFrame(rows, "id long, dhash string")
    classes, members = dupes.hash_classes(df)
    got = {(r.a, r.b): r.distance for r in dupes.hamming_pairs(classes, 8).collect()}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h % 2**64, i)
    want = {(min(i, j), max(i, j)): bin(x ^ y).count("1") for x, i in first.items() for y, j in first.items() if i < j and bin(x ^ y).count("1") <= 8}
    assert got == want
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (3, 4), (5, 4)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    roots = {r.id: r.root for r in dupes.components(edges).collect()}
    assert roots == {**dict.fromkeys((1, 2, 3, 4, 5), 1), **dict.fromkeys((7, 8, 9), 7), **dict.fromkeys(range(100, 141), 100)}
    assert dupes.components(edges.limit(0)).count() == 0
    assert dupes.duplicate_groups(df.limit(0)).count() == 0


def test_role_rules(spark):
    violin = '{"phenomena":[{"phenomenon":"music","role":"source"}],"claims":["danger"]}'
    ears = '{"phenomena":[{"phenomenon":"sound","role":"receiver"}],"subverts":["noise"]}'
    passive = '{"phenomena":[{"phenomenon":"sound","role":"receiver"}]}'
    gun = '{"objects":[{"object":"Gun","register":"real","category":"weapon"}]}'
    water = '{"objects":[{"object":"gun","register":"toy","category":"toy"}]}'
    smile, smiling = '{"claims":["Smile please"]}', '{"enacts":["a smile"]}'
    miss, tender = '{"claims":["miss"]}', '{"enacts":["tenderness"]}'
    broken = '{"claims":["smile", null], "phenomena":[{"phenomenon":"sound"}]}'
    texts = [violin, ears, passive, gun, water, smile, smiling, miss, tender, broken, None, "not json", '{"claims": "smile"}']
    prof = roles.profiles(spark.createDataFrame(list(enumerate(texts)), "id long, roleprofile string"))
    pairs = [(0, 0, 1), (1, 0, 2), (2, 3, 4), (3, 0, 3), (4, 5, 6), (5, 6, 5), (6, 7, 8), (7, 9, 6), (8, 3, 8), (9, 12, 6)]
    got = {r.id: (r.priority, r.kind, r.key) for r in roles.connect(spark.createDataFrame(pairs, "id long, a long, b long"), prof).collect()}
    assert got == {0: (1, "phenomenon", "sound"), 2: (3, "object", "gun"), 3: (4, "category", "weapon"), 4: (2, "concept", "Smile please"), 5: (2, "concept", "Smile please"), 6: (2, "concept", "miss")}
    freq = {(r.kind, r.key): r.df for r in roles.frequencies(prof).collect()}
    assert freq["phenomenon", "sound"] == 3 and freq["concept", "smile"] == 2 and freq["object", "gun"] == 2


def test_gaze_nomination():
    rows = [(1, 0.30, None, None, 1, 1, None), (2, None, 0.2, None, 0, 0, 1.0), (3, -0.5, None, None, 1, 1, None), (4, None, 0.9, None, 0, 0, 0.9), (5, 0.9, None, None, 2, 1, None), (6, 0.9, None, None, 1, None, None)]
    df = pd.DataFrame(rows, columns=["id", "gaze", "x", "date", "faces", "humans", "dominance"])
    want = {(1, 2, 1), (4, 3, 3)}
    for frame in (df, df.iloc[::-1], pd.concat([df, df])):
        assert {(r.leftid, r.rightid, r.lookerid) for r in gaze.nominate(frame).itertuples()} == want
    many = pd.DataFrame([(i, 0.3 + i / 1000, None, None, 1, 1, None) for i in range(10)] + [(100 + i, None, 0.1, None, 0, 0, 1.0) for i in range(3)], columns=df.columns)
    got = gaze.nominate(many)
    assert got.groupby("rightid").size().max() <= 3 and got.groupby("lookerid").size().max() <= 4
    assert len(gaze.nominate(df.iloc[:0])) == 0


def test_evidence(spark):
    m = lambda q, c: one(spark, E.quote_matches(F.lit(q).cast("string"), F.lit(c).cast("string")))[0]
    cap = "Two mannequins, one dressed in red, hold hands. A sign says “DO IT”. It’s late."
    assert m("Two mannequins hold hands", cap) and m("'do it'", cap) and m("it's late", cap)
    assert not m("mannequins says late", cap) and not m("", cap) and not m(None, cap) and not m("x", None) and not m("hands sign do", cap)
    assert E.quoted_regions('the "A B" and \'I CAN\'T BREATHE\' of mannequins\' hands') == ["a b", "i can't breathe"]
    assert E.sign_region("sign reads DO IT now", cap) == "do it" and E.sign_region("hold hands", cap) is None
    a, b = 'A board reads "SMILE FOREVER".', "A woman smiling in the rain."
    rows = [
        (1, 0, "real_vs_depicted", "SMILE FOREVER", "A woman smiling", True, True, "", a, b),
        (2, 0, "source_receiver", "a drum", "covers his ears", True, False, "", "He beats a drum.", "She covers his ears."),
        (3, 0, "real_vs_depicted", "a bus", "a painting of a bus", False, False, "", "There is a bus.", "There is a painting of a bus."),
        (4, 0, "real_vs_depicted", "a bus", "a car", False, False, "", "There is a bus.", "There is a car."),
        (5, 0, "text_vs_world", "a bus", "a car", False, False, "", "There is a bus.", "There is a car."),
        (6, 0, "gesture_echo", "waves", "waves", False, False, "", "She waves.", "He waves."),
        (6, 1, "same_subject_reversal", "not there", "waves", True, True, "", "She waves.", "He waves."),
    ]
    f = spark.createDataFrame(rows, "pairid long, pos int, kind string, quoteA string, quoteB string, explicitA boolean, explicitB boolean, note string, captionA string, captionB string")
    got = {r.pairid: (r.connected, r.confidence, r.relationship) for r in E.verdicts(E.verify(f)).collect()}
    assert got == {1: (True, 0.95, "ironic"), 2: (True, 0.75, "complementary"), 3: (True, 0.90, "contrastive"), 4: (False, 0.0, "none"), 5: (False, 0.0, "none"), 6: (True, 0.70, "echo")}


def test_findings_and_captions(spark):
    ok = '```json\n{"findings":[{"kind":"gesture_echo","quoteA":"a","quoteB":"b"},{"kind":"other","quoteA":"a","quoteB":"b"},{"kind":"gesture_echo","quoteA":"a"}]}\n```'
    got = [len(one(spark, E.parse_findings(F.lit(t).cast("string")))[0]) for t in (ok, None, "", "{", "{}")]
    assert got == [1, 0, 0, 0, 0]
    s = lambda t: one(spark, E.strip_opener(F.lit(t)))[0]
    assert s("The image shows a woman who waits for rain.") == "A woman who waits for rain." and s("The image shows a cat.") == "The image shows a cat."


def test_mutations(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    inc = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "id long, v string")
    got = {r.id: (r.v, r.outcome) for r in mutations.upsert(cur, inc, ["id"]).collect()}
    assert got == {1: ("a", "untouched"), 2: ("B", "changed"), 3: (None, "unchanged"), 4: ("d", "inserted")}
    again = mutations.upsert(mutations.upsert(cur, inc, ["id"]).drop("outcome"), inc, ["id"])
    assert again.filter("outcome IN ('inserted', 'changed')").count() == 0
    assert mutations.insert_new(cur, inc, ["id"]).count() == 4
    left = mutations.delete_cascade(cur, inc.select("id"), "id", {"kids": (spark.createDataFrame([(1, 1), (2, 2)], "k long, ref long"), "ref")})
    assert left[""].count() == 1 and [r.ref for r in left["kids"].collect()] == [1]
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 9), (3, 8, 9)], "id long, a long, b long")
    kept = mutations.replace_scope(pairs, spark.createDataFrame([(1,), (2,)], "id long"), pairs.limit(0), "intra")
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    for n in (0, 3, 10, 250, 750):
        s = mutations.slots(n)
        assert sum(s) >= min(n, 1) and (n < 10 or abs(sum(s) - n) <= 5) and (n < 10 or min(s) >= 1)


def test_blocked_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), [rng.uniform(-1, 1) for _ in range(8)], i % 3 == 0) for i in range(120)] + [(500, None, [0.0] * 8, True), (501, "a", None, True)]
    df = spark.createDataFrame(rows, "id long, scope string, vec array<double>, isnew boolean")
    for only_new in (False, True):
        got = {(r.id, r.other): r.rank for r in best_pairs(df, 3, block=16, only_new=only_new).collect()}
        want = {}
        for i, s, v, n in rows[:120]:
            c = sorted((-round(sum(x * y for x, y in zip(v, v2)), 9), j) for j, s2, v2, n2 in rows[:120] if j != i and s == s2 and (not only_new or n != n2))
            want.update({(i, j): k for k, (_, j) in enumerate(c[:3], 1)})
        assert got == want
    assert best_pairs(df.limit(0), 3).count() == 0
