import random
import re
from collections import Counter

import pytest

from tandem.llm import setjoin
from tandem.llm.setjoin import SketchParams, expand, set_classes, similar_classes
from tandem.llm.termcounts import TermCounts, changes, marked_terms, snapshot, term_deltas
from tandem.llm.topn import top_n
from tandem.runtime import fresh_path


def count(texts):
    occ, rec, n = Counter(), Counter(), 0
    for t in texts.values():
        toks = [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) >= 3]
        occ.update(toks)
        rec.update(set(toks))
        n += bool(toks)
    return {w: (occ[w], rec[w]) for w in occ}, n


def test_deltas_equal_counting_again(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "ÉTÉ", "of", "x1y2", "数字数字"]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(9))) for i in range(60)} | {900: None, 901: "", 902: " .,", 903: "alpha " * 20_000}
    schema, store = "id long, caption string, term string, sign int", TermCounts(spark, fresh_path(spark, "t"), 4)
    frame = lambda t: spark.createDataFrame([(i, c, "clash", 9) for i, c in t.items()] + [(i, c, "other", 9) for i, c in list(t.items())[:5]] + [(None, "lost words", "", 0)], schema)
    old = None
    for step in range(3):
        new = snapshot(frame(texts), "id", "caption")
        store.apply(term_deltas(changes(old, new)))
        want, n = count(texts)
        assert {r.term: (r.occurrences, r.records) for r in store.read().collect()} == want and store.total() == n and store.version() == step + 1
        old = new
        for i in list(texts)[:20]:
            texts[i] = rng.choice([None, "beta delta", texts[i]])
        texts.pop(next(iter(texts)))
        texts[1000 + step] = "epsilon alpha"
    none = snapshot(frame({}).limit(0), "id", "caption")
    store.apply(term_deltas(changes(old, none)))
    assert store.read().count() == 0 and store.total() == 0
    assert term_deltas(changes(None, none)).count() == 0 and TermCounts(spark, fresh_path(spark, "t")).read().count() == 0


def test_marks(spark):
    rows = spark.createDataFrame([("a", 9, 9), ("b", 2, 2), ("c", 3, 3), ("d", 8, 2)], "term string, occurrences long, records long")
    assert {r.term: r.mark for r in marked_terms(rows, 10).collect()} == {"a": "common", "b": "rare", "c": "common", "d": "rare"}
    assert {r.term: r.mark for r in marked_terms(rows, 15).collect()} == {"a": "common", "b": "rare", "c": None, "d": "rare"}


def test_top_n(spark):
    rng = random.Random(4)
    scores = [None, float("nan"), -1.0, 0.0, -0.0, 0.5, 0.5, float("inf")]
    rows = [(rng.choice([1] * 5 + [2, 3, None]), rng.choice(["p", "q", None]), rng.choice(scores), rng.choice([None, *range(9)]), i, i) for i in range(1500)]
    rows += rows[:300]
    df = spark.createDataFrame(rows, "g long, h string, score double, tie long, id long, position long").repartition(9)
    got = top_n(df, ["g", "h"], "score", ["tie", "id"], 3, copies=["g", "h", "score", "tie", "id"])
    want = {}
    for r in set(rows):
        if r[2] is not None and r[2] == r[2]:
            want.setdefault(r[:2], []).append((-(r[2] + 0.0), r[3] is None, r[3] or 0, r[4]))
    assert sorted((r.g, r.h, r.position, r.id) for r in got.collect() if r.g and r.h) == sorted((g, h, n, x[3]) for (g, h), v in want.items() if g and h for n, x in enumerate(sorted(v)[:3], 1))
    assert got.count() == sum(min(3, len(v)) for v in want.values())
    kept = top_n(df, ["g"], "score", ["tie", "id"], 2)
    assert kept.filter("g = 1").count() == 2
    assert top_n(df.limit(0), ["g"], "score", ["id"], 3).count() == 0


def brute(sets, limit):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize("limit,width,least", [(0.8, 20, 12), (0.7, 16, 8)])
def test_set_join(spark, limit, width, least):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    sets = {}
    for i in range(0, 400, 8):
        base = rng.sample(words, rng.randrange(least - 2, 24))
        for j in range(8):
            s = set(base)
            for _ in range(rng.randrange(4)):
                s.discard(rng.choice(base))
                s.add(rng.choice(words))
            sets[i + j] = s
    rows = [(i, [*s, None, *list(s)[:2]], "x") for i, s in sets.items()] + [(5, list(sets[5]), "y"), (9000, None, "z"), (9001, [], "z"), (None, words[:20], "z")]
    df = spark.createDataFrame(rows, "id long, items array<string>, key string")
    classes, members = set_classes(df, "id", "items", least)
    p = SketchParams(limit, width)
    want = brute({i: s for i, s in sets.items() if len(s) >= least}, limit)
    got = {(r.id_lo, r.id_hi) for r in expand(similar_classes(classes, p), members).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert expand(*(lambda c, m: (similar_classes(c, p), m))(*set_classes(df.limit(0), "id", "items", least))).count() == 0


def test_large_class_of_copies_stays_linear(spark):
    a, b = [f"w{i}" for i in range(15)], [f"w{i}" for i in range(16)]
    df = spark.createDataFrame([(i, a) for i in range(200)] + [(i, b) for i in range(200, 203)], "id long, items array<string>")
    classes, members = set_classes(df, "id", "items", 12)
    got = {(r.id_lo, r.id_hi) for r in expand(similar_classes(classes, SketchParams(0.8, 20)), members, whole=64).collect()}
    assert got == {(0, i) for i in range(1, 203)} | {(200, 201), (200, 202), (201, 202)}


def test_texts_of_a_large_class_are_paired_and_copies_linked(spark):
    words, other = [f"w{i}" for i in range(15)], [f"w{i}" for i in range(16)]
    rows = [(i, words, f"text {i % 3}") for i in range(90)] + [(90, other, "o")]
    df = spark.createDataFrame(rows, "id long, items array<string>, text string")
    classes, members = set_classes(df, "id", "items", 12, text_col="text")
    got = {(r.id_lo, r.id_hi) for r in expand(similar_classes(classes, SketchParams(0.8)), members, whole=64).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (0, 90), (1, 90), (2, 90)} | {(i % 3, i) for i in range(3, 90)}


def test_hot_segments_and_kinds(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    sets = {i: set(words[:14]) | set(rng.sample(words[14:], 2)) for i in range(60)}
    rows = [(i, k, list(s)) for i, s in sets.items() for k in (0, 1)]
    df = spark.createDataFrame(rows, "id long, kind int, items array<string>")
    classes, members = set_classes(df, "id", "items", {0: 12, 1: 99}, "kind")
    want = brute(sets, 0.7)
    params = {0: SketchParams(0.7), 1: SketchParams(0.5)}
    for hot in (setjoin.HOT, 3):
        monkeypatch.setattr(setjoin, "HOT", hot)
        got = {(r.kind, r.id_lo, r.id_hi) for r in expand(similar_classes(classes, params), members).collect()}
        assert {k for k, _, _ in got} == {0} and {g[1:] for g in got} <= want and len(got) >= 0.99 * len(want)


def test_width_grows_with_the_sets():
    widths = [SketchParams(0.8).fitted(n, 20).width for n in (10**3, 10**5, 10**7, 10**9)]
    assert widths == sorted(widths) and widths[0] < widths[-1] <= 40


def test_tiles_give_every_pair_once(spark):
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(40 * g)], "g int, m long")
    got = [tuple(r) for r in setjoin.all_pairs(df, ["g"], "m", block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, i, j) for g in (1, 2) for i in range(40 * g) for j in range(i + 1, 40 * g)}
