import random
from dataclasses import replace

import pytest

from tandem.llm import mojibake as M

CLEAN = ["Das Fenster über dem Café spiegelt die Häuser", "La niña con la máscara contradice el cartel", "It’s the diver’s gaze that carries the picture", "Où mène ce regard ? Vers la fenêtre fermée", "Così la città è già vuota", "“Awe without irony” is how it reads – and more"]
SOUND = ["ATENÇÃO: a REVISÃO fica para amanhã", "│   ├── 596\n│   └── 76", "Ð and Þ on the harbour sign", "then ÀÉÎÕÜ as a type sample", "Пара держится на взгляде, а не на цвете", "Το φως πέφτει στη βάρκα", "左の写真は静かで", "«\xa0awe\xa0», écrit-elle", "CAFÉ “X”", "plain ascii", "", None]


@pytest.mark.parametrize("page", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_misread_and_back(page):
    learned = M.Learned((page,), frozenset("üéäñá’ùêìàè“”–ö"), True)
    fix = learned.repairer()
    for t in CLEAN:
        once = M.HIGH.sub(lambda m: M.misread(m.group(), "utf_8", page), t)
        twice = M.HIGH.sub(lambda m: M.misread(m.group(), "utf_8", page), once)
        assert fix(once) == t and fix(t) == t and fix(twice) == t
        for run in M.HIGH.findall(t):
            assert f"utf_8>{page}" in M.explanations(M.misread(run, "utf_8", page), run)


def test_learns_from_twins_and_applies(spark):
    rng = random.Random(3)
    rows, bad, want = [], set(), {}
    n = 0
    for turn in range(40):
        for t in CLEAN:
            kind = rng.choice([None, None, "cp1252", "mac_roman", "lost", "controls"]) if turn > 2 else None
            out = t
            if kind in ("cp1252", "mac_roman"):
                out = M.HIGH.sub(lambda m: M.misread(m.group(), "utf_8", kind), t)
            elif kind == "lost":
                out = M.HIGH.sub(lambda m: "�" * len(m.group()), t)
            elif kind == "controls":
                out = M.HIGH.sub(lambda m: M.misread(m.group(), "cp1252", "latin_1") or m.group(), t)
            if out != t:
                bad.add(n)
                want[n] = t
            rows.append((n, out, "x"))
            n += 1
    for t in SOUND:
        rows += [(n, t, "x"), (n + 1, t, "x")]
        n += 2
    # a text no twin exists for, garbled in a way the others teach, inside a very long text
    rows.append((n, "Für später: " + "x " * 50_000 + "gehÃ¶rt die Brücke", "x"))
    bad.add(n)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, restored string, key string")
    learned, report, both = M.learn(df)
    assert set(learned.pages) == {"cp1252", "mac_roman"} and learned.controls and report.count() > 0
    got = M.judged(df, learned).filter("garbled")
    assert {r.doc_id for r in got.collect()} == bad
    fixed = {r.doc_id: r.restored for r in M.restore_lost(got.select("doc_id", "restored"), both).collect()}
    assert set(fixed) == bad
    ok = sum(fixed[i] == t for i, t in want.items())
    assert ok >= 0.95 * len(want)


def test_empty_and_sound_collections(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SOUND)], "doc_id long, text string")
    learned, _, both = M.learn(df)
    assert learned.pages == () and M.judged(df, learned).filter("garbled").count() == 0
    learned, _, both = M.learn(df.limit(0))
    assert M.judged(df.limit(0), learned).count() == 0
    assert M.restore_lost(M.judged(df, learned).filter("garbled").select("doc_id", "restored"), both).count() == 0


LATIN = ["The café naïve on the pier {} again", "Un été à la plage {} was déjà vu", "Die Häuser über dem Öl {} near the Tür", "El niño señala el cartel {} in the año nuevo"]
OTHER = {"cp1251": ["Photo of the кафе by the пристань {} again", "The вывеска over the рынок {} seen at night"], "koi8_r": ["A старая лодка near the берег {} in fog", "The тихий двор with the кошка {} below"], "cp1253": ["The μικρή βάρκα in the λιμάνι {} again", "A παλιά πόρτα near the δρόμος {} at noon"]}


def test_single_byte_misreadings_are_learned_found_and_restored(spark):
    """All twelve planted in one collection; each shows in windows whose clean twins are much more frequent."""
    rows, want, n = [], {}, 0
    for written, read in M.SINGLE_BYTE:
        for t in OTHER.get(written, LATIN):
            for i in range(3):
                text = t.format(f"frame{i}")
                bad = M.HIGH.sub(lambda m: M.misread(m.group(), written, read) or m.group(), text)
                if bad != text:
                    want[n] = text
                rows.append((n, bad))
                n += 1
    sound = []
    for t in (*LATIN, *(x for v in OTHER.values() for x in v)):
        for i in range(3):
            sound += [t.format(f"frame{i}")] * 60
    sound += ["a «quoted» word on the wall", "a “quoted” word on the wall", "ещё one берег", "еще one берег"] * 5
    df = spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(sound)], "doc_id long, text string")
    learned, _, both = M.learn(df)
    assert len(learned.tables) >= 8
    got = {r.doc_id: r.restored for r in M.judged(df, learned).filter("garbled").collect()}
    assert not [i for i in got if i >= 10_000]
    assert len(got) >= 0.95 * len(want) and sum(got.get(i) == t for i, t in want.items()) >= 0.9 * len(want)


def test_a_table_outside_the_list_is_learned_from_what_is_seen(spark):
    secret = str.maketrans("éàüñ", "ŁŦĦŊ")
    texts = ["Un été à la plage by the pier", "déjà vu à l’été on the wall", "über señor in the café à midi"]
    rows = [(i * 3 + j, t) for i in range(40) for j, t in enumerate(texts)] + [(900 + 3 * i + j, t.translate(secret)) for i in range(2) for j, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned, _, _ = M.learn(df)
    assert "as seen" in dict(learned.tables)
    got = {r.doc_id: r.restored for r in M.judged(df, learned).filter("garbled").collect()}
    assert got == {900 + 3 * i + j: t for i in range(2) for j, t in enumerate(texts)}
    joined = M.judged(df, replace(learned, most_held=0)).filter("garbled")
    assert {r.doc_id: r.restored for r in joined.collect()} == got
