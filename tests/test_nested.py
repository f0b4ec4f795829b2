import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.operators.nested import ARRAYS, CHILDREN, FIELDS, field_code, find_profile, flatten_batch, flatten_profiles, node_table, unwrap


def filled(x):
    return not (x is None or x == {} or x == [] or (isinstance(x, str) and not x.strip()))


def as_list(v):
    return v if isinstance(v, list) else [v]


def brute(profile):
    """Node rows of a decoded profile, one value at a time."""
    out = []

    def parts(node, path):
        if isinstance(node, dict):
            last = [v for k, v in node.items() if field_code(k) == len(FIELDS)]
            for j, x in enumerate(as_list(last[-1])) if last else ():
                if filled(x):
                    out.append((f"{path}.{CHILDREN}[{j}]", path))
                    parts(x, f"{path}.{CHILDREN}[{j}]")

    named = {}
    for k, v in profile.items():
        if 0 <= field_code(k) < len(FIELDS):
            named[field_code(k)] = v
    for c, v in named.items():
        if c == len(ARRAYS):
            if filled(v):
                out.append(("stance", "$"))
            continue
        for j, x in enumerate(as_list(v)):
            if filled(x):
                out.append((f"{FIELDS[c]}[{j}]", "$"))
                if FIELDS[c] == "objects":
                    parts(x, f"{FIELDS[c]}[{j}]")
    return sorted(out)


def flat(*texts):
    b = flatten_batch(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()))
    return sorted(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))


text = st.text(st.characters(codec="utf-8"), max_size=8)
scalar = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), text, st.sampled_from(["", " ", "\n", "{", '"', "a\\", "],[", "　"]))
thing = st.recursive(scalar, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from(["object", "register", "parts", "Parts", "x"]), v, max_size=3)), max_leaves=8)
names = st.sampled_from([*FIELDS, "SUBJECTS", "directedAt", "Objects", "confidence", "notes"])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(names, thing, max_size=5), st.booleans(), st.sampled_from([None, 0, 3]))
def test_kernel_equals_row_parsing(profile, ascii_only, indent):
    # two spellings of one field: the later one counts
    if not any(0 <= field_code(k) < len(FIELDS) for k in profile):
        profile["subjects"] = ["a"]
    assert flat(json.dumps(profile, ensure_ascii=ascii_only, indent=indent)) == brute(profile)


def test_wrapped_broken_and_empty_texts():
    p = {"subjects": ["a", None, " "], "objects": [{"object": "x", "parts": [{"object": "y", "PARTS": "z"}]}], "stance": {}}
    want = brute(p)
    assert want == [("objects[0]", "$"), ("objects[0].parts[0]", "objects[0]"), ("objects[0].parts[0].parts[0]", "objects[0].parts[0]"), ("subjects[0]", "$")]
    body = json.dumps(p)
    for wrapped in (body, f"﻿\n {body}\n", f"```json\n{body}\n```", json.dumps(body), json.dumps({"profile": p}), json.dumps({"ok": True, "data": [p]}), f'It\'s "odd: {body} Note: fine.', json.dumps({"r": body})):
        assert flat(wrapped) == want, wrapped
    for nothing in (body[:-3], body[:40], "", "  ", "null", "[]", "{}", "no braces", '{"other": [1]}', "{" * 50):
        assert flat(nothing) == [], nothing
    assert flat(None, body, None) == want
    assert unwrap("{") is None and find_profile(3) is None


def test_frame_nulls_copies_and_clashing_columns(spark):
    body = json.dumps({"claims": ["c"], "phenomena": [{"phenomenon": "sound", "role": "source"}, "heat"]})
    rows = [(1, body, "k"), (1, body, "k"), (2, None, "k"), (None, body, "k"), (3, "", None), (4, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "id long, roleprofile string, nodepath string")
    nodes = flatten_profiles(df, "id", "roleprofile")
    assert sorted((r.imageid, r.nodepath) for r in nodes.collect()) == [(1, "claims[0]"), (1, "phenomena[0]"), (1, "phenomena[1]")]
    ph = node_table(nodes, ["phenomena"], "phenomenon string, role string", "phenomenon")
    assert sorted((r.phenomenon, r.role) for r in ph.collect()) == [("heat", None), ("sound", "source")]
    assert flatten_profiles(df.limit(0), "id", "roleprofile").count() == 0
