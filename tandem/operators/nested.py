"""Deeply nested profile texts to flat node rows, over whole Arrow batches at a time.

A batch of texts is one byte buffer with row offsets.  Quotes, brackets and separators are located
in it by array operations; depths are prefix sums; the container of every value is a parent index
found by one sort.  Child tables are then emitted level by level: list offsets give the element
numbers, and ids and paths of the parents are handed down by vectorised take.  Only texts that are
not an object as they stand (string-encoded, unbalanced around the object) are unwrapped one by one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAYS = ("subjects", "phenomena", "claims", "enacts", "subverts", "objects", "directed_at")
SINGLE = "stance"
FIELDS = (*ARRAYS, SINGLE)
CHILDREN = "parts"
NODES = T.StructType(
    [
        T.StructField("imageid", T.LongType()),
        T.StructField("nodepath", T.StringType()),
        T.StructField("parentpath", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("element", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("node", T.StringType()),
    ]
)
_CODE = {f.replace("_", ""): i for i, f in enumerate((*FIELDS, CHILDREN))}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def field_code(name: str) -> int:
    """Number of a field name, whatever its case and underscores; -1 for others."""
    return _CODE.get(name.replace("_", "").lower(), -1)


@dataclass
class Values:
    """Every value of a batch: ``row``, byte span [start, end), ``kind`` (first byte; 0 where a slot is empty), the
    parent container, its own container (-1 for scalars), element number, and field code of its key (-1)."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    own: np.ndarray
    element: np.ndarray
    code: np.ndarray
    filled: np.ndarray
    is_array: np.ndarray
    open_row: np.ndarray
    open_depth: np.ndarray
    open_is_obj: np.ndarray
    good: np.ndarray


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> Values:
    n, rows = len(buf), len(offsets) - 1
    row_at = lambda pos: np.repeat(np.arange(rows), np.diff(np.searchsorted(pos, offsets)))
    q = np.nonzero(buf == 34)[0]
    slashes = np.nonzero(buf == 92)[0]
    if len(slashes):
        # a quote is escaped after an odd run of backslashes
        ends = np.concatenate([[True], np.diff(slashes) > 1])
        run_start = slashes[np.maximum.accumulate(np.where(ends, np.arange(len(slashes)), 0))]
        at = np.searchsorted(slashes, q) - 1
        follows = (at >= 0) & (slashes[np.maximum(at, 0)] == q - 1)
        begin = np.maximum(run_start[np.maximum(at, 0)], offsets[row_at(q)])
        q = q[~(follows & ((q - begin) % 2 == 1))]
    q_first = np.searchsorted(q, offsets)
    quotes = np.diff(q_first)
    good = quotes % 2 == 0
    is_token = np.zeros(256, bool)
    is_token[list(b"{}[]:,")] = True
    t = np.nonzero(is_token[buf])[0]
    t_row = row_at(t)
    marks = np.zeros(n + 1, np.int8)
    marks[q] = 1
    inside = (np.cumsum(marks, dtype=np.int32)[t] - q_first[t_row]) % 2 == 1
    t, t_row = t[~inside], t_row[~inside]
    ch = buf[t]
    opens, closes = (ch == 123) | (ch == 91), (ch == 125) | (ch == 93)
    step = opens.astype(np.int64) - closes
    run = np.cumsum(step)
    first = np.searchsorted(t, offsets)
    base = np.concatenate([[0], run])[first[:-1]]
    depth = run - base[t_row]  # after the token
    level = np.where(opens, depth - 1, depth)  # of the container the token stands in
    total = np.concatenate([[0], run])[first[1:]] - base
    good &= total == 0
    low = np.zeros(rows, np.int64)
    np.minimum.at(low, t_row, depth)
    good &= low >= 0
    o = np.nonzero(opens)[0]
    open_id = np.full(len(t), -1, np.int64)
    open_id[o] = np.arange(len(o))
    # Parent index: tokens at level L follow, in order of position, the bracket that opened level L, so every
    # opening bracket stands twice: where it is a value, and one level below as the head of its container.
    twice = np.repeat(np.arange(len(t)), 1 + opens)
    is_open = np.zeros(len(twice), bool)
    is_open[1:] = twice[1:] == twice[:-1]
    span = int(level.max(initial=0)) + 2
    key = t_row[twice] * span + np.clip(level[twice] + is_open, 0, None)
    order = np.argsort(key.astype(np.uint16) if rows * span < 65536 else key, kind="stable")
    s_key, s_tok, is_open = key[order], twice[order], is_open[order]
    last = np.maximum.accumulate(np.where(is_open, np.arange(len(order)), -1)) if len(order) else np.zeros(0, np.int64)
    same = (last >= 0) & (s_key[last] == s_key)
    s_parent = np.where(same, open_id[s_tok[last]] if len(order) else 0, -1)
    commas = np.cumsum((ch[s_tok] == 44) & ~is_open)
    s_count = commas - np.where(same, commas[last], 0)
    parent, number = np.full(len(t), -1, np.int64), np.zeros(len(t), np.int64)
    parent[s_tok[~is_open]] = s_parent[~is_open]
    number[s_tok[~is_open]] = s_count[~is_open]
    # brackets must close by their own kind: a closing one belongs to the container it closes
    obj = ch[o] == 123
    key_of = lambda k: (lambda z: z.astype(np.uint16) if rows * span < 65536 else z)(t_row[k] * span + np.clip(level[k], 0, None))
    # opens and closes of one (row, level) alternate in order of position
    oc = np.nonzero(opens | closes)[0]
    oc = oc[np.argsort(key_of(oc), kind="stable")]
    pairs_ok = np.zeros(len(oc), bool)
    if len(oc) > 1:
        a, b = oc[:-1], oc[1:]
        pairs_ok[1:] = opens[a] & closes[b] & (t_row[a] == t_row[b]) & (level[a] == level[b]) & (ch[b] - ch[a] == 2)
    bad_close = oc[closes[oc] & ~pairs_ok]
    good[t_row[bad_close]] = False
    close_pos = np.full(len(o), -1, np.int64)
    hit = np.nonzero(pairs_ok)[0]
    close_pos[open_id[oc[hit - 1]]] = t[oc[hit]]
    # a value slot begins at '[', at ',' in an array and at ':' in an object
    in_array = (parent >= 0) & ~obj[np.maximum(parent, 0)]
    in_object = (parent >= 0) & obj[np.maximum(parent, 0)]
    slot = (ch == 91) | ((ch == 44) & in_array) | ((ch == 58) & in_object)
    s = np.nonzero(slot & good[t_row])[0]
    holder = np.where(ch[s] == 91, open_id[s], parent[s])
    element = np.where(ch[s] == 91, 0, number[s])
    padded = np.concatenate([buf, np.zeros(2, np.uint8)])

    def skip(pos: np.ndarray) -> np.ndarray:
        """The first place from ``pos`` on that is no white space."""
        pos = pos.copy()
        go = np.nonzero(_SPACE[padded[pos]])[0]
        while len(go):
            pos[go] += 1
            go = go[_SPACE[padded[pos[go]]]]
        return pos

    start = skip(t[s] + 1)
    kind = padded[start]
    empty_slot = (kind == 93) | (kind == 125) | (kind == 44) | (start >= offsets[t_row[s] + 1])
    is_str, is_box = kind == 34, (kind == 123) | (kind == 91)
    qi = np.searchsorted(q, start)
    str_end = q[np.minimum(qi + 1, max(len(q) - 1, 0))] if len(q) else np.zeros(len(s), np.int64)
    own = np.full(len(s), -1, np.int64)
    open_pos = t[o]
    if len(o):
        own[is_box] = np.searchsorted(open_pos, start[is_box])
    next_token = t[np.minimum(s + 1, len(t) - 1)] if len(t) else np.zeros(0, np.int64)
    end = np.where(is_str, str_end + 1, np.where(is_box, close_pos[np.maximum(own, 0)] + 1 if len(o) else 0, next_token))
    # filled: neither null nor blank text nor {} nor []
    second = skip(np.minimum(start + 1, n))
    blank = is_str & (second >= str_end)
    odd = np.nonzero(is_str & ~blank & (str_end - start < 80))[0]
    head = padded[second[odd]]
    for i in odd[(head == 92) | (head >= 0xC2)]:
        if not _text(buf, start[i], str_end[i] + 1).strip():
            blank[i] = True
    hollow = is_box & (second == (close_pos[np.maximum(own, 0)] if len(o) else 0))
    null = kind == 110
    filled = ~(empty_slot | blank | hollow | null)
    code = np.full(len(s), -1, np.int64)
    colon = np.nonzero(ch[s] == 58)[0]
    code[colon] = _key_codes(buf, q, t[s[colon]])
    return Values(t_row[s], start, end, kind, holder, own, element, code, filled, kind == 91, t_row[o], level[o], obj, good)


def _text(buf: np.ndarray, start: int, end: int) -> str:
    raw = buf[start:end].tobytes().decode("utf-8", "replace")
    try:
        return json.loads(raw, strict=False)
    except ValueError:
        return raw


def _key_codes(buf: np.ndarray, q: np.ndarray, colons: np.ndarray) -> np.ndarray:
    """Field codes of the strings that end before the colons."""
    if not len(colons) or len(q) < 2:
        return np.full(len(colons), -1, np.int64)
    j = np.searchsorted(q, colons) - 1
    a, b = q[np.maximum(j - 1, 0)] + 1, q[np.maximum(j, 0)]
    size = np.where(j >= 1, b - a, 0)
    out = np.full(len(colons), -1, np.int64)
    width = 40
    short = np.nonzero(size <= width)[0]
    grid = np.zeros((len(short), width), np.uint8)
    place = a[short][:, None] + np.arange(width)[None, :]
    grid[:] = buf[np.minimum(place, len(buf) - 1)]
    grid[np.arange(width)[None, :] >= size[short][:, None]] = 0
    names, back = np.unique(grid.view(f"S{width}").ravel(), return_inverse=True)
    known = np.array([field_code(_name(x)) for x in names], np.int64)
    out[short] = known[back] if len(names) else -1
    for i in np.nonzero(size > width)[0]:
        out[i] = field_code(_name(buf[a[i] : b[i]].tobytes()))
    return out


def _name(raw: bytes) -> str:
    if b"\\" in raw:
        try:
            return str(json.loads(b'"' + raw + b'"', strict=False))
        except ValueError:
            pass
    return raw.decode("utf-8", "replace")


def find_profile(value: object) -> dict | None:
    """The outermost object with a profile field, breadth first; string-encoded ones are opened."""
    level = [value]
    while level:
        below: list[object] = []
        for v in level:
            if isinstance(v, dict):
                if any(0 <= field_code(k) < len(FIELDS) for k in v):
                    return v
                below.extend(v.values())
            elif isinstance(v, list):
                below.extend(v)
            elif isinstance(v, str) and "{" in v:
                inner = unwrap(v)
                if inner is not None:
                    return inner
        level = below
    return None


def unwrap(text: str) -> dict | None:
    """The profile in a text that is not a bare object; None where it breaks off or holds none."""
    decoder = json.JSONDecoder(strict=False)
    body = text.strip().lstrip("﻿").strip()
    if body.startswith('"'):
        try:
            return find_profile(decoder.decode(body))
        except ValueError:
            pass
    at = -1
    while True:
        starts = [i for i in (body.find("{", at + 1), body.find("[", at + 1)) if i >= 0]
        if not starts:
            return None
        at = min(starts)
        try:
            value, end = decoder.raw_decode(body, at)
        except json.JSONDecodeError as e:
            if e.pos >= len(body) or "Unterminated" in e.msg or not body[e.pos :].strip():
                return None
            continue
        except RecursionError:
            return None
        found = find_profile(value)
        if found is not None:
            return found
        at = end - 1


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as one Arrow string array, built from its buffers."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    data = buf[take]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def flatten_batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Node rows of one batch of profile texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    size = len(texts)
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + size + 1] if size else np.zeros(1, np.int64)
    raw = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    v = _tokens(raw, offsets)
    profile = _profiles(v, size)
    # texts that the buffer pass could not resolve are unwrapped and take a second pass
    left = np.nonzero((profile < 0) & (np.diff(offsets) > 0))[0]
    parts = [_emit(ids, raw, v, profile)]
    if len(left):
        again, keep = [], []
        for i, text in zip(left, texts.take(pa.array(left)).to_pylist()):
            if "{" in text and (found := unwrap(text)) is not None:
                again.append(json.dumps(found, ensure_ascii=False))
                keep.append(i)
        if again:
            bare = pa.array(again, pa.large_string())
            off2 = np.frombuffer(bare.buffers()[1], np.int64)[: len(again) + 1]
            raw2 = np.frombuffer(bare.buffers()[2], np.uint8)[: off2[-1]]
            v2 = _tokens(raw2, off2)
            parts.append(_emit(ids.take(pa.array(keep)), raw2, v2, _profiles(v2, len(again))))
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if sum(map(len, parts)) else parts[0]


def _profiles(v: Values, rows: int) -> np.ndarray:
    """Per row the outermost object that has a profile field, -1 if there is none."""
    out = np.full(rows, -1, np.int64)
    named = np.unique(v.parent[(v.code >= 0) & (v.code < len(FIELDS))])
    named = named[(named >= 0)]
    named = named[v.open_is_obj[named] & v.good[v.open_row[named]]]
    named = named[np.lexsort((named, v.open_depth[named], v.open_row[named]))]
    rows_of, first = np.unique(v.open_row[named], return_index=True)
    out[rows_of] = named[first]
    return out


def _emit(ids: pa.Array, raw: np.ndarray, v: Values, profile: np.ndarray) -> pa.RecordBatch:
    have = profile[profile >= 0]
    root = np.zeros(len(v.open_row) + 1, bool)
    root[have] = True
    by_parent = np.argsort(v.parent, kind="stable")
    sorted_parent = v.parent[by_parent]
    out: list[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray, int]] = []

    def members(mask: np.ndarray) -> np.ndarray:
        """Of equally named members of an object only the last counts."""
        m = np.nonzero(mask)[0]
        last = np.lexsort((v.start[m], v.code[m], v.parent[m]))
        m = m[last]
        keep = np.ones(len(m), bool)
        keep[:-1] = (v.parent[m][1:] != v.parent[m][:-1]) | (v.code[m][1:] != v.code[m][:-1])
        return m[keep]

    def elements(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, element number, position in m) of the elements of array members; a single value is its own element 0."""
        single = ~v.is_array[m]
        arrays = m[~single]
        a = np.searchsorted(sorted_parent, v.own[arrays], side="left")
        count = np.searchsorted(sorted_parent, v.own[arrays], side="right") - a
        pos = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(a) else a, count) + np.arange(count.sum())
        val = by_parent[pos]
        src = np.repeat(np.nonzero(~single)[0], count)
        val = np.concatenate([val, m[single]])
        num = np.concatenate([v.element[val[: len(src)]], np.zeros(int(single.sum()), np.int64)])
        src = np.concatenate([src, np.nonzero(single)[0]])
        ok = v.filled[val]
        return val[ok], num[ok], src[ok]

    top = members((v.code >= 0) & (v.code < len(FIELDS)) & (v.parent >= 0) & root[v.parent])
    stance = top[v.code[top] == len(ARRAYS)]
    stance = stance[v.filled[stance]]
    lists = top[v.code[top] < len(ARRAYS)]
    val, num, src = elements(lists)
    names = pa.array(FIELDS)
    code = v.code[lists][src]
    path = pc.binary_join_element_wise(names.take(pa.array(code)), "[", pc.cast(pa.array(num), pa.string()), "]", "") if len(val) else pa.array([], pa.string())
    root_path = lambda k: pa.array(["$"] * k, pa.string())
    out.append((val, path, root_path(len(val)), code, num, 1))
    if len(stance):
        out.append((stance, pa.array([SINGLE] * len(stance)), root_path(len(stance)), np.full(len(stance), len(ARRAYS)), np.zeros(len(stance), np.int64), 1))
    box = (code == ARRAYS.index("objects")) & (v.own[val] >= 0) & ~v.is_array[val]
    frontier, paths, depth = v.own[val[box]], path.filter(pa.array(box)), 1
    child = np.full(len(v.open_row) + 1, -1, np.int64)
    below = (v.code == len(FIELDS)) & (v.parent >= 0)
    while len(frontier):
        depth += 1
        child[:] = -1
        child[frontier] = np.arange(len(frontier))
        m = members(below & (child[v.parent] >= 0))
        val, num, src = elements(m)
        if not len(val):
            break
        up = paths.take(pa.array(child[v.parent[m]][src]))
        path = pc.binary_join_element_wise(up, f".{CHILDREN}[", pc.cast(pa.array(num), pa.string()), "]", "")
        out.append((val, path, up, np.full(len(val), len(FIELDS)), num, depth))
        box = (v.own[val] >= 0) & ~v.is_array[val]
        frontier, paths = v.own[val[box]], path.filter(pa.array(box))
    value = np.concatenate([x[0] for x in out])
    flat = lambda k: pa.concat_arrays([x[k].combine_chunks() if isinstance(x[k], pa.ChunkedArray) else x[k] for x in out])
    every = pa.array((*FIELDS, CHILDREN))
    cols = [
        ids.take(pa.array(v.row[value])),
        flat(1),
        flat(2),
        every.take(pa.array(np.concatenate([x[3] for x in out]))),
        pa.array(np.concatenate([x[4] for x in out]).astype(np.int32)),
        pa.array(np.concatenate([np.full(len(x[0]), x[5]) for x in out]).astype(np.int32)),
        _slices(raw, v.start[value], v.end[value]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=NODES.fieldNames())


def flatten_profiles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(imageid, nodepath, parentpath, field, element, depth, node): one row for each node of each profile.

    A node is an element of an array field or of ``parts`` under objects, or the stance, unless it is
    null, blank text, {} or []; ``node`` is its JSON text.  Null, blank and broken-off texts, texts
    without a profile and rows without id give none; repeated rows count once; of members of one
    object that differ only in case and underscores the last counts."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).contains("{")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                yield flatten_batch(part.column(0), part.column(1))

    return rows.dropDuplicates(["id", "text"]).mapInArrow(run, NODES)


def node_table(nodes: DataFrame, fields: list[str], schema: str, text_as: str) -> DataFrame:
    """A typed child table of the nodes of some fields: keys first, then the attributes of ``schema``; a node that
    is plain text fills the attribute ``text_as``."""
    own = nodes.filter(F.col("field").isin(*fields))
    box = F.from_json("node", schema)
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    plain = F.when(F.col("node").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "node", F.lit("}")), "v string")["v"])
    cols = [(F.coalesce(box[n], plain) if n == text_as else box[n]).alias(n) for n in names]
    return own.select("imageid", "nodepath", "parentpath", "element", "depth", *cols)
