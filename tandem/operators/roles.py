"""Role profiles: tolerant decoding, corpus frequencies, and the four join rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import vocab
from tandem.functions.text import whole_json
from tandem.runtime import heavy_groups, stage


def profiles(images: DataFrame, id_col: str = "id", text_col: str = "roleprofile") -> DataFrame:
    """(id, phenomena, claims, embodied, subverts, objects) of the texts that are a JSON object as a whole.

    Fields are tolerant one by one: an array with a null element, or phenomena lacking a part, count as
    empty; missing parts of objects become ''.  One row per id (copies count once).  Claims, embodiments and
    objects carry their words, so that a join need not split texts again; stage the table before joining."""
    ok = F.col(text_col).startswith("{") & whole_json(F.col(text_col)).isNotNull()
    whole = images.filter(F.col(id_col).isNotNull()).filter(ok).groupBy(F.col(id_col).alias("id")).agg(F.max(text_col).alias("t"))
    rows = whole.select("id", whole_json(F.col("t")).alias("v"))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    part = lambda x, n: F.when(kind(F.try_variant_get(x, f"$.{n}", "variant")) == "STRING", F.try_variant_get(x, f"$.{n}", "string"))

    def elements(name: str, of: str) -> Column:
        """The elements of an array field, none if one of them is not of the kind."""
        arr = F.when(kind(F.try_variant_get("v", f"$.{name}", "variant")).startswith("ARRAY"), F.try_variant_get("v", f"$.{name}", "array<variant>"))
        none = F.array().cast("array<variant>")
        return F.when(F.exists(arr, lambda x: ~kind(x).startswith(of)), none).otherwise(F.coalesce(arr, none))

    def strings(name: str) -> Column:
        return F.transform(elements(name, "STRING"), lambda x: F.try_variant_get(x, "$", "string"))

    ph = F.transform(elements("phenomena", "OBJECT"), lambda x: F.struct(part(x, "phenomenon").alias("phenomenon"), part(x, "role").alias("role")))
    ph = F.when(F.exists(ph, lambda x: x["phenomenon"].isNull() | x["role"].isNull()), F.slice(ph, 1, 0)).otherwise(ph)
    ph = F.transform(ph, lambda x: F.struct(F.when(x["phenomenon"].isin("speech", "music"), "sound").otherwise(x["phenomenon"]).alias("phenomenon"), x["role"].alias("role")))
    low = lambda x, n: F.lower(F.coalesce(part(x, n), F.lit("")))
    ob = F.transform(elements("objects", "OBJECT"), lambda x: F.struct(low(x, "object").alias("object"), low(x, "register").alias("register"), low(x, "category").alias("category")))
    said = lambda arr: F.transform(arr, lambda x: F.struct(x.alias("text"), tokens(x).alias("words")))
    cats = F.create_map(*(F.lit(x) for kv in vocab.CLAIM_CATEGORY.items() for x in kv))
    claims = F.transform(strings("claims"), lambda x: F.struct(x.alias("text"), tokens(x).alias("words"), F.filter(F.transform(tokens(x), lambda t: cats[t]), lambda w: w.isNotNull()).alias("cats")))
    things = F.transform(ob, lambda x: F.struct(x["object"].alias("object"), x["register"].alias("register"), x["category"].alias("category"), tokens(x["object"]).alias("words")))
    return rows.select("id", ph.alias("phenomena"), claims.alias("claims"), said(F.concat(strings("enacts"), strings("subverts"))).alias("embodied"), strings("subverts").alias("subverts"), things.alias("objects"))


def tokens(text: Column) -> Column:
    """Distinct words of letters only, of more than two letters, without stop-words."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*vocab.ROLE_STOP_WORDS)))


def frequencies(prof: DataFrame) -> DataFrame:
    """(kind, key, df): phenomena and concepts by profiles, nouns and categories by occurrences."""
    ph = prof.select(F.explode(F.array_distinct(F.transform("phenomena", lambda x: x["phenomenon"]))).alias("key")).select(F.lit("phenomenon").alias("kind"), "key")
    said = F.concat(F.col("claims.words"), F.col("embodied.words"))
    co = prof.select(F.explode(F.array_distinct(F.flatten(said))).alias("key")).select(F.lit("concept").alias("kind"), "key")
    ob = prof.select(F.explode("objects").alias("o"))
    no = ob.filter("o.object <> ''").select(F.lit("object").alias("kind"), F.col("o.object").alias("key"))
    ca = ob.filter("o.category <> ''").select(F.lit("category").alias("kind"), F.col("o.category").alias("key"))
    return ph.unionByName(co).unionByName(no).unionByName(ca).groupBy("kind", "key").agg(F.count("*").alias("df"))


def specificity(total: Column, df: Column) -> Column:
    return F.log((total + 1) / (F.coalesce(df, F.lit(0)) + 1))


def _first(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


def rule_hits(a: str = "a", b: str = "b") -> tuple[Column, Column, Column]:
    """(priority, key kind, key) of the first rule that connects two joined profiles, null for none.

    ``a``, ``b``: prefixes of the profile columns of both sides.  The key is what the specificity of
    the connection is looked up by: the phenomenon, the whole claim, the noun or category."""
    A, B = lambda n: F.col(f"{a}_{n}"), lambda n: F.col(f"{b}_{n}")
    counter = lambda p, other: F.exists(other, lambda q: (q["phenomenon"] == p["phenomenon"]) & (((p["role"] == "source") & (q["role"] == "receiver")) | ((p["role"] == "receiver") & (q["role"] == "source"))))
    strains = lambda p: F.when(p["role"] == "source", F.size(B("subverts")) > 0).otherwise(F.size(A("subverts")) > 0)
    one = _first(F.filter(A("phenomena"), lambda p: (p["phenomenon"] != "gaze") & counter(p, B("phenomena")) & strains(p)))["phenomenon"]

    def bridged(c: Column, e: Column) -> Column:
        out = F.lit(False)
        for claim, body in vocab.CLAIM_BRIDGE:
            out = out | ((F.lower(c) == claim) & (F.lower(e) == body))
        return out

    says = lambda claims, embodied: _first(F.filter(claims, lambda c: F.exists(embodied, lambda e: F.arrays_overlap(c["words"], e["words"]) | bridged(c["text"], e["text"]))))["text"]
    two = F.coalesce(says(A("claims"), B("embodied")), says(B("claims"), A("embodied")))
    alt = F.array(*map(F.lit, vocab.ALTERNATIVE_REGISTERS))

    def versions(x: Column, y: Column) -> Column:
        noun = (x["object"] != "") & (x["object"] == y["object"])
        cat = (x["category"] != "") & (x["category"] == y["category"]) & x["category"].isin(*vocab.CATEGORY_WHITELIST)
        regs = ((x["register"] == "real") & F.array_contains(alt, y["register"])) | ((y["register"] == "real") & F.array_contains(alt, x["register"]))
        return (noun | cat) & regs

    pairs3 = F.flatten(F.transform(A("objects"), lambda x: F.transform(F.filter(B("objects"), lambda y: versions(x, y)), lambda y: F.struct(F.when((x["object"] != "") & (x["object"] == y["object"]), F.lit("object")).otherwise("category").alias("kind"), F.when((x["object"] != "") & (x["object"] == y["object"]), x["object"]).otherwise(x["category"]).alias("key")))))
    three = _first(pairs3)
    def named(claims: Column, objects: Column) -> Column:
        def hit(c: Column, o: Column) -> Column:
            return ((o["category"] != "") & F.array_contains(c["cats"], o["category"])) | ((o["object"] != "") & F.arrays_overlap(c["words"], o["words"]))

        got = F.flatten(F.transform(claims, lambda c: F.transform(F.filter(objects, lambda o: hit(c, o)), lambda o: F.struct(F.when(o["category"] != "", F.lit("category")).otherwise("object").alias("kind"), F.when(o["category"] != "", o["category"]).otherwise(o["object"]).alias("key")))))
        return _first(got)

    four = F.coalesce(named(A("claims"), B("objects")), named(B("claims"), A("objects")))
    priority = F.when(one.isNotNull(), 1).when(two.isNotNull(), 2).when(three.isNotNull(), 3).when(four.isNotNull(), 4)
    kind = F.when(one.isNotNull(), "phenomenon").when(two.isNotNull(), "concept").when(three.isNotNull(), three["kind"]).when(four.isNotNull(), four["kind"])
    key = F.coalesce(one, two, three["key"], four["key"])
    return priority, kind, key


def connect(pairs: DataFrame, prof: DataFrame) -> DataFrame:
    """(id, priority, kind, key) of the pairs (id, a, b) that a rule connects.

    A pair costs two joins by image, so the work grows with the pairs and not with their square.  The
    rules are tried with a as the lower id."""
    side = lambda p: prof.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in prof.columns if c != "id"))
    ordered = pairs.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    joined = ordered.join(side("a"), "a").join(side("b"), "b")
    priority, kind, key = rule_hits()
    return joined.select("id", "a", "b", priority.alias("priority"), kind.alias("kind"), key.alias("key")).filter("priority IS NOT NULL")


def with_specificity(hits: DataFrame, freq: DataFrame, total: int) -> DataFrame:
    """``hits`` with the specificity of their key; of a claim the rarest of its concepts counts."""
    flat = hits.withColumn("one", F.explode_outer(F.when(F.col("kind") == "concept", tokens(F.col("key"))).otherwise(F.array("key"))))
    f = freq.select("kind", F.col("key").alias("one"), "df")
    scored = flat.join(f, ["kind", "one"], "left").withColumn("s", F.when(F.col("one").isNull(), F.lit(0.0)).otherwise(specificity(F.lit(total), F.col("df"))))
    return scored.groupBy(*hits.columns).agg(F.max("s").alias("specificity"))


def _occurrences(prof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, right) of (rule, key, id, i): what the sides of each rule are matched by, with the first position in the
    profile.  Rules 1 to 5: phenomenon, claim, noun, category, claim and object."""
    at = lambda c: prof.select("id", F.posexplode(c).alias("i", "x"))
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.alias("key"), "id", F.col("i").cast("long").alias("i"))
    x = F.col("x")
    many = lambda df, rule, keys: df.select(F.lit(rule).alias("rule"), F.explode(keys).alias("key"), "id", F.col("i").cast("long").alias("i"))
    tag = lambda t, words: F.transform(words, lambda w: F.concat(F.lit(t), w))
    ph = at("phenomena").filter("x.phenomenon <> 'gaze'")
    strained = prof.filter(F.size("subverts") > 0).select("id")
    claims, said, things = at("claims"), at("embodied"), at("objects")
    bridge = F.array(*(F.when(F.lower(x["text"]) == c, F.lit("b" + e)) for c, e in vocab.CLAIM_BRIDGE))
    bodies = sorted({e for _, e in vocab.CLAIM_BRIDGE})
    reached = F.array(F.when(F.lower(x["text"]).isin(*bodies), F.concat(F.lit("b"), F.lower(x["text"]))))
    known = lambda arr: F.filter(arr, lambda v: v.isNotNull())
    real, alt = things.filter("x.register = 'real'"), things.filter(x["register"].isin(*vocab.ALTERNATIVE_REGISTERS))
    noun, listed = x["object"] != "", x["category"].isin(*vocab.CATEGORY_WHITELIST)
    left = [
        row(ph.filter("x.role = 'source'"), 1, x["phenomenon"]), many(claims, 2, F.concat(tag("w", x["words"]), known(bridge))),
        row(real.filter(noun), 3, x["object"]), row(real.filter(listed), 4, x["category"]), many(claims, 5, F.concat(tag("w", x["words"]), tag("c", x["cats"]))),
    ]
    right = [
        row(ph.filter("x.role = 'receiver'").join(strained, "id", "left_semi"), 1, x["phenomenon"]), many(said, 2, F.concat(tag("w", x["words"]), known(reached))),
        row(alt.filter(noun), 3, x["object"]), row(alt.filter(listed), 4, x["category"]), many(things, 5, F.concat(tag("w", x["words"]), F.array(F.concat(F.lit("c"), x["category"])))),
    ]

    def once(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.groupBy("rule", "key", "id").agg(F.min("i").alias("i"))

    return once(left), once(right)


def _keys(prof: DataFrame) -> DataFrame:
    """(owner, slot, kind, key): the key a hit is looked up by, under the image and the position that hold it."""
    at = lambda c, rule: prof.select(F.col("id").alias("owner"), F.posexplode(c).alias("i", "x")).withColumn("slot", F.lit(rule).cast("long") * PLACES + F.col("i"))
    put = lambda df, kind, key: df.select("owner", "slot", kind.alias("kind"), key.alias("key"))
    noun, cat = F.lit("object"), F.lit("category")
    first = F.when(F.col("x.category") != "", cat).otherwise(noun)
    return (
        put(at("phenomena", 1), F.lit("phenomenon"), F.col("x.phenomenon")).unionByName(put(at("claims", 2), F.lit("concept"), F.col("x.text")))
        .unionByName(put(at("objects", 3), noun, F.col("x.object"))).unionByName(put(at("objects", 4), cat, F.col("x.category")))
        .unionByName(put(at("objects", 5), first, F.when(first == "category", F.col("x.category")).otherwise(F.col("x.object"))))
    )


#: Positions inside a profile's lists that a packed rank has room for; more stop the query instead of being dropped.
PLACES = 1 << 20
#: Pairs of profiles that a task compares at a time, about.
TASK_PAIRS = 500_000
#: Profiles of a block, about.
BLOCK = 1 << 15


def connect_all(prof: DataFrame, freq: DataFrame | None = None, total: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, priority, kind, key) of all pairs a < b of profiles that a rule connects, the same as ``connect`` over every
    pair; with ``freq`` and ``total`` also the specificity, rounded to ``digits`` once for each key.

    Where several rules or positions connect a pair, the first counts: a rank of priority and positions is packed into
    one number, and its smallest names the key.  Profiles are cut into blocks by id, and a tile of two blocks ranks its
    pairs by the keys that their sides have in common.  Only blocks are sent to tasks: connections grow with the square
    of the profiles, leave a task in lists of b and are neither shuffled nor staged."""
    spark = prof.sparkSession
    left, right = (stage(side, "occurrences") for side in _occurrences(prof))
    shared = left.select("rule", "key").distinct().join(right.select("rule", "key").distinct(), ["rule", "key"])
    shared = stage(shared.withColumn("kid", F.monotonically_increasing_id()), "shared")
    keys = _keys(prof)
    if freq is not None:
        rated = with_specificity(keys.select("kind", "key").distinct(), freq, total)
        keys = keys.join(rated if digits is None else rated.withColumn("specificity", F.round("specificity", digits)), ["kind", "key"])
    names = keys.select(F.col("owner").alias("id"), "slot", F.struct(*(c for c in keys.columns if c not in ("owner", "slot"))).alias("name"))
    # a claim names the key of rule 2, an object that of rule 5, either side that of the others
    slot = lambda n: F.when(F.col("rule") != (5, 2)[n], F.col("rule").cast("long") * PLACES + F.col("i"))
    side = lambda df, n: df.join(shared, ["rule", "key"]).select("id", F.col("rule").cast("int").alias("rule"), "kid", "i", F.lit(n).alias("side"), slot(n).alias("slot"))
    rows = side(left, 0).unionByName(side(right, 1)).join(names, ["id", "slot"], "left").drop("slot")
    n = max(-(-prof.count() // BLOCK), int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism))))
    bounds = prof.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10_000).alias("v")).first().v or []
    rows = rows.withColumn("block", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda v: v < F.col("id"))))
    blocks = stage(heavy_groups(rows, "block").applyInArrow(_packed, "block int, data binary"), "blocks")
    own = F.col("block")
    tiles = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(len(bounds))))).select(F.least(own, "with").alias("lo"), F.greatest(own, "with").alias("hi"), "block", "data")
    # every tile is a task of its own
    tiles = tiles.repartitionById((len(bounds) + 1) * (len(bounds) + 2) // 2, (F.col("hi") * (F.col("hi") + 1) / 2 + F.col("lo")).cast("int"))
    step, of = TASK_PAIRS, names.schema["name"].dataType

    def run(batches):
        got = {r["block"]: r for batch in batches for r in batch.to_pylist()}
        for r in list(got.values())[:1]:
            if r["lo"] in got and r["hi"] in got:
                a, b = (pa.ipc.open_stream(got[r[end]]["data"]).read_all() for end in ("lo", "hi"))
                yield from Tile(a, b, r["lo"] == r["hi"]).run(step)

    lists = tiles.mapInArrow(run, "a long, bs array<long>, priority int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in of))
    return lists.select("a", F.explode("bs").alias("b"), "priority", *of.names)


def _packed(t: pa.Table) -> pa.Table:
    """The rows of one block as one row of compressed data."""
    block = t.column("block")[0].as_py()
    t = t.drop_columns("block").combine_chunks().sort_by([("side", "ascending"), ("kid", "ascending"), ("id", "ascending")])
    flat = t.drop_columns("name")
    for f, v in zip(t.column("name").combine_chunks().type, t.column("name").combine_chunks().flatten()):
        flat = flat.append_column(f"name.{f.name}", v)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, flat.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(flat)
    return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _part(x: dict, lower: bool) -> np.ndarray:
    """What the lower or the higher end of a pair adds to its rank by occurrences ``x``; the rank is the sum of both."""
    rule, i = x["rule"], x["i"].astype(np.int64)
    left = x["side"] == 0
    first = np.int64(PLACES) * PLACES
    rest = i * first if lower else i * PLACES
    own = np.select([rule == 1, rule == 2, rule == 5], [rest if lower else i * 0, np.where(left, i * PLACES, 0), np.where(left, i * PLACES, i)], rest)
    if not lower:
        return own
    kind = np.array([0, *PRIORITY.values()])[rule] - 1
    way = np.where(((rule == 2) | (rule == 5)) & ~left, first, 0)
    return (kind.astype(np.int64) << 60) + way + own + (rule == 4)


class Tile:
    """The connections of the profiles of block ``a`` with those of block ``b``, whose ids are higher or, in the same
    block, the same."""

    FREE = np.iinfo(np.int64).max

    def __init__(self, a: pa.Table, b: pa.Table, same: bool):
        self.same = same
        get = lambda t, c: t.column(c).to_numpy()
        both = [{c: get(t, c) for c in ("id", "rule", "kid", "i", "side")} for t in (a, b)]
        if max(x["i"].max(initial=-1) for x in both) >= PLACES:
            raise ValueError(f"a profile list of more than {PLACES} elements")
        self.ids = [np.unique(x["id"]) for x in both]
        at = [np.searchsorted(ids, x["id"]) for ids, x in zip(self.ids, both)]
        self._name(a, b, both, at)
        rows, cols = both
        kids = np.unique(cols["kid"])
        k = np.minimum(np.searchsorted(kids, rows["kid"]), len(kids) - 1)
        meet = np.nonzero(kids[k] == rows["kid"])[0]
        # group: the side of a and the key; posted: where the higher profiles of a group are
        self.group, self.row = rows["side"][meet] * len(kids) + k[meet], at[0][meet]
        posted = (1 - cols["side"]) * len(kids) + np.searchsorted(kids, cols["kid"])
        order = np.argsort(posted, kind="stable")
        self.posted, self.col = np.searchsorted(posted[order], np.arange(2 * len(kids) + 1)), at[1][order]
        self.mine = _part({c: v[meet] for c, v in rows.items()}, True)
        self.other = _part({c: v[order] for c, v in cols.items()}, False)

    def _name(self, a, b, both, at) -> None:
        """Numbers the names and the places that hold one: ``code[base[profile, rule] + position]``, higher profiles last."""
        parts = [c for c in a.column_names if c.startswith("name.")]
        self.parts = {c[5:]: pa.chunked_array([*a.column(c).chunks, *b.column(c).chunks]).combine_chunks() for c in parts}
        kind, key = (self.parts[c].dictionary_encode() for c in ("kind", "key"))
        number = lambda d: d.indices.fill_null(-1).to_numpy().astype(np.int64)
        pair = number(kind) * (len(key.dictionary) + 1) + number(key)
        _, first, code = np.unique(pair, return_index=True, return_inverse=True)
        self.parts = {c: v.take(pa.array(first)) for c, v in self.parts.items()}
        join = lambda c: np.concatenate([x[c] for x in both])
        rule, i = join("rule"), join("i")
        place = np.concatenate([at[0], at[1] + len(self.ids[0])]) * 6 + rule
        holds = np.nonzero(rule != np.where(join("side") == 0, 5, 2))[0]
        room = np.zeros((len(self.ids[0]) + len(self.ids[1])) * 6, np.int64)
        np.maximum.at(room, place[holds], i[holds] + 1)
        self.base = np.cumsum(room) - room
        self.code = np.zeros(int(room.sum()), np.int64)
        self.code[self.base[place[holds]] + i[holds]] = code[holds]

    def run(self, step: int):
        """Record batches of (a, bs, priority, *name), bs being a list of b."""
        (na, nb), high = map(len, self.ids), len(self.ids[0])
        size = max(1, step // nb)
        order = np.lexsort((self.row, self.group, self.row // size))
        group, row, mine = self.group[order], self.row[order], self.mine[order]
        cut = np.searchsorted(row // size, np.arange(-(-na // size) + 1))
        best = np.empty(min(size, na) * nb, np.int64)
        for s in range(len(cut) - 1):
            if cut[s] == cut[s + 1]:
                continue
            best.fill(self.FREE)
            g = group[cut[s] : cut[s + 1]]
            edges = cut[s] + np.concatenate([[0], np.nonzero(np.diff(g))[0] + 1, [len(g)]])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                p, q = self.posted[group[x]], self.posted[group[x] + 1]
                if p < q:
                    at = ((row[x:y] - s * size) * nb)[:, None] + self.col[p:q]
                    best[at] = np.minimum(best[at], mine[x:y, None] + self.other[p:q])
            if self.same:
                for r in range(min(size, na - s * size)):
                    best[r * nb : r * nb + s * size + r + 1] = self.FREE
            hit = np.nonzero(best != self.FREE)[0]
            if not len(hit):
                continue
            rank = best[hit]
            r = hit // nb
            c = hit - r * nb
            r += s * size
            place = lambda k: (rank >> 20 * k) & (PLACES - 1)
            kind, o1, o3 = rank >> 60, place(2), place(0)
            theirs = ((kind == 1) & (o1 == 1)) | ((kind == 3) & (o1 == 0))
            rule = np.array([1, 2, 3, 5])[kind] + np.where(kind == 2, o3, 0)
            i = np.where(kind == 1, place(1), np.where(kind == 3, o3, o1))
            code = self.code[self.base[np.where(theirs, c + high, r) * 6 + rule] + i]
            # lists of one a, name and priority: profile, name, priority and b in one number
            names, bits = len(self.parts["key"]), nb.bit_length()
            run = np.sort(((((r - s * size) * names + code) * 4 + kind) << bits) + c)
            c = run & ((1 << bits) - 1)
            run >>= bits
            start = np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1])
            of = run[start]
            bs = pa.ListArray.from_arrays(pa.array(np.append(start, len(c)), pa.int32()), pa.array(self.ids[1][c]))
            lower, priority, take = self.ids[0][of // 4 // names + s * size], (of % 4 + 1).astype(np.int32), pa.array(of // 4 % names)
            yield pa.RecordBatch.from_arrays([pa.array(lower), bs, pa.array(priority), *(v.take(take) for v in self.parts.values())], ["a", "bs", "priority", *self.parts])


#: The priority of a rule of ``_occurrences``.
PRIORITY = {1: 1, 2: 2, 3: 3, 4: 3, 5: 4}


def admit(prof: DataFrame, freq: DataFrame, total: int, caps: dict[int, int]) -> DataFrame:
    """(a, b, kind) of the connections that a loop over ``connect_all`` in order of priority, specificity (rarest first),
    a, b admits, each image taking part in at most ``caps[priority]`` of a priority.

    Connections grow with the square of the profiles, admitted ones only with the profiles: they are looked for in that
    order among the images that still have room and never listed whole.  The loop of one priority is one task, which
    holds what the profiles are matched by."""
    left, right = (stage(side, "occurrences") for side in _occurrences(prof))
    shared = left.select("rule", "key").distinct().join(right.select("rule", "key").distinct(), ["rule", "key"])
    shared = stage(shared.withColumn("kid", F.monotonically_increasing_id()), "shared")
    keys = _keys(prof)
    rated = with_specificity(keys.select("kind", "key").distinct(), freq, total)
    slots = stage(keys.join(rated, ["kind", "key"]).select(F.col("owner").alias("id"), "slot", "specificity"), "slots")
    side = lambda df, n: df.join(shared, ["rule", "key"]).select("id", "rule", "kid", "i", F.lit(n).alias("side"), (F.col("rule").cast("long") * PLACES + F.col("i")).alias("slot"))
    rows = side(left, 0).unionByName(side(right, 1)).join(slots, ["id", "slot"], "left").drop("slot")
    of = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    rows = rows.withColumn("kind", F.explode(F.sequence(of[F.col("rule")], F.lit(max(PRIORITY.values())))))

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        get = lambda c: t.column(c).to_numpy()
        ids, who = np.unique(get("id"), return_inverse=True)
        a, b = Admission(kind, who, get("rule"), get("kid"), get("i"), get("side"), get("specificity").astype(np.float64)).run(caps[kind])
        return pa.table({"a": ids[a], "b": ids[b], "kind": pa.array(np.full(len(a), kind), pa.int32())})

    return heavy_groups(rows, "kind").applyInArrow(run, "a long, b long, kind int")


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Admission:
    """The loop of one priority over numbered profiles.  Side 0 has the left occurrences of the rules, side 1 the right ones."""

    def __init__(self, kind: int, who, rule, kid, i, side, spec):
        if len(i) and i.max() >= PLACES:
            raise ValueError(f"a profile list of more than {PLACES} elements")
        self.kind, self.n = kind, int(who.max(initial=-1)) + 1
        names, key = np.unique(kid, return_inverse=True)
        self.keys = len(names)
        low, high = (_part({"rule": rule, "i": i, "side": side}, lower) for lower in (True, False))
        mine = np.array([0, *PRIORITY.values()])[rule] == kind
        # a connection is looked up by its lower image (1 and 3), by its claim (2) or by its object (4)
        owner = mine & {1: True, 2: side == 0, 3: True, 4: side == 1}[kind]
        level = np.full(len(who), -1)
        self.levels, level[owner] = np.unique(-spec[owner], return_inverse=True)
        self.held, self.posted = [], []
        for s in (0, 1):
            at = np.nonzero(side == s)[0]
            at = at[np.argsort(who[at], kind="stable")]
            self.held.append((np.searchsorted(who[at], np.arange(self.n + 1)), key[at], low[at], high[at], level[at]))
            at = at[np.argsort(key[at], kind="stable")]
            self.posted.append((np.searchsorted(key[at], np.arange(len(names) + 1)), who[at]))
        at = np.nonzero(owner)[0]
        at = at[np.lexsort((who[at], key[at], side[at], level[at]))]
        self.own = side[at], key[at], who[at], np.searchsorted(level[at], np.arange(len(self.levels) + 1))
        self.place = [np.full(len(names), -1, np.int64) for _ in (0, 1)]
        self.rung = [np.full(len(names), -1) for _ in (0, 1)]

    def _mark(self, a: int) -> list[np.ndarray]:
        marked = []
        for s, (start, key, low, _, level) in enumerate(self.held):
            cut = slice(start[a], start[a + 1])
            self.place[s][key[cut]], self.rung[s][key[cut]] = low[cut], level[cut]
            marked.append(key[cut])
        return marked

    def _connected(self, some: np.ndarray, level: int) -> np.ndarray:
        """Which of the higher profiles ``some`` the marked one is connected with by this priority and level, by the
        same ranks as in ``connect_all``."""
        ends, ranks, levels = [], [], []
        for s, (start, key, _, high, own) in enumerate(self.held):
            n = start[some + 1] - start[some]
            at = _ranges(start[some], n)
            k = key[at]
            hit = self.place[1 - s][k] >= 0
            at, k, end = at[hit], k[hit], np.repeat(np.arange(len(some)), n)[hit]
            ranks.append(self.place[1 - s][k] + high[at])
            theirs = (self.kind == 2 and s == 0) or (self.kind == 4 and s == 1)
            levels.append(own[at] if theirs else self.rung[1 - s][k])
            ends.append(end)
        end, rank, rung = map(np.concatenate, (ends, ranks, levels))
        best = np.full(len(some), np.iinfo(np.int64).max)
        np.minimum.at(best, end, rank)
        good = (rank == best[end]) & (rung == level) & (rank >> 60 == self.kind - 1)
        out = np.zeros(len(some), bool)
        out[end[good]] = True
        return out

    def _lists(self, level: int, room: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(profiles that may be the lower end of a connection of this level, others to try), both sorted and with room."""
        side, key, who, start = self.own
        cut = slice(start[level], start[level + 1])
        side, key, who = side[cut], key[cut], who[cut]
        lists = []
        edges = np.nonzero(np.diff(side * self.keys + key, prepend=-1, append=-1))[0] if len(key) else []
        for x, y in zip(edges[:-1], edges[1:]):
            begin, posted = self.posted[1 - side[x]]
            other = posted[begin[key[x]] : begin[key[x] + 1]]
            mine, other = who[x:y][room[who[x:y]] > 0], other[room[other] > 0]
            if len(mine) and len(other):
                for p, q in ((mine, other), (other, mine))[: 2 if self.kind in (2, 4) else 1]:
                    p = p[: np.searchsorted(p, q[-1])]
                    if len(p):
                        lists.append((p, q))
        return lists

    def run(self, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of the admitted connections."""
        room, got = np.full(self.n, cap), []
        for level in range(len(self.levels)):
            lists = self._lists(level, room)
            if not lists:
                continue
            others = [q for _, q in lists]
            lower = np.concatenate([p for p, _ in lists])
            of = np.repeat(np.arange(len(lists)), [len(p) for p, _ in lists])
            order = np.argsort(lower, kind="stable")
            lower, of, at, idle = lower[order], of[order], 0, 0
            open_ = np.ones(len(lists), bool)
            while at < len(lower):
                # lists without room at higher profiles and profiles without room leave once they are many
                if idle > 64 + (len(lower) - at) // 4:
                    keep = open_[of[at:]] & (room[lower[at:]] > 0)
                    lower, of, at, idle = lower[at:][keep], of[at:][keep], 0, 0
                    continue
                a, mine = int(lower[at]), []
                begin = at
                while at < len(lower) and lower[at] == a:
                    mine.append(int(of[at]))
                    at += 1
                if not room[a]:
                    idle += at - begin
                    continue
                tails = []
                for x in mine:
                    if not open_[x]:
                        idle += 1
                        continue
                    q = others[x]
                    q = q[q.searchsorted(a, "right") :]
                    if 2 * np.count_nonzero(room[q[:64]]) < min(len(q), 64):
                        q = q[room[q] > 0]
                    others[x] = q
                    if len(q):
                        tails.append(q)
                    else:
                        open_[x] = False
                if tails:
                    self._admit(a, tails, level, room, got)
        a, b = np.array(got, np.int64).reshape(-1, 2).T
        return a, b

    def _admit(self, a: int, lists: list[np.ndarray], level: int, room: np.ndarray, got: list) -> None:
        """Admits the first connections of ``a`` with the profiles of ``lists`` that there is room for."""
        marked, wide = None, 64
        while room[a] and lists:
            # the next ones of every list, up to where each of them is known
            bound = min((q[wide - 1] for q in lists if len(q) > wide), default=self.n)
            some = [q[:wide][q[:wide] <= bound] for q in lists]
            lists = [q[len(s) :] for q, s in zip(lists, some) if len(q) > len(s)]
            some = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            some, wide = some[room[some] > 0], 2 * wide
            if len(some):
                marked = marked or self._mark(a)
                for b in some[self._connected(some, level)][: room[a]].tolist():
                    got.append((a, b))
                    room[a] -= 1
                    room[b] -= 1
        for s, key in enumerate(marked or []):
            self.place[s][key] = self.rung[s][key] = -1
