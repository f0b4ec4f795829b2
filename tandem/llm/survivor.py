"""Best representative of each duplicate group.

Two ways to survive: by fixed rules per field (one pass of map-side combinable minima), and by
consensus: the values of a text field are aligned token by token, every column of the alignment is
put to the vote, and the existing value closest to the winner is kept.  The alignment of a group is
built as a tree: blocks of bounded size become profiles, profiles are aligned in further blocks, so
that no task ever holds a whole large group.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.runtime import heavy_groups, spread, stage

GAP = ""


def survivors(images: DataFrame) -> DataFrame:
    """(duplicategroupid, heroid, dateid, nameid): one row for each group with two or more images.

    A capture date is credible if later than 631152000 and not after indexedat (a null or NaN date, or
    a null indexedat, is not).  Rows without group or id take no part; repeated rows change nothing."""
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(indexedat AS timestamp_ntz))") / F.lit(1e6)
    day = F.when((F.col("capturedate") > 631152000) & (F.col("capturedate") <= seconds), F.col("capturedate"))
    name = F.length(F.trim("filename"))
    rows = images.filter("duplicategroupid IS NOT NULL AND id IS NOT NULL").select("duplicategroupid", "id", F.coalesce("ishero", F.lit(False)).alias("hero"), day.alias("day"), F.when(name > 0, name).alias("name"))
    rank = F.struct(F.col("day").isNull().alias("none"), "day", "id")
    best = rows.groupBy("duplicategroupid").agg(
        F.min("id").alias("lo"),
        F.max("id").alias("hi"),
        F.min(F.when(F.col("hero"), rank)).alias("hero"),
        F.min(rank).alias("anyone"),
        F.min(F.when(F.col("day").isNotNull(), F.struct("day", "id"))).alias("dated"),
        F.min(F.when(F.col("name").isNotNull(), F.struct("name", "id"))).alias("named"),
    )
    zero = F.lit(0).cast("long")
    return best.filter("lo < hi").select(
        "duplicategroupid",
        F.coalesce(F.col("hero")["id"], F.col("anyone")["id"]).alias("heroid"),
        F.coalesce(F.col("dated")["id"], zero).alias("dateid"),
        F.coalesce(F.col("named")["id"], zero).alias("nameid"),
    )


# A profile is a list of columns; a column maps tokens (and the gap) to weights.
Profile = list[dict[str, float]]


def _weight(p: Profile) -> float:
    return sum(p[0].values()) if p else 0.0


class _Matches:
    """Chances that a token drawn from a column of ``a`` equals one drawn from a column of ``b``, by blocks of rows."""

    def __init__(self, a: Profile, b: Profile):
        self.a, self.na, self.nb = a, max(_weight(a), 1e-9), max(_weight(b), 1e-9)
        self.ids: dict[str, int] = {}
        tok, col, w = [], [], []
        for j, c in enumerate(b):
            for t, x in c.items():
                if t != GAP:
                    tok.append(self.ids.setdefault(t, len(self.ids)))
                    col.append(j)
                    w.append(x)
        self.tok, self.col, self.w = np.array(tok, np.int64), np.array(col, np.int64), np.array(w, np.float32) / self.nb

    def rows(self, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
        """The block [i0, i1) x [j0, j1)."""
        out = np.zeros((j1 - j0, i1 - i0), np.float32)
        local: dict[int, int] = {}
        own = [(local.setdefault(self.ids[t], len(local)), i - i0, x) for i in range(i0, i1) for t, x in self.a[i].items() if t in self.ids]
        if not own:
            return out.T
        weight = np.zeros((len(local) + 1, i1 - i0), np.float32)
        for k, i, x in own:
            weight[k, i] = x / self.na
        place = np.full(len(self.ids), len(local), np.int64)
        place[list(local)] = list(local.values())
        lo, hi = np.searchsorted(self.col, [j0, j1])
        k = place[self.tok[lo:hi]]
        hit = np.nonzero(k < len(local))[0]
        for at in range(0, len(hit), 8192):
            h = hit[at : at + 8192]
            np.add.at(out, self.col[lo + h] - j0, weight[k[h]] * self.w[lo + h, None])
        return out.T


def _path(score: np.ndarray) -> list[tuple[int, int]]:
    """Matched column pairs of the best global alignment with free gaps."""
    m, n = score.shape
    h = np.zeros((m + 1, n + 1), np.float32)
    for i in range(m):
        h[i + 1, 1:] = np.maximum.accumulate(np.maximum(h[i, :-1] + score[i], h[i, 1:]))
    out, i, j = [], m, n
    while i and j:
        if score[i - 1, j - 1] > 0 and h[i, j] == h[i - 1, j - 1] + score[i - 1, j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _reach(m: _Matches, i0: int, i1: int, j0: int, j1: int, back: bool) -> np.ndarray:
    """Best scores of all rows against the first (``back``: last) 0, 1, ... columns."""
    h = np.zeros(j1 - j0 + 1, np.float32)
    cuts = list(range(i0, i1, 64))
    for lo in reversed(cuts) if back else cuts:
        block = m.rows(lo, min(lo + 64, i1), j0, j1)
        for row in block[::-1, ::-1] if back else block:
            h[1:] = np.maximum.accumulate(np.maximum(h[:-1] + row, h[1:]))
    return h


def align(a: Profile, b: Profile, most: int = 4_000_000) -> list[tuple[int, int]]:
    """Matched column pairs of a best global alignment with free gaps, for profiles of any length.

    Where the table of all pairs of columns would have more than ``most`` entries, the rows are halved and the columns
    cut where the best scores of both halves meet: the alignment stays a best one, the memory that of a few rows."""
    m, out = _Matches(a, b), []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i1 <= i0 or j1 <= j0:
            continue
        if i1 - i0 == 1 or (i1 - i0) * (j1 - j0) <= most:
            out += [(i0 + i, j0 + j) for i, j in _path(m.rows(i0, i1, j0, j1))]
            continue
        mid = (i0 + i1) // 2
        cut = j0 + int(np.argmax(_reach(m, i0, mid, j0, j1, False) + _reach(m, mid, i1, j0, j1, True)[::-1]))
        todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
    return sorted(out)


def merge_profiles(a: Profile, b: Profile) -> Profile:
    """The two alignments aligned with each other; unmatched columns face gaps."""
    if not a or not b:
        return a or b
    wa, wb = _weight(a), _weight(b)
    out: Profile = []
    i = j = 0
    def alone(c: dict[str, float], w: float) -> dict[str, float]:
        return {**c, GAP: c.get(GAP, 0.0) + w}
    for x, y in [*align(a, b), (len(a), len(b))]:
        out += [alone(c, wb) for c in a[i:x]] + [alone(c, wa) for c in b[j:y]]
        if x < len(a):
            col = dict(a[x])
            for t, w in b[y].items():
                col[t] = col.get(t, 0.0) + w
            out.append(col)
        i, j = x + 1, y + 1
    return out


def vote(p: Profile) -> list[str]:
    """The heaviest token of each column, equal weights by token; a column won by the gap is left out."""
    return [t for t in (min(c.items(), key=lambda kv: (-kv[1], kv[0]))[0] for c in p) if t != GAP]


def closeness(tokens: list[str], consensus: list[str]) -> float:
    """Twice the common subsequence over both lengths; two empty sequences are equal."""
    if not tokens and not consensus:
        return 1.0
    one = lambda t: [{w: 1.0} for w in t]
    common = len([1 for i, j in align(one(tokens), one(consensus)) if tokens[i] == consensus[j]]) if tokens and consensus else 0
    return 2.0 * common / (len(tokens) + len(consensus))


def consensus(df: DataFrame, group: str, id_col: str, text_col: str, weight_col: str | None = None, block: int = 32) -> DataFrame:
    """(group, id, value, members, closeness, consensus): for each group the existing value of the text that is
    closest to the token consensus of all its values; equally close ones by weight, then by smallest id.

    Null and blank texts have no vote; groups without any other give no row.  Repeated rows count once;
    ``weight_col`` (null counts as 1) weighs the votes, the greatest of an id's rows holding.  ``members``
    is the number of ids with the value."""
    w = F.coalesce(F.col(weight_col), F.lit(1)).cast("double") if weight_col else F.lit(1.0)
    rows = df.filter(F.col(group).isNotNull() & F.col(id_col).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.trim(F.regexp_replace(text_col, r"\s+", " ")).alias("value"), w.alias("w")).filter("value <> ''")
    once = rows.groupBy("g", "id", "value").agg(F.max("w").alias("w"))
    values = stage(once.groupBy("g", "value").agg(F.min("id").alias("id"), F.count("*").alias("members"), F.sum("w").alias("w")), "values")
    sizes = values.groupBy("g").agg(F.count("*").alias("k"))
    start = values.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("value"), F.ceil(F.col("k") / block)))
    profile_schema = T.StructType([T.StructField("g", values.schema["g"].dataType), T.StructField("seq", T.LongType()), T.StructField("profile", T.StringType())])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        prof: Profile = []
        for value, weight in zip(*(pdf.sort_values(["w", "id"], ascending=[False, True])[c] for c in ("value", "w"))):
            prof = merge_profiles(prof, [{t: float(weight)} for t in value.split(" ")])
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "seq": [int(pdf.block.iloc[0])], "profile": [json.dumps(prof)]})

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        prof: Profile = []
        for text in pdf.sort_values("seq").profile:
            prof = merge_profiles(prof, json.loads(text))
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "seq": [int(pdf.seq.min()) // block], "profile": [json.dumps(prof)]})

    profiles = stage(heavy_groups(start.select("g", "value", "id", "w", "block"), "g", "block").applyInPandas(first, profile_schema), "profiles")
    most = profiles.agg(F.max("seq")).first()[0] or 0
    while most > 0:
        profiles = stage(heavy_groups(profiles.withColumn("b", F.floor(F.col("seq") / block)), "g", "b").applyInPandas(lambda pdf: again(pdf.drop(columns="b")), profile_schema), "profiles")
        most = profiles.agg(F.max("seq")).first()[0] or 0

    @F.pandas_udf("string")
    def winner(profile: pd.Series) -> pd.Series:
        return pd.Series([" ".join(vote(json.loads(s))) for s in profile], dtype=object)

    voted = profiles.select("g", winner("profile").alias("consensus"))

    @F.pandas_udf("double")
    def near(value: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([round(closeness(v.split(" "), c.split(" ") if c else []), 6) for v, c in zip(value, wanted)])

    scored = spread(stage(values.join(voted, "g"), "voted")).withColumn("closeness", near("value", "consensus"))
    best = scored.groupBy("g").agg(F.min(F.struct((-F.col("closeness")).alias("c"), (-F.col("w")).alias("w"), "id", "value", "members", "consensus")).alias("b"))
    return best.select(F.col("g").alias(group), F.col("b")["id"].alias("id"), F.col("b")["value"].alias("value"), F.col("b")["members"].alias("members"), (-F.col("b")["c"]).alias("closeness"), F.col("b")["consensus"].alias("consensus"))
