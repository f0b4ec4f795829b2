"""Directed-attention nomination: lookers pick targets, strongest look first, under shared degree caps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def nominate(rows: pd.DataFrame, threshold: float = 0.22, coherence: float = 0.05, dominance: float = 0.55, per_looker: int = 4, per_target: int = 3, burst: float = 300.0) -> pd.DataFrame:
    """(leftid, rightid, lookerid, coherence) of one scope.  ``rows``: id, gaze, x, date, faces, humans, dominance.

    Unknown humans exclude a looker, unknown centroid or dominance a target; unknown dates are no burst.
    Targets are sorted once for either side; those that are full drop out of the sorted lists, so a looker
    reads little more than it takes."""
    rows = rows.drop_duplicates("id")
    lookers = rows[(rows.gaze.abs() >= threshold) & (rows.faces == 1) & (rows.humans.fillna(99) <= 1)]
    lookers = lookers.assign(s=-lookers.gaze.abs()).sort_values(["s", "id"])
    targets = rows[rows.x.notna() & (rows.dominance.fillna(0) >= dominance)]
    right = [(0.5 - x, i, d) for i, x, d in zip(targets.id, targets.x, targets.date)]
    left = [(-c, i, d) for c, i, d in right]
    lists = {side: sorted((t for t in ts if t[0] >= coherence), key=lambda t: (-t[0], t[1])) for side, ts in ((True, right), (False, left))}
    degree: dict[int, int] = {}
    seen, out = set(), []
    for lk in lookers.itertuples(index=False):
        todo = per_looker - degree.get(lk.id, 0)
        side, taken, full = lk.gaze > 0, 0, 0
        for coh, tid, date in lists[side]:
            if taken >= todo:
                break
            if degree.get(tid, 0) >= per_target:
                full += 1
                continue
            key = (min(lk.id, tid), max(lk.id, tid))
            if tid == lk.id or key in seen or (pd.notna(lk.date) and pd.notna(date) and abs(lk.date - date) <= burst):
                continue
            out.append((lk.id, tid, lk.id, coh) if side else (tid, lk.id, lk.id, coh))
            seen.add(key)
            degree[lk.id] = degree.get(lk.id, 0) + 1
            degree[tid] = degree.get(tid, 0) + 1
            taken += 1
        if full > 256:
            lists[side] = [t for t in lists[side] if degree.get(t[1], 0) < per_target]
    return pd.DataFrame(out, columns=["leftid", "rightid", "lookerid", "coherence"])


def nominate_by(df: DataFrame, scope: str, **limits) -> DataFrame:
    """The nomination inside each scope (a folder).  It is a loop by definition - every choice depends on the
    ones before - so a scope is one task; only lookers and possible targets are sent to it."""
    t, c, d = limits.get("threshold", 0.22), limits.get("coherence", 0.05), limits.get("dominance", 0.55)
    useful = df.filter(f"(abs(gaze) >= {t} AND faces = 1 AND coalesce(humans, 99) <= 1) OR (x IS NOT NULL AND abs(x - 0.5) >= {c} - 1e-9 AND coalesce(dominance, 0) >= {d})")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return nominate(pdf, **limits).assign(**{scope: pdf[scope].iloc[0]})

    kind = df.schema[scope].dataType.simpleString()
    return useful.groupBy(scope).applyInPandas(run, f"leftid long, rightid long, lookerid long, coherence double, {scope} {kind}")
