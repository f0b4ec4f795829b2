"""Pair kernels as column expressions.  All compute in double; null inputs follow the docstrings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _same(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def clip_similarity(a: Column, b: Column) -> Column:
    """(dot + 1) / 2 of unit vectors; 0 for null, empty or unequally long ones."""
    return F.when(_same(a, b), (dot(a, b) + 1) / 2).otherwise(F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 in [0, 1]; 0 for null, empty, unequally long or vanishing vectors."""
    denom = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(_same(a, b) & (denom > 1e-8), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / denom + 1) / 2))).otherwise(F.lit(0.0))


def histogram_intersection(a: Column, b: Column) -> Column:
    return F.when(_same(a, b), _sum(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")))).otherwise(F.lit(0.0))


def palette_contrast(a: Column, b: Column) -> Column:
    """Mean distance of all 36 colour pairs of two six-colour palettes over 100, at most 1; 0 unless both have 18 values."""
    at = lambda p, i: F.element_at(p, i).cast("double")
    starts = F.sequence(F.lit(1), F.lit(16), F.lit(3))
    dist = lambda i, j: F.sqrt(reduce(lambda u, v: u + v, [(at(a, i + k) - at(b, j + k)) * (at(a, i + k) - at(b, j + k)) for k in range(3)]))
    total = F.aggregate(starts, F.lit(0.0), lambda acc, i: acc + _sum(F.transform(starts, lambda j: dist(i, j))))
    return F.when((F.size(a) == 18) & (F.size(b) == 18), F.least(total / 36 / 100, F.lit(1.0))).otherwise(F.lit(0.0))


def accent_echo(hue_a: Column, sat_a: Column, hue_b: Column, sat_b: Column) -> Column:
    """Closeness of two accent hues times their mean saturation, damped for dull warm hues; 0 if any is null."""
    diff = F.abs(hue_a - hue_b)
    d = F.least(diff, 360 - diff)
    hue = F.when(d <= 10, F.lit(1.0)).when(d <= 30, (30 - d) / 20).otherwise(F.lit(0.0))
    warm = hue_a.between(15, 35) | hue_b.between(15, 35)
    ramp = F.when(warm, F.least(F.greatest((F.least(sat_a, sat_b) - 0.45) / 0.20, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    known = hue_a.isNotNull() & hue_b.isNotNull() & sat_a.isNotNull() & sat_b.isNotNull()
    return F.when(known, hue * F.sqrt(sat_a * sat_b) * ramp).otherwise(F.lit(0.0))


def aesthetic(harmony: Column, contrast: Column, echo: Column, both_bw: Column) -> tuple[Column, Column]:
    """(score, submode): the echo only if above both others, then harmony before contrast."""
    scale = F.when(both_bw, F.lit(0.65)).otherwise(F.lit(1.0))
    h, c = harmony * scale, contrast * scale
    wins = (echo > h) & (echo > c)
    return F.when(wins, echo).otherwise(F.greatest(h, c)), F.when(wins, "accent_echo").when(h >= c, "harmony").otherwise("contrast")


def norm_peak(edge: Column) -> Column:
    """Peakedness of a 32-bin edge histogram over its anchor, at most 1."""
    return F.least(F.array_max(edge).cast("double") * 32 / 4.0, F.lit(1.0))


def grid_deviation(grid: Column) -> Column:
    """Population standard deviation of the first 16 cells; 0 for shorter grids."""
    head = F.slice(grid, 1, 16)
    mean = _sum(F.transform(head, lambda x: x.cast("double"))) / 16
    return F.when(F.size(grid) >= 16, F.sqrt(_sum(F.transform(head, lambda x: (x - mean) * (x - mean))) / 16)).otherwise(F.lit(0.0))


def norm_variance(grid: Column) -> Column:
    return F.least(grid_deviation(grid) / 0.20, F.lit(1.0))


def edge_multiplier(pa: Column, pb: Column) -> Column:
    product = F.pow(pa * pb, F.lit(0.4))
    return F.when(F.abs(pa - pb) > 0.5, F.greatest(product, F.pow(F.greatest(pa, pb), F.lit(0.4)) * 0.6)).otherwise(product)


def variance_multiplier(va: Column, vb: Column) -> Column:
    return F.pow(va * vb, F.lit(0.4))


def directional_complement(xa: Column, ya: Column, xb: Column, yb: Column, va: Column, vb: Column) -> Column:
    known = xa.isNotNull() & ya.isNotNull() & xb.isNotNull() & yb.isNotNull() & (F.greatest(va, vb) >= 0.1)
    score = (F.abs(xa - xb) * 0.70 + F.abs(ya - yb) * 0.30) * F.sqrt(F.least(va, F.lit(1.0)) * F.least(vb, F.lit(1.0)))
    return F.when(known, score).otherwise(F.lit(0.0))


def gaze_conversation(ga: Column, gb: Column) -> Column:
    """How far the left image looks right and the right one left; null gaze gives null."""
    n = lambda g: F.least(F.greatest(g / 0.30, F.lit(-1.0)), F.lit(1.0))
    return F.when(ga.isNotNull() & gb.isNotNull(), F.greatest(F.lit(0.0), (n(ga) - n(gb)) / 2))


def dominant_line(edge: Column) -> Column:
    """The undirected bin (0 to 15) of the strongest of 32 edge directions, the first on a tie; null for fewer bins."""
    return F.when(F.size(edge) >= 32, F.pmod(F.array_position(edge, F.array_max(edge)) - 1, F.lit(16)).cast("double"))


def orientation_opposition(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    """How far two dominant slanted lines cross, from their bins and peakednesses; 0 for unclear or level lines."""
    slanted = lambda x: F.abs(F.sin(x * F.lit(3.141592653589793) / 8)) >= 0.5
    diff = F.abs(a - b)
    score = F.sin(F.least(diff, 16 - diff) * F.lit(3.141592653589793) / 16) * F.sqrt(pa * pb)
    ok = (pa >= 0.25) & (pb >= 0.25) & slanted(a) & slanted(b)
    return F.when(ok, score).otherwise(F.lit(0.0))


def geometric(structural: Column, centroid: Column, gaze: Column, orientation: Column, va: Column, vb: Column) -> tuple[Column, Column]:
    """(score, submode) from the structural part and the three directional ones."""
    directional = F.greatest(centroid, gaze, orientation)
    score = structural * 0.50 + directional * 0.25 + F.abs(va - vb) * 0.25
    mode = F.when(directional <= structural, "structural").when((gaze >= centroid) & (gaze >= orientation), "gaze_conversation").when(orientation >= centroid, "opposing_diagonals").otherwise("directional_complement")
    return score, mode


def diversity(clip: Column) -> Column:
    return F.when(clip < 0.30, F.lit(1.35)).when(clip < 0.60, F.lit(1.0)).when(clip < 0.88, F.lit(0.75)).otherwise(F.lit(1.0))


def temporal_penalty(a: Column, b: Column) -> Column:
    """1 for unknown times."""
    gap = F.abs(a - b)
    return F.when(gap <= 30, F.lit(0.40)).when(gap <= 60, F.lit(0.55)).when(gap <= 120, F.lit(0.75)).when(gap <= 300, F.lit(0.90)).otherwise(F.lit(1.0))


def is_burst(a: Column, b: Column, variants: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 300, F.lit(False)) | variants


def event_factor(a: Column, b: Column, shares: Column) -> Column:
    """Discount for captions that share a meaningful cluster within six hours; 1 for unknown times."""
    gap = F.abs(a - b)
    within = (gap > 300) & (gap <= 21600) & shares
    return F.when(within & (gap <= 1800), F.lit(0.70)).when(within & (gap <= 7200), F.lit(0.80)).when(within, F.lit(0.90)).otherwise(F.lit(1.0))


def composite(aes: Column, geo: Column, them: Column, clip: Column, captions: Column, variants: Column, ta: Column, tb: Column, weights=(0.4, 0.2, 0.4)) -> Column:
    """The ordered chain of weighting, redundancy, thematic boost, similarity ceiling and time."""
    base = aes * weights[0] + geo * weights[1] + them * weights[2]
    base = F.when(~captions & (them > 0.80), base * 0.45).otherwise(base)
    boosted = captions & (them >= 0.20) & (them >= F.greatest(aes, geo * 0.8))
    base = F.when(boosted, aes * 0.25 + geo * 0.15 + them * 0.60).otherwise(base)
    base = F.when(clip > 0.88, base * 0.40).when((clip > 0.75) & (them < 0.20), base * 0.65).otherwise(base)
    return F.when(variants, F.lit(0.0)).otherwise(base * temporal_penalty(ta, tb))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 64 if one is null or not such a hash."""
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    num = lambda h: F.conv(h, 16, -10).cast("long")
    return F.when(F.coalesce(ok, F.lit(False)), F.bit_count(num(F.when(ok, a)).bitwiseXOR(num(F.when(ok, b))))).otherwise(F.lit(64))


def gaze_clarity(gaze_abs: Column, coherence: Column) -> Column:
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.lit(0.60) + F.lit(0.35) * (F.lit(0.5) * unit((gaze_abs - 0.22) / 0.38) + F.lit(0.5) * unit(coherence / 0.45))


def clarity_to_geometric(clarity: Column) -> Column:
    return F.least(F.greatest(F.lit(0.50) + (clarity - 0.60) / 0.35 * 0.26, F.lit(0.50)), F.lit(0.76))


def effective_thematic(cluster: Column, judged: Column, hypothesis: Column, event: Column) -> Column:
    """The thematic score that counts: the judged one where there is one, but the clusters' where a judged score of 0
    only rejects a hypothesis; discounted by the event factor."""
    rejected = hypothesis.isNotNull() & F.coalesce(judged == 0, F.lit(False))
    return F.when(rejected, cluster).otherwise(F.coalesce(judged, cluster)) * event


def display_geometric(edge: Column, grid: Column, edge_mult: Column, grid_mult: Column, peak: Column, var: Column, stored: Column, peak_floor: float = 2.2, var_floor: float = 0.12) -> Column:
    """Structural score with hard floors wherever the raw similarities exist, else the stored score."""
    e = edge * F.coalesce(edge_mult, F.lit(1.0)) * F.when(peak < peak_floor, F.lit(0.40)).otherwise(F.lit(1.0))
    g = grid * F.coalesce(grid_mult, F.lit(1.0)) * F.when(var < var_floor, F.lit(0.50)).otherwise(F.lit(1.0))
    return F.when(edge.isNotNull() & grid.isNotNull(), (e + g) / 2).otherwise(stored)


def modality(selected: Column, aes: Column, geo: Column, them: Column) -> Column:
    return (
        F.when(selected == "thematic", "thematic").when(selected == "aesthetic", "aesthetic").when((them >= 0.25) & (them > geo), "thematic").when(geo >= aes, "geometric").otherwise("aesthetic")
    )


def axis_score(aes: Column, geo: Column, them: Column, penalty: Column, weights=(0.4, 0.2, 0.4)) -> tuple[Column, Column]:
    """(display composite, axis score)."""
    shown = (aes * weights[0] + geo * weights[1] + them * weights[2]) * penalty
    peak = F.greatest(aes, geo * 0.8, them) * penalty
    return shown, peak * 0.6 + shown * 0.4


def color_tone(a: Column, b: Column) -> Column:
    bw = lambda c: F.coalesce(c == "bw", F.lit(False))
    return F.when(bw(a) & bw(b), "bothBW").when(~bw(a) & ~bw(b), "bothColor").otherwise("mixed")
