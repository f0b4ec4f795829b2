"""Robust-pruned directed proximity graph over one bounded shard of vectors.

The graph is the Vamana construction in batched numpy form: nodes are inserted in
blocks, a greedy beam search over the graph so far proposes the neighbours of each,
and relaxed distance pruning keeps a few diverse edges.  All distances are taken in
the caller's (usually projected) space; callers re-rank with exact vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NOWHERE = np.float32(-9.0)


@dataclass(frozen=True)
class GraphParams:
    """degree: edges kept by pruning; slack: extra reverse edges before a node is pruned
    again; beam: width of the search list; expand: nodes opened at once; entries: spread
    entry points; alpha: relaxation of the pruning rule; block: nodes inserted together."""

    degree: int = 24
    slack: int = 12
    beam: int = 32
    expand: int = 4
    entries: int = 128
    alpha: float = 1.2
    passes: int = 1
    block: int = 128


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, expand: int):
    """Greedy best-first search of every row of ``q``; returns (ids, sims), best first, -1 where empty."""
    b, n = len(q), len(x)
    beam = min(beam, n)
    seen = np.zeros((b, n), bool)
    seen[:, entries] = True
    ids = np.full((b, beam), -1, np.int32)
    sims = np.full((b, beam), NOWHERE, np.float32)
    first = q @ x[entries].T
    take = min(beam, len(entries))
    top = np.argpartition(-first, take - 1, axis=1)[:, :take]
    ids[:, :take] = entries[top]
    sims[:, :take] = np.take_along_axis(first, top, 1)
    opened = ids < 0
    live = np.arange(b)
    for _ in range(4 * beam):
        rank = np.where(opened[live], NOWHERE, sims[live])
        k = min(expand, beam)
        pick = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        good = np.take_along_axis(rank, pick, 1) > NOWHERE
        keep = good.any(1)
        if not keep.any():
            break
        live, pick, good = live[keep], pick[keep], good[keep]
        rows = live[:, None]
        opened[rows, pick] = True
        nbrs = graph[ids[rows, pick]]
        nbrs[~good] = -1
        nbrs = np.sort(nbrs.reshape(len(live), -1), axis=1)
        fresh = nbrs >= 0
        fresh[:, 1:] &= nbrs[:, 1:] != nbrs[:, :-1]
        fresh &= ~seen[rows, nbrs]
        width = int(fresh.sum(1).max(initial=0))
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        nbrs = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(nbrs, order, 1), -1)
        ok = nbrs >= 0
        r, _ = np.nonzero(ok)
        seen[live[r], nbrs[ok]] = True
        new = np.matmul(x[nbrs], q[live][:, :, None])[:, :, 0]
        new[~ok] = NOWHERE
        all_ids = np.concatenate([ids[live], nbrs], 1)
        all_sims = np.concatenate([sims[live], new], 1)
        all_open = np.concatenate([opened[live], ~ok], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
        opened[live] = np.take_along_axis(all_open, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1: none): the nearest stays and drops every
    candidate that is ``alpha`` times closer to it than to the node, then the next nearest, and so on."""
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == nodes[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    sims = np.matmul(x[cand], x[nodes][:, :, None])[:, :, 0]
    sims[bad] = NOWHERE
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    vecs = x[cand]
    between = 1.0 - np.matmul(vecs, vecs.transpose(0, 2, 1))
    to_node = 1.0 - sims
    alive, used = sims > NOWHERE, np.zeros(len(nodes), np.int32)
    out = np.full((len(nodes), degree), -1, np.int32)
    for j in range(cand.shape[1]):
        keep = alive[:, j] & (used < degree)
        if not keep.any():
            continue
        rows = np.nonzero(keep)[0]
        out[rows, used[rows]] = cand[rows, j]
        used[rows] += 1
        alive[rows] &= alpha * alpha * between[rows, j] > to_node[rows]
    return out


def build(x: np.ndarray, p: GraphParams, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over the rows of ``x``; deterministic for a given seed."""
    n = len(x)
    rng = np.random.default_rng(seed)
    cap = p.degree + p.slack
    graph = np.full((n, cap), -1, np.int32)
    if n > 1:
        graph[:, : min(6, cap)] = rng.integers(0, n, (n, min(6, cap)))
    entries = np.sort(rng.permutation(n)[: p.entries]).astype(np.int32)
    for turn in range(p.passes):
        alpha = p.alpha if turn == p.passes - 1 else 1.0
        order = rng.permutation(n)
        for at in range(0, n, p.block):
            nodes = order[at : at + p.block]
            found, _ = beam_search(x, graph, entries, x[nodes], p.beam, p.expand)
            kept = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], 1), p.degree, alpha)
            graph[nodes] = -1
            graph[nodes, : p.degree] = kept
            _add_reverse(x, graph, nodes, kept, p, alpha)
    return graph, entries


def _add_reverse(x, graph, nodes, kept, p: GraphParams, alpha: float) -> None:
    src = np.repeat(nodes, kept.shape[1]).astype(np.int32)
    dst = kept.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    known = (graph[dst] == src[:, None]).any(1)
    src, dst = src[~known], dst[~known]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, start, count = np.unique(dst, return_index=True, return_counts=True)
    slot = np.arange(len(dst)) - np.repeat(start, count)
    new = np.full((len(targets), int(count.max())), -1, np.int32)
    new[np.repeat(np.arange(len(targets)), count), slot] = src
    merged = np.concatenate([graph[targets], new], 1)
    total = (merged >= 0).sum(1)
    cap = graph.shape[1]
    small = total <= cap
    packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
    graph[targets[small]] = packed[small, :cap]
    for at in range(0, int((~small).sum()), 512):
        rows = np.nonzero(~small)[0][at : at + 512]
        wide = packed[rows][:, : int(total[rows].max())]
        graph[targets[rows]] = -1
        graph[targets[rows], : p.degree] = robust_prune(x, targets[rows], wide, p.degree, alpha)
