"""A cover tree of one chunk of points, and the assignment of its points to centres.

Children of a node lie within half its radius of their own centre and further apart than that
from each other; the first child has the node's own centre. Points are ordered so that a
subtree is one run of them, and cumulative sums along that order give any subtree's sum.
"""

from __future__ import annotations

import numpy as np

LEAF = 16  # points that are not split further
NODE = np.dtype(
    [("centre", "i4"), ("low", "i4"), ("high", "i4"), ("kids", "i4"), ("n_kids", "i4"), ("radius", "f8")]
)
SLACK = 1e-9  # relative; distances are rounded, comparisons of subtrees must be certain


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by centres."""
    gaps = points[:, None, :] - centres[None, :, :]
    return np.einsum("pcd,pcd->pc", gaps, gaps)


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gaps = (points - centre).astype(np.float64)
    return np.sqrt(np.einsum("pd,pd->p", gaps, gaps))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order, nodes``; node 0 is the root, and the children of a node stand in one run."""
    order = np.arange(len(points), dtype=np.int32)
    nodes = [(0, 0, len(points), 0, 0, float(_away(points, points[0]).max()))]
    at = 0
    while at < len(nodes):
        centre, low, high, _, _, radius = nodes[at]
        if high - low > LEAF and radius > 0:
            rest = order[low:high].copy()
            kids, place = len(nodes), low
            while len(rest):
                away = _away(points[rest], points[centre])
                near = away <= radius / 2
                mine = rest[near]
                order[place : place + len(mine)] = mine
                nodes.append((int(centre), place, place + len(mine), 0, 0, float(away[near].max())))
                place += len(mine)
                rest = rest[~near]
                centre = rest[0] if len(rest) else centre
            nodes[at] = (nodes[at][0], low, high, kids, len(nodes) - kids, radius)
        at += 1
    return order, np.array(nodes, NODE)


def _runs(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the runs that start at ``low``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + size, size)


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``low, high, entry`` of the subtrees given to a centre as a whole, and ``place, entry`` of
    the other points; places are positions in ``order``.

    Ties go to the lower entry, so of equal centres only the first can win. A subtree goes to
    a centre when no other one can be as near to any of its points: the triangle inequality on
    its centre's distances and its radius. Otherwise its children are looked at, with the
    centres that are left, and points of a leaf are compared exactly.
    """
    first = np.unique(centres, axis=0, return_index=True)[1]
    allowed = np.zeros((1, len(centres)), bool)
    allowed[0, first] = True
    front = np.zeros(1, np.int64)
    whole: list[np.ndarray] = []
    single: list[np.ndarray] = []
    most = np.iinfo(np.int64).max
    while len(front):
        now = nodes[front]
        exact = np.where(allowed, squared(points[now["centre"]], centres), most)
        away = np.where(allowed, np.sqrt(exact.astype(np.float64)), np.inf)
        reach = now["radius"][:, None]
        bound = (away.min(axis=1, keepdims=True) + reach) * (1 + SLACK)
        allowed = away * (1 - SLACK) - reach <= bound
        # all points of a subtree without radius are its centre
        sure = (allowed.sum(axis=1) == 1) | (now["radius"] == 0)
        entry = np.where(now["radius"] == 0, exact.argmin(axis=1), allowed.argmax(axis=1))
        whole.append(np.stack([now["low"][sure], now["high"][sure], entry[sure]], axis=1))
        leaf = ~sure & (now["n_kids"] == 0)
        size = (now["high"] - now["low"])[leaf]
        places = _runs(now["low"][leaf], size)
        if len(places):
            open_ = np.repeat(allowed[leaf], size, axis=0)
            found = np.where(open_, squared(points[order[places]], centres), most).argmin(axis=1)
            single.append(np.stack([places, found], axis=1))
        inner = ~sure & (now["n_kids"] > 0)
        kids = now["n_kids"][inner]
        front = _runs(now["kids"][inner].astype(np.int64), kids)
        allowed = np.repeat(allowed[inner], kids, axis=0)
    return np.concatenate(whole), np.concatenate([np.empty((0, 2), np.int64), *single])


def sums(
    points: np.ndarray, order: np.ndarray, nodes: np.ndarray, centres: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """How many points each centre gets, and their sums."""
    whole, single = assign(points, order, nodes, centres)
    total = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points[order], axis=0, out=total[1:])
    counts = np.zeros(len(centres), np.int64)
    added = np.zeros(centres.shape, np.int64)
    low, high, entry = whole.T
    np.add.at(counts, entry, high - low)
    np.add.at(added, entry, total[high] - total[low])
    np.add.at(counts, single[:, 1], 1)
    np.add.at(added, single[:, 1], points[order[single[:, 0]]])
    return counts, added


def entries(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of every point."""
    whole, single = assign(points, order, nodes, centres)
    low, high, entry = whole.T
    out = np.empty(len(points), np.int64)
    out[order[_runs(low, high - low)]] = np.repeat(entry, high - low)
    out[order[single[:, 0]]] = single[:, 1]
    return out
