"""The exact threshold-free cluster transform of one map, from a merge tree of the basins of its maxima.

Every positive element points to its highest neighbour; following the pointers assigns it to the basin of one maximum. Only
the highest saddle between two basins can join them, so the merge tree is built over basins (a small share of the elements)
and everything about elements is an array operation. On a branch of the tree the component grows by the branch's own elements
in descending order, so the integral of ``size**E * h**H`` along it is a running sum.
"""

from __future__ import annotations

import math

import numpy as np

#: Largest sum of absolute steps of a neighbour for each connectivity.
REACH = {6: 1, 18: 2, 26: 3}


def half_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite steps to a neighbour."""
    if connectivity not in REACH:
        raise ValueError(f"connectivity must be 6, 18 or 26, not {connectivity}")
    steps = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return [s for s in steps if 0 < sum(map(abs, s)) <= REACH[connectivity] and (s[2], s[1], s[0]) > (0, 0, 0)]


def _slices(step: int, n: int) -> tuple[slice, slice]:
    return slice(max(0, -step), n - max(0, step)), slice(max(0, step), n - max(0, -step))


class Grid:
    """Neighbours of a grid whose elements are numbered with x fastest."""

    def __init__(self, shape: tuple[int, int, int], connectivity: int = 26):
        self.shape = tuple(map(int, shape))
        if len(self.shape) != 3 or min(self.shape) < 1:
            raise ValueError(f"a grid has three sizes of 1 or more, not {shape}")
        self.n = math.prod(self.shape)
        self.offsets = half_offsets(connectivity)

    def pairs(self, values: np.ndarray):
        """For each step the values at both ends of all edges along it."""
        cube = values.reshape(self.shape[::-1])  # z, y, x
        for x, y, z in self.offsets:
            (a, b), (c, d), (e, f) = _slices(z, self.shape[2]), _slices(y, self.shape[1]), _slices(x, self.shape[0])
            yield cube[a, c, e], cube[b, d, f]

    def lowest(self, rank: np.ndarray) -> np.ndarray:
        """The least rank among each element and its neighbours."""
        best = rank.copy()
        for (a, b), (p, q) in zip(self.pairs(rank), self.pairs(best)):
            np.minimum(p, b, out=p)
            np.minimum(q, a, out=q)
        return best


class Mesh:
    """Neighbours given by edges; both directions hold, repeats and loops are dropped."""

    def __init__(self, n: int, src, dst):
        src, dst = np.asarray(src, np.int64), np.asarray(dst, np.int64)
        if len(src) and (min(src.min(), dst.min()) < 0 or max(src.max(), dst.max()) >= n):
            raise ValueError("an edge ends outside the map")
        self.n = n
        edges = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], 1)[src != dst], axis=0)
        self.src, self.dst = edges[:, 0], edges[:, 1]

    @classmethod
    def from_csr(cls, indptr, indices) -> Mesh:
        indptr = np.asarray(indptr, np.int64)
        if len(indptr) < 1 or indptr[-1] != len(indices):
            raise ValueError("the last row pointer must be the number of indices")
        return cls(len(indptr) - 1, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), indices)

    def pairs(self, values: np.ndarray):
        yield values[self.src], values[self.dst]

    def lowest(self, rank: np.ndarray) -> np.ndarray:
        best = rank.copy()
        np.minimum.at(best, self.src, rank[self.dst])
        np.minimum.at(best, self.dst, rank[self.src])
        return best


def basins(values: np.ndarray, space):
    """The basins of the positive part of a map, or None without one.

    Returned are ``order`` (the positive elements by falling value, then id), their ``rank`` (of every element; others have the number of positive
    ones), ``basin`` of each rank, the ranks of the ``peaks``, and the highest saddle ``a, b, low`` between each two basins, by rank.
    """
    with np.errstate(invalid="ignore"):
        inside = np.flatnonzero(values > 0)
    n = len(inside)
    if not n:
        return None
    order = inside[np.argsort(-values[inside], kind="stable")]
    rank = np.full(len(values), n, np.int64)
    rank[order] = np.arange(n)

    top = space.lowest(rank)[order]
    while True:
        further = top[top]
        if (further == top).all():
            break
        top = further
    peaks = np.flatnonzero(top == np.arange(n))
    basin = np.searchsorted(peaks, top)
    k = len(peaks)

    keys = []
    basin_of = np.append(basin, -1)
    for a, b in space.pairs(rank):
        low = np.maximum(a, b).ravel()
        x, y = basin_of[a.ravel()], basin_of[b.ravel()]
        cross = (low < n) & (x != y)
        x, y, low = x[cross], y[cross], low[cross]
        keys.append(np.stack([np.minimum(x, y) * k + np.maximum(x, y), low]))
    pair, low = np.concatenate(keys, 1) if keys else np.empty((2, 0), np.int64)
    if k * k < (1 << 62) // max(n, 1):
        packed = np.sort(pair * n + low)
        pair, low = packed // n, packed % n
    else:
        by = np.lexsort((low, pair))
        pair, low = pair[by], low[by]
    first = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.empty(0, bool)
    pair, low = pair[first], low[first]
    by = np.argsort(low, kind="stable")
    return order, rank, basin, peaks, pair[by] // k, pair[by] % k, low[by]


def _positive_pass(values: np.ndarray, space, e: float, h: float) -> np.ndarray:
    """The transform of the positive part of a float32 map; 0 elsewhere."""
    out = np.zeros(len(values))
    found = basins(values, space)
    if found is None:
        return out
    order, _, basin, peaks, first_of, second_of, low = found
    n, k, height = len(order), len(peaks), values[order].astype(float)

    # Branches: one for each basin, and one for each union; a branch starts at the rank of the element that made it.
    parent, start = list(range(k)), peaks.tolist()
    left, right = [-1] * k, [-1] * k
    root = list(range(k))
    branch = list(range(k))
    for a, b, at in zip(first_of.tolist(), second_of.tolist(), low.tolist()):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            new = len(parent)
            x, y = branch[a], branch[b]
            parent[x] = parent[y] = new
            parent.append(new)
            start.append(at)
            left.append(x)
            right.append(y)
            if b < a:
                a, b = b, a
            root[b] = a
            branch[a] = new
    parent_a, start_a = np.array(parent), np.array(start)
    own_branch = basin.copy()
    lifts = [parent_a]
    while (lifts[-1] != lifts[-1][lifts[-1]]).any():
        lifts.append(lifts[-1][lifts[-1]])
    ranks = np.arange(n)
    for lift in reversed(lifts):
        up = lift[own_branch]
        own_branch = np.where(start_a[up] <= ranks, up, own_branch)

    count = np.bincount(own_branch, minlength=len(parent))
    before = [0] * len(parent)
    total = count.tolist()
    for c in range(k, len(parent)):
        before[c] = total[left[c]] + total[right[c]]
        total[c] += before[c]
    by = np.argsort(own_branch, kind="stable")  # a branch's elements in descending order of height
    begins = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(n) - begins[own_branch[by]] + 1
    power = height[by] ** (h + 1)
    end_rank = np.where(parent_a == np.arange(len(parent)), n, start_a[parent_a])
    end_power = np.append(height, 0.0)[end_rank] ** (h + 1)
    below_power = np.append(power[1:], 0.0)
    last = begins[1:][count > 0] - 1
    below_power[last] = end_power[count > 0]
    piece = (np.asarray(before)[own_branch[by]] + place).astype(float) ** e * (power - below_power) / (h + 1)
    running = np.cumsum(piece.astype(np.longdouble)[::-1])[::-1]
    after = np.append(running, 0)[begins[1:]]
    inner = np.empty(n)
    inner[by] = (running - after[own_branch[by]]).astype(float)
    below = [0.0] * len(parent)
    inner_l, own_l = inner, own_branch
    for c in range(len(parent) - 1, -1, -1):
        if parent[c] != c:
            r = start[parent[c]]
            below[c] = float(inner_l[r]) + below[own_l[r]]
    out[order] = inner + np.asarray(below)[own_branch]
    return out


def clean(values) -> np.ndarray:
    """A map as float32 with non-finite values made 0."""
    v = np.asarray(values)
    if np.iscomplexobj(v):
        raise TypeError("complex maps are refused")
    v = v.astype(np.float32).ravel()
    return np.where(np.isfinite(v), v, np.float32(0))


def tfce(values, space, e: float = 0.5, h: float = 2.0, two_sided: bool = True) -> np.ndarray:
    """The exact transform of one map as float32, negative parts enhanced on their own and negated if ``two_sided``."""
    if not (math.isfinite(e) and math.isfinite(h)) or h <= -1:
        raise ValueError("E and H must be finite, and H above -1")
    v = clean(values)
    if len(v) != space.n:
        raise ValueError(f"the map has {len(v)} elements, its neighbourhood {space.n}")
    out = _positive_pass(v, space, e, h).astype(np.float32)
    if two_sided and (v < 0).any():
        out = out - _positive_pass(-v, space, e, h).astype(np.float32)
    return out


def _find(root: np.ndarray, a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def edges_of(space, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between kept elements."""
    src, dst = [], []
    ids = np.where(keep, np.arange(space.n), -1)
    for a, b in space.pairs(ids):
        ok = (a >= 0) & (b >= 0)
        src.append(a[ok])
        dst.append(b[ok])
    return np.concatenate(src) if src else np.empty(0, np.int64), np.concatenate(dst) if dst else np.empty(0, np.int64)


def labels(space, keep) -> np.ndarray:
    """Component of each kept element, as its smallest element; -1 elsewhere. Labels are lowered along edges with pointer jumps."""
    keep = np.asarray(keep, bool)
    label = np.where(keep, np.arange(space.n), -1)
    src, dst = edges_of(space, keep)
    while len(src):
        a, b = label[src], label[dst]
        diff = a != b
        if not diff.any():
            break
        src, dst, a, b = src[diff], dst[diff], a[diff], b[diff]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            inside = label >= 0
            jumped = label.copy()
            jumped[inside] = label[label[inside]]
            if (jumped == label).all():
                break
            label = jumped
    return label


def stepped(values, space, steps: int, e: float = 0.5, h: float = 2.0, rule: str = "right") -> np.ndarray:
    """The transform by a Riemann sum with ``steps`` thresholds up to the maximum (``rule``: right ends or midpoints), for comparison."""
    v = clean(values).astype(float)
    out = np.zeros(len(v))
    for sign in (1, -1):
        d = sign * v
        if d.max(initial=0) <= 0:
            continue
        dh = d.max() / steps
        for i in range(steps):
            level = (i + 1) * dh if rule == "right" else (i + 0.5) * dh
            found = labels(space, d >= level)
            inside = found >= 0
            size = np.bincount(found[inside], minlength=len(v))
            out[inside] += sign * size[found[inside]].astype(float) ** e * level**h * dh
    return out


def tree_nodes(values, space) -> list[tuple[int, int, float, float]]:
    """Nodes of the component tree of the positive part as (parent, size, birth, death): one for each component that changed at
    a level; a root's parent is -1 and its death 0. Children come before their parents."""
    v = clean(values)
    inside = np.flatnonzero(v > 0)
    order = inside[np.argsort(-v[inside], kind="stable")].tolist()
    src, dst = edges_of(space, v > 0)
    near: dict[int, list[int]] = {i: [] for i in order}
    for a, b in zip(src.tolist(), dst.tolist()):
        near[a].append(b)
        near[b].append(a)
    root, size, node = {}, {}, {}
    nodes: list[list] = []
    k = 0
    while k < len(order):
        level = v[order[k]]
        changed: list[int] = []
        merged: dict[int, list[int]] = {}
        while k < len(order) and v[order[k]] == level:
            i = order[k]
            root[i], size[i] = i, 1
            changed.append(i)
            for j in near[i]:
                if j in root:
                    a, b = _find(root, i), _find(root, j)
                    if a != b:
                        if size[a] < size[b]:
                            a, b = b, a
                        root[b] = a
                        size[a] += size[b]
                        merged.setdefault(a, []).extend(merged.pop(b, []))
                        if b in node:
                            merged[a].append(node.pop(b))
            k += 1
        for a in sorted({_find(root, i) for i in changed}):
            old = merged.pop(a, [])
            if a in node:
                old.append(node[a])
            nodes.append([-1, size[a], float(level), 0.0])
            for o in old:
                nodes[o][0], nodes[o][3] = len(nodes) - 1, float(level)
            node[a] = len(nodes) - 1
    return [tuple(x) for x in nodes]


def faces_to_edges(faces, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges, sorted and distinct, of triangles with vertices numbered from 1."""
    f = np.asarray(faces)
    if f.ndim != 2 or f.shape[1] != 3:
        raise ValueError("faces must have three columns")
    f = f.astype(np.int64)
    if len(f) and (f.min() < 1 or f.max() > n):
        raise ValueError(f"a face names a vertex outside 1..{n}")
    f = f - 1
    both = np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]], f[:, [1, 0]], f[:, [2, 1]], f[:, [0, 2]]])
    both = np.unique(both, axis=0)
    return both[:, 0], both[:, 1]
