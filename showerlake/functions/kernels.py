"""Clustering of the points of one group, in numpy.

`hdbscan` follows Campello et al. (2013) and McInnes & Healy (2017): core
distances count the point itself, the tree is condensed by min_cluster_size and
clusters are chosen by excess of mass, never the root. `ward` merges by Ward's
criterion while the merge height is below a threshold.
"""

from __future__ import annotations

import numpy as np

#: Rows of a distance matrix that are held at once.
CHUNK = 1024


def _core_distances(x: np.ndarray, k: int) -> np.ndarray:
    core = np.empty(len(x))
    for a in range(0, len(x), CHUNK):
        d = np.sqrt(np.maximum(((x[a : a + CHUNK, None, :] - x[None, :, :]) ** 2).sum(2), 0))
        core[a : a + CHUNK] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return core


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree of mutual reachability: memory grows with the points, not their pairs."""
    n = len(x)
    best, parent, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    a, b, w = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    now = 0
    for i in range(n - 1):
        out[now] = True
        reach = np.maximum(np.sqrt(((x - x[now]) ** 2).sum(1)), np.maximum(core, core[now]))
        closer = ~out & (reach < best)
        best[closer], parent[closer] = reach[closer], now
        now = int(np.where(out, np.inf, best).argmin())
        a[i], b[i], w[i] = parent[now], now, best[now]
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


def hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int, epsilon: float = 0.0) -> np.ndarray:
    """Labels from 0, -1 for noise."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 2 or n < min_cluster_size:
        return np.full(n, -1)
    a, b, w = _spanning_tree(x, _core_distances(x, min(min_samples, n)))
    root = np.arange(2 * n - 1)
    left, right, height, size = {}, {}, {}, np.ones(2 * n - 1, int)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(n - 1):  # single linkage, node n + k
        p, q, node = find(a[k]), find(b[k]), n + k
        left[node], right[node], height[node] = p, q, w[k]
        size[node] = size[p] + size[q]
        root[p] = root[q] = node
    leaves_of = lambda top: _leaves(top, left, right, n)
    # condensed tree: clusters are born where both sides are large enough
    birth, parent, children = {0: 0.0}, {0: -1}, {0: []}
    stability, members, gone = {0: 0.0}, {0: leaves_of(2 * n - 2)}, {}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            continue
        level = 1 / height[node] if height[node] > 0 else np.inf
        sides = [left[node], right[node]]
        large = [s for s in sides if size[s] >= min_cluster_size]
        stay = lambda count, c=cluster, at=level: (min(at, 1e300) - birth[c]) * count
        if len(large) == 2:
            stability[cluster] += stay(size[node])
            for s in sides:
                new = len(birth)
                birth[new], parent[new], children[new], stability[new] = min(level, 1e300), cluster, [], 0.0
                members[new] = leaves_of(s)
                children[cluster].append(new)
                todo.append((s, new))
        else:
            for s in sides:
                if s in large:
                    todo.append((s, cluster))
                else:
                    stability[cluster] += stay(size[s])
                    for leaf in leaves_of(s):
                        gone[leaf] = (cluster, level)
    chosen, total = set(), dict(stability)
    for c in sorted(birth, reverse=True):
        if c == 0:
            continue
        below = sum(total[x] for x in children[c])
        if children[c] and below > stability[c]:
            total[c] = below
        else:
            chosen -= _descendants(c, children)
            chosen.add(c)
    if epsilon > 0:
        merged = set()
        for c in chosen:
            top = c
            while parent[top] > 0 and 1 / max(birth[top], 1e-300) < epsilon:
                top = parent[top]
            merged.add(top)
        chosen = {c for c in merged if not any(c in _descendants(o, children) for o in merged if o != c)}
    labels = np.full(n, -1)
    for k, c in enumerate(sorted(chosen)):
        labels[members[c]] = k
    return labels


def _leaves(top: int, left: dict, right: dict, n: int) -> np.ndarray:
    found, todo = [], [top]
    while todo:
        node = todo.pop()
        if node < n:
            found.append(node)
        else:
            todo += [left[node], right[node]]
    return np.array(found, int)


def _descendants(c: int, children: dict) -> set[int]:
    found, todo = set(), list(children[c])
    while todo:
        x = todo.pop()
        found.add(x)
        todo += children[x]
    return found


def ward(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels by first member; a merge at the threshold or above is not made."""
    x = np.asarray(x, float)
    n = len(x)
    labels = np.arange(n)
    if n < 2:
        return labels
    centre, size, alive = x.copy(), np.ones(n), np.ones(n, bool)

    def heights(i: int) -> np.ndarray:
        h = np.sqrt(2 * size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(1))
        h[i] = np.inf
        return np.where(alive, h, np.inf)

    near = np.array([heights(i).argmin() for i in range(n)])
    low = np.array([heights(i)[near[i]] for i in range(n)])
    while alive.sum() > 1:
        i = int(np.where(alive, low, np.inf).argmin())
        if low[i] >= threshold:
            break
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        labels[labels == j] = i
        own = heights(i)
        near[i], low[i] = own.argmin(), own.min()
        for k in np.flatnonzero(alive & ((near == i) | (near == j) | (own < low))):
            if k != i:
                h = heights(k)
                near[k], low[k] = h.argmin(), h.min()
    return np.unique(labels, return_inverse=True)[1]
