"""Clusterings of weighted match graphs.

Connected components run on whole tables. The other algorithms look at a component as a whole, so each
connected component is clustered alone, in one group, over the lists of its edges: memory and time of a task follow the
edges of its component and not the square of its nodes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .records import number_clusters

Members = list[list[int]]
#: products of two flows that are held at once
CHUNK = 1 << 22
#: flows below this are dropped
LEAST_FLOW = 1e-6
#: eigenvectors that are looked at for the widest gap, and nodes up to which all are computed at once
MOST_VECTORS, FEW_NODES = 64, 1000


class Graph:
    """An undirected weighted graph by lists: entries (row, column, value) both ways, by column and row; diagonals are allowed."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.n = n
        code = np.asarray(column, np.int64) * n + np.asarray(row, np.int64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        self.value = np.add.reduceat(np.asarray(value, float)[order], first) if len(first) else np.zeros(0)
        self.row, self.column = code[first] % n, code[first] // n
        self.start = np.searchsorted(self.column, np.arange(n + 1))

    @classmethod
    def of_edges(cls, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> Graph:
        """From one entry for each pair of different nodes."""
        i, j, w = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(w, float)
        return cls(n, np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w]))

    def sums(self) -> np.ndarray:
        return np.bincount(self.column, weights=self.value, minlength=self.n)

    def times(self, x: np.ndarray) -> np.ndarray:
        """The matrix by columns of vectors."""
        return np.stack([np.bincount(self.column, weights=self.value * x[self.row, k], minlength=self.n) for k in range(x.shape[1])], axis=1)


def components(nodes: DataFrame, edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """E5. (ref, cluster_id): weakly connected components over edges above a weight; nodes without edges are alone."""
    found = connected_components(edges.filter(F.col("weight") > threshold), "src", "dst")
    rows = nodes.select("ref").join(found, F.col("ref") == F.col("node"), "left").select("ref", F.coalesce("component", "ref").alias("key"))
    return number_clusters(rows, "key").drop("key")


def _squared(g: Graph) -> Graph:
    """The product of a matrix with itself, some columns at a time."""
    lengths = np.diff(g.start)[g.row]  # an entry (k, c) meets all of column k
    cost = np.concatenate([[0], np.cumsum(lengths)])
    parts, at = [], 0
    while at < g.n:
        to = max(at + 1, int(np.searchsorted(cost[g.start], cost[g.start[at]] + CHUNK, side="right")) - 1)
        e = slice(g.start[at], g.start[to])
        n = lengths[e]
        ends = np.cumsum(n)
        places = np.repeat(g.start[g.row[e]] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        parts.append(Graph(g.n, g.row[places], np.repeat(g.column[e], n), g.value[places] * np.repeat(g.value[e], n)))
        at = to
    return Graph(g.n, *(np.concatenate([getattr(p, k) for p in parts]) for k in ("row", "column", "value")))


def _stochastic(g: Graph, power: float = 1.0) -> Graph:
    value = g.value**power
    return Graph(g.n, g.row, g.column, value / np.bincount(g.column, weights=value, minlength=g.n)[g.column])


def markov(g: Graph, inflation: float = 2.0, rounds: int = 100) -> Members:
    """E6. Expansion and inflation of a random walk until it stands still; attractors' basins are clusters."""
    loops = np.arange(g.n)
    flow = _stochastic(Graph(g.n, np.append(g.row, loops), np.append(g.column, loops), np.append(g.value, np.full(g.n, max(g.value.max(initial=0), 1.0)))))
    for _ in range(rounds):
        new = _stochastic(_squared(flow), inflation)
        held = new.value >= LEAST_FLOW
        new = _stochastic(Graph(g.n, new.row[held], new.column[held], new.value[held]))
        still = len(new.value) == len(flow.value) and (new.row == flow.row).all() and (new.column == flow.column).all() and np.abs(new.value - flow.value).max() < 1e-8
        flow = new
        if still:
            break
    order = np.lexsort((flow.row, -flow.value, flow.column))
    owner = flow.row[order][flow.start[:-1]]
    return [np.flatnonzero(owner == k).tolist() for k in np.unique(owner)]


def parent_center(g: Graph) -> Members:
    """E7. Edges by falling weight: a free node becomes the centre of the other, if free; a child may pass to a centre that is closer."""
    once = g.row < g.column
    i, j, w = g.row[once], g.column[once], g.value[once]
    parent, centre, strength = np.full(g.n, -1), np.zeros(g.n, bool), np.zeros(g.n)
    for k in np.lexsort((j, i, -w)):
        x, y = int(i[k]), int(j[k])
        for a, b in ((x, y), (y, x)):
            if parent[a] < 0 and not centre[a] and parent[b] < 0 and not centre[b]:
                centre[a], parent[b], strength[b] = True, a, w[k]
                break
            if centre[a] and not centre[b] and w[k] > strength[b]:
                parent[b], strength[b] = a, w[k]
    owner = np.where(parent >= 0, parent, np.arange(g.n))
    return [np.flatnonzero(owner == k).tolist() for k in np.unique(owner)]


def _moved(g: Graph, total: float, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Communities after moves of single nodes while modularity grows. A node looks at its neighbours' communities, its own and an empty one."""
    label, degree = np.arange(g.n), g.sums()
    volume, size = degree.copy(), np.ones(g.n, np.int64)
    empty: list[int] = []
    moved = True
    while moved:
        moved = False
        for x in rng.permutation(g.n):
            near, weight = g.row[g.start[x] : g.start[x + 1]], g.value[g.start[x] : g.start[x + 1]]
            old = int(label[x])
            volume[old] -= degree[x]
            size[old] -= 1
            if not size[old]:
                heapq.heappush(empty, old)
            while empty and size[empty[0]]:
                heapq.heappop(empty)
            other = near != x
            choices, place = np.unique(np.append(label[near[other]], [old, *empty[:1]]), return_inverse=True)
            to = np.bincount(place[: other.sum()], weights=weight[other], minlength=len(choices))
            gain = to - resolution * degree[x] * volume[choices] / total
            best = int(gain.argmax())
            new = int(choices[best]) if gain[best] > gain[np.searchsorted(choices, old)] + 1e-12 else old
            label[x] = new
            volume[new] += degree[x]
            size[new] += 1
            moved |= new != old
    return label


def _connected_parts(g: Graph, label: np.ndarray) -> np.ndarray:
    """Communities taken apart where they don't hold together: for each node the least node it is connected with inside."""
    part = np.full(g.n, -1)
    for first in range(g.n):
        if part[first] >= 0:
            continue
        part[first], stack = first, [first]
        while stack:
            x = stack.pop()
            near = g.row[g.start[x] : g.start[x + 1]][g.value[g.start[x] : g.start[x + 1]] > 0]
            near = near[(part[near] < 0) & (label[near] == label[x])]
            part[near] = first
            stack += near.tolist()
    return part


def leiden(g: Graph, seed: int = 42, resolution: float = 1.0) -> Members:
    """E8. Moves of nodes and then of communities while modularity grows, each community split into connected parts."""
    rng = np.random.default_rng(seed)
    total = float(g.value.sum())
    owner = np.arange(g.n)
    while total:
        _, part = np.unique(_connected_parts(g, _moved(g, total, resolution, rng)), return_inverse=True)
        n = int(part.max()) + 1
        owner = part[owner]
        if n == g.n:
            break
        g = Graph(n, part[g.row], part[g.column], g.value)
    return [np.flatnonzero(owner == k).tolist() for k in np.unique(owner)]


def _leading(g: Graph, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The smallest eigenvalues of the normalised Laplacian with their vectors: all at once for few nodes, else by orthogonal iteration."""
    scale = 1 / np.sqrt(np.maximum(g.sums(), 1e-12))
    walk = Graph(g.n, g.row, g.column, g.value * scale[g.row] * scale[g.column])
    if g.n <= FEW_NODES:
        dense = np.zeros((g.n, g.n))
        dense[walk.row, walk.column] = walk.value
        values, vectors = np.linalg.eigh(np.eye(g.n) - dense)
        return values[:k], vectors[:, :k]
    basis = np.linalg.qr(rng.normal(size=(g.n, k)))[0]
    for _ in range(300):  # of the walk's matrix shifted by one, whose largest eigenvalues are the Laplacian's smallest
        new = np.linalg.qr(walk.times(basis) + basis)[0]
        apart = np.abs(np.abs((new * basis).sum(axis=0)) - 1).max()
        basis = new
        if apart < 1e-9:
            break
    values, turn = np.linalg.eigh(basis.T @ (basis - walk.times(basis)))
    return values, basis @ turn


def spectral(g: Graph, seed: int = 42, clusters: int | None = None) -> Members:
    """E8. K-means over the first eigenvectors of the normalised Laplacian; as many clusters as the widest gap among the first eigenvalues says."""
    n = g.n
    if n < 3:
        return [list(range(n))]
    rng = np.random.default_rng(seed)
    values, vectors = _leading(g, min(max(2, n // 2) + 1, MOST_VECTORS, n), rng)
    k = clusters or int(np.diff(values).argmax()) + 1
    if k == 1:
        return [list(range(n))]
    points = vectors[:, :k] / np.maximum(np.linalg.norm(vectors[:, :k], axis=1, keepdims=True), 1e-12)
    best, label = np.inf, np.zeros(n, int)
    for _ in range(10):
        centre = points[rng.choice(n, k, replace=False)]
        for _ in range(100):
            near = np.stack([((points - c) ** 2).sum(axis=1) for c in centre], axis=1)
            own = near.argmin(axis=1)
            new = np.array([points[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        if (cost := near.min(axis=1).sum()) < best - 1e-12:
            best, label = cost, own
    return [np.flatnonzero(label == c).tolist() for c in np.unique(label)]


ALGORITHMS: dict[str, Callable[[Graph], Members]] = {"markov": markov, "parent-center": parent_center, "leiden": leiden, "spectral": spectral}


def cluster(nodes: DataFrame, edges: DataFrame, algorithm: str) -> DataFrame:
    """(ref, cluster_id) by an algorithm's name."""
    if algorithm == "wcc":
        return components(nodes, edges)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown clustering algorithm: {algorithm}")
    run = ALGORITHMS[algorithm]
    found = connected_components(edges.filter("weight > 0"), "src", "dst")
    held = edges.join(found.select(F.col("node").alias("src"), F.col("component").alias("part")), "src").groupBy("part", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    ref = nodes.schema["ref"].dataType.simpleString()
    text = held.select(F.to_json("part").alias("part"), F.to_json("src").alias("src"), F.to_json("dst").alias("dst"), "weight") if ref.startswith("struct") else held

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["src"], *group["dst"]})
        place = {r: k for k, r in enumerate(names)}
        apart = group[group["src"] != group["dst"]]
        graph = Graph.of_edges(len(names), apart["src"].map(place), apart["dst"].map(place), apart["weight"])
        rows = [(names[x], names[min(part)]) for part in run(graph) for x in part]
        return pd.DataFrame(rows, columns=["ref", "key"])

    kind = "string" if ref.startswith("struct") else ref
    out = text.groupBy("part").applyInPandas(apply, f"ref {kind}, key {kind}")
    if ref.startswith("struct"):
        out = out.select(F.from_json("ref", ref).alias("ref"), F.from_json("key", ref).alias("key"))
    alone = nodes.select("ref").join(out.select("ref"), "ref", "left_anti").select("ref", F.col("ref").alias("key"))
    return number_clusters(out.unionByName(alone), "key").drop("key")
