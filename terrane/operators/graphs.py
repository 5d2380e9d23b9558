"""Whole-graph measures of a subject's region graph; one task holds one graph, whose size the regions bound."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import KEY

NAMES = ("components", "largest", "clustering", "path_length", "betweenness_mean", "betweenness_max", "closeness_mean", "assortativity", "global_efficiency", "local_efficiency")


def _neighbours(n: int, edges: np.ndarray) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges.tolist():
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def _hops(near: list[set[int]], start: int) -> dict[int, int]:
    seen, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in seen:
                seen[w] = seen[v] + 1
                todo.append(w)
    return seen


def _betweenness(near: list[set[int]]) -> np.ndarray:
    """Shares of shortest paths through each node, by accumulation from every start."""
    n = len(near)
    out = np.zeros(n)
    for s in range(n):
        order, before, paths, depth = [], [[] for _ in range(n)], np.zeros(n), {s: 0}
        paths[s] = 1
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    todo.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def _efficiency(near: list[set[int]], nodes: set[int]) -> float:
    if len(nodes) < 2:
        return 0.0
    inside = [near[v] & nodes if v in nodes else set() for v in range(len(near))]
    total = sum(1 / d for v in nodes for w, d in _hops(inside, v).items() if w != v)
    return total / (len(nodes) * (len(nodes) - 1))


#: Nodes up to which a graph's measures are made from its full table of distances.
DENSE = 1024


def _adjacency(n: int, edges: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    edges = np.asarray(edges, int).reshape(-1, 2)
    a[edges[:, 0], edges[:, 1]] = a[edges[:, 1], edges[:, 0]] = 1
    np.fill_diagonal(a, 0)
    return a


def _distances(a: np.ndarray) -> np.ndarray:
    """Hops between all nodes of a graph, or of each of a stack of them, infinite where there is no path."""
    a = a.astype(np.float32)
    out = np.full(a.shape, np.inf)
    front = np.broadcast_to(np.eye(a.shape[-1], dtype=np.float32), a.shape)
    left, k = np.ones(a.shape, bool), 0
    while True:
        new = (front > 0) & left
        if not new.any():
            return out
        out[new] = k
        left &= ~new
        front, k = new.astype(np.float32) @ a, k + 1


def _shares(a: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """As :func:`_betweenness`, of all starts at once, a distance at a time."""
    n = len(a)
    if n <= 2:
        return np.zeros(n)
    far = int(hops[np.isfinite(hops)].max())
    at = [hops == k for k in range(far + 1)]
    paths = np.eye(n)
    for k in range(1, far + 1):
        paths += np.where(at[k], np.where(at[k - 1], paths, 0.0) @ a, 0.0)
    share = np.zeros((n, n))
    for k in range(far, 0, -1):
        passed = np.divide(1 + share, paths, out=np.zeros((n, n)), where=at[k]) @ a
        share += np.where(at[k - 1], paths * passed, 0.0)
    np.fill_diagonal(share, 0)
    return share.sum(0) / ((n - 1) * (n - 2))


def _mean_inverse(hops: np.ndarray) -> float:
    """Efficiency from a table of distances."""
    n = len(hops)
    if n < 2:
        return 0.0
    return float((1 / hops[np.isfinite(hops) & (hops > 0)]).sum() / (n * (n - 1)))


def _local(a: np.ndarray) -> np.ndarray:
    """The efficiency of every node's neighbours among themselves."""
    n = len(a)
    degree = a.sum(1).astype(int)
    most = max(int(degree.max(initial=0)), 1)
    # neighbours first, padded with a node that has none
    near = np.where(np.arange(most) < degree[:, None], np.argsort(-a, 1, kind="stable")[:, :most], n)
    wide = np.zeros((n + 1, n + 1))
    wide[:n, :n] = a
    out = np.zeros(n)
    step = max(1, DENSE * DENSE // most**2)
    for v in range(0, n, step):
        some = near[v : v + step]
        hops = _distances(wide[some[:, :, None], some[:, None, :]])
        out[v : v + step] = np.divide(1, hops, out=np.zeros(hops.shape), where=(hops > 0) & np.isfinite(hops)).sum((1, 2))
    return np.divide(out, degree * (degree - 1), out=np.zeros(n), where=degree > 1)


def _local_clustering(a: np.ndarray) -> np.ndarray:
    k = a.sum(1)
    possible = k * (k - 1)
    return np.divide(((a @ a) * a).sum(1), possible, out=np.zeros(len(a)), where=possible > 0)


def clustering(n: int, edges: np.ndarray) -> float:
    """The mean local clustering alone, as :func:`measures` has it."""
    if n <= DENSE:
        return float(_local_clustering(_adjacency(n, edges)).mean()) if n else 0.0
    near = _neighbours(n, edges)
    k = np.array([len(s) for s in near], float)
    triangles = np.array([sum(len(near[w] & near[v]) for w in near[v]) for v in range(n)], float)
    return float(np.divide(triangles, k * (k - 1), out=np.zeros(n), where=k > 1).mean())


def _dense(n: int, edges: np.ndarray) -> dict[str, float]:
    a = _adjacency(n, edges)
    hops = _distances(a)
    met = np.isfinite(hops)
    size, k = met.sum(1), a.sum(1)
    first = met.argmax(1)  # a component's first node names it
    m = int(size.max())
    inside = first == first[size == m].min()
    reach = np.where(met, hops, 0.0).sum(1)
    close = np.divide((size - 1.0) ** 2, reach * (n - 1), out=np.zeros(n), where=reach > 0)
    starts, stops = np.nonzero(a)
    ends = np.stack([k[starts], k[stops]])
    between = _shares(a, hops)
    return {
        "components": float(len(np.unique(first))), "largest": float(m), "clustering": float(_local_clustering(a).mean()), "path_length": float(hops[np.ix_(inside, inside)].sum() / (m * (m - 1))) if m > 1 else 0.0,
        "betweenness_mean": float(between.mean()), "betweenness_max": float(between.max()), "closeness_mean": float(close.mean()), "assortativity": float(np.corrcoef(ends)[0, 1]) if ends.shape[1] and ends[0].std() > 0 else 0.0,
        "global_efficiency": _mean_inverse(hops), "local_efficiency": float(_local(a).mean()),
    }


def measures(n: int, edges: np.ndarray) -> dict[str, float]:
    """The measures in NAMES of an undirected graph of nodes 0 to n - 1; undefined ones are 0.

    Path length and closeness are of the largest component and of reachable nodes
    (scaled by their share); assortativity is of degrees.
    """
    if 0 < n <= DENSE:
        return _dense(n, edges)
    near = _neighbours(n, edges)
    hops = [_hops(near, v) for v in range(n)]
    sizes, left = [], set(range(n))
    while left:
        part = set(hops[next(iter(left))])
        sizes.append(part)
        left -= part
    largest = max(sizes, key=lambda p: (len(p), -min(p)), default=set())
    k = np.array([len(s) for s in near], float)
    triangles = np.array([sum(len(near[w] & near[v]) for w in near[v]) for v in range(n)], float)
    possible = k * (k - 1)
    local = np.divide(triangles, possible, out=np.zeros(n), where=possible > 0)
    between = _betweenness(near)
    reach = [sum(h.values()) for h in hops]
    close = [(len(h) - 1) / r * (len(h) - 1) / (n - 1) if r else 0.0 for h, r in zip(hops, reach, strict=True)] if n > 1 else [0.0] * n
    ends = np.array([(k[a], k[b]) for a in range(n) for b in near[a]])
    same = 0.0
    if len(ends) and ends[:, 0].std() > 0:
        same = float(np.corrcoef(ends.T)[0, 1])
    m = len(largest)
    return {
        "components": float(len(sizes)), "largest": float(m), "clustering": float(local.mean()) if n else 0.0, "path_length": sum(sum(hops[v].values()) for v in largest) / (m * (m - 1)) if m > 1 else 0.0,
        "betweenness_mean": float(between.mean()) if n else 0.0, "betweenness_max": float(between.max()) if n else 0.0, "closeness_mean": float(np.mean(close)) if n else 0.0, "assortativity": same,
        "global_efficiency": _efficiency(near, set(range(n))), "local_efficiency": float(np.mean([_efficiency(near, near[v]) for v in range(n)])) if n else 0.0,
    }


def swap(edges: np.ndarray, seed: int, tries: int = 10) -> np.ndarray:
    """A random graph with the same degrees: ends of edge pairs are exchanged where that makes no loop or double edge."""
    now = [(a, b) if a <= b else (b, a) for a, b in edges.tolist()]
    have = set(now)
    for i, j, turn in zip(*_draws(seed, len(now), tries * len(now)), strict=True):
        if i == j:
            continue
        (a, b), (c, d) = now[i], now[j]
        if turn:
            c, d = d, c
        if a == d or c == b:
            continue
        one, two = (a, d) if a <= d else (d, a), (c, b) if c <= b else (b, c)
        if one in have or two in have or one == two:
            continue
        have.remove(now[i])
        have.discard(now[j])
        have.add(one)
        have.add(two)
        now[i], now[j] = one, two
    return np.array(now).reshape(-1, 2)


def _draws(seed: int, n: int, size: int) -> tuple[list[int], list[int], list[bool]]:
    """``size`` draws of two numbers below n and a coin, those of ``integers(n, size=2)`` and ``random() < 0.5`` in turn, made at once.

    A pair takes the two halves of one word and the coin the next word; where a half
    has to be drawn again (one in some millions) they are drawn in turn after all.
    """
    rng = np.random.default_rng(seed)
    if 1 < n < 1 << 31:
        words = rng.bit_generator.random_raw(2 * size).reshape(size, 2)
        wide = [(words[:, 0] & np.uint64(0xFFFFFFFF)) * np.uint64(n), (words[:, 0] >> np.uint64(32)) * np.uint64(n)]
        if not any(((w & np.uint64(0xFFFFFFFF)) < np.uint64(n)).any() for w in wide):
            i, j = ((w >> np.uint64(32)).tolist() for w in wide)
            return i, j, ((words[:, 1] >> np.uint64(63)) == 0).tolist()
        rng = np.random.default_rng(seed)
    found = [(*rng.integers(n, size=2).tolist(), rng.random() < 0.5) for _ in range(size)]
    return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def modularity(n: int, edges: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Modularity of communities found by moving nodes to the neighbouring community that gains most, then merging communities, until nothing gains.

    Nodes are visited in order of their number and ties go to the smallest community, so
    the result is fixed.  A graph without edges has 0.
    """
    w = np.ones(len(edges)) if weights is None else np.asarray(weights, float)
    total = float(w.sum())
    if not total:
        return 0.0
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), x in zip(edges.tolist(), w.tolist(), strict=True):
        links[a][b] = links[a].get(b, 0.0) + x
        links[b][a] = links[b].get(a, 0.0) + x
    while True:
        # a merged node's link to itself holds twice the weight inside it
        degree = [sum(near.values()) for near in links]
        home, mass = list(range(len(links))), list(degree)
        moved, moving = False, True
        while moving:
            moving = False
            for v, near in enumerate(links):
                own = home[v]
                mass[own] -= degree[v]
                to: dict[int, float] = {own: 0.0}
                for u, x in near.items():
                    if u != v:
                        to[home[u]] = to.get(home[u], 0.0) + x
                gain = {c: x - mass[c] * degree[v] / (2 * total) for c, x in to.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] <= gain[own] + 1e-12 * total:
                    best = own
                home[v] = best
                mass[best] += degree[v]
                moving |= best != own
            moved |= moving
        if not moved:
            break
        name = {c: k for k, c in enumerate(sorted(set(home)))}
        merged: list[dict[int, float]] = [{} for _ in name]
        for v, near in enumerate(links):
            at = merged[name[home[v]]]
            for u, x in near.items():
                c = name[home[u]]
                at[c] = at.get(c, 0.0) + x
        links = merged
    return sum(near.get(c, 0.0) / (2 * total) - (sum(near.values()) / (2 * total)) ** 2 for c, near in enumerate(links))


def _connected(near: list[set[int]]) -> bool:
    return len(_hops(near, 0)) == len(near)


def swap_connected(n: int, edges: np.ndarray, seed: int, rounds: int = 5) -> np.ndarray:
    """As :func:`swap`, of a connected graph that stays so: a run of exchanges that parts it is undone and tried in shorter ones."""
    now, done, size, turn = edges, 0, max(1, len(edges)), 0
    while done < rounds * len(edges) and turn < 20 * rounds:
        turn += 1
        new = swap(now, seed * 1009 + turn, 1) if size >= len(edges) else _few(now, seed * 1009 + turn, size)
        if _connected(_neighbours(n, new)):
            now, done, size = new, done + size, min(2 * size, max(1, len(edges)))
        else:
            size = max(1, size // 2)
    return now


def _few(edges: np.ndarray, seed: int, tries: int) -> np.ndarray:
    """Some exchanges among a drawn part of the edges; those that would repeat an edge outside the part are left out."""
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(edges))[: max(2, tries)]
    rest = np.delete(edges, part, 0)
    new = swap(edges[part], seed, 1)
    taken = {tuple(sorted(e)) for e in rest.tolist()}
    return edges if any(tuple(e) in taken for e in new.tolist()) else np.concatenate([rest, new])


def _spread(n: int, edges: np.ndarray) -> tuple[float, float]:
    """Transitivity and path length."""
    if n <= DENSE:
        a = _adjacency(n, edges)
        k = a.sum(1)
        possible = (k * (k - 1)).sum()
        hops = _distances(a)
        return float(((a @ a) * a).sum() / possible) if possible else 0.0, float(hops[np.isfinite(hops)].sum() / (n * (n - 1))) if n > 1 else 0.0
    near = _neighbours(n, edges)
    return _transitivity(near), _path_length(near)


def _transitivity(near: list[set[int]]) -> float:
    closed = sum(len(near[w] & near[v]) for v in range(len(near)) for w in near[v])
    possible = sum(len(s) * (len(s) - 1) for s in near)
    return closed / possible if possible else 0.0


def _path_length(near: list[set[int]]) -> float:
    n = len(near)
    return sum(sum(_hops(near, v).values()) for v in range(n)) / (n * (n - 1)) if n > 1 else 0.0


def small_world(n: int, edges: np.ndarray, seed: int = 0, least: int = 10, rounds: int = 5, draws: int = 3) -> float:
    """Transitivity over path length, each relative to its mean over connected random graphs of the same degrees.

    0 for graphs of fewer than ``least`` nodes, unconnected ones, and where the random graphs have no triangle.
    """
    near = _neighbours(n, edges)
    if n < least or not len(edges) or not _connected(near):
        return 0.0
    c, p = np.mean([_spread(n, swap_connected(n, edges, seed + k, rounds)) for k in range(draws)], axis=0).tolist()
    own, length = _spread(n, edges)
    return (own / c) / (length / p) if c else 0.0


def rich_club(near: list[set[int]]) -> dict[int, float]:
    """For every degree, the share of possible edges that exist among the nodes of a larger degree."""
    degree = [len(s) for s in near]
    out = {}
    for k in range(max(degree, default=0)):
        club = {v for v, d in enumerate(degree) if d > k}
        if len(club) > 1:
            out[k] = sum(len(near[v] & club) for v in club) / (len(club) * (len(club) - 1))
    return out


def rich_club_mean(n: int, edges: np.ndarray, seed: int = 0, tries: int = 100) -> float:
    """Mean over degrees of the rich-club share relative to a random graph of the same degrees, where that has one.

    0 for fewer than four nodes or two edges, where no ends can be exchanged.
    """
    if n < 4 or len(edges) < 2:
        return 0.0
    random = rich_club(_neighbours(n, swap(edges, seed, tries)))
    shares = [x / random[k] for k, x in rich_club(_neighbours(n, edges)).items() if random.get(k)]
    return float(np.mean(shares)) if shares else 0.0


#: Measures of the largest component beyond NAMES; modularity is of the whole graph.
EXTENDED = ("modularity", "small_world_sigma", "rich_club", "betweenness_std", "degree_skewness", "node_local_efficiency_min", "node_local_efficiency_std")


def extended(n: int, edges: np.ndarray, weights: np.ndarray | None = None, seed: int = 0) -> dict[str, float]:
    """The measures in EXTENDED; undefined ones are 0."""
    near = _neighbours(n, edges)
    left, largest = set(range(n)), []
    while left:
        part = sorted(_hops(near, min(left)))
        left -= set(part)
        if len(part) > len(largest):
            largest = part
    index = {v: k for k, v in enumerate(largest)}
    inside = np.array([(index[a], index[b]) for a, b in edges.tolist() if a in index], int).reshape(-1, 2)
    m = len(largest)
    club = _neighbours(m, inside)
    k = np.array([len(s) for s in club], float)
    if m <= DENSE:
        a = _adjacency(m, inside)
        between, local = _shares(a, _distances(a)), _local(a)
    else:
        between, local = _betweenness(club), np.array([_efficiency(club, club[v]) for v in range(m)])
    skew = 0.0
    if m >= 3 and k.std() > 0:
        skew = float(((k - k.mean()) ** 3).mean() / k.std() ** 3 * np.sqrt(m * (m - 1)) / (m - 2))
    return {
        "modularity": modularity(n, edges, weights), "small_world_sigma": small_world(m, inside, seed), "rich_club": rich_club_mean(m, inside, seed), "betweenness_std": float(between.std()) if m else 0.0,
        "degree_skewness": skew, "node_local_efficiency_min": float(local.min()) if m else 0.0, "node_local_efficiency_std": float(local.std()) if m else 0.0,
    }


def by_subject(nodes: DataFrame, edges: DataFrame, subject: str, null_rounds: int = 0, seed: int = 0, more: bool = False, weight: str | None = None) -> DataFrame:
    """(subject, measures; with ``more`` the extended ones, their communities by ``weight`` if named; with ``null_rounds`` also the clustering's z against degree-preserving graphs) of nodes (subject, node) and edges (subject, src, dst)."""
    kind = nodes.schema[subject].dataType.simpleString()
    names = [*NAMES, *(EXTENDED if more else ()), *(["clustering_null_z"] if null_rounds else [])]

    def run(key: tuple, mine: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        index = {v: k for k, v in enumerate(sorted(mine["node"].unique()))}
        pairs = np.array([(index[a], index[b]) for a, b in zip(links["src"], links["dst"], strict=True)], int).reshape(-1, 2)
        row = measures(len(index), pairs)
        if more:
            row |= extended(len(index), pairs, links[weight].to_numpy(float) if weight else None, seed)
        if null_rounds:
            null = np.array([clustering(len(index), swap(pairs, seed + r)) for r in range(null_rounds)])
            row["clustering_null_z"] = float((row["clustering"] - null.mean()) / null.std()) if null.std() > 0 else 0.0
        return pd.DataFrame([{subject: key[0], **row}])

    schema = f"{subject} {kind}, " + ", ".join(f"{n} double" for n in names)
    # new names keep the two sides apart where the edges were made from the nodes
    # a graph costs far more than its bytes say, so as many tasks as partitions are set stay
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = edges.toDF(*edges.columns).select(subject, "src", "dst", *([weight] if weight else [])).repartition(tasks, subject)
    return nodes.select(subject, "node").repartition(tasks, subject).groupBy(subject).cogroup(links.groupBy(subject)).applyInPandas(run, schema)


def dispersion(nodes: DataFrame, subject: str) -> DataFrame:
    """(subject, spatial_dispersion): mean over the axes of the centroids' population deviation."""
    return nodes.groupBy(subject).agg((sum((F.stddev_pop(k) for k in KEY), F.lit(0.0)) / len(KEY)).alias("spatial_dispersion"))


def clark_evans(nodes: DataFrame, cells: DataFrame, subject: str) -> DataFrame:
    """(subject, clark_evans): mean distance to the closest node over that of as many random ones in the subject's cells.

    Nodes are few in a subject; each keeps its closest by a grouped minimum.
    """
    a = nodes.select(subject, F.col("node").alias("a"), *(F.col(k).alias(f"a{k}") for k in KEY))
    b = nodes.select(subject, F.col("node").alias("b"), *(F.col(k).alias(f"b{k}") for k in KEY))
    d = F.sqrt(sum(((F.col(f"a{k}") - F.col(f"b{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in KEY), F.lit(0.0)))
    near = a.join(b, subject).where("a <> b").groupBy(subject, "a").agg(F.min(d).alias("d")).groupBy(subject).agg(F.avg("d").alias("d"), F.count("*").alias("n"))
    space = cells.where("label <> 0").groupBy(subject).agg(F.count("*").alias("v"))
    expected = F.lit(0.5539602785) / F.pow(F.col("n") / F.col("v"), F.lit(1 / 3))
    return near.join(space, subject).select(subject, (F.col("d") / expected).alias("clark_evans"))


def cross_degree(nodes: DataFrame, edges: DataFrame, subject: str, kind: str = "label") -> DataFrame:
    """(subject, a, b, edges, nodes_a, isolated_a): edges between regions of two kinds, and nodes of one without any to the other."""
    own = nodes.select(subject, "node", F.col(kind).alias("a"))
    both = edges.select(subject, F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select(subject, "dst", "src"))
    ends = both.join(own, [subject, "node"]).join(own.withColumnsRenamed({"node": "to", "a": "b"}), [subject, "to"]).where("a <> b")
    met = ends.groupBy(subject, "a", "b").agg(F.count("*").alias("edges"), F.countDistinct("node").alias("linked"))
    size = own.groupBy(subject, "a").agg(F.count("*").alias("nodes_a"))
    return met.join(size, [subject, "a"]).select(subject, "a", "b", "edges", "nodes_a", (F.col("nodes_a") - F.col("linked")).alias("isolated_a"))


def rank_by_degree(edges: DataFrame, subject: str) -> DataFrame:
    """(subject, node, degree, place): nodes by falling degree, ties by node."""
    ends = edges.select(subject, F.col("src").alias("node")).union(edges.select(subject, "dst"))
    degree = ends.groupBy(subject, "node").agg(F.count("*").alias("degree"))
    return degree.withColumn("place", F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("degree"), "node")))
