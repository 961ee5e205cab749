"""Graph operators over many random graphs against plain versions."""

import hashlib
import itertools
import random
from collections import deque

import pytest

from tessera.operators import graph


def random_graphs(seed=1):
    rng = random.Random(seed)
    out = {}
    for g, (n, p) in enumerate([(1, 0), (2, 1), (5, 0), (9, 0.2), (12, 0.3), (14, 0.15), (10, 1), (20, 0.12), (18, 0.25)], 1):
        names = rng.sample(range(1000), n)
        out[g] = (sorted(names), sorted((a, b) for a, b in itertools.combinations(sorted(names), 2) if rng.random() < p))
    out[40] = (list(range(12)), [(i, i + 1) for i in range(11)])  # a path
    out[41] = (list(range(9)), [(0, i) for i in range(1, 9)])  # a star
    out[42] = (list(range(8)), sorted((min(i, (i + 1) % 8), max(i, (i + 1) % 8)) for i in range(8)))  # a ring
    return out


GRAPHS = random_graphs()


@pytest.fixture(scope="module")
def frames(spark):
    nodes = spark.createDataFrame([(g, n) for g, (names, _) in GRAPHS.items() for n in names], "data_id long, node long")
    edges = spark.createDataFrame([(g, a, b) for g, (_, pairs) in GRAPHS.items() for a, b in pairs], "data_id long, src long, dst long")
    return nodes.repartition(3), edges.repartition(3)


def near(names, pairs):
    out = {n: set() for n in names}
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def reach(names, pairs, start):
    """node -> (distance, number of shortest paths)."""
    beside, seen, todo = near(names, pairs), {start: (0, 1)}, deque([start])
    while todo:
        u = todo.popleft()
        for v in beside[u]:
            if v not in seen:
                seen[v] = (seen[u][0] + 1, 0)
                todo.append(v)
            if seen[v][0] == seen[u][0] + 1:
                seen[v] = (seen[v][0], seen[v][1] + seen[u][1])
    return seen


def test_summaries(frames):
    got = {r["data_id"]: r for r in graph.summaries(*frames).collect()}
    assert set(got) == set(GRAPHS)
    for g, (names, pairs) in GRAPHS.items():
        far = {s: reach(names, pairs, s) for s in names}
        parts = sorted({frozenset(x) for x in far.values()}, key=lambda p: (-len(p), min(p)))
        share = dict.fromkeys(names, 0.0)
        for s, t, v in itertools.permutations(names, 3):
            if t in far[s] and v in far[s] and far[s][v][0] + far[v][t][0] == far[s][t][0]:
                share[v] += far[s][v][1] * far[v][t][1] / far[s][t][1]
        even = all((far[min(p)][a][0] - far[min(p)][b][0]) % 2 for p in parts for a, b in pairs if a in p)
        want = (len(names), len(pairs), len(parts), len(parts[0]), max(d for s in parts[0] for d, _ in far[s].values()), even, len(pairs) > len(names) - len(parts), min(names, key=lambda n: (-round(share[n], 9), n)))
        assert tuple(got[g])[1:] == want, g


def test_bridges(frames):
    got = {tuple(r) for r in graph.bridges(*frames).collect()}
    want = {(g, a, b) for g, (names, pairs) in GRAPHS.items() for a, b in pairs if b not in reach(names, [p for p in pairs if p != (a, b)], a)}
    assert got == want and len(want) > 20


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def plain_communities(names, pairs):
    group, m = {n: n for n in names}, len(pairs)
    while True:
        k = dict.fromkeys(set(group.values()), 0)
        w = {}
        for a, b in pairs:
            x, y = sorted((group[a], group[b]))
            k[x] += 1
            k[y] += 1
            if x != y:
                w[x, y] = w.get((x, y), 0) + 1
        gain = {p: 2 * m * c - k[p[0]] * k[p[1]] for p, c in w.items()}
        best = {}
        for p, v in sorted(gain.items(), key=lambda x: (x[1], hashed(*x[0]), -x[0][0], -x[0][1]), reverse=True):
            if v > 0:
                best.setdefault(p[0], (p[1], v, p))
                best.setdefault(p[1], (p[0], v, p))
        rank = lambda c: (k[c], hashed(c), c)
        joins = {c: x for c, x in best.items() if rank(x[0]) > rank(c)}
        into = {}
        for t in {x[0] for x in joins.values()} - set(joins):
            before, own = 0, []
            for c, (_, _, p) in sorted(((c, x) for c, x in joins.items() if x[0] == t), key=lambda x: (-x[1][1], x[0])):
                if 2 * m * w[p] - (k[t] + before) * k[c] > 0:
                    own.append(c)
                before += k[c]
            into |= dict.fromkeys([t, *own], min(t, *own))
        if not into:
            return group
        group = {n: into.get(c, c) for n, c in group.items()}


def modularity(group, pairs):
    m = len(pairs)
    inside, k = {}, {}
    for a, b in pairs:
        for n in (a, b):
            k[group[n]] = k.get(group[n], 0) + 1
        inside[group[a]] = inside.get(group[a], 0) + (group[a] == group[b])
    return sum(inside.get(c, 0) / m - (x / (2 * m)) ** 2 for c, x in k.items())


def sequential(names, pairs):
    """One union at a time, the best of all."""
    group = {n: n for n in names}
    while True:
        now, best = modularity(group, pairs), None
        for x, y in itertools.combinations(sorted(set(group.values())), 2):
            gain = modularity({n: x if c == y else c for n, c in group.items()}, pairs) - now
            if gain > 1e-12 and (best is None or gain > best[0]):
                best = (gain, x, y)
        if best is None:
            return group
        group = {n: best[1] if c == best[2] else c for n, c in group.items()}


def test_communities(frames):
    got = {}
    for r in graph.communities(*frames).collect():
        got.setdefault(r["data_id"], {})[r["node"]] = r["community"]
    for g, (names, pairs) in GRAPHS.items():
        assert got[g] == plain_communities(names, pairs)
        if pairs:  # near what uniting one by one finds
            assert modularity(got[g], pairs) >= modularity(sequential(names, pairs), pairs) - 0.06


def test_two_cliques(spark):
    pairs = [(a + o, b + o) for o in (0, 10) for a, b in itertools.combinations(range(5), 2)] + [(4, 10)]
    nodes = spark.createDataFrame([(1, n) for n in [*range(5), *range(10, 15)]], "data_id long, node long")
    got = graph.communities(nodes, spark.createDataFrame([(1, *p) for p in pairs], "data_id long, src long, dst long"))
    assert {(r["node"], r["community"]) for r in got.collect()} == {(n, 0 if n < 5 else 10) for n in [*range(5), *range(10, 15)]}


def test_triangles(frames):
    got = {(r["data_id"], r["node"]): r["triangles"] for r in graph.triangles(frames[1]).collect()}
    want = {}
    for g, (names, pairs) in GRAPHS.items():
        for t in itertools.combinations(names, 3):
            if all(p in set(pairs) for p in itertools.combinations(t, 2)):
                for n in t:
                    want[g, n] = want.get((g, n), 0) + 1
    assert got == want


def test_hub_makes_no_square(spark):
    """A hub beside all nodes of a ring: two-paths grow with the edges, though the hub has pairs of neighbours by the square."""
    n = 400
    pairs = [(0, i) for i in range(1, n + 1)] + [(i, i + 1) for i in range(1, n)]
    edges = spark.createDataFrame([(1, *p) for p in pairs], "data_id long, src long, dst long")
    assert graph.two_paths(edges).count() <= 3 * n
    assert graph.triangles(edges).filter("node = 0").first()["triangles"] == n - 1


@pytest.mark.parametrize("most", [1000, 4])
def test_projected(spark, most):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([*range(25), None])) for _ in range(300)]
    got = {(r["a"], r["b"]): r["weight"] for r in graph.projected(spark.createDataFrame(rows, "e long, m long"), "e", "m", most).collect()}
    want = {}
    for e in {r[0] for r in rows if r[0] is not None}:
        for p in itertools.combinations(sorted({m for x, m in rows if x == e and m is not None}), 2):
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_empty(spark):
    nodes, edges = spark.createDataFrame([], "data_id long, node long"), spark.createDataFrame([], "data_id long, src long, dst long")
    assert graph.summaries(nodes, edges).count() == graph.bridges(nodes, edges).count() == graph.communities(nodes, edges).count() == graph.triangles(edges).count() == 0
