"""Graph operators over (data_id, node) and (data_id, src, dst) rows, src < dst, many graphs at once.

Work goes level by level or round by round, each a join and an aggregation over all graphs,
until nothing changes or a bound fails; frames are kept in the checkpoint folder between
rounds. No graph is one group: a large one is spread over its nodes, edges or pairs.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dealing import dealt
from tessera.operators.keeping import kept as _kept
from tessera.operators.statistics import hashed


def symmetric(edges: DataFrame) -> DataFrame:
    """(data_id, u, v) in both directions."""
    return edges.select("data_id", F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("data_id", F.col("dst"), F.col("src")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(data_id, node, degree), isolated nodes with 0."""
    counts = symmetric(edges).groupBy("data_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(counts, ["data_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def upward(edges: DataFrame) -> DataFrame:
    """(data_id, low, high, place): every edge from its end of lesser (degree, node) to the other, whose degree and node are ``place``.

    No node has more than about sqrt(2 * edges) such edges, a hub's lead to it.
    """
    own = symmetric(edges).groupBy("data_id", "u").agg(F.count("*").alias("degree"))
    at = lambda end: own.select("data_id", F.col("u").alias(end), F.struct("degree", F.col("u").alias("node")).alias(f"at_{end}"))
    both = edges.join(at("src"), ["data_id", "src"]).join(at("dst"), ["data_id", "dst"])
    low, high = F.least("at_src", "at_dst"), F.greatest("at_src", "at_dst")
    return both.select("data_id", low["node"].alias("low"), high["node"].alias("high"), high.alias("place"))


def two_paths(edges: DataFrame) -> DataFrame:
    """(data_id, x, y, z): a node and two of its upward neighbours, y before z."""
    up = upward(edges)
    a = up.select("data_id", F.col("low").alias("x"), F.col("high").alias("y"), F.col("place").alias("first"))
    b = up.select("data_id", F.col("low").alias("x"), F.col("high").alias("z"), F.col("place").alias("second"))
    return a.join(b, ["data_id", "x"]).filter("first < second").select("data_id", "x", "y", "z")


def triangles(edges: DataFrame) -> DataFrame:
    """(data_id, node, triangles): two upward edges of one node closed by a third, so each is made once."""
    ends = edges.select("data_id", F.col("src").alias("s"), F.col("dst").alias("t"))
    paths = two_paths(edges).withColumn("s", F.least("y", "z")).withColumn("t", F.greatest("y", "z"))
    closed = paths.join(ends, ["data_id", "s", "t"])
    return closed.select("data_id", F.explode(F.array("x", "y", "z")).alias("node")).groupBy("data_id", "node").agg(F.count("*").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(data_id, node, clustering): closed share of a node's pairs of neighbours, 0 below two."""
    both = degrees(nodes, edges).join(triangles(edges), ["data_id", "node"], "left")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return both.select("data_id", "node", F.when(F.col("degree") < 2, 0.0).otherwise(F.coalesce("triangles", F.lit(0)) / pairs).alias("clustering"))


def labels(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(data_id, node, component): least node reachable, by spreading least labels and following them on."""
    both = _kept(symmetric(edges))
    now = nodes.select("data_id", "node", F.col("node").alias("component"))
    before = None
    for _ in range(rounds):
        near = both.join(now.select("data_id", F.col("node").alias("v"), F.col("component").alias("c")), ["data_id", "v"]).groupBy("data_id", F.col("u").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, ["data_id", "node"], "left").select("data_id", "node", F.least("component", "c").alias("component"))
        far = step.select("data_id", F.col("node").alias("component"), F.col("component").alias("next"))
        now = _kept(step.join(far, ["data_id", "component"]).select("data_id", "node", F.least("component", "next").alias("component")))
        total = now.agg(F.sum("component")).first()[0]
        if total == before:
            break
        before = total
    else:
        raise RuntimeError(f"the components aren't final after {rounds} rounds")
    return now


def shortest_paths(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """By distance, from 0: (data_id, source, node, paths) of all pairs that lie so far apart; paths: the number of shortest ones.

    Breadth first from all nodes at once. What a level reaches can only have been met in the two before it.
    """
    both = _kept(symmetric(edges).withColumnRenamed("u", "node"))
    levels = [_kept(nodes.select("data_id", F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
    while True:
        met = levels[-1].select("data_id", "source", "node")
        if len(levels) > 1:
            met = met.union(levels[-2].select("data_id", "source", "node"))
        step = levels[-1].join(both, ["data_id", "node"]).groupBy("data_id", "source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        step = _kept(step.join(met, ["data_id", "source", "node"], "left_anti"))
        if step.isEmpty():
            return levels
        levels.append(step)


def betweenness(levels: list[DataFrame], edges: DataFrame) -> DataFrame:
    """(data_id, node, share): shares of all sources' shortest paths that lead through a node, of nodes that have some.

    Dependencies are summed level by level from the farthest pairs back to the sources (Brandes).
    """
    both = _kept(symmetric(edges).withColumnRenamed("u", "node"))
    flows, behind = [], None
    for level in range(len(levels) - 1, 0, -1):
        own = levels[level]
        own = own.withColumn("flow", F.lit(0.0)) if behind is None else own.join(behind, ["data_id", "source", "node"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
        given = own.join(both, ["data_id", "node"]).select("data_id", "source", F.col("v").alias("node"), ((1 + F.col("flow")) / F.col("paths")).alias("given"))
        behind = given.join(levels[level - 1], ["data_id", "source", "node"]).groupBy("data_id", "source", "node").agg(F.sum(F.col("paths") * F.col("given")).alias("flow"))
        behind = _kept(behind)
        if level > 1:
            flows.append(behind.select("data_id", "node", "flow"))
    every = levels[0].select("data_id", "node", F.lit(0.0).alias("flow"))
    for flow in flows:
        every = every.union(flow)
    return every.groupBy("data_id", "node").agg(F.sum("flow").alias("share"))


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: size, components, diameter of the largest (ties to that of the least node), bipartite, cyclic, most central node (shortest paths; ties to the least)."""
    levels = shortest_paths(nodes, edges)
    pairs = None
    for distance, level in enumerate(levels):
        level = level.select("data_id", "source", "node", F.lit(distance).cast("long").alias("distance"))
        pairs = level if pairs is None else pairs.union(level)
    own = pairs.groupBy("data_id", "source").agg(F.min("node").alias("component"), F.max("distance").alias("far"), F.count("*").alias("size"))
    parts = own.groupBy("data_id", "component").agg(F.max("far").alias("far"), F.first("size").alias("size"))
    whole = parts.groupBy("data_id").agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"), F.max_by("far", F.struct("size", -F.col("component"))).alias("diameter"))
    roots = own.filter("source = component").select("data_id", "source")
    side = pairs.join(roots, ["data_id", "source"]).select("data_id", "node", (F.col("distance") % 2).alias("side"))
    end = lambda c: side.select("data_id", F.col("node").alias(c), F.col("side").alias(f"of_{c}"))
    sides = edges.join(end("src"), ["data_id", "src"]).join(end("dst"), ["data_id", "dst"]).groupBy("data_id").agg(F.count("*").alias("edges"), F.bool_and(F.col("of_src") != F.col("of_dst")).alias("bipartite"))
    central = betweenness(levels, edges).groupBy("data_id").agg(F.max_by("node", F.struct(F.round("share", 9), -F.col("node"))).alias("central"))
    out = whole.join(sides, "data_id", "left").join(central, "data_id")
    m = F.coalesce("edges", F.lit(0)).cast("long")
    return out.select("data_id", "nodes", m.alias("edges"), "components", "largest", "diameter", F.coalesce("bipartite", F.lit(True)).alias("bipartite"), (m > F.col("nodes") - F.col("components")).alias("cyclic"), "central")


def forest(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """By level, from 0: (data_id, node, parent) of a spanning forest, breadth first from each component's least node; parents: the least possible."""
    both = _kept(symmetric(edges))
    levels = [_kept(labels(nodes, edges).filter("node = component").select("data_id", "node", F.lit(None).cast("long").alias("parent")))]
    while True:
        met = levels[-1].select("data_id", "node")
        if len(levels) > 1:
            met = met.union(levels[-2].select("data_id", "node"))
        step = levels[-1].select("data_id", F.col("node").alias("u")).join(both, ["data_id", "u"]).groupBy("data_id", F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        step = _kept(step.join(met, ["data_id", "node"], "left_anti"))
        if step.isEmpty():
            return levels
        levels.append(step)


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(data_id, src, dst): edges whose removal adds a component, from one spanning forest.

    Every edge outside the forest has a number, a hash of 128 bits; a node has the exclusive or of its edges' numbers,
    and so has a subtree. Edges within a subtree cancel out, so what is left is of edges that leave it: the edge
    above a subtree is a bridge if nothing is. (That some numbers cancel out by chance has odds of 2 ** -128 an edge.)
    """
    levels = forest(nodes, edges)
    tree = None
    for level in levels[1:]:
        ends = level.select("data_id", F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
        tree = ends if tree is None else tree.union(ends)
    if tree is None:
        return edges.select("data_id", "src", "dst").limit(0)
    numbers = lambda seed: F.xxhash64(F.lit(seed), "data_id", "src", "dst")
    rest = symmetric_with(edges.join(tree, ["data_id", "src", "dst"], "left_anti"), {"x": numbers(1), "y": numbers(2)})
    values = rest.groupBy("data_id", "node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    out, below = None, None
    for level in levels[:0:-1]:
        own = level.join(values, ["data_id", "node"], "left").select("data_id", "node", "parent", "x", "y")
        if below is not None:
            own = own.union(level.join(below, ["data_id", "node"]).select("data_id", "node", "parent", "x", "y"))
        own = _kept(own.groupBy("data_id", "node", "parent").agg(F.coalesce(F.bit_xor("x"), F.lit(0)).alias("x"), F.coalesce(F.bit_xor("y"), F.lit(0)).alias("y")))
        below = own.select("data_id", F.col("parent").alias("node"), "x", "y")
        found = own.filter("x = 0 and y = 0").select("data_id", F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
        out = found if out is None else out.union(found)
    return out


def symmetric_with(edges: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(data_id, node, columns): each edge's columns at both of its ends."""
    rows = edges.select("data_id", "src", "dst", *[c.alias(k) for k, c in columns.items()])
    return rows.select("data_id", F.explode(F.array("src", "dst")).alias("node"), *columns)


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(data_id, node, community): groups of nodes by modularity; a group is named by its least node.

    Every node begins alone. The gain of uniting two groups is 2 m w - k k' (edges of the graph, edges between
    them, sums of their degrees: exact integers). In a round each group takes its neighbour of the greatest gain
    above 0 (ties by a hash of the pair) and joins it if that one has more edges (ties by a hash) and doesn't join
    another itself. Of those who join one group, in order of gain, a group's gain counts all before it as members, and
    stays out if it isn't above 0; so the modularity rises with each round, and a hub's leaves join it at once. Then the
    groups' graph is aggregated anew. The pair of the greatest gain always unites: rounds end when no gain is left.
    """
    member = _kept(nodes.select("data_id", "node", F.col("node").alias("community")))
    links = _kept(edges.select("data_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("w")))
    sizes = _kept(degrees(nodes, edges).select("data_id", F.col("node").alias("c"), F.col("degree").alias("k")))
    graphs = sizes.groupBy("data_id").agg(F.sum("k").alias("ends"))  # 2 m
    for _ in range(rounds):
        k = lambda c: sizes.select("data_id", F.col("c").alias(c), F.col("k").alias(f"k{c}"))
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        gains = links.join(k("a"), ["data_id", "a"]).join(k("b"), ["data_id", "b"]).join(graphs, "data_id")
        gains = gains.withColumn("gain", wide("ends") * wide("w") - wide("ka") * wide("kb")).filter("gain > 0")
        gains = gains.withColumn("h", hashed(F.col("a"), F.col("b")))
        way = lambda c, t: F.struct(F.col(c).alias("c"), F.col(t).alias("t"), F.col(f"k{c}").alias("kc"), F.col(f"k{t}").alias("kt"))
        ways = gains.select("data_id", "ends", "w", "gain", F.struct("gain", "h", -F.col("a"), -F.col("b")).alias("order"), F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way"))
        best = ways.groupBy("data_id", F.col("way.c").alias("c")).agg(F.max_by(F.struct("way.t", "way.kc", "way.kt", "ends", "w", "gain"), "order").alias("best")).select("data_id", "c", "best.*")
        joins = _kept(best.filter(F.struct("kt", hashed(F.col("t")), "t") > F.struct("kc", hashed(F.col("c")), "c")))
        heads = joins.join(joins.select("data_id", F.col("c").alias("t")), ["data_id", "t"], "left_anti")
        before = F.coalesce(F.sum("kc").over(Window.partitionBy("data_id", "t").orderBy(F.desc("gain"), "c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        heads = heads.withColumn("left", wide("ends") * wide("w") - (wide("kt") + before.cast("decimal(19,0)")) * wide("kc")).filter("left > 0")
        names = heads.groupBy("data_id", "t").agg(F.least("t", F.min("c")).alias("into"))
        united = heads.select("data_id", "t", "c").join(names, ["data_id", "t"]).select("data_id", "into", F.col("c").alias("gone"))
        united = _kept(united.union(names.select("data_id", "into", F.col("t"))).filter("into <> gone"))
        if united.isEmpty():
            return member

        def renamed(rows: DataFrame, column: str) -> DataFrame:
            left = rows.join(united.withColumnRenamed("gone", column), ["data_id", column], "left")
            return left.withColumn(column, F.coalesce("into", column)).drop("into")

        member = _kept(renamed(member, "community").select("data_id", "node", "community"))
        sizes = _kept(renamed(sizes, "c").groupBy("data_id", "c").agg(F.sum("k").alias("k")))
        both = renamed(renamed(links, "a"), "b").select("data_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b")
        links = _kept(both.groupBy("data_id", "a", "b").agg(F.sum("w").alias("w")))
    raise RuntimeError(f"groups still unite after {rounds} rounds")


def projected(members: DataFrame, event: str, member: str, most: int = 1000) -> DataFrame:
    """(a, b, weight), a < b: members that share events, by the number of events they share; repeated rows count once.

    An event of more than ``most`` rows is split into parts by hash, and each pair of parts is a block of its own,
    so no block has more than about twice ``most`` rows. Rows and pairs are counted first: tasks are as many as
    hold about ``TASK_ROWS`` of them each.
    """
    rows = members.select(F.col(event).alias("e"), F.col(member).alias("m")).filter("e is not null and m is not null")
    sizes = rows.groupBy("e").agg(F.count("*").alias("n"))
    n = F.col("n")
    total = sizes.agg(F.sum("n").alias("rows"), F.sum((n * (n - 1) / 2).cast("long")).alias("pairs"), F.count_if(n > most).alias("large"), F.sum(F.when(n > most, n * F.ceil(n / most)).otherwise(n)).alias("dealt")).first()
    parts = F.lit(1)
    if total["large"]:
        rows = rows.join(sizes.filter(n > most).select("e", F.ceil(n / most).cast("int").alias("parts")), "e", "left")
        parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("m"), parts).cast("int")
    blocks = rows.select("e", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    blocks = blocks.select("e", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "m")
    blocks = dealt(blocks, total["dealt"] or 0, "e", "i", "j").groupBy("e", "i", "j").agg(F.collect_set(F.struct("own", "m")).alias("all"))
    # in a block of two parts each pair has one of each, so no pair is made twice
    firsts = blocks.select("i", "j", "all", F.explode("all").alias("x"))
    seconds = F.filter("all", lambda y: (y["m"] > F.col("x.m")) & ((F.col("i") == F.col("j")) | (y["own"] != F.col("x.own"))))
    pairs = firsts.select(F.col("x.m").alias("a"), F.explode(seconds).alias("y")).select("a", F.col("y.m").alias("b"))
    return dealt(pairs, total["pairs"] or 0, "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def distances(nodes: DataFrame, edges: DataFrame, source: int, rounds: int | None = None) -> DataFrame:
    """(data_id, node, distance) of what ``source`` reaches in each graph: breadth first, a join a level; an error where ``rounds`` levels don't reach all."""
    both = _kept(symmetric(edges))
    seen = _kept(nodes.filter(F.col("node") == source).select("data_id", "node", F.lit(0).cast("long").alias("distance")))
    front = seen
    for level in count(1):
        reached = front.select("data_id", F.col("node").alias("u")).join(both, ["data_id", "u"]).select("data_id", F.col("v").alias("node")).distinct()
        front = _kept(reached.join(seen, ["data_id", "node"], "left_anti").withColumn("distance", F.lit(level).cast("long")))
        if front.isEmpty():
            break
        if level == rounds:
            raise RuntimeError(f"nodes lie beyond {rounds - 1} levels")
        seen = _kept(seen.union(front))
    return seen
