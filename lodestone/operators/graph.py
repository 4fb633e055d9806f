"""Graph operators on edges (a, b), distributed: frontier loops and star contraction; see ``reachability`` for strong components and counts.

Each round is written to the shared folder, so plans stay short. Nodes are any comparable keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import discard, written


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct edges; with ``nodes`` (node), only those whose target is one of them."""
    own = edges.select("a", "b").distinct()
    return own if nodes is None else own.join(nodes.select(F.col("node").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """Distinct targets of one node."""
    return edges.where(F.col("a") == node).select(F.col("b").alias("node")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): every other node that a seed reaches, with its least number of steps.

    One join for each step over the frontier alone; nodes seen before leave by an anti join.
    """
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0))
    rounds, depth = [written(frontier, "frontier")], 0
    step = edges.select(F.col("a").alias("node"), "b")
    while max_depth is None or depth < max_depth:
        depth += 1
        near = rounds[-1].join(step, "node").select("seed", F.col("b").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, rounds).select("seed", "node")
        near = written(near.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if near.isEmpty():
            break
        rounds.append(near)
        if len(rounds) > 24:
            rounds = [written(reduce(DataFrame.unionByName, rounds[:-1]), "reached"), rounds[-1]]
    return reduce(DataFrame.unionByName, rounds).where("depth > 0")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth, kind): what depends on each seed, direct at one step and else transitive. Edges are made once, not in each round."""
    back = written(reverse(edges), "back")
    out = reach(back, seeds, max_depth)
    discard(back)
    return out.withColumn("kind", F.when(F.col("depth") == 1, "direct").otherwise("transitive"))


def _completions(live: DataFrame, sources: DataFrame, targets: DataFrame, spaces: list[tuple], max_nodes: int) -> dict[int, list]:
    """The least path of each space (start, banned, stop), by its place: of the paths that begin with ``start`` and go on with
    none of ``banned``, the shortest and then the least; with ``stop``, ``start`` itself is none of them.

    One search by breadth for all spaces together: a row for each space and node, with the least of the shortest paths there.
    """
    spark, kind = live.sparkSession, live.schema["at"].dataType.simpleString()
    rows = [(i, start, banned) for i, (start, banned, _) in enumerate(spaces)]
    own = spark.createDataFrame(rows, f"space int, start array<{kind}>, banned array<{kind}>")
    of = F.broadcast(own)  # at most max_paths * max_nodes rows
    ends = targets.select(F.col("node").alias("at"), F.lit(True).alias("hit")).distinct()
    marked = lambda front: written(front.join(ends, "at", "left").select("space", "at", "path", (F.coalesce("hit", F.lit(False)) & (F.size("path") > 1)).alias("hit")), "path-front")
    first = own.where("size(start) = 0").join(sources.select(F.col("node").alias("at")).distinct(), F.lit(True)).where(~F.array_contains("banned", F.col("at"))).select("space", "at", F.array("at").alias("path"))
    front = marked(first.unionByName(own.where("size(start) > 0").select("space", F.element_at("start", -1).alias("at"), F.col("start").alias("path"))))
    seen, found, fresh = front.select("space", "at"), {}, True
    while True:
        going = []
        for r in front.groupBy("space").agg(F.min(F.when(F.col("hit"), F.col("path"))).alias("path"), F.max(F.size("path")).alias("n")).collect():  # a row for each space
            if r["path"] is not None and not (fresh and spaces[r["space"]][2]):  # a space's own start may be none of its paths
                found[r["space"]] = list(r["path"])
            elif r["n"] < max_nodes:
                going.append(r["space"])
        if not going:
            return found
        near = front.where(F.col("space").isin(going)).drop("hit").join(live, "at").join(of, "space")
        near = near.where(~F.array_contains("start", F.col("b")) & ~((F.size("path") == F.size("start")) & F.array_contains("banned", F.col("b"))))
        front = marked(near.groupBy("space", F.col("b").alias("at")).agg(F.min(F.concat("path", F.array("b"))).alias("path")).join(seen, ["space", "at"], "left_anti"))
        seen, fresh = seen.union(front.select("space", "at")), False


def _leading(edges: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """(node) of the nodes from which a target is at most so many steps away."""
    seen = front = written(targets.select("node").distinct(), "leading")
    for _ in range(steps):
        near = edges.join(front.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        front = written(near.join(seen, "node", "left_anti"), "leading")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_paths: int = 10, max_nodes: int = 20) -> DataFrame:
    """(path): the shortest simple paths of two nodes or more from a source to a target, ties by the path itself.

    A path goes on beyond a target. All paths are parted into spaces of one beginning, of each of which the least path is
    known; a space whose path is among the first ones is parted again around it, until all of the first are. So the driver
    holds ``max_paths`` paths and their spaces, and no graph makes more rows than its edges for each space.
    """
    own = edges.where("a <> b").select("a", "b").distinct()
    useful = _leading(own, targets, max_nodes - 2).withColumnRenamed("node", "b")
    live = written(own.join(useful, "b", "left_semi").select(F.col("a").alias("at"), "b"), "live-edges")
    known: list[list] = []  # [path, start, banned, whether it is parted]
    spaces: list[tuple] = [([], [], False)]
    while spaces:
        for i, path in _completions(live, sources, targets, spaces, max_nodes).items():
            known.append([path, *spaces[i][:2], False])
        known = sorted(known, key=lambda x: (len(x[0]), x[0]))[:max_paths]
        spaces = []
        for entry in known:
            path, start, banned, parted = entry
            if not parted:
                entry[3] = True
                for n in range(len(start), len(path)):
                    spaces.append((path[:n], [*(banned if n == len(start) else []), path[n]], True))
                if len(path) < max_nodes:
                    spaces.append((path, [], True))
    kind = live.schema["at"].dataType.simpleString()
    return live.sparkSession.createDataFrame([(x[0],) for x in known], f"path array<{kind}>").coalesce(1).orderBy(F.size("path"), "path")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the least node it reaches. Links to itself and nulls say nothing.

    Alternating large-star and small-star steps until only stars are left; nothing but counts reaches the driver.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = written(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(before)
        # stars: each node points to one other, and none of those points on
        done = pairs.count() == least.count()
        discard(large)
        if done and pairs.select(F.col("v").alias("u")).join(pairs, "u", "left_semi").isEmpty():
            break
    own = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cycles(edges: DataFrame, groups: DataFrame, max_length: int | None = None) -> DataFrame:
    """(component, path): a shortest cycle through each component's own node, from it back to it; the least path of equals.
    With ``max_length``, only cycles of so many steps or fewer.

    ``groups``: (node, component) of ``strong_components``. The frontiers of all components go on together, with one path
    for each node reached.
    """
    groups = written(groups, "groups")
    at = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
    inside = edges.join(at("a"), "a").join(at("b"), "b").where("a_component = b_component").select(F.col("a_component").alias("component"), "a", "b").distinct()
    inside = written(inside, "inside")
    front = groups.select("component").distinct().select("component", F.col("component").alias("a"), F.array("component").alias("path"))
    seen, done, length = [], [], 0
    while True:
        length += 1
        step = front.join(inside, ["component", "a"]).groupBy("component", "b").agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        for known in seen:
            step = step.join(known, ["component", "b"], "left_anti")
        step = written(step, "cycle-step")
        back = step.where(F.col("b") == F.col("component")).select("component", "path")
        done.append(back)
        if length == max_length:
            return reduce(DataFrame.union, done)
        seen.append(step.select("component", "b"))
        if len(seen) > 8:
            seen = [written(reduce(DataFrame.union, seen), "cycle-seen")]
        front = step.join(back, "component", "left_anti").select("component", F.col("b").alias("a"), "path")
        if front.isEmpty():
            return reduce(DataFrame.union, done)


def greedy_walk(nodes: DataFrame, edges: DataFrame, max_steps: int = 6) -> list:
    """Start at the best source (by incoming, then complexity, then path), go to the best unvisited neighbour; one top-1
    query for each of at most ``max_steps`` steps."""
    rank = [F.desc("is_source"), F.desc("incoming_count"), F.desc_nulls_last("complexity_score"), "node"]
    walk: list = []
    at = nodes.orderBy(*rank).select("node").head()
    while at is not None and len(walk) < max_steps:
        walk.append(at["node"])
        near = neighbours(edges, at["node"]).where(~F.col("node").isin(walk))
        at = nodes.join(near, "node", "left_semi").orderBy(*rank[1:]).select("node").head()
    return walk


def relevant_tour(edges: DataFrame, relevant: DataFrame, max_steps: int = 8) -> list:
    """From the nearest relevant node over relevant neighbours by distance; a neighbour outside may connect once.

    ``relevant``: (node, distance). Each step is one top-1 query.
    """
    both = edges.select("a", "b").union(reverse(edges)).distinct()
    at = relevant.orderBy("distance", "node").head()
    tour: list = []
    bridge = True
    while at is not None and len(tour) < max_steps:
        tour.append(at["node"])
        near = neighbours(both, at["node"]).where(~F.col("node").isin(tour))
        after = relevant.join(near, "node", "left_semi").orderBy("distance", "node").head()
        if after is None and bridge:
            bridge = False
            after = near.orderBy("node").head()
        at = after
    return tour


def radius(nodes: DataFrame, column: str = "incoming_count") -> DataFrame:
    """8 + 16 sqrt(in / greatest in), for each node."""
    top = nodes.agg(F.greatest(F.lit(1), F.max(column)).alias("top"))
    return nodes.crossJoin(F.broadcast(top)).withColumn("radius", 8 + 16 * F.sqrt(F.col(column) / F.col("top"))).drop("top")  # one row


def display_graph(changed: DataFrame, edges: DataFrame, max_nodes: int = 80, max_edges: int = 150) -> tuple[DataFrame, DataFrame]:
    """Changed nodes, then their neighbours, up to a number; and edges among them."""
    both = edges.select("a", "b").union(reverse(edges))
    near = both.join(changed.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(changed.select("node"), "node", "left_anti")
    nodes = changed.select("node", F.lit(0).alias("ring")).union(near.select("node", F.lit(1).alias("ring"))).orderBy("ring", "node").limit(max_nodes)
    shown = nodes.select("node")
    inner = edges.join(shown.withColumnRenamed("node", "a"), "a", "left_semi").join(shown.withColumnRenamed("node", "b"), "b", "left_semi")
    return nodes, inner.select("a", "b").orderBy("a", "b").limit(max_edges)


def path_edges(paths: DataFrame) -> DataFrame:
    """Distinct (a, b) along the paths."""
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))
    return paths.where(F.size("path") > 1).select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()


def impact_ids(impact: DataFrame, nodes: DataFrame, key: Column | None = None) -> DataFrame:
    """Paths as node ids where known, else the path itself."""
    return impact.join(nodes.select("file_path", "file_id"), "file_path", "left").select("file_path", F.coalesce(F.col("file_id").cast("string"), "file_path").alias("id"))
