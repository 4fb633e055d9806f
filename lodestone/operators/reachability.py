"""Strong components and counts of dependents on edges (a, b), for graphs of any depth.

Long paths cost rounds by the logarithm of their length: strong components contract chains by pointer jumping, and sets of
dependents double their distance in each round. Each round is written to the shared folder. Nodes are any comparable keys;
edges that repeat count once, edges with a null end must be left out by the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import reach, reverse
from lodestone.storage import discard, written

#: Share of edges that a round of trimming must take away to be followed by another before chains are contracted.
WORTH = 8


def _trimmed(live: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``live`` without nodes that have no edge in or none out, as long as that takes away many edges: (edges, their number)."""
    while n:
        has_out, has_in = live.select(F.col("a").alias("b")).distinct(), live.select(F.col("b").alias("a")).distinct()
        before, live = live, written(live.join(has_out, "b", "left_semi").join(has_in, "a", "left_semi").select("a", "b"), "trimmed")
        discard(before)
        was, n = n, live.count()
        if (was - n) * WORTH < was:
            break
    return live, n


def _pointers(entered: DataFrame) -> tuple[list[DataFrame], DataFrame, bool]:
    """Trees of nodes with one edge in, each below the node that the edge comes from: (rungs, state, whether there are rings).

    ``entered``: (node, n, at), a node's number of edges in and where one is from. ``state``: (node, at, on, top); a node on no
    ring and below none has its tree's root at ``at``. Where ``on`` is left, ``at`` goes over all nodes of rings, and a ring's nodes have
    its greatest at ``top``. Pointers reach four times as far after each round; a rung for each distance of 1, 4, 16, ... has
    (node, steps), what is once, twice and three times so far above a node, or else its root.
    """
    one = entered.where("n = 1").select("node", "at")
    state = one.join(one.select(F.col("node").alias("at"), F.lit(True).alias("on")), "at", "left").fillna(False, ["on"])
    state = written(state.select("node", "at", "on", F.col("node").alias("top")), "pointers")
    rungs, left, images = [], state.where("on").count(), None
    while left:
        ahead = state.select(F.col("node").alias("key"), F.col("at").alias("at2"), F.col("on").alias("on2"), F.col("top").alias("top2"))
        moved = state.where("on").select("node", "at", "on", "top", F.col("top").alias("was"), F.array("at").alias("steps"))
        for _ in range(3):  # a pointer that has ended meets its own node, so that all keys are spread alike
            met = moved.withColumn("key", F.when(F.col("on"), F.col("at")).otherwise(F.col("node"))).join(ahead, "key")
            at = F.when(F.col("on"), F.col("at2")).otherwise(F.col("at"))
            top = F.when(F.col("on"), F.greatest("top", "top2")).otherwise(F.col("top"))
            moved = met.select("node", at.alias("at"), (F.col("on") & F.col("on2")).alias("on"), top.alias("top"), "was", F.concat("steps", F.array(at)).alias("steps"))
        moved = moved.select("node", "at", "on", "top", (F.col("top") > F.col("was")).alias("grew"), F.slice("steps", 1, 3).alias("steps"))
        ended = state.where("not on").select("node", "at", "on", "top", F.lit(False).alias("grew"), F.array("at").alias("steps"))
        before, state = state, written(ended.unionByName(moved), "pointers")
        was, (left, grew) = left, state.agg(F.count_if("on"), F.count_if("grew")).head()
        if not any(before is r for r in rungs):
            discard(before)
        if left < was:
            rungs.append(state)
            continue
        # some pointers end in each round as long as any can: what is left is on rings or below them
        if not grew:  # each pointer on a ring has seen all of it; those below come onto it as long as fewer nodes are pointed to
            was, images = images, state.where("on").select("at").distinct().count()
            if images == was:
                break
    return rungs, state, left > 0


def _contracted(live: DataFrame, turned: bool) -> tuple[tuple | None, DataFrame | None, DataFrame]:
    """Trees of nodes with one edge in (``turned``: one edge out) become their roots, the nodes with more: (what ``_spread`` needs, if
    anything, rings, edges between roots).

    A root reaches all of its tree, and every edge that is in no tree ends at a root; so roots reach each other as before.
    Trees below nodes without edges in or below rings are left out, since nothing leads back into them. ``rings``: (node, component).
    """
    live = reverse(live) if turned else live
    entered = written(live.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("at")), "entered")
    if entered.where("n = 1").isEmpty():  # no trees: only edges from nodes that have none in are left out
        short = live.join(entered.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
        short = written(reverse(short) if turned else short, "core")
        discard(entered)
        return None, None, short
    rungs, state, ringed = _pointers(entered)
    loose = state.where("on")
    rings = loose.select(F.col("at").alias("node")).distinct().join(loose.select("node", F.col("top").alias("component")), "node") if ringed else None
    roots = entered.where("n > 1").select(F.col("node").alias("root"))
    of = state.where("not on").select("node", F.col("at").alias("root")).join(roots, "root", "left_semi").select("node", "root").union(roots.select("root", "root"))
    out = live.join(roots.select(F.col("root").alias("b")), "b", "left_semi").join(of.withColumnRenamed("node", "a"), "a")
    out = written(out.select("a", "root", "b"), "out-of-trees")
    discard(entered)
    if out.isEmpty():
        return None, rings, out.select("a", "b")
    ends = ("b", "root") if turned else ("root", "b")
    return (rungs, state, out), rings, written(out.where("root <> b").select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).distinct(), "core")


def _spread(names: DataFrame, rungs: list[DataFrame], state: DataFrame, out: DataFrame) -> DataFrame:
    """(node, component) of the nodes in trees, of that of their roots: a node is in its root's component if an edge from it or
    from below it leads there."""
    back = out.where("root = b").select(F.col("b").alias("node")).distinct().join(names, "node", "left_anti")
    names = written(names.union(back.select("node", F.col("node").alias("component"))), "scc")
    at = lambda end: names.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    inside = out.join(at("root"), "root").join(at("b"), "b").where("root_in = b_in").select(F.col("a").alias("node")).distinct()
    for k, rung in enumerate(rungs):  # distances are sums of the rungs'
        above = inside.join(rung.select("node", "steps"), "node", "left").select(F.explode(F.array_distinct(F.concat(F.array("node"), F.coalesce("steps", F.array("node"))))).alias("node")).distinct()
        inside = written(above, "inside") if k % 4 == 3 else above
    below = inside.join(state.where("not on").select("node", F.col("at").alias("root")), "node").join(at("root"), "root").select("node", F.col("root_in").alias("component"))
    return written(below.union(names), "scc")


def _coloured(live: DataFrame) -> list[DataFrame]:
    """(node, component) tables for the nodes of edges without chains: the greatest node that reaches a node is its colour;
    what reaches the colour's node back within the colour is that node's component, and leaves."""
    done: list[DataFrame] = []
    n = live.count()
    while n:
        nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
        colour = written(nodes.select("node", F.col("node").alias("c"), F.lit(True).alias("moved")), "colour")
        while True:
            # nodes whose colour moved push it on; what moves with that is told apart in the same aggregate
            pushed = live.join(colour.where("moved").select(F.col("node").alias("a"), "c"), "a").groupBy(F.col("b").alias("node")).agg(F.max("c").alias("c"))
            held = colour.select("node", "c", F.col("c").alias("old"))
            after = held.unionByName(pushed, allowMissingColumns=True).groupBy("node").agg(F.max("c").alias("c"), F.max("old").alias("old"))
            after = written(after.select("node", "c", (F.col("c") > F.col("old")).alias("moved")), "colour")
            discard(colour)
            colour = after
            if colour.where("moved").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), colour.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        inside = written(live.join(a, "a").join(b, "b").where("ca = cb").select("a", "b"), "inside")
        roots = colour.where("node = c").select("node")
        back = reach(reverse(inside), roots).select("node", F.col("seed").alias("component"))
        own = written(back.union(roots.select("node", F.col("node").alias("component"))), "scc")
        done.append(own)
        gone = own.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        rest = written(rest.select("a", "b"), "core")
        live, n = _trimmed(rest, rest.count())
    return done


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes in strongly connected components of two or more nodes, or with an edge to themselves; a
    component is named by its greatest node.

    Trees of nodes with one edge in become one node, then trees of those with one edge out, again and again as long as that takes
    away many edges; rounds of colouring tell the rest.
    """
    live = written(edges.where("a <> b").select("a", "b").distinct(), "core")
    n, levels = live.count(), []
    while n:
        was = n
        for turned in (False, True):
            level, rings, short = _contracted(live, turned)
            discard(live)
            live = short
            levels.append((level, rings))
            n = live.count()
            if not n:
                break
        if (was - n) * WORTH < was:
            break
    names = reduce(DataFrame.union, _coloured(live) if n else [], edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0))
    for level, rings in reversed(levels):
        names = _spread(names, *level) if level else names
        names = names.union(written(rings, "rings")) if rings else names  # no edge of their level leads from them into a tree
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    # a node with an edge to itself alone is a component; in a larger one it has its name twice
    sizes = names.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("name"))
    large = names.join(sizes.where("n > 1"), "component").select("node", F.col("name").alias("component"))
    return large.union(loops.distinct().join(large.select("node"), "node", "left_anti").select("node", "component"))


def condensed(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, c) of every node, and the distinct edges (a, b) between different components; ``nodes``: (node)."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).union(nodes.select("node")).distinct()
    of = written(ends.join(strong_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("c")), "component-of")
    a, b = of.select(F.col("node").alias("a"), F.col("c").alias("ca")), of.select(F.col("node").alias("b"), F.col("c").alias("cb"))
    between = edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    return of, written(between, "condensation")


def bounded_sets(dag: DataFrame, sizes: DataFrame, bound: int) -> DataFrame:
    """(c, items, full): all components from which each one is reached, or ``full`` where those and it have ``bound`` nodes or more.

    ``dag``: edges (a, b) without cycles; ``sizes``: (c, size). In a round each set takes in the sets of its farthest
    members, so sets know twice the distance after it; a full set is dropped and makes full what it reaches. No set
    holds more than ``bound`` items, so a node of any degree and a graph of any size keep rows of bounded size.
    """
    place = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    near = dag.withColumn("place", place).where(F.col("place") <= bound)  # limits each task's rows of a key before they are shuffled
    large = sizes.where(F.col("size") >= bound).select(F.col("c").alias("a"), F.lit(True).alias("large"))
    near = near.join(large, "a", "left").groupBy(F.col("b").alias("c")).agg(F.collect_list("a").alias("items"), F.max(F.coalesce("large", F.lit(False))).alias("full"))
    none = F.array().cast(near.schema["items"].dataType)
    state = sizes.join(near, "c", "left")
    full = F.coalesce("full", F.lit(False)) | (F.col("size") >= bound) | (F.coalesce(F.size("items"), F.lit(0)) >= bound)
    state = state.select("c", F.coalesce("items", none).alias("items"), full.alias("full"))
    kept = lambda c: F.when(F.col("full"), none).otherwise(F.col(c)).alias(c)
    state = written(state.select("c", kept("items"), kept("items").alias("last"), "full"), "sets")
    while not state.where("size(last) > 0").isEmpty():
        asked = state.select("c", F.explode("last").alias("z"))
        given = state.select(F.col("c").alias("z"), F.array_except("items", "last").alias("nearer"), F.col("last").alias("farther"), "full")
        union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        got = asked.join(given, "z").groupBy("c").agg(union("nearer").alias("nearer"), union("farther").alias("farther"), F.max("full").alias("filled"))
        both = state.join(got, "c", "left").fillna(False, ["filled"])
        nearer, farther = F.coalesce("nearer", none), F.coalesce("farther", none)
        grown = both.select("c", F.array_distinct(F.concat("items", nearer, farther)).alias("items"), F.array_except(F.array_except(farther, nearer), "items").alias("last"), (F.col("full") | F.col("filled")).alias("full"))
        grown = grown.withColumn("full", F.col("full") | (F.size("items") >= bound))
        before, state = state, written(grown.select("c", kept("items"), kept("last"), "full"), "sets")
        discard(before)
    return state.select("c", "items", "full")


def _closures(dag: DataFrame, of: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, n): for each full component, how many nodes reach it, its own included.

    Bitmaps over numbered nodes, 32,768 to a row, are passed on along edges between full components until none grows.
    """
    numbers = written(of.select("c", F.monotonically_increasing_id().alias("id")), "numbered-nodes")
    full, few = sets.where("full").select("c"), sets.where("not full").select(F.col("c").alias("a"), "items")
    into = dag.join(full.select(F.col("c").alias("b")), "b", "left_semi")
    given = into.join(few, "a").select(F.col("b").alias("c"), F.explode(F.concat("items", F.array("a"))).alias("m"))
    members = given.union(full.select("c", F.col("c").alias("m"))).distinct()
    at = members.join(numbers.select(F.col("c").alias("m"), "id"), "m").select("c", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    state = written(at.groupBy("c", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("grew", F.lit(True)), "bitmaps")
    along = written(into.join(full.select(F.col("c").alias("a")), "a", "left_semi").select("a", "b"), "full-edges")
    while True:
        pushed = state.where("grew").select(F.col("c").alias("a"), "bucket", "bits").join(along, "a").select(F.col("b").alias("c"), "bucket", "bits", F.lit(None).cast("long").alias("old"))
        both = state.select("c", "bucket", "bits", F.bitmap_count("bits").alias("old")).union(pushed)
        grown = both.groupBy("c", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.coalesce(F.max("old"), F.lit(0)).alias("old"))
        before, state = state, written(grown.select("c", "bucket", "bits", (F.bitmap_count("bits") > F.col("old")).alias("grew")), "bitmaps")
        discard(before)
        if state.where("grew").isEmpty():
            return state.groupBy("c").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _beyond(back: DataFrame, seeds: DataFrame, enough: int) -> DataFrame:
    """(seed, n): nodes at two or more steps of each seed, exact below ``enough``: a search that ends for a seed once it has
    found so many, and keeps no more of a step."""
    step = back.select(F.col("a").alias("node"), "b")
    front = written(seeds.select(F.col("node").alias("seed"), "node").join(step, "node").select("seed", F.col("b").alias("node")).where("seed <> node").distinct(), "direct")
    seen, found = front, front.limit(0)
    while True:
        near = front.join(step, "node").select("seed", F.col("b").alias("node")).where("seed <> node").distinct().join(seen, ["seed", "node"], "left_anti")
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("place") <= enough).drop("place")
        near = written(near, "beyond")
        found = written(found.union(near), "beyond")
        counts = found.groupBy("seed").agg(F.count("*").alias("n"))
        front = written(near.join(counts.where(F.col("n") >= enough), "seed", "left_anti"), "beyond")
        if front.isEmpty():
            return counts
        seen = seen.union(near)


def transitive_counts(edges: DataFrame, seeds: DataFrame, enough: int | None = None, bound: int | None = None) -> DataFrame:
    """(seed, n): dependents at two or more steps; with ``enough``, counts from there on are some number that isn't less.

    Every node's dependents are its component's own and those of all components before it. Sets of components, bounded
    in size, say how many these are where they are few. Beyond, nodes with few direct dependents have ``enough``; those with
    many are searched for up to it. Without ``enough``, bitmaps count what the sets don't hold. Any ``bound`` of the sets
    gives the same result.
    """
    own = edges.select("a", "b").distinct()
    asked = seeds.select("node").distinct()
    of, dag = condensed(own, asked)
    sizes = written(of.groupBy("c").agg(F.count("*").alias("size")), "sizes")
    bound = bound or (256 if enough is None else 2 * enough + 58)
    sets = bounded_sets(dag, sizes, bound)
    members = sets.where("not full").select("c", F.explode(F.concat("items", F.array("c"))).alias("m"))
    n = members.join(sizes.select(F.col("c").alias("m"), "size"), "m").groupBy("c").agg(F.sum("size").alias("n"))
    full = sets.where("full").select("c")
    n = n.union(_closures(dag, of, sets) if enough is None else full.withColumn("n", F.lit(bound).cast("long")))
    direct = own.where("a <> b").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("direct"))
    counted = asked.join(of, "node").join(n, "c").join(full.withColumn("full", F.lit(True)), "c", "left").join(direct, "node", "left").fillna(0, ["direct"])
    counted = written(counted.select(F.col("node").alias("seed"), (F.col("n") - 1 - F.col("direct")).alias("n"), "full"), "transitive-counts")
    if enough is None:
        return counted.select("seed", "n")
    open_ = F.col("full") & (F.col("n") < enough)
    hubs = counted.where(open_).select(F.col("seed").alias("node"))
    if hubs.isEmpty():
        return counted.select("seed", "n")
    searched = hubs.select(F.col("node").alias("seed")).join(_beyond(reverse(own), hubs, enough), "seed", "left").fillna(0, ["n"])
    return counted.where(F.coalesce(~open_, F.lit(True))).select("seed", "n").union(searched.select("seed", "n"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of nodes, edges and cyclic components."""
    cycles = strong_components(edges).select("component").distinct().agg(F.count("*").alias("n_cycles"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(cycles)  # single rows
