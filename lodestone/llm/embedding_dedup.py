"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are one node. The nodes of a label go to overlapping shards, those of their nearest centroids; the nearest
is a node's home. Each shard builds a graph: every node keeps near neighbours that no kept one already stands for (robust
pruning). Adjacency lists of all shards are united by node.

Every node is searched for, round by round. A visit walks greedily from the best of a shard's medoids towards the node, takes
the neighbours of where it ends, and then expands from every find within range to its neighbours until nothing new is
within range. A search visits the node's own shards first, then each shard that is home to a graph neighbour of something
it found, until none is left; who is found visits the finder's home in turn, so links hold in both directions. Finds are
verified by cosine in double precision: no link below the threshold is ever made, and none is counted twice. Links are
counted where they are found; only those that connect a shard's finds are written, at most one for each visit and node.
``audit`` measures recall against brute force.

Centroids are fitted on a bounded sample (``SAMPLE`` nodes for each centroid); every node is indexed. Vectors that are
null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing and keep their
rows. Only vectors of one length are compared. Repeated rows are copies and link with one another. Extra columns of any
name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import discard, written
from lodestone.operators.graph import components

#: Nodes of a shard, in expectation and before overlap; shards that a node joins; sampled nodes for each centroid.
SHARD, OVERLAP, SAMPLE = 700, 3, 24
#: Most centroids that are held at once: beyond SHARD times as many nodes, shards hold more nodes, in more rooms each.
MAX_CENTROIDS = 1 << 14
#: Kept neighbours, candidates that pruning looks at, and how much nearer a kept neighbour must be to stand for another.
DEGREE, CANDIDATES, ALPHA = 24, 96, 1.2
#: Visitors that search at once; about so many visitors, and nodes at home, meet in a task at most.
BLOCK, VISITORS, ROOM = 1024, 8192, 2048
#: Medoids of a shard's nodes at home.
MEDOIDS = 8


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; of any magnitude, since none is squared before its greatest component is 1."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def robust_prune(sims: np.ndarray, order: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours kept of the candidates in ``order`` (nearest first); ``sims``: among all nodes, row 0 being the node's own."""
    kept: list[int] = []
    alive = np.ones(len(order), dtype=bool)
    own = 1 - sims[0][order]
    for i in range(len(order)):
        if alive[i]:
            kept.append(order[i])
            if len(kept) == degree:
                break
            alive &= alpha * (1 - sims[1][order[i]][order]) > own
    return np.array(kept, dtype=np.int64)


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of each of the unit rows."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    width = min(CANDIDATES, n - 1)
    if width <= 0:
        return [np.zeros(0, np.int64)] * n
    near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    out = []
    for i in range(n):
        order = near[i][np.argsort(-sims[i][near[i]], kind="stable")]
        out.append(robust_prune((sims[i], sims), order, DEGREE, ALPHA))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own.tolist():
            back[j].append(i)
    merged = []
    for i in range(n):
        both = np.unique(np.concatenate([out[i], np.array(back[i], dtype=np.int64)]))
        if len(both) > 2 * DEGREE:
            order = both[np.argsort(-sims[i][both], kind="stable")]
            both = robust_prune((sims[i], sims), order, 2 * DEGREE, ALPHA)
        merged.append(both)
    return merged


def _member(lists: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which of the sorted values each list holds."""
    out = np.zeros((len(lists), len(values)), dtype=bool)
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])
    if len(flat) and len(values):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        held = values[at] == flat
        out[row[held], at[held]] = True
    return out


def _connect(hits: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, column) hits that connect what ``hits`` connects; ``label`` of the columns is kept up to date."""
    for i in np.flatnonzero(hits.any(axis=1)):
        at = np.flatnonzero(hits[i])
        groups, first = np.unique(label[at], return_index=True)
        for k in at[first]:
            yield i, k
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]


def medoids(x: np.ndarray, n: int) -> np.ndarray:
    """The row nearest to the mean, then rows that are each farthest from those chosen before."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[out[0]]
    while len(out) < min(n, len(x)):
        out.append(int(near.argmin()))
        near = np.maximum(near, x @ x[out[-1]])
    return np.array(out)


def search(sims: np.ndarray, near: np.ndarray, starts: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """What each query (row) finds within range over a graph of nodes (columns).

    ``near``: 1 where two nodes are neighbours, 0 elsewhere. A walk goes from the best of ``starts`` to a neighbour that is
    nearer for as long as there is one. Where it ends, two steps around it and the query's ``own`` node (-1: none) are
    looked at; finds within range are expanded until no neighbour is new.
    """
    rows = np.arange(len(sims))
    at = starts[sims[:, starts].argmax(axis=1)]
    moving = rows
    while len(moving):
        ahead = np.where(near[at[moving]] > 0, sims[moving], -2)
        best = ahead.argmax(axis=1)
        nearer = ahead[np.arange(len(moving)), best] > sims[moving, at[moving]]
        moving = moving[nearer]
        at[moving] = best[nearer]
    seen = np.zeros(sims.shape, dtype=bool)
    seen[rows, at] = True
    seen[rows[own >= 0], own[own >= 0]] = True
    for _ in range(2):
        seen |= seen.astype(np.float32) @ near > 0
    within = sims >= least
    fresh = seen & within
    while True:
        active = np.flatnonzero(fresh.any(axis=1))
        if not len(active):
            return seen & within
        ahead = (fresh[active].astype(np.float32) @ near > 0) & ~seen[active]
        seen[active] |= ahead
        fresh = np.zeros(sims.shape, dtype=bool)
        fresh[active] = ahead & within[active]


def visit(home: pd.DataFrame, visitors: pd.DataFrame, least: float) -> pd.DataFrame:
    """What visitors of a shard find over the graph of the nodes at home there.

    Rows (node, n, next) have a node's number of finds, copies included, and the shards it has yet to visit; rows
    (node, other) are links that connect the finds.
    """
    if not len(home) or not len(visitors):
        return pd.DataFrame({"node": [], "n": [], "next": [], "other": []})
    ids, x, copies = home["node"].to_numpy(), _unit(home["vec"]), home["copies"].to_numpy()
    order, label = np.argsort(ids), np.arange(len(ids))
    shards = np.unique(np.concatenate([*home["edges"], *visitors["edges"]]).astype(np.int64))
    edges = _member(list(home["edges"]), shards).astype(np.float32)
    homes = np.unique(visitors["home"].to_numpy())
    called = np.zeros((len(ids), len(homes)), dtype=bool)
    near = np.zeros((len(ids), len(ids)), dtype=np.float32)
    near[:, order] = _member(list(home["links"]), ids[order])
    near = np.maximum(near, near.T)
    starts = medoids(x, MEDOIDS)
    parts, links = [], []
    for a in range(0, len(visitors), BLOCK):
        own = visitors.iloc[a : a + BLOCK]
        q = own["node"].to_numpy()
        at = order[np.minimum(np.searchsorted(ids, q, sorter=order), len(ids) - 1)]
        same = ids[at] == q
        hits = search(_unit(own["vec"]) @ x.T, near, starts, np.where(same, at, -1), least)
        hits[np.flatnonzero(same), at[same]] = False
        found = hits.astype(np.float32)
        ahead = (found @ edges > 0) | _member(list(own["edges"]), shards)
        ahead &= ~_member(list(own["seen"]), shards)
        parts.append(pd.DataFrame({"node": q, "n": hits @ copies, "next": [shards[row] for row in ahead]}))
        called |= (found.T @ (own["home"].to_numpy()[:, None] == homes).astype(np.float32)) > 0
        links += [(q[i], ids[k]) for i, k in _connect(hits, label)]
    called &= ~_member(list(home["seen"]), homes)
    parts.append(pd.DataFrame({"node": ids, "n": 0, "next": [homes[row] for row in called]}))
    out = pd.concat(parts, ignore_index=True)
    out = out[(out["n"] > 0) | (out["next"].map(len) > 0)].assign(other=None)
    return pd.concat([out, pd.DataFrame({"node": [i for i, _ in links], "n": None, "next": None, "other": [k for _, k in links]})], ignore_index=True).astype({"n": "Int64", "other": "Int64"})


def valid(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that isn't zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centroids(nodes: DataFrame, sizes: dict) -> dict:
    """Unit centroids by group: spherical k-means on a bounded sample, where a group needs more than one shard."""
    want = {g: int(np.ceil(n / SHARD)) for g, n in sizes.items() if n > 1.5 * SHARD}
    total = sum(want.values())
    if total > MAX_CENTROIDS:
        want = {g: max(2, k * MAX_CENTROIDS // total) for g, k in sorted(want.items(), key=lambda x: -x[1])[: MAX_CENTROIDS // 2]}
    if not want:
        return {}
    share = F.create_map(*[F.lit(x) for g, k in want.items() for x in (g, min(1.0, SAMPLE * k / sizes[g]))])
    draw = F.xxhash64("node", F.lit(1)).bitwiseAND(F.lit((1 << 24) - 1)) / float(1 << 24)
    picked = nodes.where(draw < F.element_at(share, F.col("grp"))).select("grp", "vec").toPandas()
    out = {}
    for g, own in picked.groupby("grp"):
        x = _unit(own["vec"])
        c = x[np.random.default_rng(3).permutation(len(x))[: want[g]]]
        for _ in range(6):
            at = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            norm = np.sqrt((sums * sums).sum(axis=1))
            c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
        out[g] = c
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("__id"), F.when(valid(F.col(vec_col)) & F.col(label_col).isNotNull(), vec).alias("vec"), F.col(label_col).cast("string").alias("__label"))
    rows = rows.withColumn("grp", F.when(F.col("vec").isNotNull(), F.concat_ws("/", F.size("vec").cast("string"), "__label")))
    rows = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("grp", "vec")))
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("vec").alias("vec")), "nodes")
    sizes = {r[0]: r[1] for r in nodes.groupBy("grp").count().where(F.col("count") > 1.5 * SHARD).orderBy(F.desc("count")).limit(MAX_CENTROIDS).collect()}
    shared = spark.sparkContext.broadcast(_centroids(nodes, sizes))  # at most MAX_CENTROIDS vectors

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, own in frame.groupby("grp"):
                c = shared.value.get(g)
                if c is None:
                    yield own[["grp", "node", "vec", "copies"]].assign(shard=0, home=0)
                    continue
                order = np.argsort(-(_unit(own["vec"]) @ c.T), axis=1)[:, :OVERLAP]
                for k in range(order.shape[1]):
                    yield own[["grp", "node", "vec", "copies"]].assign(shard=order[:, k], home=order[:, 0])

    placed = written(nodes.mapInPandas(assign, "grp string, node long, vec array<double>, copies long, shard long, home long"), "shards")

    #: Two nodes within range of a third are within twice its angle of each other: longer edges lead to no link.
    close = 2 * least * least - 1 if least > 0 else -1.0

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x, home = _unit(frame["vec"]), frame["home"].to_numpy()
        edges = [np.unique(home[own[x[own] @ x[i] >= close - 1e-9]]) for i, own in enumerate(build_graph(x))]
        return pd.DataFrame({"node": frame["node"], "edges": edges})

    def navigate(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["node"].to_numpy()
        return pd.DataFrame({"node": ids, "links": [ids[own] for own in build_graph(_unit(frame["vec"]))]})

    # k-means may leave most of a dense group in one shard: its graphs are built in parts, and visits see all of them
    deal = placed.groupBy("grp", "shard").agg(F.ceil(F.count("*") / (OVERLAP * ROOM)).alias("parts"))
    dealt = placed.join(deal, ["grp", "shard"]).withColumn("part", F.pmod(F.xxhash64("node", "shard"), "parts"))
    graph = dealt.groupBy("grp", "shard", "part").applyInPandas(build, "node long, edges array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    at_home = placed.where("shard = home").drop("shard")
    rooms = written(at_home.groupBy("grp", F.col("home").alias("shard")).agg(F.ceil(F.count("*") / ROOM).alias("rooms")), "rooms")
    housed = at_home.join(rooms.withColumnRenamed("shard", "home"), ["grp", "home"]).withColumn("room", F.pmod(F.xxhash64("node", F.lit(1)), "rooms"))
    ways = housed.groupBy("grp", "home", "room").applyInPandas(navigate, "node long, links array<long>")
    index = written(housed.drop("rooms").join(united, "node").join(ways, "node"), "graph")
    state = placed.groupBy("node").agg(F.collect_set("shard").alias("seen")).select("node", "seen", F.col("seen").alias("fresh"), F.lit(0).cast("long").alias("others"))
    state, links = written(state, "state"), None
    discard(placed)
    while True:
        going = state.where("size(fresh) > 0").select("node", "seen", F.explode("fresh").alias("shard"))
        going = going.join(index.drop("links", "room"), "node")
        load = going.groupBy("grp", "shard").agg(F.ceil(F.count("*") / VISITORS).alias("parts")).join(rooms, ["grp", "shard"])
        visitors = going.join(load, ["grp", "shard"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("room", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1)))
        home = index.withColumn("shard", F.col("home")).join(load, ["grp", "shard"]).join(state.select("node", "seen"), "node")
        home = home.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        keys, columns = ["grp", "shard", "part", "room"], ["node", "vec", "copies", "home", "edges", "seen"]
        home = home.select(*[F.col(c).alias(c) for c in (*keys, *columns, "links")])  # names of its own beside the visitors
        pairs = home.groupBy(*keys).cogroup(visitors.select(*keys, *columns).groupBy(*keys))
        found = written(pairs.applyInPandas(lambda h, v: visit(h, v, least), "node long, n long, next array<long>, other long"), "visits")
        own = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        links = own if links is None else links.unionByName(own)
        news = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
        fresh = F.array_except(F.coalesce("next", F.array().cast("array<long>")), "seen")
        before = state
        state = state.drop("fresh").join(news, "node", "left").select("node", F.array_union("seen", fresh).alias("seen"), fresh.alias("fresh"), (F.col("others") + F.coalesce("n", F.lit(0))).alias("others"))
        state = written(state, "state")
        discard(before)
        if state.where("size(fresh) > 0").isEmpty():
            break
    counts = state.select(F.col("node").alias("a"), "others")
    groups = components(links)
    n = nodes.select("node", "copies").join(counts.withColumnRenamed("a", "node"), "node", "left").join(groups, "node", "left")
    n = n.select(F.col("node").alias("node_"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    slim = rows.select("__id", "node")
    named = slim.where("node is not null").join(n, F.col("node") == F.col("node_")).select("__id", "n_links", "c")
    first = named.groupBy("c").agg(F.min("__id").alias("component_id")).withColumnRenamed("c", "c_")
    out = named.join(first, F.col("c") == F.col("c_")).select("__id", "n_links", "component_id")
    alone = slim.where("node is null").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("__id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, every: int = 100) -> float:
    """Recall of n_links on rows whose id is divisible by ``every``, against brute force over all rows in blocks."""
    spark = vectors.sparkSession
    queries = vectors.where((F.col(id_col) % every == 0) & valid(F.col(vec_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("l"))
    held = spark.sparkContext.broadcast(queries.toPandas())

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = held.value
        for frame in frames:
            for label, own in frame.groupby("l"):
                mine = q[q["l"] == label]
                if len(mine):
                    hits = (_unit(mine["v"]) @ _unit(own["v"]).T >= least).sum(axis=1)
                    yield pd.DataFrame({"q": mine["q"], "hits": hits})

    rows = vectors.where(valid(F.col(vec_col)) & F.col(label_col).isNotNull()).select(F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("l"))
    want = rows.mapInPandas(brute, "q long, hits long").groupBy("q").agg((F.sum("hits") - 1).alias("want"))
    got = result.select(F.col(id_col).alias("q"), "n_links").join(want, "q").agg(F.sum("n_links"), F.sum("want")).first()
    return 1.0 if not got[1] else got[0] / got[1]
