"""Merkle manifest of a dataset: a tree of digests for each group of rows, a root over the groups, and a proof for each row.

A leaf is the SHA-256 of chosen columns, each written as its length in bytes, a colon and its value, or ``-`` if null.
Digests are lowercase hexadecimal text and are hashed as such. Leaves of a group ascend by a key; every ``FANOUT``
neighbouring nodes (the last run: fewer, even one) become the digest of their concatenation, until one node is left, the
group's subroot (a lone leaf itself). Subroots, ordered by group, make the root in the same way.

Work goes by aligned blocks of ``BLOCK`` nodes, whatever group they are of: a hot group is many blocks. A block is one
contiguous matrix of 64-byte rows; reshaped by the fanout, its rows are hashed level by level, and what stands beside
a node at any level follows from its index. Block tops are the nodes of the next round. Proofs come back down the same
way: a block's proof travels to its block as a row in front of its nodes. Rows are numbered range by range, so that no task
sees a whole group, and only keys and digests are shuffled, never texts.

The null group comes first, then groups in the order of their UTF-8 bytes; null keys come first in a group, and rows of one
key stand in the order of their leaves (equal rows in any order, with the same results). An empty table gives an empty
manifest. Columns that aren't named are left out, whatever their names; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import discard, written
from lodestone.llm._text import settle

FANOUT, LEVELS = 16, 2
#: Nodes of a block: ``LEVELS`` levels of the tree.
BLOCK = FANOUT**LEVELS

PATH = "array<struct<at: int, others: string>>"
_NODE = "grp string, index long, total long, digest string"


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 over the columns' lengths and values, as hexadecimal text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the nodes beside its way up give."""
    left = lambda x: F.substring(x["others"], F.lit(1), x["at"] * 64)
    right = lambda x: F.substring(x["others"], x["at"] * 64 + 1, F.length(x["others"]))
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(left(x), node, right(x)), 256))


def tree(leaves: np.ndarray, levels: int) -> list[np.ndarray]:
    """Matrices of digests, (n, 64) bytes each: the leaves, and ``levels`` levels above them."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        whole = len(below) // FANOUT * FANOUT
        runs = [*below[:whole].reshape(-1, FANOUT * 64), *([below[whole:].reshape(-1)] if whole < len(below) else [])]
        out.append(np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, 64))
    return out


def beside(nodes: list[np.ndarray], index: int) -> list[tuple[int, bytes]]:
    """Of each level below the top: how many nodes of its run stand left of the leaf's own, and all others of the run."""
    out = []
    for level in nodes[:-1]:
        run = index - index % FANOUT
        out.append((index - run, level[run:index].tobytes() + level[index + 1 : run + FANOUT].tobytes()))
        index //= FANOUT
    return out


def levels_of(total: int) -> int:
    """Levels that a block of a tree of so many nodes climbs."""
    return 0 if total == 1 else 1 if total <= FANOUT else LEVELS


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
    for _, block in itertools.groupby(rows, lambda r: (r["grp"], r["block"])):
        yield list(block)


def _matrix(rows: list[dict]) -> np.ndarray:
    return np.frombuffer("".join(r["digest"] for r in rows).encode(), np.uint8).reshape(-1, 64)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    own = nodes.withColumn("block", F.expr(f"index div {BLOCK}"))
    return own.repartition("grp", "block").sortWithinPartitions("grp", "block", "index")


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for rows in _sections(batches):
        total = rows[0]["total"]
        top = tree(_matrix(rows), levels_of(total))[-1]
        out.append({"grp": rows[0]["grp"], "index": rows[0]["block"], "total": -(-total // BLOCK), "digest": top[0].tobytes().decode()})
        if len(out) == 4096:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of (grp, index, total, digest), ``nodes`` first; each round holds the block tops of the one before it.

    A group is done in the round where its total is 1, and isn't in later ones.
    """
    rounds = [nodes]
    while len(rounds) == 1 or not rounds[-1].where("total > 1").isEmpty():
        below = rounds[-1] if len(rounds) == 1 else rounds[-1].where("total > 1")
        rounds.append(written(_in_blocks(below.select("grp", "index", "total", "digest")).mapInArrow(_tops, _NODE), "block-tops"))
    return rounds


def _paths(extra: list[str]) -> Callable:
    """Of the sections' nodes: the proof up to their block's top, then the proof that stands before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for head, *rows in _sections(batches):
            nodes = tree(_matrix(rows), levels_of(rows[0]["total"]))
            for i, r in enumerate(rows):
                path = [{"at": at, "others": others.decode()} for at, others in beside(nodes, i)] + head["path"]
                out.append({c: r[c] for c in extra} | {"grp": r["grp"], "index": r["index"], "digest": r["digest"], "subroot": head["subroot"], "path": path})
                size += sum(len(x["others"]) for x in path)
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        settle()

    schema = pa.schema([*[(c, pa.string()) for c in extra], ("grp", pa.string()), ("index", pa.int64()), ("digest", pa.string()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())])))])
    return run


def descend(rounds: list[DataFrame], ends: DataFrame, extra: list[str]) -> DataFrame:
    """(*extra, grp, index, digest, subroot, path) of the first round's nodes; ``extra`` are text columns of theirs.

    ``ends``: (grp, subroot, path) of each group's last node.
    """
    above = None
    for k in range(len(rounds) - 2, -1, -1):
        done = rounds[k + 1].where("total = 1").join(ends, "grp").select("grp", F.col("index").alias("block"), "subroot", "path")
        head = done if above is None else done.unionByName(above.select("grp", F.col("index").alias("block"), "subroot", "path"))
        nodes = rounds[k].where("total > 1") if k else rounds[k]
        own = extra if k == 0 else []
        nodes = nodes.select(*own, "grp", "index", "total", "digest", F.expr(f"index div {BLOCK}").alias("block"))
        both = nodes.unionByName(head.withColumn("index", F.lit(-1).cast("long")), allowMissingColumns=True)
        both = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "index")
        out = both.mapInArrow(_paths(own), "".join(f"{c} string, " for c in own) + f"grp string, index long, digest string, subroot string, path {PATH}")
        above = written(out, "proofs") if k else out
    return above


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each group of a sorted range, from 0."""
    last, n = None, 0
    for batch in batches:
        groups, at = batch.column("grp").to_pylist(), []
        for g in groups:
            n = n + 1 if g == last else 0
            last = g
            at.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with grp) with ``index``, their place in the order within their group, from 0, and ``total``, its rows."""
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt.mapInArrow(_count_on, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", at long"), "ranges")
    counts = dealt.groupBy("grp", "range").agg(F.count("*").alias("n"))  # as many rows as ranges and groups
    before = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("grp", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    out = written(dealt.join(starts, ["grp", "range"]).withColumn("index", F.col("before") + F.col("at")).drop("range", "at", "before"), "numbered")
    discard(dealt)
    return out


def manifest(docs: DataFrame, columns: list[str], group: str = "source", key: str = "doc_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, *extra, leaf, subroot, root, path): every row with its digests and the nodes beside its way to the root.

    ``path``: for each level from the leaf up, ``others``, the run's other nodes from left to right as one text, and ``at``, how
    many of them stand left of the row's own; ``fold`` climbs it. ``extra``: text columns over ``docs`` to carry along.
    """
    extra = extra or {}
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),  # "" for null: first in order
        F.col(key).alias("key"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"), *[v.alias(f"x{i}") for i, v in enumerate(extra.values())],
    )
    leaves = written(own.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    kind = leaves.schema["key"].dataType
    placed = numbered(leaves, ["key", "digest", "nth"]).withColumn("key", F.col("key").cast("string")).drop("nth")
    discard(leaves)
    rounds = climb(placed)
    subroots = reduce(DataFrame.unionByName, [r.where("total = 1") for r in rounds[1:]]).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    upper = climb(numbered(subroots, ["name"]))
    root = upper[-1].select("grp", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    ends = descend(upper, root, ["name"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("path"), F.col("subroot").alias("root"))
    ends = written(ends, "subroot-proofs")
    one = ends.select("root").head()
    proofs = descend(rounds, ends.select("grp", "subroot", "path"), ["key", *[f"x{i}" for i in range(len(extra))]])
    named = F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(group)
    return proofs.select(F.col("key").cast(kind).alias(key), named, *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra)], F.col("digest").alias("leaf"), "subroot", F.lit(one["root"] if one else None).cast("string").alias("root"), "path")
