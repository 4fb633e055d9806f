"""Exact set-similarity self-join of word n-grams, in size-banded tiles with hashed bitmap signatures.

Sizes fall into bands such that linked sets lie in one band or in neighbours. Tile j holds the pairs whose smaller set
is in band j; they differ in at most D shingles, so if each set is cut by hash into more than D parts, linked sets agree
in one. A set sends one key for each non-empty part (all parts where fewer than D + 1 are non-empty) to its tiles, and
only sets that meet on a key are compared. Before the exact intersection of sorted hash arrays, bitmap signatures bound
the overlap from above: bits that one set has and the other lacks are shingles that they don't share.

Exact copies are one node from the start. Large groups of near copies are not paired off: a first pass compares each
node with one centre, links join into components, a second pass compares the nodes of keys that still span components
with two centres of each key, and only pairs of such keys that remain across components are compared through their
bitmaps, tile by tile.
Pairs within one component need no comparison, since a component is what is asked for; no link between components is lost.

Shingles are 64-bit hashes. Null, empty and wordless texts have the empty set and link with nothing. Fewer words than a
shingle make one shingle of all of them. Repeated rows and ids keep their rows; a null id is never a component's id
unless its set has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import discard, written
from lodestone.llm._text import SPACED, Words, blocks, grams, mix64, settle
from lodestone.operators.graph import components

#: Words of a shingle and the least similarity, as a fraction, unless a caller says otherwise.
SHINGLE, LEAST = 5, (80, 100)
#: Address bits of the largest bitmap of wanted documents (16 MiB).
MAX_BITS = 27
#: Nodes of a block of a key, rows of a part of a centre, and pairs that a task remembers.
TILE, PART, HELD = 1024, 1 << 14, 1 << 18
#: Bits of a bitmap for each shingle of the largest set in its band, and the largest bitmap.
BITMAP_LOAD, BITMAP_MAX = 4, 1 << 17


class Bands:
    """Size bands for one least similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, size: int) -> int:
        self.grow(size)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def tiles(self, size: int) -> list[int]:
        """Tiles that a set of this size takes part in: as a smaller set, and as a larger one."""
        i = self.of(size)
        return [i] if i == 0 or size > (self.low[i] - 1) * self.den // self.num else [i, i - 1]

    def differ(self, tile: int) -> int:
        """Most shingles in which a linked pair of the tile differs."""
        while len(self.low) < tile + 2:
            self.grow(self.low[-1])
        top = self.low[tile + 1] - 1
        return (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def parts(self, tile: int) -> int:
        d = self.differ(tile)
        return d + 1 + (d + 7) // 8

    def bits(self, size: int) -> int:
        self.grow(size)
        top = self.low[self.of(size) + 1]
        return int(min(BITMAP_MAX, max(64, 1 << (BITMAP_LOAD * top - 1).bit_length())))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, SPACED)
    g = grams(words.hashes, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= k:
            own = np.sort(g[a : b - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(grams(words.hashes[a:b], b - a) if b > a else g[:0])
    return out


def set_digest(own: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.bitwise_xor.reduce(mix64(own + np.uint64(0x5851F42D4C957F2D))) ^ (own.sum(dtype=np.uint64) * np.uint64(0x14057B7EF767814F))
    return int(mix64(np.array([total + np.uint64(len(own))]))[0].view(np.int64))


def set_keys(own: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set in all its tiles."""
    out = []
    salted = mix64(own ^ np.uint64(0x2545F4914F6CDD1D))
    for tile in bands.tiles(len(own)):
        parts = bands.parts(tile)
        cuts = -(-(np.arange(parts, dtype=np.int64) << 32) // parts)
        at = np.append(np.searchsorted(own, cuts.astype(np.uint64) << np.uint64(32)), len(own))
        full = np.flatnonzero(at[1:] > at[:-1])
        with np.errstate(over="ignore"):
            sums = np.zeros(parts, dtype=np.uint64)
            sums[full] = np.add.reduceat(salted, at[full])
            which = full if len(full) > bands.differ(tile) else np.arange(parts)
            out.append(mix64(sums[which] * np.uint64(0x9E3779B97F4A7C15) ^ mix64((which.astype(np.uint64) << np.uint64(20)) + np.uint64(tile))))
    return np.concatenate(out)


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits as uint64 words, from the low bits of the hashes; halves of a longer map OR to a shorter one."""
    set_at = np.zeros(bits, dtype=bool)
    set_at[own & np.uint64(bits - 1)] = True
    return np.packbits(set_at, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def needed(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int):
    """Least overlap of linked sets of sizes a and b: den * o >= num * (a + b - o)."""
    return -(-(num * (a + b)) // (num + den))


def may_link(one: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether bit counts leave room for the needed overlap."""
    bound = np.minimum(n - np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64))
    return bound >= needed(n, sizes, num, den)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """The exact test on sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) >= needed(len(a), len(b), num, den)


def _key(id_col: str, text_col: str, docs: DataFrame) -> Column:
    """A long that finds a document again: its id, or a hash where the id is another type or null."""
    own = F.col(id_col) if docs.schema[id_col].dataType.simpleString() in ("bigint", "int") else F.xxhash64(id_col)
    return F.coalesce(F.when(F.col(id_col).isNotNull(), own.cast("long")), F.xxhash64(text_col))


def _members(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, __key, n, node) of each row."""
    picked = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id"), _key(id_col, text_col, docs).alias("__key"))
    schema = f"__id {picked.schema['__id'].dataType.simpleString()}, __key long, n long, node long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "__text"):
            sets = shingle_sets(data, offsets, k)
            nodes = pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), nodes], names=["__id", "__key", "n", "node"])
        settle()

    return picked.mapInArrow(run, schema)


def _keys(docs: DataFrame, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(key, node): each set once in a task, so copies don't multiply keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for _, data, offsets in blocks(batches, "__text"):
            keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for own in shingle_sets(data, offsets, k):
                if len(own) and (node := set_digest(own)) not in seen:
                    seen.add(node)
                    keys.append(set_keys(own, bands))
                    nodes.append(np.full(len(keys[-1]), node, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])
        settle()

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "key long, node long")


def _met(keys: DataFrame) -> DataFrame:
    """(key, node, centre) of keys that at least two nodes have; the centre is a node that a hash picks.

    Rows arrive sorted by key and stream through, so a key with any number of nodes takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, node, centre, whether its row is out) of the row before this batch
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if last is not None:
                key, node = np.append(last[0], key), np.append(last[1], node)
            new_key = np.append(True, key[1:] != key[:-1])
            new_node = new_key | np.append(True, node[1:] != node[:-1])
            at = np.flatnonzero(new_key)
            centre = np.repeat(node[at], np.diff(np.append(at, len(key))))
            held = last is not None and last[3]
            if last is not None:
                run0 = int(at[1]) if len(at) > 1 else len(key)
                centre[:run0] = last[2]
            shared = node != centre  # a run's other nodes
            first = np.zeros(len(key), dtype=bool)
            some = np.logical_or.reduceat(shared, at)
            first[at] = some & (node[at] == centre[at])
            out = (shared & new_node) | first
            if last is not None:
                if shared[0]:
                    out[0] = False
                if held:
                    out[0] = False
                elif not shared[0] and node[0] == centre[0]:
                    out[0] = some[0]
            run_at = int(at[-1])
            is_out = bool(some[-1]) or (held and run_at == 0)
            last = (key[-1], node[-1], centre[-1], is_out)
            if node[-1] == centre[-1] and not some[-1]:
                last = (key[-1], node[-1], centre[-1], held if run_at == 0 else False)
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out]), pa.array(centre[out])], names=["key", "node", "centre"])

    ordered = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("node"), "node")
    return ordered.mapInArrow(run, "key long, node long, centre long")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int, bands: Bands, maps: bool) -> DataFrame:
    """(node, n, bits binary) or, without ``maps``, (node, hashes binary) of the wanted (node, __key).

    A bitmap of the wanted keys, of bounded size, goes to all tasks; sets of documents that pass it are made where the
    text is read, so no text is shuffled, and the join drops what the bitmap let through.
    """
    n = wanted.count()
    bits = int(min(MAX_BITS, max(12, np.ceil(np.log2(32 * max(n, 1))))))
    at = F.shiftrightunsigned(F.xxhash64("__key"), 64 - bits).alias("at")
    cells = wanted.select(at).groupBy(F.shiftrightunsigned("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    got = cells.toArrow()  # at most 2 ** (MAX_BITS - 6) rows
    filled = np.zeros(1 << (bits - 6), dtype=np.uint64)
    filled[got.column("cell").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    key = _key(id_col, text_col, docs).alias("__key")
    picked = docs.select(F.col(text_col).alias("__text"), key).select("__text", "__key", F.shiftrightunsigned(F.xxhash64("__key"), 64 - bits).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy().astype(np.uint64)
                yield batch.filter(pa.array((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1))

        for part, data, offsets in blocks(passing(), "__text"):
            sets = shingle_sets(data, offsets, k)
            ok = [i for i, s in enumerate(sets) if len(s)]
            keys, nodes = part.column(1).take(pa.array(ok, pa.int64())), pa.array([set_digest(sets[i]) for i in ok], pa.int64())
            if maps:
                columns = {"n": pa.array([len(sets[i]) for i in ok], pa.int64()), "bits": pa.array([bitmap(sets[i], bands.bits(len(sets[i]))).tobytes() for i in ok], pa.binary())}
            else:
                columns = {"hashes": pa.array([sets[i].tobytes() for i in ok], pa.binary())}
            yield pa.RecordBatch.from_arrays([keys, nodes, *columns.values()], names=["__key", "node", *columns])
        settle()

    made = picked.mapInArrow(run, "__key long, node long, " + ("n long, bits binary" if maps else "hashes binary"))
    own = made.join(wanted.select("__key", "node"), ["__key", "node"], "left_semi")
    return own.dropDuplicates(["__key", "node"]).drop("__key")  # a repeated row; the join has dealt by these columns


def _both(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with the table's columns of both."""
    names = table.columns[1:]
    left = table.select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = table.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", *[f"{x}_{c}" for x in "ab" for c in names])


def _bounded(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose bitmaps leave room for the needed overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, p, m, q in zip(*(c.to_pylist() for c in batch.columns[2:])):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                size = min(len(p), len(q))
                ok.append(bool(may_link(fold(p, size), fold(q, size)[None], n, np.array([m]), num, den)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        settle()

    return _both(pairs, maps).mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), num, den) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        settle()

    return _both(pairs, sets).mapInArrow(run, "a long, b long")


def _dealt(rest: DataFrame) -> DataFrame:
    """Rows (key, centre, node, component) with the tile (lo, hi) of blocks of their key, their own block and a part of the centre.

    A key's nodes fall into blocks of about ``TILE``, and a tile compares two of them; so a key with any number of nodes takes
    tasks of one size, and so does a centre with any number of keys.
    """
    sizes = rest.groupBy("key").agg(F.first("centre").alias("c"), F.count("*").alias("n"))
    load = sizes.groupBy("c").agg(F.ceil(F.sum(F.col("n") * F.ceil(F.col("n") / TILE)) / PART).alias("parts"))
    sizes = sizes.join(load, "c").select("key", F.ceil(F.col("n") / TILE).alias("blocks"), "parts")
    rows = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return rows.select("key", "lo", "hi", "centre", F.pmod(F.xxhash64("key", "lo", "hi"), "parts").alias("part"), "block", "node", "component")


def _across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of a tile's nodes in different components that their bitmaps let pass.

    Rows (key, lo, hi, centre, part, block, node, component, n, bits) arrive sorted; a tile's rows are held (some hundred
    bytes each). Similar sets share many keys, and these mostly have one centre: a pair goes out once for all tiles of
    a centre's part, as far as ``HELD`` pairs can be remembered.
    """

    def tile(rows, blocks, nodes, parts, sizes, maps):
        width = min(map(len, maps))
        maps = np.stack([fold(m, width) for m in maps])
        across = rows[0][1] != rows[0][2]
        for i in range(len(nodes) - 1):
            later = parts[i + 1 :] != parts[i]
            rest = i + 1 + np.flatnonzero(later & (blocks[i + 1 :] != blocks[i]) if across else later)
            rest = rest[may_link(maps[i], maps[rest], sizes[i], sizes[rest], num, den)] if len(rest) else rest
            if len(rest):
                yield np.full(len(rest), nodes[i]), nodes[rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out: set[tuple[int, int]] = set()

        def flush():
            if len(held) > 1:
                columns = [np.array([h[i] for h in held]) for i in (5, 6, 7, 8)]
                for a, b in tile(held, *columns, [np.frombuffer(h[9], np.uint64) for h in held]):
                    fresh = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) - out
                    if fresh:
                        if len(out) > HELD:
                            out.clear()
                        out.update(fresh)
                        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in fresh], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:3] != row[:3]:
                    yield from flush()
                    if held[-1][3:5] != row[3:5]:
                        out.clear()
                    held = []
                held.append(row)
        yield from flush()
        settle()

    ordered = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "key", "lo", "hi")
    return ordered.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, n_shingles, component_id) for each row: component_id is the least id that links reach."""
    num, den = least
    bands = Bands(num, den)
    members = written(_members(docs, id_col, text_col, shingle), "members")
    met = written(_met(_keys(docs, text_col, shingle, num, den)), "met-keys")
    wanted = members.where("n > 0").groupBy("node").agg(F.min("__key").alias("__key"))
    wanted = written(wanted.join(met.select("node").distinct(), "node"), "wanted")
    maps = written(_sets_of(docs, wanted, id_col, text_col, shingle, bands, True), "maps")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among the pairs: bitmaps bound the overlap, and sets are made for those alone that they let pass."""
        pairs = written(_bounded(pairs, maps, num, den), f"{name}-bounded")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = written(_sets_of(docs, wanted.join(nodes, "node", "left_semi"), id_col, text_col, shingle, bands, False), "sets")
        links = written(_exact(pairs, sets, num, den), name)
        discard(pairs, sets)
        return links

    def spanning(groups: DataFrame) -> DataFrame:
        """Rows of keys whose nodes are in more than one component, with the component."""
        named = met.join(groups.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("key", "node", "centre", F.coalesce("component", "node").alias("component"))
        named = named.repartition("key")  # one exchange serves the aggregate and the join
        open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return written(named.join(open_keys, "key"), "spanning")

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # first one centre for each node, which joins most of what belongs together
    one = met.where("node <> centre").groupBy("node").agg(F.min("centre").alias("centre"))
    found = [verified(one.select(*pair("node", "centre")).distinct(), "star")]
    links = found[0]
    rest = spanning(components(links))
    if not rest.isEmpty():
        # then, for keys that still span components, their centre and another one
        home = rest.groupBy("key").agg(F.max(F.struct(F.xxhash64("node"), F.col("node").alias("node"), F.col("component").alias("component"))).alias("top"), F.min(F.when(F.col("node") == F.col("centre"), F.col("component"))).alias("component1"))
        home = home.select("key", "component1", F.col("top.node").alias("centre2"), F.col("top.component").alias("component2"))
        both = rest.join(home, "key")
        again = both.where("component <> component1").select(*pair("node", "centre")).unionByName(both.where("component <> component2").select(*pair("node", "centre2"))).distinct()
        done = one.select(*pair("node", "centre")).distinct()
        found.append(verified(again.join(done, ["a", "b"], "left_anti"), "second"))
        links = links.unionByName(found[-1])
        discard(rest)
        rest = spanning(components(links))
        if not rest.isEmpty():
            names = ("key", "lo", "hi", "centre", "part", "block", "node", "component", "n", "bits")
            open_rows = _dealt(rest.select("key", "centre", "node", "component")).join(maps, "node").select(*names)
            found.append(verified(_across(open_rows, num, den).distinct(), "across"))
            links = links.unionByName(found[-1])
    discard(rest, met, maps, wanted)
    groups = components(links).withColumnRenamed("node", "node_")
    discard(*found)
    named = members.where("n > 0").join(groups, F.col("node") == F.col("node_"), "left").select("__id", "n", F.coalesce("component", "node").alias("c"))
    first = named.groupBy("c").agg(F.min("__id").alias("component_id")).withColumnRenamed("c", "c_")
    out = named.join(first, F.col("c") == F.col("c_")).select("__id", "n", "component_id")
    alone = members.where("n = 0").select("__id", "n", F.col("__id").alias("component_id"))
    return out.unionByName(alone).select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
