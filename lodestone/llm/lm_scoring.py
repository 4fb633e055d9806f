"""Language-model scoring by online logistic context mixing.

A text is its words, A-Z lower-cased, each followed by a blank, and one end mark. Every byte of that stream is coded as
the bits of a Huffman code (one for each byte before it), and each bit is predicted by tables of bit counts that hashed
contexts address: the last two bytes, the last four, and the word so far. Their predictions meet in the logistic domain,
under weights that a gate selects by how much the longer contexts have seen. Along a text the weights are refined from the
coding errors, first after ``FIRST`` symbols and then at doubling distances up to ``CHUNK``. Every text starts from the same
weights, so its score doesn't depend on where it is processed.

Tables of a fixed size can't remember passages, so the corpus also gives the counts of its segments: runs of words that
end where a hash of two words says so, ``SEGMENT`` words long on average. A segment's probability is the mixture of what
its bits give and of its share of all segments; a text's own occurrences, where it was learned from, don't count.

Learning covers every training text: counts of words, segments, byte values and bits are summed by grouped aggregation.
The bit tables have a fixed number of slots; word and segment counts grow with the corpus: those of the most frequent
(at most ``TOP_WORDS`` and ``TOP_SEGMENTS``) travel to the executors, all others meet theirs in one shuffled join.

A null text is empty: it has the end token alone. Words and segments are 64-bit hashes. Without training texts counts
are 0, tables predict evenly, and scores are those of the untrained code. Repeated rows are scored row by row; ``keep``
names any columns, also those that the result has itself only if they are left out of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import written
from lodestone.llm._text import SPACED, Words, blocks, hold, mix64, settle

#: Address bits of each context's table.
SLOT_BITS = (21, 22, 22)
#: Slots that one context has, as a power of two: the bits of a symbol read neighbouring slots.
ROW_BITS = (8, 4, 4)
#: Most words and segments whose counts are sent to every executor (12 bytes each).
TOP_WORDS, TOP_SEGMENTS = 1 << 20, 1 << 18
#: Words of a segment on average (a power of two), and the prior share of segments in the mixture.
SEGMENT, REPEATED = 32, 1 / 16
#: Symbols of the first chunk and of the longest; the weights are refined after each chunk.
FIRST, CHUNK = 16, 2048
#: Step of a refinement, and the bits of a gate that make it a full one.
STEP, FULL = 1.0, 48
#: Weights before refinement: of four bytes and of the word so far where they have seen enough, of two bytes where neither
#: has, of two bytes always; and the confidence that is enough.
START = (0.6, 0.45, 0.6, 0.1, 4)
#: Symbols that are handled at once, and bytes of text.
BATCH, BLOCK = 1 << 15, 1 << 18
#: Counts, or symbols, that a task holds before it passes them on or adds them up, and entries of the bit tables in one row of the shuffle.
HELD, PIECE = 1 << 20, 1 << 12
#: Tasks a core that count bits, each with tables of its own.
TASKS = 4

_CONTEXTS, _GATES, _END = len(SLOT_BITS), 64, 10
#: The hash that the end token is counted under.
END_HASH = np.uint64(1)
_WORD, _BYTE, _SEGMENT = range(3)  # kinds of counts


@dataclass
class Code:
    """Huffman codes of the 256 byte values after each byte value: at 256 * byte before + byte, inner nodes and bits from the root."""

    length: np.ndarray
    begin: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray  # -1 and 1


def _tree(histogram: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Of each value the length of its code, and of all codes nodes and bits; ties break by value."""
    heap = [(float(histogram[i]), i, i) for i in range(256)]
    heapq.heapify(heap)
    parent, inner = {}, 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (inner, 0), (inner, 1)
        heapq.heappush(heap, (a + b, inner, inner))
        inner += 1
    length, nodes, bits = [], [], []
    for i in range(256):
        way, at = [], i
        while at in parent:
            at, bit = parent[at]
            way.append((at - 256, bit))
        length.append(len(way))
        nodes += [n for n, _ in reversed(way)]
        bits += [b for _, b in reversed(way)]
    return length, nodes, bits


def huffman(pairs: np.ndarray) -> Code:
    """From counts (256, 256) of bytes after bytes; every value gets a code after every other."""
    every = pairs.sum(axis=0) + 1e-3
    every /= every.sum()
    seen = np.flatnonzero(pairs.sum(axis=1))
    trees = [_tree(every), *(_tree(pairs[p] + every) for p in seen)]
    which = np.zeros(256, dtype=np.int64)
    which[seen] = 1 + np.arange(len(seen))
    length = np.array([t[0] for t in trees], dtype=np.int32)
    begin = (np.cumsum(length) - length.ravel()).reshape(length.shape).astype(np.int32)
    nodes, bits = (np.concatenate([np.array(t[k]) for t in trees]) for k in (1, 2))
    return Code(length[which].ravel().astype(np.int64), begin[which].ravel().astype(np.int64), nodes.astype(np.uint32), (2 * bits - 1).astype(np.float32))


def streams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text, one after another, and their bounds (n + 1)."""
    sizes = words.ends - words.starts + 1
    upto = np.append(0, np.cumsum(sizes))
    ends = np.arange(n + 1)
    bounds = upto[words.bounds] + ends
    out = np.full(int(bounds[-1]), 32, dtype=np.uint8)
    text = np.repeat(np.arange(n), np.diff(words.bounds))
    shift = np.repeat(upto[:-1] + text - words.starts, sizes - 1)
    at = np.repeat(words.starts - np.append(0, np.cumsum(sizes - 1))[:-1], sizes - 1) + np.arange(len(shift))
    out[at + shift] = words.low[at]
    out[bounds[1:] - 1] = _END
    return out, bounds


#: Of the eight bytes before a symbol, the last k.
_LAST = np.array([(0xFFFFFFFFFFFFFFFF << 8 * (8 - k)) & 0xFFFFFFFFFFFFFFFF if k else 0 for k in range(9)], dtype=np.uint64)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_SPREAD = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1)]


def contexts(symbols: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """uint32 context hashes before each symbol; nothing before a text's start counts, and of a word the last eight bytes."""
    n = len(symbols)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[8:] = symbols
    if not n:
        return [np.zeros(0, np.uint32)] * _CONTEXTS
    before = np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,))
    opens = np.append(True, (symbols[:-1] == 32) | (symbols[:-1] == _END))
    starts = np.flatnonzero(opens)
    inside = np.minimum(np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))), 8)
    found = [(before >> np.uint64(48)).astype(np.uint32), (before >> np.uint64(32)).astype(np.uint32)]
    for k in range(4):  # what lies before a text's start
        at = bounds[:-1] + k
        at = at[at < bounds[1:]]
        for x, size in zip(found, (2, 4)):
            if k < size:
                x[at] &= np.uint32((0xFFFFFFFF << 8 * (size - k)) & ((1 << 8 * size) - 1))
    with np.errstate(over="ignore"):
        word = ((before & _LAST[inside]) + inside.astype(np.uint64)) * _SALTS[0]
        found.append((word >> np.uint64(32)).astype(np.uint32))
        for k, (x, bits, row) in enumerate(zip(found, SLOT_BITS, ROW_BITS)):
            x ^= x >> np.uint32(15)
            x *= _SPREAD[k]
            x >>= np.uint32(32 - bits + row)
            x <<= np.uint32(row)
    return found


def paired(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each symbol with the one before it, as the code takes them; a text starts after an end mark."""
    out = symbols.astype(np.int64)
    out[1:] |= symbols[:-1].astype(np.int64) << 8
    out[bounds[:-1]] = symbols[bounds[:-1]].astype(np.int64) | _END << 8
    return out


def spread(pairs: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bit its place in the code and its symbol, and how many bits there are up to each symbol's end."""
    length = code.length.take(pairs)
    upto = np.cumsum(length)
    n = int(upto[-1]) if len(upto) else 0
    symbol, at = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    if n:
        begin = code.begin.take(pairs)
        symbol[upto[:-1]] = 1
        at[0] = begin[0]
        at[upto[:-1]] = begin[1:] - begin[:-1] - length[:-1] + 1
    np.cumsum(symbol, out=symbol)  # of each bit: faster than to repeat what belongs to its symbol
    return np.cumsum(at, out=at), symbol, upto


def _within(node: np.ndarray, row: int) -> np.ndarray:
    """Where a node lies in a row of 2 ** row slots."""
    return node if row == 8 else node * np.uint32(0x9E3779B1) >> np.uint32(32 - row)


def expand(pairs: np.ndarray, ctx: list[np.ndarray], code: Code, rows: tuple[int, ...] = ROW_BITS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each bit its place in the code, its symbol, and its slot in each table."""
    at, symbol, _ = spread(pairs, code)
    node = code.nodes.take(at)
    within = {row: _within(node, row) for row in set(rows)}
    slots = []
    for c, row in zip(ctx, rows):
        h = c.take(symbol)
        h |= within[row]
        slots.append(h)
    return at, symbol, slots


def look_up(tables: list[np.ndarray], ctx: list[np.ndarray], symbol: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Of each bit its entry in each table, as at the slots of ``expand``; a symbol's short row is fetched once for all its bits."""
    out, places = [], {}
    for table, c, row in zip(tables, ctx, ROW_BITS):
        if row > 5:
            slot = c.take(symbol)
            slot |= node
            out.append(table.take(slot))
            continue
        if row not in places:
            places[row] = symbol << row
            places[row] |= _within(node, row)
        out.append(table.reshape(-1, 1 << row).take(c >> np.uint32(row), axis=0).reshape(-1).take(places[row]))
    return out


def _confidence(n: np.ndarray) -> np.ndarray:
    """0 to 7: how much a slot has seen."""
    return np.searchsorted(np.array([1, 2, 4, 10, 32, 128, 1024]), n, side="right").astype(np.int16)


def pack_table(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """int16 entries: 256 times the log odds, shifted over three bits of confidence."""
    n = zeros + ones
    odds = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -7.9, 7.9)
    return (np.round(odds * 256).astype(np.int16) << 3) | _confidence(n)


def chunks(longest: int) -> list[int]:
    """Bounds of the chunks of a text: ``FIRST`` symbols, then twice as many each time, up to ``CHUNK``."""
    out, size = [0], FIRST
    while out[-1] < longest:
        out.append(out[-1] + size)
        size = min(2 * size, CHUNK)
    return out


def start_weights() -> np.ndarray:
    """(contexts, gates) before anything is refined: the longer context leads as far as it has seen enough."""
    w = np.zeros((_CONTEXTS, _GATES), dtype=np.float32)
    seen4, seenw = (np.minimum(x / START[4], 1) for x in (np.arange(_GATES) >> 3, np.arange(_GATES) & 7))
    w[1] = START[0] * seen4
    w[2] = START[1] * seenw
    w[0] = START[2] * (1 - seen4) * (1 - seenw) + START[3]
    return w


@dataclass
class Top:
    """The most frequent words or segments: sorted hashes, their counts, and where each bucket of leading bits starts."""

    keys: np.ndarray
    counts: np.ndarray
    bits: int
    cuts: np.ndarray


def make_top(keys: np.ndarray, counts: np.ndarray) -> Top:
    bits = max(1, len(keys).bit_length())
    starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return Top(keys, counts, bits, np.append(starts, len(keys)).astype(np.int64))


@dataclass
class MixModel:
    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray  # (contexts, gates): where every text starts
    top: dict[int, Top]  # by kind
    n: int  # training tokens
    v: int  # distinct training tokens
    n_end: int  # training texts
    n_segments: int

    def nats(self, pairs: np.ndarray, bounds: np.ndarray, ctx: list[np.ndarray]) -> np.ndarray:
        """Nats that each symbol takes. Texts go side by side, chunk by chunk, each under weights of its own, the longest first."""
        sizes = np.diff(bounds)
        out = np.zeros(len(pairs))
        own = np.repeat(self.weights[:, None, :], len(sizes), axis=1).reshape(_CONTEXTS, -1)
        marks = chunks(int(sizes.max(initial=0)))
        order = np.argsort(-sizes, kind="stable")
        for a, b in zip(marks[:-1], marks[1:]):
            order = order[sizes[order] > a]
            here = np.minimum(sizes[order], b) - a
            cuts = np.flatnonzero(np.diff((np.cumsum(here) - here) // BATCH)) + 1
            more = int(np.count_nonzero(sizes[order] > b))
            for first, texts, n in zip(np.append(0, cuts).tolist(), np.split(order, cuts), np.split(here, cuts)):
                at = np.repeat(bounds[texts] + a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                weights = own[:, first * _GATES : (first + len(texts)) * _GATES]
                out[at] = self._chunk(pairs.take(at), [c.take(at) for c in ctx], n, weights, min(max(more - first, 0), len(texts)))
        return out

    def _chunk(self, pairs: np.ndarray, ctx: list[np.ndarray], n: np.ndarray, own: np.ndarray, more: int) -> np.ndarray:
        """Nats of each symbol of one chunk of each text (``n`` symbols); refines the texts' weights in ``own``, those of the first
        ``more`` texts: the others end here."""
        bits, symbol, upto = spread(pairs, self.code)
        seen = look_up(self.tables, ctx, symbol, self.code.nodes.take(bits))
        ends = upto[np.cumsum(n) - 1]
        each = np.diff(ends, prepend=0)
        gate = ((seen[1] & 7) << 3 | (seen[2] & 7)).astype(np.int64)
        gate += np.repeat(np.arange(len(n)) * _GATES, each)
        odds = [(s >> 3).astype(np.float32) for s in seen]  # in 256ths; so are the weights of this chunk
        x: np.ndarray | None = None
        for w, o in zip(own * np.float32(1 / 256), odds):
            w = w.take(gate)
            w *= o
            x = w if x is None else np.add(x, w, out=x)
        np.clip(x, -12, 12, out=x)
        sign = self.code.signs.take(bits)
        x *= sign
        np.negative(x, out=x)
        e = np.exp(x, out=x)  # the odds against the bit that came
        total = e + 1
        spent = np.log(total)
        if more:
            upto, gates = int(ends[more - 1]), more * _GATES
            gate = gate[:upto]
            error = e[:upto] / total[:upto]
            error *= sign[:upto]
            step = STEP / 256 / np.maximum(np.bincount(gate, minlength=gates), FULL)
            for w, o in zip(own, odds):
                w[:gates] += (step * np.bincount(gate, weights=error * o[:upto], minlength=gates)).astype(np.float32)
        return np.bincount(symbol, weights=spent, minlength=len(pairs))


def segments(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds in symbols of each segment, texts' bounds in segments) of a block of n texts; every text ends one."""
    token = np.repeat(np.arange(n), np.diff(words.bounds)) + np.arange(len(words))
    ends = words.bounds[1:] + np.arange(n)
    hashes = np.full(len(words) + n, END_HASH, dtype=np.uint64)
    hashes[token] = words.hashes
    sizes = np.ones(len(hashes), dtype=np.int64)
    sizes[token] = words.ends - words.starts + 1
    with np.errstate(over="ignore"):
        pair = mix64(words.hashes * _SALTS[0] + np.append(np.zeros(1, np.uint64), words.hashes[:-1])[: len(words)])
        pair[words.bounds[:-1][np.diff(words.bounds) > 0]] = 1  # no word before: no end of a segment
        closes = np.zeros(len(hashes), dtype=bool)
        closes[token] = pair & np.uint64(SEGMENT - 1) == 0
        closes[ends] = True
        last = np.flatnonzero(closes)
        first = np.append(0, last[:-1] + 1)[: len(last)]
        place = np.arange(len(hashes)) - np.repeat(first, last + 1 - first)
        found = np.add.reduceat(mix64(hashes + (place + 1).astype(np.uint64) * _SALTS[1]), first) if len(first) else hashes
        found = mix64(found + (last + 1 - first).astype(np.uint64) * _SALTS[2])
    upto = np.append(0, np.cumsum(sizes))
    return found, upto[np.append(first, len(hashes))], np.append(0, np.searchsorted(last, ends) + 1)


def _times(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each segment occurs in its text."""
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    with np.errstate(over="ignore"):
        _, which, times = np.unique(mix64(hashes + text * _SALTS[0]), return_inverse=True, return_counts=True)
    return times[which]


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, key, c): words (the end token under ``END_HASH``), bytes after bytes, and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        held: dict[int, list] = {_WORD: [], _SEGMENT: []}
        pairs = np.zeros(65536, np.int64)

        def rows(kind: int, keys: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(c)], names=["kind", "key", "c"])

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
            return keys, np.bincount(which, weights=np.concatenate([c for _, c in held[kind]])).astype(np.int64)

        def add(kind: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
            held[kind].append(np.unique(hashes, return_counts=True))
            if sum(len(k) for k, _ in held[kind]) > HELD:
                keys, c = merged(kind)
                held[kind] = [(keys, c)]
                if len(keys) > HELD // 2:
                    yield rows(kind, keys, c)
                    held[kind] = []

        for part, data, offsets in blocks(batches, "__text", BLOCK):
            words = Words(data, offsets, SPACED)
            symbols, bounds = streams(words, part.num_rows)
            pairs += np.bincount(paired(symbols, bounds), minlength=65536)
            yield from add(_WORD, np.append(words.hashes, np.full(part.num_rows, END_HASH)))
            yield from add(_SEGMENT, segments(words, part.num_rows)[0])
        for kind in held:
            if held[kind]:
                yield rows(kind, *merged(kind))
        used = np.flatnonzero(pairs)
        yield rows(_BYTE, used, pairs[used])
        settle()

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def bit_tables(docs: DataFrame, text_col: str, code: Code) -> list[np.ndarray]:
    """Packed tables of all training texts: each task adds up its own, sends pieces, and pieces are summed by place.

    Tables are sent once a task, so there are only a few tasks a core. A piece's sum streams through sorted rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(code)
    starts = np.cumsum([0, *(2 << b for b in SLOT_BITS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        own, packer = np.zeros(starts[-1], dtype=np.int32), pa.Codec("zstd", 1)
        held: list[list[np.ndarray]] = [[] for _ in SLOT_BITS]

        def flush() -> None:
            for k, row in enumerate(ROW_BITS):
                key = np.sort(np.concatenate(held[k]))  # each context and symbol is spelt out once, with its number
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                times, key = np.diff(np.append(at, len(key))).astype(np.int32), key[at]
                bits, symbol, (slots,) = expand((key & np.uint64(0xFFFF)).astype(np.int64), [(key >> np.uint64(16)).astype(np.uint32) << np.uint32(row)], shared.value, (row,))
                slots <<= np.uint32(1)
                slots |= (shared.value.signs.take(bits) > 0).view(np.uint8)
                np.add.at(own[starts[k] : starts[k + 1]], slots, times.take(symbol))
                held[k] = []

        for part, data, offsets in blocks(batches, "__text", BLOCK):
            symbols, bounds = streams(Words(data, offsets, SPACED), part.num_rows)
            pairs = paired(symbols, bounds).astype(np.uint64)
            for k, c in enumerate(contexts(symbols, bounds)):
                held[k].append((c >> np.uint32(ROW_BITS[k])).astype(np.uint64) << np.uint64(16) | pairs)
            if sum(map(len, held[0])) >= HELD:
                flush()
        if held[0]:
            flush()
        for a in range(0, starts[-1], PIECE):
            if own[a : a + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([a // PIECE], pa.int32()), pa.array([packer.compress(own[a : a + PIECE], asbytes=True)], pa.binary())], names=["place", "piece"])
        own = None
        settle()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, packer = None, np.zeros(PIECE, dtype=np.int64), pa.Codec("zstd", 1)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pack_table(total[0::2], total[1::2]).tobytes()], pa.binary())], names=["place", "piece"])

        for batch in batches:
            for place, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if place != at:
                    if at is not None:
                        yield out()
                    at, total = place, np.zeros(PIECE, dtype=np.int64)
                total += np.frombuffer(packer.decompress(piece.as_buffer(), 4 * PIECE), dtype=np.int32)
        if at is not None:
            yield out()

    texts = docs.select(F.col(text_col).alias("__text")).coalesce(TASKS * spark.sparkContext.defaultParallelism)
    pieces = texts.mapInArrow(count, "place int, piece binary").repartition("place").sortWithinPartitions("place")
    flat = np.zeros(starts[-1] // 2, dtype=np.int16)
    for place, piece in pieces.mapInArrow(add, "place int, piece binary").collect():  # a fixed number of fixed-size rows
        flat[place * PIECE // 2 : (place + 1) * PIECE // 2] = np.frombuffer(piece, dtype=np.int16)
    return [flat[a // 2 : b // 2] for a, b in zip(starts[:-1], starts[1:])]


def _frequent(rows: DataFrame, most: int) -> tuple[Top, int]:
    """Hashes and counts of the rows that reach a power of two of counts such that at most ``most`` do; and that power."""
    power = F.floor(F.log2("c")).cast("int")
    classes = {x[0]: x[1] for x in rows.groupBy(power.alias("k")).count().collect()}  # counts fall into few powers of two
    least, held = 64, 0
    for k in sorted(classes, reverse=True):
        if held + classes[k] > most:
            break
        held, least = held + classes[k], k
    if not held:
        return make_top(np.zeros(0, np.uint64), np.zeros(0)), least
    got = rows.where(power >= least).select("key", "c").toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return make_top(keys[order], got.column("c").to_numpy()[order].astype(np.float64)), least


def fit(docs: DataFrame, text_col: str = "text") -> tuple[MixModel, DataFrame]:
    """The model, and (kind, key, c): counts of the words and segments that it doesn't carry itself."""
    counts = written(corpus_counts(docs, text_col), "corpus-counts")
    pairs = np.zeros(65536)
    for r in counts.where(F.col("kind") == _BYTE).collect():  # at most 65 536 rows
        pairs[r["key"]] = r["c"]
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("key") == int(END_HASH), F.col("c"))).alias("ends")).collect()}
    n, v, n_end = (sums[_WORD]["n"], sums[_WORD]["v"], sums[_WORD]["ends"] or 0) if _WORD in sums else (0, 0, 0)
    code = huffman(pairs.reshape(256, 256))
    top, rest = {}, F.lit(False)
    for kind, most in ((_WORD, TOP_WORDS), (_SEGMENT, TOP_SEGMENTS)):
        top[kind], least = _frequent(counts.where(F.col("kind") == kind), most)
        rest = rest | ((F.col("kind") == kind) & (F.floor(F.log2("c")) < least))
    model = MixModel(code, bit_tables(docs, text_col, code), start_weights(), top, n, v, n_end, sums[_SEGMENT]["n"] if _SEGMENT in sums else 0)
    return model, counts.where(rest)


def _known(top: Top, hashes: np.ndarray) -> np.ndarray:
    """Counts of the hashes that ``top`` has, else -1."""
    out = np.full(len(hashes), -1.0)
    bucket = hashes >> np.uint64(64 - top.bits)
    at, end = top.cuts[bucket], top.cuts[bucket + np.uint64(1)]
    todo = np.flatnonzero(at < end)
    while len(todo):
        here = at[todo]
        met = top.keys[here] == hashes[todo]
        out[todo[met]] = top.counts[here[met]]
        at[todo] += 1
        todo = todo[~met & (here + 1 < end[todo])]
    return out


def score(docs: DataFrame, model: MixModel, rest: DataFrame, keep: list[str], trained: Column, text_col: str = "text") -> DataFrame:
    """``keep`` and (n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row.

    ``trained``: whether the model learned from the row, so that its own segments aren't held to be repeats.
    """
    picked = docs.select(F.col(text_col).alias("__text"), F.coalesce(trained, F.lit(False)).alias("__own"), F.monotonically_increasing_id().alias("__row"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    names = picked.columns[2:]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[2:]), "n_bytes long, n_tokens long, n_top long, logs double, nats double, tail array<struct<kind: int, key: long, own: long, nats: double>>"])
    kind_of = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("own", pa.int64()), ("nats", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, at most TOP_WORDS and TOP_SEGMENTS counts
    mixed = model.n_segments > 0
    fresh = float(np.log(1 - REPEATED)) if mixed else 0.0
    share = float(np.log(REPEATED / max(model.n_segments, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        own = shared.value
        end_log = np.log10(own.n_end + 1.0)
        for part, data, offsets in blocks(batches, "__text", BLOCK):
            words = Words(data, offsets, SPACED)
            n = part.num_rows
            c = _known(own.top[_WORD], words.hashes)
            met = c >= 0
            logs = np.append(0, np.cumsum(np.where(met, np.log10(c + 1, where=met, out=np.zeros(len(c))), 0.0)))
            known = np.append(0, np.cumsum(met))
            symbols, bounds = streams(words, n)
            nats = np.append(0, np.cumsum(own.nats(paired(symbols, bounds), bounds, contexts(symbols, bounds))))
            keys, cuts, spans = segments(words, n)
            each = nats[cuts[:-1]] - nats[cuts[1:]] + fresh  # the log of what the bits give of the mixture
            again = np.where(np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(spans)), _times(keys, spans), 0)
            c = _known(own.top[_SEGMENT], keys)
            rare = c < 0
            c = c - again
            more = np.logaddexp(each, share + np.log(c, where=c > 0, out=np.full(len(c), -np.inf))) if mixed else each
            total = np.append(0, np.cumsum(np.where(rare, each, more)))[spans]
            rare &= mixed
            text = np.repeat(np.arange(n), np.diff(words.bounds))
            kinds = np.concatenate([np.full(int((~met).sum()), _WORD, np.int32), np.full(int(rare.sum()), _SEGMENT, np.int32)])
            row = np.concatenate([text[~met], np.repeat(np.arange(n), np.diff(spans))[rare]])
            order = np.argsort(row, kind="stable")
            zeros = np.zeros(len(words) - int(met.sum()))
            tail = pa.StructArray.from_arrays(
                [
                    pa.array(kinds[order]),
                    pa.array(np.concatenate([words.hashes[~met], keys[rare]])[order].view(np.int64)),
                    pa.array(np.concatenate([zeros.astype(np.int64), again[rare].astype(np.int64)])[order]),
                    pa.array(np.concatenate([zeros, each[rare]])[order]),
                ],
                fields=list(kind_of.value_type),
            )
            columns = [
                pa.array(np.diff(offsets)),
                pa.array(np.diff(words.bounds).astype(np.int64) + 1),
                pa.array(np.diff(known[words.bounds]).astype(np.int64) + (own.n_end > 0)),
                pa.array(np.diff(logs[words.bounds]) + end_log),
                pa.array(np.diff(total)),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)), tail),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *columns], names=[*names, "n_bytes", "n_tokens", "n_top", "logs", "nats", "tail"])
        settle()

    read = written(picked.mapInArrow(run, schema), "scored")
    tail = read.select("__row", F.inline("tail")).join(rest, ["kind", "key"])
    is_word, others = F.col("kind") == _WORD, F.col("c") - F.col("own")
    again = F.lit(share) + F.log(others)
    gained = F.greatest(again, "nats") + F.log1p(F.exp(-F.abs(again - F.col("nats")))) - F.col("nats")
    found = tail.groupBy("__row").agg(F.count(F.when(is_word, 1)).alias("more"), F.sum(F.when(is_word, F.log10(F.col("c") + 1))).alias("more_logs"), F.sum(F.when(~is_word & (others > 0), gained)).alias("gained"))
    out = read.drop("tail").join(found, "__row", "left")
    floor = float(np.log10(model.n + model.v + 1))
    total = (F.col("nats") + F.coalesce("gained", F.lit(0.0))) / F.lit(float(np.log(10)))
    return out.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        "n_bytes",
        "n_tokens",
        (F.col("n_top") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        total.alias("score"),
        (total * F.lit(-1 / float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
