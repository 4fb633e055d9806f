"""Benchmark decontamination by winnowing.

Documents and benchmark items are words; of every ``WINDOW`` neighbouring k-grams the least hash (the rightmost of
equals) is a fingerprint. Whatever k + WINDOW - 1 words two texts share, they share a fingerprint of it, so joining
fingerprints finds every shared span of at least that many words. Each hit is then extended word by word to both sides
and kept if the shared span is long enough. Items shorter than a span count whole: their only window is matched by its
own hash.

A bitmap of the benchmark's hashes, of a size fixed by a parameter, spares the shuffle nearly all fingerprints of clean
text; it lets through more if the benchmark outgrows it and never drops a hit. Fingerprints that pass travel with the
few words around them, so no text is shuffled.

Null or wordless texts have no words and aren't contaminated; null or wordless items match nothing. Rows that repeat
a document or an item keep their own results, and an item id counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import written
from lodestone.llm._text import ALNUM, Words, blocks, grams, settle

#: Words of a span that counts, and of a fingerprint.
SPAN, GRAM = 10, 5
#: Bits of the largest bitmap (16 MiB).
MAX_BITS = 27

_MARKS = "m int, h long, pos int, before array<string>, own string, after array<string>"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(hashes: np.ndarray, bounds: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Positions of the fingerprints of each text that lies between ``bounds`` (in words)."""
    width, n = span - gram + 1, len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = grams(hashes, gram)
    best, at = g[:n].copy(), np.arange(n)
    for s in range(1, width):
        less = g[s : s + n] <= best
        best = np.where(less, g[s : s + n], best)
        at[less] = np.flatnonzero(less) + s
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[at[text[:n] == text[span - 1 : span - 1 + n]]] = True
    return np.flatnonzero(chosen)


def _mark(words: Words, lo: int, hi: int, m: int, h: int, at: int, gram: int, span: int) -> dict:
    """A fingerprint at word ``at`` (m = 0), or a whole short window (m words), with its surroundings."""
    size, reach = (m, 0) if m else (gram, span - gram)
    strings = lambda i, j: [words.text(k, k + 1) for k in range(max(i, lo), min(j, hi))]
    return {"m": m, "h": h, "pos": at - lo, "before": strings(at - reach, at)[::-1], "own": words.text(at, at + size), "after": strings(at + size, at + size + reach)}


def _marks_of(texts: DataFrame, keys: list[str], text_col: str, short: list[int] | None, bitmap, gram: int, span: int) -> DataFrame:
    """(keys, n_words, marks). ``short`` None: an item, which is marked whole if it is shorter than a span; else lengths to look for."""
    picked = texts.select(F.col(text_col).alias("__text"), *keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:]), f"n_words long, marks array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _MARKS.split(', '))}>>"])
    kind = pa.list_(pa.struct([("m", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("before", pa.list_(pa.string())), ("own", pa.string()), ("after", pa.list_(pa.string()))]))

    def passing(h: np.ndarray, salt: int) -> np.ndarray:
        if bitmap is None:
            return np.ones(len(h), dtype=bool)
        bits, shift = bitmap.value
        at = (h ^ np.uint64(salt)) >> np.uint64(shift)
        return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "__text"):
            words = Words(data, offsets, ALNUM)
            sizes = np.diff(words.bounds)
            text = np.repeat(np.arange(len(sizes)), sizes)
            found: list[list[dict]] = [[] for _ in sizes]
            at = winnow(words.hashes, words.bounds, gram, span)
            if len(at):
                h = grams(words.hashes, gram)[at]
                ok = passing(h, 0)
                for i, x in zip(at[ok].tolist(), h[ok].view(np.int64).tolist()):
                    t = text[i]
                    found[t].append(_mark(words, words.bounds[t], words.bounds[t + 1], 0, x, i, gram, span))
            for m in sorted(set(sizes[(sizes > 0) & (sizes < span)].tolist())) if short is None else short:
                g = grams(words.hashes, m)
                ok = text[: len(g)] == text[m - 1 : m - 1 + len(g)]
                ok &= (sizes[text[: len(g)]] == m) if short is None else passing(g, m)
                for i in np.flatnonzero(ok).tolist():
                    t = text[i]
                    found[t].append(_mark(words, words.bounds[t], words.bounds[t + 1], m, int(g[i].view(np.int64)), i, gram, span))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sizes, pa.int64()), pa.array(found, kind)], names=[*keys, "n_words", "marks"])
        settle()

    return picked.mapInArrow(run, schema)


def _bitmap(marks: DataFrame):
    """A broadcast (bits, shift) of the marks' hashes; at most ``MAX_BITS`` address bits however many marks."""
    n = marks.count()
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(64 * max(n, 1))))))
    at = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.col("m").cast("long")), 64 - bits)
    cells = marks.select(at.alias("at"))
    cells = cells.groupBy(F.shiftrightunsigned("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    got = cells.toArrow()  # at most 2 ** (MAX_BITS - 6) rows
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return marks.sparkSession.sparkContext.broadcast((out, 64 - bits))


def _run_length(a: Column, b: Column) -> Column:
    """Words that two arrays share from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents (row, id, n_words) and hits (row, item, start, end), spans of words shared with an item.

    Overlapping spans of one item may come in parts; each holds at least one window of the item.
    """
    items = _marks_of(benchmark.where(F.col(item_col).isNotNull()), [item_col], item_text_col, None, None, gram, span)
    items = written(items.select(F.col(item_col).alias("item"), F.inline("marks")), "benchmark-marks")
    short = [r[0] for r in items.where("m > 0").select("m").distinct().collect()]  # fewer than ``span`` values
    rows = docs.select(F.col(id_col), F.col(text_col)).withColumn("__row", F.monotonically_increasing_id())
    read = written(_marks_of(rows, ["__row", id_col], text_col, sorted(short), _bitmap(items), gram, span), "document-marks")
    marks = read.select("__row", F.inline("marks"))
    i = items.select("item", *[F.col(c).alias(f"i_{c}") for c in ("m", "h", "before", "own", "after")])
    met = marks.join(i, (F.col("h") == F.col("i_h")) & (F.col("m") == F.col("i_m")) & (F.col("own") == F.col("i_own")))
    left, right = _run_length(F.col("before"), F.col("i_before")), _run_length(F.col("after"), F.col("i_after"))
    size = F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(gram))
    met = met.withColumns({"left": left, "right": right, "size": size}).where((F.col("m") > 0) | (F.col("left") + F.col("right") + gram >= span))
    hits = met.select("__row", "item", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("size") + F.col("right")).alias("end"))
    return read.select("__row", id_col, "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_hit, items array<string> sorted, contaminated) for each document row."""
    from pyspark.sql import Window

    rows, hits = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, span, gram)
    spans = hits.groupBy("__row", "start", "end").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    before = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    found = fresh.groupBy("__row").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = rows.join(found, "__row", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(id_col, "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))
