"""Importance resampling towards a target distribution, by hashed word n-grams.

Features are all runs of 1 to ``n`` words, joined by one space; a feature's bucket is the CRC-32 of its bytes modulo a
number. Blocks of texts are read through an integer dictionary: distinct words get ids, n-grams are tuples of ids (each a
prefix's id and a last word's), and each distinct tuple of a block is hashed once. Its bytes continue those of its prefix,
so the CRC goes on from the prefix's. Equal word hashes are confirmed by bytes. Buckets join back to occurrences by the
tuple's number: counts of buckets for the corpus and the target, then gains for each document. Both are exact integers.

A bucket's gain is floor(scale * ln((t + 1) (S + B) / ((s + 1) (T + B)))), where s of the corpus's S and t of the target's
T features are in it and B is the number of buckets. A document's weight is the sum of its features' gains; its score adds
Gumbel noise that a seed and its id fix, and the highest scores are drawn without replacement. Places in the order are
numbered range by range: a range's number is the sum of the ranges before it, so no task sees more than its range, and
ranges beyond the draw aren't sorted.

A null or wordless text has no features and weight 0. A null id counts as empty text in its noise, and comes last among
equal scores. Rows that repeat an id stand by themselves, equal ones in any order. Texts of any length are read whole.
Empty tables give empty tables; an empty target gives gains by the corpus alone. Columns of ``docs`` but id and text are
left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import discard, written
from lodestone.llm._text import ALNUM, Words, blocks, same_spans, settle

BUCKETS, NGRAM, SCALE = 10_000, 3, 1000


def dictionary(words: Words) -> tuple[np.ndarray, list[bytes]]:
    """The id of each word of the block, and the distinct words by id."""
    _, first, ids = np.unique(words.hashes, return_index=True, return_inverse=True)
    if not same_spans(words.low, words.starts, words.ends, first[ids]).all():  # two words of one hash
        spans = [words.low[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in spans], np.int64)
        return ids, list(known)
    data = words.low.tobytes()
    return ids.astype(np.int64), [data[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]


def block_features(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of 1 to ``n``: bucket of each distinct tuple, tuple of each occurrence, and the bounds of each
    text's occurrences. Tuples stay within a text."""
    words = Words(data, offsets, ALNUM)
    if not len(words):
        return
    ids, known = dictionary(words)
    size, doc = len(known), np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    crcs = list(map(zlib.crc32, known))
    after = [b" " + w for w in known]
    tuples, start = ids, np.arange(len(ids))  # of the occurrences of this length: tuple and first word
    for k in range(1, n + 1):
        if k > 1:
            inside = start + (k - 1) < len(ids)
            tuples, start = tuples[inside], start[inside]
            inside = doc[start] == doc[start + (k - 1)]
            tuples, start = tuples[inside], start[inside]
            pairs, tuples = np.unique(tuples * size + ids[start + (k - 1)], return_inverse=True)
            prefix, last = (pairs // size).tolist(), (pairs % size).tolist()
            crcs = [zlib.crc32(after[w], crcs[p]) for p, w in zip(prefix, last)]
        yield np.array(crcs, np.int64) % buckets, tuples, np.searchsorted(doc[start], np.arange(len(offsets)))


def _task_counts(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in blocks(batches, "text"):
            for bucket, tuples, _ in block_features(data, offsets, n, buckets):
                np.add.at(total, bucket, np.bincount(tuples, minlength=len(bucket)))
        settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; each task sends its sums alone."""
    counts = texts.select(F.col(text_col).alias("text")).mapInArrow(_task_counts(n, buckets), "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """The gain of each bucket, of two tables of ``bucket_counts``: as many rows as buckets at most."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for table, out in ((corpus, s), (target, t)):
        for r in table.collect():
            out[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(scale * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def _weights(gain: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "text"):
            weight, n_features, n_words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for k, (bucket, tuples, bounds) in enumerate(block_features(data, offsets, n, len(gain))):
                upto = np.concatenate([[0], np.cumsum(gain[bucket][tuples])])
                weight += np.diff(upto[bounds])
                n_features += np.diff(bounds)
                n_words = n_words if k else np.diff(bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n_words, n_features, weight))], names=["id", "n_words", "n_features", "weight"])
        settle()

    return run


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_weights(gain, n), f"id {own.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, first: int) -> DataFrame:
    """The first ``first`` rows of an order without ties, with their rank (1, 2, ...): numbered range by range."""
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("range").count().select("range", before.alias("before")).where(F.col("before") < first)  # a row for each range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = dealt.join(F.broadcast(starts), "range").withColumn("rank", (F.col("before") + inside).cast("long"))
    return out.where(F.col("rank") <= first).drop("range", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42, n: int = NGRAM, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): every document; ``rank`` numbers the drawn ones, else it is null.

    Of the documents with ``min_words`` words or more, ``share`` (a fraction, rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, text_col, n, buckets), buckets, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-float(scale) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    judged = weights(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise)
    judged = written(judged.withColumn("row", F.monotonically_increasing_id()), "scores")
    able = judged.where(F.col("n_words") >= min_words)
    first = share[0] * able.count() // share[1]
    drawn = ranked(able.select("score", "id", "row"), [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], first)
    out = judged.join(drawn.select("row", "rank"), "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
