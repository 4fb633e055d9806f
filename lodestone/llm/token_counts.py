"""Token counts through a digest cache.

The cache is a Parquet folder of (content_digest, tokenizer_digest, n_tokens). Contents are joined to it by digest; only
distinct contents that it lacks are encoded, and their counts are appended as a new set of files. Byte-level tokenizers
count every byte, so the only normalisation that keeps counts is null to the empty text; ``normalise`` takes another
column expression for tokenizers that fold case or white space themselves.

One digest's copies never meet in one task: representatives come from a grouped minimum with partial aggregation, and a
bitmap of them, of bounded size, picks their texts out where they are read. So what the cache holds and copies stay where
they are; missing contents are shuffled once, each row that repeats one at most once a task. Beyond about 10^8 missing
contents the bitmap lets more rows through, and the join behind it drops them. Counts of the most frequent contents go to
all tasks, the rest are joined by digest.

A null text is the empty one. Rows may repeat an id, or have none: each distinct content is encoded once all the same,
and each row keeps its own output row. Very long texts are encoded whole, one at a time. An empty table gives no rows.
Other columns are not read, so they may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import fresh_path, hash_bitmap, in_bitmap, written
from lodestone.llm._text import blocks, settle

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
#: Bytes of text that the tokenizer gets at once.
BLOCK = 1 << 20
#: Most frequent contents whose counts are sent to every task (some 100 bytes each); the others' rows meet theirs by digest.
HOT = 4096


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens by the library that the file belongs to; one for each worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file and its library's version: another of either never meets counts of this one."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str, digest: str) -> DataFrame:
    """Stored counts of one tokenizer; an absent folder is an empty cache. Counts appended twice are read once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content_digest", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == digest)
    return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(content_digest, n_tokens) of (content_digest, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(path)
        for part, _, _ in blocks(batches, "content", BLOCK):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["content_digest", "n_tokens"])
        settle()

    return texts.select("content_digest", "content").mapInArrow(run, "content_digest string, n_tokens long")


def _representatives(base: DataFrame, misses: DataFrame) -> DataFrame:
    """(content_digest, content): one row for each of the missing (content_digest, first), out of (__id, content, content_digest)."""
    wanted = misses.select("content_digest", F.xxhash64("first").alias("place"))
    shared = base.sparkSession.sparkContext.broadcast(hash_bitmap(wanted.select(F.xxhash64("content_digest", "place"))))
    picked = base.select("content_digest", F.xxhash64("__id").alias("place"), "content")
    picked = picked.withColumn("h", F.xxhash64("content_digest", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # no more than the task's rows
        for batch in batches:
            h = batch.column(3).to_numpy()
            fresh = np.zeros(len(h), dtype=bool)
            for i in np.flatnonzero(in_bitmap(shared.value, h)).tolist():
                key = (batch.column(0)[i].as_py(), int(h[i]))
                fresh[i] = key not in seen
                seen.add(key)
            if fresh.any():
                yield batch.select([0, 1, 2]).filter(pa.array(fresh))
        settle()

    found = picked.mapInArrow(run, "content_digest string, place long, content string").join(wanted, ["content_digest", "place"], "left_semi")
    return found.dropDuplicates(["content_digest", "place"]).select("content_digest", "content")  # the join has dealt by these


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row; what the cache lacked is appended to it.

    ``cache``: a shared folder that lasts; None makes a new one in the cluster's shared folder. A null text is empty. A
    null id keeps its row and its count.
    """
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-counts")
    digest = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    content = normalise(content) if normalise else content
    base = docs.select(F.col(id_col).alias("__id"), content.alias("content"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    base = base.withColumn("content_digest", F.sha2("content", 256))
    slim = written(base.select("__id", "n_bytes", "content_digest"), "token-digests")
    # the least id stands for a content's rows, null if none of them has an id
    distinct = written(slim.groupBy("content_digest").agg(F.min("__id").alias("first"), F.count("*").alias("n")), "token-contents")
    misses = written(distinct.join(read_cache(spark, cache, digest), "content_digest", "left_anti"), "token-misses")
    counted = encode_counts(_representatives(base, misses), tokenizer_path)
    counted.select("content_digest", F.lit(digest).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, digest)
    most = distinct.where("n > 1").orderBy(F.desc("n"), "content_digest").limit(HOT).select("content_digest")
    hot = F.broadcast(written(counts.join(F.broadcast(most), "content_digest"), "token-hot"))
    out = slim.join(hot, "content_digest").unionByName(slim.join(hot, "content_digest", "left_anti").join(counts, "content_digest"))
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens")
