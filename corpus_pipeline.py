"""Corpus pipeline: quality, language, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and rereads as
the next stage's documents. The stages but the last keep the columns of documents.

Decisions are about rows: the first two stages carry whole rows through their operators, the next two know each row by
its place in the files that they read. So repeated ids and null ids need no special care, and empty tables give empty
tables. Names that a stage adds are chosen apart from the documents' own, so extra columns may have any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard_join, language_id, quality
from lodestone.llm._shared import bound_batches, written


#: Most rows to drop whose places are sent to every executor (16 bytes each); more meet the documents in a shuffled join.
BROADCAST_ROWS = 500_000


def _free(docs: DataFrame, stem: str) -> str:
    """``stem``, longer by as many underscores as it takes until no column starts with it."""
    own = [c.lower() for c in docs.columns]
    while any(c.startswith(stem.lower()) for c in own):
        stem += "_"
    return stem


def _placed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with a row's place in the files behind it, and the names of the two columns (file, row); what no files are behind is written first."""
    file, at = _free(docs, "__file"), _free(docs, "__at")

    def place(table: DataFrame) -> DataFrame:
        behind = table.metadataColumn("_metadata")
        return table.select("*", F.xxhash64(behind["file_path"]).alias(file), behind["row_index"].alias(at))

    try:
        return place(docs), file, at
    except AnalysisException:
        return place(written(docs, "documents")), file, at


def _without(placed: DataFrame, gone: DataFrame, file: str, at: str) -> DataFrame:
    """Placed documents but those in ``gone`` (file, row)."""
    gone = written(gone.toDF(file, at), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(gone) if few else gone, [file, at], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose posterior quality isn't rejected; a null or empty text goes by its path's posterior.

    A posterior that equals the bound stays. Each row is judged by itself, so copies fare alike within a path.
    """
    bound_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = _free(docs, "__quality_")
    judged = quality.score(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"), keep=docs.columns, prefix=own)
    return judged.where(F.col(f"{own}keep")).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: texts that are null, empty, without a letter or ambiguous go. Copies fare alike."""
    bound_batches(spark)
    own = _free(docs, "__language_")
    judged = language_id.predict(docs, language_id.fit(docs), docs.columns, prefix=own)
    return judged.where((F.col(f"{own}lang_pred") != "und") & ~F.col(f"{own}ambiguous")).select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, similarity of 0.8 or more): that of the least id.

    A row without an id stays only if its group has no other kind; among rows of one id the place decides. Texts without
    words are in no group and stay.
    """
    bound_batches(spark)
    placed, file, at = _placed(docs)
    doc = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col(file).alias("file"), F.col(at).alias("at"))
    groups = jaccard_join.similar_groups(placed.select("text", doc.alias("__doc")), id_col="__doc")
    least = F.col("component_id")
    gone = groups.where((F.col("__doc")["file"] != least["file"]) | (F.col("__doc")["at"] != least["at"]))
    return _without(placed, gone.select("__doc.file", "__doc.at"), file, at).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that share ten words in a row, or a whole shorter item, with the benchmark; a text without words stays."""
    bound_batches(spark)
    placed, file, at = _placed(docs)
    rows = placed.select("text", F.struct(F.col(file).alias("file"), F.col(at).alias("at")).alias("__doc"))
    judged = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__doc")
    return _without(placed, judged.where("contaminated").select("__doc.file", "__doc.at"), file, at).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256); a null text encodes as the empty one."""
    bound_batches(spark)
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: The classifiers and the encoder have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
