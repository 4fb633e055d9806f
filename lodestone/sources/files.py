"""File sources and sinks: folders, archives, CSV and JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files that a scan takes.
SOURCE_EXTENSIONS = ("js", "jsx", "ts", "tsx", "py", "cs", "go", "java", "rs", "rb")


def scan_folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> DataFrame:
    """(file_path, content) of source files anywhere below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/", "")
    own = files.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    return own.select(relative.alias("file_path"), F.decode("content", "UTF-8").alias("content"))


def unpack(archives: DataFrame, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> DataFrame:
    """(archive, file_path, content) of the members of ZIP files (path, content); members go out one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.filename.rpartition(".")[2].lower() in extensions:
                            text = z.read(info).decode("utf-8", "replace")
                            yield pd.DataFrame({"archive": [archive], "file_path": [info.filename], "content": [text]})

    return archives.select("path", "content").mapInPandas(run, "archive string, file_path string, content string")


def scan_archives(spark: SparkSession, path: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> DataFrame:
    """The members of all ZIP files in a folder."""
    return unpack(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path), extensions)


def export_csv(df: DataFrame, path: str, digits: int = 2) -> None:
    """CSV with a header; doubles are rounded."""
    columns = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
