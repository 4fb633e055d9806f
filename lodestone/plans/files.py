"""Sources and sinks as queries: texts are made from the driver's tables, files go to the shared folder."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators.incremental import add_rollup
from lodestone.plans.registry import query
from lodestone.sources import coverage, files, manifests
from lodestone.sources.tables import read_commits
from lodestone.storage import fresh_path
from lodestone.streaming.usage import changed_files


def _package_json(m):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    text = F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "^1.'), F.col("p_size").cast("string"), F.lit('.0"}, "devDependencies": {"dev-'), name, F.lit('": "~2.0.'), F.col("p_size").cast("string"), F.lit('"}}'))
    return m.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/package.json")).alias("file_path"), text.alias("content"))


query(
    "S5_manifests",
    lambda m: manifests.parse_manifests(_package_json(m)),
    "SELECT 'p' || p_partkey || '/package.json' AS manifest_path, 'npm' AS ecosystem, unnest([replace(p_name, ' ', '-'), 'dev-' || replace(p_name, ' ', '-')]) AS package_name, unnest(['1.' || p_size || '.0', '2.0.' || p_size]) AS pkg_version, FALSE AS is_transitive FROM part",
)


def _lcov(m):
    lines = m.table("lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("DA:"), F.concat("l_orderkey", F.lit("0"), "l_linenumber"), F.lit(","), F.when(F.col("l_tax") > 0.03, "1").otherwise("0")))).alias("l"))
    text = F.concat(F.lit("SF:f"), F.col("l_partkey").cast("string"), F.lit("\n"), F.array_join("l", "\n"), F.lit("\nend_of_record"))
    return lines.select(F.lit("cov/lcov.info").alias("file_path"), text.alias("content"))


query(
    "S7_coverage",
    lambda m: coverage.parse_reports(_lcov(m)).select("reported", F.round("coverage_percentage", 6).alias("percent")),
    "SELECT 'f' || l_partkey AS reported, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6)::DOUBLE AS percent FROM (SELECT l_partkey, l_orderkey || '0' || l_linenumber AS n, bool_or(l_tax > 0.03) AS hit FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def _commits(m):
    """Commits written as pages of JSON and read as a source."""
    path = fresh_path(m.spark, "commit-pages")
    detail = F.transform("files", lambda f: F.struct(f["filename"].alias("filename"), f["additions"].cast("long").alias("additions"), f["deletions"].cast("long").alias("deletions")))
    pages = m.commits.select(F.col("sha").cast("string").alias("sha"), F.struct(F.struct(F.lit(None).cast("string").alias("name"), F.col("author").alias("email"), F.col("ts").alias("date")).alias("author")).alias("commit"), detail.alias("files"))
    pages.write.json(path)
    return read_commits(m.spark, path, "1995-01-01", None).select("sha", "author", F.size("files").alias("n_files"))


query("S8_commits", _commits, "SELECT o_orderkey::VARCHAR AS sha, o_custkey::VARCHAR AS author, count(*) AS n_files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING max(l_shipdate) >= TIMESTAMP '1995-01-01'")


def _scan(m):
    """Documents as lines of source files in folders by source, scanned again."""
    root = fresh_path(m.spark, "scan") + "/root"
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", ""))
    m.table("documents").where("text is not null").select(line.alias("value"), "source").write.partitionBy("source").text(root)
    found = files.scan_folder(m.spark, root, ("txt",)).select(F.explode(F.split(F.trim("content"), "\n")).alias("line")).where("line <> ''")
    return found.select(F.split("line", " ")[0].cast("long").alias("doc_id"), F.sha2(F.unbase64(F.split("line", " ")[1]), 256).alias("h"))


query("S2_scan_folder", _scan, "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")


def _zips(m):
    """Archives made on the executors, each a row, read as the ZIP source reads them."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["doc_id"], frame["text"]):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(f"r/{key}.py", text)
                    z.writestr("r/skip.bin", "x")
                out.append(data.getvalue())
            yield pd.DataFrame({"path": "z.zip", "content": out})

    packed = m.table("documents").where("text is not null").select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return files.unpack(packed).select("file_path", F.sha2("content", 256).alias("h"))


query("S3_archives", _zips, "SELECT 'r/' || doc_id || '.py' AS file_path, sha256(text) AS h FROM documents WHERE text IS NOT NULL")


def _csv(m):
    path = fresh_path(m.spark, "csv")
    files.export_csv(m.table("supplier").select("s_suppkey", (F.col("s_acctbal") / 7).alias("v")), path)
    return m.spark.read.csv(path, header=True, schema="s_suppkey long, v double")


query("S11_csv", _csv, "SELECT s_suppkey, round(s_acctbal / 7, 2) AS v FROM supplier")


def _dynamic(m):
    """Counts of whatever types and severities occur, null among them."""
    counts = m.issues.withColumn("severity", F.when(F.col("id") % 10 > 0, F.col("severity"))).groupBy("repo_id", F.coalesce("severity", F.lit("null")).alias("k")).agg(F.count("*").alias("c"))
    return counts.groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: F.concat_ws("=", x["k"], x["c"].cast("string"))).alias("by_severity"))


query("A17_dynamic_counts", _dynamic, ", c AS (SELECT repo_id, CASE WHEN id % 10 > 0 THEN severity ELSE 'null' END AS k, count(*) AS c FROM issues GROUP BY 1, 2) SELECT repo_id, list(k || '=' || c ORDER BY k) AS by_severity FROM c GROUP BY 1", "issues")


def _incremental(m):
    """A stream of usage files, each batch added to the stored rollup."""
    source, state = fresh_path(m.spark, "stream-in"), fresh_path(m.spark, "stream-state")
    m.usage.repartition(3).write.parquet(source)
    held = {"path": None}

    def apply(batch, number):
        fresh = A.usage_rollup(batch)
        out = fresh if held["path"] is None else add_rollup(m.spark.read.parquet(held["path"]), fresh)
        held["path"] = f"{state}/{number}"
        out.write.mode("overwrite").parquet(held["path"])

    stream = m.spark.readStream.schema(m.usage.schema).option("maxFilesPerTrigger", 1).parquet(source)
    changed_files(stream, apply, fresh_path(m.spark, "stream-checkpoint")).awaitTermination()
    return m.spark.read.parquet(held["path"])


query("ST5_stream_rollup", _incremental, "SELECT user_id, created_at::DATE AS usage_date, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM usage GROUP BY 1, 2", "usage")
