"""Text operators and file formats as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import text as X
from lodestone.plans.registry import query
from lodestone.sources.tables import scan_table

query("X2_estimated_tokens", lambda m: m.texts.select("id", X.estimated_tokens(F.col("content")).alias("tokens")), "SELECT id, ceil(length(content) / 4)::BIGINT AS tokens FROM texts", "texts")
query("W8_packed_lines", lambda m: X.packed_lines(m.texts, "id", "content"))
query("X1_chunks", lambda m: X.chunks(m.texts, "id", "file_path", "content").select("id", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256")))
query("X1_short_files", lambda m: X.chunks(m.sources, "file_id", "file_path", "content"), "SELECT file_id, 1 AS start_line, 5 AS end_line, content FROM sources", "sources")
query("X8_stitched", lambda m: X.stitched(m.table("conversations"), "conv_id", "turn", "text", "\n\n").select("conv_id", F.sha2("content", 256).alias("h")), "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
query("X9_line_range", lambda m: m.texts.select("id", X.line_range(F.col("content"), 2, 4).alias("part")), "SELECT id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS part FROM texts", "texts")
query("X10_language", lambda m: m.nodes.select("file_id", X.language_of(F.col("file_path")).alias("language")), "SELECT file_id, CASE WHEN file_path LIKE '%.js' THEN 'javascript' WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.cs' THEN 'csharp' ELSE 'go' END AS language FROM nodes", "nodes")
query("X11_skipped", lambda m: m.nodes.where(~X.skipped(F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("a/node_modules/"), "file_path")).otherwise(F.col("file_path")))).select("file_id"), "SELECT file_id FROM nodes WHERE file_id % 3 <> 0", "nodes")
query("S4_manifest_paths", lambda m: m.dependencies.where(~X.skipped(F.concat(F.when(F.col("id") % 5 == 0, "dist/").otherwise("pkg/"), F.col("manifest_path")))).groupBy("manifest_path").agg(F.count("*").alias("n")), "SELECT manifest_path, count(*) AS n FROM dependencies WHERE id % 5 <> 0 GROUP BY 1", "dependencies")
query("S6_clean_version", lambda m: m.dependencies.select("id", X.clean_version(F.concat(F.when(F.col("id") % 3 == 0, "^").when(F.col("id") % 3 == 1, ">= ").otherwise(""), "pkg_version")).alias("version")), "SELECT id, pkg_version AS version FROM dependencies", "dependencies")
query("X7_dependency_text", lambda m: m.dependencies.select("id", *X.dependency_text(F.concat(F.lit("Package "), "package_name", F.lit("@"), "pkg_version", F.lit(" is vulnerable (HIGH)")))), "SELECT id, package_name, pkg_version, 'high' AS severity FROM dependencies", "dependencies")
def _imports(m):
    text = F.concat(F.lit("import {a, b as c} from './x"), F.col("page_id").cast("string"), F.lit("';\nconst f = require('fs');\nexport * from './y';\nimport('./z'); // import './no'"))
    return X.imports(m.table("pages").select(F.concat("page_id", F.lit(".ts")).alias("path"), text.alias("text")), "path", "text")


query("X3_imports", lambda m: _imports(m).select("from_path", "name", "symbols"), "SELECT page_id || '.ts' AS from_path, unnest(['./x' || page_id, 'fs', './y', './z']) AS name, unnest([['a', 'c'], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]]) AS symbols FROM pages")


def _resolved(m):
    files = m.nodes.where("not is_test_file")
    found = files.select(F.col("file_path").alias("from_path"), F.lit("import").alias("kind"), F.concat(F.lit("../d"), ((F.col("file_id") + 4) % 40).cast("string"), F.lit("/f"), (F.col("file_id") + 4).cast("string")).alias("name"))
    python = files.select(F.col("file_path").alias("from_path"), F.lit("import").alias("kind"), F.concat(F.lit("..d"), ((F.col("file_id") + 4) % 40).cast("string"), F.lit(".f"), (F.col("file_id") + 4).cast("string")).alias("name")).where("from_path like '%.py'")
    return X.resolve_imports(files, found.where("from_path like '%.js'").unionByName(python)).select("from_path", "to_path")


query(
    "X3_resolved_imports",
    _resolved,
    "SELECT a.file_path AS from_path, b.file_path AS to_path FROM nodes a JOIN nodes b ON b.file_id = a.file_id + 4 WHERE NOT a.is_test_file AND NOT b.is_test_file AND (a.file_path LIKE '%.js' OR a.file_path LIKE '%.py')",
    "nodes",
)


def _graph(m):
    """Files that import by their language's rules, read from their texts."""
    k, path = F.col("file_id"), F.col("file_path")
    far = ((k + 4) % 40).cast("string")
    text = F.when(path.endswith(".go"), F.concat(F.lit('import (\n\t"mod/d'), (k % 40).cast("string"), F.lit('"\n)'))).when(path.endswith(".cs"), F.concat(F.lit("using App.N"), far, F.lit(";\nnamespace App.N"), (k % 40).cast("string"), F.lit(" {\n}"))).otherwise("x")
    return X.import_edges(m.nodes.select("file_path", text.alias("content")))


query(
    "X4_import_graph",
    lambda m: _graph(m).select("from_path", "to_path"),
    "SELECT a.file_path AS from_path, b.file_path AS to_path FROM nodes a JOIN nodes b ON (a.file_path LIKE '%.go' AND b.file_id % 40 = a.file_id % 40) OR (a.file_path LIKE '%.cs' AND b.file_path LIKE '%.cs' AND b.file_id % 40 = (a.file_id + 4) % 40)",
    "nodes",
)


def _packages(m):
    """Java, Rust and Ruby imports of files made from the parts."""
    k = F.col("p_partkey")
    n, after = k.cast("string"), (k + 6).cast("string")
    files = m.table("part").select(F.concat(F.lit("p"), (k % 5).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("/C"), n, F.lit(".java"))).when(k % 3 == 1, F.concat(F.lit("/m"), n, F.lit(".rs"))).otherwise(F.concat(F.lit("/r"), n, F.lit(".rb")))).alias("to_path"), k.alias("k"))
    name = F.when(k % 3 == 0, F.concat(F.lit("a.b.C"), after)).when(k % 3 == 1, F.concat(F.lit("crate::a::m"), after)).otherwise(F.concat(F.lit("x/r"), after))
    found = files.join(m.table("part").select(k.alias("k"), name.alias("name"), F.when(k % 3 == 0, "import").when(k % 3 == 1, "use").otherwise("require").alias("kind")), "k").select(F.col("to_path").alias("from_path"), "kind", "name")
    return X.resolve_packages(files.select("to_path"), found).select("from_path", "to_path")


query(
    "X4_resolved_packages",
    _packages,
    "WITH f AS (SELECT p_partkey AS k, 'p' || (p_partkey % 5) || CASE p_partkey % 3 WHEN 0 THEN '/C' || p_partkey || '.java' WHEN 1 THEN '/m' || p_partkey || '.rs' ELSE '/r' || p_partkey || '.rb' END AS p FROM part) SELECT a.p AS from_path, b.p AS to_path FROM f a JOIN f b ON b.k = a.k + 6",
)
query("X5_symbols", lambda m: m.nodes.select("file_id", X.imported_symbols(F.concat(F.lit("import { a"), F.col("file_id").cast("string"), F.lit(", b as c } from 'x'"))).alias("symbols")), "SELECT file_id, ['a' || file_id, 'c'] AS symbols FROM nodes", "nodes")
query("X6_namespaces", lambda m: X.namespace_files(m.nodes.select("file_path", F.array(F.col("repo_id"), F.col("language")).alias("exports"))), ", e AS (SELECT file_path, unnest([repo_id, language]) AS namespace FROM nodes) SELECT namespace, list_sort(list(DISTINCT file_path)) AS files FROM e GROUP BY 1", "nodes")
query("S1_scan", lambda m: scan_table(m.spark, f"{m.sf_dir}/part.parquet", ["p_partkey", "p_size"], F.col("p_size") > 10), "SELECT p_partkey, p_size FROM part WHERE p_size > 10")
query("S10_bulk_insert", lambda m: m.issues.select(F.to_json(F.array(F.struct("type", "file_paths", F.when(F.col("id") % 3 > 0, F.col("severity")).otherwise("").alias("severity")))).alias("j")).select(F.inline(F.from_json("j", "array<struct<type:string,file_paths:array<string>,severity:string>>"))).where("type is not null and size(file_paths) > 0").groupBy("type", F.nullif("severity", F.lit("")).alias("severity")).agg(F.count("*").alias("n")), "SELECT type, CASE WHEN id % 3 > 0 THEN severity END AS severity, count(*) AS n FROM issues GROUP BY 1, 2", "issues")
query("S12_impact_json", lambda m: m.edges.groupBy("to_path").agg(F.to_json(F.struct(F.first("to_path").alias("path"), F.count("*").alias("n"))).alias("json")), "SELECT to_path, '{\"path\":\"' || to_path || '\",\"n\":' || count(*) || '}' AS json FROM edges GROUP BY 1", "edges")
query("X12_excerpt", lambda m: m.texts.select("id", X.excerpt(F.col("content")).alias("head")), "SELECT id, array_to_string(string_split(content, chr(10))[1:8], chr(10))[1:200] AS head FROM texts", "texts")
