"""The relational model of repository analytics, built from the driver's tables.

Each property gives a DataFrame with the columns that the operators expect; ``CTE`` holds the same relation as DuckDB
SQL, so oracle queries start from the tables themselves. Paths, types and edges are arithmetic on keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".js", ".py", ".cs", ".go")
LANGUAGES = ("javascript", "python", "csharp", "go")
ISSUE_TYPES = ("god_file", "high_coupling", "dead_code", "circular_dependency", "untested_critical_file", "secret", "missing_auth", "vulnerable_dependency", "insecure_pattern")
SEVERITIES = ("low", "medium", "high", "critical")


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def path_of(k: Column) -> Column:
    folder = F.concat(F.lit("d"), (k % 40).cast("string"), F.lit("/f"), k.cast("string"))
    return F.when(k % 7 == 0, F.concat(F.lit("tests/"), folder, F.lit(".test.js"))).otherwise(F.concat(F.lit("src/"), folder, _pick(EXTENSIONS, k)))


def path_sql(k: str) -> str:
    return f"CASE WHEN ({k}) % 7 = 0 THEN 'tests/d' || (({k}) % 40) || '/f' || ({k}) || '.test.js' ELSE 'src/d' || (({k}) % 40) || '/f' || ({k}) || (['.js', '.py', '.cs', '.go'])[({k}) % 4 + 1] END"


class Model:
    """Tables by name (``m.table``) and relations of the model."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_files(self) -> int:
        return self.table("part").count()

    @cached_property
    def nodes(self) -> DataFrame:
        """Files: repo_id, file_path, language, line_count, complexity_score, flags, content_hash."""
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("file_id"),
            F.col("p_brand").alias("repo_id"),
            path_of(k).alias("file_path"),
            F.when(k % 13 != 0, _pick(LANGUAGES, k)).alias("language"),
            ((k * 37) % 900).cast("int").alias("line_count"),
            F.when(k % 17 != 0, F.col("p_size")).cast("int").alias("complexity_score"),
            (k % 7 == 0).alias("is_test_file"),
            (k % 3 == 0).alias("has_test_coverage"),
            F.sha2(F.concat("p_name", F.lit("/"), F.col("p_size").cast("string")), 256).alias("content_hash"),
        )

    @cached_property
    def edge_ids(self) -> DataFrame:
        k, n = F.col("p_partkey"), self.n_files
        a = self.table("part").where(k % 3 != 0).select(k.alias("a"), ((k * 7 + 3) % n).alias("b"))
        b = self.table("part").where(k % 5 == 0).select(k.alias("a"), ((k * k + 1) % n).alias("b"))
        return a.union(b).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """Imports: from_path, to_path, symbols."""
        symbols = F.array(F.concat(F.lit("s"), (F.col("a") % 5).cast("string")), F.concat(F.lit("s"), (F.col("b") % 3).cast("string")))
        return self.edge_ids.select(path_of(F.col("a")).alias("from_path"), path_of(F.col("b")).alias("to_path"), symbols.alias("symbols"))

    @cached_property
    def degrees(self) -> DataFrame:
        """Nodes with incoming_count and outgoing_count."""
        from lodestone.operators.aggregates import with_degrees

        return with_degrees(self.nodes, self.edges)

    @cached_property
    def issues(self) -> DataFrame:
        k, n = F.col("p_partkey"), self.n_files
        return self.table("part").where(k % 2 == 0).select(
            k.alias("id"),
            F.col("p_brand").alias("repo_id"),
            _pick(ISSUE_TYPES, k).alias("type"),
            _pick(SEVERITIES, F.col("p_size")).alias("severity"),
            F.array(path_of(k), path_of((k * 7 + 3) % n)).alias("file_paths"),
            F.concat(F.lit("Issue in "), F.col("p_name"), F.lit(" at line "), F.col("p_size").cast("string")).alias("description"),
            F.when(k % 11 != 0, (F.col("p_size") * k) % 97 / 10.0).alias("risk_score"),
            F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("created_at"),
        )

    @cached_property
    def suppressions(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").where(k % 6 == 0).select(
            F.col("p_brand").alias("repo_id"), path_of(k).alias("file_path"), _pick(ISSUE_TYPES, k).alias("rule_id"), F.when(k % 4 != 0, F.col("p_size")).alias("line_number")
        )

    @cached_property
    def findings(self) -> DataFrame:
        """Review findings: one line each."""
        k = F.col("p_partkey")
        return self.table("part").where(k % 3 == 0).select(
            k.alias("finding_id"), F.col("p_brand").alias("repo_id"), path_of(k).alias("file_path"), _pick(ISSUE_TYPES, k).alias("rule_id"), _pick(SEVERITIES, F.col("p_size")).alias("severity"), F.col("p_size").alias("line_number"), F.col("p_name").alias("message")
        )

    @cached_property
    def commits(self) -> DataFrame:
        """A row for each commit with its files, from orders and their lines."""
        files = F.collect_list(F.struct(path_of(F.col("l_partkey")).alias("filename"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").cast("int").alias("deletions")))
        lines = self.table("lineitem").groupBy("l_orderkey").agg(files.alias("files"), F.max("l_shipdate").alias("ts"))
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("author"))
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_orderkey").alias("sha"), "author", F.col("ts").cast("timestamp").alias("ts"), "files")

    @cached_property
    def churn(self) -> DataFrame:
        from lodestone.operators.aggregates import churn_by_file

        return churn_by_file(self.commits, "2001-06-01")

    @cached_property
    def usage(self) -> DataFrame:
        value = F.floor((F.col("value") * 100).cast("decimal(20,4)").cast("double"))
        return self.table("events").select(F.col("event_id"), F.col("user_id"), F.col("event_type").alias("endpoint"), (value % 500).alias("prompt_tokens"), (value % 300).alias("completion_tokens"), F.col("ts").cast("timestamp").alias("created_at"))

    @cached_property
    def notifications(self) -> DataFrame:
        k = F.col("event_id")
        return self.table("events").select(
            k.alias("id"), "user_id", (k % 5).alias("repo_id"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("dedup_key"), F.when(k % 3 == 0, F.col("ts").cast("timestamp")).alias("read_at"), F.col("ts").cast("timestamp").alias("created_at")
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        k = F.col("p_partkey")
        vulns = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("V"), k.cast("string"), F.lit("-"), i.cast("string")).alias("id"), _pick(("low", "medium", "high"), i + k).alias("severity")))
        return self.table("part").select(
            k.alias("id"), F.col("p_brand").alias("repo_id"), F.concat(F.lit("m"), (k % 9).cast("string"), F.lit("/package.json")).alias("manifest_path"), F.lit("npm").alias("ecosystem"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("package_name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("pkg_version"), (k % 4 == 0).alias("is_transitive"), F.when(F.col("p_size") % 3 > 0, vulns).otherwise(F.array().cast("array<struct<id:string,severity:string>>")).alias("vulns"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks with embeddings; the label is the repository."""
        k = F.col("vec_id")
        return self.table("embeddings").select(k.alias("id"), F.col("label").alias("repo_id"), path_of(k).alias("file_path"), (k * 3 % 50).cast("int").alias("start_line"), (k * 3 % 50 + k % 30).cast("int").alias("end_line"), "embedding")

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), "lang", "n_chars")

    @cached_property
    def sources(self) -> DataFrame:
        """Source files in four languages: file_id, file_path, content of five lines that the scans know."""
        k, size = F.col("p_partkey"), F.col("p_size")
        second = F.when(size % 3 == 0, F.concat(F.lit("url = 'http://h"), k.cast("string"), F.lit(".example/'"))).when(size % 3 == 1, F.concat(F.lit("host = '192.168.1."), (size % 250).cast("string"), F.lit("'"))).otherwise("url = 'http://localhost/'")
        fourth = F.when(size % 4 == 0, "router.get('/x', run)").when(size % 4 == 1, "router.get('/x', require('child_process'))").when(size % 4 == 2, "child_process.run(x)").otherwise("pass")
        text = F.concat_ws("\n", F.concat(F.lit("size = "), size.cast("string")), second, F.lit("cursor.execute('a %s' % name)"), fourth, F.lit("MD5.Create() + SHA1 + DES"))
        return self.table("part").select(k.alias("file_id"), path_of(k).alias("file_path"), text.alias("content"))


_K = "p_partkey"
_N = "(SELECT count(*) FROM part)"
CTE = {
    "nodes": f"""nodes AS (SELECT {_K} AS file_id, p_brand AS repo_id, {path_sql(_K)} AS file_path, CASE WHEN {_K} % 13 <> 0 THEN (['javascript', 'python', 'csharp', 'go'])[{_K} % 4 + 1] END AS language, ({_K} * 37) % 900 AS line_count, CASE WHEN {_K} % 17 <> 0 THEN p_size END AS complexity_score, {_K} % 7 = 0 AS is_test_file, {_K} % 3 = 0 AS has_test_coverage, sha256(p_name || '/' || p_size) AS content_hash FROM part)""",
    "edge_ids": f"""edge_ids AS (SELECT {_K} AS a, ({_K} * 7 + 3) % {_N} AS b FROM part WHERE {_K} % 3 <> 0 UNION SELECT {_K}, ({_K} * {_K} + 1) % {_N} FROM part WHERE {_K} % 5 = 0)""",
    "edges": f"""edges AS (SELECT {path_sql('a')} AS from_path, {path_sql('b')} AS to_path, ['s' || (a % 5), 's' || (b % 3)] AS symbols FROM edge_ids)""",
    "degrees": """degrees AS (SELECT n.*, coalesce(i.c, 0) AS incoming_count, coalesce(o.c, 0) AS outgoing_count FROM nodes n LEFT JOIN (SELECT to_path, count(*) AS c FROM edges GROUP BY 1) i ON i.to_path = n.file_path LEFT JOIN (SELECT from_path, count(*) AS c FROM edges GROUP BY 1) o ON o.from_path = n.file_path)""",
    "issues": f"""issues AS (SELECT {_K} AS id, p_brand AS repo_id, (['god_file', 'high_coupling', 'dead_code', 'circular_dependency', 'untested_critical_file', 'secret', 'missing_auth', 'vulnerable_dependency', 'insecure_pattern'])[{_K} % 9 + 1] AS type, (['low', 'medium', 'high', 'critical'])[p_size % 4 + 1] AS severity, [{path_sql(_K)}, {path_sql(f'(({_K} * 7 + 3) % {_N})')}] AS file_paths, 'Issue in ' || p_name || ' at line ' || p_size AS description, CASE WHEN {_K} % 11 <> 0 THEN (p_size * {_K}) % 97 / 10.0::DOUBLE END AS risk_score, make_timestamp((1704067200 + {_K} * 60) * 1000000) AS created_at FROM part WHERE {_K} % 2 = 0)""",
    "suppressions": f"""suppressions AS (SELECT p_brand AS repo_id, {path_sql(_K)} AS file_path, (['god_file', 'high_coupling', 'dead_code', 'circular_dependency', 'untested_critical_file', 'secret', 'missing_auth', 'vulnerable_dependency', 'insecure_pattern'])[{_K} % 9 + 1] AS rule_id, CASE WHEN {_K} % 4 <> 0 THEN p_size END AS line_number FROM part WHERE {_K} % 6 = 0)""",
    "findings": f"""findings AS (SELECT {_K} AS finding_id, p_brand AS repo_id, {path_sql(_K)} AS file_path, (['god_file', 'high_coupling', 'dead_code', 'circular_dependency', 'untested_critical_file', 'secret', 'missing_auth', 'vulnerable_dependency', 'insecure_pattern'])[{_K} % 9 + 1] AS rule_id, (['low', 'medium', 'high', 'critical'])[p_size % 4 + 1] AS severity, p_size AS line_number, p_name AS message FROM part WHERE {_K} % 3 = 0)""",
    "churn": f"""churn AS (SELECT {path_sql('l_partkey')} AS file_path, count(*) AS commit_count, count(*) FILTER (WHERE c.ts >= TIMESTAMP '2001-06-01' - INTERVAL 30 DAY) AS commits_in_last_30d, count(DISTINCT o_custkey) AS unique_authors, sum(l_quantity::INT + l_linenumber) AS lines_changed, max(c.ts) AS last_modified FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT l_orderkey AS k, max(l_shipdate) AS ts FROM lineitem GROUP BY 1) c ON c.k = l_orderkey GROUP BY 1)""",
    "usage": """usage AS (SELECT event_id, user_id, event_type AS endpoint, ((value * 100)::DECIMAL(20, 4)::DOUBLE // 1)::BIGINT % 500 AS prompt_tokens, ((value * 100)::DECIMAL(20, 4)::DOUBLE // 1)::BIGINT % 300 AS completion_tokens, ts AS created_at FROM events)""",
    "notifications": """notifications AS (SELECT event_id AS id, user_id, event_id % 5 AS repo_id, event_type AS type, props->>'$.k' AS dedup_key, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at, ts AS created_at FROM events)""",
    "dependencies": f"""dependencies AS (SELECT {_K} AS id, p_brand AS repo_id, 'm' || ({_K} % 9) || '/package.json' AS manifest_path, 'npm' AS ecosystem, replace(p_name, ' ', '-') AS package_name, '1.' || p_size AS pkg_version, {_K} % 4 = 0 AS is_transitive, list_transform(range(1, p_size % 3 + 1), lambda i: {{'id': 'V' || {_K} || '-' || i, 'severity': (['low', 'medium', 'high'])[(i + {_K}) % 3 + 1]}}) AS vulns FROM part)""",
    "chunks": f"""chunks AS (SELECT vec_id AS id, label AS repo_id, {path_sql('vec_id')} AS file_path, vec_id * 3 % 50 AS start_line, vec_id * 3 % 50 + vec_id % 30 AS end_line, embedding FROM embeddings)""",
    "sources": f"""sources AS (SELECT {_K} AS file_id, {path_sql(_K)} AS file_path, 'size = ' || p_size || chr(10) || CASE p_size % 3 WHEN 0 THEN 'url = ''http://h' || {_K} || '.example/''' WHEN 1 THEN 'host = ''192.168.1.' || (p_size % 250) || '''' ELSE 'url = ''http://localhost/''' END || chr(10) || 'cursor.execute(''a %s'' % name)' || chr(10) || CASE p_size % 4 WHEN 0 THEN 'router.get(''/x'', run)' WHEN 1 THEN 'router.get(''/x'', require(''child_process''))' WHEN 2 THEN 'child_process.run(x)' ELSE 'pass' END || chr(10) || 'MD5.Create() + SHA1 + DES' AS content, p_size FROM part)""",
    "texts": """texts AS (SELECT doc_id AS id, source AS repo_id, 'doc/' || doc_id AS file_path, text AS content, lang, n_chars FROM documents)""",
}
_NEEDS = {"edges": ("edge_ids",), "degrees": ("nodes", "edge_ids", "edges")}


def with_ctes(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` (further CTEs may open it, as ``, x AS (...)``) after the named relations and those they need."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*_NEEDS.get(name, ()), name) if x not in order]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(CTE[x] for x in order)} {sql}"
