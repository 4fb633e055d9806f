"""Scans of source text as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import code
from lodestone.operators import detection as D
from lodestone.plans.registry import query

query(
    "D7_attack_surface",
    lambda m: D.attack_surface(m.sources.withColumn("content", F.replace("content", F.lit("cursor.execute"), F.lit("run"))), "file_id", "file_path", "content"),
    "SELECT file_id, CASE WHEN file_path LIKE '%.js' AND p_size % 4 = 1 THEN 'both' WHEN file_path LIKE '%.js' AND p_size % 4 = 0 THEN 'source' WHEN p_size % 4 IN (1, 2) THEN 'sink' END AS surface FROM sources",
    "sources",
)
_FOUND = """, f AS (
SELECT file_id, file_path, 2 AS line, 'cross_http_url' AS rule_id, 'low' AS severity, 'CWE-319' AS cwe FROM sources WHERE p_size % 3 = 0 AND file_path NOT LIKE '%.test.%'
UNION ALL SELECT file_id, file_path, 2, 'cross_hardcoded_ipv4', 'low', 'CWE-547' FROM sources WHERE p_size % 3 = 1
UNION ALL SELECT file_id, file_path, 3, 'py_sql_percent_format', 'high', 'CWE-89' FROM sources WHERE file_path LIKE '%.py'
UNION ALL SELECT file_id, file_path, 5, unnest(['cs_weak_crypto_md5', 'cs_weak_crypto_sha1', 'cs_weak_crypto_des']), unnest(['medium', 'medium', 'high']), 'CWE-327' FROM sources WHERE file_path LIKE '%.cs')"""
query("D8_line_rules", lambda m: D.line_findings(m.sources, "file_id", "file_path", "content"), f"{_FOUND} SELECT * FROM f", "sources")
query("D8_disabled_rules", lambda m: D.line_findings(m.sources, "file_id", "file_path", "content", ("cross_http_url", "cs_weak_crypto_des")).groupBy("rule_id").agg(F.count("*").alias("n")), f"{_FOUND} SELECT rule_id, count(*) AS n FROM f WHERE rule_id NOT IN ('cross_http_url', 'cs_weak_crypto_des') GROUP BY 1", "sources")
query(
    "D8_document_rules",
    lambda m: D.line_findings(m.texts.withColumn("path", F.concat("file_path", F.lit(".py"))), "id", "path", "content").select("id", "line", "rule_id"),
    r""", l AS (SELECT id, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line, unnest(string_split(content, chr(10))) AS t FROM texts)
SELECT id, line, 'cross_http_url' AS rule_id FROM l WHERE contains(regexp_replace(t, 'http://(localhost|127\.0\.0\.1|0\.0\.0\.0)', '', 'g'), 'http://')
UNION ALL SELECT id, line, 'cross_hardcoded_ipv4' FROM l WHERE regexp_matches(t, '(^|[^0-9.])(10|172\.(1[6-9]|2[0-9]|3[01])|192\.168)\.[0-9]{1,3}\.[0-9]{1,3}\b')
UNION ALL SELECT id, line, 'py_sql_percent_format' FROM l WHERE regexp_matches(t, 'execute\s*\(.*%.*\)')
UNION ALL SELECT id, line, 'py_yaml_unsafe_load' FROM l WHERE regexp_matches(t, 'yaml\.load\s*\([^)]*\)')
UNION ALL SELECT id, line, 'py_sql_fstring' FROM l WHERE regexp_matches(t, 'execute\s*\(\s*f[''"]')""",
    "texts",
)


def _dangerous(m):
    """Texts with a call that the syntax rules know, in a line that the key decides; the same call in a string is none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    python = F.concat(F.lit("def f(x):\n    s = 'eval(x)'\n"), F.when(size % 2 == 0, "    return eval(x)\n").otherwise("    return str(x)\n"), F.lit("import pickle\npickle.loads(b'')\nrun(x, shell=True)\n"))
    script = F.concat(F.lit("const s = 'eval(x)';\n"), F.when(size % 2 == 0, "eval(x);\n").otherwise("x.eval(1);\n"), F.lit("document.write(s); new Function(s);\nrequire(s);"))
    return m.table("part").select("p_partkey", F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".py"))).otherwise(F.concat(k.cast("string"), F.lit(".js"))).alias("path"), F.when(k % 2 == 0, python).otherwise(script).alias("text"))


_SYNTAX = "SELECT p_partkey, 'py_eval' AS rule_id, 3 AS line FROM part WHERE p_partkey % 2 = 0 AND p_size % 2 = 0 UNION ALL SELECT p_partkey, unnest(['py_pickle_loads', 'py_subprocess_shell_true']), unnest([5, 6]) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'js_eval', 2 FROM part WHERE p_partkey % 2 = 1 AND p_size % 2 = 0 UNION ALL SELECT p_partkey, unnest(['js_document_write', 'js_new_function', 'js_require_non_literal']), unnest([3, 3, 4]) FROM part WHERE p_partkey % 2 = 1"
query(
    "D9_syntax_rules",
    lambda m: _dangerous(m).select("p_partkey", F.inline(code.syntax_findings("path", "text"))),
    _SYNTAX,
)


def _rules_used(m):
    """Rules by language, kind and state, with their findings in source files and in texts with dangerous calls."""
    found = D.line_findings(m.sources, "file_id", "file_path", "content", ("cross_http_url",)).select("rule_id")
    found = found.union(_dangerous(m).select(F.inline(code.syntax_findings("path", "text"))).select("rule_id"))
    return D.rule_usage(D.rule_catalogue(m.spark, ("cross_http_url",)), found).groupBy("language", "kind", "enabled").agg(F.count("*").alias("n"), F.sum("n_findings").alias("n_findings"))


query(
    "D10_rule_catalogue",
    _rules_used,
    f"""{_FOUND}, s AS ({_SYNTAX}), v(language, kind, enabled, n) AS (VALUES ('js', 'syntax', TRUE, 6), ('py', 'syntax', TRUE, 4), ('py', 'line', TRUE, 3), ('cs', 'syntax', TRUE, 2), ('cs', 'line', TRUE, 3), (NULL, 'line', FALSE, 1), (NULL, 'line', TRUE, 1)),
c AS (SELECT nullif(split_part(rule_id, '_', 1), 'cross') AS language, 'line' AS kind, count(*) AS k FROM f WHERE rule_id <> 'cross_http_url' GROUP BY 1 UNION ALL SELECT split_part(rule_id, '_', 1), 'syntax', count(*) FROM s GROUP BY 1)
SELECT v.*, CASE WHEN enabled THEN coalesce(k, 0) ELSE 0 END AS n_findings FROM v LEFT JOIN c ON c.language IS NOT DISTINCT FROM v.language AND c.kind = v.kind""",
    "sources",
)


def _routes(m):
    """Files of routes in three languages: a public one, one with a marker, one with an import that sounds like it."""
    k = F.col("p_partkey")
    route = F.when(k % 3 == 0, "/login").otherwise(F.concat(F.lit("/u"), k.cast("string")))
    text = F.when(k % 4 == 0, F.concat(F.lit("@app.route('"), route, F.lit("')\ndef f(): pass"))).when(k % 4 == 1, F.concat(F.lit('@GetMapping("'), route, F.lit('")'))).otherwise(F.concat(F.lit("router.get('"), route, F.lit("', h)")))
    path = F.concat(F.lit("r"), k.cast("string"), F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".java").when(k % 4 == 2, ".ts").otherwise(".rs"))
    marked = F.concat(text, F.when(k % 5 == 0, "\nrequireAuth").otherwise(""))
    return m.table("part").select(k, path.alias("path"), marked.alias("text"), F.array(F.when(k % 7 == 0, "src/middleware/auth.js").otherwise("src/author.js")).alias("imports"))


query(
    "D11_missing_auth",
    lambda m: D.missing_auth(_routes(m), "p_partkey", "path", "text", "imports").select("p_partkey", "routes"),
    "SELECT p_partkey, ['/u' || p_partkey] AS routes FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
)


def _credentials(m):
    size, hexes = F.col("p_size"), F.md5("p_name")
    value = F.when(size % 6 == 0, F.concat(F.lit("id = AKIA"), F.upper(F.substring(hexes, 1, 16)))).when(size % 6 == 1, F.concat(F.lit("x = 'ghp_"), F.substring(F.concat(hexes, hexes), 1, 36), F.lit("'"))).when(size % 6 == 2, "db_password = 'abcdefghijklmnopqrstuvwxyz0123456789'")
    value = F.coalesce(value, F.when(size % 6 == 3, "api_key = 'aaaaaaaaaaaaaaaaaaaaaaaaaa'").when(size % 6 == 4, "-----BEGIN RSA PRIVATE KEY-----").otherwise("plain = 'abcdefghijklmnopqrstuvwxyz0123456789'"))
    return m.table("part").select("p_partkey", F.concat(F.lit("first line\n"), value).alias("text"))


query(
    "D12_secrets",
    lambda m: D.secrets(_credentials(m), "p_partkey", "text"),
    "SELECT p_partkey, 2 AS line, CASE p_size % 6 WHEN 0 THEN 'aws_access_key' WHEN 1 THEN 'github_token' WHEN 2 THEN 'generic_entropy' ELSE 'private_key' END AS rule FROM part WHERE p_size % 6 NOT IN (3, 5)",
)
query("D12_document_secrets", lambda m: D.secrets(m.table("documents"), "doc_id", "text"))


def _functions(m):
    """One function in each of seven languages, with a decision more where the key says so."""
    k, size = F.col("p_partkey"), F.col("p_size")
    more = lambda a: F.when(size % 2 == 0, a).otherwise("")
    texts = {
        "js": F.concat(F.lit("const f = (a) => {\n  if (a && b) { return 'if (x) || y'; } // for while\n"), more("  while (a) { a--; }\n"), F.lit("  return a ? 1 : 2;\n};\n")),
        "py": F.concat(F.lit("def f(a):\n    # if for while\n    if a and b or c:\n        return 1\n"), more("    for x in a:\n        pass\n"), F.lit("    return 1 if a else 2\n")),
        "java": F.concat(F.lit("class A {\n  int f(int a) {\n    if (a > 1 || a < 0) { return 1; }\n"), more("    for (;;) { }\n"), F.lit("    return 0;\n  }\n}\n")),
        "go": F.concat(F.lit("func f(a int) int {\n\tif a > 1 && a < 9 {\n\t\treturn 1\n\t}\n"), more("\tfor {\n\t}\n"), F.lit("\treturn 0\n}\n")),
        "rs": F.concat(F.lit("fn f(a: i32) -> i32 {\n    if a > 1 && a < 9 { return 1; }\n"), more("    loop { }\n"), F.lit("    0\n}\n")),
        "rb": F.concat(F.lit("def f(a)\n  return 1 if a && b # while\n"), more("  while a\n  end\n"), F.lit("  0\nend\n")),
        "cs": F.concat(F.lit("class A {\n  public int F(int a) {\n    if (a > 1 || a < 0) { return 1; }\n"), more("    while (a > 0) { a--; }\n"), F.lit("    return 0;\n  }\n}\n")),
    }
    text, path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (ending, own) in enumerate(texts.items()):
        text, path = F.when(k % 7 == i, own).otherwise(text), F.when(k % 7 == i, f"f.{ending}").otherwise(path)
    return m.table("part").select("p_partkey", path.alias("path"), text.alias("text"))


query("D13_complexity", lambda m: _functions(m).select("p_partkey", code.complexity("path", "text").alias("complexity")), "SELECT p_partkey, (CASE p_partkey % 7 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 3 END) + (p_size % 2 = 0)::INT AS complexity FROM part")
