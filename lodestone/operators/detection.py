"""Findings and scores over files, reviews and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import patterns as P
from lodestone.operators.aggregates import percentile_90


def god_files(nodes: DataFrame) -> DataFrame:
    """Files that many depend on, that are very complex, or that are long and depended on; high where two hold."""
    n = nodes.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    rows = nodes.crossJoin(F.broadcast(n))  # one row
    inc, cx, loc = F.col("incoming_count"), F.coalesce("complexity_score", F.lit(0)), F.col("line_count")
    central = (inc >= 10) & (inc > 0.3 * F.col("n"))
    big = (cx > 30) | ((loc > 500) & (inc > 0.1 * F.col("n")))
    return rows.where(central | big).select("file_path", F.when(central & big, "high").otherwise("medium").alias("severity"))


def high_coupling(nodes: DataFrame) -> DataFrame:
    out = F.col("outgoing_count")
    return nodes.where(out > 15).select("file_path", F.when(out >= 30, "high").when(out >= 20, "medium").otherwise("low").alias("severity"))


#: Endings of files that start programs, and so may have no importers.
ENTRY_POINTS = ("index.js", "index.ts", "index.jsx", "index.tsx", "main.js", "main.ts", "main.py", "app.js", "app.ts", "app.py", "server.js", "server.ts", "__init__.py", "__main__.py", "main.go", "manage.py", "setup.py", "wsgi.py", "program.cs", "startup.cs")


def dead_code(nodes: DataFrame) -> DataFrame:
    """Files that nothing imports and that start nothing; namespaces hide imports of C#."""
    low = F.lower("file_path")
    entry = low.rlike("(" + "|".join(e.replace(".", r"\.") for e in ENTRY_POINTS) + ")$")
    return nodes.where((F.col("incoming_count") == 0) & (F.coalesce("language", F.lit("")) != "csharp") & ~entry & ~is_test_path(F.col("file_path"))).select("file_path")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text holds any of the patterns, as one expression."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def repo_path(path: Column) -> Column:
    """Forward slashes, single, without a drive and without one at the start."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), "^[A-Za-z]:/", "")
    return F.regexp_replace(F.regexp_replace(p, "^/+", ""), "/+", "/")


def is_test_path(path: Column) -> Column:
    """Test files by folder or by name; the endings of Java and C# keep their case."""
    p = repo_path(path)
    return p.rlike("|".join(f"(?:{x})" if exact else f"(?i:{x})" for x, exact in P.TEST_PATHS))


def untested_critical(nodes: DataFrame) -> DataFrame:
    """Source files without coverage whose complexity or incoming count reaches the 90th percentile of their repository."""
    own = nodes.where(F.col("is_test_file") == F.lit(False))
    cx = percentile_90(own, "complexity_score", ["repo_id"], "cx90")
    inc = percentile_90(own, "incoming_count", ["repo_id"], "in90")
    rows = own.join(cx, "repo_id").join(inc, "repo_id")
    critical = (F.coalesce("complexity_score", F.lit(0)) >= F.col("cx90")) | (F.coalesce("incoming_count", F.lit(0)) >= F.col("in90"))
    return rows.where(~F.coalesce("has_test_coverage", F.lit(False)) & critical).select("repo_id", "file_path")


#: Weight of an issue by severity; unknown ones weigh 1.
RISK_WEIGHTS = (("critical", 4), ("high", 3), ("medium", 2), ("low", 1))


def risk_scores(issues: DataFrame, transitive: DataFrame, churn: DataFrame, median: DataFrame) -> DataFrame:
    """weight * min(3, 1 + log10(1 + transitive dependents)) * churn, by the issue's first file.

    churn: 1 where unknown or the median is 0, else min(2, 1 + recent commits / median). ``transitive``: (file_path, n);
    ``churn``: (file_path, commits_in_last_30d); ``median``: one row.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RISK_WEIGHTS for x in kv]), F.col("severity")), F.lit(1))
    rows = issues.withColumn("file_path", F.element_at("file_paths", 1)).join(transitive, "file_path", "left").join(churn, "file_path", "left").crossJoin(F.broadcast(median))
    blast = F.least(F.lit(3.0), 1 + F.log10(1 + F.coalesce("n", F.lit(0))))
    moved = F.when(F.col("commits_in_last_30d").isNull() | (F.col("median") == 0), 1.0).otherwise(F.least(F.lit(2.0), 1 + F.col("commits_in_last_30d") / F.col("median")))
    return rows.select("id", weight.alias("weight"), F.round(blast, 6).alias("blast"), F.round(moved, 6).alias("churn"), F.round(weight * blast * moved, 4).alias("risk_score"))


def scan_language(path: Column) -> Column:
    """Language key of a path by its extension; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in P.SCAN_LANGUAGES for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def line_findings(df: DataFrame, key: str, path: str, text: str, disabled: tuple[str, ...] = (), rules: tuple = P.RULES) -> DataFrame:
    """(key, path, line, rule_id, severity, cwe): lines that a rule of the file's language, or of all, matches; once for a rule and line.

    Every line is read once, for all rules together. Plain http addresses are no finding in test files.
    """
    own = df.select(F.col(key).alias("__key"), F.col(path).alias("__path"), scan_language(F.col(path)).alias("__language"), F.posexplode(F.split(text, "\n")).alias("__at", "__line"))
    in_test = F.lit(False)
    for part in P.RULE_TEST_PARTS:
        in_test = in_test | F.col("__path").contains(part)
    found = []
    for rule, language, severity, cwe, pattern in rules:
        if pattern is None or rule in disabled:
            continue
        hit = F.col("__line").rlike(pattern) & (F.col("__language").isNotNull() if language is None else F.col("__language") == language)
        hit = hit & ~in_test if rule == "cross_http_url" else hit
        found.append(F.when(hit, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe"))))
    hits = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule_id:string,severity:string,cwe:string>>")
    return own.select(F.col("__key").alias(key), F.col("__path").alias(path), (F.col("__at") + 1).alias("line"), F.inline(hits))


def rule_catalogue(spark, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(rule_id, language, severity, cwe, kind, enabled) of all rules."""
    rows = [(r, lang, sev, cwe, "syntax" if pattern is None else "line", r not in disabled) for r, lang, sev, cwe, pattern in P.RULES]
    return spark.createDataFrame(rows, "rule_id string, language string, severity string, cwe string, kind string, enabled boolean")


def rule_usage(catalogue: DataFrame, findings: DataFrame) -> DataFrame:
    """The catalogue with ``n_findings`` of each rule; ``findings``: (rule_id)."""
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"))
    return catalogue.join(counts, "rule_id", "left").fillna(0, ["n_findings"])


def attack_surface(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, surface): ``source``, ``sink``, ``both`` or null; null for languages that the patterns don't know."""
    language, t = scan_language(F.col(path)), F.coalesce(F.col(text), F.lit(""))
    source = F.lit(False)
    for k, patterns in P.SOURCES.items():
        source = F.when(language == k, any_of(t, patterns)).otherwise(source)
    sink = language.isNotNull() & any_of(t, P.SINKS)
    return df.select(key, F.when(source & sink, "both").when(source, "source").when(sink, "sink").alias("surface"))


def route_paths(language: Column, text: Column) -> Column:
    """Distinct routes of a text, in the order of the patterns; an empty one is the root."""
    out = F.array().cast("array<string>")
    for k, patterns in P.ROUTE_PATHS.items():
        own = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda r: F.when(r == "", "/").otherwise(r)) for p in patterns])
        out = F.when(language == k, own).otherwise(out)
    return F.array_distinct(out)


def missing_auth(df: DataFrame, key: str, path: str, text: str, imports: str) -> DataFrame:
    """(key, path, routes) of route files without a sign of authentication in text or imports, unless all their routes are public.

    ``routes``: those that aren't public; empty where no route can be read from the text.
    """
    language, t = scan_language(F.col(path)), F.coalesce(F.col(text), F.lit(""))
    handles = F.lit(False)
    for k, patterns in P.ROUTE_FILES.items():
        handles = F.when(language == k, any_of(t, patterns)).otherwise(handles)
    imported = F.exists(F.coalesce(F.col(imports), F.array().cast("array<string>")), lambda i: any_of(i, tuple(f"(?i:{p})" for p in P.AUTH_IMPORTS)))
    routes = route_paths(language, t)
    private = F.filter(routes, lambda r: ~any_of(r, P.PUBLIC_ROUTES))
    flagged = handles & ~any_of(t, P.AUTH_MARKERS) & ~imported & ((F.size(routes) == 0) | (F.size(private) > 0))
    return df.where(flagged).select(key, path, private.alias("routes"))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def secrets(df: DataFrame, key: str, text: str, least_entropy: float = 4.5) -> DataFrame:
    """(key, line, rule): credentials by their public shapes, and assigned strings of high entropy. Values stay out of the result."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("__at", "__line"))
    shapes = [F.when(F.col("__line").rlike(pattern), F.lit(rule)) for rule, pattern in P.SECRETS]
    assigned = F.regexp_extract_all(F.col("__line"), F.lit(P.ASSIGNED_SECRET), F.lit(1))
    generic = F.when(F.exists(assigned, lambda v: entropy(v) > least_entropy), F.lit("generic_entropy"))
    return lines.select(key, (F.col("__at") + 1).alias("line"), F.explode(F.array_compact(F.array(*shapes, generic))).alias("rule"))


def coverage(nodes: DataFrame, edges: DataFrame, formal: DataFrame) -> DataFrame:
    """Covered if a test imports the file; a formal percentage, where there is one, decides instead."""
    tests = nodes.where("is_test_file").select(F.col("file_path").alias("from_path"))
    tested = edges.join(tests, "from_path", "left_semi").select(F.col("to_path").alias("file_path"), F.lit(True).alias("tested")).distinct()
    out = nodes.join(tested, "file_path", "left").join(formal, "file_path", "left")
    return out.select("file_path", F.coalesce(F.col("coverage_percentage") > 0, "tested", F.lit(False)).alias("covered"))


def coverage_path(path: Column) -> Column:
    """A reported path without the folders that build servers put before it."""
    p = F.regexp_replace(repo_path(path), "(?i)^home/runner/work/[^/]+/[^/]+/", "")
    p = F.regexp_replace(p, "(?i)^(github/workspace/|workspace/|build/|app/)", "")
    # the first such folder inside, only
    p = F.regexp_replace(p, "(?is)^(.*?)/(github/workspace|workspace|build|app)/(.*)$", "$1/$3")
    return F.regexp_replace(p, "^/+", "")


def match_coverage_paths(reported: DataFrame, files: DataFrame, root: str = "", candidates: int = 5, cap: int = 64) -> DataFrame:
    """(reported, file_path): exact, then below ``root``, then by a common ending of whole segments, else none.

    Of several endings the longest file path wins; of up to ``candidates`` equally long ones, the single one that is
    nearest by edit distance of the last ``cap`` characters. A suffix match shares the last segment, so the join is by equality.
    """
    base = root.strip("/") + "/" if root.strip("/") else ""
    r = reported.select("reported").distinct().withColumn("p", coverage_path(F.col("reported")))
    r = r.withColumn("name", F.element_at(F.split("p", "/"), -1))
    f = files.select("file_path", repo_path(F.col("file_path")).alias("q")).withColumn("name", F.element_at(F.split("q", "/"), -1))
    ending = F.col("p").endswith(F.concat(F.lit("/"), "q")) | F.col("q").endswith(F.concat(F.lit("/"), "p"))
    rank = F.when(F.col("p") == F.col("q"), 3).when(F.col("p") == F.concat(F.lit(base), "q"), 2).when(ending, 1)
    met = r.join(f, "name").withColumn("rank", rank).where("rank is not null")
    distance = F.levenshtein(F.right("p", F.lit(cap)), F.right(F.concat(F.lit("/" + base), "q"), F.lit(cap)))
    met = met.withColumns({"size": F.when(F.col("rank") == 1, F.length("q")).otherwise(0), "distance": F.when(F.col("rank") == 1, distance).otherwise(0)})
    w = Window.partitionBy("reported")
    top = met.withColumn("best", F.max(F.struct("rank", "size")).over(w)).where("rank = best.rank and size = best.size")
    top = top.withColumns({"n": F.count("*").over(w), "nearest": F.min("distance").over(w)})
    top = top.where(F.col("distance") == F.col("nearest")).withColumn("same", F.count("*").over(w))
    won = top.where((F.col("n") == 1) | (F.col("rank") > 1) | ((F.col("n") <= candidates) & (F.col("same") == 1)))
    won = won.groupBy("reported").agg(F.max("file_path").alias("file_path"))
    return reported.select("reported").distinct().join(won, "reported", "left")


def cvss_severity(score: Column) -> Column:
    return F.when(score < 4, "low").when(score <= 7, "medium").when(score > 7, "high")


def first_fixed(affected: Column, package: Column, ecosystem: Column) -> Column:
    """The first fixed version of a package in ``array<struct<package, ecosystem, fixed: array<string>>>``."""
    own = F.filter(affected, lambda a: (a["package"] == package) & (a["ecosystem"] == ecosystem))
    return F.try_element_at(F.flatten(F.transform(own, lambda a: a["fixed"])), F.lit(1))


def dependency_issues(deps: DataFrame) -> DataFrame:
    """A row for each vulnerability of each dependency."""
    return deps.select("id", "package_name", "pkg_version", F.explode("vulns").alias("v")).select("id", "package_name", "pkg_version", F.col("v.id").alias("vuln_id"), F.col("v.severity").alias("severity"))


def cache_split(keys: DataFrame, cache: DataFrame, on: list[str], as_of: str, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): entries of the last hours count."""
    fresh = cache.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))).select(*on).distinct()
    return keys.join(fresh, on, "left_semi"), keys.join(fresh, on, "left_anti")


def gate(reviews: DataFrame, fail_on: list[str]) -> DataFrame:
    """fails where a listed severity occurs, or no review is ready."""
    hit = F.lit(False)
    for s in fail_on:
        hit = hit | (F.coalesce(s, F.lit(0)) > 0)
    return reviews.withColumn("fails", ~F.coalesce(F.col("status") == "ready", F.lit(False)) | hit)


def review_event(counts: DataFrame, threshold: str) -> DataFrame:
    """REQUEST_CHANGES if a finding reaches the threshold, else COMMENT."""
    order = ("low", "medium", "high", "critical")
    hit = F.lit(False)
    for s in order[order.index(threshold) :]:
        hit = hit | (F.col(s) > 0)
    return counts.withColumn("event", F.when(hit, "REQUEST_CHANGES").otherwise("COMMENT"))


def new_in_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Issues that head has and base hasn't: god files (complexity over 30 or more than 500 lines) and coupling (over 15)."""
    kinds = lambda df: df.select("file_path", F.explode(F.filter(F.array(F.when((F.coalesce("complexity_score", F.lit(0)) > 30) | (F.col("line_count") > 500), "god_file"), F.when(F.col("outgoing_count") > 15, "high_coupling")), lambda x: x.isNotNull())).alias("type"))
    return kinds(head).join(kinds(base), ["file_path", "type"], "left_anti")


def version_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(package, old_version, new_version) of packages in both whose version differs."""
    return old.select("package_name", F.col("pkg_version").alias("old_version")).join(new.select("package_name", F.col("pkg_version").alias("new_version")), "package_name").where("old_version <> new_version")


def batch_key(ids: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.sort_array(ids), ","), 256), 1, 16)


def context_hash(text: Column, line: Column) -> Column:
    """SHA-256 of a line and its neighbours; lines count from 1."""
    start = F.greatest(F.lit(1), line - 1)
    return F.sha2(F.array_join(F.slice(F.split(text, "\n"), start.cast("int"), (line + 2 - start).cast("int")), "\n"), 256)


def finding_id(path: Column, line: Column, rule: Column, message: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, line.cast("string"), rule, message)), 1, 16)


def added_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, line_number, text) of the lines that a unified diff adds, with their numbers in the new file."""
    rows = patches.select(key, F.posexplode(F.split(patch, "\n")).alias("at", "t"))
    w = Window.partitionBy(key).orderBy("at")
    hunk = F.regexp_extract("t", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    rows = rows.withColumn("start", F.when(F.col("t").startswith("@@"), hunk.cast("int"))).withColumns({"base": F.last("start", True).over(w), "hunk": F.count("start").over(w)})
    own = Window.partitionBy(key, "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(F.col("start").isNull() & ~F.col("t").startswith("-") & ~F.col("t").startswith("\\"), 1).otherwise(0)
    rows = rows.withColumn("kept", kept).withColumn("line_number", F.col("base") + F.coalesce(F.sum("kept").over(own), F.lit(0)))
    return rows.where(F.col("base").isNotNull() & F.col("start").isNull() & F.col("t").startswith("+") & ~F.col("t").startswith("+++")).select(key, F.col("line_number").cast("int").alias("line_number"), F.expr("substring(t, 2)").alias("text"))


def audit_tokens(length: Column) -> Column:
    """512 + min(ceil(length / 4), 5000) + 1800 + 900."""
    return 512 + F.least(F.ceil(length / 4), F.lit(5000)) + 1800 + 900


def review_status(status: Column, critical: Column, high: Column, total: Column) -> Column:
    return F.when(status.isNull(), "not_reviewed").when(status != "ready", status).when(critical + high > 0, "blocking").when(total > 0, "findings").otherwise("clean")


def staleness(indexed: Column, head: Column) -> Column:
    """A note where the indexed commit isn't the head; shortened to seven characters."""
    return F.when(indexed.isNull(), "Index commit is unknown").when(indexed != head, F.concat(F.lit("Index is at "), F.substring(indexed, 1, 7), F.lit(", head is "), F.substring(head, 1, 7)))
