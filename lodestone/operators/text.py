"""Text operators: chunking, imports, manifests' versions, ranges and stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import code
from lodestone.storage import written

#: Language by file extension.
LANGUAGE_BY_EXTENSION = (("js", "javascript"), ("jsx", "javascript"), ("ts", "typescript"), ("tsx", "typescript"), ("py", "python"), ("cs", "csharp"), ("go", "go"), ("java", "java"), ("rs", "rust"), ("rb", "ruby"))

#: Folders that scans leave out.
SKIPPED = ("node_modules", ".git", "dist", "build", "vendor", "__pycache__", "target", "bin", "obj")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def language_of(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION for x in kv]), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def skipped(path: Column) -> Column:
    """Whether any folder of the path is left out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))


def clean_version(version: Column) -> Column:
    """A version without its range operator."""
    return F.trim(F.regexp_replace(F.trim(version), r"^[\^~>=<]+\s*", ""))


def packed_lines(df: DataFrame, key: str, text: str, budget: int = 450) -> DataFrame:
    """(key, part, start_line, end_line): lines, each with its line break, packed greedily into parts of at most ``budget``
    estimated tokens; a longer line has a part of its own. A fold over the array of lines, as the state starts anew with each part."""
    sizes = F.transform(F.split(text, "\n"), lambda x: F.ceil((F.length(x) + 1) / 4).cast("int"))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("sum"), F.lit(0).alias("at"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["at"] > 0) & (acc["sum"] + n > budget)
        return F.struct(F.when(full, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"]).alias("ends"), F.when(full, n).otherwise(acc["sum"] + n).cast("int").alias("sum"), (acc["at"] + 1).cast("int").alias("at"))

    ends = F.aggregate(sizes, start, step, lambda acc: F.concat(acc["ends"], F.array(acc["at"])))
    rows = df.where(F.col(text).isNotNull()).select(key, ends.alias("ends")).select(key, F.posexplode("ends").alias("part", "end_line"), "ends")
    return rows.select(key, "part", (F.coalesce(F.get("ends", F.col("part") - 1), F.lit(0)) + 1).alias("start_line"), "end_line")


def chunks(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, start_line, end_line, content): short files whole, others by their definitions and the gaps between them."""
    return df.select(key, F.inline(code.code_chunks(F.col(path), F.coalesce(text, F.lit("")))))


def excerpt(text: Column, lines: int = 8, characters: int = 200) -> Column:
    """The first lines, at most so many characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, characters)


def line_range(text: Column, start: int, end: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def stitched(chunks: DataFrame, key: str, order: str, text: str, separator: str) -> DataFrame:
    """The chunks of each key joined in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return chunks.groupBy(key).agg(F.array_join(parts, separator).alias("content"))


def dependency_text(text: Column) -> list[Column]:
    """package, version and severity out of ``Package NAME@VERSION ... (SEVERITY)``."""
    return [F.regexp_extract(text, r"([\w@/.-]+)@([\w.-]+)", 1).alias("package_name"), F.regexp_extract(text, r"([\w@/.-]+)@([\w.-]+)", 2).alias("pkg_version"), F.lower(F.regexp_extract(text, r"\((\w+)\)", 1)).alias("severity")]


def imports(df: DataFrame, path: str, text: str) -> DataFrame:
    """(from_path, kind, name, symbols): what each file imports, unresolved."""
    return df.select(F.col(path).alias("from_path"), F.inline(code.imports(F.col(path), F.coalesce(text, F.lit("")))))


def folder_of(path: Column) -> Column:
    """The folder with a slash at its end; empty for a file at the root."""
    return F.regexp_replace(path, r"[^/]*$", "")


def normal_path(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` segments; what would lead above the root stays at it."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


#: Endings that a script's relative import may leave out, in the order that they are tried.
SCRIPT_ENDINGS = ("", ".tsx", ".ts", ".jsx", ".js", "/index.tsx", "/index.ts", "/index.js")


def import_candidates(found: DataFrame) -> DataFrame:
    """(from_path, kind, name, place, to_path): the paths that a script's or Python's import may mean, the first that exists wins."""
    own = found.withColumns({"__language": language_of(F.col("from_path")), "__folder": folder_of(F.col("from_path"))})
    name, folder = F.col("name"), F.col("__folder")
    # scripts: relative names only
    base = normal_path(F.concat(folder, name))
    script = F.when(name.rlike(r"^\.\.?/"), F.array(*[F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS]))
    # Python: one dot is the file's folder, each further dot one above it; else below the root or the file's folder
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    up = F.concat(folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    rest = F.replace(F.expr("substring(name, length(regexp_extract(name, '^([.]*)', 1)) + 1)"), F.lit("."), F.lit("/"))
    near = normal_path(F.concat(up, rest))
    below = F.replace("name", F.lit("."), F.lit("/"))
    within = normal_path(F.concat(folder, below))
    relative = F.array(F.concat(near, F.lit(".py")), F.when(near == "", "__init__.py").otherwise(F.concat(near, F.lit("/__init__.py"))))
    absolute = F.array(F.concat(below, F.lit(".py")), F.concat(within, F.lit(".py")), F.concat(below, F.lit("/__init__.py")), F.concat(within, F.lit("/__init__.py")))
    every = F.when(F.col("__language").isin("javascript", "typescript"), script).when(F.col("__language") == "python", F.when(dots > 0, relative).otherwise(absolute))
    return own.select("from_path", "kind", "name", F.posexplode(every).alias("place", "to_path"))


def resolve_imports(files: DataFrame, found: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """(from_path, name, to_path): imports against the files (file_path); one that no rule resolves gives no row.

    ``found``: (from_path, kind, name). Scripts and Python try candidates in order. C# asks ``namespaces`` (namespace,
    file_path), and gets all files of one. Go: a file of that name at the root, then the name as a path, else every file
    below a folder of its last segment. Java, Rust and Ruby: by the file name, the least path first; Rust modules and
    relative requires by the importing file's folder. All joins are by equality, on whole paths, file names or folders.
    """
    f = files.select(F.col("file_path").alias("to_path")).distinct()
    i = found.select("from_path", F.coalesce("kind", F.lit("import")).alias("kind"), "name").distinct()
    met = import_candidates(i).join(f, "to_path").groupBy("from_path", "name").agg(F.min_by("to_path", "place").alias("to_path"))
    out = met.select("from_path", "name", "to_path")
    if namespaces is not None:
        own = i.where(language_of(F.col("from_path")) == "csharp").withColumnRenamed("name", "namespace")
        out = out.unionByName(own.join(namespaces.select("namespace", F.col("file_path").alias("to_path")).distinct(), "namespace").select("from_path", F.col("namespace").alias("name"), "to_path"))
    return out.unionByName(resolve_packages(f, i))


def _folders(path: Column) -> Column:
    """Names of the folders that a path is below."""
    return F.array_distinct(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))


def _go(files: DataFrame, go: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Go's imports: (from_path, name, to_path) of those that name a file, (from_path, name, last) of the rest, by their last segment."""
    go = go.select("from_path", "name", F.element_at(F.split("name", "/"), -1).alias("last"))
    exact = go.select("from_path", "name", F.posexplode(F.array(F.concat("last", F.lit(".go")), F.concat("name", F.lit(".go")))).alias("place", "to_path"))
    exact = exact.join(files, "to_path").groupBy("from_path", "name").agg(F.min_by("to_path", "place").alias("to_path"))
    return exact, go.join(exact.select("from_path", "name"), ["from_path", "name"], "left_anti")


def resolve_packages(files: DataFrame, found: DataFrame) -> DataFrame:
    """The part of ``resolve_imports`` for Go, Java, Rust and Ruby, over (to_path) and (from_path, kind, name)."""
    language = language_of(F.col("from_path"))
    named = files.withColumn("file", F.element_at(F.split("to_path", "/"), -1))
    exact, asked = _go(files, found.where(language == "go"))
    rest = asked.join(files.select("to_path", F.explode(_folders(F.col("to_path"))).alias("last")), "last")
    # by file name; for Ruby an ending of the whole name goes before the file name alone
    java = found.where(language == "java").select("from_path", "name", F.concat(F.element_at(F.split("name", r"\."), -1), F.lit(".java")).alias("tail"))
    parts = F.filter(F.split("name", "::"), lambda p: ~p.isin("crate", "super", "self"))
    rust = found.where((language == "rust") & (F.col("kind") == "use")).select("from_path", "name", F.concat(F.try_element_at(parts, F.lit(-1)), F.lit(".rs")).alias("tail")).where("tail is not null")
    ruby = found.where((language == "ruby") & (F.col("kind") == "require")).select("from_path", "name", F.when(F.col("name").endswith(".rb"), F.col("name")).otherwise(F.concat("name", F.lit(".rb"))).alias("tail"))
    tails = java.unionByName(rust).unionByName(ruby).withColumn("file", F.element_at(F.split("tail", "/"), -1)).join(named, "file")
    whole = F.concat(F.lit("/"), "to_path").endswith(F.concat(F.lit("/"), "tail"))
    by_name = tails.groupBy("from_path", "name").agg(F.min_by("to_path", F.struct(~whole, "to_path")).alias("to_path"))
    # by the folder of the importing file
    folder = folder_of(F.col("from_path"))
    mod = found.where((language == "rust") & (F.col("kind") == "mod")).select("from_path", "name", F.posexplode(F.array(F.concat("name", F.lit(".rs")), F.concat("name", F.lit("/mod.rs")))).alias("place", "tail"))
    relative = found.where((language == "ruby") & (F.col("kind") == "require_relative")).select("from_path", "name", F.lit(0).alias("place"), F.when(F.col("name").endswith(".rb"), F.col("name")).otherwise(F.concat("name", F.lit(".rb"))).alias("tail"))
    near = mod.unionByName(relative).withColumn("to_path", normal_path(F.concat(folder, "tail"))).join(files, "to_path").groupBy("from_path", "name").agg(F.min_by("to_path", "place").alias("to_path"))
    columns = ["from_path", "name", "to_path"]
    return exact.select(columns).unionByName(rest.select(columns)).unionByName(by_name.select(columns)).unionByName(near.select(columns))


#: Importing files, and files of a folder or namespace, in a tile of pairs; pairs in a task.
TILE, TASK = 1024, 1 << 22


def _members(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(from_path, to_path), once each: all files of the groups (folders, namespaces) that a file asks for.

    ``asked``: (from_path, of, all, without): a group, all that its file asks for, and files that don't count; ``held``:
    (to_path, of, all): a file's group and all that it is in. A pair is made in the least group that both have, so pairs are
    never shuffled; each group's pairs are dealt into tiles of one size, so a large folder takes more tasks.
    """
    count = lambda df, name: df.groupBy("of").agg(F.count("*").alias(name))
    sizes = written(count(asked, "n_from").join(count(held, "n_to"), "of"), "group-sizes")
    pairs = sizes.agg(F.sum(F.col("n_from").cast("double") * F.col("n_to"))).head()[0] or 0  # one number
    n = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -int(-pairs // TASK))
    tiles = sizes.select("of", F.ceil(F.col("n_from") / TILE).alias("x"), F.ceil(F.col("n_to") / TILE).alias("y"))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).alias(f"{k}_at")
    place = lambda path, k: F.pmod(F.xxhash64(path), F.col(k)).alias(f"{k}_at")
    at = ["of", "x_at", "y_at"]
    left = asked.join(tiles, "of").select("of", "from_path", F.when(F.size("all") > 1, F.col("all")).alias("all"), "without", place("from_path", "x"), each("y"))
    right = held.join(tiles, "of").select("of", "to_path", F.col("all").alias("also"), each("x"), place("to_path", "y"))
    met = left.repartition(n, *at).join(right.repartition(n, *at), at)
    least = F.array_min(F.array_intersect("all", "also"))
    return met.where((F.col("all").isNull() | (least == F.col("of"))) & (F.col("without").isNull() | ~F.array_contains("without", F.col("to_path")))).select("from_path", "to_path")


def import_edges(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """(from_path, to_path, symbols): the import graph of (path, text); scripts' edges carry the names that they import.

    The same edges as by ``resolve_imports``; those into all files of a folder (Go) or namespace (C#), which have no names, aren't grouped by pair.
    """
    language = lambda c: F.coalesce(language_of(F.col(c)), F.lit(""))
    found = written(imports(files, path, text), "imports")
    spaces = files.select(F.col(path).alias("to_path"), F.explode(code.exports(F.col(path), F.coalesce(text, F.lit("")))).alias("of")).where(language("to_path") == "csharp")
    paths = files.select(F.col(path).alias("to_path")).distinct()
    one = found.where(~language("from_path").isin("go", "csharp"))
    met = resolve_imports(paths.withColumnRenamed("to_path", "file_path"), one).join(one.select("from_path", "name", "symbols"), ["from_path", "name"])
    met = met.groupBy("from_path", "to_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"))
    exact, folders = _go(paths, found.where(language("from_path") == "go").select("from_path", "name").distinct())
    # groups by language, since a namespace may have a folder's name
    group = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")).alias("of")
    of_go = folders.select("from_path", group("go", "last"))
    of_cs = found.where(language("from_path") == "csharp").select("from_path", group("csharp", "name"))
    asked = of_go.union(of_cs).groupBy("from_path").agg(F.collect_set("of").alias("all"))
    asked = asked.join(exact.groupBy("from_path").agg(F.collect_set("to_path").alias("without")), "from_path", "left")
    asked = written(asked.select("from_path", F.explode("all").alias("of"), "all", "without"), "asked-groups")
    in_folders = paths.select("to_path", F.transform(_folders(F.col("to_path")), lambda x: F.struct(F.lit("go").alias("kind"), x.alias("name"))).alias("all"))
    in_spaces = spaces.select("to_path", group("csharp", "of")).groupBy("to_path").agg(F.collect_set("of").alias("all"))
    held = written(in_folders.union(in_spaces).select("to_path", F.explode("all").alias("of"), "all"), "group-members")
    plain = exact.select("from_path", "to_path").distinct().union(_members(asked, held))
    return met.union(plain.withColumn("symbols", F.array().cast("array<string>")))


def namespace_files(exports: DataFrame) -> DataFrame:
    """(namespace, files) of (file_path, exports)."""
    return exports.select("file_path", F.explode("exports").alias("namespace")).groupBy("namespace").agg(F.sort_array(F.collect_set("file_path")).alias("files"))


def imported_symbols(statement: Column) -> Column:
    """Local names between the braces of an import: of a rename the new name."""
    inner = F.regexp_extract(statement, r"\{([^}]*)\}", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(F.regexp_replace(s, r"^.*\s+as\s+", ""))), lambda s: s != "")
