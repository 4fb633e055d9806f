"""What needs a reading of source text: complexity, syntax rules, imports, exports and spans of definitions.

Python goes through its own ``ast``. The other languages are read as text whose comments and strings are blanked out
in place, so positions and lines stay: keywords, braces and calls then stand for syntax. That is an approximation where
a grammar would be needed (regular expression literals, generics, macros). Every function is total: a text that can't be
read gives the least result.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Language by extension, as the scans of source text name them.
LANGUAGES = {"js": "js", "jsx": "js", "ts": "js", "tsx": "js", "py": "py", "cs": "cs", "go": "go", "java": "java", "rs": "rs", "rb": "rb"}

_HASH = {"py", "rb"}
_QUOTES = {"js": "\"'`", "go": "\"`", "rs": '"', "java": "\"'", "cs": "\"'", "rb": "\"'", "py": "\"'"}


def language_of(path: str | None) -> str | None:
    return LANGUAGES.get((path or "").rpartition(".")[2].lower())


def blanked(text: str, language: str, strings: bool = True) -> str:
    """The text with comments and, if asked, the insides of strings as blanks; line breaks stay."""
    out, i, n = list(text), 0, len(text)
    quotes, hashes = _QUOTES.get(language, "\"'"), language in _HASH

    def clear(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if not hashes and text.startswith("//", i) or hashes and c == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
            clear(i, end)
            i = end
        elif not hashes and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            clear(i, end)
            i = end
        elif c in quotes:
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            if strings:
                clear(i + 1, j)
            i = j + 1
        else:
            i += 1
    return "".join(out)


def _parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


# --- complexity: decisions plus functions, one at least
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
#: Keywords that decide, by language, and patterns that open a function.
_KEYWORDS = {
    "js": ("if", "else", "do", "case", "catch"),
    "cs": ("if", "else", "do", "case", "default", "catch"),
    "java": ("if", "else", "for", "while", "do", "case", "default", "catch"),
    "go": ("if", "for", "case"),
    "rs": ("if", "else", "for", "while", "loop"),
    "rb": ("if", "elsif", "unless", "when", "rescue", "for", "while", "until"),
}
_FUNCTIONS = {
    "js": r"\bfunction\b|=>|^[ \t]*(?:(?:async|static|get|set|public|private|protected)\s+)*(?!(?:if|for|while|switch|catch|function|return|do|else)\b)[A-Za-z_$][\w$]*\s*\([^()]*\)\s*(?::[^{=;]+)?\{",
    "cs": r"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|extern|new|partial)\s+)*(?!(?:if|for|foreach|while|switch|catch|using|lock|return|new|else|do)\b)(?:[\w<>\[\],.?]+\s+)?[A-Za-z_]\w*\s*\([^()]*\)\s*(?:\{|=>)",
    "java": r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?!(?:if|for|while|switch|catch|return|new|else|do|try)\b)(?:[\w<>\[\],.?]+\s+)?[A-Za-z_]\w*\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{",
    "go": r"\bfunc\b",
    "rs": r"\bfn\s+\w+|(?<=[(,=])\s*(?:move\s+)?\|[^|\n]*\|",
    "rb": r"\bdef\b|\{\s*\||\bdo\b",
}


def complexity_of(source: str | None, language: str = "py") -> int | None:
    """Decisions plus functions (one at least); None for a language that isn't known or Python that doesn't parse."""
    if language == "py":
        tree = _parsed(source)
        if tree is None:
            return None
        nodes = list(ast.walk(tree))
        booleans = sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
        return sum(isinstance(n, _DECISIONS) for n in nodes) + booleans + max(1, sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in nodes))
    if language not in _KEYWORDS:
        return None
    text = blanked(source or "", language)
    count = lambda p: len(re.findall(p, text, re.M))
    decisions = sum(count(rf"(?<![\w$.@]){k}(?![\w$])") for k in _KEYWORDS[language])
    if language in ("js", "cs"):
        decisions += count(r"(?<![\w$.])for\s*\((?![^;()]*\b(?:of|in)\b[^;]*\))") + max(0, count(r"(?<![\w$.])while(?![\w$])") - count(r"(?<![\w$.])do(?![\w$])"))
    if language == "java":
        decisions -= count(r"(?<![\w$.])do(?![\w$])")  # its while is counted
    if language == "rs":
        decisions += count(r"=>")
    if language in ("js", "cs", "java"):
        decisions += count(r"(?<!\?)\?(?![.?:)>,\]])[^;\n]*?:")
    if language == "cs":
        decisions += count(r"\?\.")
    decisions += count(r"&&|\|\|") + (count(r"(?<!\w)(?:and|or)(?!\w)") if language == "rb" else 0)
    return decisions + max(1, count(_FUNCTIONS[language]))


# --- rules over syntax
#: Calls and parts of syntax that the rules without a line pattern report, for languages read as text.
_SYNTAX = {
    "js": (
        ("js_eval", r"(?<![\w$.])eval\s*\("),
        ("js_new_function", r"\bnew\s+Function\b"),
        ("js_dangerous_inner_html", r"\bdangerouslySetInnerHTML\b\s*="),
        ("js_exec_template_literal", r"\.(?:exec|execSync|spawn|spawnSync)\s*\(\s*`"),
        ("js_require_non_literal", r"(?<![\w$.])require\s*\(\s*[A-Za-z_$][\w$]*\s*\)"),
        ("js_document_write", r"(?<![\w$.])document\s*\.\s*write\b"),
    ),
    "cs": (
        ("cs_process_start_concat", r"\.Start\s*\((?:[^()]*,)?[^(),]*\+"),
        ("cs_sql_concat", r"\bnew\s+SqlCommand\s*\((?:[^()]*,)?[^(),]*\+"),
    ),
}


def syntax_findings_of(path: str | None, source: str | None) -> list[dict]:
    """(rule_id, line) of the syntax rules of a file's language, in the order of lines."""
    language = language_of(path)
    if language == "py":
        tree, out = _parsed(source), []
        for n in ast.walk(tree) if tree else ():
            if not isinstance(n, ast.Call):
                continue
            f = n.func
            if isinstance(f, ast.Name) and f.id in ("eval", "exec"):
                out.append((f.lineno, f"py_{f.id}"))
            if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "pickle" and f.attr in ("load", "loads"):
                out.append((f.value.lineno, "py_pickle_loads"))
            out += [(k.value.lineno, "py_subprocess_shell_true") for k in n.keywords if k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True]
    else:
        text = blanked(source or "", language or "")
        out = [(text.count("\n", 0, m.start()) + 1, rule) for rule, p in _SYNTAX.get(language, ()) for m in re.finditer(p, text)]
    return [{"rule_id": rule, "line": line} for line, rule in sorted(out)]


# --- spans of definitions
def definition_spans(path: str | None, source: str) -> list[tuple[int, int, int]]:
    """(offset, end offset, first line) of definitions, whole module first for Python; the languages that aren't known have none.

    Python: module, functions and classes by syntax. Others: from a line that opens a function, class or method to the
    brace that closes it.
    """
    language, out = language_of(path), []
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    if language == "py":
        tree = _parsed(source)
        if tree is None:
            return []
        lines = source.split("\n")
        first = len(source) - len(source.lstrip())
        out.append((first, len(source), source.count("\n", 0, first) + 1))
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                chars = lambda line, col: starts[line - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore"))
                out.append((chars(n.lineno, n.col_offset), chars(n.end_lineno, n.end_col_offset), n.lineno))
        return sorted(out, key=lambda s: (s[0], -s[1]))
    if language not in ("js", "cs"):
        return []
    text = blanked(source, language)
    opens = _FUNCTIONS[language] + r"|^[ \t]*(?:(?:export|default|public|private|protected|internal|static|abstract|sealed|partial)\s+)*class\s+\w+" + (r"|^[ \t]*export\s+(?:default\s+)?(?:const|let|var|interface|enum|type)\b" if language == "js" else "")
    for m in re.finditer(opens, text, re.M):
        at, depth = text.find("{", m.start()), 0
        stop = text.find(";", m.end())
        if at < 0 or 0 <= stop < at:
            continue
        for k in range(at, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if not depth:
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                out.append((begin, k + 1, text.count("\n", 0, begin) + 1))
                break
    return sorted(set(out), key=lambda s: (s[0], -s[1]))


def _packed(lines: list[str], first: int, budget: int) -> Iterator[tuple[int, int, str]]:
    """Lines packed greedily into parts of at most ``budget`` estimated tokens."""
    own, used = [], 0
    for i, line in enumerate(lines):
        size = -(-(len(line) + 1) // 4)
        if own and used + size > budget:
            yield first + i - len(own), first + i - 1, "\n".join(own)
            own, used = [], 0
        own.append(line)
        used += size
    if own:
        yield first + len(lines) - len(own), first + len(lines) - 1, "\n".join(own)


def chunks_of(path: str | None, source: str | None, short: int = 50, most: int = 500, least: int = 5, budget: int = 450) -> list[dict]:
    """(start_line, end_line, content): a short file whole; else its definitions of at least ``least`` lines and the gaps
    between them, each cut into parts where it has more than ``most`` estimated tokens. A span comes once."""
    if not source or not source.strip():
        return []
    lines, found = source.split("\n"), []
    if len(lines) <= short:
        found = [(1, len(lines), source)] if -(-len(source) // 4) <= most else list(_packed(lines, 1, budget))
    else:
        for a, b, line in definition_spans(path, source):
            text = source[a:b]
            if text.count("\n") + 1 < least:
                continue
            found += _packed(text.split("\n"), line, budget) if -(-len(text) // 4) > most else [(line, line + text.count("\n"), text)]
        covered = [False] * (len(lines) + 2)
        for a, b, _ in found:
            covered[a : b + 1] = [True] * (b + 1 - a)
        at = 1
        while at <= len(lines):
            end = at
            while end <= len(lines) and not covered[end]:
                end += 1
            if end > at and "".join(lines[at - 1 : end - 1]).strip():
                found += _packed(lines[at - 1 : end - 1], at, budget)
            at = end + 1
    first: dict[tuple[int, int], str] = {}
    for a, b, text in found:
        first.setdefault((a, b), text.strip())
    return [{"start_line": a, "end_line": b, "content": text} for (a, b), text in sorted(first.items())]


# --- imports and exports
_JS_STRING = r"""(?P<quote>['"])(?P<name>(?:(?!(?P=quote))[^\n\\])+)(?P=quote)"""
_JS_IMPORTS = (
    rf"(?<![\w$.])import\s+(?P<what>[\w$*{{}},\s]+?\s+from\s+)?{_JS_STRING}",
    rf"(?<![\w$.])export\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{{[^}}]*\}})\s+from\s+{_JS_STRING}",
    rf"(?<![\w$.])import\s*\(\s*{_JS_STRING}",
    rf"(?<![\w$.])require\s*\(\s*{_JS_STRING}",
)


def _symbols(what: str) -> list[str]:
    """Local names of an import clause: of a rename the new name."""
    out = []
    braces = re.search(r"\{([^}]*)\}", what)
    for part in [*re.sub(r"\{[^}]*\}", "", what).split(","), *(braces[1].split(",") if braces else ())]:
        name = re.sub(r"^type\s+", "", part.strip()).rpartition(" as ")[2].strip()
        if re.fullmatch(r"[A-Za-z_$][\w$]*", name) and name not in ("from", "type"):
            out.append(name)
    return out


def imports_of(path: str | None, source: str | None) -> list[dict]:
    """(kind, name, symbols) of a file's imports, each name once, in the order of the text.

    Kinds: ``import``, and for Rust ``mod`` and ``use``, for Ruby ``require`` and ``require_relative``.
    """
    language, text, out = language_of(path), source or "", {}

    def add(kind: str, name: str, symbols: list[str] = ()) -> None:
        held = out.setdefault((kind, name), [])
        held += [s for s in symbols if s not in held]

    if language == "py":
        tree = _parsed(source)
        for n in sorted((n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset)) if tree else ():
            if isinstance(n, ast.Import):
                for a in n.names:
                    add("import", a.name)
            else:
                add("import", "." * n.level + (n.module or ""))
    elif language == "js":
        kept, outside = blanked(text, language, strings=False), blanked(text, language)
        found = ((m.start(), k, m) for k, p in enumerate(_JS_IMPORTS) for m in re.finditer(p, kept))
        for _, k, m in sorted(x for x in found if not outside[x[0]].isspace()):  # not within a string
            add("import", m["name"], _symbols(re.sub(r"\s+from\s+$", "", m["what"])) if k == 0 and m["what"] else ())
    elif language == "cs":
        for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([A-Za-z_][\w.]*)\s*;", blanked(text, language), re.M):
            add("import", m[1])
    elif language == "go":
        kept = blanked(text, language, strings=False)
        for block in re.finditer(r"^\s*import\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?[\"`][^\"`\n]+[\"`]))", kept, re.M):
            for m in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", block[1] or block[2] or ""):
                add("import", m[1])
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", blanked(text, language), re.M):
            add("import", m[1])
    elif language == "rs":
        kept = blanked(text, language)
        for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:mod\s+(\w+)|use\s+([\w:]+)\s*;)", kept, re.M):
            add("mod" if m[1] else "use", m[1] or m[2])
    elif language == "rb":
        for m in re.finditer(r"""^\s*(require|require_relative)\s*\(?\s*['"]([^'"\n]+)['"]""", blanked(text, language, strings=False), re.M):
            add(m[1], m[2])
    return [{"kind": kind, "name": name, "symbols": symbols} for (kind, name), symbols in out.items()]


def exports_of(path: str | None, source: str | None) -> list[str]:
    """Names that a file gives away: namespaces and types of C#, packages of Java, definitions of Python, exports of scripts."""
    language, text = language_of(path), source or ""
    if language == "py":
        tree = _parsed(source)
        found = [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if tree else []
    else:
        patterns = {
            "cs": (r"^\s*namespace\s+([\w.]+)\s*(?:\{|$)", r"\b(?:class|interface)\s+(\w+)"),
            "java": (r"^\s*package\s+([\w.]+)\s*;",),
            "js": (r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let)\s+([\w$]+)",),
        }.get(language, ())
        kept = blanked(text, language or "")
        found = [m[1] for p in patterns for m in re.finditer(p, kept, re.M)]
        if language == "js":
            for m in re.finditer(r"\bexport\s*\{([^}]*)\}", kept):
                found += [x for part in m[1].split(",") for x in re.split(r"\s+as\s+", part.strip()) if x]
    return sorted(set(found))


# --- the same as functions of columns
_CHUNK = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("content", T.StringType())]))
_IMPORT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("symbols", T.ArrayType(T.StringType()))]))
_FINDING = T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("line", T.IntegerType())]))


def _pairs(f):
    return lambda path, source: pd.Series([f(p, s) for p, s in zip(path, source)], index=path.index)


@F.pandas_udf(T.IntegerType())
def complexity(path: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([complexity_of(s, language_of(p) or "") for p, s in zip(path, source)], index=path.index, dtype="Int32")


@F.pandas_udf(_FINDING)
def syntax_findings(path: pd.Series, source: pd.Series) -> pd.Series:
    return _pairs(syntax_findings_of)(path, source)


@F.pandas_udf(_CHUNK)
def code_chunks(path: pd.Series, source: pd.Series) -> pd.Series:
    return _pairs(chunks_of)(path, source)


@F.pandas_udf(_IMPORT)
def imports(path: pd.Series, source: pd.Series) -> pd.Series:
    return _pairs(imports_of)(path, source)


@F.pandas_udf(T.ArrayType(T.StringType()))
def exports(path: pd.Series, source: pd.Series) -> pd.Series:
    return _pairs(exports_of)(path, source)
