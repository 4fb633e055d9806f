"""Dependency manifests as rows. A parser gives (name, version, transitive) of one text; a broken text gives none."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Row = tuple[str, str, bool]


#: Starts of version strings that name a place and no version.
_PLACES = ("http", "file:", "workspace:", "git+")


def _bare(version: object) -> str:
    """A version without its range operator; empty for addresses and workspaces."""
    if not isinstance(version, str) or version.startswith(_PLACES):
        return ""
    return version.lstrip("^~>=<").strip()


def package_json(text: str) -> list[Row]:
    """Dependencies and those for development, with a version."""
    data = json.loads(text)
    groups = (data.get(g) or {} for g in ("dependencies", "devDependencies"))
    return [(name, own, False) for g in groups for name, version in g.items() if (own := _bare(version))]


def package_lock(text: str) -> list[Row]:
    """Versions 2 and 3 list packages by folder, version 1 nests them. Locked packages count as transitive."""
    data = json.loads(text)
    if packages := data.get("packages"):
        return [(key.rpartition("node_modules/")[2], entry["version"], True) for key, entry in packages.items() if key and entry.get("version")]
    out: list[Row] = []

    def walk(level: dict) -> None:
        for name, entry in level.items():
            if entry.get("version"):
                out.append((name, entry["version"], True))
            walk(entry.get("dependencies") or {})

    walk(data.get("dependencies") or {})
    return out


def yarn_lock(text: str) -> list[Row]:
    """Entries are a header of comma-separated specifiers at the margin and indented fields; an entry counts by its first
    specifier, whose name ends at the last part's at sign."""
    out, name = [], None
    for line in text.split("\n"):
        if not line.strip():
            name = None
        elif not line[0].isspace():
            first = line.rstrip(": ").split(",")[0].strip().strip('"')
            at = first.find("@", 1)
            name = first[:at] if at > 0 and not line.startswith("#") and " " not in first[:at] else None
        elif name and (field := line.split(None, 1)) and field[0] == "version" and len(field) > 1:
            out.append((name, field[1].strip().strip('"').split()[0], True))
            name = None
    return out


def requirements(text: str) -> list[Row]:
    """Pins only; comments and options are left out."""
    lines = (line.strip() for line in text.split("\n"))
    return [(m[1], m[2], False) for line in lines if (m := re.match(r"([\w.-]+)\s*==\s*([^\s;#]+)", line, re.A)) and not line.startswith("-")]


def pipfile_lock(text: str) -> list[Row]:
    data = json.loads(text)
    return [(name, version, False) for g in ("default", "develop") for name, entry in (data.get(g) or {}).items() if (version := (entry.get("version") or "").removeprefix("=="))]


def go_mod(text: str) -> list[Row]:
    """The first block of requirements, then those on a line of their own; versions keep their v."""
    out: list[Row] = []
    module = re.compile(r"(\S+)\s+(v[\d.]+\S*)")
    if block := re.search(r"require\s*\(([^)]*)\)", text):
        out += [(m[1], m[2], False) for line in block[1].split("\n") if (m := module.match(line.strip()))]
    singles = (line.split(None, 1)[1] for line in text.split("\n") if line.startswith("require") and len(line.split(None, 1)) > 1 and line[7:8].isspace())
    return out + [(m[1], m[2], False) for rest in singles if (m := module.match(rest))]


def cargo_lock(text: str) -> list[Row]:
    out: list[Row] = []
    for block in text.split("[[package]]"):
        fields: dict[str, str] = {}
        for line in block.split("\n"):
            key, _, value = line.partition("=")
            if line[:1].isalpha() and value.strip().startswith('"'):
                fields.setdefault(key.strip(), value.split('"')[1])
        if fields.get("name") and fields.get("version"):
            out.append((fields["name"], fields["version"], True))
    return out


def gemfile_lock(text: str) -> list[Row]:
    """Specs of the first GEM section, at their indent of four blanks, up to an empty line or the next section."""
    lines = iter(text.split("\n"))
    out: list[Row] = []
    gem = False
    for line in lines:
        gem = gem or "GEM" in line
        if gem and line.endswith("specs:"):
            break
    for line in lines:
        if not line or line.startswith(("PLATFORMS", "DEPENDENCIES", "BUNDLED")):
            break
        if m := re.match(r" {4}(\S+)\s+\(([^)]+)\)", line):
            out.append((m[1], m[2], False))
    return out


def csproj(text: str) -> list[Row]:
    """Package references that give name and version as attributes, in either order, of broken documents too."""
    out: list[Row] = []
    for tag in re.findall(r"<PackageReference\s([^>]*)", text, re.I):
        given = {k.lower(): v for k, v in re.findall(r'(\w+)="([^"]+)"', tag)}
        if "include" in given and "version" in given:
            out.append((given["include"], given["version"], False))
    return out


#: File name (or ending), ecosystem and parser.
FORMATS: tuple[tuple[str, str, Callable[[str], list[Row]]], ...] = (
    ("package.json", "npm", package_json),
    ("package-lock.json", "npm", package_lock),
    ("yarn.lock", "npm", yarn_lock),
    ("requirements.txt", "PyPI", requirements),
    ("Pipfile.lock", "PyPI", pipfile_lock),
    ("go.mod", "Go", go_mod),
    ("Cargo.lock", "crates.io", cargo_lock),
    ("Gemfile.lock", "RubyGems", gemfile_lock),
    (".csproj", "NuGet", csproj),
)


def format_of(path: str):
    """(ecosystem, parser) by the file's name in any case, or None."""
    name = path.rpartition("/")[2].lower()
    return next(((e, p) for n, e, p in FORMATS if name == n.lower() or n.startswith(".") and name.endswith(n)), None)


def parse_manifest(path: str, text: str | None) -> list[tuple[str, str, str, bool]]:
    """(ecosystem, name, version, transitive) of a manifest; none for other files and broken texts."""
    kind = format_of(path)
    if kind is None or not text:
        return []
    try:
        rows = kind[1](text)
    except (ValueError, AttributeError, TypeError, KeyError):
        return []
    return [(kind[0], name, version, transitive) for name, version, transitive in rows if name]


def parse_manifests(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests among (file_path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *row) for path, text in zip(frame["file_path"], frame["content"]) for row in parse_manifest(path, text)]
            yield pd.DataFrame(rows, columns=["manifest_path", "ecosystem", "package_name", "pkg_version", "is_transitive"])

    return files.select("file_path", "content").mapInPandas(run, "manifest_path string, ecosystem string, package_name string, pkg_version string, is_transitive boolean")
