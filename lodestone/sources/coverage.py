"""Coverage reports as rows: LCOV, Istanbul JSON and Cobertura XML give (file, percentage)."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _percent(hit: int, total: int) -> float:
    return 100.0 * hit / total if total else 0.0


def lcov(text: str) -> list[tuple[str, float]]:
    """By the totals of found and hit lines where they are given, else by the lines themselves."""
    out, name, hits, totals = [], None, {}, {}
    for line in text.splitlines():
        kind, _, rest = line.strip().partition(":")
        if kind == "SF":
            name, hits, totals = rest, {}, {}
        elif kind in ("LF", "LH"):
            totals[kind] = int(rest)
        elif kind == "DA":
            number, count = rest.split(",")[:2]
            hits[number] = max(hits.get(number, 0), int(count))
        elif kind == "end_of_record" and name:
            out.append((name, _percent(totals.get("LH", 0), totals["LF"]) if "LF" in totals else _percent(sum(c > 0 for c in hits.values()), len(hits))))
            name = None
    return out


def istanbul(text: str) -> list[tuple[str, float]]:
    """Final reports (statement counts) and summaries (percentages)."""
    out = []
    for path, entry in json.loads(text).items():
        if path == "total" or not isinstance(entry, dict):
            continue
        if "s" in entry:
            out.append((entry.get("path", path), _percent(sum(1 for c in entry["s"].values() if c > 0), len(entry["s"]))))
        elif "pct" in entry.get("lines", {}):
            out.append((path, float(entry["lines"]["pct"])))
    return out


def cobertura(text: str) -> list[tuple[str, float]]:
    """Classes of one file count together, by lines where they are listed and else by rate."""
    root = ET.fromstring(text)
    if root.tag != "coverage":
        return []
    lines: dict[str, dict[str, int]] = {}
    rates: dict[str, list[float]] = {}
    for item in root.iter("class"):
        name = item.get("filename")
        if name:
            rates.setdefault(name, []).append(float(item.get("line-rate") or 0))
            for line in item.iter("line"):
                own = lines.setdefault(name, {})
                own[line.get("number")] = max(own.get(line.get("number"), 0), int(line.get("hits") or 0))
    return [(n, _percent(sum(h > 0 for h in lines[n].values()), len(lines[n])) if lines.get(n) else 100 * sum(r) / len(r)) for n, r in rates.items()]


def parse_report(path: str, text: str | None) -> list[tuple[str, float]]:
    """Rows of one report; none for other files and broken texts."""
    low = path.lower()
    parser = lcov if low.endswith((".info", "lcov")) else istanbul if low.endswith(".json") else cobertura if low.endswith(".xml") else None
    if parser is None or not text:
        return []
    try:
        return parser(text)
    except (ValueError, AttributeError, TypeError, ET.ParseError):
        return []


def parse_reports(files: DataFrame) -> DataFrame:
    """(report, reported, coverage_percentage) of all reports among (file_path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, name, value) for path, text in zip(frame["file_path"], frame["content"]) for name, value in parse_report(path, text)]
            yield pd.DataFrame(rows, columns=["report", "reported", "coverage_percentage"])

    return files.select("file_path", "content").mapInPandas(run, "report string, reported string, coverage_percentage double")
