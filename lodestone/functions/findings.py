"""Findings out of free text, as a model's answer gives them: JSON that may be fenced, one object a line, or broken off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that a finding must have, the levels of two of them, and the most characters of the other two.
REQUIRED = ("severity", "category", "line_reference", "explanation", "suggested_fix", "confidence")
LEVELS = ("low", "medium", "high")
LONGEST = {"category": 80, "line_reference": 160}


def _text(value: object) -> str:
    """A JSON value as text: true and false in lower case, whole numbers without a point."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def finding_of(row: object, file_path: str | None = None) -> dict | None:
    """One finding, or None where a required field is missing, null or blank; unknown levels are medium."""
    if not isinstance(row, dict) or any(row.get(k) is None or not _text(row[k]).strip() for k in REQUIRED):
        return None
    out: dict = {k: _text(row[k]) for k in REQUIRED}
    for k in ("severity", "confidence"):
        out[k] = out[k].lower() if out[k].lower() in LEVELS else "medium"
    for k, n in LONGEST.items():
        out[k] = out[k][:n]
    for k in ("explanation", "suggested_fix"):
        out[k] = out[k].strip()
    out["file_path"] = _text(row["file_path"]) if row.get("file_path") else file_path
    return out


def _read(text: str) -> list:
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return []
    return got if isinstance(got, list) else [got]


def findings_of(text: str | None, file_path: str | None = None) -> list[dict]:
    """Findings of a text by the first way that gives any: the first fenced block, the whole text, its lines, and objects
    without inner braces that mention a severity, category or confidence."""
    whole = (text or "").strip()
    if not whole:
        return []
    fence = re.search(r"```(?:json)?\s*(.*?)```", whole, re.S | re.I)
    lines = (line.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip() for line in re.split(r"\r?\n", whole))
    ways = (
        lambda: _read(fence[1].strip()) if fence else [],
        lambda: _read(whole),
        lambda: [row for line in lines if line.startswith("{") for row in _read(line)],
        lambda: [row for m in re.finditer(r"\{[^{}]*\}", whole) if re.search(r'"(?:severity|category|confidence)"', m[0]) for row in _read(m[0])],
    )
    for way in ways:
        if found := [f for row in way() if (f := finding_of(row, file_path))]:
            return found
    return []


_FINDING = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in (*REQUIRED, "file_path")]))


@F.pandas_udf(_FINDING)
def findings(text: pd.Series, file_path: pd.Series) -> pd.Series:
    return pd.Series([findings_of(t, p) for t, p in zip(text, file_path)], index=text.index)
