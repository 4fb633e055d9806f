"""Line deduplication: lines that many documents share go from all of them.

Texts split at line feeds. A line's key is the line without white space at its ends (space, tab to carriage return), A-Z
lower-cased; keys are told apart by 128-bit hashes. Each document counts once for each of its keys, so a task's counts
meet before they are shuffled and a line of any frequency is a sum of partial counts. Keys that are in at least ``least``
documents are common, and all their lines go; the others stay in their order, joined by line feeds.

Common keys meet the texts in two ways with one result. The ``MOST`` most frequent ones are sent to every executor (16
bytes each) and are dropped as the texts are read. What is common beyond those joins the positions of lines by key, where
no key can then hold more than 1 / ``MOST`` of them; a text's dropped positions come back to it by the number of its row.

A row is a document: rows that repeat an id or a text count as many documents. A null or empty text has one empty line.
Keys of less than ``min_chars`` code points (the empty key always) never go. A text of any length is handled whole, and
an empty table gives an empty table. Results are named under ``prefix``; columns of ``docs`` that ``keep`` doesn't name
are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm._shared import discard, written
from lodestone.llm._text import settle

#: Most keys that are sent to every executor.
MOST = 1 << 18


def keys_of(text: str | None, min_chars: int = 1) -> list[bytes | None]:
    """The 16-byte key of each line; None where the key is too short to go."""
    stripped = [line.strip() for line in (text or "").encode().lower().split(b"\n")]  # on bytes these know ASCII alone
    long_enough = (lambda k: len(k) > 0) if min_chars <= 1 else (lambda k: len(k) >= min_chars and len(k.decode()) >= min_chars)
    return [xxhash.xxh3_128_digest(k) if long_enough(k) else None for k in stripped]


def _halves(keys: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _counts(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0):
                n.update(set(keys_of(text.as_py(), min_chars)))
            n.pop(None, None)
            both = _halves(list(n))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(n.values()), pa.int64())], names=["hi", "lo", "n"])
        settle()

    return run


def common_lines(docs: DataFrame, text_col: str = "text", least: int = 10, min_chars: int = 1) -> DataFrame:
    """(hi, lo, n): the keys that at least ``least`` documents have, with how many do."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts(min_chars), "hi long, lo long, n long")
    return counts.groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _rest(hot: frozenset[bytes], min_chars: int):
    """Positions of lines whose keys aren't among the hottest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, keys = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, key in enumerate(keys_of(text.as_py(), min_chars)):
                    if key is not None and key not in hot:
                        rows.append(row)
                        places.append(at)
                        keys.append(key)
            both = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["row", "at", "hi", "lo"])
        settle()

    return run


def _kept(hot: frozenset[bytes], min_chars: int, passed: int):
    """The first ``passed`` columns, then results; text and positions to drop are the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column(passed), batch.column(passed + 1)):
                text, gone = text.as_py() or "", set(drop.as_py() or ())
                lines, keys = text.split("\n"), keys_of(text, min_chars)
                stay = [line for i, (line, k) in enumerate(zip(lines, keys)) if k not in hot and i not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            own = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, batch.column(passed).type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *own], names=[*batch.schema.names[:passed], "n_lines", "n_dropped", "kept"])
        settle()

    return run


def dedup_lines(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), least: int = 10, min_chars: int = 1, most: int = MOST, prefix: str = "") -> DataFrame:
    """The columns ``keep``, and n_lines (before dropping), n_dropped and kept, the text without common lines."""
    common = written(common_lines(docs, text_col, least, min_chars), "common-lines")
    top = common.orderBy(F.desc("n"), "hi", "lo").limit(most).select("hi", "lo").toArrow()
    pairs = np.column_stack([top.column("hi").to_numpy(), top.column("lo").to_numpy()]).astype("<i8")
    hot = frozenset(pair.tobytes() for pair in pairs)
    shown = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    if common.count() > len(hot):
        own = written(docs.select(*shown, F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered-texts")
        at = own.select("row", "text").mapInArrow(_rest(hot, min_chars), "row long, at long, hi long, lo long")
        gone = at.join(common, ["hi", "lo"], "left_semi").groupBy("row").agg(F.collect_list("at").alias("gone"))
        texts = own.join(gone, "row", "left").select(*[f"c{i}" for i in range(len(keep))], "text", "gone")
    else:
        discard(common)
        texts = docs.select(*shown, F.col(text_col).alias("text"), F.lit(None).cast("array<bigint>").alias("gone"))
    passed = texts.select(*[f"c{i}" for i in range(len(keep))]).schema.fields
    schema = StructType(passed).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    out = texts.mapInArrow(_kept(hot, min_chars, len(keep)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in ("n_lines", "n_dropped", "kept")])
