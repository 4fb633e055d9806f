"""Language identification by error-correcting output codes.

Each learned language gets a codeword; one binary classifier over hashed byte n-grams predicts each bit. Decoding weighs
every bit by its classifier's training accuracy and takes the codeword of least weighted loss; a small gap between the
two best flags the text as ambiguous.

The classifiers are ridge regressions on n-gram frequencies and share one factorised Gram matrix. They are fitted on a
bounded sample of labelled rows (``per_language``), whose products are added up in tasks: the driver gets one matrix of
``dims`` rows, however many languages there are. Prediction runs over every whole text.

A null text, or one without a letter, is ``und`` with score 0. Null labels teach nothing. Without any label all texts
are ``und``; with one language every text with a letter gets it. Of two nearest codewords the earlier language in
alphabetical order wins. Repeated rows are judged row by row and teach once for each distinct text and label. Columns to
keep may have any names; ``prefix`` sets the results' names apart from theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import discard, written
from lodestone.llm._text import blocks, gram_counts, settle

#: Hashed n-gram features.
DIMS = 2048
#: Distinct labelled texts that each language gives to the fit, in expectation.
PER_LANGUAGE = 800
#: Sampled texts of a task that adds up products, and the most such tasks; beyond, a task takes more texts in turn.
PART, MAX_PARTS = 1024, 256
#: Score below which a prediction is ambiguous.
AMBIGUOUS = 0.6

#: ASCII letters lower-cased, other ASCII bytes one blank, non-ASCII bytes kept.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = 32
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: the exhaustive code for up to six languages, else seeded random codes far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        code = np.array([[(j + 1 >> i) & 1 if i < n - 1 else 0 for j in range(bits)] for i in range(n)])
        return 2.0 * code - 1
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, 4 * int(np.ceil(np.log2(n))) + 8))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        agree = code @ code.T
        np.fill_diagonal(agree, -np.inf)
        gap = (code.shape[1] - agree.max()) / 2
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (dims + 1, bits)
    trust: np.ndarray  # (bits,): training accuracy of each bit, 0 for chance
    scale: float = 6.0

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score, 0 to 1, for each row of counts."""
        n = len(counts)
        if len(self.languages) <= 1:
            return np.zeros(n, dtype=int), np.ones(n)
        margins = np.clip(features(counts) @ self.weights[:-1] + self.weights[-1], -1, 1)
        loss = (np.exp(-margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2) / self.trust.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        gap = loss[np.arange(n), order[:, 1]] - loss[np.arange(n), order[:, 0]]
        return order[:, 0], 1 / (1 + np.exp(-self.scale * gap))


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of n-gram frequencies: unit rows, whatever the text's length."""
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def sample_counts(docs: DataFrame, text_col: str, target: Column, dims: int, count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, list]:
    """What ``count`` (bytes, offsets) gives for (already sampled) rows, ``dims`` wide, and their targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "text"):
            rows = count(data, offsets).astype("<f4")
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["target", "counts"])
        settle()

    picked = docs.select(F.col(text_col).alias("text"), target.alias("target"))
    got = picked.mapInArrow(run, f"target {picked.schema['target'].dataType.simpleString()}, counts binary").toArrow()
    column = got.column("counts").combine_chunks()
    if not len(column):
        return np.zeros((0, dims), "f4"), []
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset :]  # rows of one width lie one after another
    flat = np.frombuffer(column.buffers()[2], dtype="<f4")[offsets[0] // 4 : offsets[len(column)] // 4]
    return flat.reshape(len(column), dims), got.column("target").to_pylist()


def _sample(picked: DataFrame, dims: int, parts: int) -> DataFrame:
    """(which, key, counts): n-gram counts of (which, __text), dealt into ``parts`` tasks and written, each task's rows in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "__text"):
            rows = gram_counts(data, offsets, _TABLE, dims, squeeze=32).astype("<f4")
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["which", "key", "counts"])
        settle()

    counted = picked.select("__text", "which", F.xxhash64("__text", "which").alias("key")).mapInArrow(run, "which int, key long, counts binary")
    return written(counted.repartition(parts, "key").sortWithinPartitions("key", "which"), "language-sample")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(languages, features with a constant) of sampled rows, some hundreds at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            own = batch.slice(a, 512)
            counts = np.frombuffer(b"".join(own.column(1).to_pylist()), dtype="<f4").reshape(own.num_rows, -1)
            yield own.column(0).to_numpy(), with_constant(counts)


def _products(sample: DataFrame, shared, dims: int, bits: int) -> np.ndarray:
    """X'WX beside X'WY, (dims + 1, dims + 1 + bits): a matrix for each task with rows, and these are added up row by row."""
    width = dims + 1 + bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, weight = shared.value
        total = np.zeros((dims + 1, width))
        seen = 0
        for which, x in _steps(batches):
            total += (x * weight[which, None]).T @ np.hstack([x, code[which]])
            seen += len(x)
        part = TaskContext.get().partitionId()
        for a in range(0, dims + 1 if seen else 0, 256):
            rows = total[a : a + 256]
            at = np.arange(a, a + len(rows), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(rows), part, np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["at", "part", "row"])
        settle()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("row").to_pylist()))  # at most MAX_PARTS
        total = np.zeros(width)  # in the order of the parts: the same sum on every run
        for _, r in rows:
            total += np.frombuffer(r, "<f8")
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})

    parts = sample.select("which", "counts").mapInArrow(run, "at int, part int, row binary")
    got = parts.groupBy("at").applyInArrow(add, "at int, row binary").toArrow()  # dims + 1 rows
    out = np.zeros((dims + 1, width))
    for at, row in zip(got.column("at").to_pylist(), got.column("row")):
        out[at] = np.frombuffer(row.as_py(), "<f8")
    return out


def _hits(sample: DataFrame, shared, w: np.ndarray, bits: int) -> np.ndarray:
    """Weight of the sampled rows whose bits have the right sign, for each bit."""
    fitted = sample.sparkSession.sparkContext.broadcast(w)  # dims x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, weight = shared.value
        total = np.zeros(bits)
        for which, x in _steps(batches):
            total += ((np.sign(x @ fitted.value) == code[which]) * weight[which, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "hits"])
        settle()

    rows = sample.select("which", "counts").mapInArrow(run, "part int, hits array<double>").collect()  # a row for each task
    return sum((np.array(r.hits) for r in sorted(rows, key=lambda r: r.part)), np.zeros(bits))


def with_constant(counts: np.ndarray) -> np.ndarray:
    return np.hstack([features(counts.astype(np.float64)), np.ones((len(counts), 1))])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, dims: int = DIMS) -> LanguageModel:
    """Fit on about ``per_language`` distinct labelled texts of each language, chosen by a hash of the text."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    draw = F.xxhash64("__text")
    sizes = {r[0]: r[1] for r in labelled.groupBy("__lang").agg(F.approx_count_distinct(draw)).collect()}  # a row for each language
    languages = sorted(sizes)
    if len(languages) <= 1:
        return LanguageModel(languages, codewords(len(languages)), np.zeros((dims + 1, 1)), np.ones(1))
    share = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, F.struct(F.lit(i).alias("which"), F.lit(min(1.0, per_language / max(sizes[k], 1))).alias("share")))])
    known = labelled.withColumn("__of", F.element_at(share, F.col("__lang")))
    drawn = draw.bitwiseAND(F.lit((1 << 24) - 1)) / float(1 << 24) < F.col("__of.share")
    # copies of a drawn text are all drawn, and count once
    picked = known.where(drawn).select("__text", F.col("__of.which").alias("which")).dropDuplicates()
    expected = sum(min(per_language, n) for n in sizes.values())
    parts = max(1, min(MAX_PARTS, expected // PART))
    sample = _sample(picked, dims, parts)
    found = np.zeros(len(languages))
    for r in sample.groupBy("which").count().collect():  # a row for each language
        found[r["which"]] = r["count"]
    code = codewords(len(languages))
    # languages weigh alike, and the weights of all texts add up to their number
    weight = found.sum() / max((found > 0).sum(), 1) / np.maximum(found, 1)
    shared = docs.sparkSession.sparkContext.broadcast((code, weight))  # languages x bits
    both = _products(sample.coalesce(parts), shared, dims, code.shape[1])  # files may be split
    gram, right = both[:, : dims + 1], both[:, dims + 1 :]
    gram[np.diag_indices(dims + 1)] += 0.05
    w = np.linalg.solve(gram, right)
    accuracy = _hits(sample, shared, w, code.shape[1]) / max(found.sum(), 1e-9)
    discard(sample)
    return LanguageModel(languages, code, w, np.maximum(2 * accuracy - 1, 0.01))


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns in ``keep`` and (lang_pred, score, ambiguous), a row for each row."""
    picked = docs.select(F.col(text_col).alias("__text"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    names = [*picked.columns[1:], "lang_pred", "score", "ambiguous"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:]), "lang_pred string, score double, ambiguous boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and dims x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        dims = len(own.weights) - 1
        for part, data, offsets in blocks(batches, "__text"):
            which, score = own.predict(gram_counts(data, offsets, _TABLE, dims, squeeze=32))
            known = has_letter(part.column(0)) & bool(own.languages)
            score = np.where(known, score, 0.0)
            pred = np.where(known, np.array([*own.languages, "und"], dtype=object)[which] if own.languages else "und", "und")
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=names)
        settle()

    out = picked.mapInArrow(run, schema)
    return out.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in names[len(keep) :]])
