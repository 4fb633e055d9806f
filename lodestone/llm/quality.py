"""Quality by hierarchical empirical Bayes.

A logistic classifier over hashed n-grams of character shapes (case, digits, punctuation; letters of one kind look
alike) gives each document's evidence. Grouped aggregation gives each host and each path below it the mean of that
evidence; sparse groups shrink towards their parent: path to host, host to the global mean. The strength of the
shrinkage comes from the variance between groups. A document's posterior combines its own log odds with its path's.

A null text is empty and is judged by its group's prior alone. A null host or path forms a group of its own. Without
labels of both kinds every document gets the global prior of the labels (0.5 without any). Repeated rows count row by
row; of an id's labels the greatest counts, and rows that share a labelled id teach once for each distinct text. A
posterior that equals the bound is kept. Columns to keep may have any names; ``prefix`` sets the results' names apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import written
from lodestone.llm._text import SPACED, Words, blocks, gram_counts, settle
from lodestone.llm.language_id import features, sample_counts

DIMS = 512
#: Labelled documents that the classifier is fitted on, in expectation.
SAMPLE = 8_000
#: Posterior below which a document is rejected.
REJECT_BELOW = 0.5

#: Shapes: lower and non-ASCII letters a, upper A, digits 0, white space one blank (line breaks apart), punctuation itself.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[97:123] = _TABLE[128:] = 97
_TABLE[65:91] = 65
_TABLE[48:58] = 48
_TABLE[[9, 11, 12, 13]] = 32


#: Trigrams at which a document's own evidence has half its weight.
HALF_WEIGHT = 40


def shape_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of shape n-grams and, last, of words that repeat the word before."""
    words = Words(data, offsets, SPACED)
    again = np.zeros(len(words) + 1)
    if len(words) > 1:
        same = words.hashes[1:] == words.hashes[:-1]
        first = words.bounds[(words.bounds > 0) & (words.bounds < len(words))]
        same[first - 1] = False  # the word before is another text's
        again[2:] = np.cumsum(same)
    repeats = again[words.bounds[1:]] - again[words.bounds[:-1]]
    return np.hstack([gram_counts(data, offsets, _TABLE, DIMS, squeeze=32), repeats[:, None]])


@dataclass
class QualityModel:
    weights: np.ndarray | None
    prior: float

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        """Log odds that the document adds to the prior: 0 where there is nothing to judge."""
        if self.weights is None:
            return np.zeros(len(counts))
        odds = features(counts) @ self.weights[:-1] + self.weights[-1] - np.log(self.prior / (1 - self.prior))
        size = counts.sum(axis=1)
        return odds * size / (size + HALF_WEIGHT)  # a few characters say little


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on about ``sample`` labelled documents, chosen by a hash of the id; the prior counts all labels."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    total, good = known.agg(F.count("*"), F.sum(F.col("__label").cast("long"))).first()
    if not total:
        return QualityModel(None, 0.5)
    prior = (good + 0.5) / (total + 1)
    draw = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 24) - 1)) / float(1 << 24)
    known = known.where(draw < min(1.0, sample / total)).select(F.col(id_col).alias("__id"), "__label")
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(known, "__id").dropDuplicates()
    counts, target = sample_counts(picked, "__text", F.col("__label").cast("int"), DIMS + 1, shape_counts)
    y = np.array(target, dtype=float)
    if not len(y) or y.min() == y.max():
        return QualityModel(None, prior)
    x = np.hstack([features(counts), np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), 0.3)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    del counts, x
    settle()
    return QualityModel(w, prior)


def evidence(docs: DataFrame, model: QualityModel, text_col: str = "__text") -> DataFrame:
    """The columns of ``docs`` but its text, and ``__evidence`` double, a row for each row; the text is the first column."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[1:]), "__evidence double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, text_col):
            odds = shared.value.evidence(shape_counts(data, offsets))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(odds)], names=[*part.schema.names[1:], "__evidence"])
        settle()

    return docs.mapInArrow(run, schema)


def _strength(groups: DataFrame, total: str, n: str, mean: float) -> float:
    """Pseudo-counts of the parent: within-group over between-group variance, by the method of moments."""
    r = groups.agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mean, 2)).alias("between"), F.count("*").alias("k")).first()
    if not r["k"] or r["k"] < 2:
        return 10.0
    inside = max(mean * (1 - mean), 1e-6)
    spread = (r["between"] - (r["k"] - 1) * inside) / r["n"]
    return float(min(1000.0, max(1.0, inside / max(spread, 1e-6))))


def score(docs: DataFrame, model: QualityModel, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", reject_below: float = REJECT_BELOW, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(id or ``keep``, host, path, evidence, host_prior, path_prior, quality, keep) for each document.

    Each text is read and classified once; what it gives is written with the columns to keep. Group tables are joined
    back by key. Sums take partial aggregation, so a host with a third of all rows costs no more than its rows.
    """
    keep = keep or [id_col]
    named = docs.select(
        F.col(text_col).alias("__text"),
        *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)],
        F.coalesce(host.cast("string"), F.lit("")).alias("__host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("__path"),
    )
    logit = float(np.log(model.prior / (1 - model.prior)))
    own = written(evidence(named, model), "quality-evidence")
    p = F.lit(1.0) / (1 + F.exp(-(F.col("__evidence") + logit)))
    paths = written(own.groupBy("__host", "__path").agg(F.sum(p).alias("s"), F.count("*").alias("n")), "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    r = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    mean = float(min(1 - 1e-6, max(1e-6, r[0] / r[1]))) if r[1] else model.prior
    of_host, of_path = _strength(hosts, "hs", "hn", mean), _strength(paths, "s", "n", mean)
    hosts = hosts.select("__host", ((F.col("hs") + mean * of_host) / (F.col("hn") + of_host)).alias("__host_prior"))
    paths = paths.join(hosts, "__host")
    groups = paths.select("__host", "__path", "__host_prior", ((F.col("s") + F.col("__host_prior") * of_path) / (F.col("n") + of_path)).alias("__path_prior"))
    judged = own.join(groups, ["__host", "__path"])
    odds = F.col("__evidence") + F.log(F.col("__path_prior") / (1 - F.col("__path_prior")))
    judged = judged.withColumn("__quality", F.lit(1.0) / (1 + F.exp(-odds))).withColumn("__keep", F.col("__quality") >= reject_below)
    results = ("host", "path", "evidence", "host_prior", "path_prior", "quality", "keep")
    return judged.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"__{c}").alias(prefix + c) for c in results])
