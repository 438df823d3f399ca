"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed (logarithms, square roots of shares),
each class gets a mean and a covariance shrunk towards the pooled one and its
diagonal, and a score is the logistic of the difference of the two Gaussian
log-densities, taken with Cholesky factors that are made once on the driver.

The fit reads sufficient statistics only (counts, sums, products: a few hundred
numbers a class, whatever the input), summed by Spark over all labelled rows.

Defined results: null and empty texts are texts with no characters and are scored
like any other; null labels are left out of the fit, and with no labelled rows at
all every score is 0.5; repeated rows are scored alike; a doc_id that has several
labels counts once with each; an empty table gives an empty table; columns of the
input other than doc_id and text are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, materialize, small_batches, table
from .kernels import space_table, utf8, word_hashes

#: The most labelled documents that ``train_bounded`` fits on, by smallest hash of their id.
MAX_LABELLED = 20_000
NAMES = ("log_chars", "log_words", "word_chars", "upper", "digits", "exclaim", "symbols", "pipes", "stops", "commas", "lines", "distinct", "adjacent", "top_word")
THRESHOLD = 0.7


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each whole text."""
    raw, ends = utf8(column)
    n = len(ends) - 1
    size = np.diff(ends)
    sums = np.zeros(len(raw) + 1, dtype=np.int64)

    def count(members: str) -> np.ndarray:
        flags = np.zeros(256, dtype=bool)
        flags[list(members.encode("latin-1"))] = True
        np.cumsum(flags[raw], out=sums[1:])
        return np.diff(sums[ends])

    upper = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits, exclaim = count("0123456789"), count("!")
    symbols, pipes = count("#$%&*+/<=>@\\^_~{}[]"), count("|")
    stops, commas, lines = count(".?"), count(",;:"), count("\n")
    spaces = np.diff(np.concatenate([[0], np.cumsum(space_table()[raw])])[ends])
    hashes, by = word_hashes(column)
    w = np.diff(by)
    distinct, adjacent, top = np.zeros(n), np.zeros(n), np.zeros(n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    for i, (a, b) in enumerate(zip(by[:-1].tolist(), by[1:].tolist(), strict=True)):
        if b > a:
            _, c = np.unique(hashes[a:b], return_counts=True)
            distinct[i], top[i], adjacent[i] = len(c), c.max(), same[a + 1 : b].sum()
    ink, w1 = np.maximum(size - spaces, 1), np.maximum(w, 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(w),
            np.log1p((size - spaces) / w1),
            np.sqrt(upper / ink),
            np.sqrt(digits / ink),
            np.sqrt(exclaim / ink),
            np.sqrt(symbols / ink),
            np.sqrt(pipes / ink),
            np.sqrt(stops / w1),
            np.sqrt(commas / w1),
            np.sqrt(lines / w1),
            # distinct words against what a text of this length has by Heaps' law
            np.log((distinct + 1) / (w + 1)) + 0.12 * np.log1p(w),
            np.sqrt(adjacent / w1),
            np.sqrt(top / w1),
        ]
    )


def with_statistics(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """x (the statistics) of every row, beside its column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                x = statistics(batch.column(1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], [name, "x"])

    kind = docs.schema[name].dataType.simpleString()
    return docs.select(name, "text").mapInArrow(run, f"{name} {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log priors with log determinants, for classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray
    #: Whether there was any labelled row.
    fitted: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        log = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            log.append(self.offsets[c] - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """From rows (x, label): moments by Spark over all of them, the rest on the driver.

    A class covariance is (1 - shrink) of its own plus shrink of the pooled one,
    and ``ridge`` of the pooled variances on the diagonal.
    """
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        at = np.arange(total.shape[1], dtype=np.int32)
        for c in (0, 1):
            if total[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at), pa.array(total[c])], ["label", "at", "part"])

    parts = labelled.where(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, at int, part double")
    total = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("label", "at").agg(F.sum("part").alias("part")).collect():
        total[row.label, row.at] = row.part
    counts, everything = total[:, 0], total.sum(0)
    if not everything[0]:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), False)

    def moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(t[0], 1.0)
        mean = t[1 : 1 + d] / n
        return mean, t[1 + d :].reshape(d, d) / n - np.outer(mean, mean)

    each = [moments(t) for t in total]
    whole = moments(everything)
    pooled = sum(counts[c] * each[c][1] for c in (0, 1)) / everything[0]
    floor = ridge * (np.diag(whole[1]) + 1e-4)
    means, whiten, offsets = [], [], []
    for c in (0, 1):
        mean = each[c][0] if counts[c] else whole[0]
        cov = ((1 - shrink) * each[c][1] + shrink * pooled if counts[c] else pooled) + np.diag(floor)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log((counts[c] + 1) / (everything[0] + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(offsets))


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """Adds score and predicted to rows that have x."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "x", "score", "predicted"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, x array<double>, score double, predicted int")


def training_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (x, label) whose crc32(doc_id as text) mod 4 isn't 2; both sides are cut before they meet."""
    keep = crc_mod("doc_id", 4) != 2
    named = labels.where(keep & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    return features.where(keep).join(named, "doc_id").select("x", "label")


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    """The statistics of ``docs``, written once, and the discriminant fitted on the training fold."""
    features = materialize(with_statistics(docs), "statistics")
    return features, fit(training_rows(features, labels))


def train_bounded(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Discriminant:
    """The discriminant fitted on at most ``most`` labels of the training fold; only their documents are read by Python.

    A label whose doc_id stands on several documents counts with each.
    """
    small_batches(docs.sparkSession)
    keep = crc_mod("doc_id", 4) != 2
    named = labels.where(keep & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    own = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id")  # ``most`` ids at most
    return fit(with_statistics(own, "label"))


def keep_good(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that the model doesn't reject; one narrow pass, no join.

    A model that saw no label rejects nothing.
    """
    if not model.fitted:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                s = model.score(statistics(batch.column(batch.schema.get_field_index("text"))))
                yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text of ``documents``."""
    features, model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = scored(features, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
