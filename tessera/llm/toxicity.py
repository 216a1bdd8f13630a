"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased and its character n-grams are hashed to ``2 ** BITS`` features, each counted once (presence). From
labelled texts, each feature gets the log ratio of its smoothed shares in both classes; those whose shares differ no more
than chance makes of one in millions get none. A logistic regression is then fit on features multiplied by these ratios,
by gradient steps; a class's texts weigh one over the root of their number. A score is the logistic function of the sum of the weights of
a text's features.

Training takes at most ``MAX_TRAINING`` texts of each class, those of the least hashed doc_id; scoring takes all of every text.

Defined results: a null or empty text has no n-grams and its score is the intercept's; without labelled texts of both
classes every score is 0; a null doc_id counts as not held out and is scored, but never trained on; repeated rows are
scored row by row; an empty table gives no row; further columns are ignored by ``scored`` and kept by ``accepted``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import free_names, read_spread, read_table, text_or_empty

SIZES = (4, 5)
BITS = 20
#: Bound of the training sample, for each class.
MAX_TRAINING = 4000
#: A feature whose shares differ by a smaller likelihood-ratio statistic has no weight.
LEAST_EVIDENCE = 30.0
SMOOTHING = 0.5
STEPS = 200
DECAY = 1e-3
THRESHOLD = 0.7


class Features:
    """Distinct hashed n-grams of texts."""

    def __init__(self, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
        self.sizes, self.shift = sizes, np.uint32(32 - bits)
        self.last = np.zeros(1 << bits, np.int32)
        self.count = 1 << bits

    def all(self, text: str) -> np.ndarray:
        """The feature of every n-gram."""
        if not text:
            return np.empty(0, np.int32)
        chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        h, ids = np.zeros(len(chars), np.uint32), []
        for n in range(1, min(max(self.sizes), len(chars)) + 1):
            h = (h[: len(chars) - n + 1] + chars[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in self.sizes:
                ids.append((h * np.uint32(0x85EBCA6B)) >> self.shift)
        return np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)

    def of(self, text: str) -> np.ndarray:
        """Each feature once."""
        found = self.all(text)
        order = np.arange(len(found), dtype=np.int32)
        self.last[found] = order  # of equal ones the last stays
        return found[self.last[found] == order]


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The likelihood-ratio statistic of each feature's presence against the class."""
    n = n_pos + n_neg
    out = np.zeros(len(pos))
    for present, absent, own in ((pos, n_pos - pos, n_pos), (neg, n_neg - neg, n_neg)):
        for seen, expected in ((present, (pos + neg) * own / n), (absent, (n - pos - neg) * own / n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0)
    return out


def unlike(texts: list[str], window: int = 16) -> list[int]:
    """Which texts aren't likely copies of an earlier one: none that shares the least of either of two hashes over its
    windows of characters. Evidence is counted as if texts were independent, and copies aren't."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, text in enumerate(texts):
        chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(max(1, len(chars) - window + 1), np.uint64)
        for k in range(min(window, len(chars))):
            h = (h + chars[k : k + len(h)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        marks = [(k, int((h * np.uint64(m)).min())) for k, m in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB))]
        if not any(mark in seen for mark in marks):
            out.append(i)
        seen.update(marks)
    return out


def fit(texts: list[str], toxic: list[int]) -> tuple[np.ndarray, float]:
    """Weights by feature and intercept."""
    kept = unlike(texts)
    texts, toxic = [texts[i] for i in kept], [toxic[i] for i in kept]
    features = Features()
    y = np.array(toxic, float)
    weights = np.zeros(features.count, np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return weights, -np.inf
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    pos, neg = np.zeros(features.count), np.zeros(features.count)
    for text, label in zip(texts, y, strict=True):
        (pos if label else neg)[features.of(text)] += 1
    known = evidence(pos, neg, n_pos, n_neg) >= LEAST_EVIDENCE
    smooth = lambda c, k: (c + SMOOTHING) / (k + 2 * SMOOTHING)  # noqa: E731  share of texts that have the feature
    ratio = np.where(known, np.log(smooth(pos, n_pos) / smooth(neg, n_neg)), 0)
    rows = [ids[known[ids]] for ids in map(features.of, texts)]
    at, owner = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # Columns are the known features; each text's values are their ratios.
    used, column = np.unique(at, return_inverse=True)
    value = ratio[used][column]
    share = np.where(y == 1, n_pos**-0.5, n_neg**-0.5)
    share /= share.sum()
    w, bias, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(owner, value * w[column], len(rows)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.append(np.bincount(column, value * error[owner], len(used)) + DECAY * w, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights[used] = w * ratio[used]
    return weights, float(bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most: int = MAX_TRAINING) -> tuple[np.ndarray, float]:
    """Fits on rows that aren't held out: of each class, ``most`` at most."""
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("label_id")))
    usable = usable.groupBy("label_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("label_id"))
    # At most 2 * most ids of numbers, so this side of the join has a bound.
    chosen = usable.where("toxic = 1").orderBy("h", "label_id").limit(most).union(usable.where("toxic = 0").orderBy("h", "label_id").limit(most))
    rows = docs.select(F.col(key).alias("label_id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "label_id")
    rows = rows.groupBy("label_id", "toxic", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "label_id"])
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", key: str = "doc_id", keep: str | None = None) -> DataFrame:
    """doc_id and score of every row; with ``keep`` all columns and the score by that name."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers

    def score(column: pa.Array) -> np.ndarray:
        features, w = Features(), shared.value
        weighted = w != 0

        def total(text: str) -> float:
            ids = features.all(text)
            return float(w[np.unique(ids[weighted[ids]])].sum(dtype=np.float64)) + bias

        z = np.array([total(t.as_py() or "") for t in column], float)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-z))

    if keep:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = score(batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, keep])

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(keep, DoubleType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected as toxic."""
    (score,) = free_names(docs, "tox_score")
    return scored(docs, trained(docs, labels), keep=score).where(F.col(score) < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents")
    found = scored(docs, trained(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
