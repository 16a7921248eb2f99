"""Toxicity as graded severity: cumulative-link ordinal regression on sparse text features.

A text's features are its words and their first letters, hashed. Labelled documents, up to a documented number, choose the
features that toxic documents have far more often and fit one weight per feature, shared by all ordered thresholds:
P(grade > k) = logistic(w x - t_k). Every document is then scored, to its expected grade. Labels say toxic or not; the
grades of toxic training documents are thirds by the number of such features that they hold.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.sources.workdir import stage

#: Labelled documents of each class that are fitted at most.
SAMPLE = 10_000
#: Hash space of features, and how many may be chosen.
SPACE = 1 << 20
CHOSEN = 4096
#: Least chi-square statistic of a chosen feature.
CHI2 = 15.0
#: And how many times as common it is in toxic documents at least; common words of the corpus say little.
LIFT = 8.0
#: Share of the toxic documents that hold it, and how many at least.
HOLDERS, LEAST = 0.01, 3
PREFIXES = (4, 5, 6)
#: Distinct words whose features a worker remembers.
KNOWN_WORDS = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    names = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SPACE for x in names]


class _Found(dict):
    """Positions of chosen features by word."""

    def __init__(self, chosen: dict[int, int] | None):
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        every = word_features(word)
        own = tuple(every) if self.chosen is None else tuple(self.chosen[f] for f in every if f in self.chosen)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = own
        return own

    def of(self, text: str | None) -> set[int]:
        """The features that the text holds."""
        return set().union(*map(self.__getitem__, _WORD.findall(text.lower()))) if text else set()


def _presence(batches):
    """Toxic and clean documents that hold each feature, of one task."""
    found, counts = _Found(None), np.zeros((2, SPACE), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[int(toxic), list(found.of(text))] += 1
    some = np.flatnonzero(counts.sum(axis=0))
    columns = [pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])]
    yield pa.RecordBatch.from_arrays(columns, ["feature", "clean", "bad"])


def _examples(chosen: dict[int, int]):
    def examples(batches):
        found = _Found(chosen)
        for batch in batches:
            rows = [found.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic").cast(pa.int32()),
                    pa.array([sorted(x) for x in rows], pa.list_(pa.int64())),
                ],
                ["toxic", "features"],
            )

    return examples


@dataclass
class Model:
    """Chosen features, their weights, and the thresholds between grades."""

    chosen: dict[int, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -60, 60)))


def _by_third(numbers: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(np.quantile(numbers, [1 / 3, 2 / 3]), numbers, side="left")


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-4):
    """Weights and increasing thresholds of the cumulative-link model, by Adam on the whole sample.

    ``rows`` hold the positions of the features that a document has.
    """
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    k = int(grades.max())
    share = np.array([(grades > j).mean() for j in range(k)])
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        cuts = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(of, w[at], len(rows))
        over = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -60, 60)))
        edge = np.concatenate([np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        prob = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), over * (1 - over), np.zeros((len(rows), 1))], axis=1)
        d_score = -(slope[i, grades] - slope[i, grades + 1]) / prob / len(rows)
        d_cut = np.zeros((len(rows), k + 2))
        d_cut[i, grades] += slope[i, grades] / prob
        d_cut[i, grades + 1] -= slope[i, grades + 1] / prob
        d_cut = d_cut[:, 1 : k + 1].sum(axis=0) / len(rows)
        later = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(at, d_score[of], n_features) + l2 * w, later[:1], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])
    return p[:n_features], cuts


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE
) -> Model | None:
    """Fit on at most ``sample`` toxic and as many other documents, first by a hash of the key.

    Keys alone are joined and ranked; texts are read for the sample, whose keys are broadcast. Only counts per hashed feature and the chosen features of the sample reach the driver. None unless both classes occur.
    """
    ids = labels.select(F.col(key).alias("key"), F.col(toxic).cast("int").alias("toxic")).where("toxic IN (0, 1)")
    ids = ids.join(docs.select(F.col(key).alias("key")), "key", "left_semi")
    picked = [ids.where(f"toxic = {c}").orderBy(F.xxhash64("key"), "key").limit(sample) for c in (0, 1)]
    picked = stage(picked[0].unionByName(picked[1]), "picked")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    train = stage(texts.join(F.broadcast(picked), "key").select("text", "toxic"), "train")  # 2 * sample rows
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    counts = train.mapInArrow(_presence, "feature long, clean long, bad long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("a"), F.sum("bad").alias("b"))
    a, b, p, q = F.col("a"), F.col("b"), float(sizes[0]), float(sizes[1])
    n = p + q
    chi2 = n * F.pow(a * (q - b) - b * (p - a), 2) / ((a + b) * (n - a - b + 0.5) * p * q)
    lift = (b + 0.5) / q / ((a + 0.5) / p)
    best = counts.withColumn("chi2", chi2).where((F.col("chi2") >= CHI2) & (lift >= LIFT) & (b >= max(LEAST, HOLDERS * q))).orderBy(F.desc("chi2"), "feature").limit(CHOSEN)
    best = best.collect()
    chosen = {r["feature"]: i for i, r in enumerate(best)}
    if not chosen:
        return None
    rows = train.mapInArrow(_examples(chosen), "toxic int, features array<long>").collect()
    marked = [len(r["features"]) for r in rows]
    grades, is_bad = np.zeros(len(rows), np.int64), np.array([r["toxic"] == 1 for r in rows])
    grades[is_bad] = _by_third(np.array(marked)[is_bad])
    grades = np.unique(grades, return_inverse=True)[1]  # without gaps where shares coincide
    weights, cuts = fit_ordinal([np.array(r["features"], np.int64) for r in rows], grades, len(chosen))
    return Model(chosen, weights, cuts)


def _score(model: Model):
    def score(batches):
        found = _Found(model.chosen)
        for batch in batches:
            sums = [model.weights[sorted(found.of(t))].sum() for t in batch.column("text").to_pylist()]
            over = model.above(np.array(sums))
            columns = [
                batch.column("key"),
                pa.array(over.sum(axis=1)),
                pa.array(over[:, 0]),
                pa.array((over >= 0.5).sum(axis=1).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "expected_severity", "p_toxic", "grade"])

    return score


def severity(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, expected_severity, p_toxic, grade, toxic)`` per row.

    ``grade`` counts the thresholds that are passed with a probability of one half, ``toxic`` is a grade above 0. A null or
    empty text has no features and gets the severity of a text without any. Without a model (no labels of both
    classes) all are 0. Other columns are ignored. Empty in, empty out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    if model is None:
        out = rows.select("key", F.lit(0.0).alias("expected_severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"))
    else:
        out = rows.mapInArrow(_score(model), f"key {kind}, expected_severity double, p_toxic double, grade int")
    return out.withColumn("toxic", F.col("grade") > 0).withColumnRenamed("key", key)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return severity(docs, fit(docs, labels))
