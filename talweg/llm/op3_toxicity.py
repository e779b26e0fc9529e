"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed word features are trained in numpy from
confirmed toxic examples and unlabelled text alone. With class prior p, the
risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): what the
unlabelled text says of negatives, less the share that positives make of it.
Where a step drives that second term below zero it is overfitted, and the step
goes the other way.

``fit`` trains ``MODELS`` classifiers side by side, each a Spark task with all
chosen positives and its own part of the unlabelled text; the weights are
averaged. Positives and unlabelled rows are bounded samples, the rows with the
least hash of their ids (``max_positive``, ``max_unlabelled``); scoring covers
every whole text, in one pass without a shuffle, with weights of a fixed size.

Nulls: a null text is empty and scores by the intercept; rows with a null id
aren't learnt from and are scored. Repeated rows score alike. Labels that are
null count as unlabelled. Without a confirmed example, or without unlabelled
text, every score is that of an intercept of -60, 0 to 26 places. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common, tokens
from talweg.llm.features import BUCKETS, linear, sparse, sums

MODELS, MAX_POSITIVE, MAX_UNLABELLED = 4, 2000, 10000
STEPS, RATE, SHRINK, MIN_ROWS = 200, 0.5, 1.2e-4, 5
#: One text in this many hash remainders is held out.
FOLDS = 5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = linear(texts, self.weights)[0] + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(w: np.ndarray, b: float, bucket: np.ndarray, value: np.ndarray, count: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(p R+(positives), R-(unlabelled) - p R-(positives), the step's gradient by w and by b).

    The gradient is that of both terms' sum, or of the second one turned over where it is negative.
    """
    n_pos, n_un = positive.sum(), (~positive).sum()
    z = sums(w[bucket] * value, count) + b
    up = 1 / (1 + np.exp(-np.clip(z, -60, 60)))  # derivative of the loss as a negative
    wanted = prior * np.logaddexp(0, -z[positive]).mean()
    negative = np.logaddexp(0, z[~positive]).mean() - prior * np.logaddexp(0, z[positive]).mean()
    pull = np.where(positive, -prior * up / n_pos, up / n_un)
    g = -pull if negative < 0 else np.where(positive, prior * (up - 1) / n_pos, 0) + pull
    return float(wanted), float(negative), np.bincount(bucket, weights=np.repeat(g, count) * value, minlength=len(w)), float(g.sum())


def train(bucket: np.ndarray, value: np.ndarray, count: np.ndarray, positive: np.ndarray, prior: float, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> tuple[np.ndarray, float]:
    """Minimise the non-negative PU risk (logistic loss, Adam with a lasso step, all rows at every step).

    ``bucket`` and ``value`` hold every row's features, ``count`` how many each
    row has. Features of fewer than ``MIN_ROWS`` rows keep no weight.
    """
    w, b = np.zeros(buckets), 0.0
    if not positive.any() or positive.all():
        return w, -60.0
    value = np.where(np.bincount(bucket, minlength=buckets)[bucket] >= MIN_ROWS, value, 0.0)
    m, v, mb, vb = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0
    b = float(np.log(prior / (1 - prior)))
    for t in range(1, steps + 1):
        _, _, gw, gb = risk(w, b, bucket, value, count, positive, prior)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * (1 - t / (steps + 1)) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-5)
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink / (np.sqrt(v) + 1e-5), 0)
        b -= 0.3 * step * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 by ``FOLDS``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _least(ids: DataFrame, n: int) -> DataFrame:
    """The n ids with the least hash: a sample that a rerun repeats, of at most n rows."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from labels outside the held-out fold. ``prior``: share of toxic text; None takes it from those labels."""
    learn = labels.where(~held_out() & F.col("doc_id").isNotNull())
    if prior is None:
        toxic, known = learn.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count("toxic")).first()
        prior = min(max((toxic or 0) / max(known, 1), 1e-4), 0.9)
    positives = _least(learn.where("toxic = 1").select("doc_id").distinct(), max_positive).withColumn("positive", F.lit(True))
    unlabelled = _least(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct(), max_unlabelled).withColumn("positive", F.lit(False))
    chosen = positives.unionByName(unlabelled)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                bucket, value, count, _ = sparse(part.column("text"))
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), *lists], names=["doc_id", "positive", "bucket", "value"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["positive", "doc_id"])
        count = rows["bucket"].map(len).to_numpy()
        w, b = train(np.concatenate(rows["bucket"].to_list()).astype(np.int64), np.concatenate(rows["value"].to_list()).astype(float), count, rows["positive"].to_numpy(bool), prior)
        tokens.tidy()
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "intercept": [b]})

    # Both samples are bounded by their parameters, so their ids may be broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "positive")), "doc_id")
    rows = text.mapInArrow(vectors, "doc_id long, positive boolean, bucket array<int>, value array<float>")
    every = F.sequence(F.lit(0), F.lit(MODELS - 1))
    own = F.array(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(MODELS)).cast("int"))
    dealt = rows.withColumn("model", F.explode(F.when(F.col("positive"), every).otherwise(own)))
    models = dealt.groupBy("model").applyInPandas(one, "weights binary, intercept double").collect()
    if not models:
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    return Model(np.mean([np.frombuffer(r.weights, "<f4") for r in models], axis=0).astype(np.float32), float(np.mean([r.intercept for r in models])))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, with score and predicted after them."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for a, b in tokens.slices(batch.column("_scored")):
                part = batch.slice(a, b - a)
                s = model.scores(part.column("_scored"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    rows = docs.select(*keep, F.col("text").alias("_scored"))
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*docs.select(*keep).schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return rows.mapInArrow(scored, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learning outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
