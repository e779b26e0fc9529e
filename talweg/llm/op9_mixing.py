"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed word features, trained in numpy on rows that a
labelled table covers, gives every document a posterior over the domains. The
documents' rates r >= ``floor`` (0 unless stated) then minimise

    sum over domains k of (sum_d r_d tokens_d p_dk - target_k)^2 / (N tokens of k)

by projected gradient from r = 1. A step needs the domains' residuals alone: one
aggregate over a narrow table, in which every task takes the steps so far anew in
numpy, so nothing grows on the driver and no state is lost with an executor. In the metric of the documents' tokens the loss's curvature is at most
1, so the step is 1 and no document's weight in the step depends on its length.

Labelled rows are a bounded sample (``max_labelled``, least hash of id, and of
every domain there is ``LEAST_LABELLED`` at least); rates, totals and targets
cover all rows. A target without a domain is an error; iteration that ends before
its targets are met says so in a warning.

Nulls: a null text has no tokens and weighs nothing; it still gets a posterior
and a rate. Labelled rows with a null domain are not learnt from. Without
labelled rows there is one domain and every rate is 1. Repeated rows each count.
Tokens are words (runs of letters and digits). An empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from talweg.llm import common, tokens
from talweg.llm.features import linear, sparse, sums

#: Labelled rows that are learnt from, and those of each domain that are at least, however rare it is.
BUCKETS, MODELS, MAX_LABELLED, LEAST_LABELLED = 1 << 16, 4, 8000, 50
STEPS, RATE, SHRINK, MIN_ROWS = 80, 0.2, 1e-5, 3
ROUNDS, CLOSE, TEMPERATURE = 40, 1e-6, 0.7


@dataclass(frozen=True)
class Domains:
    names: tuple[str, ...]
    weights: np.ndarray  # buckets x domains
    intercepts: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z, words = linear(texts, self.weights)
        z = z + self.intercepts
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), words


def train(bucket: np.ndarray, value: np.ndarray, count: np.ndarray, label: np.ndarray, domains: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression (Adam with a lasso step, all rows at every step)."""
    used, at = np.unique(bucket, return_inverse=True)
    value = np.where(np.bincount(at)[at] >= MIN_ROWS, value, 0.0)
    w, b = np.zeros((len(used), domains)), np.log((np.bincount(label, minlength=domains) + 1) / (len(label) + domains))
    m, v = np.zeros_like(w), np.zeros_like(w)
    truth = np.eye(domains)[label]
    for t in range(1, STEPS + 1):
        # A domain at a time: no array of features by domains.
        z = np.stack([sums(w[at, k] * value, count) for k in range(domains)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - truth) / len(label)
        gw = np.stack([np.bincount(at, weights=np.repeat(g[:, k], count) * value, minlength=len(used)) for k in range(domains)], 1)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        step = RATE * (1 - t / (STEPS + 1)) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        size = np.sqrt(v) + 1e-6
        w = w - step * m / size
        w = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK / size, 0)
    out = np.zeros((buckets, domains))
    out[used] = w
    return out, b


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Domains:
    """Learn domains from ``labelled`` (doc_id, domain)."""
    known = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")]
    place = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    rare = known.withColumn("place", place).where(F.col("place") <= LEAST_LABELLED).drop("place")
    sample = known.orderBy(*order).limit(max_labelled).union(rare).distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                bucket, value, count, _ = sparse(part.column("text"), BUCKETS)
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), *lists], names=["doc_id", "domain", "bucket", "value"])

    # The sample is bounded by its parameter and a few rows a domain, so its ids may be broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = common.written(text.mapInArrow(vectors, "doc_id long, domain string, bucket array<int>, value array<float>"), "labelled")
    names = tuple(sorted(r.domain for r in rows.select("domain").distinct().collect()))
    if not names:
        return Domains(("all",), np.zeros((BUCKETS, 1), np.float32), np.zeros(1))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "domain"])
        count = group["bucket"].map(len).to_numpy()
        label = group["domain"].map(names.index).to_numpy()
        w, b = train(np.concatenate(group["bucket"].to_list()).astype(np.int64), np.concatenate(group["value"].to_list()).astype(float), count, label, len(names))
        tokens.tidy()
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "intercepts": [b.tolist()]})

    models = rows.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(MODELS)).alias("model")).applyInPandas(one, "weights binary, intercepts array<double>").collect()
    weights = np.mean([np.frombuffer(r.weights, "<f4").reshape(BUCKETS, len(names)) for r in models], axis=0)
    return Domains(names, weights.astype(np.float32), np.mean([r.intercepts for r in models], axis=0))


def memberships(docs: DataFrame, domains: Domains, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with _tokens and one posterior column a domain (_p0, _p1, ...)."""
    held = docs.sparkSession.sparkContext.broadcast(domains)  # a few MB, whatever the input
    schema = StructType([*docs.select(*keep).schema.fields]).add("_tokens", LongType())
    for k in range(len(domains.names)):
        schema = schema.add(f"_p{k}", DoubleType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column("_scored")):
                part = batch.slice(a, b - a)
                p, words = held.value.posteriors(part.column("_scored"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(words, pa.int64()), *(pa.array(x) for x in p.T)], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(scored, schema)


def advance(r: Column, pull: list[float], floor: float) -> Column:
    """The rate one step on: it moves by the posterior's product with the domains' pull, then is projected."""
    move = sum((F.col(f"_p{k}") * F.lit(float(u)) for k, u in enumerate(pull)), F.lit(0.0))
    return F.greatest(F.lit(float(floor)), r - move)


def rate(steps: list[list[float]], floor: float) -> Column:
    """The rate after ``steps``."""
    r = F.lit(max(1.0, float(floor)))
    for pull in steps:
        r = advance(r, pull, floor)
    return r


def rates(p: np.ndarray, steps: list[list[float]], floor: float) -> np.ndarray:
    """``rate`` of rows with the posteriors ``p``, in numpy: a task takes any number of steps without a plan that grows."""
    r = np.full(len(p), max(1.0, float(floor)))
    for pull in steps:
        r = np.maximum(floor, r - p @ np.array(pull))
    return r


def tempered(share: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """A group's share (names up to the slash) to the power ``TEMPERATURE``; its domains keep their parts of it."""
    groups = [n.split("/")[0] for n in names]
    whole = np.array([sum(s for s, g in zip(share, groups) if g == own) for own in groups])
    return whole ** (TEMPERATURE - 1) * share


def fit_rates(members: DataFrame, domains: Domains, targets: dict[str, float] | None = None, floor: float = 0.0, grow: bool = False) -> list[list[float]]:
    """The projected-gradient steps towards ``targets`` (weights by domain).

    Without targets they are ``tempered``. The target total is the tokens there are, or with ``grow``
    the least total at which no domain has to shrink.
    """
    n = len(domains.names)
    narrow = members.select("_tokens", *(f"_p{k}" for k in range(n)))

    def totals(steps: list[list[float]]) -> np.ndarray:
        """Each domain's tokens at the rates after ``steps``: one row a task, then one."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(n)
            for batch in batches:
                own, *p = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
                p = np.stack(p, 1)
                held += (rates(p, steps, floor) * own) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=[f"t{k}" for k in range(n)])

        row = narrow.mapInArrow(part, ", ".join(f"t{k} double" for k in range(n))).agg(*(F.sum(f"t{k}") for k in range(n))).first()
        return np.array([x or 0.0 for x in row])

    now = totals([])
    whole = now.sum()
    if not whole:
        return []
    share = np.maximum(now / whole, 1e-9)
    if unknown := sorted(set(targets or ()) - set(domains.names)):
        raise ValueError(f"targets without a domain: {', '.join(unknown)}")
    weight = tempered(share, domains.names) if targets is None else np.array([targets.get(x, 0.0) for x in domains.names])
    if floor > 0 and (weight <= 0).any():
        raise ValueError(f"no weight for {', '.join(x for x, w in zip(domains.names, weight) if w <= 0)}, of which a rate of {floor} keeps documents")
    weight = weight / weight.sum()
    total = whole * max(1.0, (share / np.maximum(weight, 1e-12)).max()) if grow else whole
    steps: list[list[float]] = []
    for _ in range(ROUNDS):
        off = (now - weight * total) / whole
        if np.abs(off).max() < CLOSE:
            break
        steps.append((off / share).tolist())
        now = totals(steps)
    else:
        left = float(np.abs(now - weight * total).max() / whole)
        if left >= CLOSE:
            warnings.warn(f"mixing ended after {ROUNDS} rounds, {left:.1e} of all tokens from its targets", stacklevel=2)
    return steps


def copies(rates: Column, *seed: Column) -> Column:
    """A rate as a whole number of copies: its fraction decides by a hash of the row, the same on every run."""
    u = F.pmod(F.xxhash64(*seed), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rates + u).cast("int")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the rows that the labels cover: language and quality."""
    known = docs.where("lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    return labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").join(known, "doc_id").select("doc_id", F.concat_ws("/", "lang", "quality").alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, rate and posteriors of every document for the tempered targets."""
    docs = common.table(spark, sf_dir, "documents")
    domains = fit(docs, labelled_domains(docs, common.table(spark, sf_dir, "labels")))
    members = common.written(memberships(docs, domains, ["doc_id"]), "members")
    steps = fit_rates(members, domains)
    return members.select("doc_id", F.col("_tokens").alias("n_tokens"), rate(steps, 0.0).alias("rate"), *(F.col(f"_p{k}").alias(f"p_{name.replace('/', '_')}") for k, name in enumerate(domains.names)))
