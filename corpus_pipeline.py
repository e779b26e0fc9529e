"""The training-corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame with the columns of ``documents`` (the last: packed pieces).
``run`` writes each stage's rows as Parquet and reads them again for the next.

Nulls: a null text is an empty one in every stage and stays null; rows without an
id are scored, kept and packed. Rows that repeat an id and a text are one after
near-dedup; different texts under one id are documents of their own. Of a group
of near-duplicates the least id, then the least hash of the text, stays. Texts of
any length are read whole. Columns beyond those of documents go in the first
stage, whatever their names. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import common, op2_minhash_dedup, op3_toxicity, op4_packing, op5_pii, op9_mixing

#: SQL can't express the classifiers: tests hold every stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from the labels of the fold that isn't held out."""
    model = op3_toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return op3_toxicity.score(docs, model, common.DOCUMENT_COLUMNS).where("predicted = 0").select(common.DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id, then of least hash. Rows without an id stay."""
    return op2_minhash_dedup.one_of_each(docs.select(common.DOCUMENT_COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets."""
    return op5_pii.redact(docs).select(common.DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at the fitted rates; the rates are 1 at least, so no clean document goes."""
    labelled = op9_mixing.labelled_domains(docs, common.table(spark, sf_dir, "labels"))
    domains = op9_mixing.fit(docs, labelled)
    members = common.written(op9_mixing.memberships(docs, domains, common.DOCUMENT_COLUMNS), "members")
    steps = op9_mixing.fit_rates(members, domains, floor=1.0, grow=True)
    times = F.greatest(F.lit(1), op9_mixing.copies(op9_mixing.rate(steps, 1.0), F.col("doc_id"), F.col("_tokens")))
    return members.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(common.DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row a piece."""
    return op4_packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
