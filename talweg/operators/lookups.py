"""Lookups with accounting: coverage, codes of several levels, nested lists, positions, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covered_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inner join, one row: expected keys of the left, matched ones, their ratio and a reason where some are missing)."""
    joined = left.join(right, key)
    keys = left.select(key).distinct().join(right.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    counted = keys.agg(F.count("*").alias("expected"), F.count("__there").alias("matched"))
    ratio = F.coalesce(F.try_divide(F.col("matched"), F.col("expected")), F.lit(0.0))
    return joined, counted.withColumns({"coverage_ratio": ratio, "reason": F.when(F.col("matched") < F.col("expected"), "incomplete_coverage")})


def nested_values(df: DataFrame, outer: str, key: Column, values: Column, name: str) -> DataFrame:
    """(key, name): the distinct values that go with each element of a nested list, over all rows.

    ``key`` reads the element ``x`` of the array ``outer``; ``values`` is an array of the row's.
    """
    pairs = df.select(F.explode(outer).alias("x"), values.alias("__v")).select(key.alias("key"), F.explode("__v").alias("__v")).distinct()
    return pairs.groupBy("key").agg(F.array_sort(F.collect_list("__v")).alias(name))


def level_names(df: DataFrame, names: DataFrame, levels: list[str], asked: dict[str, dict[str, str]]) -> DataFrame:
    """Names of composite codes: ``asked`` maps a new column to the levels that a wildcard stands in for.

    ``names``: the levels and name; of a key that comes twice the last (``_ord``) counts.
    """
    one = names.groupBy(*levels).agg(F.max_by("name", "_ord").alias("__name"))
    out = df
    for column, wild in asked.items():
        keys = [F.lit(wild[c]) if c in wild else F.col(c) for c in levels]
        side = one.withColumnsRenamed({c: f"__{c}" for c in levels}).withColumnRenamed("__name", column)
        match = F.lit(True)
        for c, k in zip(levels, keys):
            match = match & (F.col(f"__{c}") == k)
        out = out.join(side, match, "left").drop(*(f"__{c}" for c in levels))
    return out


def zipped(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of both sides by their places within a group; groups whose lengths differ fail the job."""
    place = lambda df: df.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    both = place(left).join(place(right).drop(order).withColumn("__right", F.lit(True)), [group, "__place"], "full")
    ok = F.assert_true(F.col("__right").isNotNull() & F.col(order).isNotNull(), F.lit("paired lists differ in length"))
    return both.withColumn("__ok", ok).where("__ok IS NULL").drop("__ok", "__right")


def dataset_sources(datasets: DataFrame, sources: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(dataset, source, catalogue's columns); a source that the catalogue has twice fails the job."""
    from talweg.operators.joins import lookup

    return lookup(datasets.join(sources, "dataset"), catalogue, ["source"])


def explained(codes: DataFrame, key: str, reasons: str, registry: DataFrame) -> DataFrame:
    """(key, place, reason_code, documented, registry's columns): an array of codes in order, each once; unknown ones stay."""
    rows = codes.select(key, F.posexplode(F.array_distinct(F.filter(reasons, lambda x: x.isNotNull() & (x != "")))).alias("place", "reason_code"))
    return rows.join(registry.withColumn("__known", F.lit(True)), "reason_code", "left").withColumn("documented", F.col("__known").isNotNull()).drop("__known")


def with_provenance(records: DataFrame, sources: DataFrame, defaults: DataFrame) -> DataFrame:
    """Records with source, source_url, url_type and warnings.

    A record's own source (``source``) goes before its envelope's
    (``raw_source``) and the dataset's default; the envelope's address
    (``raw_source_url``) before the record's and the registry's (``sources``:
    source, url, url_type).
    """
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    own, raw = empty("source"), empty("raw_source")
    rows = records.join(defaults.withColumnRenamed("source", "__default"), "dataset", "left")
    rows = rows.withColumn("__source", F.coalesce(own, raw, F.col("__default"))).withColumn("__url", F.coalesce(empty("raw_source_url"), empty("source_url")))
    known = sources.select(F.col("source").alias("__source"), F.col("url").alias("__registered"), F.col("url_type").alias("__type"), F.lit(True).alias("__known"))
    met = rows.join(known, "__source", "left")
    unknown = F.col("__source").isNotNull() & F.col("__known").isNull()
    unresolved = F.col("__source").isNull() | (unknown & F.col("__url").isNull())
    warnings = F.filter(F.array(F.when(own != raw, "source_conflict"), F.when(unresolved, "source_unresolved"), F.when(unknown, "unknown_source_id")), lambda x: x.isNotNull())
    out = met.withColumns({"source": F.col("__source"), "source_url": F.coalesce("__url", "__registered"), "source_url_type": F.col("__type"), "warnings": warnings})
    return out.drop("__source", "__default", "__url", "__registered", "__type", "__known")


def first_by_code(df: DataFrame, code: str, order: str) -> DataFrame:
    """The first row of each code, with how many rows it has and whether it repeats."""
    rest = [c for c in df.columns if c != code]
    return df.groupBy(code).agg(F.min_by(F.struct(*rest), order).alias("__r"), F.count("*").alias("rows_of_code")).select(code, "__r.*", "rows_of_code", (F.col("rows_of_code") > 1).alias("repeated"))


def first_name(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """The first name that isn't null of each key."""
    return df.groupBy(*keys).agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name))


def last_present(df: DataFrame, keys: list[str], period: str, *values: str) -> DataFrame:
    """Each value of the last period that has one, with that period."""
    there = lambda v: F.when(F.col(v).isNotNull(), F.col(period))
    return df.groupBy(*keys).agg(*(x for v in values for x in (F.max_by(v, there(v)).alias(v), F.max(there(v)).alias(f"{v}_{period}"))))
