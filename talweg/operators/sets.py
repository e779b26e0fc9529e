"""Unions, dedupes, limits and quotas with explicit tie-breaks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.stats import first_by


#: Parts of a group that are cut by themselves.
SHARES = 64


def union_all(parts: list[DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """By name; columns that a part lacks are null.

    A part may be a function that opens it: one that can't be opened is left out
    (its schema is resolved here, its rows are read later). At least one is needed.
    """
    opened, failures = [], []
    for part in parts:
        try:
            df = part() if callable(part) else part
            df.schema  # noqa: B018
            opened.append(df)
        except (AnalysisException, OSError) as e:
            failures.append(e)
    if not opened:
        raise ValueError(f"every source failed: {'; '.join(map(str, failures))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), opened)


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_by(df, keys, F.col(order))


def merged_duplicates(df: DataFrame, key: Column, order: str, observed: str, flags: list[str], sums: list[str]) -> DataFrame:
    """One row a key: observations together, flags or-ed, counts added, the rest from the first row."""
    rest = [c for c in df.columns if c not in {observed, *flags, *sums}]
    return df.groupBy(key.alias("merge_key")).agg(
        F.min(F.struct(order, *(c for c in rest if c != order))).alias("first"),
        F.array_sort(F.flatten(F.collect_list(observed))).alias(observed),
        *(F.bool_or(f).alias(f) for f in flags),
        *(F.sum(s).alias(s) for s in sums),
    ).select("merge_key", "first.*", observed, *flags, *sums)


def unused(df: DataFrame, name: str) -> str:
    """``name``, behind as many underscores as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked_first(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their ``rank``. Each of ``SHARES`` parts of a group is cut first, so no task sorts a group.

    ``order`` may name any column of ``df``; the columns made on the way have names that it doesn't use.
    """
    share, place = unused(df, "__share"), unused(df, "__rank")
    rows = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = df.withColumn(share, F.pmod(F.xxhash64(F.spark_partition_id(), *rows), F.lit(SHARES)))
    first = lambda rows, name, *by: rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return first(first(dealt, place, group, share).drop(share, place), "rank", group)


def limited(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with the group's rows and whether it was cut."""
    totals = df.groupBy(group).agg(F.count("*").alias("group_rows"))
    return ranked_first(df, group, order, n).join(totals, group).withColumn("truncated", F.col("group_rows") > n)


def quotas(counts: dict[str, int], shares: dict[str, float], cap: int) -> dict[str, int]:
    """Floor quotas by share of the cap; what is left goes to groups with more rows, in the order given."""
    if sum(counts.values()) <= cap:
        return dict(counts)
    out = {g: min(counts.get(g, 0), int(cap * s)) for g, s in shares.items()}
    left = cap - sum(out.values())
    for g in shares:
        more = min(left, counts.get(g, 0) - out[g])
        out[g], left = out[g] + more, left - more
    return out


def quota_top(df: DataFrame, group: str, order: list[Column], shares: dict[str, float], cap: int) -> DataFrame:
    """At most ``cap`` rows by quota. Group sizes (one number a share) are all that the driver sees."""
    counts = {r[0]: r[1] for r in df.where(F.col(group).isin(list(shares))).groupBy(group).count().collect()}
    take = dict.fromkeys(shares, 0) | quotas(counts, shares, cap)
    allowed = F.create_map(*(F.lit(x) for kv in take.items() for x in kv)) if take else F.create_map()
    # No more than ``cap`` rows of a part of a group are ranked together.
    ranked = ranked_first(df.where(F.col(group).isin(list(shares))), group, order, cap)
    return ranked.where(F.col("rank") <= allowed[F.col(group)])


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long rows (metric_id, value), a null value kept."""
    wide = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot(keys, metrics, "metric_id", "value")


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` with each row's place from 0 by ``order``: ranges of it are sorted apart, and each adds what stands before it.

    The ranges are written once, so that places and counts are of the same ones; ``order`` has to be without ties.
    """
    from talweg.sources import scratch

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scratch.kept(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")
