"""Statistics over groups: partial aggregates and unbounded windows; ratios are taken once, after totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.nulls import finite, finite_sql, ratio


#: The quantile sketch's accuracy, and how many values of a group need no narrowing.
ACCURACY = 10_000
FEW = 10 * ACCURACY


def percentiles(df: DataFrame, keys: list[str], value: Column, at: dict[str, float], count: str | None = None) -> DataFrame:
    """Exact percentiles (linear interpolation) by group: ``at`` maps a column's name to its share, ``count`` names the values' number.

    A first pass sketches each group's quantiles. Two ranks beside each wanted
    one enclose it by the sketch's error bound, so a second pass keeps apart only
    the values between them and counts the others as a few cells: no task holds
    a group's values, and neither pass shuffles more than partial aggregates and
    those values. Groups of few values (``FEW``) keep them all.
    """
    rows = df.select(*keys, finite(value).alias("__v")).where("__v IS NOT NULL")
    step = 3 / ACCURACY
    ends = [(max(0.0, q - step), min(1.0, q + step)) for q in at.values()]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", [e for pair in ends for e in pair], ACCURACY).alias("__b"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(bounds.withColumnsRenamed({k: f"__{k}" for k in keys}), same) if keys else rows.crossJoin(F.broadcast(bounds))
    v, low = F.col("__v"), lambda k: F.col("__b")[2 * k]
    inside = F.col("__n") <= FEW
    for k in range(len(ends)):
        inside = inside | v.between(low(k), F.col("__b")[2 * k + 1])
    # Between windows, values are one cell: that of the windows that begin below them.
    cell = sum(((v >= low(k)).cast("int") for k in range(len(ends))), F.lit(0))
    cells = joined.groupBy(*keys, "__n", F.when(inside, v).alias("__slot"), F.when(~inside, cell).alias("__cell")).agg(F.count("*").alias("__c"), F.min("__v").alias("__at"))
    ranked = cells.withColumn("__to", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    from_ = F.col("__to") - F.col("__c")

    def pick(rank: Column) -> Column:
        return F.max(F.when((from_ <= rank) & (rank < F.col("__to")), F.col("__at")))

    out = []
    for name, q in at.items():
        place = (F.col("__n") - 1) * F.lit(float(q))
        lower, upper = pick(F.floor(place)), pick(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((lower + (upper - lower) * part).alias(name))
    if count:
        out.append(F.max("__n").alias(count))
    return ranked.groupBy(*keys).agg(*out)


def with_bounds(df: DataFrame, *cols: str, low: float | None = None, high: float | None = None, dimension: bool = False) -> DataFrame:
    """Each column's least and greatest value (or percentiles) beside every row: one aggregate row, broadcast.

    ``dimension``: the table is a small one behind a long plan, so bounds are
    windows over all of it and the plan runs once.
    """
    over = " OVER ()" if dimension else ""
    ends = lambda c, f, q: f"{f}({finite_sql(c)}){over}" if q is None else f"percentile({finite_sql(c)}, {q}D){over}"
    bounds = {f"{c}__{name}": ends(c, f, q) for c in cols for f, name, q in (("min", "lo", low), ("max", "hi", high))}
    if dimension:
        return df.selectExpr("*", *(f"{e} AS `{name}`" for name, e in bounds.items()))
    if low is None or high is None:
        return df.crossJoin(F.broadcast(df.selectExpr(*(f"{e} AS `{name}`" for name, e in bounds.items()))))
    for c in cols:
        df = df.join(F.broadcast(percentiles(df, [], F.col(c), {f"{c}__lo": low, f"{c}__hi": high})), F.lit(True), "left")
    return df


def scaled(c: str, inverse: bool = False) -> str:
    """0 to 100 between the bounds, clipped; 50 where they are one; null stays null. SQL."""
    lo, hi, v = f"`{c}__lo`", f"`{c}__hi`", finite_sql(c)
    up = f"CASE WHEN {hi} > {lo} THEN (least(greatest({v}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) * 100 ELSE 50D END"
    return f"CASE WHEN {v} IS NOT NULL THEN {'100 - ' if inverse else ''}{up} END"


def minmax(df: DataFrame, spec: dict[str, tuple[str, bool]], low: float | None = None, high: float | None = None, dimension: bool = False) -> DataFrame:
    """``spec``: new column -> (source column, inverse). All bounds come from one pass."""
    out = with_bounds(df, *dict.fromkeys(c for c, _ in spec.values()), low=low, high=high, dimension=dimension)
    made = [f"{scaled(c, inverse)} AS `{name}`" for name, (c, inverse) in spec.items()]
    return out.selectExpr(*(f"`{c}`" for c in df.columns if c not in spec), *made)


def quartile_level(df: DataFrame, c: str, name: str = "level", dimension: bool = False, names: tuple[str, str] = ("high", "low")) -> DataFrame:
    """``names``: the level at or under the first quartile (tested first) and the one at or over the third; else medium. ``dimension``: as in ``with_bounds``."""
    v = finite(F.col(c))
    if dimension:
        all_ = Window.partitionBy()
        bounded = df.withColumns({"__q1": F.percentile(v, 0.25).over(all_), "__q3": F.percentile(v, 0.75).over(all_)})
    else:
        bounded = df.join(F.broadcast(percentiles(df, [], v, {"__q1": 0.25, "__q3": 0.75})), F.lit(True), "left")
    level = F.when(v <= F.col("__q1"), names[0]).when(v >= F.col("__q3"), names[1]).when(v.isNotNull(), "medium")
    return bounded.withColumn(name, level).drop("__q1", "__q3")


def entropy(df: DataFrame, keys: list[str], category: str, weight: Column | None = None) -> DataFrame:
    """Shannon entropy in bits of each group's categories; missing categories are one of their own."""
    n = F.sum(weight) if weight is not None else F.count("*")
    counts = df.groupBy(*keys, F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("__c")).agg(n.cast("double").alias("__n")).where("__n > 0")
    # The entropy of counts needs their sum and the sum of n log n alone: one more partial aggregate.
    return counts.groupBy(*keys).agg((F.log2(F.sum("__n")) - F.sum(F.col("__n") * F.log2("__n")) / F.sum("__n")).alias("entropy"))


def ols(y: Column, x: Column) -> dict[str, Column]:
    """Least squares of finite pairs: null without two pairs or spread in x; r2 is null without spread in y."""
    fy, fx = finite(y), finite(x)
    y_, x_ = F.when(fx.isNotNull(), fy), F.when(fy.isNotNull(), fx)
    ok = (F.count(y_) >= 2) & (F.var_pop(x_) > 0)
    return {
        "n": F.count(y_),
        "slope": F.when(ok, F.regr_slope(y_, x_)),
        "intercept": F.when(ok, F.regr_intercept(y_, x_)),
        "r2": F.when(ok & (F.var_pop(y_) > 0), F.regr_r2(y_, x_)),
    }


def shrunk(x: Column, n: Column, whole: Column, k: float) -> Column:
    """Empirical Bayes: a group's value drawn to the whole's by k units of evidence; no value is the whole's."""
    return F.when(x.isNull(), whole).otherwise((n * x + k * whole) / (n + k))


def rollup_ratio(df: DataFrame, keys: list[str], top: Column, bottom: Column) -> DataFrame:
    """Totals of each level of the keys, then one ratio; never a mean of ratios."""
    out = df.rollup(*keys).agg(F.sum(top).alias("top"), F.sum(bottom).alias("bottom"))
    return out.withColumn("ratio", ratio(F.col("top"), F.col("bottom")))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order: an aggregate of one struct, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(o.alias(f"__{i}") for i, o in enumerate(order)), *rest)
    return df.groupBy(*keys).agg(F.min(ranked).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))
