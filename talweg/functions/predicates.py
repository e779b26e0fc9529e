"""Predicates and rewritings of landed text with fixed word lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from talweg.functions.nulls import finite

# Uses that are homes, markers that aren't, words of degrees.
HOME_USES = ["住家用", "集合住宅", "住宅"]
BUSINESS_MARKERS = ["店面", "辦公", "商業", "工廠", "廠辦", "倉庫"]
HOME_MARKERS = ["住家", "住宅", "集合住宅"]
DEGREES = ["大學", "專科", "學士", "碩士", "博士"]
RENTAL_TYPES = {"整棟(戶)出租": "整戶", "獨立套房": "獨立套房", "分租套房": "分租套房", "分租雅房": "分租雅房", "分層出租": "分層出租"}


def any_in(c: Column, words: list[str]) -> Column:
    """One of the words is contained; null contains none."""
    text = F.coalesce(c, F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def home_listing(target: Column, usage: Column, building: Column, targets: list[str]) -> Column:
    """A listed target of residential use in a building without a business marker."""
    return F.coalesce(F.trim(target).isin(targets) & F.trim(usage).isin(HOME_USES), F.lit(False)) & ~any_in(building, BUSINESS_MARKERS)


def home_sale(kind: Column, area: Column, usage: Column, land_use: Column) -> Column:
    """A sale of a home: called so, or a building with an area whose use or zone is residential; never bare land."""
    zone = any_in(land_use, ["住宅區"]) | F.coalesce(F.trim(land_use).isin("住", "住宅"), F.lit(False))
    built = ~F.coalesce(kind == "土地", F.lit(False)) & (F.coalesce(finite(area), F.lit(0.0)) != 0)
    return F.coalesce(kind == "住宅用", F.lit(False)) | (built & (any_in(usage, HOME_MARKERS) | zone))


def college(requirement: Column) -> Column:
    return any_in(requirement, DEGREES)


def labelled(code: Column, names: dict[str, str], default: str) -> Column:
    """A code's name, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.trim(code)), F.lit(default))


def question_period(explicit: Column, question: Column) -> Column:
    """The period that is asked for, else a three-digit year that the question names."""
    named = F.regexp_extract(question, r"(?<![0-9])([0-9]{3})\s*年", 1)
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.nullif(named, F.lit("")))


def sanitized(df: DataFrame, internal: tuple[str, ...] = ("_quality", "raw_record", "raw_records")) -> DataFrame:
    """The table without internal fields at any depth, non-finite numbers null: a projection from the schema."""

    def clean(c: Column, kind) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return finite(c)
        if isinstance(kind, StructType):
            fields = [clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in internal]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in internal))
