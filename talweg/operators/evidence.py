"""Evidence: long facts, scoped filters, period policy, de-duplication, quotas, inventory, fingerprint."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKED = {"raw_record", "raw_records", "_quality", "note", "notes"}


def public(df: DataFrame) -> DataFrame:
    """The table if no column, at any depth, is a raw one; a walk over the schema, not the data."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                if f.name in ("raw_record", "raw_records"):
                    raise ValueError(f"raw records must not be published: {path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, MapType):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return df


LEVELS = 8


def flatten(payloads: DataFrame, body: str, key: str) -> DataFrame:
    """(key, path, value) of each leaf of a JSON payload; blocked keys are left out.

    Objects and arrays are unfolded level by level with VARIANT functions: a
    generator for each level, no Python. What lies deeper than ``LEVELS`` is
    walked by a small helper in the same plan; payloads rarely have any of it.
    """
    import json

    blocked = json.dumps(sorted(BLOCKED))
    names = F.from_json(F.lit(blocked), "array<string>")
    now = payloads.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(F.col(body)).alias("v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    deep = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    done = None
    for _ in range(LEVELS):
        leaf = now.where(~deep).select(key, "path", F.col("v").cast("string").alias("value"))
        done = leaf if done is None else done.unionAll(leaf)
        nxt = now.where(deep).select(key, "path", F.explode(F.coalesce(F.expr("try_cast(v as map<string,variant>)"), F.map_from_entries(F.transform(F.expr("try_cast(v as array<variant>)"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))))).alias("__name", "v"))
        now = nxt.where(~F.array_contains(names, F.col("__name"))).select(key, F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("__name")).alias("path"), "v")
    rest = now.select(key, "path", F.to_json("v").alias("body"))
    return done.where("value IS NOT NULL").unionAll(rest.mapInPandas(_walked(key), f"{key} {dict(rest.dtypes)[key]}, path string, value string"))


def _walked(key: str):
    """Leaves of the bodies of each batch, without recursion."""
    import json

    import pandas as pd

    def leaves(path: str, body: str):
        todo = [(path, json.loads(body, parse_int=str, parse_float=str))]
        while todo:
            at, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{at}.{k}" if at else k, y) for k, y in reversed(x.items()) if k not in BLOCKED]
            elif isinstance(x, list):
                todo += [(f"{at}.{k}" if at else str(k), y) for k, y in reversed(list(enumerate(x)))]
            elif x is not None:
                yield at, x if isinstance(x, str) else str(x).lower()

    def walk(batches):
        for batch in batches:
            rows = [(k, p, v) for k, path, body in zip(batch[key], batch["path"], batch["body"]) for p, v in leaves(path, body)]
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return walk


def record_evidence(records: DataFrame, measures: dict[str, dict[str, str]], dataset: str = "dataset", period: str = "period", order: str = "record_index") -> DataFrame:
    """Long facts from curated records: a record's own metric and value, else each of its dataset's measure columns that has one.

    ``measures``: dataset -> measure column -> unit. The id is
    dataset:period:record:metric, so a record's facts stay apart.
    """
    fields = sorted({m for of in measures.values() for m in of if m in records.columns})
    direct = F.col("metric_id").isNotNull() & F.col("value").isNotNull()
    own = F.struct(F.col("metric_id").alias("metric_id"), F.lit("metric_id").alias("metric_source"), F.col("value").cast("string").alias("value"), (F.col("unit") if "unit" in records.columns else F.lit(None).cast("string")).alias("unit"))
    unit = lambda m: F.coalesce(*(F.when(F.col(dataset) == d, F.lit(of[m])) for d, of in measures.items() if m in of))
    mine = lambda m: F.col(dataset).isin(*(d for d, of in measures.items() if m in of)) & F.col(m).isNotNull()
    wide = [F.when(mine(m), F.struct(F.lit(m).alias("metric_id"), F.lit("record_field").alias("metric_source"), F.col(m).cast("string").alias("value"), unit(m).alias("unit"))) for m in fields]
    found = F.when(direct, F.array(own)).otherwise(F.filter(F.array(*wide), lambda x: x.isNotNull()) if wide else F.array().cast("array<struct<metric_id:string,metric_source:string,value:string,unit:string>>"))
    keep = [c for c in records.columns if c not in {"metric_id", "value", "unit", *fields}]
    rows = records.select(*keep, F.explode(found).alias("__f")).select(*keep, "__f.*")
    return rows.withColumn("evidence_id", F.concat_ws(":", dataset, period, F.col(order).cast("string"), "metric_id"))


def capped(rows: DataFrame, body: str, caps: dict[str, int], default: int = 120) -> DataFrame:
    """Arrays of rows (``body``, with ``path``) cut to their path's cap, with how many went, and exploded after that."""
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("path")), F.lit(default)) if caps else F.lit(default)
    cut = rows.withColumns({"__n": F.size(body), "__cap": cap}).withColumn(body, F.slice(body, 1, F.col("__cap")))
    return cut.select("path", F.greatest(F.col("__n") - F.col("__cap"), F.lit(0)).alias("dropped"), F.posexplode(body).alias("place", "row"))


def artifacts(available: DataFrame, datasets: list[str] | None, area: str | None, areas: dict[str, list[str]]) -> DataFrame:
    """The artifacts to read: those named, else those of a focus area that has any, else all. ``available``: key."""
    if datasets is not None:
        return available.where(F.col("key").isin(*datasets) | F.concat(F.lit("analytics:"), F.col("key")).isin(*datasets))
    wanted = areas.get((area or "").strip().lower())
    if wanted is None:
        return available
    one = available.agg(F.count_if(F.col("key").isin(*wanted)).alias("__n"))
    return available.crossJoin(F.broadcast(one)).where((F.col("__n") == 0) | F.col("key").isin(*wanted)).drop("__n")


def assembled(facts: DataFrame, comparison: list[str], focus: list[str], districts: list[str], shares: dict[str, float], cap: int, requested: str | None = None) -> DataFrame:
    """The evidence of one question: the comparison metrics for every district, and the focus ones of its own; each fact once, then by quota.

    Facts that the comparison asks for come first; ``shares`` are by
    ``metric_source``.
    """
    from talweg.operators.sets import quota_top
    from talweg.operators.stats import first_by

    inside = period_policy(facts, requested)
    wide = scoped(inside, metrics=comparison).withColumn("__rank", F.lit(0)) if comparison else None
    own = scoped(inside, districts=districts, metrics=focus).withColumn("__rank", F.lit(1))
    both = own if wide is None else wide.unionByName(own)
    once = first_by(both, ["evidence_id"], F.col("__rank"))
    return quota_top(once, "metric_source", [F.asc("__rank"), F.asc("evidence_id")], shares, cap).drop("__rank", "rank")


#: Facts that one artifact may bring, whatever it holds.
ARTIFACT_CAP = 4000


def artifact_cap(facts: DataFrame, artifact: str, order: str, cap: int = ARTIFACT_CAP) -> DataFrame:
    """The first ``cap`` facts of each artifact, in their order, with ``artifact_facts`` (how many it has) and ``truncated``."""
    from talweg.operators.sets import limited

    return limited(facts, artifact, [F.asc(order)], cap).withColumnRenamed("group_rows", "artifact_facts").drop("rank")


def limitations(facts: DataFrame, context: DataFrame, metrics: list[str], districts: list[str]) -> DataFrame:
    """(code, subject, n): what a context of a question can't say.

    ``facts``: all there are (metric_id, dataset, youth_eligibility,
    district_name, geo_level); ``context``: those taken. A metric that is asked for
    has no evidence, or only in part (some facts were cut), a district is without
    facts of its own, facts taken are proxies or context only.
    """
    spark = facts.sparkSession
    asked = F.broadcast(spark.createDataFrame([(m,) for m in metrics], "subject string"))
    named = F.broadcast(spark.createDataFrame([(d,) for d in districts], "subject string"))
    have = facts.where(F.col("metric_id").isin(*metrics)).groupBy(F.col("metric_id").alias("subject")).agg(F.count("*").alias("have"))
    took = context.groupBy(F.col("metric_id").alias("subject")).agg(F.count("*").alias("took"))
    state = asked.join(have, "subject", "left").join(took, "subject", "left").fillna(0, ["have", "took"])
    code = F.when(F.col("have") == 0, "no_evidence").when(F.col("took") < F.col("have"), "evidence_cut")
    of_metrics = state.select(code.alias("code"), "subject", (F.col("have") - F.col("took")).alias("n")).where("code IS NOT NULL")
    own = context.where("geo_level = 'district'").groupBy(F.col("district_name").alias("subject")).agg(F.count("*").alias("k"))
    of_districts = named.join(own, "subject", "left_anti").select(F.lit("no_district_evidence").alias("code"), "subject", F.lit(0).cast("long").alias("n"))
    marked = context.where(F.col("youth_eligibility").isin("proxy", "context")).groupBy("youth_eligibility").agg(F.count("*").alias("n"))
    return of_metrics.unionByName(of_districts).unionByName(marked.select(F.concat("youth_eligibility", F.lit("_evidence")).alias("code"), F.lit("").alias("subject"), "n"))


def item_evidence(items: DataFrame, plans: dict[str, list[str]], area: str) -> DataFrame:
    """Leaves of the serving items that an area reads: (pk, sk, path, value). ``items``: pk, sk, body; ``plans``: area -> partitions."""
    mine = items.where(F.col("pk").isin(*plans[area])).withColumn("__key", F.to_json(F.struct("pk", "sk")))
    return flatten(mine, "body", "__key").select(F.get_json_object("__key", "$.pk").alias("pk"), F.get_json_object("__key", "$.sk").alias("sk"), "path", "value")


class Repository(Protocol):
    """Where facts come from: a query in, facts out."""

    def facts(self, districts: list[str], metrics: list[str], eligibility: list[str], period: str | None) -> DataFrame: ...


@dataclass(frozen=True)
class TableRepository:
    """Facts of one table, scoped and under the period policy, each dataset's rows up to a limit."""

    table: DataFrame
    limit: int = 4000

    def facts(self, districts: list[str] = (), metrics: list[str] = (), eligibility: list[str] = (), period: str | None = None) -> DataFrame:
        from talweg.operators.sets import limited

        rows = period_policy(scoped(self.table, districts, metrics, eligibility), period)
        return limited(rows, "dataset", [F.asc("evidence_id")], self.limit)


@dataclass(frozen=True)
class CompositeRepository:
    """Several repositories as one; those that can't answer are left out, all failing is an error."""

    parts: list[Repository]

    def facts(self, districts: list[str] = (), metrics: list[str] = (), eligibility: list[str] = (), period: str | None = None) -> DataFrame:
        from talweg.operators.sets import union_all

        return union_all([lambda p=p: p.facts(districts, metrics, eligibility, period) for p in self.parts])


def scoped(facts: DataFrame, districts: list[str] = (), metrics: list[str] = (), eligibility: list[str] = ()) -> DataFrame:
    """The district condition binds district rows only; wider rows always pass it."""
    out = facts
    if districts:
        out = out.where((F.col("geo_level") != "district") | F.col("district_name").isin(*districts) | F.col("district_id").cast("string").isin(*districts))
    if metrics:
        out = out.where(F.col("metric_id").isin(*metrics))
    if eligibility:
        out = out.where(F.col("youth_eligibility").isin(*eligibility))
    return out


def period_policy(facts: DataFrame, requested: str | None = None) -> DataFrame:
    """Snapshots stay; yearly facts are of the requested year or their dataset's last; others must equal the request."""
    last = F.max(F.when(F.col("period_type") == "year", F.col("period"))).over(Window.partitionBy("dataset"))
    want = F.lit(requested)
    keep = (F.col("period_type") == "snapshot") | ((F.col("period_type") == "year") & (F.col("period") == F.coalesce(want, F.col("__last"))))
    if requested is not None:
        keep = keep | ((F.col("period_type") == "month") & (F.col("period") == want))
    return facts.withColumn("__last", last).where(keep).drop("__last")


def inventory(facts: DataFrame) -> DataFrame:
    """Distinct labels by eligibility, sorted."""
    return facts.groupBy("youth_eligibility").agg(F.array_join(F.sort_array(F.collect_set("metric_id")), ",").alias("labels"), F.countDistinct("metric_id").alias("n"))


def fingerprint(facts: DataFrame, key: str, value: str) -> DataFrame:
    """One hash of all (key, value), whatever their order: a sum of row hashes in wide decimals, then hashed."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit("\x00"))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return facts.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("string")), 256).alias("fingerprint"))
