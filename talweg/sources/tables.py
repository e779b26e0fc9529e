"""Landed files in, partitioned tables out.

Curated data is Parquet partitioned by (dataset, output_key): a period scan is
partition pruning, a column scan is column pruning. A small catalogue table
lists what each partition holds.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CATALOGUE = "dataset string, output_key string, path string, period_strategy string, source_period string, transform_version int"
CHARSETS = ("utf-8-sig", "cp950", "big5")


class Curated:
    """Scans of a curated root, dataset by dataset.

    A scan reads the folders of the periods that it is asked for, and no other
    file's footer; periods are the names of a dataset's folders. A dataset's schema is stated,
    or merged over the files of those folders.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType | str] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas or {}

    def _folders(self, path: str, prefix: str) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def keys(self, dataset: str) -> set[str]:
        self._guard(dataset)
        return set(self._folders(f"{self.root}/dataset={dataset}", "output_key="))

    def period(self, dataset: str, key: str) -> DataFrame:
        return self.periods(dataset, [key])

    def periods(self, dataset: str, keys: list[str]) -> DataFrame:
        """Strict: every period must be there."""
        self._guard(dataset, *keys)
        if missing := sorted(set(keys) - self.keys(dataset)):
            raise FileNotFoundError(f"{dataset}: no {', '.join(missing)}")
        return self._where(dataset, sorted(set(keys)))

    def available(self, dataset: str, keys: list[str]) -> DataFrame:
        """Lenient: what is there of the periods; none is an error."""
        self._guard(dataset, *keys)
        if not (have := sorted(set(keys) & self.keys(dataset))):
            raise FileNotFoundError(f"{dataset}: none of {', '.join(keys)}")
        return self._where(dataset, have)

    def latest(self, dataset: str) -> DataFrame:
        if not (keys := self.keys(dataset)):
            raise FileNotFoundError(f"{dataset}: no period")
        return self._where(dataset, ["latest" if "latest" in keys else max(keys)])

    def everything(self, dataset: str) -> DataFrame:
        return self.available(dataset, sorted(self.keys(dataset)))

    def all_available(self, dataset: str, index: DataFrame) -> DataFrame:
        """Rows of every path that the index has for all of a dataset's time, each path once. ``index``: dataset, output_key, path."""
        whole = index.where((F.col("dataset") == dataset) & (F.col("output_key").isNull() | (F.col("output_key") == "all") | F.col("path").endswith("/all.json")))
        paths = [r.path for r in whole.select("path").distinct().orderBy("path").collect()]
        if not paths:
            raise FileNotFoundError(f"{dataset}: nothing for all of its time")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def _guard(self, *names: str) -> None:
        if any("/" in x or "\\" in x or x in ("", ".", "..") for x in names):
            raise ValueError("a dataset or period that leaves the root")

    def _where(self, dataset: str, keys: list[str]) -> DataFrame:
        """The rows of these periods' folders, with the folders' names as they are written."""
        self._guard(dataset, *keys)
        stated = self.schemas.get(dataset)
        reader = self.spark.read.schema(stated) if stated else self.spark.read.option("mergeSchema", "true")
        # The folders themselves are the paths, so nothing guesses a type for their names.
        rows = reader.option("recursiveFileLookup", "true").parquet(*(f"{self.root}/dataset={dataset}/output_key={k}" for k in keys))
        return rows.withColumns({"dataset": F.lit(dataset), "output_key": F.regexp_extract("_metadata.file_path", "/output_key=([^/]+)/", 1)})


def write_partitions(df: DataFrame, root: str) -> None:
    """Replace the (dataset, output_key) partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "output_key").parquet(root)


def write_triple(accepted: DataFrame, quarantine: DataFrame, quality: DataFrame, root: str, dataset: str, key: str) -> None:
    for name, df in (("curated", accepted), ("quarantine", quarantine), ("quality", quality)):
        write_partitions(df.withColumns({"dataset": F.lit(dataset), "output_key": F.lit(key)}), f"{root}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def newest(listing: DataFrame, group: str, path: str = "path", modified: str = "modified") -> DataFrame:
    """The newest raw file of each group: by the timestamp in its name, else by when it changed, then by name."""
    stamp = F.try_to_timestamp(F.regexp_extract(path, r"([0-9]{8}T[0-9]{6})Z?", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return listing.groupBy(group).agg(F.max_by(path, F.struct(F.coalesce(stamp, F.col(modified).cast("timestamp")), F.col(path))).alias(path))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects or an envelope with ``records``, one row a record, with its place; anything else fails the job."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_path"), F.parse_json("value").alias("v"))
    records = F.coalesce(F.expr("try_cast(variant_get(v, '$.records', 'variant') as array<variant>)"), F.expr("try_cast(v as array<variant>)"))
    rows = raw.select("_path", F.expr("try_variant_get(v, '$.fetched_at', 'string')").alias("fetched_at"), records.alias("records"))
    rows = rows.withColumn("_ok", F.assert_true(F.col("records").isNotNull(), F.lit("neither an array nor an envelope with records"))).where("_ok IS NULL")
    each = rows.select("_path", "fetched_at", F.posexplode("records").alias("_ord", "record"))
    is_object = F.schema_of_variant("record").startswith("OBJECT")
    return each.withColumn("_ok", F.assert_true(F.coalesce(is_object, F.lit(False)), F.lit("a record is no object"))).where("_ok IS NULL").drop("_ok")


def read_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV files in the first charset in which they decode and have the header; a malformed row fails the job.

    Spark's own reader knows none of the legacy charsets, so files (small, as
    landed extracts are) are decoded in a task each.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                rows = None
                for charset in CHARSETS:
                    try:
                        rows = list(csv.reader(io.StringIO(content.decode(charset), newline="")))
                    except UnicodeDecodeError:
                        continue
                    if rows and set(header) <= set(rows[0]):
                        break
                else:
                    raise ValueError(f"{p}: no charset gives the header {', '.join(header)}")
                if any(len(r) != len(rows[0]) for r in rows):
                    raise ValueError(f"{p}: a row has another number of fields than the header")
                yield pd.DataFrame({"path": p, "_ord": range(len(rows)), "fields": rows})

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, _ord long, fields array<string>")
    names = cells.where("_ord = 0").first().fields
    return cells.where("_ord > 0").select("_ord", *(F.col("fields")[k].alias(n) for k, n in enumerate(names)))


def read_zip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, member, content) of the members whose name matches; a name that leaves the archive is an error."""
    import re

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if ".." in name.split("/") or name.startswith("/"):
                            raise ValueError(f"{p}: {name} leaves the archive")
                        if re.search(member, name):
                            yield pd.DataFrame({"path": [p], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "path string, member string, content binary")


def verified_binary(df: DataFrame, content: str, sha256: str) -> DataFrame:
    """The rows, failing where a content's hash isn't the one stated."""
    ok = F.assert_true(F.sha2(content, 256) == F.col(sha256), F.lit("content does not match its hash"))
    return df.withColumn("_ok", ok).where("_ok IS NULL").drop("_ok")


def publish(tables: dict[str, DataFrame], root: str, snapshot: str, candidate: bool = False) -> None:
    """Write a snapshot's tables and manifest, and move the pointer last."""
    from talweg.operators.evidence import public

    spark = next(iter(tables.values())).sparkSession
    sizes = []
    for name, df in tables.items():
        public(df).write.mode("overwrite").json(f"{root}/snapshot_id={snapshot}/{name}", ignoreNullFields=False)
        sizes.append((name, spark.read.text(f"{root}/snapshot_id={snapshot}/{name}").count()))
    spark.createDataFrame(sizes, "name string, n long").coalesce(1).write.mode("overwrite").json(f"{root}/snapshot_id={snapshot}/manifest")
    if not candidate:
        # Only added to: a reader meets the pointer before or after, never none.
        moved = spark.createDataFrame([(snapshot,)], "snapshot_id string").withColumn("at", F.current_timestamp())
        moved.coalesce(1).write.mode("append").parquet(f"{root}/current")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the snapshot that the pointer named last."""
    snapshot = spark.read.parquet(f"{root}/current").agg(F.max_by("snapshot_id", "at").alias("s")).first().s
    return spark.read.json(f"{root}/snapshot_id={snapshot}/{name}")


def items(df: DataFrame, pk: str, sk: list[str]) -> DataFrame:
    """Serving items: pk, sk and a JSON body without nulls lost."""
    from talweg.operators.evidence import public

    key = F.concat_ws("#", *(F.col(c).cast("string") for c in sk))
    return public(df).select(F.lit(pk).alias("pk"), key.alias("sk"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))
