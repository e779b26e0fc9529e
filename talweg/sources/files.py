"""Landed files that Spark has no reader for: spreadsheets, page texts, shapes, topologies; caches and cascades of sources.

Files are small, as landed extracts are: each is one row of Spark's binary reader
and is parsed by a small helper in its task; everything after it is columns.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, value string"
# The namespaces of the two spreadsheet formats.
XLSX = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ODS = {"t": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "x": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    read = lambda name: ElementTree.fromstring(z.read(name))
    text = lambda e: "".join(x.text or "" for x in e.iter(f"{{{XLSX['m']}}}t"))
    shared = [text(si) for si in read("xl/sharedStrings.xml").findall("m:si", XLSX)] if "xl/sharedStrings.xml" in z.namelist() else []
    target = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    for sheet in read("xl/workbook.xml").iterfind("m:sheets/m:sheet", XLSX):
        name = target[sheet.get(RELATION)].lstrip("/")
        for c in read(name if name.startswith("xl/") else f"xl/{name}").iter(f"{{{XLSX['m']}}}c"):
            v = c.find("m:v", XLSX)
            value = text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            if value is not None:
                yield sheet.get("name"), int(re.search("[0-9]+", c.get("r"))[0]) - 1, _column(c.get("r")), value


def _ods(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    name = lambda k: f"{{{ODS['t']}}}{k}"
    for table in ElementTree.fromstring(z.read("content.xml")).iter(name("table")):
        at = 0
        for row in table.iter(name("table-row")):
            times, col = int(row.get(name("number-rows-repeated"), 1)), 0
            for cell in row:
                wide = int(cell.get(name("number-columns-repeated"), 1))
                value = "\n".join("".join(p.itertext()) for p in cell.findall("x:p", ODS))
                if value:
                    yield from ((table.get(name("name")), at + i, col + j, value) for i in range(times) for j in range(wide))
                col += wide
            at += times


def sheet_cells(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of an opened XLSX or ODS file."""
    return _ods(z) if "content.xml" in z.namelist() else _xlsx(z)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) of every cell of XLSX and ODS files."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = list(sheet_cells(z))
                yield pd.DataFrame([(p, *f) for f in found], columns=["path", "sheet", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, CELLS)


def sheet_of_year(cells: DataFrame, year: int | None = None) -> DataFrame:
    """Cells of each file's sheet of a republic-era year (in its name): the one asked for, else the latest."""
    named = F.regexp_extract("sheet", "([0-9]{2,3})", 1).try_cast("int")
    rows = cells.withColumn("year", named).where("year IS NOT NULL")
    if year is not None:
        return rows.where(F.col("year") == year)
    return rows.join(rows.groupBy("path").agg(F.max("year").alias("year")), ["path", "year"], "left_semi")


def measures_by_group(cells: DataFrame, header_row: int) -> DataFrame:
    """(path, sheet, measure, group, value): the header's columns are groups, the first column names the measure."""
    head = cells.where(F.col("row") == header_row).select("path", "sheet", "col", F.trim("value").alias("group"))
    name = cells.where(F.col("col") == 0).select("path", "sheet", "row", F.trim("value").alias("measure"))
    body = cells.where((F.col("row") > header_row) & (F.col("col") > 0)).select("path", "sheet", "row", "col", "value")
    return body.join(name, ["path", "sheet", "row"]).join(head, ["path", "sheet", "col"]).select("path", "sheet", "measure", "group", "value")


def page_rows(pages: DataFrame, key: str, texts: str, pattern: str, names: list[str]) -> DataFrame:
    """(key, page, place, names...): lines of page texts that match, their groups as columns; lines are single-spaced first."""
    line = pages.select(key, F.posexplode(texts).alias("page", "__text")).select(key, "page", F.posexplode(F.split("__text", r"\n")).alias("place", "__line"))
    line = line.withColumn("__line", F.trim(F.regexp_replace("__line", r"(?U)\s+", " "))).where(F.col("__line").rlike(pattern))
    return line.select(key, "page", "place", *(F.regexp_extract("__line", pattern, k).alias(n) for k, n in enumerate(names, 1)))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, lines) of every page of PDF files."""
    from talweg.sources import pdf

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                lines = pdf.page_lines(content)
                yield pd.DataFrame({"path": [p] * len(lines), "page": range(len(lines)), "lines": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page int, lines array<string>")


# Allocation codes and their table's name, and what marks a settlement's first page.
ALLOCATION = r"^(0[1-4])\s+(\S+)\s+([0-9,]+)$"
SOURCE = r"^(\S.*?)\s+([0-9,]+)\s+(-?[0-9,]+)\s+([0-9,]+)$"
RESULT = r"^([0-9,]+)\s+([0-9,]+)\s+([0-9,]+)\s+([0-9,]+)\s+(-?[0-9,]+)\s+([0-9.]+)$"
SETTLED = ["歲出機關", "原預算數"]


def _lines(pages: DataFrame) -> DataFrame:
    """(path, page, place, line) of pages (path, page, lines), single-spaced."""
    return pages.select("path", "page", F.posexplode("lines").alias("place", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"(?U)\s+", " ")))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("long")


def budget_allocations(pages: DataFrame, title: str) -> DataFrame:
    """(path, page, code, name, amount) of the pages with the table's title; a code that comes twice in a file fails the job."""
    lines = _lines(pages)
    named = lines.where(F.contains(F.replace("line", F.lit(" "), F.lit("")), F.lit(title))).select("path", "page").distinct()
    found = lines.join(named, ["path", "page"], "left_semi").where(F.col("line").rlike(ALLOCATION))
    part = lambda k: F.regexp_extract("line", ALLOCATION, k)
    rows = found.select("path", "page", part(1).alias("code"), part(2).alias("name"), _number(part(3)).alias("amount"))
    one = rows.groupBy("path", "code").agg(F.count("*").alias("n"), F.min(F.struct("page", "name", "amount")).alias("r"))
    checked = one.withColumn("_ok", F.assert_true(F.col("n") == 1, F.concat(F.lit("an allocation comes twice: "), "code")))
    return checked.where("_ok IS NULL").select("path", "r.page", "code", "r.name", "r.amount")


def settlements(pages: DataFrame) -> DataFrame:
    """(path, page, place, plan, original, adjustment, budget, realized, payable, reserved, settlement, difference, ratio): plans of a page with their results on the next, by place.

    Pages of unlike length fail the job; the first row of a plan in a file counts.
    """
    lines = _lines(pages)
    heads = lines.groupBy("path", "page").agg(F.replace(F.array_join(F.collect_list("line"), ""), F.lit(" "), F.lit("")).alias("t"))
    for mark in SETTLED:
        heads = heads.where(F.contains("t", F.lit(mark)))
    group = lambda rx, k: F.regexp_extract("line", rx, k)
    order = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("path", "page").orderBy("place")))
    first = order(lines.join(heads.select("path", "page"), ["path", "page"], "left_semi").where(F.col("line").rlike(SOURCE)))
    first = first.select("path", "page", "place", group(SOURCE, 1).alias("plan"), *(_number(group(SOURCE, k)).alias(n) for k, n in enumerate(("original", "adjustment", "budget"), 2)))
    after = lines.join(heads.select("path", (F.col("page") + 1).alias("page")), ["path", "page"], "left_semi").where(F.col("line").rlike(RESULT))
    after = order(after).select("path", (F.col("page") - 1).alias("page"), "place", *(_number(group(RESULT, k)).alias(n) for k, n in enumerate(("realized", "payable", "reserved", "settlement", "difference"), 1)), group(RESULT, 6).try_cast("double").alias("ratio"))
    both = first.join(after, ["path", "page", "place"], "full")
    both = both.withColumn("_ok", F.assert_true(F.col("plan").isNotNull() & F.col("realized").isNotNull(), F.concat(F.lit("unlike pages of a settlement: page "), F.col("page").cast("string")))).where("_ok IS NULL").drop("_ok")
    one = both.groupBy("path", "plan").agg(F.min_by(F.struct(*(c for c in both.columns if c not in ("path", "plan"))), F.struct("page", "place")).alias("r"))
    return one.select("path", "plan", "r.*")


def _rings(record: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon record: bounds, counts, where each ring starts, points; no ring for another kind."""
    if struct.unpack_from("<i", record)[0] not in (5, 15, 25):
        return []
    parts, points = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
    return [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]


def read_shapes(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """(path, place, properties, rings) of each polygon of zipped shapefiles; a member that leaves the archive is an error."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if any(n.startswith("/") or ".." in n.split("/") for n in z.namelist()):
                        raise ValueError(f"{p}: a member leaves the archive")
                    shp, dbf = (z.read(next(n for n in z.namelist() if n.lower().endswith(e))) for e in (".shp", ".dbf"))
                rings, at = [], 100
                while at < len(shp):
                    size = 2 * struct.unpack_from(">i", shp, at + 4)[0]
                    rings.append(_rings(shp[at + 8 : at + 8 + size]))
                    at += 8 + size
                n, head, wide = struct.unpack_from("<IHH", dbf, 4)
                fields = [(dbf[k : k + 11].split(b"\0")[0].decode(charset), dbf[k + 16]) for k in range(32, head - 1, 32)]
                rows = []
                for i in range(n):
                    record, values, a = dbf[head + i * wide : head + (i + 1) * wide], {}, 1
                    for name, size in fields:
                        values[name] = record[a : a + size].decode(charset).strip()
                        a += size
                    rows.append((p, i, values, [[{"x": x, "y": y} for x, y in r] for r in rings[i]]))
                yield pd.DataFrame(rows, columns=["path", "place", "properties", "rings"])

    kind = "path string, place int, properties map<string,string>, rings array<array<struct<x:double,y:double>>>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(shapes, kind)


def topology(text: Column, layer: str) -> Column:
    """Geometries of a layer of a TopoJSON text: array of (properties, rings), by higher-order functions alone.

    Arcs are running sums of their deltas, scaled and moved; a negative index is
    an arc backwards; arcs of a ring lose the point that they share with the one
    before.
    """
    shape = f"struct<transform:struct<scale:array<double>,translate:array<double>>,arcs:array<array<array<double>>>,objects:struct<`{layer}`:struct<geometries:array<struct<type:string,properties:map<string,string>,arcs:string>>>>>"
    t = F.from_json(text, shape)
    scale, move = t["transform"]["scale"], t["transform"]["translate"]
    point = "struct<x:double,y:double>"

    def decoded(arc: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast(f"array<{point}>").alias("out"))

        def step(acc: Column, d: Column) -> Column:
            x, y = acc["x"] + d[0], acc["y"] + d[1]
            place = F.struct((x * F.coalesce(scale[0], F.lit(1.0)) + F.coalesce(move[0], F.lit(0.0))).alias("x"), (y * F.coalesce(scale[1], F.lit(1.0)) + F.coalesce(move[1], F.lit(0.0))).alias("y"))
            return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(place)).alias("out"))

        return F.aggregate(arc, start, step, lambda acc: acc["out"])

    arcs = F.transform(t["arcs"], decoded)

    def stitched(indexes: Column) -> Column:
        def add(ring: Column, i: Column) -> Column:
            arc = F.when(i >= 0, F.element_at(arcs, i + 1)).otherwise(F.reverse(F.element_at(arcs, -i)))
            return F.concat(ring, F.when(F.size(ring) == 0, arc).otherwise(F.slice(arc, 2, F.greatest(F.size(arc) - 1, F.lit(0)))))

        return F.aggregate(indexes, F.array().cast(f"array<{point}>"), add)

    def geometry(g: Column) -> Column:
        single = F.from_json(g["arcs"], "array<array<int>>")
        many = F.flatten(F.from_json(g["arcs"], "array<array<array<int>>>"))
        indexes = F.when(g["type"] == "MultiPolygon", many).otherwise(single)
        return F.struct(g["properties"].alias("properties"), F.transform(indexes, stitched).alias("rings"))

    return F.transform(t["objects"][layer]["geometries"], geometry)


def cached(spark: SparkSession, root: str, content: DataFrame, key: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made(content)``, kept under ``root`` by the hash of all contents and a key: the same files are parsed once.

    ``content``: one binary column, content, a row a file.
    """
    digest = content.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.sha2("content", 256)))), 256).alias("h")).first().h
    path = f"{root}/{key}-{digest[:32]}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        made(content).write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def cascade(sources: list[Callable[[], DataFrame]], key: str) -> DataFrame:
    """Rows of all sources that can be opened, those of an earlier one first: one row a key. None at all is an error."""
    from talweg.operators.sets import first_wins, union_all

    ranked = [lambda s=s, k=k: s().withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)]
    return first_wins(union_all(ranked), [key], "source_rank")
