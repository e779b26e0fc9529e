"""Files without a reader of Spark's, runs with state, SQL functions, deep payloads and repositories."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from talweg.functions import sql
from talweg.functions import text as T
from talweg.operators import evidence, runs, stats
from talweg.operators.quality import split
from talweg.sources import files, tables


def archive(path, **members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    path.write_bytes(buffer.getvalue())
    return str(path)


def test_spreadsheets_of_both_formats(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda cells: f"<worksheet {ns}><sheetData><row>{cells}</row></sheetData></worksheet>"
    x = archive(tmp_path / "a.xlsx", **{
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="112年" sheetId="1" r:id="r1"/><sheet name="113年" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>mean</t></si><si><r><t>25-</t></r><r><t>29</t></r></si></sst>",
        "xl/worksheets/s1.xml": sheet('<c r="A1"><v>9</v></c>'),
        "xl/worksheets/s2.xml": sheet('<c r="B1" t="s"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>30-34</t></is></c><c r="A2" t="s"><v>0</v></c><c r="B2"><v>41.5</v></c><c r="AA2"><v>50</v></c><c r="C2"/>'),
    })
    got = files.measures_by_group(files.sheet_of_year(files.read_sheets(spark, x)), 0)
    assert sorted((r.sheet, r.measure, r.group, r.value) for r in got.collect()) == [("113年", "mean", "25-29", "41.5"), ("113年", "mean", "30-34", "50")]
    assert files.sheet_of_year(files.read_sheets(spark, x), 112).count() == 1
    t, p = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"', 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda v, n=1: f'<table:table-cell table:number-columns-repeated="{n}">' + (f"<text:p>{v}</text:p>" if v else "") + "</table:table-cell>"
    o = archive(tmp_path / "b.ods", **{"content.xml": f'<doc {t} {p}><table:table table:name="S"><table:table-row table:number-rows-repeated="2">{cell("", 2)}{cell("v", 2)}</table:table-row></table:table></doc>'})
    assert sorted((r.row, r.col, r.value) for r in files.read_sheets(spark, o).collect()) == [(0, 2, "v"), (0, 3, "v"), (1, 2, "v"), (1, 3, "v")]


def test_page_rows(spark):
    pages = spark.createDataFrame([("d", ["head\n01  staff   1,200\n", "02 goods 30\nnothing"])], "doc string, texts array<string>")
    got = files.page_rows(pages, "doc", "texts", r"^([0-9]{2}) (\S+) ([0-9,]+)$", ["code", "name", "amount"]).orderBy("code").collect()
    assert [(r.page, r.place, r.code, r.name if False else r["name"], r.amount) for r in got] == [(0, 1, "01", "staff", "1,200"), (1, 0, "02", "goods", "30")]


def test_shapes(spark, tmp_path):
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
    flat = [c for r in rings for p in r for c in p]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 8, 0, 4) + struct.pack(f"<{len(flat)}d", *flat)
    empty = struct.pack("<i", 0)
    shp = b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, len(empty) // 2) + empty
    fields = b"".join(struct.pack("<11sc4sBB14s", n, b"C", b"", w, 0, b"") for n, w in ((b"CODE", 4), (b"NAME", 6)))
    dbf = struct.pack("<B3sIHH20s", 3, b"", 2, 32 + len(fields) + 1, 11, b"") + fields + b"\r" + b" 65  North " + b" 66  South "
    got = files.read_shapes(spark, archive(tmp_path / "s.zip", **{"v.shp": shp, "v.dbf": dbf})).orderBy("place").collect()
    assert got[0].properties == {"CODE": "65", "NAME": "North"} and [[(p.x, p.y) for p in r] for r in got[0].rings] == rings and got[1].rings == []
    with pytest.raises(Exception, match="leaves the archive"):
        files.read_shapes(spark, archive(tmp_path / "t.zip", **{"../v.shp": shp})).collect()


def test_topology(spark):
    text = '{"type":"Topology","transform":{"scale":[2,1],"translate":[10,0]},"arcs":[[[0,0],[1,0],[0,1]],[[1,1],[-1,0],[0,-1]]],"objects":{"town":{"geometries":[{"type":"Polygon","properties":{"n":"A"},"arcs":[[0,1]]},{"type":"MultiPolygon","properties":{"n":"B"},"arcs":[[[-2,-1]]]}]}}}'
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(files.topology(F.col("t"), "town")).alias("g")).select("g.*").collect()
    ring = lambda r: [(p.x, p.y) for p in r.rings[0]]
    assert got[0].properties["n"] == "A" and ring(got[0]) == [(10, 0), (12, 0), (12, 1), (10, 1), (10, 0)]
    assert ring(got[1]) == [(10, 0), (10, 1), (12, 1), (12, 0), (10, 0)]


def test_cache_and_cascade(spark, tmp_path):
    content = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    made = []

    def parse(df):
        made.append(1)
        return df.select(F.length("content").alias("n"))

    for _ in range(2):
        assert files.cached(spark, str(tmp_path), content, "wage-113", parse).first().n == 1
    assert made == [1]
    missing = lambda: spark.read.parquet(str(tmp_path / "nowhere"))
    first, second = (spark.createDataFrame(rows, "id int, v string") for rows in ([(1, "a")], [(1, "b"), (2, "c")]))
    assert sorted((r.id, r.v) for r in files.cascade([missing, lambda: first, lambda: second], "id").collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        files.cascade([missing], "id")


def test_runs_resume_fail_and_replay(spark, tmp_path):
    opened = []

    def landed(spark, key):
        opened.append(key)
        if key == "11303" and opened.count(key) == 1:
            raise OSError("not yet")
        return spark.createDataFrame([(0, "5"), (1, "x")], "_ord int, v string")

    transform = lambda df: split(df, {"bad": F.col("v") == "x"}, "_ord")
    source = [runs.Source("d", "MONTHLY", landed, transform)]
    root = str(tmp_path / "root")
    first = runs.run(spark, root, source, "2024-02-01", "2024-03-01")
    assert first.done == [("d", "11302")] and [x[:2] for x in first.failed] == [("d", "11303")]
    again = runs.run(spark, root, source, "2024-02-01", "2024-03-01", failed_only=True)
    assert again.done == [("d", "11303")] and opened == ["11302", "11303", "11303"]
    last = runs.run(spark, root, source, "2024-02-01", "2024-03-01")
    assert not last.done and last.kept == [("d", "11302"), ("d", "11303")]
    assert {r.status for r in runs.State(spark, root).current().collect()} == {"ok"}
    assert tables.Curated(spark, f"{root}/curated").period("d", "11302").count() == 1
    assert spark.read.parquet(f"{root}/reports/collection").count() == 6
    with pytest.raises(ValueError):
        tables.Curated(spark, f"{root}/curated")._where("d", ["../x"])
    listing = spark.createDataFrame([("d", "11302", "a-20240101T000000Z", "2024-01-01"), ("d", "11302", "b-20240201T000000Z", "2024-01-01")], "dataset string, output_key string, path string, modified string")
    got = runs.replay(spark, listing, source, lambda s, p: s.createDataFrame([(0, p)], "_ord int, v string"), str(tmp_path / "sandbox"))
    assert [tuple(r) for r in got.collect()] == [("d", "11302", 1)]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT clean_text(' n/a ') a, parse_count('+1,200') b, roc_year('113') c, finite(double('nan')) d, safe_ratio(1, 0) e, yoy(3, 2) f, salary_middle(NULL, 4) g").first()
    assert tuple(row) == (None, 1200, 2024, None, None, 50.0, 4.0)
    got = spark.sql("""SELECT path, value FROM json_leaves('{"a": {"b": [1, true, null, "x"]}}')""").collect()
    assert [tuple(r) for r in got] == [("a.b.0", "1"), ("a.b.1", "true"), ("a.b.3", "x")]
    assert spark.sql("SELECT * FROM json_leaves('not json')").count() == 0


def test_payloads_deeper_than_the_levels(spark):
    deep = "1"
    for k in range(14):
        deep = f'{{"k{k}": {deep}, "note": 5}}' if k % 2 else f"[{deep}, 7]"
    got = {r.path: r.value for r in evidence.flatten(spark.createDataFrame([(1, deep)], "id int, body string"), "body", "id").collect()}

    def plain(x, path=()):
        if isinstance(x, dict):
            return {p: v for k, y in x.items() if k != "note" for p, v in plain(y, (*path, k)).items()}
        if isinstance(x, list):
            return {p: v for k, y in enumerate(x) for p, v in plain(y, (*path, str(k))).items()}
        return {".".join(path): str(x)}

    import json

    assert got == plain(json.loads(deep))


def test_repositories(spark):
    rows = [(f"e{k}", "d", "city", None, None, "snapshot", "latest", "m", 1.0, "eligible") for k in range(5)]
    facts = spark.createDataFrame(rows, "evidence_id string, dataset string, geo_level string, district_id int, district_name string, period_type string, period string, metric_id string, value double, youth_eligibility string")

    class Broken:
        def facts(self, *a):
            raise OSError("away")

    both = evidence.CompositeRepository([Broken(), evidence.TableRepository(facts, 3)])
    assert [r.evidence_id for r in both.facts(metrics=["m"]).orderBy("evidence_id").collect()] == ["e0", "e1", "e2"]
    assert both.facts(metrics=["other"]).count() == 0
    with pytest.raises(ValueError):
        evidence.CompositeRepository([Broken()]).facts()


def test_percentiles_narrowed_by_a_sketch(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(stats, "FEW", 50)
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=30_000), 1: rng.integers(0, 5, 20_000).astype(float), 2: np.r_[np.zeros(15_000), rng.random(10) * 1e9], 3: np.array([4.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [(4, None), (None, 2.0), (None, 4.0)], "g int, v double")
    at = {"low": 0.0, "a": 0.05, "m": 0.5, "q": 0.75, "p": 0.999, "top": 1.0}
    got = {r.g: r for r in stats.percentiles(df, ["g"], F.col("v"), at, "n").collect()}
    assert set(got) == {0, 1, 2, 3, None} and got[None].m == 3.0 and got[0].n == 30_000
    for g, v in groups.items():
        for name, q in at.items():
            assert got[g][name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (g, name)


def test_scrub_with_roles(spark):
    clean, n = T.scrub(F.col("t"), T.ROLES)
    r = spark.createDataFrame([("第 12 頁 王小明委員 113年5月2日 AB-12345 page 3 好",)], "t string").select(clean.alias("c"), *(v.alias(k) for k, v in n.items())).first()
    assert (r.page, r.date, r.identifier, r.role) == (2, 1, 1, 1) and "好" in r.c and "王小明" not in r.c and not any(c.isdigit() for c in r.c)
