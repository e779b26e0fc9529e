"""Landed files as a data source, and budget documents from PDF pages to rows."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from talweg.sources import files, pdf, readers

TITLE = "預算分配表"


def document(pages, packed=True):
    """A PDF with these pages of (x, y, text); fonts code characters by number, as office programs do."""
    chars = sorted({c for page in pages for _, _, t in page for c in t})
    code = {c: i + 1 for i, c in enumerate(chars)}
    cmap = "\n".join(["beginbfchar"] + [f"<{code[c]:04X}> <{c.encode('utf-16-be').hex()}>" for c in chars] + ["endbfchar"]).encode()
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 5: b"<< /Font << /F1 3 0 R >> >>"}

    def stream(data):
        body = zlib.compress(data) if packed else data
        return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", body)

    objects[4] = stream(cmap)
    kids = []
    for k, page in enumerate(pages):
        text = b"BT /F1 10 Tf\n" + b"".join(b"1 0 0 1 %d %d Tm <%s> Tj\n" % (x, y, "".join(f"{code[c]:04X}" for c in t).encode()) for x, y, t in page) + b"ET"
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Resources 5 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = stream(text)
        kids.append(b"%d 0 R" % (10 + 2 * k))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


def table(rows, top=700):
    """Cells side by side, 120 points apart, rows 20 points below each other."""
    return [(50 + 120 * j, top - 20 * i, cell) for i, row in enumerate(rows) for j, cell in enumerate(row)]


BUDGET = [
    table([["市政府 預算分配表"], ["01", "一般行政", "1,200"], ["02", "青年發展", "3,400"], ["合計", "4,600"]]),
    table([["無關"], ["03", "不算", "9"]]),
    table([["預算", "分配表"], ["03", "職涯", "50"], ["04", "公共參與", "60"]]),
    table([["歲出機關", "原預算數"], ["合計", "100", "-10", "90"], ["青年發展", "60", "0", "60"]]),
    table([["實現數"], ["80", "1", "2", "83", "-7", "92.2"], ["55", "0", "0", "55", "-5", "91.7"]]),
]


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "budget.pdf").write_bytes(document(BUDGET))
    (tmp_path / "plain.pdf").write_bytes(document([[(50, 700, "b"), (10, 700.9, "a"), (10, 600, "(c)")]], packed=False))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/a.csv", "1")
        z.writestr("x/b.csv", "2")
        z.writestr("c.txt", "3")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("content.xml", '<o xmlns:t="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:x="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><t:table t:name="s"><t:table-row><t:table-cell><x:p>v</x:p></t:table-cell></t:table-row></t:table></o>')
    (tmp_path / "s.ods").write_bytes(sheet.getvalue())
    return f"file://{tmp_path}"


def test_lines_of_pages():
    lines = pdf.page_lines(document(BUDGET))
    assert lines[0] == ["市政府 預算分配表", "01 一般行政 1,200", "02 青年發展 3,400", "合計 4,600"] and len(lines) == 5
    literal = b"1 0 obj<< /Type /Catalog /Pages 2 0 R >>endobj 2 0 obj<< /Type /Pages /Kids [3 0 R] >>endobj 3 0 obj<< /Type /Page /Contents 4 0 R >>endobj 4 0 obj<< >>stream\nBT /F 12 Tf 14 TL 10 500 Td (One \\(1\\)) Tj T* [(Tw) -20 (o)] TJ 0 -30 Td (\\101bc) Tj ET\nendstream endobj"
    assert pdf.page_lines(literal) == [["One (1)", "Two", "Abc"]]
    assert pdf.page_lines(b"not a document") == []


def test_the_data_source_has_a_partition_for_each_file_or_member(spark, landed):
    readers.register(spark)
    read = lambda kind, **o: spark.read.format("landed").options(kind=kind, **o).load(landed)
    members = read("zip", member=r"\.csv$")
    assert members.rdd.getNumPartitions() == 2 and sorted((r.member, bytes(r.content)) for r in members.collect()) == [("x/a.csv", b"1"), ("x/b.csv", b"2")]
    assert [(r.sheet, r.row, r.col, r.value) for r in read("sheets").collect()] == [("s", 0, 0, "v")]
    pages = read("pdf")
    assert pages.rdd.getNumPartitions() == 2 and pages.count() == 6
    name = F.regexp_extract("path", "([^/]+)$", 1)
    same = lambda df: sorted(map(tuple, df.select(name, "page", F.array_join("lines", "|")).collect()))
    assert same(pages) == same(files.read_pdf(spark, f"{landed}/*.pdf"))
    assert ("plain.pdf", 0, "a b|(c)") in same(pages)
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("landed").load(landed).count()


def test_budget_documents_to_rows(spark, landed):
    pages = files.read_pdf(spark, f"{landed}/budget.pdf")
    got = files.budget_allocations(pages, TITLE).orderBy("code").collect()
    assert [(r.page, r.code, r.name, r.amount) for r in got] == [(0, "01", "一般行政", 1200), (0, "02", "青年發展", 3400), (2, "03", "職涯", 50), (2, "04", "公共參與", 60)]
    rows = files.settlements(pages).orderBy("place").collect()
    assert [(r.page, r.plan, r.original, r.adjustment, r.budget, r.realized, r.difference, r.ratio) for r in rows] == [(3, "合計", 100, -10, 90, 80, -7, 92.2), (3, "青年發展", 60, 0, 60, 55, -5, 91.7)]
    twice = pages.unionByName(pages.where("page = 0").withColumn("page", F.lit(9)))
    with pytest.raises(Exception, match="comes twice"):
        files.budget_allocations(twice, TITLE).collect()
    short = pages.withColumn("lines", F.when(F.col("page") == 4, F.slice("lines", 1, 2)).otherwise(F.col("lines")))
    with pytest.raises(Exception, match="unlike pages"):
        files.settlements(short).collect()
