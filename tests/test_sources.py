"""Listings by page, workbooks, JSON replies."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import replies
from gridsmith.sources import listing, sheets


def put(path, start, records, total, result="OK"):
    (path / f"start={start}").write_text(json.dumps({"Result": result, "Records": records, "TotalRecordCount": total}))


def record(i):
    return {"Id": i, "CompanyUId": 1000 + i, "Company": f"\t Company {i} "}


@pytest.fixture
def pages(tmp_path):
    for s in range(0, 25, 10):
        put(tmp_path, s, [record(i) for i in range(s, min(25, s + 10))], 25)
    return tmp_path


def test_listing(spark, pages, tmp_path_factory):
    to = lambda: str(tmp_path_factory.mktemp("kept") / "t")
    df = listing.pages(spark, str(pages), 10)
    assert df.rdd.getNumPartitions() == 3, "a partition for each page"
    got = listing.companies(spark, str(pages), to(), 10).collect()
    assert sorted((r.page, r.id, r.company_uid, r.name) for r in got) == [(i // 10, i, 1000 + i, f"Company {i}") for i in range(25)]
    assert {r.id for r in listing.companies(spark, str(pages), to(), 10, start=10).collect()} == set(range(10, 25))
    # pages beyond the total aren't asked for, and the listing ends at the first bad page
    put(pages, 30, [record(99)], 25)
    assert listing.companies(spark, str(pages), to(), 10).count() == 25
    put(pages, 10, [], 25, "ERROR")
    assert {r.id for r in listing.companies(spark, str(pages), to(), 10).collect()} == set(range(10))
    (pages / "start=10").unlink()
    assert {r.id for r in listing.companies(spark, str(pages), to(), 10).collect()} == set(range(10))
    (pages / "start=0").write_text("not JSON")
    assert listing.companies(spark, str(pages), to(), 10).count() == 0
    assert listing.companies(spark, str(pages / "nowhere"), to(), 10).count() == 0


def test_listing_goes_on_where_it_stopped(spark, pages, tmp_path_factory):
    out, marks = (str(tmp_path_factory.mktemp(n)) for n in ("out", "marks"))

    def run():
        q = listing.stream(spark, str(pages), 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run() == list(range(25))
    for s in range(0, 31, 10):  # the last page has grown, and another follows; those before hold other records now
        put(pages, s, [record(i if s >= 20 else -1) for i in range(s, min(32, s + 10))], 32)
    assert run() == list(range(32))
    assert run() == list(range(32))


# ------------------------------------------------------------------ workbooks

SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def rich(sheet, extra=""):
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return book(
        {
            "xl/workbook.xml": f'<workbook {SHEET} xmlns:r="{links}">{extra}<sheets><sheet name="b" r:id="x2"/><sheet name="c" r:id="x3"/><sheet name="a" r:id="x1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/one.xml"/><Relationship Id="x2" Target="/xl/worksheets/two.xml"/><Relationship Id="x3" Target="charts/c.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {SHEET}><numFmts><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
            "xl/sharedStrings.xml": f"<sst {SHEET}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
            "xl/worksheets/one.xml": f'<worksheet {SHEET}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
            "xl/worksheets/two.xml": f'<worksheet {SHEET}><dimension ref="A1:D9"/><sheetData>{sheet}</sheetData></worksheet>',
        }
    )


def test_kinds_of_cells():
    got = sheets.workbook_rows(
        rich(
            '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
            '<row r="4"><c r="A4"><v>0</v></c><c r="B4"><v>1.50</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="b"><v>0</v></c></row>'
            '<row><c t="inlineStr"><is><t>in</t></is></c><c t="str"><f>A1</f><v>formula</v></c><c t="e"><v>#N/A</v></c><c><f>A1</f></c></row>'
            '<row r="6"><c r="A6" s="1"><v>45658</v></c><c r="B6" s="2"><v>45658.5</v></c><c r="C6" s="1"><v>0.25</v></c><c r="D6" s="3"><v>3</v></c></row>'
            '<row r="50"><c r="AB50"><v>1E3</v></c></row><row r="51"><c r="A51"><v>5</v></c></row>'
        )
    )
    assert [(s, r) for s, r, _ in got] == [(0, 1), (0, 3), (0, 4), (0, 5), (0, 49), (1, 0)]
    rows = [c for _, _, c in got]
    assert rows[0] == ["plain", "", "rich", ""] and rows[1] == ["", "1.5", "True", ""] and rows[2] == ["in", "formula", "#N/A", ""]
    assert rows[3] == ["2025-01-01 00:00:00", "2025-01-01 12:00:00", "06:00:00", "3"]
    assert rows[4] == [""] * 27 + ["1000.0"] and rows[5] == ["7"]
    early = sheets.workbook_rows(rich('<row r="1"><c r="A1" s="1"><v>1</v></c></row>', '<workbookPr date1904="1"/>'))
    assert early[0][2][0] == "1904-01-02 00:00:00"


def test_workbooks_that_cannot_be_read():
    good = rich('<row r="1"><c r="A1"><v>1</v></c></row>')
    for bad in (None, b"", b"PK\x03\x04", good[:200], b"\xd0\xcf\x11\xe0" + b"x" * 100, book({"a.txt": "x"}), rich("<row>"), rich('<row r="1"><c r="A1" t="s"><v>9</v></c></row>'), rich('<row r="1"><c r="A1"><v>x</v></c></row>')):
        assert sheets.workbook_rows(bad) == []


def test_sheet_text(spark):
    rows = [[f"r{i}", i, None, "ü<&>"] for i in range(60)]
    books = [("a", sheets.packed([rows, [[None], ["", 0]], [["third"]]])), ("b", b"no workbook"), ("c", None), (None, sheets.packed([[["x"]]])), ("d", sheets.packed([[[""]]]))]
    got = {r.path: r.text for r in sheets.text(spark.createDataFrame(books, "path string, content binary")).collect()}
    assert set(got) == {"a", None} and got[None] == "x"
    assert got["a"].split("\n") == [f"r{i} {i or ''}  ü<&>" for i in range(50)]


# ------------------------------------------------------------------ replies


def python_texts(json_text):
    out = []

    def walk(v):
        if isinstance(v, str):
            if v.strip():
                out.append(v.strip())
        elif isinstance(v, dict):
            for k, x in v.items():
                if k != "_extraction_meta":
                    walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(json.loads(json_text))
    return out


BODIES = [
    '{"data":[{"a":"x \\"q\\" \\u00e9 \\\\"},{"b":[1,"y",{"c":" z "}]}],"_extraction_meta":{"m":"no","k":["no",{"_extraction_meta":"no"}]},"t":"w"}',
    '{"_extraction_meta" : "a","b":"c"}', '{"_extraction_meta":["a"],"b":["c",{"_extraction_meta":1,"d":"e"}]}', '{"a":{"_extraction_meta":[["no"],"no"],"k":"yes"},"e":""}',
    '{"a":"b:c, d]","_extraction_meta":null,"f":"{g}"}', "[]", "{}", "[[[\"deep\"]]]", '{"z":"1","a":"2"}', '"text"', "12", "null", '{"a":"\\n \\t"}', '{"k:":"v"}', '{"x":-1.5e3,"y":true,"z":[false,"t"]}', json.dumps({"a": "\\" * 99 + '"' * 99, "b": "ü😀"}),
]


def test_texts_of_replies(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)], "i int, b string")
    got = {r.i: r.t for r in df.select("i", replies.texts(F.col("b")).alias("t")).collect()}
    assert got == {i: python_texts(b) for i, b in enumerate(BODIES)}


@pytest.mark.parametrize(
    "reply,body,wrong,plain",
    [
        ('{"data":[{"a":"x"}]}', '{"data":[{"a":"x"}]}', None, "x"),
        ('Sure!\n```json\n{"data":[]}\n```\n```json\n{"data":1}\n```', '{"data":[]}', None, ""),
        ('```json\n{"text":" ","ocr":" said ","z":"q"}```', '{"text":" ","ocr":" said ","z":"q"}', None, "said"),
        ('{"text":["a"],"content":5,"b":"c"}', '{"text":["a"],"content":5,"b":"c"}', None, "a\nc"),
        ("```json\n{oops}\n```", None, "not JSON", None),
        ("```json", None, "not JSON", None),
        ("nothing", None, "not JSON", None),
        ("", None, "not JSON", None),
        (None, None, "not JSON", None),
        ('["a"]', '["a"]', "not an object: array", "a"),
        ('"a b"', '"a b"', "not an object: string", "a b"),
        ('{"data":null}', '{"data":null}', "data is no list: void", ""),
        ('{"data":{"a":1}}', '{"data":{"a":1}}', "data is no list: object", ""),
        ('{"data":[{}, [], {}]}', '{"data":[{}, [], {}]}', "no object: record 1", ""),
    ],
)
def test_replies(spark, reply, body, wrong, plain):
    df = spark.createDataFrame([(reply,)], "r string").withColumn("b", replies.body(F.col("r")))
    r = df.select("b", replies.verdict(F.col("b")).alias("v"), replies.plain_text(F.col("b")).alias("p"), F.size(replies.records(F.col("b"))).alias("n")).first()
    assert (r.b, r.v, r.p) == (body, wrong, plain) and (r.n is None or wrong is None)
