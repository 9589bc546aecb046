import io
import json
import zipfile

import pytest

from tesserae.sources import archives


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return out.getvalue()


def core(lon, lat, tables, **files):
    data = {"dataSetName": "s", "geo": {"geometry": {"coordinates": [lon, lat]}}, "paleoData": [{"measurementTable": t} for t in tables]}
    return packed(bag__data__metadata_DOT_jsonld=json.dumps(data), **{f"bag__data__{k}_DOT_csv": v for k, v in files.items()})


def column(number, name, units="", doi=None):
    return {"number": number, "variableName": name, "units": units} | ({"calibration": {"calibrationDOI": doi}} if doi else {})


AGE, HEAT = column(2, "age", "yr ka"), column(3, "temperature", "degC", archives.MAGNESIUM_CALIBRATIONS[1])


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"a{i % 3}.zip", f"m/{i}.txt", f"text {i} é\n" * i) for i in range(20)] + [("a0.zip", "none.txt", None)]
    path = f"file://{tmp_path}/made"
    archives.write_archives(spark.createDataFrame(rows, archives.MEMBER).repartition(5), path)
    got = sorted((r.archive, r.member, r.content) for r in archives.members(spark, path).collect())
    assert got == sorted((a, m, c or "") for a, m, c in rows)
    assert [r.member for r in archives.members(spark, path, "a1.zip", "1[36]").collect()] == ["m/13.txt", "m/16.txt"]


def test_members_of_one_archive_in_two_tasks_are_refused(spark, tmp_path):
    spark.dataSource.register(archives.Archives)
    rows = spark.createDataFrame([("a", str(i), "x") for i in range(8)], archives.MEMBER).repartition(4, "member")
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("archives").mode("append").save(f"{tmp_path}/split")


def test_what_cannot_be_read_is_a_row_with_an_error(spark, tmp_path):
    good = packed(a_DOT_txt="hello " * 100, b_DOT_txt="x")
    at = good.index(b"hello") + 5
    (tmp_path / "bad.lpd").write_bytes(b"no archive")
    (tmp_path / "empty.lpd").write_bytes(b"")
    (tmp_path / "short.lpd").write_bytes(good[:50])
    (tmp_path / "damaged.lpd").write_bytes(good[:at] + b"#" + good[at + 1 :])
    got = {(r.archive, r.member): r for r in archives.members(spark, str(tmp_path)).collect()}
    assert got.keys() == {("bad.lpd", None), ("short.lpd", None), ("damaged.lpd", "a.txt"), ("damaged.lpd", "b.txt")}
    assert all((r.content is None) == (r.error is not None) for r in got.values()) and got["damaged.lpd", "b.txt"].content == "x"
    assert "CRC" in got["damaged.lpd", "a.txt"].error
    assert archives.cores(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        ([AGE, HEAT], ("mgca", archives.MAGNESIUM_CALIBRATIONS[1])),
        ([AGE, column(1, "uk_37"), column(4, "Mg/Ca"), HEAT], ("alkenone", archives.MAGNESIUM_CALIBRATIONS[1])),
        ([AGE, column(4, "mg_ca"), column(5, "Temperature", "degc"), HEAT], ("mgca", archives.MAGNESIUM_CALIBRATIONS[1])),
        ([AGE, column(4, "temperature", "degC", archives.ALKENONE_CALIBRATIONS[2]), HEAT], ("alkenone", archives.ALKENONE_CALIBRATIONS[2])),
        ([AGE, column(3, "temperature", "degC")], ("unknown", "unknown")),
        ([AGE, column(3, "temperature", "K")], None),
        ([column(2, "age", "yr"), HEAT], None),
        ([column(9, "age", "yr ka"), HEAT], None),
    ],
)
def test_proxy_and_calibration(spark, tmp_path, columns, want):
    (tmp_path / "x.lpd").write_bytes(core(-30, 55, [[{"filename": "t.csv", "columns": columns}]], t="0,1.5,20,30,40\n0,1,10,30,40\nx,NaN,1,1,1\n0,3,inf,2,2\n0,2, 15 ,3,3\r\n\n"))
    got = [(r.modality, r.calibration, r.age_ka) for r in archives.cores(spark, str(tmp_path)).collect()]
    assert sorted(got) == ([] if want is None else [(*want, a) for a in (1.0, 1.5, 2.0, *((3.0,) if want[1] == archives.ALKENONE_CALIBRATIONS[2] else ()))])


def test_first_usable_table_and_box(spark, tmp_path):
    table = lambda f, *c: {"filename": f, "columns": list(c)}
    tables = [[table("few.csv", AGE, HEAT), table("gone.csv", AGE, HEAT)], [table(None, AGE, HEAT), table("good.csv", AGE, HEAT), table("later.csv", AGE, HEAT)]]
    files = {"few": "0,1,1\n0,2,2\n", "good": "0,3,1\n0,1,7\n0,2,2", "later": "0,1,1\n" * 9}
    (tmp_path / "in.lpd").write_bytes(core(-30, 55, tables, **files))
    (tmp_path / "out.lpd").write_bytes(core(10, 55, tables, **files))
    (tmp_path / "nowhere.lpd").write_bytes(packed(bag__data__metadata_DOT_jsonld='{"dataSetName": "s"}'))
    (tmp_path / "broken.lpd").write_bytes(packed(bag__data__metadata_DOT_jsonld="{"))
    got = archives.cores(spark, str(tmp_path), (50, 65, -50, -10)).collect()
    assert sorted((r.lon, r.lat, r.age_ka, r.v) for r in got) == [(-30.0, 55.0, 1.0, 7.0), (-30.0, 55.0, 2.0, 2.0), (-30.0, 55.0, 3.0, 1.0)]


def test_sheets(spark, tmp_path):
    head, ns = '<?xml version="1.0"?>', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = packed(
        xl__workbook_DOT_xml=f'{head}<workbook {ns} xmlns:r="{relation}"><sheets><sheet name="One" sheetId="1" r:id="rId7"/><sheet name="B &amp; C" sheetId="2" r:id="rId2"/></sheets></workbook>',
        xl___rels__workbook_DOT_xml_DOT_rels=f'{head}<Relationships xmlns="x"><Relationship Id="rId2" Type="w" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="rId7" Type="w" Target="worksheets/sheet1.xml"/></Relationships>',
        xl__sharedStrings_DOT_xml=f'{head}<sst {ns}><si><t>year</t></si><si><t xml:space="preserve"> v </t></si><si><r><t>1</t></r><r><t>999</t></r></si></sst>',
        xl__worksheets__sheet1_DOT_xml=f'{head}<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>2000.5</v></c><c r="B3"><v>-1e-2</v></c><c r="AB3"><v>7</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4" t="inlineStr"><is><t>3.5</t></is></c></row><row r="5"><c r="A5"><v>-4</v></c><c r="B5"><v>1</v></c></row><row r="6"><c r="A6"><v>2001</v></c><c r="B6" t="e"><v>#N/A</v></c></row><row r="7"/></sheetData></worksheet>',
        xl__worksheets__sheet2_DOT_xml=f"{head}<worksheet {ns}><sheetData><row><c><v>1</v></c></row><row><c><v>5</v></c><c><v>6</v></c></row></sheetData></worksheet>",
    )
    (tmp_path / "b.xlsx").write_bytes(book)
    (tmp_path / "other.xlsx").write_bytes(b"PK")
    values = archives.cells(spark, str(tmp_path))
    assert sorted((r.row, r.col, r.text) for r in values.where("sheet = 'One'").collect())[:5] == [(1, 0, "year"), (1, 1, " v "), (3, 0, "2000.5"), (3, 1, "-1e-2"), (3, 27, "7")]
    got = sorted((r.sheet, r.row, r.year, r.v) for r in archives.sheet_series(values).collect())
    assert got == [("B & C", 2, 5.0, 6.0), ("One", 3, 2000.5, -0.01), ("One", 4, 1999.0, 3.5)]
    assert archives.sheet_series(values, 0, 27).count() == 1
