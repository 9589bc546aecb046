"""Zip archives as a sink and as a source, and what comes in them: sediment cores and spreadsheets.

Archives are read by Spark's binary file reader, so from every store that Spark reads, and unpacked in tasks to one row a member; from there on
everything is relational: metadata and sheets are parsed by Spark's JSON and XML functions, tables and strings meet by joins. An archive or a member that
can't be read becomes a row with an error instead of content.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MEMBER = "archive string, member string, content string"


def _at(uri: str):
    """The file system of a folder's address, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """Each task packs its archives under names of its own; the driver's commit gives them theirs."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        store, folder = _at(self.path)
        store.create_dir(f"{folder}/_part", recursive=True)
        files = []
        for archive, members in groupby(rows, key=lambda r: r[0]):
            part = f"{folder}/_part/{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, member, content in members:
                    z.writestr(zipfile.ZipInfo(member), content or "", zipfile.ZIP_DEFLATED)
            files.append((part, f"{folder}/{archive}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _at(self.path)
        named = [f for m in messages if m for f in m.files]
        if len({name for _, name in named}) < len(named):
            raise ValueError("members of one archive are in several tasks: repartition by archive and sort within partitions before writing")
        for part, name in named:
            store.move(part, name)
        if named:
            store.delete_dir(f"{folder}/_part")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _at(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                store.delete_file(part)


class Archives(DataSource):
    """The format `archives`: rows (archive, member, content) are written to a zip file for each archive, in the folder of the option path."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBER

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(rows: DataFrame, path: str) -> None:
    """Rows (archive, member, content) as zip files in a folder; an archive's members, in order of name, are packed by one task."""
    rows.sparkSession.dataSource.register(Archives)
    whole = rows.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member")
    whole.write.format("archives").mode("append").save(path)


def members(spark: SparkSession, path: str, pattern: str = "*", wanted: str = ".") -> DataFrame:
    """archive (file name), path, member, content, error of each member whose name matches the regular expression `wanted`, and a row for each archive that can't be opened.

    Content is text, bytes that aren't UTF-8 replaced. Files without a byte are not listed: Spark's file readers pass over them.
    """
    import re

    find = re.compile(wanted)
    names = ["archive", "path", "member", "content", "error"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content"), strict=True):
                path, rows = path.as_py(), []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                        for name in filter(find.search, z.namelist()):
                            try:
                                rows.append((name, z.read(name).decode("utf-8", "replace"), None))
                            except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
                                rows.append((name, None, f"{type(e).__name__}: {e}"))
                            except Exception as e:  # zlib.error of damaged data
                                if type(e).__module__ != "zlib":
                                    raise
                                rows.append((name, None, f"zlib: {e}"))
                except (zipfile.BadZipFile, EOFError, OSError, ValueError) as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(rows), pa.string()) for v in (path.rsplit("/", 1)[-1], path)] + [pa.array([r[i] for r in rows], pa.large_string() if i == 1 else pa.string()) for i in range(3)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(unpack, "archive string, path string, member string, content string, error string")


# Where the parts of a core's archive are, the names of its proxies, and the calibrations of each proxy in order of preference.
METADATA, DATA = "bag/data/metadata.jsonld", "bag/data/"
ALKENONE, MAGNESIUM = "(?i)uk_?37|alkenone", "(?i)mg[/_]ca"
ALKENONE_CALIBRATIONS = ["10.1002/2017PA003201", "10.1016/S0016-7037(98)00097-0", "10.1016/j.gca.2008.10.027"]
MAGNESIUM_CALIBRATIONS = ["10.1029/2018PA003517", "10.1029/2002PA000846", "10.1038/nature07717"]

COLUMN = "struct<number:string,variableName:string,units:string,calibration:struct<calibrationDOI:string>>"
CORE = f"dataSetName string, geo struct<geometry:struct<coordinates:array<double>>>, paleoData array<struct<measurementTable:array<struct<filename:string,columns:array<{COLUMN}>>>>>"


def _place(doi: Column, priority: list[str]) -> Column:
    """The place of a calibration in a list of preference, a missing one behind all."""
    at = F.array_position(F.array(*map(F.lit, priority)), doi)
    return F.when(at > 0, at).otherwise(len(priority) + 1)


def core_tables(metadata: DataFrame) -> DataFrame:
    """Measurement tables that name a temperature and an age, of metadata (path, content: JSON): path, site, lon, lat, place (p, m), file, modality, calibration, age_at and v_at (columns, from 0).

    The proxy is told by the columns' names, else by the calibration of a temperature; the temperature is the one with the most preferred calibration,
    of several the first.
    """
    d = metadata.select("path", F.from_json("content", CORE).alias("d"))
    at = d.select("path", F.col("d.dataSetName").alias("site"), F.col("d.geo.geometry.coordinates").alias("xy"), F.posexplode("d.paleoData").alias("p", "data"))
    t = at.where(F.size("xy") >= 2).select("path", "site", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"), "p", F.posexplode("data.measurementTable").alias("m", "table"))
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    heat = F.filter("table.columns", lambda c: (lower(c["variableName"]) == "temperature") & (lower(c["units"]) == "degc"))
    named = lambda regex: F.exists("table.columns", lambda c: F.coalesce(c["variableName"], F.lit("")).rlike(regex))
    known = F.filter(heat, lambda c: c["calibration"]["calibrationDOI"].isin(ALKENONE_CALIBRATIONS + MAGNESIUM_CALIBRATIONS))
    by_doi = F.when(F.try_element_at(known, F.lit(1))["calibration"]["calibrationDOI"].isin(ALKENONE_CALIBRATIONS), "alkenone").when(F.size(known) > 0, "mgca").otherwise("unknown")
    modality = F.when(named(ALKENONE), "alkenone").when(named(MAGNESIUM), "mgca").otherwise(by_doi)
    age = F.filter("table.columns", lambda c: (c["variableName"] == "age") & (c["units"] == "yr ka"))
    t = t.select("*", modality.alias("modality"), heat.alias("heat"), F.try_element_at(age, F.lit(1)).alias("age")).where("size(heat) > 0 AND age IS NOT NULL AND table.filename IS NOT NULL")
    doi = lambda c: c["calibration"]["calibrationDOI"]
    order = lambda c: F.when(F.col("modality") == "alkenone", _place(doi(c), ALKENONE_CALIBRATIONS)).otherwise(_place(doi(c), MAGNESIUM_CALIBRATIONS))
    best = F.array_min(F.transform("heat", lambda c, i: F.struct(order(c).alias("place"), i.alias("i"))))
    t = t.withColumn("best", F.element_at("heat", best["i"].cast("int") + 1))
    number = lambda c: c["number"].try_cast("int") - 1
    return t.select("path", "site", "lon", "lat", "p", "m", F.concat(F.lit(DATA), "table.filename").alias("file"), "modality", F.coalesce(doi(F.col("best")), F.lit("unknown")).alias("calibration"), number(F.col("age")).alias("age_at"), number(F.col("best")).alias("v_at"))


def cores(spark: SparkSession, path: str, box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0), least: int = 3, pattern: str = "*.lpd") -> DataFrame:
    """path, site, lon, lat, modality, calibration, age_ka, v: the first measurement table of each core in the box (south, north, west, east) with at least `least` rows of two finite numbers.

    Cores without such a table, and archives or members that can't be read, give no rows; members() tells their errors.
    """
    unpacked = members(spark, path, pattern, rf"^{DATA}")
    tables = core_tables(unpacked.where(F.col("member") == METADATA)).where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]) & F.col("age_at").isNotNull() & F.col("v_at").isNotNull())
    read = tables.join(unpacked.select("path", F.col("member").alias("file"), "content").where("content IS NOT NULL"), ["path", "file"])
    lines = read.withColumn("line", F.explode(F.split("content", "\r?\n"))).withColumn("cells", F.split("line", ",")).drop("content", "line")
    number = lambda at: F.trim(F.try_element_at("cells", F.col(at) + 1)).try_cast("double")
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))  # noqa: E731  null for null
    rows = lines.where("age_at >= 0 AND v_at >= 0").select("path", "site", "lon", "lat", "p", "m", "modality", "calibration", number("age_at").alias("age_ka"), number("v_at").alias("v")).where(finite("age_ka") & finite("v"))
    usable = rows.groupBy("path", "p", "m").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("path").agg(F.min(F.struct("p", "m")).alias("first")).select("path", F.col("first.p").alias("p"), F.col("first.m").alias("m"))
    return rows.join(usable, ["path", "p", "m"]).drop("p", "m")


# Where the parts of a workbook are.
WORKBOOK, RELATIONS, STRINGS, SHEETS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/worksheets/"

TEXT = "struct<_VALUE:string,`_xml:space`:string>"
XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def _text(c: Column) -> Column:
    """The plain text of a string item: its own, or its runs' together."""
    return F.coalesce(c["t"]["_VALUE"], F.array_join(F.transform(c["r"], lambda r: F.coalesce(r["t"]["_VALUE"], F.lit(""))), ""), F.lit(""))


def _parsed(parts: DataFrame, schema: str, tag: str) -> DataFrame:
    return parts.select("path", "member", F.from_xml("content", schema, XML | {"rowTag": tag}).alias("x"))


def cells(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """path, sheet (name), row (from 1), col (from 0), text of each cell with a value in the sheets of all workbooks of a folder; shared strings are joined by their number."""
    parts = members(spark, path, pattern, rf"^({WORKBOOK}|{RELATIONS}|{STRINGS}|{SHEETS}[^/]+\.xml)$").where("content IS NOT NULL")
    sheets = _parsed(parts.where(F.col("member") == WORKBOOK), "sheets struct<sheet:array<struct<_name:string,_id:string,`_r:id`:string>>>", "workbook").select("path", F.explode("x.sheets.sheet").alias("s"))
    links = _parsed(parts.where(F.col("member") == RELATIONS), "Relationship array<struct<_Id:string,_Target:string>>", "Relationships").select("path", F.explode("x.Relationship").alias("l"))
    named = sheets.select("path", F.col("s._name").alias("sheet"), F.coalesce("s._r:id", "s._id").alias("id")).join(links.select("path", F.col("l._Id").alias("id"), F.regexp_replace("l._Target", "^(/xl/|xl/)?", "xl/").alias("member")), ["path", "id"])
    item = f"struct<t:{TEXT},r:array<struct<t:{TEXT}>>>"
    body = _parsed(parts.where(F.col("member").startswith(SHEETS)), f"sheetData struct<row:array<struct<_r:int,c:array<struct<_r:string,_t:string,v:{TEXT},is:{item}>>>>>", "worksheet")
    rows = body.join(named, ["path", "member"]).select("path", "sheet", F.posexplode("x.sheetData.row").alias("i", "row"))
    each = rows.select("path", "sheet", F.coalesce("row._r", F.col("i") + 1).alias("row"), F.posexplode("row.c").alias("j", "c"))
    letters = F.split(F.regexp_extract("c._r", "^([A-Z]+)", 1), "")
    col = F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1
    each = each.select("path", "sheet", "row", F.when(F.col("c._r").isNotNull(), col).otherwise(F.col("j")).alias("col"), F.col("c._t").alias("kind"), F.when(F.col("c._t") == "inlineStr", _text(F.col("c.is"))).otherwise(F.col("c.v._VALUE")).alias("v"))
    strings = _parsed(parts.where(F.col("member") == STRINGS), f"si array<{item}>", "sst").select("path", F.posexplode("x.si").alias("number", "si")).select("path", "number", _text(F.col("si")).alias("shared"))
    at = F.when(F.col("kind") == "s", F.col("v").try_cast("int"))
    joined = each.withColumn("number", at).join(strings, ["path", "number"], "left")
    return joined.select("path", "sheet", "row", "col", F.when(F.col("kind") == "s", F.col("shared")).otherwise(F.col("v")).alias("text")).where("text IS NOT NULL")


def sheet_series(values: DataFrame, year_at: int = 0, v_at: int = 1) -> DataFrame:
    """path, sheet, row, year, v of two columns of cells(): from the second row on, those that are finite numbers, with a year that isn't negative."""
    rows = values.where((F.col("row") >= 2) & F.col("col").isin(year_at, v_at)).groupBy("path", "sheet", "row")
    number = lambda at: F.max(F.when(F.col("col") == at, F.trim("text").try_cast("double")))
    out = rows.agg(number(year_at).alias("year"), number(v_at).alias("v"))
    return out.where("year >= 0 AND NOT isnan(year) AND NOT isnan(v) AND abs(year) < double('inf') AND abs(v) < double('inf')")


def sheet_xml(cells: Column) -> Column:
    """A worksheet's XML of an array of rows, each an array of struct<ref, kind, text> (kind s: number of a shared string, str: text, n: number)."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit('<c r="'), c["ref"], F.lit('" t="'), c["kind"], F.lit('"><v>'), escaped(c["text"]), F.lit("</v></c>"))
    row = lambda r, i: F.concat(F.lit('<row r="'), (i + 1).cast("string"), F.lit('">'), F.array_join(F.transform(r, cell), ""), F.lit("</row>"))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'), F.array_join(F.transform(cells, row), ""), F.lit("</sheetData></worksheet>"))


def workbook(sheets: DataFrame, strings: list[str]) -> DataFrame:
    """Rows (archive, member, content) of one workbook an archive. sheets: archive, name, xml; strings: the shared ones of all."""
    order = Window.partitionBy("archive").orderBy("name")
    s = sheets.withColumn("i", F.row_number().over(order).cast("string"))
    body = s.select("archive", F.concat(F.lit(f"{SHEETS}sheet"), "i", F.lit(".xml")).alias("member"), F.col("xml").alias("content"))
    of = F.array_sort(F.collect_list(F.struct("i", "name")))
    joined = lambda f: F.array_join(F.transform(of, f), "")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    tags = s.groupBy("archive").agg(
        joined(lambda x: F.concat(F.lit('<sheet name="'), x["name"], F.lit('" sheetId="'), x["i"], F.lit('" r:id="rId'), x["i"], F.lit('"/>'))).alias("sheets"),
        joined(lambda x: F.concat(F.lit('<Relationship Id="rId'), x["i"], F.lit('" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet'), x["i"], F.lit('.xml"/>'))).alias("links"),
    )
    book = F.concat(F.lit(f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'), "sheets", F.lit("</sheets></workbook>"))
    links = F.concat(F.lit(f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'), "links", F.lit("</Relationships>"))
    shared = F.lit(f'{head}<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
    parts = F.array(*[F.struct(F.lit(m).alias("member"), c.alias("content")) for m, c in ((WORKBOOK, book), (RELATIONS, links), (STRINGS, shared))])
    return body.unionByName(tags.select("archive", F.explode(parts).alias("p")).select("archive", "p.member", "p.content"))
