"""Results as one CSV, TSV, JSON or XLSX file, or as a folder of part files."""

from __future__ import annotations

import csv
import io
import json
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch_path
from .storage import copied, joined, removed

FORMATS = ["dataframe", "csv", "tsv", "xlsx", "json"]


def write_parts(df: DataFrame, fmt: str, path: str) -> None:
    """Distributed output: every task writes its own part."""
    if fmt == "json":
        df.write.json(path)
    else:
        df.write.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')


def _text(v: object) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _xlsx(df: DataFrame, path: str) -> None:
    types = "http://schemas.openxmlformats.org/package/2006/content-types"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("[Content_Types].xml", f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        out.writestr("_rels/.rels", f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="results" sheetId="1" r:id="r1"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with out.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for row in [df.columns, *()]:
                sheet.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
            for row in df.toLocalIterator():
                sheet.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
            sheet.write(b"</sheetData></worksheet>")


def _field(name: str, kind: T.DataType, sep: str):
    """A column as a field of a line: null is empty, quotes only where they are needed."""
    value = F.col(f"`{name}`").cast("string")
    if isinstance(kind, T.StringType):
        value = F.when(value.rlike(f'["\r\n{sep}]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)
    return F.coalesce(value, F.lit(""))


def _joined_file(df: DataFrame, fmt: str, path: str) -> None:
    """Every task writes its own lines in the shared folder; their bytes are joined to one file."""
    spark, folder = df.sparkSession, scratch_path(df.sparkSession)
    sep = "\t" if fmt == "tsv" else ","
    if fmt == "json":
        # One record a line, each after the first with a comma before it: an array that can be read by lines.
        line = F.concat(F.lit(","), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
        head, tail, skip = "[", "]", 1
    else:
        line = F.concat_ws(sep, *(_field(f.name, f.dataType, sep) for f in df.schema))
        text = io.StringIO(newline="")
        csv.writer(text, delimiter=sep, lineterminator="\n").writerow(df.columns)
        head, tail, skip = text.getvalue(), "", 0
    try:
        df.select(line.alias("value")).write.text(folder)
        joined(spark, folder, path, head.encode(), tail.encode(), skip)
    finally:
        removed(spark, folder)


def read_json_file(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON file of ``write_file``, read by lines, so that a large file is split."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[\[,]\{"))
    return lines.select(F.from_json(F.expr("substr(value, 2)"), schema).alias("x")).select("x.*")


def write_file(df: DataFrame, fmt: str, name: str) -> str:
    """One file; the suffix is added unless it is there.

    Texts, whole numbers and booleans are written by all tasks and joined by bytes.
    Other columns, and XLSX, are streamed partition by partition; a name with a
    store (``scheme://...``) is then written by the driver beside it first and copied there.
    """
    path = str(name)
    if not path.lower().endswith(f".{fmt}"):
        path += f".{fmt}"
    if fmt != "xlsx" and all(isinstance(f.dataType, T.StringType | T.IntegralType | T.BooleanType) for f in df.schema) and len(df.columns) > 1:
        _joined_file(df, fmt, path)
        return path
    if "://" in path:
        with tempfile.TemporaryDirectory() as folder:
            copied(df.sparkSession, write_file(df, fmt, f"{folder}/part"), path)
        return path
    if fmt == "xlsx":
        _xlsx(df, path)
    elif fmt == "json":
        with open(path, "w", encoding="utf-8") as out:
            out.write("[")
            for i, row in enumerate(df.toLocalIterator()):
                out.write(("," if i else "") + json.dumps(row.asDict(), ensure_ascii=False))
            out.write("]")
    else:
        with open(path, "w", encoding="utf-8", newline="") as out:
            rows = csv.writer(out, delimiter="\t" if fmt == "tsv" else ",", lineterminator="\n")
            rows.writerow(df.columns)
            rows.writerows([_text(v) for v in row] for row in df.toLocalIterator())
    return path
