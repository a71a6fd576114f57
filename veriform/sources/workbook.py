"""Workbooks (xlsx, xlsm): the rows of the first sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriform.sources.documents import read_folder

ROWS_SCHEMA = "file_path string, row int, values array<string>, error string"
ROWS_PER_BATCH = 2000

# Built-in number formats that show a date or a time.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(e for e in root.iter() if _local(e.tag) == "sheet")
    since_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else "xl/" + target, since_1904


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(e.get("numFmtId")) for e in root.iter()
        if _local(e.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")).lower())
    }
    formats = next((e for e in root if _local(e.tag) == "cellXfs"), ())
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in DATE_FORMAT_IDS | custom}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """``(row, values)`` of the first sheet, rows counted from 0; an empty cell is None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, since_1904 = _first_sheet(book)
        shared, dates = _shared(book), _date_styles(book)
        start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)

        def value(cell) -> str | None:
            kind = cell.get("t", "n")
            text = "".join(e.text or "" for e in cell.iter() if _local(e.tag) == ("t" if kind == "inlineStr" else "v"))
            if kind == "s":
                return shared[int(text)]
            if kind == "b":
                return "True" if text == "1" else "False"
            if not text and kind != "inlineStr":
                return None
            if kind == "n" and int(cell.get("s", 0)) in dates:
                moment = start + timedelta(days=float(text))
                return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
            return text

        place = -1
        with book.open(path) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if _local(element.tag) != "row":
                    continue
                place = int(element.get("r", place + 2)) - 1
                values: list[str | None] = []
                for cell in element:
                    at = _column(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (at - len(values)) + [value(cell)]
                element.clear()
                yield place, values


def parse_workbooks(df: DataFrame) -> DataFrame:
    """``(file_path, content)`` to ``(file_path, row, values, error)``; an unreadable workbook gives one error row."""

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"], strict=True):
                rows = []
                try:
                    for row, values in sheet_rows(content):
                        rows.append((path, row, values, None))
                        if len(rows) == ROWS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=["file_path", "row", "values", "error"])
                            rows = []
                except Exception as exc:  # one bad file must not stop the others
                    rows.append((path, None, None, f"{type(exc).__name__}: {exc}"))
                if rows:
                    yield pd.DataFrame(rows, columns=["file_path", "row", "values", "error"]).astype({"row": "Int32"})

    return df.select("file_path", "content").mapInPandas(parse, ROWS_SCHEMA)


def read_workbook(spark: SparkSession, folder: str, pattern: str = "*.xls[xm]") -> DataFrame:
    return parse_workbooks(read_folder(spark, folder, pattern))


def workbook_cells(rows: DataFrame) -> DataFrame:
    """``(file_path, row, col, value)`` of the cells that hold something."""
    cells = rows.filter("error is null").select("file_path", "row", F.posexplode("values").alias("col", "value"))
    return cells.filter("value is not null")
