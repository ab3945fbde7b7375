"""Footnotes of .docx files as rows: doc, note, runs (text, italic).

Files are read with binaryFile and parsed in Arrow batches, a file at a time. Archives with too many entries, too
large a declared size, or a document type declaration give an `error` and no notes. Notes stand in the order of their first
reference in the body, numbered from 1; separators are left out; deleted text too.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_ENTRIES, MAX_BYTES = 2000, 200 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "doc string, note int, runs array<struct<text:string,italic:boolean>>, error string"
_ROW = pa.schema([("doc", pa.string()), ("note", pa.int32()), ("runs", pa.list_(pa.struct([("text", pa.string()), ("italic", pa.bool_())]))), ("error", pa.string())])


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in archive.namelist():
        return None
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("document type declaration")
    return ElementTree.fromstring(raw)


def _is_italic(run: ElementTree.Element) -> bool:
    properties = run.find(f"{_W}rPr")
    if properties is None:
        return False
    for tag in ("i", "iCs"):
        mark = properties.find(_W + tag)
        if mark is not None:
            return mark.get(f"{_W}val", "true").lower() not in ("0", "false", "off")
    style = properties.find(f"{_W}rStyle")
    return style is not None and style.get(f"{_W}val") == "Emphasis"


def _runs(note: ElementTree.Element) -> list[dict]:
    out: list[dict] = []

    def add(text: str, italic: bool) -> None:
        if text and out and out[-1]["italic"] == italic:
            out[-1]["text"] += text
        elif text:
            out.append({"text": text, "italic": italic})

    for k, paragraph in enumerate(note.iter(f"{_W}p")):
        if k:
            add("\n", False)
        deleted = {r for d in paragraph.iter(f"{_W}del") for r in d.iter(f"{_W}r")}
        for run in paragraph.iter(f"{_W}r"):
            if run not in deleted:
                for child in run:
                    kind = child.tag.removeprefix(_W)
                    add({"t": child.text or "", "tab": "\t", "br": "\n"}.get(kind, ""), _is_italic(run))
    if out and out[0]["text"].startswith(" "):
        out[0]["text"] = out[0]["text"][1:]
    return [r for r in out if r["text"]]


def footnotes_of(content: bytes) -> list[tuple[int, list[dict]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
            raise ValueError("archive too large")
        body, notes = _part(archive, "word/document.xml"), _part(archive, "word/footnotes.xml")
    if body is None or notes is None:
        return []
    known = {n.get(f"{_W}id"): n for n in notes.iter(f"{_W}footnote") if n.get(f"{_W}type", "normal") == "normal"}
    order = dict.fromkeys(r.get(f"{_W}id") for r in body.iter(f"{_W}footnoteReference"))
    return [(k, _runs(known[i]) if i in known else []) for k, i in enumerate(order, 1)]


def read_footnotes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [{"doc": name, "note": k, "runs": runs, "error": None} for k, runs in footnotes_of(content.as_py())]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
                    rows.append({"doc": name, "note": None, "runs": None, "error": str(problem) or type(problem).__name__})
            yield pa.RecordBatch.from_pylist(rows, _ROW)

    return files.mapInArrow(parse, SCHEMA)
