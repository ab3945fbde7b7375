"""Writing changed footnotes into .docx files as tracked changes.

`df.write.format("tracked_docx").mode("append").option("path", folder).save()` takes rows of name (of the file), content (the archive as it was) and
notes (array of note: its number by first reference, as sources/docx.py counts, and runs: its new text). A row makes one file. All parts but
word/footnotes.xml are copied byte for byte, and so are all notes that don't change; of a changed note what both texts have at their start and
end (by words) stays as it is, the rest is marked as deleted and the new text as inserted.

Tasks write beside each other into a staging folder; the commit moves the files into place and writes `_changes.jsonl`, an abort removes what was staged. The
folder is any place that pyarrow's file systems and all workers reach. A note that isn't there, or a change across a break between paragraphs, is
refused: the note stays as it is and `_changes.jsonl` says so, as it does of files that can't be read (these aren't written).
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from marginalia.sources.docx import MAX_BYTES, MAX_ENTRIES

NOTES = "word/footnotes.xml"
SCHEMA = "name string, content binary, notes array<struct<note:int,runs:array<struct<text:string,italic:boolean>>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
Styled = list[tuple[str, bool]]


@dataclass
class _Run:
    """A run of a note in the bytes of the part: where it stands, its properties, its text, and whether it is italic."""

    start: int
    end: int
    properties: bytes
    text: str
    italic: bool
    paragraph: int


def _runs_by_note(raw: bytes) -> dict[str, list[_Run]]:
    """Runs with text of each note, without deleted ones."""
    parser = expat.ParserCreate(namespace_separator="}")
    found: dict[str, list[_Run]] = {}
    path: list[str] = []
    state: dict = {"note": None, "paragraph": 0, "run": None, "props": None, "deleted": 0}
    name = lambda tag: tag.rsplit("}", 1)[-1]

    def attribute(attributes: dict, key: str, default: str | None = None) -> str | None:
        return next((v for k, v in attributes.items() if name(k) == key), default)

    def close(end: int) -> None:
        state["run"].end = end

    def start(tag: str, attributes: dict) -> None:
        tag = name(tag)
        path.append(tag)
        run = state["run"]
        if tag == "footnote" and attribute(attributes, "type", "normal") == "normal":
            state.update(note=attribute(attributes, "id"), paragraph=-1)
            found[state["note"]] = []
        elif tag == "p":
            state["paragraph"] += 1
        elif tag == "del":
            state["deleted"] += 1
        elif tag == "r" and state["note"] is not None:
            state["run"] = _Run(parser.CurrentByteIndex, -1, b"", "", False, state["paragraph"])
            state["mark"] = None
        elif run is not None and tag == "rPr":
            state["props"] = parser.CurrentByteIndex
        elif run is not None and tag in ("i", "iCs") and state["mark"] is None:
            state["mark"] = True
            run.italic = attribute(attributes, "val", "true").lower() not in ("0", "false", "off")
        elif run is not None and tag == "rStyle" and state["mark"] is None:
            run.italic = attribute(attributes, "val") == "Emphasis"
        elif run is not None and tag in ("tab", "br") and path[-2] == "r":
            run.text += "\t" if tag == "tab" else "\n"

    def end(tag: str) -> None:
        tag = name(tag)
        path.pop()
        stop = raw.index(b">", parser.CurrentByteIndex) + 1
        if tag == "footnote":
            state["note"] = None
        elif tag == "del":
            state["deleted"] -= 1
        elif tag == "rPr" and state["props"] is not None:
            state["run"].properties = raw[state["props"] : stop]
            state["props"] = None
        elif tag == "r" and state["run"] is not None:
            close(stop)
            if state["run"].text and not state["deleted"]:
                found[state["note"]].append(state["run"])
            state["run"] = None

    def characters(data: str) -> None:
        if state["run"] is not None and path[-1] == "t":
            state["run"].text += data

    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.Parse(raw, True)
    return found


def _split(text: str) -> list[str]:
    out, word = [], ""
    for c in text:
        if c in "\t\n":
            out += [word, "<w:tab/>" if c == "\t" else "<w:br/>"]
            word = ""
        else:
            word += c
    return [*out, word]


def _run_xml(properties: bytes, text: str, tag: str = "t") -> bytes:
    inner = "".join(part if part in ("<w:tab/>", "<w:br/>") else f'<w:{tag} xml:space="preserve">{escape(part)}</w:{tag}>' for part in _split(text) if part)
    return b"<w:r>" + properties + inner.encode() + b"</w:r>"


def _common(old: Styled, new: Styled) -> tuple[int, int]:
    """How many characters at the start and at the end both have, cut back to where a word begins or ends."""
    most = min(len(old), len(new))
    a = next((k for k in range(most) if old[k] != new[k]), most)
    if a < max(len(old), len(new)):
        while a and not (old[a - 1][0].isspace()):
            a -= 1
    b = next((k for k in range(most - a) if old[-1 - k] != new[-1 - k]), most - a)
    while b and not old[len(old) - b][0].isspace():
        b -= 1
    return a, b


class _Refused(ValueError):
    pass


def _changed(raw: bytes, runs: list[_Run], new: Styled, mark: str, ids: Iterator[int]) -> list[tuple[int, int, bytes]]:
    """Replacements (start, end, bytes) in the part that make this note's text the new one, as tracked changes."""
    old: Styled = []
    at: list[int] = []
    for k, run in enumerate(runs):
        if k and run.paragraph != runs[k - 1].paragraph:
            old += [("\n", False)] * (run.paragraph - runs[k - 1].paragraph)
            at += [-1] * (run.paragraph - runs[k - 1].paragraph)
        old += [(c, run.italic) for c in run.text]
        at += [k] * len(run.text)
    if old and old[0][0] == " ":
        new = [(" ", old[0][1]), *new]  # the space behind the note's number isn't part of its text
    if [c for c, _ in old] == [c for c, _ in new] and all(x == y or x[0] == "\n" for x, y in zip(old, new, strict=True)):
        return []
    a, b = _common(old, new)
    gone, fresh = range(a, len(old) - b), new[a : len(new) - b]
    if any(at[i] < 0 for i in gone) or not runs:
        raise _Refused("a change across paragraphs" if runs else "no text to change")
    inserted = b""
    k = 0
    while k < len(fresh):
        stop = next((j for j in range(k, len(fresh)) if fresh[j][1] != fresh[k][1]), len(fresh))
        inserted += _run_xml(b"<w:rPr><w:i/></w:rPr>" if fresh[k][1] else b"", "".join(c for c, _ in fresh[k:stop]))
        k = stop
    if inserted:
        inserted = f'<w:ins w:id="{next(ids)}" {mark}>'.encode() + inserted + b"</w:ins>"
    # The insertion goes behind the last deleted character, or behind the last one kept before it.
    anchor = gone[-1] if len(gone) else a - 1
    out, first = [], 0
    for k, run in enumerate(runs):
        while first < len(at) and at[first] < k:
            first += 1
        places = range(first, first + len(run.text))
        parts = [("keep", [i for i in places if i < a]), ("gone", [i for i in places if a <= i < len(old) - b]), ("keep", [i for i in places if i >= max(a, len(old) - b)])]
        xml = b""
        cut = not (len(parts[0][1]) == len(run.text) or len(parts[2][1]) == len(run.text))
        if anchor < 0 and k == 0:
            xml += inserted
        for kind, where in parts:
            if where:
                text = "".join(old[i][0] for i in where)
                if kind == "gone":
                    xml += f'<w:del w:id="{next(ids)}" {mark}>'.encode() + _run_xml(run.properties, text, "delText") + b"</w:del>"
                else:
                    xml += _run_xml(run.properties, text) if cut else raw[run.start : run.end]
                if anchor in where and (kind == "gone" or where[-1] == anchor):
                    xml += inserted
        if xml != raw[run.start : run.end]:
            out.append((run.start, run.end, xml))
        first += len(run.text)
    return out


def with_changes(content: bytes, notes: list[tuple[int, Styled]], author: str, date: str) -> tuple[bytes, list[dict]]:
    """The archive with these notes changed, and what was done or refused."""
    said: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
            raise ValueError("archive too large")
        parts = {e.filename: archive.read(e) for e in entries}
    raw, body = parts.get(NOTES, b""), parts.get("word/document.xml", b"")
    for part in (raw, body):
        if b"<!DOCTYPE" in part or b"<!ENTITY" in part:
            raise ValueError("document type declaration")
    order = list(dict.fromkeys(r.get(f"{_W}id") for r in ElementTree.fromstring(body).iter(f"{_W}footnoteReference"))) if body else []
    runs = _runs_by_note(raw) if raw else {}
    mark = f"w:author={quoteattr(author)} w:date={quoteattr(date)}"
    ids = iter(range(900_000, 2**31))
    replaced: list[tuple[int, int, bytes]] = []
    for note, new in notes:
        try:
            if not 1 <= note <= len(order) or order[note - 1] not in runs:
                raise _Refused("no such note")
            found = _changed(raw, runs[order[note - 1]], new, mark, ids)
            replaced += found
            if found:
                said.append({"note": note, "refused": None})
        except _Refused as reason:
            said.append({"note": note, "refused": str(reason)})
    for start, end, xml in sorted(replaced, reverse=True):
        raw = raw[:start] + xml + raw[end:]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for e in entries:
            archive.writestr(e, raw if e.filename == NOTES else parts[e.filename], compress_type=e.compress_type)
    return out.getvalue(), said


@dataclass
class _Staged(WriterCommitMessage):
    names: list[str]
    said: list[dict]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, author: str, date: str) -> None:
        self.path, self.author, self.date, self.stage = path, author, date, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = _file_system(self.path)
        names, said = [], []
        own = uuid.uuid4().hex
        files.create_dir(f"{root}/{self.stage}/{own}", recursive=True)
        for row in iterator:
            try:
                notes = [(n["note"], [(c, bool(r["italic"])) for r in n["runs"] or [] for c in r["text"] or ""]) for n in row["notes"] or []]
                made, done = with_changes(bytes(row["content"]), notes, self.author, self.date)
            except (ValueError, TypeError, zipfile.BadZipFile, ElementTree.ParseError, expat.ExpatError) as problem:
                said.append({"name": row["name"], "note": None, "refused": str(problem) or type(problem).__name__})
                continue
            base = str(row["name"]).rsplit("/", 1)[-1]
            with files.open_output_stream(f"{root}/{self.stage}/{own}/{base}") as out:
                out.write(made)
            names.append(f"{own}/{base}")
            said += [{"name": row["name"], **d} for d in done]
        return _Staged(names, said)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _file_system(self.path)
        done = [m for m in messages if isinstance(m, _Staged)]
        for m in done:
            for name in m.names:
                files.move(f"{root}/{self.stage}/{name}", f"{root}/{name.split('/', 1)[1]}")
        with files.open_output_stream(f"{root}/_changes.jsonl") as out:
            out.write("".join(json.dumps(s, ensure_ascii=False) + "\n" for m in done for s in m.said).encode())
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _file_system(self.path)
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.stage}")


class TrackedDocx(DataSource):
    """The format "tracked_docx"; options path, author, date."""

    @classmethod
    def name(cls) -> str:
        return "tracked_docx"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added to the folder; mode must be append")
        return _Writer(self.options["path"], self.options.get("author", "editor"), self.options.get("date", "2000-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrackedDocx)
