"""PDF files: objects, Flate streams, pages in order, text operators, the fonts' maps to Unicode, information, links."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.DOTALL)
_STREAM = re.compile(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A step back in an array of strings, in thousandths of the font size, beyond which words part.
SPACE = 180


def _stream(body: bytes) -> bytes | None:
    m = _STREAM.match(body)
    if not m:
        return None
    if b"FlateDecode" in m[1]:
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return None
    return m[2] if b"/Filter" not in m[1] else None


def objects(content: bytes) -> dict[int, bytes]:
    """Number -> body of each object, those in object streams included; of several versions the last."""
    found = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in [*found.values()]:
        head = re.search(rb"/Type\s*/ObjStm", body)
        data = _stream(body) if head else None
        if data is None:
            continue
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
        table = [*map(int, data[:first].split())]
        places = [*zip(table[0 : 2 * n : 2], table[1 : 2 * n : 2], strict=True)]
        for k, (number, at) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) else len(data) - first
            found.setdefault(number, data[first + at : first + end])
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
    return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(found: dict[int, bytes]) -> list[int]:
    """Pages by the page tree from the catalog on; without one, in the order of their numbers."""
    out, seen = [], set()

    def walk(n: int) -> None:
        if n in seen:
            return
        seen.add(n)
        body = found.get(n, b"")
        kids = _refs(body, b"Kids")
        if kids:
            for k in kids:
                walk(k)
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(n)

    for body in found.values():
        if re.search(rb"/Type\s*/Catalog\b", body):
            for n in _refs(body, b"Pages"):
                walk(n)
    return out or sorted(n for n, body in found.items() if re.search(rb"/Type\s*/Page\b", body))


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.DOTALL)


def _unicode_map(data: bytes) -> dict[int, str]:
    """Code -> text of a font's ToUnicode stream."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    table: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        table |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(c)
            table |= {int(a, 16) + k: first[:-1] + chr(ord(first[-1]) + k) for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16))}
    return table


def _fonts(found: dict[int, bytes], page: bytes) -> dict[bytes, dict[int, str]]:
    held = page + b"".join(found.get(n, b"") for n in _refs(page, b"Resources")) + b"".join(found.get(n, b"") for n in _refs(page, b"Parent"))
    held += b"".join(found.get(n, b"") for n in _refs(held, b"Font"))
    fonts = {}
    for name, n in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", held):
        for m in _refs(found.get(int(n), b""), b"ToUnicode"):
            data = _stream(found.get(m, b""))
            if data:
                fonts[name] = _unicode_map(data)
    return fonts


def _shown(token: bytes, font: dict[int, str]) -> str:
    raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2)) if token[:1] == b"<" else _unescaped(token[1:-1])
    if font:
        wide = 2 if max(font) > 255 or (len(raw) % 2 == 0 and raw[:1] == b"\0") else 1
        return "".join(font.get(int.from_bytes(raw[k : k + wide]), "") for k in range(0, len(raw), wide))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _text(data: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    out: list[str] = []
    font: dict[int, str] = {}
    args: list[bytes] = []
    for m in _TOKEN.finditer(data):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            args.append(t)
            continue
        if t == b"Tf":
            font = next((fonts[a[1:]] for a in args if a[:1] == b"/" and a[1:] in fonts), {})
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for a in args:
                if a[:1] in b"(<":
                    out.append(_shown(a, font))
                elif a[:1] not in b"[]/" and t == b"TJ" and float(a) < -SPACE:
                    out.append(" ")
        elif t in (b"Td", b"TD"):
            out.append("\n" if len(args) >= 2 and float(args[-1]) else " ")
        elif t in (b"T*", b"Tm", b"ET"):
            out.append("\n")
        args = []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip()


def pages(content: bytes | None) -> list[str]:
    """The text of each page; a file that is no PDF has none, nor has one that is encrypted."""
    if not content or b"%PDF-" not in content[:1024] or b"/Encrypt" in content:
        return []
    found = objects(content)
    out = []
    for n in _pages(found):
        data = b"\n".join(s for s in (_stream(found.get(k, b"")) for k in _refs(found[n], b"Contents")) if s)
        out.append(_text(data, _fonts(found, found[n])))
    return out


#: Entries of the information dictionary that are kept.
INFO = ("Title", "Author", "Subject", "Keywords")
#: A line of ten words at most that begins so is a heading.
_HEADING = re.compile(r"(?i)(?:[\d.]*\.|section|chapter|abstract|references)(?:\s|$)")
_LITERAL = rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)"


def document(content: bytes | None) -> tuple[str | None, dict[str, str], str | None, list[str]]:
    """Title, information, Markdown and link targets of a file; nothing of what has no pages.

    Pages are marked by comments, headings by two signs. The title is that of the information dictionary, else the
    first heading. Links are those of annotations with an address, each once.
    """
    texts = pages(content)
    if not texts:
        return None, {}, None, []
    found = objects(content)
    info = b"".join(found.get(int(n), b"") for n in re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", content))
    meta = {}
    for name in INFO:
        m = re.search(rb"/%s%s" % (name.encode(), _LITERAL), info)
        if m and (said := _shown(m[1], {}).strip()):
            meta[name.lower()] = said
    lines, first = [], None
    for k, text in enumerate(texts, 1):
        lines += ["", f"<!-- Page {k} -->", ""]
        for line in filter(None, text.split("\n")):
            heading = len(line.split()) <= 10 and _HEADING.match(line)
            first = first or (line if heading else None)
            lines.append(f"## {line}" if heading else line)
    links: dict[str, None] = {}
    for n in _pages(found):
        annotated = found[n] + b"".join(found.get(r, b"") for r in _refs(found[n], b"Annots"))
        annotated += b"".join(found.get(r, b"") for r in _refs(annotated, b"A"))
        for m in re.finditer(rb"/URI" + _LITERAL, annotated):
            links[_shown(m[1], {}).strip()] = None
    return meta.get("title") or first, meta, "\n".join(lines).strip(), [x for x in links if x]


def pdf_documents(files: DataFrame) -> DataFrame:
    """path, title, metadata, markdown, links of (path, content); what is no PDF gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("target", pa.string()), ("label", pa.string())]))
        for batch in batches:
            found = [document(c) for c in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([[*f[1].items()] for f in found], pa.map_(pa.string(), pa.string())), pa.array([f[2] for f in found], pa.string()), pa.array([[{"target": t, "label": None} for t in f[3]] for f in found], link)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", "title", "metadata", "markdown", "links"])

    return files.select("path", "content").mapInArrow(run, "path string, title string, metadata map<string,string>, markdown string, links array<struct<target:string,label:string>>")


def pdf_files(files: DataFrame) -> DataFrame:
    """path, page (from 1), text of (path, content). Scanned pages have empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, k, t) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, t in enumerate(pages(c), 1)]
            columns = [*zip(*rows, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["path", "page", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string")
