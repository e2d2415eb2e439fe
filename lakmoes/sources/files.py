"""Office files and PDF to text chunks and metadata, with the standard library alone.

`read_files` lists a folder as binary rows, drops what is above the size cap before its content is read any
further, and keeps one row for each content; `decode` turns each into chunks. A file that can't be read gets
a status of its own and never stops a run.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MB = 60
CHUNK = "array<struct<idx:int,loc:string,text:string>>"
DECODED = f"status string, chunks {CHUNK}, meta map<string,string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"

Chunks = list[tuple[str, str]]


def clean(text: str) -> str:
    """Lone surrogates as question marks, so that the text can be encoded."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _props(z: zipfile.ZipFile, keys: tuple[str, ...]) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    found = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml"))}
    return {k: found[k] for k in keys if found.get(k)}


def _runs(e: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in e.iter(tag))


def docx(content: bytes) -> tuple[Chunks, dict[str, str]]:
    """One chunk: the paragraphs that aren't blank, then the rows of the tables with their cells joined by a bar."""
    z = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = [t for p in body.findall(f"{_W}p") if (t := _runs(p, f"{_W}t")).strip()]
    for row in body.iter(f"{_W}tr"):
        cells = [_runs(c, f"{_W}t").strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            lines.append(" | ".join(cells))
    meta = _props(z, ("creator", "lastModifiedBy", "title", "subject", "keywords"))
    return ([("document", "\n".join(lines))] if lines else []), meta


def xlsx(content: bytes) -> tuple[Chunks, dict[str, str]]:
    """A chunk for each sheet with data; hidden sheets are marked, and named in the metadata even if empty."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_runs(si, f"{_S}t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    chunks: Chunks = []
    hidden = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        name, secret = sheet.get("name") or "", sheet.get("state") in ("hidden", "veryHidden")
        if secret:
            hidden.append(name)
        target = (rels.get(sheet.get(f"{_R}id")) or "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        rows = []
        for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
            cells = []
            for c in row.findall(f"{_S}c"):
                v = c.find(f"{_S}v")
                text = _runs(c, f"{_S}t") if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                if c.get("t") == "s" and text.isdigit() and int(text) < len(shared):
                    text = shared[int(text)]
                if text.strip():
                    cells.append(text)
            if cells:
                rows.append(" | ".join(cells))
        if rows:
            chunks.append((f"tabblad {name}" + (" [VERBORGEN]" if secret else ""), "\n".join(rows)))
    meta = _props(z, ("creator", "lastModifiedBy", "title", "subject"))
    if hidden:
        meta["_verborgen_tabbladen"] = ", ".join(hidden)
    return chunks, meta


def pptx(content: bytes) -> tuple[Chunks, dict[str, str]]:
    """A chunk for each slide: the text of its shapes, then its notes."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    if "ppt/presentation.xml" in names and "ppt/_rels/presentation.xml.rels" in names:
        target = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        listed = [e.get(f"{_R}id") for e in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if str(e.tag).endswith("}sldId")]
        order = [t.lstrip("/") if t.startswith("/") else f"ppt/{t}" for t in (target.get(i, "") for i in listed)]
        slides = [n for n in order if n in names] or slides
    chunks: Chunks = []
    for number, name in enumerate(slides, 1):
        lines = [t for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p") if (t := _runs(p, f"{_A}t")).strip()]
        rel = name.replace("ppt/slides/", "ppt/slides/_rels/") + ".rels"
        if rel in names:
            for r in ElementTree.fromstring(z.read(rel)):
                if (r.get("Type") or "").endswith("/notesSlide"):
                    path = "ppt/" + (r.get("Target") or "").replace("../", "")
                    if path in names:
                        notes = [t for p in ElementTree.fromstring(z.read(path)).iter(f"{_A}p") if (t := _runs(p, f"{_A}t")).strip()]
                        if notes:
                            lines.append("[notities] " + " ".join(notes))
        if lines:
            chunks.append((f"dia {number}", "\n".join(lines)))
    return chunks, _props(z, ("creator", "lastModifiedBy", "title", "subject"))


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]<>()]+\s+[-\d.]+\s+Tf|T\*|Td|TD|Tm|ET|'|\"", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _raw(shown: bytes) -> bytes:
    """The bytes of a string operand, in brackets or in hexadecimal digits."""
    if shown.startswith(b"<"):
        h = re.sub(rb"\s", b"", shown[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), shown[1:-1], flags=re.S)


def _literal(raw: bytes) -> str:
    data = _raw(raw)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _character_map(stream: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code has, code -> text) of a font's map to characters."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    width, codes = 1, {}
    for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", stream, re.S):
        width = max([width, *(len(h) // 2 for h in re.findall(rb"<([0-9A-Fa-f]+)>", block))])
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        codes |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if many:
                codes |= {low + i: text(h) for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
            else:
                first = int(one, 16)
                codes |= {k: text(b"%0*x" % (len(one), first + k - low)) for k in range(low, high + 1)}
    return width, codes


class _Pdf:
    """The objects of a file, and its pages in the order of the page tree."""

    def __init__(self, content: bytes) -> None:
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                data, n, first = self.stream(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
                if n and first:
                    head = list(map(int, data[: int(first[1])].split()))
                    for k in range(int(n[1])):
                        end = head[2 * k + 3] if k + 1 < int(n[1]) else len(data) - int(first[1])
                        self.objects.setdefault(head[2 * k], data[int(first[1]) + head[2 * k + 1] : int(first[1]) + end])
        roots = re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", content)
        catalog = self.objects.get(int(roots[-1]), b"") if roots else next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", catalog)
        #: (page, its own dictionary before those of the nodes above it, which pages inherit from)
        self.pages: list[tuple[bytes, list[bytes]]] = []
        open_, seen = [(int(top[1]), [])] if top else [], set()
        while open_:
            number, above = open_.pop()
            node = self.objects.get(number)
            if number in seen or node is None:
                continue
            seen.add(number)
            kids = re.search(rb"/Kids\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", node)
            if kids:
                listed = kids[1] if kids[1] is not None else self.objects.get(int(kids[2]), b"")
                open_ += [(int(k), [node, *above]) for k in reversed(re.findall(rb"(\d+)\s+\d+\s+R", listed))]
            else:
                self.pages.append((node, [node, *above]))

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def entry(self, body: bytes, key: bytes) -> bytes:
        """The dictionary under a key, written in place or referred to."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        depth, at = 1, m.end()
        while depth and (x := re.compile(rb"<<|>>").search(body, at)):
            depth += 1 if x[0] == b"<<" else -1
            at = x.end()
        return body[m.end() : at]

    def fonts(self, above: list[bytes]) -> dict[bytes, tuple[int, dict[int, str]] | None]:
        """How each font of a page is read: by its map to characters; as single bytes (0, {}); or not at all (None), if it is composite without a map."""
        named = next((f for node in above if (f := self.entry(self.entry(node, b"Resources"), b"Font"))), b"")
        out = {}
        for name, number in re.findall(rb"/([^\s/\[\]<>()]+)\s+(\d+)\s+\d+\s+R", named):
            font = self.objects.get(int(number), b"")
            told = self.entry(font, b"ToUnicode")
            if told:
                out[name] = _character_map(self.stream(told))
            else:
                out[name] = None if re.search(rb"/Subtype\s*/Type0\b", font) else (0, {})
        return out


def pdf(content: bytes) -> tuple[Chunks, dict[str, str]]:
    """A chunk for each page with text, in the order of the page tree; pages with images only are counted in the metadata.

    Reads plain and deflated content streams. Glyph numbers of composite fonts are read by the font's map to
    characters; a page with text in a font without one is unreadable and counted, and a file without any
    readable page, or that is encrypted, is reported as unreadable rather than as empty.
    """
    if not content.lstrip().startswith(b"%PDF"):
        raise ValueError("no PDF")
    if b"/Encrypt" in content:
        raise ValueError("encrypted PDF")
    doc = _Pdf(content)
    if not doc.pages:
        raise ValueError("PDF without readable pages")
    chunks: Chunks = []
    images = unread = 0
    for number, (body, above) in enumerate(doc.pages, 1):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        data = b"\n".join(doc.stream(doc.objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else b""
        fonts, font, text, lost = doc.fonts(above), (0, {}), [], False
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            for m in _SHOWN.finditer(block):
                if m[0].endswith(b"Tf"):
                    font = fonts.get(m[0].split()[0][1:], (0, {}))
                elif m[0][:1] not in b"(<":
                    text.append("\n")
                elif font is None:
                    lost = lost or bool(_raw(m[0]))
                elif font[0]:
                    raw, width = _raw(m[0]), font[0]
                    shown = [font[1].get(int.from_bytes(raw[i : i + width], "big")) for i in range(0, len(raw), width)]
                    lost = lost or None in shown
                    text += [x for x in shown if x is not None]
                else:
                    text.append(_literal(m[0]))
            text.append("\n")
        unread += lost
        lines = "\n".join(x.strip() for x in "".join(text).split("\n") if x.strip())
        if lines:
            chunks.append((f"pagina {number}", lines))
        elif not lost and (b" Do" in data or b"/XObject" in body):
            images += 1
    if unread and not chunks:
        raise ValueError("text in fonts without a map to characters")
    meta = {}
    info = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    if info:
        for key in ("Title", "Author", "Subject", "Creator", "Producer"):
            m = re.search(rb"/" + key.encode() + rb"\s*(\((?:\\.|[^\\()])*\))", doc.objects.get(int(info[-1]), b""))
            if m and _literal(m[1]).strip():
                meta[key.lower()] = _literal(m[1]).strip()
    if images:
        meta["_ocr_kandidaat_paginas"] = str(images)
    if unread:
        meta["_fout"] = f"{unread} pages with text that could not be read"
    return chunks, meta


DECODERS = {"docx": docx, "xlsx": xlsx, "xlsm": xlsx, "pptx": pptx, "pdf": pdf}


def decode_one(content: bytes | None, ext: str | None) -> tuple[str, Chunks, dict[str, str]]:
    """(status, chunks, meta): status is ok, empty, unreadable (with _fout in the metadata) or unsupported."""
    reader = DECODERS.get((ext or "").lower().lstrip("."))
    if reader is None:
        return "unsupported", [], {}
    try:
        chunks, meta = reader(content or b"")
    except Exception as e:  # whatever a broken file does, the run goes on
        return "unreadable", [], {"_fout": f"{type(e).__name__}: {e}"[:200]}
    chunks = [(clean(a), clean(b)) for a, b in chunks]
    return ("ok" if chunks else "empty"), chunks, {clean(k): clean(v) for k, v in meta.items()}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("loc", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for path, ext, sha, content in zip(*(batch.column(c).to_pylist() for c in ("path", "ext", "sha256", "content"))):
            status, chunks, meta = decode_one(content, ext)
            rows = [{"idx": i, "loc": a, "text": b} for i, (a, b) in enumerate(chunks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([ext], pa.string()), pa.array([sha]), pa.array([status]), pa.array([rows], kind), pa.array([list(meta.items())], pa.map_(pa.string(), pa.string()))], names=["path", "ext", "sha256", "status", "chunks", "meta"]
            )


def read_files(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> DataFrame:
    """(path, ext, length, sha256, content) of the files below path within the size cap; the cap is applied on the listing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_mb * 1024 * 1024)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return f.select("path", F.when(ext == "", F.lit("bin")).otherwise(ext).alias("ext"), "length", F.sha2("content", 256).alias("sha256"), "content")


def too_large(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> DataFrame:
    """(path, ext, sha256, status, chunks, meta) of the files above the size cap, as decode gives them: status 'too large', with _fout in the metadata. Contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > max_mb * 1024 * 1024)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    why = F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(f" bytes, above {max_mb} MB"))
    rows = f.select("path", F.when(ext == "", F.lit("bin")).otherwise(ext).alias("ext"), F.lit(None).cast("string").alias("sha256"), F.lit("too large").alias("status"), why.alias("why"))
    return rows.select("path", "ext", "sha256", "status", F.array().cast(CHUNK).alias("chunks"), F.create_map(F.lit("_fout"), F.col("why")).alias("meta"))


def decode(files: DataFrame) -> DataFrame:
    """(path, ext, sha256, status, chunks, meta) of each content once; equal contents are decoded under their first path."""
    first = files.groupBy("sha256").agg(F.min("path").alias("_first"))
    once = files.join(first, "sha256").where(F.col("path") == F.col("_first"))
    return once.select("path", "ext", "sha256", "content").mapInArrow(_decode, f"path string, ext string, sha256 string, {DECODED}")
