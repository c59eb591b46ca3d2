"""Files to documents: text, Markdown, HTML, e-mail and DOCX with the standard library, row by row.

PDF is dispatched but has no parser here: its pages come as rows, and
:func:`spanloom.operators.layout.join_pages` puts them together.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import zipfile
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from . import html
from .assembly import Assembly

HEADERS = ("Subject", "From", "To", "Cc", "Date")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CORE, DC, TERMS = "docProps/core.xml", "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}"
RANGE = "start_char: bigint, end_char: bigint, start_byte: bigint, end_byte: bigint"
CELL = f"struct<row_index: int, column_index: int, {RANGE}, header_labels: array<string>>"
OUT = (
    f"source_path string, format string, source_sha256 string, text string, text_sha256 string, layout array<struct<span_id: string, role: string, page_number: bigint, {RANGE}>>, "
    f"tables array<struct<table_id: string, page_number: bigint, {RANGE}, cells: array<{CELL}>>>, source_map array<struct<segment_id: string, kind: string, {RANGE}>>, metadata map<string,string>, error string"
)


class Read:
    """A parsed file: its assembly and its metadata."""

    def __init__(self, out: Assembly, metadata: dict[str, str] | None = None, source: bool = False):
        self.out, self.metadata, self.source = out, metadata or {}, source


def read_text(raw: bytes) -> Read:
    """Strict UTF-8 as it is: one segment that is the source itself."""
    out = Assembly()
    out.prefix(raw.decode("utf-8"))
    return Read(out, source=True)


def read_html(raw: bytes) -> Read:
    text, charset = html.decode(raw)
    page = html.read(text)
    return Read(page.out, {**page.meta, **({"title": page.title} if page.title else {}), "declared_encoding": charset})


def read_mail(raw: bytes) -> Read:
    """Header block and body; plain text is preferred. An HTML body keeps its spans, moved by the
    header. Attachments, nested messages and defects are errors."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    if any(True for _ in m.iter_attachments()) or any(p.get_content_type() == "message/rfc822" for p in m.walk()):
        raise ValueError("attachments and nested messages are not supported")
    if any(p.defects for p in m.walk()):
        raise ValueError("the message has defects")
    body = m.get_body(preferencelist=("plain", "html"))
    if body is None:
        raise ValueError("no body")
    fields = {h: str(m[h]) for h in HEADERS if m[h]}
    head = "\n".join(f"{h}: {v}" for h, v in fields.items())
    out = Assembly()
    if head:
        out.prefix(head)
        out._put("\n\n", "generated")
    if body.get_content_subtype() == "html":
        inner = html.read(body.get_content()).out
        shift = {"start_char": out.char, "end_char": out.char, "start_byte": out.byte, "end_byte": out.byte}
        moved = lambda s: {k: v + shift.get(k, 0) if k in shift else v for k, v in s.items()}
        out.layout = [moved(s) for s in inner.layout]
        out.tables = [{**moved(t), "cells": [moved(c) for c in t["cells"]]} for t in inner.tables]
        out.segments += [moved(s) for s in inner.segments]
        out.parts += inner.parts
    else:
        out._put(body.get_content().strip(), "unmapped")
    return Read(out, {k.lower(): v for k, v in fields.items()})


def _words(node) -> str:
    return "".join((t.text or "") if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" for t in node.iter() if t.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br")).strip()


def docx_role(paragraph) -> str:
    """Headings by style, list items by style or numbering."""
    style = paragraph.find(f"{WORD}pPr/{WORD}pStyle")
    name = (style.get(f"{WORD}val") or "").lower() if style is not None else ""
    if name.startswith("heading") or name == "title":
        return "heading"
    return "list_item" if name.startswith("list") or paragraph.find(f"{WORD}pPr/{WORD}numPr") is not None else "paragraph"


def docx_metadata(package: zipfile.ZipFile) -> dict[str, str]:
    """Title, creator, created and modified of the core properties; a time that is none is an error."""
    if CORE not in package.namelist():
        return {}
    root, out = ElementTree.fromstring(package.read(CORE)), {}
    for key, tag in (("title", f"{DC}title"), ("creator", f"{DC}creator"), ("created", f"{TERMS}created"), ("modified", f"{TERMS}modified")):
        value = (root.findtext(tag) or "").strip()
        if value:
            out[key] = datetime.fromisoformat(value.replace("Z", "+00:00")).isoformat() if key in ("created", "modified") else value
    return out


def read_docx(raw: bytes) -> Read:
    """Paragraphs and tables of the body in order, one line end between them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        root, metadata = ElementTree.fromstring(package.read("word/document.xml")), docx_metadata(package)
    out = Assembly()
    for block in root.find(f"{WORD}body"):
        if block.tag == f"{WORD}p":
            out.block(docx_role(block), _words(block))
        elif block.tag == f"{WORD}tbl":
            rows = [[" ".join(_words(c).split()) for c in r.findall(f"{WORD}tc")] for r in block.findall(f"{WORD}tr")]
            if any(rows):
                out.table(rows)
    return Read(out, metadata)


def read_pdf(raw: bytes) -> Read:
    raise ValueError("no PDF parser; pass its pages to join_pages")


PARSERS = {
    "eml": ("email", read_mail), "docx": ("docx", read_docx), "html": ("html", read_html), "htm": ("html", read_html), "pdf": ("pdf", read_pdf),
    "txt": ("plain_text", read_text), "text": ("plain_text", read_text), "md": ("markdown", read_text), "markdown": ("markdown", read_text),
}


def ingest(files: DataFrame) -> DataFrame:
    """Rows of (path, content) to documents with layout, tables, source map, metadata and hashes; a
    bad file, an unknown format or an empty text gives an error row and never fails the job."""
    names = [c.split()[0] for c in ("source_path", "format", "source_sha256", "text", "text_sha256", "layout", "tables", "source_map", "metadata", "error")]

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                raw = bytes(content) if content is not None else b""
                kind, parse = PARSERS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", (None, None))
                digest = hashlib.sha256(raw).hexdigest()
                try:
                    if parse is None:
                        raise ValueError("unsupported format")
                    got = parse(raw)
                    text = got.out.text
                    if not text.strip():
                        raise ValueError("empty text")
                    segments = [{**s, "kind": "source"} if got.source else s for s in got.out.segments]
                    out.append((path, kind, digest, text, hashlib.sha256(text.encode()).hexdigest(), got.out.layout, got.out.tables, segments, got.metadata, None))
                except Exception as e:  # noqa: BLE001  kept as a row
                    out.append((path, kind, digest, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, OUT)
