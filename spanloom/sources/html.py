"""HTML ingestion: block text with roles, tables with cells and exact offsets, title and meta."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assembly import Assembly

#: Block tags and their roles, and tags whose text is dropped.
ROLES = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "li": "list_item"}
DROPPED = ("script", "style")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
SNIFFED = 4096
BLOCKS = "page_id long, block_index long, role string, text string, start_char long, end_char long, start_byte long, end_byte long, title string, error string"
META = "page_id long, title string, meta map<string,string>, error string"
CELLS = "page_id long, table_id string, row_index int, column_index int, start_char long, end_char long, header_labels array<string>, error string"


def decode(raw: bytes) -> tuple[str, str]:
    """(text, charset): the charset declared in the first bytes, else UTF-8, strictly."""
    found = CHARSET.search(raw[:SNIFFED])
    name = found[1].decode("ascii").lower() if found else "utf-8"
    return raw.decode(name), name


class Page(HTMLParser):
    """Reads one page into an :class:`Assembly`. Text outside headings, paragraphs, list items and
    tables is dropped; white space collapses. A block that opens closes the one before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.meta = Assembly(), None, {}
        self._mute, self._parts, self._role = 0, None, None
        self._rows: list[list[list[str]]] = []
        self._cell, self._heading = None, None

    @staticmethod
    def _flat(parts) -> str:
        return " ".join("".join(parts).split())

    def _close_block(self) -> None:
        if self._parts is not None:
            self.out.block(self._role, self._flat(self._parts))
        self._parts = self._role = None

    def _close_cell(self) -> None:
        if self._cell is not None and self._rows and self._rows[-1]:
            self._rows[-1][-1].append(self._flat(self._cell))
        self._cell = None

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self._mute += 1
        elif tag == "title":
            self._heading = []
        elif tag == "meta":
            a = {k: v for k, v in attrs if v is not None}
            name = a.get("name") or a.get("property") or a.get("http-equiv")
            if "charset" in a:
                self.meta["charset"] = a["charset"]
            if name and "content" in a:
                self.meta[name.lower()] = " ".join(a["content"].split())
        elif tag == "table":
            self._close_block()
            self._rows.append([])
        elif self._rows:
            if tag == "tr":
                self._close_cell()
                self._rows[-1].append([])
            elif tag in ("td", "th"):
                self._close_cell()
                self._cell = []
        elif tag in ROLES:
            self._close_block()
            self._role, self._parts = ROLES[tag], []

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self._mute = max(0, self._mute - 1)
        elif tag == "title":
            self.title = self._flat(self._heading or []) or None
            self._heading = None
        elif tag == "table" and self._rows:
            self._close_cell()
            rows = [r for r in self._rows.pop() if r]
            if not self._rows and rows:
                self.out.table(rows)
        elif self._rows:
            if tag in ("td", "th", "tr"):
                self._close_cell()
        elif tag in ROLES:
            self._close_block()

    def handle_data(self, data):
        if self._mute:
            return
        into = self._heading if self._heading is not None else self._cell if self._rows else self._parts
        if into is not None:
            into.append(data)

    def finish(self) -> Page:
        self.close()
        self._close_block()
        return self


def read(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    return page.finish()


def _rows_of(pages: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make(page_id, page)`` yields; a page that fails gives one row with an error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for page_id, html in zip(pdf.page_id, pdf.html):
                try:
                    out += [(page_id, *row, None) for row in make(read(html))]
                except Exception as e:  # noqa: BLE001  kept as a row, so that one page fails no job
                    out.append((page_id, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            pdf = pd.DataFrame(out, columns=names)
            yield pdf.astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.split()[1] in ("long", "int")})

    return pages.select("page_id", "html").mapInPandas(run, schema)


def blocks(pages: DataFrame) -> DataFrame:
    """One row a block; offsets run over the blocks joined by line ends."""

    def make(page: Page):
        text = page.out.text
        for i, s in enumerate(page.out.layout):
            yield i, s["role"], text[s["start_char"] : s["end_char"]], s["start_char"], s["end_char"], s["start_byte"], s["end_byte"], page.title

    return _rows_of(pages, BLOCKS, make)


def table_cells(pages: DataFrame) -> DataFrame:
    """One row a table cell, with its place in the page's text and its column's header."""

    def make(page: Page):
        for t in page.out.tables:
            for c in t["cells"]:
                yield t["table_id"], c["row_index"], c["column_index"], c["start_char"], c["end_char"], c["header_labels"]

    return _rows_of(pages, CELLS, make)


def title_meta(pages: DataFrame) -> DataFrame:
    """Title and meta entries of each page; the title is also an entry."""

    def make(page: Page):
        yield page.title, dict(sorted({**page.meta, **({"title": page.title} if page.title else {})}.items()))

    found = _rows_of(pages, META, make)
    return found.select("page_id", "title", F.to_json("meta").alias("meta"), "error")


def headings(pages: DataFrame) -> DataFrame:
    return blocks(pages).where("role = 'heading'").select("page_id", "block_index", "text")


def block_counts(pages: DataFrame) -> DataFrame:
    """Opening tags by role, without parsing: a native estimate of :func:`blocks`."""
    html = F.coalesce("html", F.lit(""))
    count = lambda pat: F.size(F.regexp_extract_all(html, F.lit(pat), F.lit(0))).cast("long")
    return pages.select("page_id", count("<h[1-6][ >]").alias("headings"), count("<p[ >]").alias("paragraphs"), count("<li[ >]").alias("items"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"))
