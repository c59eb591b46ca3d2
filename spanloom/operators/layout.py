"""Layout: joined pages, aligned words and cells, span shifts, boundaries, blocks and their packing.

A document row carries its layout as arrays of structs: ``page_map`` (page_number, start_char,
end_char, start_byte, end_byte), ``layout`` (span_id, role, page_number and the four offsets) and
``tables`` (table_id, page_number and the four offsets). All work stays inside the row.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from ..functions.text import stable_id

RANGE = "start_char: bigint, end_char: bigint, start_byte: bigint, end_byte: bigint"
PAGES = f"array<struct<page_number: bigint, {RANGE}>>"
LAYOUT = f"array<struct<span_id: string, role: string, page_number: bigint, {RANGE}>>"
TABLES = f"array<struct<table_id: string, page_number: bigint, {RANGE}>>"
SEPARATOR = "\n\n"
#: What comes first where boundaries fall on one place.
PRIORITIES = {"document_start": 0, "document_end": 0, "page_start": 10, "page_end": 10, "layout_start": 20, "layout_end": 20, "table_start": 30, "table_end": 30}


def join_pages(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page_number, text) to one document: text, page_map and source_map.

    Pages stand in the order of their numbers and are numbered anew from 1, two line ends between
    them. Separators are ``generated`` segments, pages ``unmapped`` ones; empty pages have none.
    """
    each = F.struct(F.col("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("ps"))
    gap = len(SEPARATOR)

    def placed(size) -> Column:
        return running_sums(F.transform("ps", lambda p: size(p["text"]) + gap))

    docs = docs.withColumn("cs", placed(F.length)).withColumn("bs", placed(F.octet_length))

    def page(p: Column, i: Column) -> Column:
        c, b = F.get("cs", i), F.get("bs", i)
        return F.struct((i + 1).cast("long").alias("page_number"), c.alias("start_char"), (c + F.length(p["text"])).alias("end_char"), b.alias("start_byte"), (b + F.octet_length(p["text"])).alias("end_byte"))

    docs = docs.withColumn("page_map", F.transform("ps", page))

    def segment(name: Column, kind: str, c0, c1, b0, b1) -> Column:
        return F.struct(name.alias("segment_id"), F.lit(kind).alias("kind"), c0.alias("start_char"), c1.alias("end_char"), b0.alias("start_byte"), b1.alias("end_byte"))

    def segments(p: Column) -> Column:
        n = p["page_number"].cast("string")
        before = (p["page_number"] - 1).cast("string")
        own = segment(F.concat(F.lit("unmapped:page:"), n), "unmapped", p["start_char"], p["end_char"], p["start_byte"], p["end_byte"])
        sep = segment(F.concat(F.lit("generated:page-separator:"), before, F.lit(":"), n), "generated", p["start_char"] - gap, p["start_char"], p["start_byte"] - gap, p["start_byte"])
        return F.array_compact(F.array(F.when(p["page_number"] > 1, sep), F.when(p["end_char"] > p["start_char"], own)))

    text = F.array_join(F.transform("ps", lambda p: p["text"]), SEPARATOR)
    return docs.select("doc_id", text.alias("text"), "page_map", F.flatten(F.transform("page_map", segments)).alias("source_map"))


#: Parts that are looked for by one pattern, at least and at most, and patterns of a text, if the most allows.
BLOCK, MOST, BLOCKS = 32, 256, 1024
_GROUPS = "\0".join(f"${i + 1}" for i in range(MOST))


def _tools(text: Column, parts: Column) -> dict[str, Column]:
    """What :func:`_blocks` takes: the text's bytes, the parts as they stand in a pattern (null if one is
    empty or null), a mark that occurs nowhere in the text, and how many parts a block has."""
    quoted = F.transform(parts, lambda w: F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")))
    quoted = F.when(F.contains(F.array_join(parts, " "), F.lit("\\E")), quoted).otherwise(parts)
    sound = ~F.coalesce(F.array_contains(parts, ""), F.lit(True))
    # One zero more than the text's longest run of them; the ones keep its own zeros away.
    run = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("\\x00+"), F.lit(0)), F.length))
    mark = F.when(F.contains(text, F.lit("\0")), F.concat(F.lit("\1"), F.repeat(F.lit("\0"), run + 1), F.lit("\1"))).otherwise(F.lit("\0"))
    size = F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.ceil(F.size(parts) / BLOCKS).cast("int")))
    return {"octets": text.cast("binary"), "quoted": F.when(sound, quoted), "mark": mark, "size": size}


def _blocks(octets: Column, quoted: Column, mark: Column, size: Column) -> Column:
    """Blocks of parts in the text, each with the text before it (``chars``, ``octets``) and ``marked``: a mark, then
    the text up to the end of each part, with a mark between. Null if a part is missing, empty or null.

    One pattern finds the parts of a block: a group a part, the shortest stretch that ends with it, which is
    never taken back. It is tried on the text close by, and on all that is left if that does not hold them.
    The text is taken as valid UTF-8, as patterns read it.
    """
    count = lambda k: F.least(size, F.size(quoted) - k * size)
    block = lambda marked, n, chars, by: F.struct(marked.alias("marked"), n.alias("n"), chars.alias("chars"), by.alias("octets"))

    def found(by: Column, k: Column) -> Column:
        pattern = F.concat(F.lit("(?s)\\A((?>.*?\\Q"), F.array_join(F.slice(quoted, k * size + 1, size), "\\E))((?>.*?\\Q"), F.lit("\\E)).*"))
        groups = F.concat(mark, F.replace(F.call_function("substring_index", F.lit(_GROUPS), F.lit("\0"), count(k)), F.lit("\0"), mark))
        close = F.greatest(size * 24, F.floor(F.octet_length(octets) / BLOCKS).cast("int"))
        behind = lambda n: F.call_function("substring", octets, (by + 1).cast("int"), n).cast("string")
        left = behind(F.lit(2**31 - 1))
        # The cut may fall into a character, so the last one goes.
        near = F.when(F.octet_length(octets) - by > close, let(behind(close), lambda t: F.left(t, F.length(t) - 1))).otherwise(left)
        return let(F.regexp_replace(near, pattern, groups), lambda t: F.when(F.startswith(t, mark), t).otherwise(F.regexp_replace(left, pattern, groups)))

    def step(out: Column, k: Column) -> Column:
        b = F.element_at(out, -1)
        by = b["octets"] + F.octet_length(b["marked"]) - b["n"] * F.octet_length(mark)
        chars = b["chars"] + F.length(b["marked"]) - b["n"] * F.length(mark)
        return F.when(F.startswith(b["marked"], mark), F.concat(out, F.array(block(found(by, k), count(k), chars, by)))).otherwise(out)

    zero = F.lit(0).cast("long")
    first = F.array(block(mark, F.lit(1), zero, zero)).cast("array<struct<marked: string, n: int, chars: bigint, octets: bigint>>")
    last = F.floor((F.size(quoted) - 1) / size).cast("int")
    ended = lambda out: F.when(F.startswith(F.element_at(out, -1)["marked"], mark), F.slice(out, F.lit(2), F.size(out)))
    return F.when(F.size(quoted) > 0, F.aggregate(F.sequence(F.lit(0), last), first, step, ended))


def _place(b: Column, upto: Column, part: Column, i: Column, mark: Column, chars=F.length) -> list[Column]:
    """The four offsets of a block's part ``i``, where ``upto`` is the block's marked text to its end."""
    end = b["chars"] + chars(upto) - (i + 1) * F.length(mark)
    last = b["octets"] + F.octet_length(upto) - (i + 1) * F.octet_length(mark)
    return [(end - chars(part)).alias("start_char"), end.alias("end_char"), (last - F.octet_length(part)).alias("start_byte"), last.alias("end_byte")]


def _upto(b: Column, i: Column, mark: Column) -> Column:
    return F.call_function("substring_index", b["marked"], mark, i + 2)


def aligned(text: Column, parts: Column) -> Column:
    """Places of the parts in the text (the four offsets), each looked for behind the one before; null
    if one is missing, empty or null. No parts give an empty array, a null text or array counts as empty.

    Rows of places cost less by :func:`placed`, which leaves the array as soon as the blocks are found.
    """
    text, parts = F.coalesce(text, F.lit("")), F.coalesce(parts, F.array().cast("array<string>"))

    def all_places(ws: Column, t: Column) -> Column:
        mark, size = t["mark"], t["size"]

        def within(b: Column, k: Column) -> Column:
            return F.transform(F.slice(ws, k * size + 1, size), lambda w, i: let(_upto(b, i, mark), lambda u: F.struct(*_place(b, u, w, i, mark))))

        return F.flatten(F.transform(_blocks(t["octets"], t["quoted"], mark, size), within))

    none = F.array().cast(f"array<struct<{RANGE}>>")
    return let(parts, lambda ws: F.when(F.size(ws) == 0, none).otherwise(let(let(text, lambda x: F.struct(*[t.alias(n) for n, t in _tools(x, ws).items()])), lambda t: all_places(ws, t))))


def placed(pages: DataFrame, text: str, parts: str) -> DataFrame:
    """:func:`aligned` as rows: the page's other columns, ``at`` (the part's number), ``part`` and the four
    offsets; one row without them for a page that lacks a part, or has none."""
    keep = [c for c in pages.columns if c not in (text, parts)]
    x = pages.select(*keep, F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(parts, F.array().cast("array<string>")).alias("_parts"))
    tools = {f"_{n}": t for n, t in _tools(F.col("_text"), F.col("_parts")).items()}
    x = x.select(*keep, "_parts", *[t.alias(n) for n, t in tools.items()])
    x = x.select(*keep, "_parts", "_mark", "_size", _blocks(*[F.col(n) for n in tools]).alias("_blocks"))
    x = x.select(*keep, "_parts", "_mark", "_size", F.posexplode_outer("_blocks").alias("_k", "_b"))
    b, k, i, mark, size, ascii = (F.col(n) for n in ("_b", "_k", "_i", "_mark", "_size", "_ascii"))
    # Characters are counted once a block, and for each part only where they are not bytes.
    x = x.select("*", (F.length(b["marked"]) == F.octet_length(b["marked"])).alias("_ascii"))
    own = F.when(k.isNotNull(), F.slice("_parts", k * size + 1, size))
    x = x.select(*keep, "_mark", "_size", "_k", "_b", "_ascii", F.posexplode_outer(own).alias("_i", "part"))
    x = x.select(*keep, "_mark", "_b", "_ascii", "_i", "part", (k * size + i).alias("at"), _upto(b, i, mark).alias("_upto"))
    chars = lambda t: F.when(ascii, F.octet_length(t)).otherwise(F.length(t))
    return x.select(*keep, "at", "part", *_place(b, F.col("_upto"), F.col("part"), i, mark, chars))


def placed_cells(pages: DataFrame, text: str, table: str) -> DataFrame:
    """:func:`aligned_cells` as rows: the page's other columns, row_index, column_index, the four offsets
    and header_labels; one row without them for a page that lacks a cell, or has none."""
    keep = [c for c in pages.columns if c not in (text, table)]
    rows = F.transform(F.coalesce(table, F.array().cast("array<array<string>>")), lambda r: F.coalesce(r, F.array().cast("array<string>")))
    x = pages.select(*keep, F.col(text).alias("_text"), rows.alias("_rows"))
    row = F.flatten(F.transform("_rows", lambda r, n: F.array_repeat(n, F.size(r))))
    none = F.array().cast("array<int>")
    column = F.flatten(F.transform("_rows", lambda r: F.when(F.size(r) > 0, F.sequence(F.lit(0), F.size(r) - 1)).otherwise(none)))
    x = x.select(*keep, "_text", F.flatten("_rows").alias("_cells"), F.get("_rows", F.lit(0)).alias("_names"), row.alias("_row"), column.alias("_column"))
    x = placed(x, "_text", "_cells").withColumn("row_index", F.get("_row", F.col("at"))).withColumn("column_index", F.get("_column", F.col("at")))
    label = F.get("_names", F.col("column_index"))
    labels = F.when((F.col("row_index") > 0) & (F.length(label) > 0), F.array(label)).when(F.col("at").isNotNull(), F.array().cast("array<string>"))
    return x.select(*keep, "row_index", "column_index", "start_char", "end_char", "start_byte", "end_byte", labels.alias("header_labels"))


def table_cells(rows: list[list[str]], places: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[str]]]:
    """(row, column, start, end, header labels) of cells given row by row with their places; the
    first row names the columns of the others."""
    out, at = [], iter(places)
    for r, row in enumerate(rows):
        for c in range(len(row)):
            a, b = next(at)
            labels = [rows[0][c]] if r > 0 and c < len(rows[0]) and rows[0][c] else []
            out.append((r, c, a, b, labels))
    return out


def aligned_words():
    """Spans of a page's words in its text: a function of (text, words) to an array, null on failure."""
    return lambda text, words: aligned(*[F.col(x) if isinstance(x, str) else x for x in (text, words)])


def aligned_cells():
    """Cells of a page's table (array of rows) in its text, row by row, with the labels that the first
    row gives the columns of the others: a function of (text, table), null on failure."""

    def cells(text: Column, table: Column) -> Column:
        rows = F.transform(F.coalesce(table, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))

        def placed(rs: Column) -> Column:
            def cell(places: Column, first: Column, r: Column, c: Column) -> Column:
                label = F.get(F.get(rs, F.lit(0)), c)
                labels = F.when((r > 0) & (F.length(label) > 0), F.array(label)).otherwise(F.array().cast("array<string>"))
                p = F.get(places, (first + c).cast("int"))
                return F.struct(r.alias("row_index"), c.alias("column_index"), p["start_char"].alias("start_char"), p["end_char"].alias("end_char"), labels.alias("header_labels"))

            def all_rows(places: Column, firsts: Column) -> Column:
                return F.flatten(F.transform(rs, lambda row, r: F.transform(row, lambda _, c: cell(places, F.get(firsts, r), r, c))))

            firsts = running_sums(F.transform(rs, F.size))
            return let(aligned(text, F.flatten(rs)), lambda places: let(firsts, lambda fs: F.when(places.isNotNull(), all_rows(places, fs))))

        return let(rows, placed)

    return lambda text, table: cells(*[F.col(x) if isinstance(x, str) else x for x in (text, table)])


def shift(spans: Column, chars: Column, bytes_: Column) -> Column:
    """Spans of an embedded text moved by what stands before it."""
    move = {"start_char": chars, "end_char": chars, "start_byte": bytes_, "end_byte": bytes_}

    def one(s: Column) -> Column:
        for name, by in move.items():
            s = s.withField(name, s[name] + by)
        return s

    return F.transform(spans, one)


def _adjacent(xs: Column, wrong) -> Column:
    """Whether ``wrong(before, after)`` holds for two neighbours of an array."""
    return F.exists(F.zip_with(xs, F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: F.coalesce(b.isNotNull() & wrong(a, b), F.lit(False))), lambda x: x)


def layout_errors(docs: DataFrame) -> DataFrame:
    """doc_id and errors: pages out of order or beyond the text, layout or tables on unknown pages
    or beyond the text, repeated ids, and, with a source_map, gaps, overlaps or a short cover."""
    chars, octets = F.length("text"), F.octet_length("text")
    beyond = lambda s: (s["end_char"] > chars) | (s["end_byte"] > octets)
    known = F.transform("page_map", lambda p: p["page_number"])
    strange = lambda s: ~F.array_contains(known, s["page_number"])
    repeated = lambda c, f: F.size(F.array_distinct(F.transform(c, lambda s: s[f]))) < F.size(c)
    tests = [
        (_adjacent(F.col("page_map"), lambda a, b: (b["start_char"] < a["end_char"]) | (b["start_byte"] < a["end_byte"])), "pages_overlap"),
        (F.exists("page_map", beyond), "page_beyond_text"), (repeated(F.col("page_map"), "page_number"), "page_repeated"),
        (F.exists("layout", strange) | F.exists("tables", strange), "unknown_page"),
        (F.exists("layout", beyond) | F.exists("tables", beyond), "range_beyond_text"),
        (repeated(F.col("layout"), "span_id") | repeated(F.col("tables"), "table_id"), "id_repeated"),
    ]
    if "source_map" in docs.columns:
        last = F.element_at("source_map", -1)
        first = F.get("source_map", F.lit(0))
        tests += [
            (_adjacent(F.col("source_map"), lambda a, b: (b["start_char"] != a["end_char"]) | (b["start_byte"] != a["end_byte"])) | (first["start_char"] != 0), "source_map_not_contiguous"),
            ((F.size("source_map") > 0) & ((last["end_char"] != chars) | (last["end_byte"] != octets)), "source_map_not_covering"),
        ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]))
    return docs.select("doc_id", found.alias("errors"))


def source_backed(segments: Column, start: Column, end: Column) -> Column:
    """Whether contiguous ``source`` segments cover the whole range; true without any segment."""
    met = F.filter(segments, lambda s: (s["start_char"] < end) & (s["end_char"] > start))
    covered = F.aggregate(met, F.lit(0).cast("long"), lambda n, s: n + F.least(s["end_char"], end) - F.greatest(s["start_char"], start))
    return (F.size(segments) == 0) | ((covered == end - start) & F.forall(met, lambda s: s["kind"] == "source"))


def boundaries(docs: DataFrame) -> DataFrame:
    """Starts and ends of the document, its pages, layout spans and tables in reading order:
    by character, byte, priority, id. Sorted inside the row."""

    def event(name: Column, kind: str, char: Column, byte: Column, page: Column) -> Column:
        return F.struct(
            char.cast("long").alias("char_offset"), byte.cast("long").alias("byte_offset"), F.lit(PRIORITIES[kind]).alias("priority"),
            name.alias("boundary_id"), F.lit(kind).alias("kind"), page.cast("long").alias("page_number"),
        )

    def ends(of: str, named) -> Column:
        def both(s: Column) -> Column:
            start = event(F.concat(named(s), F.lit(":start")), f"{of}_start", s["start_char"], s["start_byte"], s["page_number"])
            return F.array(start, event(F.concat(named(s), F.lit(":end")), f"{of}_end", s["end_char"], s["end_byte"], s["page_number"]))

        return F.flatten(F.transform({"page": "page_map", "layout": "layout", "table": "tables"}[of], both))

    none = F.lit(None)
    whole = F.array(
        event(F.lit("document:start"), "document_start", F.lit(0), F.lit(0), none),
        event(F.lit("document:end"), "document_end", F.length("text"), F.octet_length("text"), none),
    )
    every = F.concat(
        whole, ends("page", lambda p: F.concat(F.lit("page:"), p["page_number"].cast("string"))),
        ends("layout", lambda s: F.concat(F.lit("layout:"), s["span_id"])), ends("table", lambda t: F.concat(F.lit("table:"), t["table_id"])),
    )
    each = docs.select("doc_id", F.posexplode(F.array_sort(every)).alias("rank", "b"))
    return each.select("doc_id", F.col("rank").cast("long").alias("rank"), "b.*")


# Blocks and packing: sequential, so in Python, one document row at a time.

WORD = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?](?=\s|\Z)")
TAKEN = ("heading", "paragraph", "list_item")


class _Tokens:
    """Counts of words in slices of a text; a word cut by a slice's end counts on both sides."""

    def __init__(self, text: str):
        spans = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def count(self, a: int, b: int) -> int:
        if a >= b:
            return 0
        first = bisect_right(self.ends, a)
        return max(0, bisect_right(self.starts, b - 1) - first)

    def fit(self, a: int, most: int, end: int) -> int:
        """End of the largest prefix of [a, end) with at most so many words."""
        first = bisect_right(self.ends, a)
        over = first + most
        return end if over >= len(self.starts) else max(a + 1, min(end, self.starts[over]))


def blocks_of(text: str, layout: list[dict], tables: list[dict]) -> list[tuple]:
    """(start, end, kind, span_id, table_id): tables, and headings, paragraphs and list items
    outside them; blank gaps go to the block before, others are ``mixed``. Overlaps are an error."""
    inside = sorted((t["start_char"], t["end_char"]) for t in tables)
    found = [(t["start_char"], t["end_char"], "table", None, t["table_id"]) for t in tables]
    for s in layout:
        if s["role"] in TAKEN:
            k = bisect_right(inside, (s["start_char"], float("inf"))) - 1
            if k < 0 or s["end_char"] > inside[k][1]:
                found.append((s["start_char"], s["end_char"], "section" if s["role"] == "heading" else s["role"], s["span_id"], None))
    out, at = [], 0
    for block in sorted(found, key=lambda b: b[:3]):
        if block[0] < at:
            raise ValueError("blocks overlap")
        if block[0] > at:
            if out and text[at : block[0]].isspace():
                out[-1] = (out[-1][0], block[0], *out[-1][2:])
            else:
                out.append((at, block[0], "mixed", None, None))
        out.append(block)
        at = block[1]
    if at < len(text):
        out.append((at, len(text), "mixed", None, None))
    return [b for b in out if b[1] > b[0]]


def _cut(text: str, tokens: _Tokens, block: tuple, window: int) -> list[tuple]:
    """An oversized text block by sentences; a sentence over the window by its largest prefixes."""
    a, b, kind, span, _ = block
    ids = [span] if span else []
    ends = [a + m.end() for m in SENTENCE_END.finditer(text[a:b])]
    if not ends or ends[-1] != b:
        ends.append(b)
    out, start, done = [], a, a
    for end in ends:
        if tokens.count(done, end) > window or len(ends) == 1:
            if done > start:
                out.append((start, done, kind, ids, [], "boundary"))
            while done < end:
                cut = tokens.fit(done, window, end)
                out.append((done, cut, "overflow", ids, [], "oversized_sentence"))
                done = cut
            start = end
        elif tokens.count(start, end) > window and done > start:
            out.append((start, done, kind, ids, [], "boundary"))
            start = done
        done = end
    if done > start:
        out.append((start, done, kind, ids, [], "boundary"))
    return out


def pack_blocks(text: str, layout: list[dict], tables: list[dict], window: int, whole_tables: bool = True) -> list[tuple]:
    """(start, end, kind, span ids, table ids, split reason) of each chunk, in order: a table stands
    alone, a heading opens a chunk, others fill one until the next would pass the window."""
    blocks = blocks_of(text, layout, tables)
    if not blocks:
        return [(0, len(text), "document", [], [], "boundary")]
    tokens, out, now = _Tokens(text), [], []

    def flush():
        if now:
            kinds = {b[2] for b in now} - {"mixed"}
            kind = "section" if "section" in kinds else kinds.pop() if len(kinds) == 1 else "mixed"
            out.append((now[0][0], now[-1][1], kind, [b[3] for b in now if b[3]], [], "boundary"))
            now.clear()

    for block in blocks:
        a, b, kind, _, table = block
        size = tokens.count(a, b)
        if kind == "table":
            flush()
            if size > window and not whole_tables:
                raise ValueError("a table exceeds the window")
            out.append((a, b, "table", [], [table], "atomic_table_overflow" if size > window else "boundary"))
            continue
        if kind == "section":
            flush()
        if size > window:
            flush()
            out += _cut(text, tokens, block, window)
            continue
        if now and tokens.count(now[0][0], b) > window:
            flush()
        now.append(block)
    flush()
    return out


#: Chunks that are held as Python objects before they are handed on.
FEW = 1024
PACKED = (
    "doc_id bigint, chunk_index bigint, kind string, split_reason string, start_char bigint, end_char bigint, start_byte bigint, end_byte bigint, "
    "tokens bigint, layout_span_ids array<string>, table_ids array<string>, pages array<bigint>, section string, section_id string, error string"
)


def packed_chunks(docs: DataFrame, window: int = 1200, whole_tables: bool = True) -> DataFrame:
    """Boundary-aware chunks of documents with a layout, with pages, byte offsets, and the last
    heading's text and span id carried forward. A document that cannot be packed gives an error row."""

    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PACKED.split(", ")])

    def packed_rows(doc, text, layout, tables, pages):
        try:
            packed = pack_blocks(text, layout, tables, window, whole_tables)
        except ValueError as e:
            return [(doc, 0, *[None] * 12, str(e))]
        heads = {s["span_id"]: text[s["start_char"] : s["end_char"]].strip() for s in layout if s["role"] == "heading"}
        out, tokens, char, byte, section, section_id = [], _Tokens(text), 0, 0, None, None
        for k, (a, b, kind, spans, ids, why) in enumerate(packed):
            byte += len(text[char:a].encode())
            end = byte + len(text[a:b].encode())
            opens = next((s for s in spans if s in heads), None)
            if kind == "section" and opens:
                section, section_id = heads[opens], opens
            on = [p["page_number"] for p in pages if a < p["end_char"] and b > p["start_char"]]
            out.append((doc, k, kind, why, a, b, byte, end, tokens.count(a, b), spans, ids, on, section, section_id, None))
            char, byte = b, end
        return out

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        # A batch holds thousands of documents; only one of them is Python objects at a time.
        for batch in batches:
            cols, rows = [batch.column(n) for n in ("doc_id", "text", "layout", "tables", "page_map")], []
            for i in range(batch.num_rows):
                rows += packed_rows(*[c[i].as_py() for c in cols])
                if len(rows) >= FEW:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    made = docs.where("text <> ''").select("doc_id", "text", "layout", "tables", "page_map").mapInArrow(run, PACKED)
    return made.withColumn("chunk_id", stable_id("chunk-", F.col("doc_id"), F.col("chunk_index"), F.col("start_byte"), F.col("end_byte")))


def line_layout(docs: DataFrame, heading_words: int = 8) -> DataFrame:
    """A layout for plain texts, by lines: short lines are headings, lines that begin with a dash,
    star or number are list items, lines with two bars or more are tables, others paragraphs.
    The page map is one page; empty lines have no span."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)

    def spans(ls: Column) -> Column:
        def with_chars(cs: Column) -> Column:
            def with_bytes(bs: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    c, b = F.get(cs, i), F.get(bs, i)
                    role = F.when(F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2, "table").when(x.rlike("^(?:[-*]|[0-9]+[.)]) "), "list_item")
                    role = role.when(F.size(F.split(x, " ")) <= heading_words, "heading").otherwise("paragraph")
                    return F.struct(
                        F.concat(F.lit("line:"), i.cast("string")).alias("span_id"), role.alias("role"), F.lit(1).cast("long").alias("page_number"),
                        c.alias("start_char"), (c + F.length(x)).alias("end_char"), b.alias("start_byte"), (b + F.octet_length(x)).alias("end_byte"),
                    )

                return F.filter(F.transform(ls, one), lambda s: s["end_char"] > s["start_char"])

            return let(running_sums(F.transform(ls, lambda x: F.octet_length(x) + 1)), with_bytes)

        return let(running_sums(F.transform(ls, lambda x: F.length(x) + 1)), with_chars)

    every = docs.where(F.length(text) > 0).select("doc_id", text.alias("text"), let(lines, spans).alias("all"))
    table = F.transform(
        F.filter("all", lambda s: s["role"] == "table"),
        lambda s: F.struct(s["span_id"].alias("table_id"), s["page_number"], s["start_char"], s["end_char"], s["start_byte"], s["end_byte"]),
    )
    zero = F.lit(0).cast("long")
    page = F.array(F.struct(F.lit(1).cast("long").alias("page_number"), zero.alias("start_char"), F.length("text").cast("long").alias("end_char"), zero.alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte")))
    return every.select("doc_id", "text", page.alias("page_map"), F.filter("all", lambda s: s["role"] != "table").alias("layout"), table.alias("tables"))
