"""Ingestion and chunking of plain texts: identities, page maps, token windows, sections, sentences, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from ..functions.text import BLANKS, SPACE, stable_id

BLANK = "[ \\t\\n\\r\\f\\x0B]"
#: Tokens of the default tokenizer: a word with the blanks before it, or the blanks at the end.
#: Joined they are the text, and none splits a character.
TOKEN = f"{BLANK}*[^ \\t\\n\\r\\f\\x0B]+|{BLANK}+$"
WINDOW, OVERLAP = 1200, 120
MARK = "\u0001"


def identities(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.concat(F.lit("doc-"), F.substring(F.sha2(t, 256), 1, 32)).alias("doc_key"), F.sha2(t, 256).alias("text_sha256"),
        F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"),
    )


#: File suffixes and their formats.
FORMATS = {".txt": "plain_text", ".text": "plain_text", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html", ".eml": "email"}


def detect_format(paths: DataFrame, col: str) -> DataFrame:
    """Adds suffix, format and error: a path of unknown suffix has no format but an error, and is
    for the errors table."""
    suffix = F.regexp_extract(F.lower(F.col(col)), "([.][^./]+)$", 1)
    fmt = F.lit(None).cast("string")
    for k, v in FORMATS.items():
        fmt = F.when(suffix == k, v).otherwise(fmt)
    out = paths.withColumn("suffix", suffix).withColumn("format", fmt)
    return out.withColumn("error", F.when(F.col("format").isNull(), F.concat(F.lit("unsupported format: "), "suffix")))


def page_map(docs: DataFrame) -> DataFrame:
    """Plain text is one page and one identity source segment."""
    t = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    return docs.where(F.length(t) > 0).select(
        "doc_id", F.lit(1).cast("long").alias("page_number"), F.lit("source").alias("kind"), zero.alias("start_char"),
        F.length(t).cast("long").alias("end_char"), zero.alias("start_byte"), F.octet_length(t).cast("long").alias("end_byte"),
    )


def decode(files: DataFrame) -> DataFrame:
    """Rows of (path, content) to strict UTF-8 text, or an error."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string"))
    error = F.when(~good, "not UTF-8").when(F.trim(text) == "", "empty text")
    return files.select("path", text.alias("text"), F.sha2("content", 256).alias("source_sha256"), error.alias("error"))


def chunks(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token windows in closed form: starts are multiples of window - overlap. Nothing shuffles.

    A chunk's text is a slice of its document's, with token, character and byte offsets and an id
    of the document, its hash, the index and the byte and token ranges.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be less than the window")
    text, step = F.coalesce("text", F.lit("")), window - overlap

    def cut(tok: Column) -> Column:
        # Windows start where strides of tokens do, so offsets are sums over strides, not tokens.
        numbers = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(tok) - window, F.lit(0)) / F.lit(step)).cast("int"))
        strides = F.transform(numbers, lambda k: F.array_join(F.slice(tok, k * step + 1, F.lit(step)), ""))

        def placed(ss: Column) -> Column:
            chars, octets = running_sums(F.transform(ss, F.length)), running_sums(F.transform(ss, F.octet_length))

            def one(k: Column, cs: Column, bs: Column) -> Column:
                start, end = k * step, F.least(k * step + window, F.size(tok))
                body = F.array_join(F.slice(tok, start + 1, end - start), "")
                return F.struct(
                    k.cast("long").alias("chunk_index"), start.cast("long").alias("token_start"), end.cast("long").alias("token_end"),
                    F.get(cs, k).alias("start_char"), F.get(bs, k).alias("start_byte"), body.alias("text"),
                )

            return let(chars, lambda cs: let(octets, lambda bs: F.transform(numbers, lambda k: one(k, cs, bs))))

        return F.when(F.size(tok) > 0, let(strides, placed))

    each = F.explode(let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), cut)).alias("c")
    out = docs.select("doc_id", *keep, F.sha2(text, 256).alias("_hash"), each).select("doc_id", *keep, "_hash", "c.*")
    out = out.withColumn("end_char", F.col("start_char") + F.length("text")).withColumn("end_byte", F.col("start_byte") + F.octet_length("text"))
    parts = ("doc_id", "_hash", "chunk_index", "start_byte", "end_byte", "token_start", "token_end")
    return out.withColumn("chunk_id", stable_id("chunk-", *[F.col(c) for c in parts])).drop("_hash")


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def sections(docs: DataFrame, heading_words: int = 8) -> DataFrame:
    """Each line with the last short line at or before it: carry-forward inside the row.

    Headings cut the lines into stretches, and a stretch takes its heading's text.
    """
    ls = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def short(line: Column) -> Column:
        return (line != "") & (F.size(F.split(line, " ")) <= heading_words)

    def carried(xs: Column) -> Column:
        places = F.filter(F.transform(xs, lambda x, i: F.when(short(x), i)), lambda i: i.isNotNull())
        edges = F.array_distinct(F.concat(F.array(F.lit(0)), places, F.array(F.size(xs))))

        def stretch(es: Column) -> Column:
            return F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.size(es) - 2),
                    lambda k: let(
                        F.get(es, k),
                        lambda a: F.transform(
                            F.slice(xs, a + 1, F.get(es, k + 1) - a),
                            lambda x, j: F.struct((a + j).cast("long").alias("line_no"), x.alias("line"), F.when(short(F.get(xs, a)), F.get(xs, a)).alias("section")),
                        ),
                    ),
                )
            )

        return let(edges, stretch)

    each = docs.select("doc_id", F.explode(let(ls, carried)).alias("s")).where("s.line <> ''")
    return each.select("doc_id", "s.line_no", "s.section")


#: Words after which a full stop ends no sentence.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st")
#: A sentence ends at . ! or ? before white space or the end, unless a title or initials stand
#: before it or a small letter follows, and at a blank line. What stands before is looked at last.
TERMINAL = (
    f"(?U)([.!?])(?={SPACE}|\\z)(?!{SPACE}*\\p{{Ll}})(?<!(?:^|[ \\n])(?:{'|'.join(''.join(f'[{c.upper()}{c}]' for c in t) for t in TITLES)})[.!?])"
    "(?<![A-Z][.][A-Z][.!?])"
)


def sentence_pieces(text: Column) -> Column:
    """The text cut behind the ends of sentences and before blank lines: joined, they are the text."""
    plain = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\u0002")).otherwise(text)
    return F.split(F.replace(F.regexp_replace(plain, TERMINAL, f"$1{MARK}"), F.lit("\n\n"), F.lit(f"{MARK}\n\n")), MARK, -1)


def sentence_in(piece: Column, made) -> Column:
    """``made`` (the piece without white space before it, and at both ends) if the piece is a sentence, else
    null: headings and pieces without a letter or digit are none."""

    def bare(left: Column) -> Column:
        def kept(b: Column) -> Column:
            return F.when((b != "") & ~b.startswith("#") & b.rlike("[\\p{L}\\p{N}]"), made(left, b))

        return let(F.rtrim(left, F.lit(BLANKS)), kept)

    return let(F.ltrim(piece, F.lit(BLANKS)), bare)


def sentence_array(text: Column) -> Column:
    """array<struct<start_char, end_char>> of a text's sentences; the pieces' lengths give the offsets."""

    def spans(ps: Column) -> Column:
        def placed(at: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                def place(left: Column, bare: Column) -> Column:
                    start = F.get(at, i) + F.length(p) - F.length(left)
                    return F.struct(start.alias("start_char"), (start + F.length(bare)).alias("end_char"))

                return sentence_in(p, place)

            return F.array_compact(F.transform(ps, one))

        return let(running_sums(F.transform(ps, F.length)), placed)

    return let(sentence_pieces(text), spans)


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_index, start_char, end_char."""
    each = docs.select("doc_id", F.posexplode(sentence_array(F.coalesce("text", F.lit("")))).alias("i", "s"))
    return each.select("doc_id", F.col("i").cast("long").alias("sentence_index"), "s.start_char", "s.end_char")


def page_numbers(pages: Column, start: Column, end: Column) -> Column:
    """Numbers of the pages (structs with page_number, start_char, end_char) that a range overlaps."""
    return F.transform(F.filter(pages, lambda p: (start < p["end_char"]) & (end > p["start_char"])), lambda p: p["page_number"])


def paged(docs: DataFrame, page_chars: int = 1000) -> DataFrame:
    """Documents with a page map of equal pages, for texts that come without one."""
    n = F.length(F.coalesce("text", F.lit("")))
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / page_chars).cast("int")),
        lambda k: F.struct((k + 1).cast("long").alias("page_number"), (k * page_chars).cast("long").alias("start_char"), F.least((k + 1) * page_chars, n).cast("long").alias("end_char")),
    )
    return docs.where(n > 0).withColumn("page_map", pages)


def overlapping_pages(docs: DataFrame, span_chars: int = 700) -> DataFrame:
    """The pages that every span of a fixed length overlaps; ``docs`` has a page_map."""
    n = F.length("text")
    span = docs.select("doc_id", "page_map", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / span_chars).cast("int"))).alias("k"))
    start, end = F.col("k") * span_chars, F.least((F.col("k") + 1) * span_chars, F.col("n"))
    numbers = F.transform(page_numbers(F.col("page_map"), start, end), lambda p: p.cast("string"))
    return span.select("doc_id", F.col("k").cast("long").alias("span_index"), F.array_join(numbers, ",").alias("pages"))
