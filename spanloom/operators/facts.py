"""Facts: rule lenses over whole texts or chunks, deduplication, conflicts, cross-document groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import running_sums_sql
from ..functions.text import canonical_key, span_matches, stable_id

MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)[.]?"
CLOCK = "(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?"
DATE = (
    "[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
    "|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}"
    f"|{MONTH} [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} {MONTH} [0-9]{{4}}|{MONTH} [0-9]{{4}}|{MONTH} [0-9]{{1,2}}"
)
#: Dates (with a time behind a T), clock times, quarters and fiscal periods, and durations.
TIME = (
    f"\\b(?:(?:{DATE})(?:T{CLOCK}Z?)?|{CLOCK}(?: ?[AaPp][Mm])?"
    "|[Qq][1-4](?: [0-9]{4})?|(?:[Ff]irst|[Ss]econd|[Tt]hird|[Ff]ourth) quarter(?: of [0-9]{4})?"
    f"|[Ff]iscal (?:year|quarter)(?: ended (?:{DATE})| [0-9]{{4}})"
    "|[0-9]+[ -](?:(?:business|working|calendar) )?(?:second|minute|hour|day|week|month|quarter|year)s?)\\b"
)
REFERENCE = (
    "(?:\\b(?:Sections?|Sec[.]|Exhibits?|Tables?|Figures?|Fig[.]|Articles?|Appendix|Annex|Schedule|Chapters?|Clauses?|Paragraphs?|Parts?|Items?|Rules?|Notes?) (?:[0-9]+[A-Za-z]?|[IVXLC]+|[A-Z])\\b"
    "|\\b(?:ISO|IEC|RFC|IEEE|EN|DIN|ANSI|NIST|ASTM)(?:[/ -][A-Z]{2,4})?[ -][0-9]+|§§? ?[0-9]+)(?:[.-][0-9A-Za-z]+)*(?:\\([0-9A-Za-z]+\\))*"
)

MEANS = "(?:means|shall mean|(?:is|are) defined as|refers? to)"
EVENT = "(?:acquired|announced|appointed|approved|began|closed|commenced|completed|launched|merged|opened|resigned|retired|signed|started|terminated)"
CLAIM = "(?:concluded|expects?|found|indicated?|may|must|reported|requires?|shall|should|shows?|showed)"

#: Rule lenses: (lens, category, field, pattern). No look-around, so any engine can check them. A
#: fifth entry is a quicker pattern without which the lens cannot match.
LENSES = (
    ("number", "Quantity", "number", "[0-9]+(?:[.,][0-9]+)*", "[0-9]"),
    ("citation", "Reference", "license_version", "[Vv]ersion [0-9]+(?:[.][0-9]+)*"),
    ("citation", "Reference", "reference", REFERENCE, "[0-9§ ](?:(?<=[0-9§])|(?<=(?:[a-z]|Sec[.]|Fig[.]) )[A-Z])"),
    ("entity", "Identifier", "email", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+[a-z]", "@"),
    ("entity", "Entity", "name", "[A-Z][a-z]{9,}"),
    ("temporal", "Time", "clock", TIME, "[0-9q](?:(?<=[0-9])|uarter)"),
    ("quantity_with_unit", "Quantity", "with_unit", "[0-9]+ [a-z]{3,}"),
    ("definition", "Definition", "meaning", f"(?:\"[^\"\n]+\"|\\b[A-Z][A-Za-z]+) {MEANS} [^.;\n]+", MEANS),
    ("event", "Event", "summary", f"\\b[A-Z][^.!?\n]*\\b{EVENT}\\b[^.!?\n]*[.!?]", f"\\b{EVENT}\\b"),
    ("claim", "Claim", "statement", f"\\b[A-Z][^.!?\n]*\\b{CLAIM}\\b[^.!?\n]*[.!?]", f"\\b{CLAIM}\\b"),
)
#: Every lens by name with the kinds of value it may give. The last four read sentences: see clauses.py.
REGISTRY = (
    ("entity", "string,identifier", True), ("event", "string,label", True), ("claim", "string", True), ("number", "number", True),
    ("definition", "string", True), ("citation", "reference", True), ("temporal", "date,duration", True), ("quantity_with_unit", "quantity", True),
    ("relation", "string", True), ("obligation", "string", True), ("condition", "string", True), ("exception", "string", True),
)
MARK = "\u0001"
#: How the patterns begin whose matches are whole stretches.
STRETCH = "\\b[A-Z][^.!?\n]*"


def lens_registry(spark) -> DataFrame:
    """lens, value_kinds, executable."""
    return spark.createDataFrame(list(REGISTRY), "lens string, value_kinds string, executable boolean")


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stretches(text: str, word: str) -> str:
    """As :func:`_pieces` for the lenses that take a stretch between sentence ends from its first capital
    to its end mark, if a word follows that capital. Searched as one pattern, every capital of a long
    stretch would read it to its end. Here each stretch is read a few times, however long it is.

    A stretch without a match gives an empty one.
    """
    at = "regexp_instr(s, '\\\\b[A-Z]')"
    tail = f"substring(s, {at})"
    hit = f"{at} > 0 AND rlike(s, '[.!?]$') AND rlike({tail}, {_literal(f'^[A-Z][^.!?' + chr(10) + f']*{word}')})"
    pair = f"CASE WHEN {hit} THEN array(substring(s, 1, {at} - 1), {tail}) ELSE array(s, '') END"
    return f"flatten(transform(split({text}, {_literal('(?<=[.!?' + chr(10) + '])')}, -1), s -> {pair}))"


def _pieces(text: str, pattern: str) -> str:
    """The text cut into gap, match, gap, match and so on: joined, they are the text again.

    One pass marks the matches and cuts there. A text that holds the mark itself is cut by
    extracting and splitting, two passes.
    """
    p, mark = _literal(pattern), _literal(MARK)
    fast = f"split(regexp_replace({text}, {_literal(f'({pattern})')}, {_literal(f'{MARK}$1{MARK}')}), {mark}, -1)"
    slow = f"flatten(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> array(g, coalesce(m, ''))))"
    return f"CASE WHEN contains({text}, {mark}) THEN {slow} ELSE {fast} END"


FOUND = "array<struct<lens:string,category:string,field:string,ordinal:bigint,value:string,start_char:bigint,start_byte:bigint>>"


def _found(text: str, lens: tuple) -> str:
    """All matches of a lens with their offsets, summed inside the row, as SQL text."""
    name, category, field, pattern = lens[:4]
    one = f"""named_struct('lens', {_literal(name)}, 'category', {_literal(category)}, 'field', {_literal(field)}, 'ordinal', cast(k as bigint),
        'value', get(ps, 2 * k + 1), 'start_char', get(cs, 2 * k + 1), 'start_byte', get(bs, 2 * k + 1))"""
    each = f"transform(sequence(0, cast(floor((size(ps) - 2) / 2) as int)), k -> {one})"
    with_bytes = f"transform(array({running_sums_sql('transform(ps, p -> octet_length(p))')}), bs -> filter({each}, m -> m.value <> ''))[0]"
    with_chars = f"transform(array({running_sums_sql('transform(ps, p -> length(p))')}), cs -> {with_bytes})[0]"
    cut = _stretches(text, lens[4]) if pattern.startswith(STRETCH) else _pieces(text, pattern)
    placed = f"transform(array({cut}), ps -> CASE WHEN size(ps) >= 2 THEN {with_chars} END)[0]"
    if pattern.startswith(STRETCH):
        # Matches are numbered without the empty ones.
        fields = ", ".join(f"'{f}', {'cast(k as bigint)' if f == 'ordinal' else f'm.{f}'}" for f in ("lens", "category", "field", "ordinal", "value", "start_char", "start_byte"))
        placed = f"transform({placed}, (m, k) -> named_struct({fields}))"
    # Most texts have no match of most lenses: they are passed over by one search.
    return f"coalesce(CASE WHEN rlike({text}, {_literal(lens[-1])}) THEN {placed} END, cast(array() as {FOUND}))"


def matches(text: str, lenses) -> str:
    """All matches of the lenses in a text, one array, as SQL text."""
    return f"concat({', '.join(_found(text, x) for x in lenses)})"


def propose(docs: DataFrame, lenses=LENSES, confidence: float | Column = 1.0) -> DataFrame:
    """Candidates of every lens with exact character and byte spans.

    ``docs`` has doc_id, text and source, and may have chunk_id, start_char and start_byte: then
    rows are chunks, and offsets count from their document's start. One scan, no shuffle: offsets
    are summed inside the row, so rows of one id do not mix: ``text_key``, a hash of the row's text,
    tells them apart later. ``confidence`` is what the caller gives these lenses. Null texts have no
    candidates. Repeated rows give repeated candidates, of equal ids.
    """
    chunked = "chunk_id" in docs.columns
    zero = F.lit(0).cast("long")
    # SQL text: as columns, call by call, so wide an expression takes a second to build.
    found = F.expr(matches("coalesce(text, '')", lenses))
    at = (F.col("start_char"), F.col("start_byte")) if chunked else (zero, zero)
    keep = ["chunk_id"] if chunked else []
    rows = docs.select("doc_id", "source", *keep, text_key().alias("text_key"), at[0].alias("_c"), at[1].alias("_b"), F.explode(found).alias("m"))
    rows = rows.select(
        "doc_id", "source", *keep, "text_key", "m.lens", "m.category", "m.field", "m.ordinal", "m.value",
        (F.col("_c") + F.col("m.start_char")).alias("start_char"), (F.col("_c") + F.col("m.start_char") + F.length("m.value")).alias("end_char"),
        (F.col("_b") + F.col("m.start_byte")).alias("start_byte"), (F.col("_b") + F.col("m.start_byte") + F.octet_length("m.value")).alias("end_byte"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
    )
    parts = ("doc_id", *keep, "lens", "category", "field", "value", "start_char")
    return rows.withColumn("candidate_id", stable_id("cand-", *[F.col(c) for c in parts]))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def with_texts(facts: DataFrame, docs: DataFrame, name: str = "text", how: str = "inner") -> DataFrame:
    """Facts with the text they were found in, under ``name``: by document and text_key, so unlike texts
    of one id do not mix and repeated rows of a document are one. Facts of another maker, without the
    column, meet every unlike text of their document."""
    by = ["doc_id", "text_key"] if "text_key" in facts.columns else ["doc_id"]
    texts = docs.select("doc_id", text_key().alias("text_key"), F.col("text").alias(name)).dropDuplicates(["doc_id", "text_key"])
    return facts.join(texts if "text_key" in by else texts.drop("text_key"), by, how)


def span_check(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Every fact with whether its two slices equal its quoted value."""
    joined = with_texts(facts, docs)
    ok = span_matches(F.col("text"), F.col("value"), F.col("start_char"), F.col("end_char"), F.col("start_byte"), F.col("end_byte"))
    return joined.select("candidate_id", "doc_id", "lens", "ordinal", ok.alias("span_ok"))


def keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("key", canonical_key(F.col("value")))


KEY = ("doc_id", "lens", "category", "field", "key")
#: With the source span, which tells verbatim candidates apart; -1 for canonicalized ones.
PLACE = (*KEY, "at_start", "at_end")


def placed(facts: DataFrame) -> DataFrame:
    """Facts with the columns of PLACE. All are verbatim unless a column ``status`` says canonicalized."""
    free = F.coalesce(F.col("status") == "canonicalized", F.lit(False)) if "status" in facts.columns else F.lit(False)
    at = lambda c: F.when(free, F.lit(-1)).otherwise(F.col(c)).cast("long")
    return keyed(facts).withColumn("at_start", at("start_char")).withColumn("at_end", at("end_char"))


def dedup(facts: DataFrame) -> DataFrame:
    """Each candidate with the smallest id of its (document, lens, field, key, span) as primary; one shuffle."""
    return placed(facts).withColumn("primary_id", F.min("candidate_id").over(W.partitionBy(*PLACE)))


def survivors(facts: DataFrame) -> DataFrame:
    return dedup(facts).where("candidate_id = primary_id").select("candidate_id", *KEY)


def rejections(facts: DataFrame) -> DataFrame:
    d = dedup(facts).where("candidate_id <> primary_id")
    rid = stable_id("rej-", F.col("candidate_id"), F.col("primary_id"), F.lit("duplicate_candidate"))
    return d.select(rid.alias("rejection_id"), "candidate_id", "primary_id", F.concat(F.lit("merged_into:"), F.col("primary_id")).alias("message"))


def clusters(facts: DataFrame) -> DataFrame:
    """Groups of two or more: members, distinct spans (with the chunk), primary, and the merged ids."""
    span = ["chunk_id"] if "chunk_id" in facts.columns else []
    g = placed(facts).groupBy(*PLACE).agg(
        F.count("*").alias("members"), F.count_distinct(*span, "start_char", "end_char").alias("spans"), F.min("candidate_id").alias("primary_id"),
        F.array_join(F.array_sort(F.collect_list("candidate_id")), ",").alias("all_ids"),
    )
    return g.where("members >= 2").select(*KEY, "members", "spans", "primary_id", "all_ids")


def field_conflicts(facts: DataFrame) -> DataFrame:
    """(document, category, field) with two or more distinct keys; the id names the sorted keys.

    With a column ``status``, only canonicalized facts can conflict.
    """
    k = keyed(facts)
    if "status" in facts.columns:
        k = k.where(F.col("status") == "canonicalized")
    # Keys are made distinct before they are collected: a field of one document, not of all.
    g = k.groupBy("doc_id", "category", "field", "key").agg(F.count("*").alias("n")).groupBy("doc_id", "category", "field")
    g = g.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_facts"), F.array_join(F.array_sort(F.collect_list("key")), "\n").alias("keys"))
    return g.where("n_keys >= 2").withColumn("conflict_id", stable_id("conf-", F.col("doc_id"), F.col("category"), F.col("field"), F.col("keys"))).drop("keys")


def crossdoc_groups(facts: DataFrame, least_docs: int = 2) -> DataFrame:
    """Equal facts across documents, of one schema where the column ``schema`` names it.

    Counts combine before the shuffle; no list per group.
    """
    by = [*(["schema"] if "schema" in facts.columns else []), "category", "field", "key"]
    g = keyed(facts).groupBy(*by).agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_facts"), F.min("candidate_id").alias("first_id"))
    return g.where(F.col("n_docs") >= least_docs).withColumn("group_id", stable_id("xdg-", *[F.col(c) for c in by]))


def crossdoc_conflicts(facts: DataFrame) -> DataFrame:
    by = [*(["schema"] if "schema" in facts.columns else []), "category", "field"]
    g = crossdoc_groups(facts).groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum("n_facts").alias("n_facts"))
    return g.where("n_groups > 1").withColumn("conflict_id", stable_id("xdc-", *[F.col(c) for c in by]))


def crossdoc_inputs(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Every fact with the first failing precondition of its document's run, null where it is kept.

    ``runs`` has doc_id, completed, has_document and has_schema, one row a document.
    """
    reason = (
        F.when(F.col("completed").isNull(), "missing_manifest").when(~F.col("completed"), "run_not_completed")
        .when(~F.col("has_document"), "document_missing").when(~F.col("has_schema"), "schema_missing")
    )
    return facts.join(runs, "doc_id", "left").select("candidate_id", "doc_id", reason.alias("reason"))


def crossdoc_skipped(facts: DataFrame, runs: DataFrame) -> DataFrame:
    return crossdoc_inputs(facts, runs).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def review_batches(facts: DataFrame, size: int = 20) -> DataFrame:
    """Contiguous batches of each chunk's candidates in (lens, field, ordinal) order."""
    of = ["doc_id", "chunk_id"] if "chunk_id" in facts.columns else ["doc_id"]
    w = W.partitionBy(*of).orderBy("lens", "field", "ordinal")
    return facts.select("candidate_id", *of, F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("batch"))


def context(facts: DataFrame, docs: DataFrame, radius: int = 30) -> DataFrame:
    """Prefix, highlight and suffix; status matched, mismatched, or unavailable without a text."""
    j = with_texts(facts, docs, how="left")
    cut = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    status = F.when(F.col("text").isNull(), "unavailable").when(cut == F.col("value"), "matched").otherwise("mismatched")
    return j.select(
        "candidate_id", "doc_id", "lens", "ordinal", status.alias("status"),
        F.substring("text", F.greatest(F.col("start_char") - radius, F.lit(0)) + 1, F.least(F.lit(radius), F.col("start_char"))).alias("prefix"),
        cut.alias("highlight"),
        F.substring("text", F.col("end_char") + 1, F.lit(radius)).alias("suffix"),
    )
