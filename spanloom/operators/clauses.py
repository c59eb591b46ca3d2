"""Lenses over sentences: relations, obligations, conditions, exceptions.

Cues and entities are found by the rule lenses' patterns inside each sentence, in the document's row: no
text is shuffled. No pattern crosses white space behind . ! ? or a blank line, so what is found in a text
and lies in a sentence is what is found in the sentence. Values are slices of it, verbatim, with exact spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from ..functions.text import slice_chars, stable_id
from .documents import sentence_in, sentence_pieces
from .facts import LENSES, matches, text_key

#: Cues by lens: (lens, category, field, pattern), as the rule lenses.
CUES = (
    ("obligation", "Obligation", "duty", "\\b(?:shall|must|(?:is|are) (?:required|obliged) to|agrees? to|undertakes? to)\\b"),
    ("condition", "Condition", "condition", "\\b(?:[Ii]f|[Uu]nless|[Pp]rovided that|[Ss]ubject to|[Ii]n the event (?:of|that))\\b"),
    ("exception", "Exception", "exception", "\\b(?:[Ee]xcept(?: for| that)?|[Ee]xcluding|[Oo]ther than|[Nn]otwithstanding|[Ss]ave for)\\b"),
)
#: Most characters between two related entities, one of them a letter of a word.
REACH = 80
KEY = ["doc_id", "text_key"]


def found(docs: DataFrame, lenses) -> DataFrame:
    """One row a sentence that holds a match: doc_id, source, text_key, sentence, its outer_start and
    outer_byte, and ``before`` (matches of the first lens in earlier pieces, sentences or not). Rows without
    id have none."""
    text = F.coalesce("text", F.lit(""))
    hit = "|".join(f"(?:{x[-1]})" for x in lenses)

    def placed(ps: Column) -> Column:
        counts = F.transform(ps, lambda p: F.regexp_count(p, F.lit(lenses[0][3])))
        sums = [running_sums(x) for x in (F.transform(ps, F.length), F.transform(ps, F.octet_length), counts)]

        def each(cs: Column, bs: Column, ns: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                def sentence(left: Column, bare: Column) -> Column:
                    at = F.get(cs, i) + F.length(p) - F.length(left)
                    return F.struct(bare.alias("sentence"), at.alias("outer_start"), (F.get(bs, i) + F.octet_length(p) - F.octet_length(left)).alias("outer_byte"), F.get(ns, i).alias("before"))

                return F.when(p.rlike(hit), sentence_in(p, sentence))

            return F.array_compact(F.transform(ps, one))

        return let(sums[0], lambda cs: let(sums[1], lambda bs: let(sums[2], lambda ns: each(cs, bs, ns))))

    rows = docs.where(F.col("doc_id").isNotNull() & text.rlike(hit))
    rows = rows.select("doc_id", "source", text_key().alias("text_key"), F.explode(let(sentence_pieces(text), placed)).alias("s"))
    return rows.select("doc_id", "source", "text_key", "s.*")


def _facts(rows: DataFrame, lens: str, category: str, field: str, start: Column, start_byte: Column, value: Column) -> DataFrame:
    out = rows.select(
        "doc_id", "source", F.lit(lens).alias("lens"), F.lit(category).alias("category"), F.lit(field).alias("field"), "ordinal", value.alias("value"),
        start.cast("long").alias("start_char"), start_byte.cast("long").alias("start_byte"), F.lit(1.0).alias("confidence"),
    )
    out = out.withColumn("end_char", F.col("start_char") + F.length("value")).withColumn("end_byte", F.col("start_byte") + F.octet_length("value"))
    return out.withColumn("candidate_id", stable_id("cand-", *[F.col(c) for c in ("doc_id", "lens", "category", "field", "value", "start_char")]))


def clauses(docs: DataFrame, lens: str, cues=CUES) -> DataFrame:
    """Obligations: the clause around a cue, from the last comma or semicolon before it to the next
    semicolon. Conditions and exceptions: from the cue to the next comma or semicolon. All end with
    the sentence at the latest. A cue outside any sentence (in a heading) gives nothing.

    Rows of one id and unlike texts do not mix; repeated rows give what one gives, once.
    """
    cue = next(c for c in cues if c[0] == lens)
    at = found(docs, [cue]).select("*", F.explode(F.expr(matches("sentence", [cue]))).alias("m")).select(
        "doc_id", "source", "text_key", "sentence", "outer_start", (F.col("before") + F.col("m.ordinal")).alias("ordinal"), F.col("m.value").alias("value"),
        (F.col("outer_start") + F.col("m.start_char")).alias("start_char"), (F.col("outer_byte") + F.col("m.start_byte")).alias("start_byte"),
    ).withColumn("end_char", F.col("start_char") + F.length("value"))
    head = F.substring("sentence", F.lit(1), (F.col("start_char") - F.col("outer_start")).cast("int"))
    rest = F.expr("substring(sentence, cast(end_char - outer_start + 1 as int))")
    if lens == "obligation":
        before = F.regexp_replace(F.regexp_extract(head, "([^,;]*)$", 1), "^\\s+", "")
        value = F.concat(before, F.col("value"), F.regexp_extract(rest, "^[^;]*", 0))
    else:
        before, value = F.lit(""), F.concat("value", F.regexp_extract(rest, "^[^,;]*", 0))
    at = at.select("doc_id", "source", "text_key", "ordinal", (F.col("start_char") - F.length(before)).alias("start_char"), (F.col("start_byte") - F.octet_length(before)).alias("start_byte"), value.alias("value"))
    at = at.dropDuplicates([*KEY, "ordinal"])
    return _facts(at, *cue[:3], F.col("start_char"), F.col("start_byte"), F.col("value"))


def relations(docs: DataFrame, lenses=None, reach: int = REACH) -> DataFrame:
    """Two entities that follow one another in a sentence with words between them, as one span from the
    first's start to the second's end. Neighbours only: a sentence of n entities has n - 1 pairs at most.

    Rows of one id and unlike texts do not mix; repeated rows give what one gives, once.
    """
    # Where two entities share a start the longer stands first; a sentence's entities are ordered in its row.
    entity = lambda m: F.struct(m["start_char"].alias("start_char"), (-m["start_char"] - F.length(m["value"])).alias("less"), m["field"].alias("field"), m["start_byte"].alias("start_byte"))
    lenses = lenses or [x for x in LENSES if x[0] == "entity"]
    part = lambda xs, k: F.slice(xs, F.lit(k), F.greatest(F.size(xs) - 1, F.lit(0)))
    both = lambda xs: F.zip_with(part(xs, 1), part(xs, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.explode(let(F.array_sort(F.transform(F.expr(matches("sentence", lenses)), entity)), both))
    rows = found(docs, lenses).select("*", pairs.alias("x")).where("-x.a.less <= x.b.start_char")
    gap = slice_chars(F.col("sentence"), -F.col("x.a.less"), F.col("x.b.start_char"))
    pairs = rows.where((F.length(gap) <= reach) & gap.rlike("[a-z]"))
    pairs = pairs.select(
        "doc_id", "source", "text_key", slice_chars(F.col("sentence"), F.col("x.a.start_char"), -F.col("x.b.less")).alias("value"),
        (F.col("outer_start") + F.col("x.a.start_char")).alias("start_char"), (F.col("outer_byte") + F.col("x.a.start_byte")).alias("start_byte"),
        (F.col("outer_start") + F.col("x.b.start_char")).alias("second"), (F.col("x.b.less") - F.col("outer_start")).alias("less"), F.col("x.b.field").alias("second_field"),
    ).dropDuplicates([*KEY, "second", "less", "second_field"])
    order = W.partitionBy(*KEY).orderBy("second", "less", "second_field")
    pairs = pairs.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    return _facts(pairs, "relation", "Relation", "related", F.col("start_char"), F.col("start_byte"), F.col("value"))
