"""Mechanical checks and what they make of verdicts: rejection reasons, corrections, reports.

Candidates have candidate_id, doc_id, chunk_id, category, field, value, source_text and the four
span offsets. :func:`checked` joins their chunk and the approved fields once; all else are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import QUALIFIERS, folded, is_label_field, slice_chars, spaced, span_matches, stable_id, tokens, value_supported

#: Every code a rejection can have. The last two mark verdicts that never came.
CODES = (
    "invalid_source_offsets", "invented_span", "category_not_approved", "critic_rejected", "verifier_rejected", "reconciler_rejected",
    "schema_violation", "ambiguous_source_span", "duplicate_candidate", "critic_missing_report", "verifier_missing_report",
)
#: Words of a field's name that make its value stand alone, and words of objections.
ATOMIC = ("amount", "count", "date", "deadline", "duration", "number", "pct", "percent", "percentage", "period", "quantity", "rate", "ratio", "term", "time", "total", "value", "year")
CONTEXT = ("alone", "ambiguous", "anchor", "anchored", "context", "specific", "vague")
COMPANION = ("category", "companion", "entry", "field", "record", "without")
LOSABLE = (*QUALIFIERS, "subject to")
SPAN_CODES = ("invalid_source_offsets", "invented_span", "ambiguous_source_span")


def approved(candidates: DataFrame, plan_fields: DataFrame) -> DataFrame:
    """Adds category_ok and field_ok. ``plan_fields`` (category, field, ...) is a plan's few rows."""
    cats = plan_fields.select("category").distinct().withColumn("category_ok", F.lit(True))
    fields = plan_fields.select("category", "field").distinct().withColumn("field_ok", F.lit(True))
    out = candidates.join(F.broadcast(cats), "category", "left").join(F.broadcast(fields), ["category", "field"], "left")
    return out.withColumn("category_ok", F.coalesce("category_ok", F.lit(False))).withColumn("field_ok", F.coalesce("field_ok", F.lit(False)))


def checked(candidates: DataFrame, chunks: DataFrame, plan_fields: DataFrame) -> DataFrame:
    """Adds the chunk (null where there is none), category_ok, field_ok, span_ok, supported and valid.

    A chunk's id names its document, text and place, and a candidate's its chunk and span: rows that
    share one are one. So a table that holds a document twice gives the reports of one, and each
    candidate gets one report. Both are made distinct by chunk, which is one shuffle for the join, too:
    candidates before they meet the text, so no sort carries it.
    """
    own = candidates.repartition("chunk_id").dropDuplicates(["chunk_id", "candidate_id"])
    c = chunks.select("chunk_id", F.col("text").alias("chunk_text"), F.col("start_char").alias("chunk_start"), F.col("start_byte").alias("chunk_byte"))
    return with_checks(approved(own, plan_fields).join(c.dropDuplicates(["chunk_id"]), "chunk_id", "left"))


def with_checks(j: DataFrame) -> DataFrame:
    span = span_matches(F.col("chunk_text"), F.col("source_text"), F.col("start_char"), F.col("end_char"), F.col("start_byte"), F.col("end_byte"), F.col("chunk_start"), F.col("chunk_byte"))
    j = j.withColumn("span_ok", F.coalesce(span, F.lit(False))).withColumn("supported", F.coalesce(value_supported(F.col("value"), F.col("source_text")), F.lit(False)))
    return j.withColumn("valid", F.col("field_ok") & F.col("span_ok") & F.col("supported"))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in this order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs])))


def schema_reason() -> list[tuple[Column, str]]:
    return [(~F.col("category_ok"), "category_not_approved"), (F.col("category_ok") & ~F.col("field_ok"), "schema_violation")]


def executor_reasons() -> Column:
    """Category approved? Else field approved? And does the span match?"""
    return reasons(*schema_reason(), (~F.col("span_ok"), "invented_span"))


def verifier_reasons() -> Column:
    """As for the executor, and a value, but for labels, must be grounded in a span that matches."""
    loose = F.col("span_ok") & ~is_label_field(F.col("field")) & ~F.col("supported")
    return reasons(*schema_reason(), (~F.col("span_ok") | loose, "invented_span"))


def _any(words: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in of]))


def critic_contradicted(code: Column, evidence: Column, asset_role: Column | None = None) -> Column:
    """Whether the mechanical checks make a reject verdict false.

    Four cases: the category is approved after all; the offsets match after all; a valid asset detail
    of a role whose description allows source-backed details; a valid value that stands alone, and an
    objection to missing context and companions only.
    """
    words = tokens(F.coalesce(evidence, F.lit("")))
    alone = _any(tokens(F.replace(F.col("field"), F.lit("_"), F.lit(" "))), ATOMIC) & _any(words, CONTEXT) & _any(words, COMPANION)
    asset = (F.col("category") == "CorporateEvent") & (F.col("field") == "asset_detail") & (asset_role if asset_role is not None else F.lit(False))
    out = ((code == "category_not_approved") & F.col("field_ok")) | ((code == "invalid_source_offsets") & F.col("span_ok"))
    out = out | (code.isin("critic_rejected", "schema_violation", "invented_span") & F.col("valid") & asset)
    out = out | (code.isin("critic_rejected", "schema_violation") & F.col("valid") & alone)
    return F.coalesce(out, F.lit(False))


def verifier_contradicted(code: Column) -> Column:
    """The verifier's table: offsets by the span, invention by span and support, category by the
    schema, schema by all three."""
    out = (
        F.when(code.isin("invalid_source_offsets", "ambiguous_source_span"), F.col("span_ok"))
        .when(code == "invented_span", F.col("span_ok") & F.col("supported"))
        .when(code == "category_not_approved", F.col("field_ok"))
        .when(code == "schema_violation", F.col("field_ok") & F.col("span_ok") & F.col("supported"))
    )
    return F.coalesce(out, F.lit(False))


def asset_role(description: Column) -> Column:
    d = F.lower(description)
    has = lambda *words: d.rlike("|".join(words))
    return has("detail", "description", "attribute", "profile") & has("source-backed", "source-stated", "stated", "verbatim")


# Verdicts


def decode_verdicts(replies: DataFrame, col: str = "payload", default_code: str | None = None, corrections: bool = True, most_evidence: int = 200) -> DataFrame:
    """Compact arrays ``[id, decision, code, evidence, correction]`` or objects to one shape.

    Decisions are a, r, c or their words in any case. Evidence over ``most_evidence`` characters is
    dropped, so is a correction beside another decision; a reject without code takes the default.
    What is no verdict gets an error.
    """
    got = F.try_parse_json(F.col(col))
    # A JSON string may hold the JSON once more.
    inner = F.try_variant_get(got, "$", "string")
    got = F.when(F.schema_of_variant(got) == "STRING", F.try_parse_json(inner)).otherwise(got)
    kind = F.schema_of_variant(got)
    listed = kind.startswith("ARRAY")
    size = F.size(F.try_variant_get(got, "$", "array<variant>"))
    names = ("id", "decision", "code", "evidence", "correction")
    read = {n: F.when(listed, F.try_variant_get(got, f"$[{i}]", "string")).otherwise(F.try_variant_get(got, f"$.{n}", "string")) for i, n in enumerate(names)}
    said = F.lower(read["decision"])
    decision = F.when(said.isin("a", "accept"), "accept").when(said.isin("r", "reject"), "reject").when(said.isin("c", "correct"), "correct")
    out = replies.withColumn("verdict_id", read["id"]).withColumn("decision", decision)
    code = F.coalesce(read["code"], F.when(F.col("decision") == "reject", F.lit(default_code)))
    out = out.withColumn("code", code).withColumn("evidence", F.when(F.length(read["evidence"]) <= most_evidence, read["evidence"]))
    out = out.withColumn("correction", F.when(F.col("decision") == "correct", read["correction"]))
    bad = F.when(got.isNull(), "not_json").when(listed & ((size < 2) | (size > 5)), "wrong_length").when(F.col("verdict_id").isNull(), "no_id")
    bad = bad.when(F.col("decision").isNull(), "unknown_decision").when((F.col("decision") == "reject") & F.col("code").isNull(), "no_code")
    bad = bad.when(F.col("code").isNotNull() & ~F.col("code").isin(*CODES), "unknown_code")
    if not corrections:
        bad = bad.when(F.col("decision") == "correct", "correction_not_allowed")
    return out.withColumn("error", bad)


CORRECTION = "new_value string, new_category string, new_field string, new_start bigint, new_text string"


def correct(c: DataFrame) -> DataFrame:
    """Checked candidates with the columns of CORRECTION (null keeps the old): outcome and codes.

    The corrected span is cut from the chunk and must hold the text it claims. The result must keep
    to the plan and to the old span, be grounded (labels aside), and lose no qualifier that its span
    still has. A valid original stays where the correction only relabels, only widens, or cannot be
    built. ``outcome`` is corrected, preserved or rejected.
    """
    start = F.coalesce("new_start", "start_char")
    text = F.coalesce("new_text", "source_text")
    at = start - F.col("chunk_start")
    end = at + F.length(text)
    empty = F.col("new_value").isNull() & F.col("new_category").isNull() & F.col("new_field").isNull() & F.col("new_start").isNull() & F.col("new_text").isNull()
    built = F.coalesce((at >= 0) & (end <= F.length("chunk_text")) & (slice_chars(F.col("chunk_text"), at, end) == text) & (F.length(text) > 0), F.lit(False))
    first = F.col("chunk_byte") + F.octet_length(F.substring("chunk_text", F.lit(1), at.cast("int")))
    new = {
        "value": F.coalesce("new_value", "value"), "category": F.coalesce("new_category", "category"), "field": F.coalesce("new_field", "field"),
        "source_text": text, "start_char": start, "end_char": start + F.length(text), "start_byte": first, "end_byte": first + F.octet_length(text),
    }
    j = c.withColumn("missing", empty).withColumn("built", built)
    for name, col in new.items():
        j = j.withColumn(f"c_{name}", F.when(F.col("built"), col))
    relabelled = (F.col("c_category") != F.col("category")) | (F.col("c_field") != F.col("field"))
    wider = (F.col("c_start_char") < F.col("start_char")) | (F.col("c_end_char") > F.col("end_char")) | (F.col("c_start_byte") < F.col("start_byte")) | (F.col("c_end_byte") > F.col("end_byte"))
    grounded = is_label_field(F.col("c_field")) | value_supported(F.col("c_value"), F.col("c_source_text"))
    # Words are taken once, not once a phrase.
    j = j.withColumn("span_words", spaced(F.col("c_source_text"))).withColumn("value_words", spaced(F.col("c_value")))
    lost = F.lit(False)
    for phrase in LOSABLE:
        lost = lost | (F.contains("span_words", F.lit(f" {phrase} ")) & ~F.contains("value_words", F.lit(f" {phrase} ")))
    lost = (F.col("c_value") != F.col("value")) & lost
    # The plan is asked about the slot the correction names; a slot it keeps was asked about before.
    slot_ok = F.when(relabelled, F.coalesce("new_slot_ok", F.lit(False))).otherwise(F.col("field_ok")) if "new_slot_ok" in c.columns else F.when(relabelled, F.lit(False)).otherwise(F.col("field_ok"))
    found = F.array_compact(F.array(
        F.when(F.col("missing"), F.lit("no_correction")), F.when(~F.col("missing") & ~F.col("built"), F.lit("span_text_mismatch")),
        F.when(F.col("built") & ~F.col("missing") & ~slot_ok, F.lit("slot_not_approved")), F.when(F.col("built") & ~F.col("missing") & wider, F.lit("span_expanded")),
        F.when(F.col("built") & ~F.col("missing") & ~grounded, F.lit("value_not_grounded")), F.when(F.col("built") & ~F.col("missing") & lost, F.lit("qualifier_lost")),
    ))
    j = j.withColumn("faults", found)
    only = lambda name: (F.size("faults") == 1) & F.array_contains("faults", name)
    keep = F.col("valid") & ~F.col("missing") & F.when(F.col("built"), relabelled | only("span_expanded")).otherwise(only("span_text_mismatch"))
    outcome = F.when(F.coalesce(keep, F.lit(False)), "preserved").when(F.size("faults") > 0, "rejected").otherwise("corrected")
    return j.withColumn("outcome", outcome).drop("span_words", "value_words")


#: Fault of a correction -> code of the rejection.
FAULT_CODES = {
    "no_correction": "schema_violation", "span_text_mismatch": "invented_span", "slot_not_approved": "schema_violation",
    "span_expanded": "schema_violation", "value_not_grounded": "invented_span", "qualifier_lost": "schema_violation",
}


def first_verdicts(verdicts: DataFrame) -> DataFrame:
    """The first verdict of each candidate by ``pos``; the minimum is taken before the shuffle."""
    rest = [c for c in verdicts.columns if c not in ("candidate_id", "pos")]
    first = verdicts.groupBy("candidate_id").agg(F.min(F.struct("pos", *rest)).alias("v"))
    return first.select("candidate_id", *[F.col(f"v.{c}").alias(c) for c in rest])


def critic_reports(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One report a checked candidate: accepted, code, score and the value and span it leaves with.

    ``verdicts`` has candidate_id, pos, decision, code, evidence and the columns of CORRECTION. No
    verdict is a rejection of its own, never a silent drop.
    """
    j = correct(candidates.join(first_verdicts(verdicts), "candidate_id", "left"))
    false_reject = critic_contradicted(F.col("code"), F.col("evidence"))
    code = (
        F.when(F.col("decision").isNull(), "critic_missing_report")
        .when((F.col("decision") == "reject") & ~false_reject, F.col("code"))
        .when((F.col("decision") == "correct") & (F.col("outcome") == "rejected"), "invalid_correction")
    )
    j = j.withColumn("why", code).withColumn("accepted", F.col("why").isNull())
    changed = F.col("accepted") & (F.col("decision") == "correct") & (F.col("outcome") == "corrected")
    slots = ("value", "category", "field", "source_text", "start_char", "end_char", "start_byte", "end_byte")
    out = j.select(
        "candidate_id", "doc_id", "chunk_id", "accepted", F.col("why").alias("reason"), F.col("accepted").cast("double").alias("score"), F.coalesce(changed, F.lit(False)).alias("corrected"),
        *[F.when(changed, F.col(f"c_{s}")).otherwise(F.col(s)).alias(s) for s in slots],
    )
    identity = ("candidate_id", "accepted", "reason", "score", "corrected", "value", "start_char", "end_char")
    return out.withColumn("report_id", stable_id("critic-", *[F.col(c) for c in identity]))


def verifier_reports(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One report a checked candidate: the verdict's code unless the checks contradict it, then the
    mechanical reasons, each once; accepted where none is left."""
    said = first_verdicts(verdicts)
    j = candidates.join(said, "candidate_id", "left")
    code = F.when(F.col("decision") == "reject", F.coalesce("code", F.lit("verifier_rejected")))
    stands = code.isNotNull() & ~verifier_contradicted(code)
    own = F.when(F.col("decision").isNull(), F.array(F.lit("verifier_missing_report"))).when(stands, F.array(code)).otherwise(F.array().cast("array<string>"))
    j = j.withColumn("codes", F.array_distinct(F.concat(own, verifier_reasons()))).withColumn("accepted", F.size("codes") == 0)
    span_ok, slot_ok = ~_any(F.col("codes"), SPAN_CODES), ~_any(F.col("codes"), ("category_not_approved", "schema_violation"))
    out = j.select("candidate_id", "doc_id", "accepted", F.array_join("codes", ",").alias("codes"), F.col("accepted").cast("double").alias("score"), span_ok.alias("span_verified"), slot_ok.alias("category_verified"))
    return out.withColumn("report_id", stable_id("verifier-", *[F.col(c) for c in ("candidate_id", "span_verified", "category_verified", "score", "accepted", "codes")]))


def merge_retry(prior: DataFrame, retry: DataFrame, complained: DataFrame, expected: DataFrame) -> DataFrame:
    """A batch after a retry: verdicts complained about are replaced where the retry has one, missing
    ones are added, unknown ids are dropped. All tables have candidate_id."""
    known = expected.select("candidate_id").distinct()
    prior = prior.join(known, "candidate_id", "left_semi")
    good = prior.join(complained.select("candidate_id").distinct(), "candidate_id", "left_anti")
    new = retry.join(known, "candidate_id", "left_semi").join(good.select("candidate_id").distinct(), "candidate_id", "left_anti")
    lost = prior.join(complained.select("candidate_id").distinct(), "candidate_id", "left_semi").join(retry.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return good.unionByName(new).unionByName(lost)


def complaint_texts(reported: DataFrame) -> DataFrame:
    """What a remote proposer is told of each verdict that failed, one row a candidate."""
    text = F.format_string("%s: the correction or verdict fails (%s); send it again for this id only.", F.col("candidate_id"), F.col("reason"))
    return reported.where(F.col("reason").isNotNull()).select("candidate_id", text.alias("message"))


def stage_input_errors(candidates: DataFrame, chunks: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """candidate_id and what is wrong with a stage's input: an unknown or foreign chunk, a repeated
    id, and, with ``reports``, not exactly one accepted report."""
    c = chunks.select("chunk_id", F.col("doc_id").alias("chunk_doc")).dropDuplicates(["chunk_id"])
    n = candidates.groupBy("candidate_id").agg(F.count("*").alias("n_ids"))
    j = candidates.select("candidate_id", "doc_id", "chunk_id").distinct().join(c, "chunk_id", "left").join(n, "candidate_id")
    tests = [(F.col("chunk_doc").isNull(), "unknown_chunk"), (F.col("chunk_doc") != F.col("doc_id"), "foreign_chunk"), (F.col("n_ids") > 1, "repeated_id")]
    if reports is not None:
        ok = reports.groupBy("candidate_id").agg(F.count_if("accepted").alias("n_accepted"))
        j = j.join(ok, "candidate_id", "left")
        tests.append((F.coalesce("n_accepted", F.lit(0)) != 1, "not_one_accepted_report"))
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))
    return j.select("candidate_id", F.explode(found).alias("error"))


def same_field(a: Column, b: Column) -> Column:
    return folded(a) == folded(b)
