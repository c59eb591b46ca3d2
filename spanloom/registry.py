"""Queries of the fact engine. Their SQL is in :mod:`spanloom.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples as S
from .functions.text import canonical_key, value_supported
from .operators import chains as H
from .operators import claims as C
from .operators import clauses as K
from .operators import documents as D
from .operators import facts as X
from .operators import layout as L
from .operators import occurrences as O
from .operators import policies as P
from .operators import reconcile as M
from .operators import review as R
from .operators import rounds as N
from .operators import verdicts as V
from .session import ship
from .sources import html
from .tables import materialize, spread

LENS_NAMES = ("number", "citation", "entity", "temporal", "quantity_with_unit", "definition", "event", "claim")
LEAST = 0.9


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(f):
    return lambda spark, d: f(_t(spark, d, "documents"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents for the lenses, which are heavy per byte: over all cores."""
    return spread(_t(spark, d, "documents"), "doc_id")


def _spread(f):
    return lambda spark, d: f(_texts(spark, d))


def _facts(f):
    """Facts of whole documents, read once."""
    return lambda spark, d: f(S.scored(X.propose(_texts(spark, d))))


def _both(f):
    return lambda spark, d: f(S.scored(X.propose(_texts(spark, d))), _t(spark, d, "documents"))


def _candidates(f):
    """Candidates of chunks, read once; overlapping chunks find some facts twice."""
    return lambda spark, d: f(S.scored(X.propose(S.chunked(_texts(spark, d)))))


def _written(f):
    """Facts written once, for queries that read them more than once."""
    return lambda spark, d: f(materialize(S.scored(X.propose(_texts(spark, d))), "facts"))


def _checked(f):
    """Chunk candidates with their checks, written once, as are the chunks, which they meet again."""

    def run(spark, d):
        chunks = materialize(S.chunked(_texts(spark, d)), "chunks")
        c = S.scored(X.propose(chunks)).withColumn("source_text", F.col("value"))
        return f(materialize(P.checked(c, chunks, S.plan_fields(spark)), "candidates"))

    return run


def _matched(f):
    def run(facts):
        labels = S.labels_of(facts)
        return f(labels, facts, R.match(labels, facts))

    return _written(run)


def _events(labels, facts, matched):
    return R.counts(labels, facts, matched)


def _thresholds(facts: DataFrame) -> DataFrame:
    """Least ratios over all, for two categories of which one has no label, and for a field."""
    rows = [("suite", None, None), ("category", "Quantity", None), ("category", "Nothing", None), ("field", "Entity", "name")]
    data = [(s, c, f, m, "min", LEAST) for s, c, f in rows for m in R.RATIOS] + [("suite", None, None, "violations", "max", 0.0)]
    return facts.sparkSession.createDataFrame(data, "scope string, category string, field string, metric string, comparator string, threshold double")


def _pages(f):
    def run(spark, d):
        ship(spark)
        return f(_t(spark, d, "pages"))

    return run


def _shipped(f):
    def run(spark, d):
        ship(spark)
        return f(spark, d)

    return run


def _diff(f):
    return _written(lambda facts: f(R.run_diff(*S.reports(facts))))


def _reviewed(f):
    """Reports written once: a filter on their outcome would else be unfolded into every check it follows from."""

    def run(c):
        return f(c, materialize(P.critic_reports(c, S.verdicts(c)), "reports"))

    return _checked(run)


def _reconciled(f):
    def run(facts):
        c = facts.withColumn("source_text", F.col("value"))
        plan = S.plan_fields(facts.sparkSession)
        groups = materialize(S.groups_of(M.rule_groups(c)), "groups")
        return f(c, groups, materialize(M.assess_groups(groups, c, plan), "assessed"))

    return _written(run)


def _batches(spark, d):
    """What replies to batches say: groups, rejections and faulty replies, one row each."""
    x = M.decode_batches(S.replies(_t(spark, d, "documents")))
    row = lambda kind, pos, id, detail: (F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), id.alias("id"), detail.alias("detail"))
    groups = M.batch_groups(x).select("doc_id", *row("group", F.col("group_pos"), F.col("source_id"), F.array_join("member_ids", ",")))
    none = F.lit(None).cast("string")
    rejected = M.batch_rejections(x).select("doc_id", *row("rejected", F.lit(0), F.col("candidate_id"), F.col("code")))
    return groups.unionByName(rejected).unionByName(x.where("error is not null").select("doc_id", *row("error", F.lit(0), none, F.col("error"))))


def _no_rejections(c: DataFrame) -> DataFrame:
    """Explicit rejections of the sample: short values."""
    return c.where("length(value) = 1").select("doc_id", "candidate_id", F.lit("invented_span").alias("code"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to facts to cross-document groups, in report order."""
    return X.crossdoc_groups(X.propose(_texts(spark, d))).orderBy("category", "field", "key")


def _lens(name: str):
    return lambda spark, d: X.propose(S.contracted(_texts(spark, d)), [x for x in X.LENSES if x[0] == name]).drop("text_key")


def _stage(c: DataFrame) -> DataFrame:
    return R.stage_completeness(c.select("candidate_id", "doc_id"), X.rejections(c), X.survivors(c).where("lens <> 'number'"))


def _rejected(c: DataFrame, reported: DataFrame) -> DataFrame:
    """Rejections of three stages as rows (stage, candidate_id, codes)."""
    ex = c.select(F.lit("executor").alias("stage"), "candidate_id", P.executor_reasons().alias("codes")).where("size(codes) > 0")
    cr = reported.where("not accepted").select(F.lit("critic").alias("stage"), "candidate_id", F.array("reason").alias("codes"))
    ve = P.verifier_reports(c, S.verifier_verdicts(c)).where("not accepted").select(F.lit("verifier").alias("stage"), "candidate_id", F.split("codes", ",").alias("codes"))
    return ex.unionByName(cr).unionByName(ve)


def _fates(c: DataFrame, reported: DataFrame) -> DataFrame:
    reported = materialize(reported.select("candidate_id", "accepted"), "reports")
    merged = materialize(S.chained(c), "chains")
    first = merged.select("candidate_id")
    members = reported.where("accepted").select("candidate_id").join(first, "candidate_id", "left_anti")
    rejections = reported.where("not accepted").select("candidate_id", F.lit("critic").alias("stage")).join(first, "candidate_id", "left_anti")
    return V.fates(c.select("candidate_id"), merged, rejections, members)


def _triage(labels, facts, matched):
    fate = F.element_at(F.array(*[F.lit(x) for x in R.TRIAGE]), (F.pmod(F.col("ordinal") + F.col("doc_id"), F.lit(7)) + 1).cast("int"))
    return R.triage_missing(labels, matched, facts.withColumn("fate", fate))


def _claims(f):
    """Claims written once: they are counted by chunk before they meet it, and the lenses are dear."""

    def run(spark, d):
        chunks = materialize(S.chunked(S.headed(_texts(spark, d))), "chunks")
        return f(materialize(S.claims_of(S.scored(X.propose(chunks))), "claims"), chunks)

    return run


def _resolved(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    out = C.resolve(claims, chunks)
    return out.select("claim_id", "doc_id", "lens", "ordinal", "start_char", "resolution", "resolved_start", "source_text", F.array_join("codes", ",").alias("codes"))


def _materialized(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    out = C.materialize_candidates(C.normalize(C.resolve(claims, chunks), chunks).where("size(codes) = 0"))
    return out.select("claim_id", "doc_id", "value", "source_text", "start_char", "end_char", "start_byte", "end_byte", "status", "value_canonical", "policy_id")


def _value_matches(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    m = O.value_places(claims.select("claim_id", "chunk_id", "value"), chunks, ["chunk_id"])
    ends = F.transform("places", lambda p: p["end"])
    return m.select("claim_id", F.size("places").cast("long").alias("n"), F.get("places", F.lit(0))["start"].alias("first_start"), F.array_max(ends).alias("last_end"))


def _supported(docs: DataFrame) -> DataFrame:
    """Whether each line is supported by the line before it."""
    ls = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ls) - 1, F.lit(1))), lambda i: F.struct(i.cast("long").alias("line_no"), F.get(ls, i).alias("v"), F.get(ls, i - 1).alias("s")))
    rows = docs.where(F.size(ls) > 1).select("doc_id", F.explode(each).alias("x")).where("x.v <> ''")
    return rows.select("doc_id", "x.line_no", value_supported(F.col("x.v"), F.col("x.s")).alias("supported"))


def _keys(spark, d):
    """Keys of whole texts; long ones as a hash."""
    whole = lambda t, i: _t(spark, d, t).select(F.lit(t).alias("origin"), F.col(i).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("value"))
    rows = whole("benchmark", "item_id").unionByName(whole("documents", "doc_id")).unionByName(whole("conversations", "conv_id"))
    key = canonical_key(F.col("value"))
    return rows.select("origin", "id", F.length(key).cast("long").alias("key_chars"), F.sha2(key, 256).alias("key_sha256"))


def _tampered(facts: DataFrame) -> DataFrame:
    """Facts whose spans are off in every way, by residue."""
    h = F.pmod(F.col("doc_id") + F.col("ordinal"), F.lit(5))
    end = F.when(h == 1, F.col("end_char") + 10_000_000).otherwise(F.col("end_char"))
    byte = F.when(h == 2, F.col("start_byte") + 1).otherwise(F.col("start_byte"))
    value = F.when(h == 3, F.concat("value", F.lit("?"))).otherwise(F.col("value"))
    return facts.withColumn("end_char", end).withColumn("start_byte", byte).withColumn("value", value)


def _joined(spark, d):
    return L.join_pages(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"))


def _page_join(spark, d):
    j = _joined(spark, d)
    each = j.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.explode("page_map").alias("p"))
    return each.select("doc_id", "text_sha256", "p.*")


def _segments(spark, d):
    each = _joined(spark, d).select("doc_id", F.explode("source_map").alias("s"))
    return each.select("doc_id", "s.*")


def _line_blocks(docs: DataFrame) -> DataFrame:
    laid = L.line_layout(docs)
    part = lambda c, i, role: laid.select("doc_id", F.explode(c).alias("s")).select("doc_id", F.col(f"s.{i}").alias("span_id"), role, "s.start_char", "s.end_char", "s.start_byte", "s.end_byte")
    return part("layout", "span_id", F.col("s.role").alias("role")).unionByName(part("tables", "table_id", F.lit("table").alias("role")))


def _word_alignment(docs: DataFrame) -> DataFrame:
    """A row a word; a page whose words were not all found has one row without places."""
    return L.placed(S.worded(docs), "text", "words").select("doc_id", "line_no", F.col("at").cast("long").alias("word_index"), "start_char", "end_char", "start_byte", "end_byte")


def _cell_alignment(docs: DataFrame) -> DataFrame:
    x = L.placed_cells(S.celled(docs), "text", "cells")
    at = [F.col(n).cast("long").alias(n) for n in ("row_index", "column_index", "start_char", "end_char")]
    return x.select("doc_id", "line_no", *at, F.array_join("header_labels", ",").alias("headers"))


def _chains(f):
    """Stored chains of the users' events, and the same with changes; both are read more than once."""

    def run(spark, d):
        stored = materialize(H.link(S.chain_rows(_t(spark, d, "events")), "user_id", ["ts", "event_id"]), "chains")
        return f(stored, S.tampered_chain(stored))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    lenses = {f"lens_{k}": _lens(k) for k in LENS_NAMES}
    return {
        "doc_identity": _docs(D.identities),
        "format_detect": lambda s, d: D.detect_format(_t(s, d, "pages").select("page_id", "url"), "url").select("page_id", "suffix", "format", "error"),
        "page_and_source_map": _docs(D.page_map),
        "chunk_token_window": _docs(lambda x: D.chunks(x, *S.CHUNK).drop("text")),
        "chunk_ids": _docs(lambda x: D.chunks(x).select("doc_id", "chunk_index", "chunk_id")),
        "chunk_pages_overlap": _docs(lambda x: D.overlapping_pages(D.paged(x))),
        "section_carry_forward": _docs(D.sections),
        "sentence_spans": _docs(D.sentences),
        "layout_blocks": _docs(_line_blocks),
        "chunk_boundaries": _docs(lambda x: L.boundaries(L.line_layout(x))),
        "layout_errors": _docs(lambda x: L.layout_errors(L.line_layout(x)).select("doc_id", F.array_join("errors", ",").alias("errors"))),
        "packed_chunks": _shipped(lambda s, d: L.packed_chunks(L.line_layout(_t(s, d, "documents")), 200)),
        "word_alignment": _spread(_word_alignment),
        "cell_alignment": _spread(_cell_alignment),
        "page_join": _page_join,
        "page_segments": _segments,
        "boundary_contiguity": lambda s, d: V.contiguity(_segments(s, d).select("doc_id", "start_char", "end_char")),
        "html_blocks": _pages(html.blocks),
        "html_headings": _pages(html.headings),
        "html_title_meta": _pages(html.title_meta),
        "html_tag_counts": lambda s, d: html.block_counts(_t(s, d, "pages")),
        **lenses,
        "lens_relation": lambda s, d: K.relations(S.contracted(_texts(s, d))),
        **{f"lens_{x[0]}": (lambda s, d, lens=x[0]: K.clauses(S.contracted(_texts(s, d)), lens)) for x in K.CUES},
        "span_roundtrip_check": _both(X.span_check),
        "span_invariants": _both(lambda f, x: R.violations(_tampered(f), x).select("candidate_id", "code")),
        "resolve_claim_offsets": _shipped(_claims(_resolved)),
        "materialized_candidates": _shipped(_claims(_materialized)),
        "value_matches": _shipped(_claims(_value_matches)),
        "value_supported": _docs(_supported),
        "canonical_key": _keys,
        "dedup_survivors": _candidates(X.survivors),
        "dedup_clusters": _candidates(X.clusters),
        "dedup_rejections": _candidates(X.rejections),
        "field_conflicts": _facts(X.field_conflicts),
        "crossdoc_groups": _facts(X.crossdoc_groups),
        "crossdoc_conflicts": _facts(X.crossdoc_conflicts),
        "crossdoc_skipped": lambda s, d: X.crossdoc_skipped(X.propose(_t(s, d, "documents")), S.runs_of(_t(s, d, "labels"), _t(s, d, "documents"))),
        "source_specificity_pick": _facts(M.specificity_pick),
        "review_batches": _candidates(X.review_batches),
        "source_context": _both(X.context),
        "approved_fields": _checked(lambda c: c.select("candidate_id", F.array_join(P.executor_reasons(), ",").alias("codes"), "valid")),
        "critic_reports": _reviewed(lambda c, r: r.select("candidate_id", "accepted", "reason", "score", "corrected", "value", "start_char", "end_char")),
        "corrections": _checked(lambda c: P.correct(c.join(P.first_verdicts(S.verdicts(c)), "candidate_id").where("decision = 'correct'")).select("candidate_id", "outcome", F.array_join("faults", ",").alias("faults"))),
        "verifier_reports": _checked(lambda c: P.verifier_reports(c, S.verifier_verdicts(c)).drop("report_id")),
        "rejection_summary": _reviewed(lambda c, r: V.rejection_summary(r.join(c.select("candidate_id", "lens"), "candidate_id"))),
        "drop_summary": _reviewed(lambda c, r: R.drop_summary(_rejected(c, r))),
        "rejected_candidates": _reviewed(lambda c, r: R.rejected_candidates(_rejected(c, r))),
        "verdict_complaints": _checked(lambda c: V.complaints(c, S.verdicts(c))),
        "retry_outcomes": _written(lambda f: N.outcomes(S.asked_of(f), S.answers_of(f), S.ATTEMPTS, S.PATIENCE)),
        "retry_requests": _written(lambda f: N.requests(S.asked_of(f), S.answers_of(f), S.ATTEMPTS, S.PATIENCE)),
        "mirrored_reports": _reviewed(V.mirrored),
        "candidate_fates": _reviewed(_fates),
        "fact_confidence": _reviewed(V.fact_confidence),
        "reconcile_groups": _reconciled(lambda c, g, a: a),
        "reconcile_batches": _batches,
        "data_points": _reconciled(lambda c, g, a: M.data_points(a, c, c.select("candidate_id", F.lit(0.8).alias("score"))).drop("decision_id", "data_point_id")),
        "reconcile_rejections": _reconciled(lambda c, g, a: M.unaccounted(a, _no_rejections(c), c)),
        "conflict_complaints": _reconciled(lambda c, g, a: M.conflict_complaints(g, c)),
        "usage_by_stage": lambda s, d: R.usage_by_stage(S.calls(_t(s, d, "events"))),
        "acceptance_checks": lambda s, d: R.acceptance(R.usage_by_stage(S.calls(_t(s, d, "events")))),
        "confidence_buckets": _facts(R.confidence_buckets),
        "match_labels": _matched(lambda l, f, m: m),
        "score_overall": _matched(lambda l, f, m: R.metrics(_events(l, f, m), "fixture")),
        "score_by_field": _matched(lambda l, f, m: R.metrics(_events(l, f, m))),
        "threshold_failures": _matched(lambda l, f, m: R.threshold_failures(R.metrics(_events(l, f, m)), _thresholds(f))),
        "calibration_bins": _matched(lambda l, f, m: R.calibration(m, f)),
        "calibration_error": _matched(lambda l, f, m: R.expected_calibration_error(R.calibration(m, f))),
        "triage_missing": _matched(_triage),
        "span_shapes": _matched(lambda l, f, m: R.span_shapes(l, m, f)),
        "run_diff": _diff(lambda x: x.drop("entry_id")),
        "diff_summary": _diff(R.diff_summary),
        "integrity_chain": lambda s, d: R.integrity_chain(_t(s, d, "events")),
        "chain_breaks": _chains(lambda c, x: H.breaks(x, "user_id", 16).select("user_id", "seq", "chain_hash", F.array_join("codes", ",").alias("codes"))),
        "chain_digests": _chains(lambda c, x: H.digests(x, "user_id", 16)),
        "chain_divergence": _chains(lambda c, x: H.divergence(c, x, "user_id", 16)),
        "stage_completeness": _checked(_stage),
        "mutation_sensitivity": _shipped(lambda s, d: R.mutation_sensitivity(_t(s, d, "benchmark"), _texts(s, d))),
        "mutation_failures": _written(lambda f: R.mutation_failures(*S.mutations(f))),
        "mutation_suite": _written(lambda f: R.mutation_suite(R.mutation_scores(S.mutations(f)[0], R.mutation_failures(*S.mutations(f))))),
        "schema_fit": lambda s, d: R.schema_fit(S.classified(_t(s, d, "documents")), S.schemas(s)),
        "run_status": lambda s, d: V.run_status(S.run_events(_t(s, d, "events"))),
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as made

    return made()
