"""Evaluation, calibration, report diff, usage, integrity chain, mutations, triage and schema fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded, slice_bytes, slice_chars, stable_id
from .facts import with_texts
from .occurrences import documents_with

#: Kinds of change between two reports, in the order they are listed and counted.
DIFF_ORDER = ("changed_value", "changed_provenance", "changed_confidence", "removed", "added", "ambiguous_match", "unchanged")
SUMMARY_ORDER = ("added", "removed", "changed_value", "changed_provenance", "changed_confidence", "unchanged", "ambiguous_match")
#: Most batches of the two review stages.
CRITIC_BATCHES, VERIFIER_BATCHES = 6, 5
USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def usage_by_stage(calls: DataFrame) -> DataFrame:
    """Calls and the four token sums by stage; ``calls`` has stage and the columns of USAGE."""
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in USAGE])


def acceptance(usage: DataFrame) -> DataFrame:
    """The four checks of a run's usage: few enough batches of both review stages, and cache reads
    in both. A stage without calls counts as nought."""
    of = lambda stage, col: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col(col))), F.lit(0)).cast("long")
    g = usage.agg(of("critic", "calls").alias("c"), of("verifier", "calls").alias("v"), of("critic", "cache_read_tokens").alias("cc"), of("verifier", "cache_read_tokens").alias("vc"))
    row = lambda name, actual, limit, ok: F.struct(F.lit(name).alias("check"), ok.alias("passed"), actual.alias("actual"), F.lit(limit).cast("long").alias("limit"))
    checks = F.array(
        row(f"critic_batches_le_{CRITIC_BATCHES}", F.col("c"), CRITIC_BATCHES, F.col("c") <= CRITIC_BATCHES),
        row(f"verifier_batches_le_{VERIFIER_BATCHES}", F.col("v"), VERIFIER_BATCHES, F.col("v") <= VERIFIER_BATCHES),
        row("critic_cache_read_tokens_nonzero", F.col("cc"), None, F.col("cc") > 0),
        row("verifier_cache_read_tokens_nonzero", F.col("vc"), None, F.col("vc") > 0),
    )
    return g.select(F.explode(checks).alias("x")).select("x.*")


#: Buckets of confidence by their least value, highest first.
BUCKETS = (("high", 0.9), ("medium", 0.7), ("low", 0.0))


def bucket_of(confidence: Column, buckets=BUCKETS) -> Column:
    """Name of the half-open bucket; the first has no upper end."""
    out = F.lit(None).cast("string")
    for name, least in reversed(buckets):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def confidence_buckets(facts: DataFrame, buckets=BUCKETS) -> DataFrame:
    """Facts by bucket, empty buckets kept. Items of a bucket: :func:`bucket_items`."""
    tops = [1.0, *[b for _, b in buckets[:-1]]]
    table = facts.sparkSession.createDataFrame([(i, n, float(a), float(t)) for i, ((n, a), t) in enumerate(zip(buckets, tops))], "ord int, bucket string, least double, top double")
    g = facts.groupBy(bucket_of(F.col("confidence"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    return table.join(g, "bucket", "left").select("ord", "bucket", "least", "top", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bucket_items(facts: DataFrame, buckets=BUCKETS) -> DataFrame:
    """One row a fact with its bucket: lists of a bucket's items, without a list in one task."""
    return facts.select("candidate_id", bucket_of(F.col("confidence"), buckets).alias("bucket"))


# Labels against facts

SPAN = ("start_char", "end_char", "start_byte", "end_byte")


def _sided(df: DataFrame, id_: str) -> DataFrame:
    key = F.struct("doc_id", folded(F.col("category")).alias("c"), folded(F.col("field")).alias("f"), folded(F.col("value")).alias("v")).alias("k")
    text = F.col("source_text") if "source_text" in df.columns else F.col("value")
    return df.select(F.col(id_).alias("id"), key, F.struct(*SPAN, text.alias("t")).alias("place"))


def match(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Greedy one-to-one matching, exact places first, then any: expected_id, data_point_id, status.

    ``labels`` has expected_id, ``found`` candidate_id; both doc_id, category, field, value and the
    four offsets. Labels and facts of one key and place are numbered by id, equal numbers meet;
    the rest of each key is numbered anew. Status is exact, matched, missing or unexpected.
    """
    rank = lambda df, *by: df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("id")))
    l, f = rank(_sided(labels, "expected_id"), "k", "place"), rank(_sided(found, "candidate_id"), "k", "place")
    first = l.select("k", "place", "r", F.col("id").alias("expected_id")).join(f.select("k", "place", "r", F.col("id").alias("data_point_id")), ["k", "place", "r"], "full_outer")
    # What met is done; the rest of both sides goes on, each row once.
    done = first.where("expected_id is not null and data_point_id is not null").select("expected_id", "data_point_id", F.lit("exact").alias("status"))
    rest = first.where("expected_id is null or data_point_id is null")
    l2 = rank(rest.where("expected_id is not null").select("k", F.col("expected_id").alias("id")), "k").select("k", "r", F.col("id").alias("expected_id"))
    f2 = rank(rest.where("data_point_id is not null").select("k", F.col("data_point_id").alias("id")), "k").select("k", "r", F.col("id").alias("data_point_id"))
    status = F.when(F.col("data_point_id").isNull(), "missing").when(F.col("expected_id").isNull(), "unexpected").otherwise("matched")
    return done.unionByName(l2.join(f2, ["k", "r"], "full_outer").select("expected_id", "data_point_id", status.alias("status")))


def violations(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Span faults of facts: candidate_id, kind (source or supporting) and code, one row each.

    Out of bounds stands alone; else byte offsets off the characters, text and bytes that differ.
    ``supporting`` (array of spans with text) is looked at where the column is there.
    """
    own = F.array(F.struct(F.lit("source_span").alias("kind"), *SPAN, F.col("value").alias("text")))
    if "supporting" in facts.columns:
        own = F.concat(own, F.transform("supporting", lambda s: F.struct(F.lit("supporting_source_span").alias("kind"), *[s[c].alias(c) for c in SPAN], s["text"].alias("text"))))
    key = ["text_key"] if "text_key" in facts.columns else []
    each = with_texts(facts.select("candidate_id", "doc_id", *key, F.explode(own).alias("s")), docs, "doc").withColumn("doc", F.coalesce("doc", F.lit("")))
    s, doc = F.col("s"), F.col("doc")
    beyond = (s["end_char"] > F.length(doc)) | (s["end_byte"] > F.octet_length(doc))
    before = lambda n: F.octet_length(F.substring(doc, F.lit(1), n.cast("int")))
    codes = F.when(beyond, F.array(F.lit("out_of_bounds"))).otherwise(F.array_compact(F.array(
        F.when((before(s["start_char"]) != s["start_byte"]) | (before(s["end_char"]) != s["end_byte"]), "byte_offset_mismatch"),
        F.when(slice_chars(doc, s["start_char"], s["end_char"]) != s["text"], "text_mismatch"),
        F.when(slice_bytes(doc, s["start_byte"], s["end_byte"]) != s["text"].cast("binary"), "byte_mismatch"),
    )))
    return each.select("candidate_id", "doc_id", F.explode(codes).alias("c"), s["kind"].alias("kind")).select("candidate_id", "doc_id", F.concat_ws("_", "kind", "c").alias("code"))


COUNTS = ("expected", "actual", "hits", "exact", "violations")


def counts(labels: DataFrame, found: DataFrame, matched: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """Events to add up: one row a label, fact, hit, exact hit and violation, by fixture and slot.

    Hits count for the label's slot. ``fixture`` is the column of that name, else the document.
    """
    fixture = lambda df: F.col("fixture") if "fixture" in df.columns else F.col("doc_id").cast("string")
    mark = lambda **on: [F.lit(1 if c in on else 0).cast("long").alias(c) for c in COUNTS]
    slot = lambda df: [fixture(df).alias("fixture"), "category", "field"]
    hit = labels.join(matched.where("status in ('exact', 'matched')").select("expected_id", "status"), "expected_id")
    out = labels.select(*slot(labels), *mark(expected=1)).unionByName(found.select(*slot(found), *mark(actual=1)))
    out = out.unionByName(hit.select(*slot(labels), *mark(hits=1))).unionByName(hit.where("status = 'exact'").select(*slot(labels), *mark(exact=1)))
    if faults is not None:
        of = found.join(faults.select("candidate_id", "code"), "candidate_id")
        out = out.unionByName(of.select(*slot(found), *mark(violations=1)))
    return out


def metrics(events: DataFrame, by: str = "suite") -> DataFrame:
    """Counts and ratios over all, by category and by field, and with ``by="fixture"`` also by
    fixture: micro-averages from one grouping-sets aggregation. Precision is 0 without facts,
    recall and provenance recall are 1 without labels."""
    sets = [["category", "field"], ["category"], []] + ([["fixture"]] if by == "fixture" else [])
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    cols = ["fixture", "category", "field"] if by == "fixture" else ["category", "field"]
    g = events.groupingSets(sets, *cols).agg(F.grouping_id().alias("gid"), *sums)
    n = len(cols)
    scope = F.when(F.col("gid") == (1 << n) - 1, "suite")
    if by == "fixture":
        scope = scope.when(F.col("gid") == 3, "fixture").when(F.col("gid") == 5, "category").otherwise("field")
    else:
        scope = scope.when(F.col("gid") == 1, "category").otherwise("field")
    p = F.when(F.col("actual") == 0, 0.0).otherwise(F.col("hits") / F.col("actual"))
    r = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("hits") / F.col("expected"))
    v = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("exact") / F.col("expected"))
    g = g.withColumn("scope", scope).drop("gid").withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("provenance_recall", F.round(v, 6))
    return g.withColumn("f1", F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6))


RATIOS = ("precision", "recall", "f1", "provenance_recall")


def threshold_failures(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics beyond their thresholds. ``thresholds`` (scope, category, field, metric, comparator,
    threshold; null category or field for scopes without) are a suite's few rows; a slot with
    thresholds that nothing was scored for counts as noughts, with recall 1."""
    cells = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("actual")) for k in (*RATIOS, "violations")]
    of = [c for c in ("fixture", "category", "field") if c in scored.columns]
    long = scored.select("scope", *of, F.explode(F.array(*cells)).alias("m")).select("scope", *of, "m.*")
    t = thresholds.select(*[F.col(c).alias(f"t_{c}") for c in thresholds.columns])
    on = (F.col("t_scope") == F.col("scope")) & (F.col("t_metric") == F.col("metric"))
    for c in ("category", "field"):
        on = on & (F.col(f"t_{c}").eqNullSafe(F.col(c)))
    empty = F.when(F.col("t_metric").isin("recall", "provenance_recall"), 1.0).otherwise(0.0)
    j = F.broadcast(t).join(long, on, "left").withColumn("actual", F.coalesce("actual", empty))
    bad = F.when(F.col("t_comparator") == "min", F.col("actual") < F.col("t_threshold")).otherwise(F.col("actual") > F.col("t_threshold"))
    fixture = [F.col("fixture")] if "fixture" in of else []
    return j.where(bad).select(F.col("t_scope").alias("scope"), *fixture, F.col("t_category").alias("category"), F.col("t_field").alias("field"), F.col("t_metric").alias("metric"), "actual", F.col("t_threshold").alias("threshold"), F.col("t_comparator").alias("comparator"))


def calibration(matched: DataFrame, found: DataFrame, bins: int = 5) -> DataFrame:
    """Mean confidence against accuracy per bin; empty bins stay. A fact is right if it matched."""
    right = matched.where("data_point_id is not null").select(F.col("data_point_id").alias("candidate_id"), F.col("status").isin("exact", "matched").cast("double").alias("right"))
    j = found.select("candidate_id", "confidence").join(right, "candidate_id", "left")
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    g = j.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.coalesce("right", F.lit(0.0))).alias("a"))
    return found.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round("c", 6).alias("mean_confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap")
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n")
    return bins.agg(F.sum("n").alias("n"), F.round(gap, 6).alias("ece"))


# Differences between two reports

FACT_KEY = ("doc_id", "category", "field", "value_kind", "policy_id", "policy_version")


def run_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by fact key in list order: kind, old and new ids, entry id.

    A key on one side only gives one entry a fact; with several facts on a side it is ambiguous;
    else value, span, confidence in this order name the change. Columns value_kind, policy_id,
    policy_version and value_canonical count where they are there.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        for c in FACT_KEY:
            df = df if c in df.columns else df.withColumn(c, F.lit(""))
        value = F.coalesce("value_canonical", "value") if "value_canonical" in df.columns else F.col("value")
        place = F.struct("start_char", "end_char", *[c for c in ("start_byte", "end_byte") if c in df.columns])
        key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "doc_id" else F.col(c) for c in FACT_KEY]
        rows = df.select(*key, "start_char", "candidate_id", value.alias("v"), place.alias("s"), "confidence")
        one = F.min(F.struct("start_char", "candidate_id", "v", "s", "confidence"))
        ids = F.transform(F.array_sort(F.collect_list(F.struct("start_char", "candidate_id"))), lambda x: x["candidate_id"])
        return rows.groupBy(*FACT_KEY).agg(F.count("*").alias(f"{p}n"), one.alias(f"{p}1"), ids.alias(f"{p}ids"))

    j = side(base, "b").join(side(new, "n"), list(FACT_KEY), "full_outer")
    kind = (
        F.when(F.col("bn").isNull(), "added").when(F.col("nn").isNull(), "removed").when((F.col("bn") > 1) | (F.col("nn") > 1), "ambiguous_match")
        .when(F.col("b1.v") != F.col("n1.v"), "changed_value").when(F.col("b1.s") != F.col("n1.s"), "changed_provenance")
        .when(F.col("b1.confidence") != F.col("n1.confidence"), "changed_confidence").otherwise("unchanged")
    )
    none = F.array().cast("array<string>")
    j = j.select("doc_id", "category", "field", kind.alias("kind"), F.coalesce("bids", none).alias("o"), F.coalesce("nids", none).alias("n"))
    single = F.col("kind").isin("added", "removed")
    pairs = F.when(single, F.transform(F.concat("o", "n"), lambda x: F.struct(F.when(F.col("kind") == "removed", F.array(x)).otherwise(none).alias("o"), F.when(F.col("kind") == "added", F.array(x)).otherwise(none).alias("n"))))
    pairs = pairs.otherwise(F.array(F.struct(F.col("o").alias("o"), F.col("n").alias("n"))))
    out = j.select("doc_id", "category", "field", "kind", F.explode(pairs).alias("p"))
    out = out.select("doc_id", "category", "field", "kind", F.array_join("p.o", ",").alias("old_ids"), F.array_join("p.n", ",").alias("new_ids"))
    rank = (F.array_position(F.array(*[F.lit(k) for k in DIFF_ORDER]), F.col("kind")) - 1).cast("int")
    return out.withColumn("ord", rank).withColumn("entry_id", F.concat(F.lit("diff-"), "kind", F.lit("-"), stable_id("", F.col("kind"), F.col("old_ids"), F.col("new_ids"), size=16)))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Entries per kind, zeros kept, in the summary's order."""
    kinds = diff.sparkSession.createDataFrame(list(enumerate(SUMMARY_ORDER)), "ord int, kind string")
    return kinds.join(diff.groupBy("kind").agg(F.count("*").alias("c")), "kind", "left").select("ord", "kind", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


# Chains and stages


def integrity_chain(events: DataFrame, per: str = "user_id") -> DataFrame:
    """Hash chain of each key's events, folded in (time, id) order; start is 64 zeros.

    A chain is sequential: one key's events are folded by one task, as hashes of 64 characters."""
    item = F.struct("ts", "event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("h"))
    g = events.groupBy(per).agg(F.array_sort(F.collect_list(item)).alias("es"))
    chain = F.aggregate("es", F.lit("0" * 64), lambda acc, x: F.sha2(F.concat(acc, x["h"]), 256))
    return g.select(per, F.size("es").cast("long").alias("n_events"), chain.alias("chain_hash"))


def stage_completeness(facts: DataFrame, rejected: DataFrame, kept: DataFrame) -> DataFrame:
    """Per document: none accounted for, all, or some."""
    done = kept.select("candidate_id").unionByName(rejected.select("candidate_id")).distinct().withColumn("ok", F.lit(1))
    g = facts.join(done, "candidate_id", "left").groupBy("doc_id").agg(F.count("*").alias("expected"), F.count("ok").alias("accounted"))
    return g.withColumn("state", F.when(F.col("accounted") == 0, "pending").when(F.col("accounted") == F.col("expected"), "complete").otherwise("partial"))


def drop_summary(rejections: DataFrame) -> DataFrame:
    """Reasons by stage and code, and rejections of the run: two totals on purpose. ``rejections``
    has stage, candidate_id and codes (array), and is read once: each gives a row a code and level."""
    none = F.lit(None).cast("string")
    level = lambda k, stage, code: F.struct(F.lit(k).alias("level"), stage.alias("stage"), code.alias("code"))
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    by_code = F.transform(codes, lambda c: level(0, F.col("stage"), c))
    by_stage = F.transform(codes, lambda c: level(1, F.col("stage"), none))
    each = rejections.select(F.explode(F.concat(by_code, by_stage, F.array(level(2, none, none)))).alias("x"), F.lit(1).cast("long").alias("one"))
    # The total is there without any rejection, too.
    least = rejections.sparkSession.range(1).select(level(2, none, none).alias("x"), F.lit(0).cast("long").alias("one"))
    return each.unionByName(least).groupBy("x").agg(F.sum("one").alias("n")).select("x.stage", "x.code", "n")


def rejected_candidates(rejections: DataFrame) -> DataFrame:
    """Distinct candidates by (stage, code)."""
    each = rejections.select("stage", "candidate_id", F.explode("codes").alias("code")).distinct()
    return each.groupBy("stage", "code").agg(F.count("*").alias("n"))


def mutation_sensitivity(benchmark: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that hold each whole passage (the retired value) and its changed form (the introduced one).

    A passage is one mutation with one change, an x after its first character (at its end, the
    old passage would still stand in the new one). The share is 1 where the passage is gone and
    the changed form is there. All forms, of any length, are one automaton streamed past the texts.
    Each row of ``docs`` counts; rows of one item_id and text are one passage, and those of one
    item_id and unlike texts add up. Null and empty passages have no row.
    """
    forms = F.array(F.struct(F.lit("kept").alias("form"), F.col("text").alias("t")), F.struct(F.lit("changed").alias("form"), F.concat(F.substring("text", 1, 1), F.lit("x"), F.expr("substring(text, 2)")).alias("t")))
    items = benchmark.select("item_id", folded(F.col("text")).alias("text")).where("text <> ''").distinct()
    needles = items.select("item_id", F.explode(forms).alias("f")).select("item_id", "f.form", F.col("f.t").alias("needle"))
    met = needles.join(documents_with(needles, docs.select(folded(F.col("text")).alias("text"))), "needle", "left")
    n = lambda form: F.sum(F.when(F.col("form") == form, F.coalesce("n", F.lit(0))).otherwise(0)).alias(f"{form}_in")
    out = met.groupBy("item_id").agg(n("kept"), n("changed"))
    return out.select("item_id", "kept_in", "changed_in", ((F.col("kept_in") == 0) & (F.col("changed_in") > 0)).cast("double").alias("sensitivity"))


def mutation_failures(changes: DataFrame, values: DataFrame) -> DataFrame:
    """Retired values that a mutation's report still holds, and introduced ones that it lacks.

    ``changes`` has mutation_id, expected_id, retired and introduced (either may be null), ``values``
    mutation_id and value: the values and span texts of the mutated report.
    """
    v = values.select("mutation_id", folded(F.col("value")).alias("v")).distinct()
    c = changes.select("mutation_id", "expected_id", "retired", "introduced")
    has = lambda col: F.max(F.contains("v", folded(F.col(col))).cast("int"))
    j = c.join(v, "mutation_id", "left").groupBy(*c.columns).agg(has("retired").alias("r"), has("introduced").alias("i"))
    kept = F.when(F.col("retired").isNotNull() & (F.coalesce("r", F.lit(0)) == 1), F.struct(F.lit("retired_value_retained").alias("code"), F.col("retired").alias("value")))
    lost = F.when(F.col("introduced").isNotNull() & (F.coalesce("i", F.lit(0)) == 0), F.struct(F.lit("introduced_value_missing").alias("code"), F.col("introduced").alias("value")))
    return j.select("mutation_id", "expected_id", F.explode(F.array_compact(F.array(kept, lost))).alias("f")).select("mutation_id", "expected_id", "f.code", "f.value")


def mutation_scores(changes: DataFrame, failures: DataFrame) -> DataFrame:
    """Share of each mutation's changes without a failure; a mutation without changes scores 1."""
    n = changes.groupBy("mutation_id").agg(F.count("expected_id").alias("changes"))
    bad = failures.groupBy("mutation_id").agg(F.count_distinct("expected_id").alias("failed"))
    j = n.join(bad, "mutation_id", "left").withColumn("failed", F.coalesce("failed", F.lit(0)).cast("long"))
    return j.withColumn("sensitivity", F.when(F.col("changes") == 0, 1.0).otherwise(F.round((F.col("changes") - F.col("failed")) / F.col("changes"), 6)))


def mutation_suite(scored: DataFrame, least: float = 1.0) -> DataFrame:
    """Mean over mutations (1 without any) and whether the suite passes."""
    return scored.agg(F.count("*").alias("mutations"), F.round(F.coalesce(F.avg("sensitivity"), F.lit(1.0)), 6).alias("sensitivity")).withColumn("passed", F.col("sensitivity") >= least)


def mutation_errors(changes: DataFrame, base: DataFrame, mutated: DataFrame) -> DataFrame:
    """Declared changes that the labels contradict: an id in neither case, a retired value not in
    the base label, an introduced value in no mutated label, and a place whose text changed in
    silence. Labels have mutation_id, expected_id, value, source_text, start_char, end_char."""
    b = base.select("mutation_id", "expected_id", folded(F.concat_ws("\n", "source_text", "value")).alias("b"), F.struct("start_char", "end_char").alias("bp"), F.col("source_text").alias("bt"))
    m = mutated.select("mutation_id", "expected_id", F.lit(True).alias("in_m"), F.struct("start_char", "end_char").alias("mp"), F.col("source_text").alias("mt"))
    every = mutated.select("mutation_id", folded(F.concat_ws("\n", "source_text", "value")).alias("m"))
    intro = changes.where("introduced is not null").join(every, "mutation_id").where(F.contains("m", folded(F.col("introduced")))).select("mutation_id", "expected_id").distinct().withColumn("intro_ok", F.lit(True))
    of = ["mutation_id", "expected_id"]
    j = changes.join(b, of, "left").join(m, of, "left").join(intro, of, "left")
    tests = [
        (F.col("b").isNull() & F.col("in_m").isNull(), "unknown_expected_id"),
        (F.col("retired").isNotNull() & ~F.coalesce(F.contains("b", folded(F.col("retired"))), F.lit(False)), "retired_not_in_base"),
        (F.col("introduced").isNotNull() & F.col("intro_ok").isNull(), "introduced_not_in_mutated"),
    ]
    declared = j.select(*of, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))).alias("error"))
    silent = b.join(m, of).join(changes.select(*of).distinct(), of, "left_anti").where("bp = mp and bt <> mt").select(*of, F.lit("undeclared_change").alias("error"))
    return declared.unionByName(silent)


def adversarial_suite(variants: DataFrame) -> DataFrame:
    """Variants and whether all pass; ``variants`` has pair_id and passed. An empty suite passes."""
    return variants.agg(F.count("*").alias("pairs"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


#: Buckets of labels that no fact matched, the decisive first.
TRIAGE = ("surfaced_but_not_matched", "critic_rejected", "verifier_rejected", "executor_rejected", "dedup_merged_then_lost", "reconciler_rejected", "no_outcome")


def triage_missing(labels: DataFrame, matched: DataFrame, fates: DataFrame) -> DataFrame:
    """Why each missing label is missing. ``fates`` has doc_id, category, field, value and fate (of
    TRIAGE) of every candidate; the most decisive fate among candidates of the label's key decides,
    and ``near`` counts candidates of its slot where none has its value."""
    gone = labels.join(matched.where("status = 'missing'").select("expected_id"), "expected_id")
    k = lambda df, *extra: df.select(*extra, "doc_id", folded(F.col("category")).alias("c"), folded(F.col("field")).alias("f"), folded(F.col("value")).alias("v"))
    rank = F.array_position(F.array(*[F.lit(x) for x in TRIAGE]), F.col("fate"))
    by = k(fates.withColumn("rank", rank), "rank").groupBy("doc_id", "c", "f", "v").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    near = by.groupBy("doc_id", "c", "f").agg(F.sum("n").alias("near"))
    j = k(gone, "expected_id").join(by.select("doc_id", "c", "f", "v", "rank"), ["doc_id", "c", "f", "v"], "left").join(near, ["doc_id", "c", "f"], "left")
    name = F.when(F.col("rank").isNull(), "no_candidate").otherwise(F.get(F.array(*[F.lit(x) for x in TRIAGE]), (F.col("rank") - 1).cast("int")))
    return j.select("expected_id", name.alias("bucket"), F.when(F.col("rank").isNull(), F.coalesce("near", F.lit(0))).otherwise(0).cast("long").alias("near"))


def span_shapes(labels: DataFrame, matched: DataFrame, found: DataFrame) -> DataFrame:
    """How the span of each match at another place lies to its label's: narrower, wider, disjoint, shifted."""
    m = matched.where("status = 'matched'").select("expected_id", F.col("data_point_id").alias("candidate_id"))
    l = labels.select("expected_id", F.col("start_char").alias("ls"), F.col("end_char").alias("le"))
    j = m.join(l, "expected_id").join(found.select("candidate_id", "start_char", "end_char"), "candidate_id")
    s, e, ls, le = (F.col(c) for c in ("start_char", "end_char", "ls", "le"))
    shape = F.when((s >= ls) & (e <= le), "narrower").when((s <= ls) & (e >= le), "wider").when((e <= ls) | (s >= le), "disjoint").otherwise("shifted")
    return j.select("expected_id", "candidate_id", shape.alias("shape"))


# Schema fit


def schema_fit(documents: DataFrame, schemas: DataFrame, least_coverage: float = 0.8, fallback: bool = False) -> DataFrame:
    """Exactly one fitting schema is reused; else planning falls back, or refuses with codes.

    ``documents`` has doc_id, document_class, hints and confidence; ``schemas``, a registry's few
    rows, schema_id, document_class and hints. A schema is a candidate if the class is its own and
    all its hints are given; it fits if the confidence reaches the least coverage.
    """
    s = schemas.select("schema_id", F.col("document_class").alias("s_class"), F.coalesce("hints", F.array().cast("array<string>")).alias("s_hints"))
    given = F.coalesce("hints", F.array().cast("array<string>"))
    on = (F.col("document_class") == F.col("s_class")) & (F.size(F.array_except("s_hints", given)) == 0)
    j = documents.join(F.broadcast(s), on, "left")
    g = j.groupBy("doc_id", "document_class", "confidence").agg(F.count("schema_id").alias("candidates"), F.min("schema_id").alias("one"))
    fits = F.when(F.col("confidence") >= least_coverage, F.col("candidates")).otherwise(0)
    code = (
        F.when((F.col("candidates") == 0) & (F.col("document_class") == "unknown_document"), "document_out_of_scope")
        .when(F.col("candidates") == 0, "no_approved_schema_candidates").when(fits > 1, "ambiguous_schema_candidates").otherwise("coverage_below_threshold")
    )
    decision = F.when(fits == 1, "reuse").otherwise("generate" if fallback else "refuse")
    return g.select("doc_id", decision.alias("decision"), F.when(fits == 1, F.col("one")).alias("schema_id"), F.col("candidates"), F.when((fits != 1) & F.lit(not fallback), code).alias("code"))
