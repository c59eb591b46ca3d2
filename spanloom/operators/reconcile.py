"""Reconciliation: groups of candidates to facts, with every candidate accounted for.

Groups are rows (doc_id, group_pos, source_id, member_ids); candidates are accepted ones with
candidate_id, doc_id, category, field, value, source_text, the span offsets and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import canonical_key, folded, has_qualifier, is_label_field, stable_id, stems, strip, tokens, value_supported
from .policies import CODES

#: Tokens that scope a metric's name, and names of its role only.
SCOPED = ("annual", "fy", "full", "full-year", "fullyear", "q1", "q2", "q3", "q4", "quarter", "quarterly", "year", "year-end", "yearend")
GENERIC = ("guidance", "metric", "measure")


def specificity(candidate_id="candidate_id") -> Column:
    """Seven-part rank, least is best: unsupported last; labels by extra words of the span, then by
    shape; rates by qualifier; names and others by whether the span is the value; then the lengths
    of span and value, then the id."""
    value, span, field = F.col("value"), F.col("source_text"), F.col("field")
    words = F.filter(stems(span), lambda t: ~F.array_contains(stems(value), t))
    extra = F.size(words)
    same = folded(value) == folded(span)
    traced = is_label_field(field) & value_supported(value, span)
    label = F.struct(extra.alias("a"), F.when(~traced, 2).when(same, 1).otherwise(0).alias("b"), F.lit(0).alias("c"))
    rate_field = field.endswith("_pct") | field.endswith("_percentage") | field.endswith("_rate") | field.contains("exposure")
    span_q, value_q = has_qualifier(tokens(span)), has_qualifier(tokens(value))
    rate = F.struct(F.when(span_q & value_q, 0).when(span_q, 2).otherwise(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    both = F.array_distinct(F.concat(tokens(value), tokens(span)))
    scoped = F.arrays_overlap(both, F.array(*[F.lit(x) for x in SCOPED])) | F.exists(both, lambda t: t.rlike("^[0-9]{4}$"))
    generic = F.arrays_overlap(both, F.array(*[F.lit(x) for x in GENERIC]))
    guided = F.struct(F.when(scoped, 0).otherwise(1).alias("a"), generic.cast("int").alias("b"), (-F.size(tokens(value))).alias("c"))
    plain = F.struct(F.when(same, 0).otherwise(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    metric = (field == "metric_name") & (F.col("category") == "ForwardGuidance")
    part = F.when(is_label_field(field), label).when(rate_field, rate).when(metric, guided).otherwise(plain)
    return F.struct(
        F.when(value_supported(value, span), 0).otherwise(1).alias("unsupported"), part.alias("part"),
        F.length(span).alias("span"), F.length(value).alias("value"), F.col(candidate_id).alias("id"),
    )


def specificity_pick(facts: DataFrame) -> DataFrame:
    """Best source of every (category, field, key); the minimum is combined before the shuffle."""
    f = facts if "source_text" in facts.columns else facts.withColumn("source_text", F.col("value"))
    return f.withColumn("key", canonical_key(F.col("value"))).groupBy("category", "field", "key").agg(F.min_by("candidate_id", specificity()).alias("picked_id"))


def rule_groups(candidates: DataFrame) -> DataFrame:
    """Groups without a model: a document's candidates of one (category, field, canonical key)."""
    k = candidates.withColumn("key", canonical_key(F.col("value")))
    g = k.groupBy("doc_id", "category", "field", "key").agg(F.min("candidate_id").alias("source_id"), F.array_sort(F.collect_list("candidate_id")).alias("member_ids"))
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("category", "field", "key")).cast("long")
    return g.select("doc_id", pos.alias("group_pos"), "source_id", "member_ids")


def short_id(candidate_id: Column) -> Column:
    """The id a model sees: the first 12 hex digits behind the prefix."""
    return F.substring(F.regexp_replace(candidate_id, "^[a-z]+-", ""), 1, 12)


def decode_batches(replies: DataFrame, col: str = "payload", default_code: str = "reconciler_rejected") -> DataFrame:
    """A model's replies to whole batches: the rows with ``groups`` (source_id, member_ids), ``rejected``
    (candidate_id, code) and ``error``; a batch with an error has neither.

    A reply is an object with the lists ``groups`` and ``rejected``, and no other key. A reply, or
    either list, may be given as a JSON string. A group is ``[source, members]``, one member may
    stand without its list; a rejection is ``[id, code]``, or an id, alone or in a list, which takes
    the default code. Ids are strings that are not blank. The source is among its members;
    members of a group, and rejected ids, are distinct. Shapes are told by variant functions.
    """
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    opened = lambda v: F.when(kind(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    items = lambda v: F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    full = lambda x: F.coalesce(F.length(strip(x)) > 0, F.lit(False))

    got = opened(F.try_parse_json(F.col(col)))
    r = replies.withColumn("_got", got)
    r = r.withColumn("_keys", F.when(kind(F.col("_got")).startswith("OBJECT"), F.map_keys(F.try_variant_get("_got", "$", "map<string,variant>"))))
    for name in ("groups", "rejected"):
        r = r.withColumn(f"_{name}", items(opened(F.try_variant_get("_got", f"$.{name}", "variant"))))

    def group(v: Column) -> Column:
        two = lambda xs: F.struct(F.when(F.size(xs) == 2, text(F.get(xs, F.lit(0)))).alias("source_id"), F.when(F.size(xs) == 2, members(F.get(xs, F.lit(1)))).alias("member_ids"))
        return let(items(v), two)

    def members(v: Column) -> Column:
        return F.when(kind(v) == "STRING", F.array(text(v))).otherwise(F.transform(items(v), text))

    def rejection(v: Column) -> Column:
        def listed(xs: Column) -> Column:
            name = F.when(F.size(xs).between(1, 2), text(F.get(xs, F.lit(0))))
            return F.struct(F.coalesce(text(v), name).alias("candidate_id"), F.when(F.size(xs) == 2, text(F.get(xs, F.lit(1)))).otherwise(default_code).alias("code"))

        return let(items(v), listed)

    r = r.withColumn("groups", F.transform("_groups", group)).withColumn("rejected", F.transform("_rejected", rejection))
    bad_group = F.exists("groups", lambda g: ~full(g["source_id"]) | g["member_ids"].isNull() | F.exists(g["member_ids"], lambda m: ~full(m)))
    repeated = lambda xs: F.size(F.array_distinct(xs)) < F.size(xs)
    error = (
        F.when(F.col("_got").isNull(), "not_json")
        .when(F.col("_keys").isNull(), "not_object")
        .when(F.exists("_keys", lambda k: ~k.isin("groups", "rejected")), "unknown_key")
        .when(F.col("groups").isNull(), "groups_not_list")
        .when(F.col("rejected").isNull(), "rejected_not_list")
        .when(bad_group, "bad_group")
        .when(F.exists("rejected", lambda x: ~full(x["candidate_id"])), "bad_rejection")
        .when(F.exists("rejected", lambda x: ~F.coalesce(x["code"].isin(*CODES), F.lit(False))), "unknown_code")
        .when(F.exists("groups", lambda g: ~F.array_contains(g["member_ids"], g["source_id"])), "source_not_member")
        .when(F.exists("groups", lambda g: repeated(g["member_ids"])), "members_repeated")
        .when(repeated(F.transform("rejected", lambda x: x["candidate_id"])), "rejected_repeated")
    )
    r = r.withColumn("error", error)
    sound = [F.when(F.col("error").isNull(), F.col(n)).alias(n) for n in ("groups", "rejected")]
    return r.select(*[c for c in replies.columns if c not in ("groups", "rejected", "error")], *sound, "error")


def batch_groups(decoded: DataFrame) -> DataFrame:
    """Groups of sound batches, for :func:`expand_ids` and :func:`assess_groups`; positions from 1."""
    each = decoded.select("doc_id", F.posexplode("groups").alias("at", "g"))
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("group_pos"), "g.source_id", "g.member_ids")


def batch_rejections(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.explode("rejected").alias("x")).select("doc_id", "x.candidate_id", "x.code")


def input_runs(points: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """The distinct runs (run_id, doc_id) that facts of several documents come from: those of the
    manifests where there are any, else those of the facts. Rows without run are left out."""
    said = points if manifests is None or manifests.isEmpty() else manifests
    return said.where("run_id is not null").select("run_id", "doc_id").distinct()


def expand_ids(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Short ids of groups back to full ones; an id that stays short is unknown, and one that two
    candidates of a document share is an error row (``collision``)."""
    names = candidates.select("doc_id", short_id(F.col("candidate_id")).alias("s"), F.col("candidate_id").alias("full")).groupBy("doc_id", "s").agg(F.min("full").alias("full"), F.count_distinct("full").alias("n"))
    each = groups.select("doc_id", "group_pos", F.posexplode(F.concat(F.array("source_id"), "member_ids")).alias("at", "s"))
    j = each.join(names, ["doc_id", "s"], "left").withColumn("id", F.coalesce("full", "s"))
    back = j.groupBy("doc_id", "group_pos").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("ids"), F.max("n").alias("n"))
    ids = F.transform("ids", lambda x: x["id"])
    return back.select("doc_id", "group_pos", ids[0].alias("source_id"), F.slice(ids, F.lit(2), F.size(ids) - 1).alias("member_ids"), (F.coalesce("n", F.lit(1)) > 1).alias("collision"))


def unknown_ids(groups: DataFrame, rejected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids that groups or rejections name and no candidate has."""
    named = groups.select("doc_id", F.explode(F.concat(F.array("source_id"), "member_ids")).alias("candidate_id"))
    named = named.unionByName(rejected.select("doc_id", "candidate_id")).distinct()
    return named.join(candidates.select("doc_id", "candidate_id"), ["doc_id", "candidate_id"], "left_anti")


def conflict_complaints(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Omitted candidates that a kept one of the same field contradicts (another key), with the kept
    ids. Per document and field; kept keys are made distinct first."""
    kept = groups.select("doc_id", F.explode(F.concat(F.array("source_id"), "member_ids")).alias("candidate_id")).distinct()
    k = candidates.select("doc_id", "candidate_id", "category", "field", canonical_key(F.col("value")).alias("key"))
    of = ["doc_id", "category", "field"]
    in_ = k.join(kept, ["doc_id", "candidate_id"], "left_semi").groupBy(*of, "key").agg(F.array_sort(F.collect_set("candidate_id")).alias("ids"))
    out = k.join(kept, ["doc_id", "candidate_id"], "left_anti").alias("o").join(in_.alias("i"), of).where("o.key <> i.key")
    g = out.groupBy("doc_id", "o.candidate_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("i.ids"))), ",").alias("kept_ids"))
    return g.select("doc_id", "candidate_id", "kept_ids")


def assess_groups(groups: DataFrame, candidates: DataFrame, plan_fields: DataFrame) -> DataFrame:
    """Every (group, member) with its group's source, slot and fault.

    The source is the best by :func:`specificity` among members of the model's pick's slot. A group
    falls whole if its slot is not in the plan, if a member is of another slot, or if a member
    stands in an earlier group, accepted or not: which the least position of a member tells.
    """
    rank = specificity()
    c = candidates.select("doc_id", "candidate_id", "category", "field", rank.alias("rank"))
    m = groups.select("doc_id", "group_pos", "source_id", F.explode(F.array_distinct("member_ids")).alias("candidate_id")).join(c, ["doc_id", "candidate_id"])
    m = m.withColumn("first_pos", F.min("group_pos").over(W.partitionBy("doc_id", "candidate_id")))
    pick = c.select("doc_id", F.col("candidate_id").alias("source_id"), F.col("category").alias("p_category"), F.col("field").alias("p_field"))
    m = m.join(pick, ["doc_id", "source_id"], "left")
    group = W.partitionBy("doc_id", "group_pos")
    alike = (F.col("category") == F.col("p_category")) & (F.col("field") == F.col("p_field"))
    m = m.withColumn("alike", F.coalesce(alike, F.lit(False)))
    m = m.withColumn("best_id", F.coalesce(F.min_by("candidate_id", F.when(F.col("alike"), F.col("rank"))).over(group), F.col("source_id")))
    slots = plan_fields.select(F.col("category").alias("p_category"), F.col("field").alias("p_field")).distinct().withColumn("planned", F.lit(True))
    m = m.join(F.broadcast(slots), ["p_category", "p_field"], "left")
    fault = F.when(F.col("planned").isNull(), "schema_violation").when(F.max((F.col("first_pos") < F.col("group_pos")).cast("int")).over(group) == 1, "reconciler_rejected")
    fault = fault.when(F.max((~F.col("alike")).cast("int")).over(group) == 1, "schema_violation")
    return m.select("doc_id", "group_pos", "candidate_id", "best_id", F.col("p_category").alias("category"), F.col("p_field").alias("field"), "first_pos", fault.alias("fault"))


def data_points(assessed: DataFrame, candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """A fact for each sound group: the best source's value and span, the least confidence of its
    members and of their reports' ``score`` (candidate_id, score), and its members."""
    member = candidates.select("doc_id", "candidate_id", "confidence").join(scores.select("candidate_id", "score"), "candidate_id", "left")
    g = assessed.where("fault is null").join(member, ["doc_id", "candidate_id"])
    g = g.groupBy("doc_id", "group_pos", "best_id", "category", "field").agg(
        F.least(F.min("confidence"), F.min("score")).alias("confidence"), F.array_join(F.array_sort(F.collect_set("candidate_id")), ",").alias("members")
    )
    best = candidates.select("doc_id", F.col("candidate_id").alias("best_id"), "value", "start_char", "end_char")
    out = g.join(best, ["doc_id", "best_id"])
    out = out.withColumn("decision_id", stable_id("decision-", *[F.col(c) for c in ("doc_id", "category", "field", "value", "best_id", "members")]))
    return out.withColumn("data_point_id", stable_id("dp-", *[F.col(c) for c in ("doc_id", "decision_id", "best_id", "value")]))


def unaccounted(assessed: DataFrame, rejected: DataFrame, candidates: DataFrame) -> DataFrame:
    """One rejection for every candidate in no sound group: its first group's fault, its explicit
    code, or ``reconciler_rejected`` where nothing names it."""
    first = assessed.groupBy("doc_id", "candidate_id").agg(
        F.count_if(F.col("fault").isNull()).alias("sound"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("group_pos"))).alias("fault")
    )
    said = rejected.groupBy("doc_id", "candidate_id").agg(F.min("code").alias("code"))
    j = candidates.select("doc_id", "candidate_id").join(first, ["doc_id", "candidate_id"], "left").join(said, ["doc_id", "candidate_id"], "left")
    # A member of a sound group that also stands in one that fell is rejected there as well.
    out = j.where((F.coalesce("sound", F.lit(0)) == 0) | F.col("fault").isNotNull())
    return out.select("doc_id", "candidate_id", F.coalesce("fault", "code", F.lit("reconciler_rejected")).alias("code"))


def mark_conflicts(points: DataFrame) -> DataFrame:
    """conflict_id on all facts of a (document, category, field) with two distinct keys or more."""
    k = points.withColumn("key", canonical_key(F.col("value")))
    of = W.partitionBy("doc_id", "category", "field")
    many = F.min("key").over(of) != F.max("key").over(of)
    keys = F.array_join(F.array_sort(F.collect_set("key").over(of)), "\n")
    return k.withColumn("conflict_id", F.when(many, stable_id("conf-", F.col("doc_id"), F.col("category"), F.col("field"), keys))).drop("key")


def source_refs(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with their document's hashes; a fact without document has status ``document_missing``."""
    d = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    j = points.join(d, "doc_id", "left")
    return j.withColumn("ref_status", F.when(F.col("text_sha256").isNull(), "document_missing").otherwise("ok"))
