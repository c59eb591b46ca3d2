"""Inputs of the registered queries that the tables do not hold: plans, replayed verdicts, labels,
second runs. All follow from row values, so that SQL can make the same; no operator uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import documents as D
from .operators import facts as X

CHUNK = (200, 20)
#: Slots of the sample plan: all the lenses' but a field and a category.
PLAN = tuple(sorted({(x[1], x[2]) for x in X.LENSES} - {("Reference", "reference"), ("Identifier", "email")}))


def plan_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLAN), "category string, field string")


def chunked(docs: DataFrame) -> DataFrame:
    return D.chunks(docs, *CHUNK, keep=("source",))


def scored(facts: DataFrame) -> DataFrame:
    """Confidences to calibrate and bucket by."""
    return facts.withColumn("confidence", F.round(F.pmod(F.col("doc_id") * 7 + F.col("ordinal") * 3, F.lit(100)) / 100, 2))


def verdicts(c: DataFrame) -> DataFrame:
    """Replayed critic verdicts: some missing, some given twice, some of unknown candidates, rejects
    that checks contradict or do not, and corrections of every kind."""
    h = F.pmod(F.col("doc_id") * 3 + F.col("ordinal"), F.lit(11))
    s = lambda x: F.lit(x).cast("string")
    long = F.lit(None).cast("long")
    decision = F.when(h < 2, "reject").when(h < 7, "correct").otherwise("accept")
    code = F.when((h == 0) & (F.col("ordinal") % 2 == 0), "invalid_source_offsets").when(h == 0, "critic_rejected").when(h == 1, "category_not_approved")
    shorter = F.expr("substring(value, 1, length(value) - 1)")
    value = F.when(h == 3, shorter).when(h == 5, F.concat("value", F.lit(" extraordinary")))
    text = F.when(h == 3, shorter).when(h == 4, F.concat("value", F.lit(" zzzz zz")))
    own = c.where(h != 7).select(
        "candidate_id", F.lit(0).alias("pos"), decision.alias("decision"), code.alias("code"), s(None).alias("evidence"), value.alias("new_value"), s(None).alias("new_category"),
        F.when(h == 2, "other").alias("new_field"), long.alias("new_start"), text.alias("new_text"),
    )
    blank = [s(None).alias(n) for n in ("evidence", "new_value", "new_category", "new_field")]
    again = c.where("ordinal % 5 = 0").select("candidate_id", F.lit(1).alias("pos"), F.lit("reject").alias("decision"), F.lit("critic_rejected").alias("code"), *blank, long.alias("new_start"), s(None).alias("new_text"))
    unknown = c.where(h == 3).select(F.concat(F.lit("unknown-"), "candidate_id").alias("candidate_id"), F.lit(0).alias("pos"), F.lit("accept").alias("decision"), s(None).alias("code"), *blank, long.alias("new_start"), s(None).alias("new_text"))
    return own.unionByName(again).unionByName(unknown)


def verifier_verdicts(c: DataFrame) -> DataFrame:
    h = F.pmod(F.col("doc_id") * 5 + F.col("ordinal"), F.lit(7))
    code = F.when(h == 1, "invented_span").when(h == 2, "verifier_rejected").when(h == 3, "schema_violation")
    return c.where(h != 0).select("candidate_id", F.lit(0).alias("pos"), F.when(code.isNull(), "accept").otherwise("reject").alias("decision"), code.alias("code"))


def labels_of(facts: DataFrame) -> DataFrame:
    """Labels made from facts: some left out, some with another value or place, some twice."""
    o = F.col("ordinal")
    value = F.when((F.pmod("doc_id", F.lit(5)) == 0) & (o == 0), F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    moved = F.when(F.pmod(o, F.lit(3)) == 1, 1).otherwise(0)
    one = facts.where("ordinal % 6 <> 5").select(
        F.concat(F.lit("exp-"), "candidate_id").alias("expected_id"), "doc_id", "category", "field", value.alias("value"), F.col("value").alias("source_text"),
        (F.col("start_char") + moved).alias("start_char"), (F.col("end_char") + moved).alias("end_char"), "start_byte", "end_byte", "ordinal",
    )
    twice = one.where("ordinal % 7 = 2").withColumn("expected_id", F.concat(F.lit("dup-"), "expected_id"))
    return one.unionByName(twice).drop("ordinal")


def reports(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two runs of one fact a document and field but for documents of residue 5 modulo 7, whose facts
    all stand; the second lacks documents, adds a field, and changes value, place and confidence."""
    d = F.pmod(F.col("doc_id"), F.lit(7))
    base = facts.where((F.col("ordinal") == 0) | (d == 5)).select("doc_id", "category", "field", "value", "start_char", "end_char", "confidence", "candidate_id")
    new = base.where(d != 0).withColumn("value", F.when(d == 1, F.concat(F.lit("new "), "value")).otherwise(F.col("value")))
    new = new.withColumn("start_char", F.when(d == 2, F.col("start_char") + 1).otherwise(F.col("start_char")))
    new = new.withColumn("confidence", F.when(d == 3, F.col("confidence") + 1).otherwise(F.col("confidence")))
    extra = base.where(d == 4).withColumn("field", F.concat(F.lit("extra_"), "field"))
    return base, new.unionByName(extra)


def calls(events: DataFrame) -> DataFrame:
    """Call logs: the kinds of events as stages, values as tokens."""
    stage = F.when(F.col("event_type") == "click", "critic").when(F.col("event_type") == "view", "verifier").otherwise(F.col("event_type"))
    n = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    return events.select(stage.alias("stage"), n.alias("input_tokens"), F.expr("event_id % 97").cast("long").alias("output_tokens"), F.expr("event_id % 5").cast("long").alias("cache_read_tokens"), F.expr("event_id % 3").cast("long").alias("cache_creation_tokens"))


def run_events(events: DataFrame) -> DataFrame:
    """Users as runs; each event moves a run to a status by its number."""
    k = F.pmod(F.col("event_id") * 7, F.lit(5)).cast("int")
    status = F.element_at(F.array(*[F.lit(s) for s in ("created", "running", "completed", "failed", "refused")]), k + 1)
    return events.select(F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status"))


def runs_of(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Run manifests: labelled documents have one, good quality is a completed run, toxic ones lack
    a schema, and documents of residue 0 modulo 9 were lost."""
    g = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return g.select("doc_id", (F.col("q") == 1).alias("completed"), (F.pmod("doc_id", F.lit(9)) != 0).alias("has_document"), (F.col("t") != 1).alias("has_schema"))


def groups_of(rule: DataFrame) -> DataFrame:
    """A model's groups: every fourth rule group left out, and the first one's source used again."""
    return rule.where("group_pos % 4 <> 0").unionByName(
        rule.where("group_pos = 1").select("doc_id", F.lit(100000).cast("long").alias("group_pos"), "source_id", F.array("source_id").alias("member_ids"))
    )


def headed(docs: DataFrame) -> DataFrame:
    """Documents whose short lines are headings with a mark."""
    return docs.withColumn("text", F.regexp_replace("text", "(?m)^([^\n]{1,60})$", "# $1"))


def contracted(docs: DataFrame) -> DataFrame:
    """Two documents of three with sentences of a contract behind their text, made from their row."""
    k = F.pmod("doc_id", F.lit(3))
    who = F.when(k == 1, "Contractor").otherwise("Manufacturer")
    more = F.concat(
        F.lit("\n\nThis is agreed; the "), who, F.lit(" must deliver "), F.col("doc_id").cast("string"), F.lit(" units to Wholesalers, unless "), F.coalesce("source", F.lit("nobody")),
        F.lit(" is closed; it shall pay 5 € é. Notwithstanding this, "), who, F.lit("s of "), F.coalesce("lang", F.lit("xx")), F.lit(" work with Wholesalers and Distributors, Electricians, except for holidays. \"Units\" means goods of "),
        F.coalesce("source", F.lit("nobody")), F.lit("; on 5 May 2026 the Board approved them at 10:30 am. Report of it! Éa began"),
    )
    return docs.withColumn("text", F.when(k == 0, F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), more)))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def claims_of(facts: DataFrame) -> DataFrame:
    """Claims of what facts say, eight kinds by document and ordinal: moved by the document's number
    modulo 3; with outer blanks; in capitals; with two blanks for one; of a value that stands nowhere;
    of a field that headings decide, from 40 characters before; far out of the chunk; without length."""
    h = F.pmod(F.col("doc_id") + F.col("ordinal"), F.lit(8))
    value = (
        F.when(h == 1, F.concat(F.lit(" "), "value", F.lit(" "))).when(h == 2, F.translate("value", LETTERS, LETTERS.upper()))
        .when(h == 3, F.replace("value", F.lit(" "), F.lit("  "))).when(h == 4, F.concat("value", F.lit("zq"))).otherwise(F.col("value"))
    )
    start = F.when(h == 5, F.col("start_char") - 40).when(h == 6, F.col("start_char") + 1_000_000).otherwise(F.col("start_char") + F.pmod("doc_id", F.lit(3)))
    return facts.select(
        F.col("candidate_id").alias("claim_id"), "chunk_id", "doc_id", "lens", "category", F.when(h == 5, "metric_name").otherwise(F.col("field")).alias("field"), "ordinal", value.alias("value"),
        start.alias("start_char"), F.when(h == 7, 0).otherwise(F.length("value")).cast("long").alias("length"), "confidence",
    )


def chained(c: DataFrame) -> DataFrame:
    """Merges of duplicates, and of survivors of one document, lens, field and key into the one before."""
    twice = X.dedup(c).where("candidate_id <> primary_id").select("candidate_id", "primary_id")
    before = F.lag("candidate_id").over(W.partitionBy(*X.KEY).orderBy("candidate_id"))
    again = X.survivors(c).withColumn("primary_id", before).where("primary_id is not null").select("candidate_id", "primary_id")
    return twice.unionByName(again)


def mutations(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes and report values: documents as mutations; each first fact of a field is retired in
    favour of the same with an x, and the report has changed where the ordinal count says so."""
    first = facts.where("ordinal = 0")
    changes = first.select(F.col("doc_id").alias("mutation_id"), F.col("candidate_id").alias("expected_id"), F.concat(F.lit("<"), "value", F.lit(">")).alias("retired"), F.concat(F.lit("["), "value", F.lit("]")).alias("introduced"))
    h = F.pmod(F.col("doc_id") + F.length("value"), F.lit(4))
    value = F.when(h == 0, F.concat(F.lit("old <"), "value", F.lit(">"))).when(h == 1, F.concat(F.lit("both <"), "value", F.lit("> ["), "value", F.lit("]"))).otherwise(F.concat(F.lit("NEW ["), F.upper("value"), F.lit("]")))
    return changes, first.select(F.col("doc_id").alias("mutation_id"), value.alias("value"))


SCHEMAS = (("s1", "en", ["src0"]), ("s2", "de", []), ("s3", "de", ["src1"]), ("s4", "fr", ["src2"]), ("s5", "fr", ["src9"]))


def schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCHEMAS), "schema_id string, document_class string, hints array<string>")


def classified(docs: DataFrame) -> DataFrame:
    """Languages as document classes, sources as hints, and a confidence of the length."""
    kind = F.when(F.col("lang") == "es", "unknown_document").otherwise(F.coalesce("lang", F.lit("unknown_document")))
    sure = F.when(F.pmod("doc_id", F.lit(10)) == 3, 0.5).otherwise(0.9)
    return docs.select("doc_id", kind.alias("document_class"), F.array("source", F.lit("any")).alias("hints"), sure.alias("confidence"))


def chain_rows(events: DataFrame) -> DataFrame:
    """Events as payloads of one chain a user."""
    return events.select("user_id", "ts", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))


def tampered_chain(records: DataFrame) -> DataFrame:
    """Stored records as they were written, but for changes by seq and user: payloads, hashes of payloads and
    chain hashes altered, records taken out or given twice, seqs lost, and chains begun elsewhere."""
    m = F.pmod(F.col("seq") * 7 + F.col("user_id"), F.lit(61))
    x = lambda c, hit: F.when(hit, F.concat(F.col(c), F.lit("x"))).otherwise(F.col(c)).alias(c)
    start = F.when((F.col("seq") == 0) & (F.col("user_id") % 9 == 4), "1" * 64).otherwise(F.col("previous_hash")).alias("previous_hash")
    kept = records.where(m != 3).withColumn("m", m)
    copies = kept.select("*", F.explode(F.when(F.col("m") == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    m = F.col("m")
    return copies.select("user_id", F.when(m != 40, F.col("seq")).alias("seq"), x("payload", m == 17), x("payload_hash", m == 23), start, x("chain_hash", m == 29))


#: Replies to batches, by doc_id modulo their number; I and J stand for two ids of the document.
REPLIES = (
    '{"groups":[["I",["I","J"]]],"rejected":[]}',
    '{"groups":[["I","I"]],"rejected":["J"]}',
    '{"groups":"[[\\"I\\",[\\"I\\"]]]","rejected":"[[\\"J\\"]]"}',
    '"{\\"groups\\":[[\\"J\\",[\\"I\\",\\"J\\"]]],\\"rejected\\":[]}"',
    '{"groups":[["I",["J"]]],"rejected":[]}',
    '{"groups":[["I",["I","I"]]],"rejected":[]}',
    '{"groups":[],"rejected":[["J","invented_span"],"J"]}',
    '{"groups":[],"rejected":[["J","made_up"]]}',
    '{"groups":[["I"]],"rejected":[]}',
    "nope",
    '{"groups":[]}',
    "[1,2]",
    '{"groups":[["I",["I",5]]],"rejected":[]}',
    '{"groups":[["I",["I"]],["J","J"]],"rejected":[["e","schema_violation"],["f"]]}',
    '{"groups":[],"rejected":[],"more":1}',
    '{"groups":[],"rejected":[""]}',
    '{"groups":"nope","rejected":[]}',
)


def replies(docs: DataFrame) -> DataFrame:
    shapes = F.array(*[F.lit(x) for x in REPLIES])
    payload = F.get(shapes, F.pmod("doc_id", F.lit(len(REPLIES))).cast("int"))
    for name, letter in (("I", "c"), ("J", "d")):
        payload = F.replace(payload, F.lit(name), F.concat(F.lit(letter), F.col("doc_id").cast("string")))
    return docs.select("doc_id", payload.alias("payload"))


def worded(docs: DataFrame) -> DataFrame:
    """Lines as pages with the words a reader of pages would give: two of three, in their order; of some
    lines a last one that stands nowhere. Lines without words have no row."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))
    ws = F.filter(F.array_remove(F.split("text", " ", -1), ""), lambda w, i: i % 3 != 2)
    strange = (F.pmod("doc_id", F.lit(7)) == 5) & (F.col("line_no") % 3 == 1)
    words = F.concat(ws, F.when(strange, F.array(F.lit("zqzq9"))).otherwise(F.array().cast("array<string>")))
    # Asked of the text: asked of the words, these would be made twice.
    return lines.where(strange | (F.trim("text") != "")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", words.alias("words"))


def celled(docs: DataFrame) -> DataFrame:
    """The same words as cells of tables of three columns."""
    last = F.floor((F.size("words") - 1) / 3).cast("int")
    rows = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words", k * 3 + 1, F.lit(3)))
    return worded(docs).withColumn("cells", rows).drop("words")


#: Replies of candidates by row: attempt, milliseconds after the asking (an attempt has 100), pos, decision, fault.
ROUNDS = (
    (),
    ((1, 5, 0, "accept", None),),
    ((1, 5, 0, "reject", "no_code"), (2, 9, 0, "accept", None)),
    ((1, 5, 0, "maybe", "unknown_decision"), (1, 6, 0, "accept", None)),
    ((1, 200, 0, "accept", None),),
    ((1, 400, 0, "accept", None), (3, 301, 0, "accept", None)),
    ((1, 5, 0, "maybe", "unknown_decision"), (2, 10, 0, "reject", "no_code"), (3, 15, 0, "reject", "unknown_code"), (3, 16, 0, "accept", None)),
    ((1, 5, 0, "maybe", "unknown_decision"), (3, 7, 0, "correct", None)),
    ((1, 5, 0, "maybe", "unknown_decision"), (2, 3, 0, "reject", "no_code"), (2, 50, 0, "accept", None)),
    ((4, 5, 0, "accept", None),),
    ((1, 5, 1, "accept", None), (1, 5, 0, "reject", None), (1, 5, 0, "reject", None)),
    ((2, 120, 0, "reject", "no_code"), (1, 150, 0, "accept", None)),
    ((1, 100, 0, "reject", "no_code"), (2, 200, 0, "accept", None)),
)
ATTEMPTS, PATIENCE = 3, 100


def asked_of(facts: DataFrame) -> DataFrame:
    return facts.select("candidate_id", (F.col("doc_id") * 1000).alias("at"))


def answers_of(facts: DataFrame) -> DataFrame:
    """Replies of every kind, and of ids that nobody asked."""
    s = lambda x: F.lit(x).cast("string")
    reply = lambda k, at, pos, said, fault: F.struct(F.lit(k).alias("attempt"), F.lit(at).alias("after"), F.lit(pos).alias("pos"), s(said).alias("decision"), s(fault).alias("fault"))
    none = F.array().cast("array<struct<attempt: int, after: int, pos: int, decision: string, fault: string>>")
    shapes = [F.array(*[reply(*x) for x in one]) if one else none for one in ROUNDS]
    h = F.pmod(F.col("doc_id") * 3 + F.col("ordinal"), F.lit(len(ROUNDS)))
    of = none
    for i, shape in enumerate(shapes):
        of = F.when(h == i, shape).otherwise(of)
    name = F.when(F.col("ordinal") % 11 == 7, F.concat(F.lit("unknown-"), "candidate_id")).otherwise(F.col("candidate_id"))
    each = facts.select(name.alias("candidate_id"), "doc_id", F.explode(of).alias("x"))
    code = F.when(F.col("x.decision") == "reject", "critic_rejected")
    return each.select("candidate_id", "x.attempt", (F.col("doc_id") * 1000 + F.col("x.after")).alias("at"), "x.pos", "x.decision", code.alias("code"), "x.fault")
