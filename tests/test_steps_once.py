"""Steps that read their input once, and carry no text where none is needed."""

from pyspark.sql import functions as F

from spanloom.functions import arrays as A
from spanloom.functions import text as T
from spanloom.operators import claims as C
from spanloom.operators import clauses as K
from spanloom.operators import layout as L
from spanloom.operators import policies as P
from spanloom.operators import review as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_summaries_read_rejections_once(spark):
    none = spark.createDataFrame([], "stage string, candidate_id string, codes array<string>")
    assert R.drop_summary(none).collect() == [(None, None, 0)]
    x = spark.createDataFrame([("a", "1", ["p", "q"]), ("a", "2", ["p"]), ("b", "1", []), ("b", "3", [None]), ("b", "4", None)], none.schema)
    assert plan(R.drop_summary(x)).count("LogicalRDD") == 1
    got = sorted(map(tuple, R.drop_summary(x).collect()), key=str)
    assert got == sorted([("a", "p", 2), ("a", "q", 1), ("b", None, 1), ("a", None, 3), ("b", None, 1), (None, None, 5)], key=str)


def test_candidates_are_made_distinct_before_they_meet_the_text(spark):
    c = spark.createDataFrame([], "candidate_id string, doc_id long, chunk_id string, category string, field string, value string, source_text string, start_char long, end_char long, start_byte long, end_byte long")
    chunks = spark.createDataFrame([], "chunk_id string, text string, start_char long, start_byte long")
    got = P.checked(c, chunks, spark.createDataFrame([], "category string, field string"))
    for line in plan(got).splitlines():
        assert not ("Aggregate" in line and "candidate_id" in line and "chunk_text" in line), line


def test_edges_are_those_of_the_pattern(spark):
    x = spark.range(0x20, 0x3100).union(spark.range(1, 0x20)).selectExpr("cast(id as int) as i").where("i not between 55296 and 57343")
    s = F.concat(F.lit("a "), F.expr("decode(unhex(lpad(hex(i), 8, '0')), 'UTF-32')"))
    both = F.concat(F.expr("decode(unhex(lpad(hex(i), 8, '0')), 'UTF-32')"), s)
    old = F.regexp_replace(both, f"(?U)^{T.SPACE}+|{T.SPACE}+$", "")
    assert x.where(~(T.strip(both) == old)).count() == 0


def test_phrases_are_looked_for_in_words_taken_once(spark):
    x = spark.createDataFrame([("About  5",), ("5 roundabout",), ("up",), ("",), (None,), ("no more-than 3",)], "v string")
    got = x.select(T.has_qualifier(T.tokens(F.col("v"))).alias("q"))
    assert [r["q"] for r in got.collect()] == [True, False, True, False, None, True]
    assert plan(got).count("regexp_extract_all") == 1


def test_sentence_lenses_shuffle_no_text(spark):
    docs = spark.createDataFrame([(1, "# A heading shall not. If it must, unless not, it stays.\n\nIf so. Mr. Bb must go, if asked.", "s")] * 2 + [(2, "If", None), (None, "If so.", "s")], "doc_id long, text string, source string")
    got = K.clauses(docs, "condition")
    assert sorted((r["doc_id"], r["ordinal"], r["value"], r["start_char"]) for r in got.collect()) == [(1, 0, "If it must", 23), (1, 1, "unless not", 35), (1, 2, "If so.", 58), (1, 3, "if asked.", 81), (2, 0, "If", 0)]
    for df in (got, K.relations(docs)):
        p = plan(df)
        assert "Join" not in p and p.count("regexp_replace(") > 0 and not any("Aggregate" in x and "text#" in x for x in p.splitlines())
        # No filter repeats the search for cues or entities.
        assert not any(x.strip(" :+-").startswith("Filter") and "size(" in x for x in p.splitlines())


def test_sums_of_long_arrays(spark):
    x = spark.range(1).select(A.running_sums(F.sequence(F.lit(1), F.lit(500_000))).alias("s"), F.expr(A.running_sums_sql("sequence(1, 300)")).alias("t"))
    r = x.select(F.size("s").alias("n"), F.element_at("s", -1).alias("last"), "t").first()
    assert (r["n"], r["last"]) == (500_000, 499_999 * 250_000) and r["t"] == [k * (k + 1) // 2 for k in range(300)]


def test_packing_holds_one_document_at_a_time(spark):
    line = "a line of more words than eight, to é be none\n"
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 3, None).otherwise(F.repeat(F.lit(line), 60)).alias("text"))
    got = L.packed_chunks(L.line_layout(docs.coalesce(1)), 11)
    assert "MapInArrow" in plan(got) and "MapInPandas" not in plan(got)
    r = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_byte").alias("e"), F.count("error").alias("bad")).collect()
    assert len(r) == 39 and {(x["n"], x["e"], x["bad"]) for x in r} == {(60, 60 * len(line.encode()), 0)} and 39 * 60 > 2 * L.FEW


def test_keys_of_many_values(spark):
    x = spark.range(3 * T.FEW).coalesce(1).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit(" ﬁ É  "), F.col("id"))).alias("v"), "id")
    got = x.select(T.canonical_key(F.col("v")).alias("k"), "id")
    assert "pandas" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert all(r["k"] == (f"fi é {r['id']}" if r["id"] % 7 else None) for r in got.collect())


def test_resolved_claims_are_read_from_what_was_written(spark):
    r = spark.createDataFrame([("c", "k", "metric_name", "v", 0, "v", 0, [])], "claim_id string, chunk_id string, field string, value string, resolved_start long, source_text string, start_byte long, codes array<string>")
    chunks = spark.createDataFrame([("k", 1, "v", 0, 0)], "chunk_id string, doc_id long, text string, start_char long, start_byte long")
    out = C.normalize(r.withColumn("chunk_start", F.lit(0).cast("long")).withColumn("chunk_byte", F.lit(0).cast("long")), chunks)
    assert out.count() == 1 and plan(out).count("LogicalRDD") == 1
