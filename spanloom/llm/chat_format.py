r"""Chat formatting with Spark expressions only.

Turn rows are collected per conversation, sorted by (turn, role, text), adjacent turns of one
role are merged into one block by array aggregation, and blocks are concatenated into one
string. Each part of a block keeps its own text mark, so :func:`read_back` restores every turn.

Template: a block is ``### role:``, its parts, and ``</turn>`` with a line end; a part is the mark
``<part>`` and the escaped text. Escaping is reversible: a backslash becomes two, ``#`` becomes
``\h`` and ``<`` becomes ``\l`` in texts and roles, so no mark of the template, each of which
holds one of these characters, can occur there.

A conversation is one string, so one task holds all its turns; that is what the result asks for.
Work is linear in the string's length: offsets are summed in stretches of 256 pieces, and masked
texts are cut from a form of four bytes a code point, where a place is found without counting.

Defined results: null text is empty, null role is the role ``unknown``; rows without conv_id
form one conversation with a null id; equal rows are all kept; equal turns are ordered by
role and text; very long texts and conversations are formatted whole; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.arrays import let, running_sums

#: The template's marks: before and behind a block's role, before a part, behind a block.
HEAD, OPEN, PART, END = "### ", ":", "<part>", "</turn>\n"


def escape(text: Column) -> Column:
    r"""``\`` to ``\\``, ``#`` to ``\h``, ``<`` to ``\l``: no control string survives in a text."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    r"""Inverse of :func:`escape`: split at doubled backslashes, so ``\\h`` is not read as ``\h``."""
    plain = F.transform(
        F.split(text, "\\\\\\\\", -1),
        lambda x: F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")),
    )
    return F.array_join(plain, "\\")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, and loss_spans: [start, end) code points of trained texts."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Merge: a turn opens a block where the role before it differs; else it adds a part.
    pieces = F.transform(
        F.col("ts"),
        lambda t, i: let(
            F.struct(
                ((i == 0) | (F.get(F.col("ts"), i - 1)["role"] != t["role"])).alias("opens"),
                ((i == F.size("ts") - 1) | (F.get(F.col("ts"), i + 1)["role"] != t["role"])).alias("closes"),
                escape(t["role"]).alias("role"),
                escape(t["text"]).alias("body"),
            ),
            lambda p: F.struct(
                F.concat(F.when(p["opens"], F.concat(F.lit(HEAD), p["role"], F.lit(OPEN))).otherwise(F.lit("")), F.lit(PART)).alias("before"),
                p["body"].alias("body"),
                F.when(p["closes"], F.lit(END)).otherwise(F.lit("")).alias("after"),
                (t["role"] == trained_role).alias("trained"),
            ),
        ),
    )
    laid = sorted_turns.select("conv_id", pieces.alias("ps"))
    size = lambda p: (F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).cast("long")
    laid = laid.withColumn("at", running_sums(F.transform("ps", size)))

    def span(p: Column, i: Column) -> Column:
        start = F.get(F.col("at"), i) + F.length(p["before"])
        return F.when(p["trained"], F.struct(start.cast("long").alias("start"), (start + F.length(p["body"])).cast("long").alias("end")))

    return laid.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.array_compact(F.transform("ps", span)).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and turns (array of role, text), parsed from the formatted string alone."""
    blocks = let(F.split("formatted", END, -1), lambda bs: F.slice(bs, F.lit(1), F.size(bs) - 1))

    def turns_of(block: Column) -> Column:
        parts = F.split(block, PART, -1)
        return let(
            parts,
            lambda ps: let(
                unescape(F.substring(ps[0], F.lit(len(HEAD) + 1), F.length(ps[0]) - len(HEAD) - len(OPEN))),
                lambda role: F.transform(F.slice(ps, F.lit(2), F.size(ps) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))),
            ),
        )

    return formatted.select("*", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's digest columns, taken from the formatted strings and the loss mask."""
    back = read_back(formatted)
    # Four bytes a code point: a span is cut without counting from the string's start.
    wide = F.encode("formatted", "UTF-32")

    def text_of(raw: Column, s: Column) -> Column:
        return unescape(F.decode(F.substring(raw, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32"))

    masked = let(wide, lambda raw: F.array_join(F.transform("loss_spans", lambda s: text_of(raw, s)), ""))
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turn_text, 256).alias("turns_sha256"),
        masked.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table plus conversation -7, whose texts hold this template's look-alikes."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS v(conv_id, turn, role)")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra.withColumn("text", F.lit(odd)))


def oracle() -> str:
    """Digests straight from the rows, except the formatted length, rebuilt from the template."""
    esc = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '#', '\\h'), '<', '\\l')"
    return f"""WITH rows_ AS (
      SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
    marked AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    sums AS (SELECT conv_id, count(*) AS n_turns,
      string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length({esc('text')}) + 6 + CASE WHEN opens THEN length({esc('role')}) + 13 ELSE 0 END) AS chars
      FROM marked GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(all_) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM sums"""
