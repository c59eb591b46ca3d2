"""Quality rules: a threshold table compiled into one Spark projection, no user functions.

Each rule is a row (name, metric, least, most); :func:`verdict` compiles the table into a
single boolean expression over the metrics of :func:`metrics`.

Defined results: null text counts as empty; an empty text has every count 0 and fails the
length rule; repeated rows give repeated result rows; an empty table gives an empty table;
extra columns of the input are ignored by :func:`evaluate` and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, let

#: Characters that separate words: space and U+0009 to U+000D.
BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it for on that with as was be by at this are or an from not "
    "der die das und ist von zu den mit ein eine auf für des dem sich im "
    "le la les de du et un une que pour qui est par sur dans avec en au "
    "el los las y del se para con una por no su al"
).split()
#: Also with a first capital and all in capitals, so that no text need be lower-cased.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """A metric's closed range; None leaves that side open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Wide on purpose: only text far from prose fails.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_share", 0.02, None),
    Rule("shouting", "exclamations_per_word", None, 0.3),
    Rule("dup_lines", "dup_line_share", None, 0.6),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK, -1), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows found twice or more.

    Windows are compared by a 64-bit hash of their three words (two different windows of one
    text agree with a chance below 1e-10 even at 50,000 words). Texts whose hashes are all
    distinct stop there; in others (hash, place) pairs are sorted and equal neighbours marked.
    """

    def covered(s: Column) -> Column:
        hits = F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)),
        )
        spread = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spread)).cast("long")

    def from_hashes(hs: Column) -> Column:
        paired = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(paired), covered)
        )

    def hashes(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(words, lambda ws: let(hashes(ws), from_hashes))
    )


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and ratios for every document, in one projection over the scan."""
    base = id_text(docs, id_col, text_col).select("doc_id", "text", words_of(F.col("text")).alias("_w"))
    return base.select("doc_id", *_measured(F.col("text"), F.col("_w"))).select("*", *_flat()).drop("_lines")


def _measured(text: Column, w: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        counted.alias("_lines"),
        _repeated(w).alias("n_repeat_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
    ]


def _flat() -> list[Column]:
    return [(F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"), F.col("_lines.n").cast("long").alias("n_lines")]


#: The ratios that rules refer to, as expressions over the counts.
def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_share": F.col("n_stop_words") / n,
        "exclamations_per_word": F.col("n_exclamations") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules=RULES) -> Column:
    """The table as one expression: true where every metric is within its range."""
    found, ok = ratios(), F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (found[r.metric] >= r.least)
        if r.most is not None:
            ok = ok & (found[r.metric] <= r.most)
    return ok


def evaluate(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, ratios, base_failed and kept."""
    m = metrics(docs, id_col, text_col)
    return m.select("*", *[c.alias(k) for k, c in ratios().items()], base_failed().alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def filter_documents(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The input's rows that pass, with exactly the input's columns; no join, no shuffle."""
    names = docs.columns
    inner = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    wide = docs.select(inner, text.alias("_text")).select("_row", "_text", words_of(F.col("_text")).alias("_w"))
    measured = wide.select("_row", *_measured(F.col("_text"), F.col("_w"))).select("*", *_flat())
    kept = measured.where(~base_failed() & verdict(rules))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def oracle(rules=RULES) -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS)
    tests = " AND ".join(f"{r.metric} >= {r.least}" for r in rules if r.least is not None) + " AND " + " AND ".join(f"{r.metric} <= {r.most}" for r in rules if r.most is not None)
    return f"""WITH split_ AS (
      SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM split_, unnest(generate_series(1, len(w) - 2)) AS u(i)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
    counts AS (SELECT s.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
      (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
      len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines FROM split_ s LEFT JOIN covered c USING (doc_id)),
    ratios AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_length, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word,
      n_stop_words / greatest(n_words, 1)::DOUBLE AS stop_word_share, n_exclamations / greatest(n_words, 1)::DOUBLE AS exclamations_per_word,
      n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
    SELECT *, NOT base_failed AND ({tests}) AS kept FROM ratios"""
