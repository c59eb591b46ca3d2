"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, of ``window`` words for templates up to half as long
and of twice the template's words for longer ones, at any offset of the text. A block matches a
template if it holds at least ``percent`` of the template's distinct words. The join:

1. One pass over the texts keeps, per document, the distinct template words it holds, and, where
   they can make up a template at all, the places of its template words.
2. Template words are ordered by document frequency over the whole corpus, rarest first. A
   template's prefix is its first ``|T| - need + 1`` words: a block with ``need`` of its words
   must hold one of them. Places of prefix words meet their templates in a join.
3. Length filter: enough distinct words of the template within a block's reach of that place.
   Positional filter: enough of them at or behind the shared word in the global order, or before.
4. Survivors are verified: a block that matches can be moved to start at a word of the template
   and only gain, so the blocks that start at such words and hold the place are counted exactly.

Besides, fixed phrases are located by their words standing consecutively (the base).

Defined results: null and empty texts have no words, no labels and score 0; repeated rows give
repeated result rows; rows of one or no doc_id are scanned each for itself; very long texts are
read whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, let, lower_ascii, numbered

#: Separators between words, on lower-cased text.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW, PERCENT = 64, 80
#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public license notices of any length, by label.
TEMPLATES = {
    "notice-gpl": "this work is licensed under the gnu general public license version 3",
    "notice-apache": "licensed under the apache license version 2 0",
    "notice-cc-by": "licensed under cc by 4 0",
    "notice-cc-by-nc": "licensed under cc by nc 4 0",
    "notice-mit": "released under the mit license",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "text-bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "text-gpl": "this program is free software you can redistribute it and or modify it under the terms",
    "text-mpl": "this source code form is subject to the terms of the mozilla public license",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), GAP, -1), lambda w: w != "")


def _need(words: list[str], percent: int) -> int:
    return -(-len(words) * percent // 100)


def _reach(words: list[str]) -> int:
    return max(WINDOW, 2 * len(words))


def word_order(has: DataFrame, vocabulary: list[str]) -> list[int]:
    """Rank of each vocabulary word by the number of documents that hold it, rarest first."""
    seen = has.select(F.explode("has").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    counts = {r["v"]: r["n"] for r in seen.collect()}  # one row a template word
    order = sorted(range(len(vocabulary)), key=lambda v: (counts.get(v, 0), vocabulary[v]))
    rank = [0] * len(vocabulary)
    for i, v in enumerate(order):
        rank[v] = i
    return rank


def _base(words: Column) -> Column:
    """n_base, first, last, labels of the phrases, from words wrapped as `` word ``."""
    wrapped = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))

    def located(s: Column) -> Column:
        def n_words(part: Column) -> Column:
            return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")

        counts, firsts, lasts, labels = [], [], [], []
        for phrase, label in PHRASES:
            mark = " " + "  ".join(phrase.split()) + " "
            has = F.contains(s, F.lit(mark))
            counts.append((F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))) / len(mark))
            firsts.append(F.when(has, n_words(F.substring_index(s, mark, 1))))
            lasts.append(F.when(has, n_words(s) - n_words(F.substring_index(s, mark, -1)) - len(phrase.split())))
            labels.append(F.when(has, F.lit(label)))
        total = counts[0]
        for c in counts[1:]:
            total = total + c
        return F.struct(
            total.cast("long").alias("n"),
            F.array_min(F.array(*firsts)).alias("first"),
            F.array_max(F.array(*lasts)).alias("last"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("labels"),
        )

    hit = F.array_contains(words, "license") | (F.array_contains(words, "cc") & F.array_contains(words, "by"))
    return F.when(hit, let(wrapped, located))


def hits(docs: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    """One numbered row per input row: word and base counts, template words held, their places."""
    parts = {k: t.split() for k, t in templates.items()}
    vocabulary = sorted({w for t in parts.values() for w in t})
    number = F.create_map(*[x for i, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(i))]) if vocabulary else None
    none = F.array().cast("array<struct<i:int,v:int>>")
    words = id_text(docs).select("doc_id", words_of(F.col("text")).alias("w"))
    if not vocabulary:
        empty = F.array().cast("array<int>")
        return numbered(words.select("doc_id", F.size("w").cast("long").alias("n_words"), _base(F.col("w")).alias("b"), empty.alias("has"), none.alias("hits")), "license-rows", "row")
    distinct = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.col("w"))
    held = words.select("*", F.transform(distinct, lambda x: F.element_at(number, x)).alias("has"))
    enough = F.lit(False)
    for t in parts.values():
        own = F.array(*[F.lit(vocabulary.index(w)) for w in sorted(set(t))])
        enough = enough | (F.size(F.array_intersect("has", own)) >= _need(list(set(t)), percent))
    at = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), F.when(x.isin(vocabulary), F.element_at(number, x)).alias("v"))), lambda h: h["v"].isNotNull())
    out = held.select("doc_id", F.size("w").cast("long").alias("n_words"), _base(F.col("w")).alias("b"), "has", F.when(enough, at).otherwise(none).alias("hits"))
    return numbered(out, "license-rows", "row")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per input row: word and base counts, labels, and the best containment as score."""
    spark = docs.sparkSession
    templates = {k: t for k, t in templates.items() if t.split()}
    passed = hits(docs, templates, percent)
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    rank = word_order(passed, vocabulary)
    index = []
    for label, text in sorted(templates.items()):
        words = sorted({vocabulary.index(w) for w in text.split()}, key=rank.__getitem__)
        need = _need(words, percent)
        index += [(words[i], label, i, need, _reach(text.split()), words) for i in range(len(words) - need + 1)]
    # ``words`` stand in the global order, rarest first; ``at`` is the shared word's place there.
    shape = "word int, label string, at int, need int, reach int, words array<int>"
    probe = spark.createDataFrame(index, shape)
    prefix = sorted({row[0] for row in index})
    place = passed.where(F.size("hits") > 0).select("row", "hits", F.posexplode(F.transform("hits", lambda h: h["v"])).alias("j", "word"))
    place = place.where(F.col("word").isin(prefix)) if prefix else place.where("false")
    # The probe has a fixed bound: the prefixes of the templates given as a parameter.
    met = place.join(F.broadcast(probe), "word")
    # Places ascend, so a block's reach in words is at most that in entries.
    low = F.greatest(F.col("j") - F.col("reach") + 2, F.lit(1))
    around = F.slice("hits", low, F.col("j") + F.col("reach") + 1 - low)
    here = F.get("hits", F.col("j"))["i"]
    near = met.withColumn("here", here).withColumn(
        "own", F.filter(around, lambda h: F.array_contains("words", h["v"]) & (F.abs(h["i"] - F.col("here")) < F.col("reach")))
    ).drop("hits")
    near = near.withColumn("kinds", F.array_intersect("words", F.transform("own", lambda h: h["v"]))).where(F.size("kinds") >= F.col("need"))
    rarer = F.size(F.array_intersect(F.slice("words", F.lit(1), F.col("at")), "kinds"))
    near = near.where(rarer + F.size("words") - F.col("at") >= F.col("need"))
    starts = F.filter("own", lambda h: h["i"] <= F.col("here"))
    both = F.transform(starts, lambda s: F.size(F.array_distinct(F.transform(F.filter("own", lambda h: (h["i"] >= s["i"]) & (h["i"] < s["i"] + F.col("reach"))), lambda h: h["v"]))))
    shared = near.select("row", "label", F.array_max(both).alias("both"), F.size("words").alias("size"), "need").where("both >= need")
    best = shared.groupBy("row", "label").agg(F.max(F.col("both") / F.col("size")).alias("c"))
    per_row = best.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("c").alias("best"))
    none = F.array().cast("array<string>")
    out = passed.join(per_row, "row", "left")
    n_base = F.coalesce(F.col("b.n"), F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.col("b.first").alias("first_word"), F.col("b.last").alias("last_word"),
        F.array_join(F.coalesce("b.labels", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("b.labels", none), F.coalesce("found", none)))), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def oracle(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    """Phrases by comparing slices, and every block that starts at a template's word, in plain SQL."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    parts = {k: t.split() for k, t in sorted(templates.items())}
    t = " UNION ALL ".join(f"SELECT '{k}' AS label, {len(set(w))} AS size, {_reach(w)} AS reach, {_need(list(set(w)), percent)} AS need, {quoted(sorted(set(w)))} AS ws" for k, w in parts.items())
    phrases = " UNION ALL ".join(f"SELECT '{la}' AS label, {quoted(ph.split())} AS ws" for ph, la in PHRASES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    word AS (SELECT r, i - 1 AS i, w[i] AS v FROM d, unnest(generate_series(1, len(w))) AS u(i)),
    phrase AS ({phrases}), template AS ({t}), entry AS (SELECT label, size, reach, need, unnest(ws) AS v FROM template),
    stands AS (SELECT d.r, word.i, phrase.label FROM word JOIN phrase ON word.v = phrase.ws[1] JOIN d USING (r) WHERE d.w[word.i + 1:word.i + len(phrase.ws)] = phrase.ws),
    base AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS ls FROM stands GROUP BY r),
    own AS (SELECT r, i, v, label, size, reach, need FROM word JOIN entry USING (v)),
    able AS (SELECT r, label FROM own GROUP BY r, label, need HAVING count(DISTINCT v) >= need),
    spot AS (SELECT own.* FROM own JOIN able USING (r, label)),
    block AS (SELECT a.r, a.label, a.i, a.size, a.need, count(DISTINCT b.v) AS n FROM spot a JOIN spot b ON a.r = b.r AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.reach GROUP BY ALL),
    best AS (SELECT r, label, max(n / size) AS c FROM block WHERE n >= need GROUP BY r, label),
    found AS (SELECT r, list(label) AS ls, max(c) AS c FROM best GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
      greatest(CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE 0.0 END, coalesce(found.c, 0.0)) AS score
    FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""
