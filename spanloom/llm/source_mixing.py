"""Mixing sources to target weights, with DataFrame operations only.

A tree domain > language > source carries integer weights. A token budget is handed down level
by level: a node's capacity is what its leaves can give in ``max_epochs`` passes, and children
share their parent's amount by weight until full. What a full child leaves over goes to its
siblings first and reaches the parent's siblings only when the whole subtree is full. Each
leaf then reads its documents in a seeded order per epoch and takes a prefix of their tokens.

The order is by md5(seed:epoch:doc_id), and by hashes of the row among rows of one id. Prefix
sums over a hot leaf are taken in hash ranges: sums per range, then a running sum over the ranges
(at most 4096 a leaf), then rows of the one cut range only.

Defined results: null language or source is the node ``unknown``; null or empty texts have no
tokens and are never drawn; repeated rows are drawn as separate documents, each as often and as
far as the budget says; rows of one id and unlike texts are documents of their own; rows without
doc_id are ordered by their hashes and drawn like others; a very long text is cut like any other; a
weight of 0 shuts its node out, and siblings take its share;
an empty table or a zero budget gives an empty result; extra columns are ignored by :func:`draw`
and kept, whatever their names, by :func:`mix_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, forget, materialize, row_marks, same
from .quality_rules import words_of

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by node name (1 where not named), budget as a share of all tokens, or in tokens."""

    domain: dict = field(default_factory=lambda: {"web": 3, "reference": 2})
    lang: dict = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2})
    source: dict = field(default_factory=lambda: {"src0": 2})
    budget_share_percent: int = 80
    budget_tokens: int | None = None
    max_epochs: int = 2
    seed: str = "mix-1"


def domain_of(source: Column) -> Column:
    """Sources whose name ends in an even digit are ``web``, all others ``reference``."""
    return F.when(source.rlike("[02468]$"), "web").otherwise("reference")


def _weight(node: Column, weights: dict) -> Column:
    out = F.lit(1).cast("long")
    for name, w in sorted(weights.items()):
        out = F.when(node == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens (words) and row hashes of each document with any."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain_of(source).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"),
        source.alias("source"),
        F.size(words_of(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("tokens"),
        *row_marks(docs),
    ).where("tokens > 0")


def _share(children: DataFrame, parents: list[str], node: str, weights: dict) -> DataFrame:
    """Water-filling inside each parent: columns in are ``have`` (capacity) and ``amount``.

    Children are sorted by capacity per weight; one is full while its capacity is within its
    share of what is left. Whole tokens: the rounded-down rest stays undistributed.
    """
    c = children.withColumn("w", _weight(F.col(node), weights))
    order = W.partitionBy(*parents).orderBy(F.try_divide("have", "w"), F.col(node))
    upto, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    c = c.withColumn("full_before", F.coalesce(F.sum("have").over(upto), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    c = c.withColumn("is_full", F.col("have") * F.col("w_left") <= (F.col("amount") - F.col("full_before")) * F.col("w"))
    group = W.partitionBy(*parents)
    c = c.withColumn("rest", F.col("amount") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("have"))).over(group), F.lit(0)))
    c = c.withColumn("w_open", F.sum(F.when(~F.col("is_full"), F.col("w"))).over(group))
    given = F.when(F.col("is_full"), F.col("have")).otherwise(F.expr("(rest * w) div w_open"))
    return c.withColumn("given", given).drop("w", "full_before", "w_left", "is_full", "rest", "w_open", "amount")


def leaf_budgets(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """domain, lang, source, supply and given tokens. Its size is the tree's, not the corpus's.

    Each level is written: it is tiny, and the next level's plan then stays as small.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    # What a weight of 0 shuts out has no capacity, so its parents hand nothing down to it.
    shut = (_weight(F.col("domain"), mix.domain) == 0) | (_weight(F.col("lang"), mix.lang) == 0) | (_weight(F.col("source"), mix.source) == 0)
    have = materialize(leaves.withColumn("have", F.when(shut, 0).otherwise(F.col("supply") * mix.max_epochs)), "mix-leaves")
    langs = have.groupBy("domain", "lang").agg(F.sum("have").alias("have"))
    tops = have.groupBy("domain").agg(F.sum("have").alias("have"))
    total = have.agg(F.sum("have").alias("h"), F.sum("supply").alias("n")).first()
    share = (total["n"] or 0) * mix.budget_share_percent // 100
    amount = min(share if mix.budget_tokens is None else mix.budget_tokens, total["h"] or 0)
    tops = tops.withColumn("amount", F.lit(amount).cast("long")).withColumn("_all", F.lit(1))
    tops = materialize(_share(tops, ["_all"], "domain", mix.domain).select("domain", F.col("given").alias("amount")), "mix-domains")
    langs = _share(langs.join(tops, "domain"), ["domain"], "lang", mix.lang).select("domain", "lang", F.col("given").alias("amount"))
    langs = materialize(langs, "mix-langs")
    forget(tops)
    return _share(have.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", mix.source).select(*LEVELS, "supply", "given")


def _drawn(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    plan = plan.where("given > 0").withColumn("whole", F.expr("given div supply")).withColumn("rest", F.expr("given % supply"))
    near = rows.join(plan.drop("given", "supply"), list(LEVELS))
    near = near.withColumn("epochs", F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0)).where("epochs > 0")
    each = near.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    cols = ["doc_id", "k1", "k2", *LEVELS, "epoch", "tokens", "take_tokens"]
    whole = each.where("epoch < whole").withColumn("take_tokens", F.col("tokens"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("row"), "k1", "k2"))
    cut = each.where("epoch >= whole").withColumn("key", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epoch"), name)))
    cut = cut.withColumn("range", F.substring("key", 1, 3))
    sums = cut.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("in_range"))
    along = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_range").over(along), F.lit(0))).where("before < rest").drop("rest")
    met = cut.join(sums, [*LEVELS, "range"])
    inside = met.where("before + in_range <= rest").withColumn("take_tokens", F.col("tokens"))
    order = W.partitionBy(*LEVELS, "range").orderBy("key", "doc_id", "tokens", "k1", "k2").rowsBetween(W.unboundedPreceding, -1)
    edge = met.where("before + in_range > rest").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    edge = edge.where("at < rest").withColumn("take_tokens", F.least(F.col("tokens"), F.col("rest") - F.col("at")))
    return whole.select(*cols).unionByName(inside.select(*cols)).unionByName(edge.select(*cols))


def draw_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per drawn (row, epoch): id and hashes, leaf, tokens, and take_tokens of its prefix."""
    rows = materialize(leaf_rows(docs), "mix-rows")
    # Small by construction (one row per leaf) and read three times: written, so that its
    # chain of windows is planned and run once.
    return _drawn(rows, materialize(leaf_budgets(rows, mix), "mix-plan"), mix)


def draw(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    return draw_rows(docs, mix).drop("k1", "k2")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn documents with the input's columns, one row per epoch; a document cut by the
    budget keeps its first words, joined by single spaces.

    Draws find their text by the row's hashes. Rows equal in every column share one text and one
    hash, so texts are made distinct first, combined before the shuffle, and each draw meets one.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[same(c).alias(c) for c in names]).alias("row"), *row_marks(docs))
    once = packed.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    drawn = draw_rows(docs, mix).select("k1", "k2", "tokens", "take_tokens")
    out = once.join(drawn, ["k1", "k2"])
    text = F.col("row.text")
    cut = F.array_join(F.slice(words_of(text), F.lit(1), F.col("take_tokens").cast("int")), " ")
    new = {"text": F.when(F.col("take_tokens") < F.col("tokens"), cut).otherwise(text)}
    if "n_chars" in names:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(documents(spark, sf_dir))


def _sql_share(rel: str, parents: str, node: str, weights: dict) -> str:
    w = "CASE " + " ".join(f"WHEN {node} = '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END" if weights else "1"
    return f"""(SELECT *, CASE WHEN is_full THEN have ELSE (rest * w) // w_open END AS given FROM (
      SELECT *, amount - coalesce(sum(have) FILTER (is_full) OVER (PARTITION BY {parents}), 0) AS rest,
             sum(w) FILTER (NOT is_full) OVER (PARTITION BY {parents}) AS w_open FROM (
        SELECT *, have * w_left <= (amount - full_before) * w AS is_full FROM (
          SELECT *, coalesce(sum(have) OVER (PARTITION BY {parents} ORDER BY have / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
                 sum(w) OVER (PARTITION BY {parents} ORDER BY have / w, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
          FROM (SELECT *, {w} AS w FROM {rel})))))"""


def oracle(mix: Mix = Mix()) -> str:
    tops = _sql_share("(SELECT *, least(supply_all * %d // 100, have_all) AS amount FROM (SELECT domain, sum(have)::BIGINT AS have, sum(sum(supply)) OVER ()::BIGINT AS supply_all, sum(sum(have)) OVER ()::BIGINT AS have_all, 1 AS one FROM leaves GROUP BY domain))" % mix.budget_share_percent, "one", "domain", mix.domain)
    langs = _sql_share("(SELECT l.domain, l.lang, l.have, t.given AS amount FROM (SELECT domain, lang, sum(have)::BIGINT AS have FROM leaves GROUP BY domain, lang) l JOIN tops t USING (domain))", "domain", "lang", mix.lang)
    sources = _sql_share("(SELECT l.*, t.given AS amount FROM leaves l JOIN langs t USING (domain, lang))", "domain, lang", "source", mix.source)
    return f"""WITH base AS (
      SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, 'unknown'), '[02468]$') THEN 'web' ELSE 'reference' END AS domain,
             coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
             len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
    rows_ AS (SELECT * FROM base WHERE tokens > 0),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, (sum(tokens) * {mix.max_epochs})::BIGINT AS have FROM rows_ GROUP BY ALL),
    tops AS (SELECT domain, given FROM {tops}), langs AS (SELECT domain, lang, given FROM {langs}),
    plan AS (SELECT domain, lang, source, supply, given::BIGINT AS given FROM {sources}),
    each_ AS (SELECT r.*, g.given, g.supply, e.epoch FROM rows_ r JOIN plan g USING (domain, lang, source), generate_series(0, {mix.max_epochs}) AS e(epoch) WHERE e.epoch * g.supply < g.given),
    placed AS (SELECT *, given - epoch * supply AS rest, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{mix.seed}:' || epoch || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM each_)
    SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, tokens, least(tokens, rest - at_)::BIGINT AS take_tokens FROM placed WHERE at_ < rest"""
