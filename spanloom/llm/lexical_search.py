"""Ranked lexical search, impact-ordered and score-at-a-time.

A posting's impact is the exact integer that it adds to a score, so it needs the corpus statistics:

1. One scan of all whole texts: terms counted per document, kept where a query has them. Written.
2. From that table the number of documents with a term, their terms in all, and per query term the
   documents that hold it: a sum per term, made before the shuffle.
3. The table is read in blocks of documents. Each block's postings are sorted by term and falling
   impact, so that postings of one exact impact stand together. A query takes whole impact groups,
   highest first, over all its terms, and adds them to its documents' scores. It stops once the
   highest impacts left, summed over its terms, are less than the score that the k-th document has for
   certain: no document not met by then can enter. Documents met that still may enter get their
   scores completed, all others are out. A task carries its best k from block to block, so later
   blocks stop sooner; what it gives is k rows a query at most, whatever it has read.
4. The best k of all tasks: one window per query, over k rows a query and task.

Documents are dealt, never postings: no shuffle grows with them, and no term is hot. Queries are taken
in blocks of about TERMS terms, each with its own scans, so what a task holds of them is bounded.

Defined results: null texts and texts without terms are no documents; documents of one id, or
repeated, are ranked each for itself; those without id come last among equal scores; very long texts
are read whole; rows of one item_id are one query with the terms of all; a query without terms, or an
empty table, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, forget, id_text, materialize

K, TERMS = 50, 500_000
#: Each round goes down to this share of the highest impact left.
SHARE = 0.7
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: ASCII letters lower-cased, digits and all bytes beyond ASCII kept, everything else a gap.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER, LOWER))
LAST = 2**63 - 1


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: every document with a term, with its query terms by number."""

    def run(batches):
        for batch in batches:
            ids, sizes, edges, found, times = [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                for w, tf in Counter(words).items():
                    if (t := number.get(w)) is not None:
                        found.append(t)
                        times.append(tf)
                ids.append(doc)
                sizes.append(len(words))
                edges.append(len(found))
            at = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return id_text(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """The postings of a block of documents by term, then falling impact."""

    def __init__(self, edges: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(n)), np.diff(edges))
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        by_impact = np.lexsort((-gain, term))
        self.doc, self.gain = doc[by_impact], gain[by_impact]
        self.fall = -self.gain
        self.terms, first = np.unique(term[by_impact], return_index=True)
        self.first = np.append(first, len(term))
        self.size = len(n)

    def best(self, query: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block that may be among the best k, with exact scores; ``query`` is sorted.
        None with less than ``least`` is needed."""
        where = np.searchsorted(self.terms, query)
        known = (where < len(self.terms)) & (self.terms[np.minimum(where, max(len(self.terms) - 1, 0))] == query) if len(self.terms) else np.zeros(len(query), bool)
        where = where[known]
        at, end = self.first[where].copy(), self.first[where + 1]
        scores = np.zeros(self.size, np.int64)
        left = np.where(at < end, self.gain[np.minimum(at, max(len(self.gain) - 1, 0))], 0) if len(at) else at
        while True:
            bound = int(left.sum())
            if bound == 0 or bound < least:
                break
            floor = math.floor(int(left.max()) * SHARE)
            for i in np.flatnonzero(left > floor):
                # Whole groups of equal impact, down to the floor.
                to = at[i] + int(np.searchsorted(self.fall[at[i] : end[i]], -floor))
                scores[self.doc[at[i] : to]] += self.gain[at[i] : to]
                at[i] = to
                left[i] = self.gain[to] if to < end[i] else 0
            if self.size >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
        may = np.flatnonzero((scores > 0) & (scores + bound >= max(least, 1)))
        if bound:
            # What is left of the postings adds to those documents only.
            open_ = np.zeros(self.size, bool)
            open_[may] = True
            for a, b in zip(at, end):
                rest = np.flatnonzero(open_[self.doc[a:b]])
                scores[self.doc[a:b][rest]] += self.gain[a:b][rest]
        found = scores[may]
        may = may[found >= max(least, 1)]
        return may, scores[may]


def searched(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query (its number), doc_id, score: the best k of each task."""

    def run(batches):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = [none for _ in queries]
        for batch in batches:
            ids = batch.column(0)
            lost = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
            lists, tfs = batch.column(2), batch.column(3)
            edges = lists.offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            block = Block(edges, lists.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False), weights, n_docs, n_terms)
            for q, query in enumerate(queries):
                had = best[q]
                at, scores = block.best(query, int(had[0][-1]) if len(had[0]) == k else 0, k)
                if len(at):
                    s, d, x = np.concatenate([had[0], scores]), np.concatenate([had[1], doc[at]]), np.concatenate([had[2], lost[at]])
                    top = np.lexsort((d, x, -s))[:k]
                    best[q] = (s[top], d[top], x[top])
        sizes = [len(b[0]) for b in best]
        number = np.repeat(np.arange(len(best), dtype=np.int32), sizes)
        s, d, x = (np.concatenate([b[j] for b in best]) if best else none[j] for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(d, mask=x), pa.array(s)], ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(items: DataFrame, most: int):
    """(ids, terms of each) of about ``most`` terms at a time; one row an item."""
    ids, sets, held = [], [], 0
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    for row in texts.sort("item_id").toLocalIterator():
        own = {w for t in row["texts"] for w in terms(t)}
        if not own:
            continue
        ids.append(row["item_id"])
        sets.append(own)
        held += len(own)
        if held >= most:
            yield ids, sets
            ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def search(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. ``items`` has item_id and text."""
    spark = docs.sparkSession
    out = None
    for ids, sets in _blocks(items, most_terms):
        number = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
        index = materialize(counted(docs, number), "lexical-index")
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        held = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row a query term
        weights = np.array([weight(n_docs, held.get(t, 0)) for t in range(len(number))], dtype=np.int64)
        queries = [np.array(sorted(number[w] for w in s), dtype=np.int32) for s in sets]
        found = searched(index, queries, weights, n_docs, n_terms or 0, k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {dict(items.dtypes)['item_id']}")
        # As many rows as the block has queries: bounded by its terms.
        best = materialize(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "lexical-best")
        forget(index)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle(k: int = K) -> str:
    """Every posting scored and ranked, in plain SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    term = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{term}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), s AS (SELECT r, doc_id, len(w)::HUGEINT AS n FROM d WHERE len(w) > 0),
      c AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS total FROM s), p AS (SELECT r, t, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
      df AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM p, c GROUP BY t, docs),
      q AS (SELECT DISTINCT item_id, unnest({words}) AS t FROM benchmark),
      e AS (SELECT q.item_id, p.r, sum(df.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN p USING (t) JOIN df USING (t) JOIN s USING (r), c GROUP BY q.item_id, p.r),
      o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM e JOIN s USING (r) WHERE score > 0)
      SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {k}"""
