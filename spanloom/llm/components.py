"""Connected components: chunks of links contract on their own, then alternating large-star and
small-star steps join what the chunks left apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: Links that one task contracts at once: 4 MB of ids.
CHUNK = 1 << 18


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each of n rows: labels sink along links until they rest."""
    low = np.arange(n)
    while True:
        before, a, b = low.copy(), low[i], low[j]
        m = np.minimum(a, b)
        for at in (a, b, i, j):
            np.minimum.at(low, at, m)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _contract(batches):
    """The links of a task as stars (node, smallest node of its component)."""
    held = [pdf.to_numpy(np.int64) for pdf in batches if len(pdf)]
    if held:
        nodes, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        low = smallest_reachable(len(nodes), at[:, 0], at[:, 1])
        hangs = low != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[hangs], "v": nodes[low[hangs]]})


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Whether every node hangs on one centre and no centre hangs on another."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    per = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per.where("hangs > 1 or hangs > 0 and holds > 0").limit(1).count() == 0


def connected_components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node and component (its smallest node) of every node with an edge.

    ``edges``, best a written table, has long columns u and v. Chunks of links contract first,
    each in bounded memory; the stars they leave, one chunk's being the result already, need
    few rounds, in which minima per node are combined before the shuffle. Self-links and
    repeats are ignored.
    """
    links = edges.select("u", "v").where("u <> v")
    chunks = max(1, -(-links.count() // chunk))
    now = materialize(links.repartition(chunks).mapInPandas(_contract, "u long, v long"), "cc")
    while chunks > 1 and not _is_stars(now):
        before = now
        now = materialize(_small_star(_large_star(now)), "cc")
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
