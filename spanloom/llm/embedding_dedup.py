"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on seeded Gaussian directions; ``floor((a.x + b) / w)`` of k
projections makes a table's bucket. For unit vectors cosine c is distance sqrt(2 - 2c), and the
chance that one projection agrees follows from the distance (:func:`agree`). The number of
projections follows from the number of vectors of the largest label, so that an unrelated vector
shares a bucket of a table with one of them in about one of ``spare`` cases; the number of tables follows from
``miss``, the accepted chance to miss a pair exactly at the threshold. Closer pairs are missed
far less often. Both numbers are one formula at every size.

Equal vectors of a label are one class with a multiplicity and a number of its own. Buckets of
several classes are cut into chunks of at most about ``chunk`` rows; every pair of chunks is one
block of a matrix product, so memory is flat. A linked pair is counted in the first table that
holds it, and a block emits counts per class and a spanning forest, never the pairs.

Defined results: null or all-zero vectors, null or non-finite components and null labels link
with nothing; rows without vec_id have a null component and link with nothing; rows of one vec_id
with one vector and label are one vector, rows of one vec_id with unlike vectors or labels are
vectors of their own, each with the links of its own vector; vectors of unlike lengths never
link; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, numbered
from .components import connected_components, smallest_reachable


@dataclass(frozen=True)
class PStable:
    cosine: float = 0.98
    width: float = 2.0
    miss: float = 1e-5
    spare: int = 16
    chunk: int = 2048
    seed: int = 5


def agree(distance: float, width: float) -> float:
    """Chance that a Gaussian projection of two points at ``distance`` falls into one cell."""
    r = width / distance
    inside = erf(r / sqrt(2))
    return inside - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def shape(p: PStable, vectors: int) -> tuple[int, int]:
    """(projections a table, tables) for labels of at most so many vectors."""
    far, near = agree(sqrt(2), p.width), agree(sqrt(2 - 2 * p.cosine), p.width)
    k = max(1, ceil(log(max(vectors, 2) * p.spare) / -log(far)))
    return k, ceil(log(p.miss) / log(1 - near**k))


def _projections(p: PStable, size: tuple[int, int], dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([p.seed, dim])
    n = size[0] * size[1]
    return rng.standard_normal((n, dim)), rng.random(n) * p.width


def _keys(x: np.ndarray, size: tuple[int, int], made: tuple, width: float) -> np.ndarray:
    """Bucket keys, one column a table, of the unit vectors in the rows of x."""
    a, b = made
    k, tables = size
    out = np.full((len(x), tables), x.shape[1], dtype=np.uint64)
    for i in range(0, len(x), 512):
        cells = np.floor((x[i : i + 512] @ a.T + b) / width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(-1, tables, k)
        for j in range(k):
            part = (out[i : i + 512] ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            out[i : i + 512] = part ^ (part >> np.uint64(29))
    return out.view(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, e of the rows that can link."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    return clean.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(
        F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    )


def classed(vectors: DataFrame) -> DataFrame:
    """cls (a number), label, e, low (least vec_id), copies (vec_ids) of each distinct usable vector."""
    # Repeats go before the shuffle: ids of one vector are made distinct, then counted.
    each = usable(vectors).groupBy("label", "e", "vec_id").agg(F.lit(1).alias("one"))
    found = each.groupBy("label", "e").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    return numbered(found, "emb-classes", "cls")


def hashed(classes: DataFrame, p: PStable, size: tuple[int, int]) -> DataFrame:
    """cls, label, copies, unit (bytes of doubles) and keys, one key a table."""

    def run(batches):
        made: dict[int, tuple] = {}
        for pdf in batches:
            n = len(pdf)
            units, keys = [b""] * n, [None] * n
            dims = np.array([len(e) for e in pdf.e])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([np.asarray(pdf.e.iloc[i], dtype=np.float64) for i in at])
                x = x / np.abs(x).max(axis=1)[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                if dim not in made:
                    made[dim] = _projections(p, size, int(dim))
                for i, u, k in zip(at, x, _keys(x, size, made[dim], p.width)):
                    units[i], keys[i] = u.tobytes(), k
            yield pd.DataFrame({"cls": pdf.cls, "label": pdf.label, "copies": pdf.copies, "unit": units, "keys": keys})

    return classes.mapInPandas(run, "cls long, label long, copies long, unit binary, keys array<long>")


def _block(unit, earlier, chunk, copies, cls, table: int, across: bool, p: PStable) -> list[tuple]:
    """(cls, n, low) arrays of the linked rows of a block, given as arrays. Most blocks are tiny, so
    nothing here makes a frame."""
    lengths = {len(u) for u in unit}
    if len(lengths) > 1:  # a bucket holds vectors of one length but for a hash collision
        out = []
        for n in lengths:
            at = np.array([k for k, u in enumerate(unit) if len(u) == n])
            out += _block(unit[at], earlier[at], chunk[at], copies[at], cls[at], table, across, p)
        return out
    x = np.frombuffer(b"".join(unit), dtype=np.float64).reshape(len(unit), -1)
    pairs = []
    for s in range(0, len(x), 256):
        i, j = np.nonzero(x[s : s + 256] @ x.T >= p.cosine)
        i = i + s
        ok = i < j
        if across:
            ok &= chunk[i] != chunk[j]
        if ok.any():
            pairs.append((i[ok], j[ok]))
    if not pairs:
        return []
    i, j = (np.concatenate(v) for v in zip(*pairs))
    if table:  # a pair that an earlier table holds was counted there
        keys = np.stack([earlier[k] for k in range(len(x))])
        first = np.ones(len(i), dtype=bool)
        for k in range(0, len(i), 65536):
            first[k : k + 65536] = ~(keys[i[k : k + 65536]] == keys[j[k : k + 65536]]).any(axis=1)
        i, j = i[first], j[first]
        if not len(i):
            return []
    count = np.zeros(len(x), dtype=np.int64)
    np.add.at(count, i, copies[j])
    np.add.at(count, j, copies[i])
    low = smallest_reachable(len(x), i, j)
    hit = count > 0
    return [(cls[hit], count[hit], cls[low[hit]])]


def _blocks(pdf: pd.DataFrame, cuts: np.ndarray, p: PStable) -> pd.DataFrame | None:
    """Links of the blocks between the cuts of a sorted frame."""
    unit, earlier = pdf["unit"].to_numpy(), pdf["earlier"].to_numpy()
    chunk, copies, cls, table = (pdf[c].to_numpy() for c in ("c", "copies", "cls", "t"))
    across = pdf["bi"].to_numpy() != pdf["bj"].to_numpy()
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            out += _block(unit[a:b], earlier[a:b], chunk[a:b], copies[a:b], cls[a:b], int(table[a]), bool(across[a]), p)
    return pd.DataFrame(dict(zip(("cls", "n", "low"), map(np.concatenate, zip(*out))))) if out else None


def embedding_duplicates(vectors: DataFrame, p: PStable = PStable()) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    classes = classed(vectors)
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    size = shape(p, most or 0)
    base = materialize(hashed(classes.select("cls", "label", "copies", "e"), p, size), "emb")
    slots = base.select("cls", "label", F.posexplode("keys").alias("t", "key"))
    shared = slots.groupBy("label", "t", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = slots.join(shared, ["label", "t", "key"])
    met = met.withColumn("chunks", F.ceil(F.col("size") / p.chunk)).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.withColumn("bi", F.least("c", "o")).withColumn("bj", F.greatest("c", "o")).drop("o", "size", "chunks")
    block = ["label", "t", "key", "bi", "bj"]
    full = met.join(base.select("cls", "copies", "unit", "keys"), "cls")
    # A slot carries the keys of the tables before its own, which tell pairs counted there.
    full = full.withColumn("earlier", F.slice("keys", F.lit(1), F.col("t"))).drop("keys").repartition(*block).sortWithinPartitions(*block)

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            ids = pdf[block].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1])
            found = _blocks(pdf, cuts, p)  # the last block may go on in the next batch
            held = pdf.iloc[cuts[-1] :]
            if found is not None:
                yield found
        if held is not None and len(held):
            found = _blocks(held, np.array([0, len(held)]), p)
            if found is not None:
                yield found

    parts = materialize(full.mapInPandas(run, "cls long, n long, low long"), "emb-links")
    forget(base)
    label = connected_components(parts.select(F.col("cls").alias("u"), F.col("low").alias("v")))
    # Numbers mean nothing outside: a component is called by its smallest vec_id.
    label = label.join(classes.select("cls", "low"), F.col("node") == F.col("cls")).select("node", "component", "low")
    lows = label.groupBy("component").agg(F.min("low").alias("component_id"))
    label = label.join(lows, "component").select("node", "component_id")
    sums = parts.groupBy("cls").agg(F.sum("n").alias("n"))
    named = classes.select("cls", "label", "e", "low", "copies").join(sums, "cls", "left").join(label, F.col("cls") == F.col("node"), "left")
    found = named.select("label", "e", F.coalesce("component_id", "low").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Back to rows by label and the vector itself.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    out = rows.join(found, ["label", "e"], "left").withColumn("id", F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.col("id") == F.coalesce("component_id", "id")).otherwise(True).alias("kept"),
    )


def oracle(cosine: float = 0.98) -> str:
    """All pairs of a label, links, and components by a recursive query."""
    return f"""WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM ok),
    link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
      WHERE list_inner_product(a.u, b.u) >= {cosine}),
    reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
    low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(DISTINCT y) AS n FROM link GROUP BY x)
    SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
    FROM v JOIN low ON low.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
