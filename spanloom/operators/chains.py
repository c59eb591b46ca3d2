"""Stored hash chains: written, checked by many tasks a chain, digested and compared.

A record is a row (chain key, seq, payload, payload_hash, previous_hash, chain_hash). ``seq`` counts
from 0 without gaps; ``payload_hash`` is the SHA-256 of the payload, ``chain_hash`` that of
``previous_hash`` followed by ``payload_hash``; the first ``previous_hash`` is 64 zeros. Writing a
chain is sequential. Checking is not: each record holds all but one thing that its check needs, and
that stands in the record before it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZEROS = "0" * 64
#: Records of one stretch of a chain, the unit of checking and of the lowest digests.
STRETCH = 1024


def link(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Records of each key's rows, in ``order`` (the payload breaks ties), columns key, seq and the hashes.

    A chain is folded by one task, row by row out of a sort that may spill: no list of a chain is held.
    A null payload is empty; rows without a key are a chain of their own.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    r = rows.select(F.col(key).alias("chain"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], payload.alias("payload"))
    r = r.withColumn("payload_hash", F.sha2("payload", 256)).repartition("chain").sortWithinPartitions("chain", *[f"o{i}" for i in range(len(order))], "payload")

    def run(batches):
        chain, seq, head = None, -1, ZEROS
        for b in batches:
            seqs, before, after = [], [], []
            for k, h in zip(b["chain"].to_pylist(), b["payload_hash"].to_pylist()):
                if seq < 0 or k != chain:
                    chain, seq, head = k, -1, ZEROS
                seq += 1
                before.append(head)
                head = hashlib.sha256((head + h).encode()).hexdigest()
                seqs.append(seq)
                after.append(head)
            cols = [b["chain"], pa.array(seqs, pa.int64()), b["payload"], b["payload_hash"], pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["chain", "seq", "payload", "payload_hash", "previous_hash", "chain_hash"])

    kind = rows.schema[key].dataType.simpleString()
    made = r.select("chain", "payload", "payload_hash").mapInArrow(run, f"chain {kind}, seq bigint, payload string, payload_hash string, previous_hash string, chain_hash string")
    return made.withColumnRenamed("chain", key)


def placed(seq: Column) -> Column:
    return F.coalesce(seq >= 0, F.lit(False))


def breaks(records: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """Records at which a chain does not hold: key, seq, chain_hash and codes, one row a faulty record.

    ``payload_changed``: the payload has another hash. ``hash_wrong``: the chain hash is not that of
    the two it is made from. ``repeated``: its seq stands in several records, whether alike or not.
    ``missing_before``: no record has the seq before it. ``link_broken``: records have it, but none
    with the hash that this one was linked to; also a first record that does not begin at zeros.
    ``unplaced``: seq is null or negative; such a record is linked with nothing. Null hashes and
    payloads count as empty ones.

    A chain is cut into stretches of ``stretch`` seqs, each checked by itself; the last record of a
    stretch stands in the next one too, as a witness. So no chain, however long, is one task's work.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    payload_changed = F.sha2(text("payload"), 256) != text("payload_hash")
    hash_wrong = F.sha2(F.concat(text("previous_hash"), text("payload_hash")), 256) != text("chain_hash")
    r = records.select(F.col(key).alias("k"), "seq", text("previous_hash").alias("p"), F.col("chain_hash"), payload_changed.alias("payload_changed"), hash_wrong.alias("hash_wrong"))
    own = [F.when(F.col(c), c) for c in ("payload_changed", "hash_wrong")]

    number = F.floor(F.col("seq") / stretch).cast("long")
    last = F.when((F.col("seq") + 1) % stretch == 0, F.struct((number + 1).alias("n"), F.lit(True).alias("witness")))
    s = r.where(placed(F.col("seq"))).withColumn("at", F.explode(F.array_compact(F.array(F.struct(number.alias("n"), F.lit(False).alias("witness")), last))))
    w = W.partitionBy("k", "at.n").orderBy("seq")
    before = F.collect_set(F.coalesce("chain_hash", F.lit(""))).over(w.rangeBetween(-1, -1))
    s = s.withColumn("before", before).withColumn("alike", F.count(F.lit(1)).over(w.rangeBetween(0, 0))).where("not at.witness")
    first, none = F.col("seq") == 0, F.size("before") == 0
    linked = F.when(first, F.col("p") == ZEROS).when(none, True).otherwise(F.array_contains("before", F.col("p")))
    met = [F.when(F.col("alike") > 1, "repeated"), F.when(~first & none, "missing_before"), F.when(~linked, "link_broken")]
    out = s.select("k", "seq", "chain_hash", F.array_compact(F.array(*own, *met)).alias("codes")).where(F.size("codes") > 0)
    lost = r.where(~placed(F.col("seq"))).select("k", "seq", "chain_hash", F.array_compact(F.array(*own, F.lit("unplaced"))).alias("codes"))
    return out.unionByName(lost).withColumnRenamed("k", key)


def digests(records: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """The lowest digests: key, stretch, n, digest, for stretches of ``stretch`` seqs.

    A digest is the SHA-256 of the stretch's lines ``seq:payload_hash:chain_hash``, sorted by seq, then
    the hashes, and joined by commas; repeated records count. Records without a place are in none.
    """
    r = records.where(placed(F.col("seq")))
    item = F.struct("seq", F.coalesce("payload_hash", F.lit("")).alias("p"), F.coalesce("chain_hash", F.lit("")).alias("h"))
    g = r.groupBy(key, F.floor(F.col("seq") / stretch).cast("long").alias("stretch")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("rs"))
    lines = F.transform("rs", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["p"], x["h"]))
    return g.select(key, "stretch", "n", F.sha2(F.array_join(lines, ","), 256).alias("digest"))


def roots(lowest: DataFrame, key: str, fan: int = STRETCH, levels: int = 3) -> DataFrame:
    """One digest a chain (key, n, digest) from :func:`digests`: ``fan`` neighbours are hashed into one,
    ``levels`` times, then what is left of a chain; three levels of 1,024 over stretches of 1,024
    leave one digest of a chain of up to 10^12 records, and longer ones are still exact."""
    d = lowest.select(key, F.col("stretch").alias("i"), "n", "digest")
    for level in range(levels + 1):
        to = F.floor(F.col("i") / fan).cast("long") if level < levels else F.lit(0).cast("long")
        d = d.withColumn("to", to).groupBy(key, "to").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("ds"))
        d = d.select(key, F.col("to").alias("i"), "n", F.sha2(F.array_join(F.transform("ds", lambda x: F.concat_ws(":", x["i"].cast("string"), x["digest"])), ","), 256).alias("digest"))
    return d.drop("i")


def divergence(records: DataFrame, replica: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """Chains in which two copies differ: key, first_seq, n_only (records of the first alone), n_replica_only.

    Digests of stretches are compared first; only records of stretches that differ are met with each
    other, as multisets of (seq, payload_hash, chain_hash).
    """
    a, b = digests(records, key, stretch), digests(replica, key, stretch)
    b = b.select(F.col(key).alias("k2"), F.col("stretch").alias("s2"), F.col("digest").alias("d2"))
    j = a.join(b, a[key].eqNullSafe(b["k2"]) & (a["stretch"] == b["s2"]), "full")
    # A key may be null on either side, so the side that is there is told by its digest.
    here = F.col("digest").isNotNull()
    unlike = j.where(~F.col("digest").eqNullSafe(F.col("d2"))).select(F.when(here, F.col(key)).otherwise(F.col("k2")).alias("uk"), F.coalesce("stretch", "s2").alias("us"))

    def opened(x: DataFrame, side: int) -> DataFrame:
        r = x.where(placed(F.col("seq"))).select(F.col(key).alias("k"), "seq", F.coalesce("payload_hash", F.lit("")).alias("p"), F.coalesce("chain_hash", F.lit("")).alias("h"))
        r = r.join(unlike, r["k"].eqNullSafe(F.col("uk")) & (F.floor(F.col("seq") / stretch).cast("long") == F.col("us")), "left_semi")
        return r.withColumn("side", F.lit(side))

    each = opened(records, 1).unionByName(opened(replica, -1)).groupBy("k", "seq", "p", "h").agg(F.sum("side").alias("over")).where("over <> 0")
    n = lambda sign: F.sum(F.greatest(F.col("over") * sign, F.lit(0))).cast("long")
    return each.groupBy(F.col("k").alias(key)).agg(F.min("seq").alias("first_seq"), n(1).alias("n_only"), n(-1).alias("n_replica_only"))
