"""Sharding by the minimax contiguous partition of ordered atomic groups.

Rows of one text are a group, which no cut may split. Groups stand in a fixed order: heavy ones by
falling size, then all others by the hash of their text. Shards are contiguous ranges of that order,
of the smallest capacity that fits: it is found by binary search, and a capacity is checked by
filling shard after shard up to it. Within that capacity cuts are moved towards even shares, as the
greedy filling leaves all slack to the last shard.

1. One scan of the texts gives each row's size, checksum and group; sizes are summed per group
   before the shuffle. A group is heavy if it has over ``1 / (shards * GRAIN)`` of all bytes, so
   at most shards * GRAIN groups are, and only those are listed on the driver.
2. A heavy group with at least an even share of what is left gets a shard of its own, and the rest is
   cut by itself. Else one text that fills a third of the table would set the capacity of all shards.
3. The others reach the driver as sums over hash ranges (CELLS at most). A range's inner cuts are not
   known, but lie no further apart than its largest group, so a check gives a sure yes, a sure no, or
   neither. Where neither is left, the ranges that a cut may fall into are summed again, finer, until
   the capacity and all cuts are exact. Each pass reads group sizes only, and few of them.
4. A row's shard follows from its group; its slot is a rank, summed over hash ranges of rows, so a
   hot shard is numbered by many tasks.

The result is exact: no shard of the contiguous partitions of that order (behind the shards given
to single groups) could have fewer bytes at its largest.

Defined results: a null text is an empty one (8 bytes), and all of those are one group; rows without
doc_id, of one doc_id, or repeated are kept apart as rows; very long texts are only hashed and
measured; fewer groups than shards leave shards empty; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, forget, id_text, materialize, numbered

SHARDS, OVERHEAD = 24, 8
#: Heavy groups a shard at most; hash ranges on the driver; rows ranked in one range.
GRAIN, CELLS, RANGE_ROWS = 4096, 1 << 16, 4096
LAST = 2**63 - 1


@dataclass
class Order:
    """The ordered groups behind those with a shard of their own, as cells: single groups or ranges."""

    sums: np.ndarray
    largest: np.ndarray
    count: np.ndarray
    #: Keys of the last group a cell may hold; heavy groups come first, so theirs are not compared.
    k1: np.ndarray
    k2: np.ndarray
    #: log2 of a range's width in k1; -1 for single groups.
    width: np.ndarray

    def __post_init__(self):
        self.ends = np.concatenate([[0], np.cumsum(self.sums)])

    @property
    def total(self) -> int:
        return int(self.ends[-1])

    def _cell(self, at: int) -> int:
        return int(np.searchsorted(self.ends, at, side="right")) - 1

    def latest(self, start: int, room: int) -> int:
        """No group's end within ``room`` behind ``start`` is later than this."""
        at = start + room
        if at >= self.total:
            return self.total
        c = self._cell(at)
        return int(self.ends[c]) if self.count[c] == 1 else at

    def earliest(self, start: int, room: int) -> int:
        """Some group ends here or later within ``room`` behind ``start``."""
        at = start + room
        if at >= self.total:
            return self.total
        c = self._cell(at)
        return int(self.ends[c]) if self.count[c] == 1 else max(int(self.ends[c]), at - int(self.largest[c]) + 1)

    def cuts(self, room: int, shards: int, step) -> list[int]:
        """Greedy filling: where each shard ends."""
        out, at = [], 0
        for _ in range(shards):
            at = step(at, room)
            out.append(at)
        return out

    def least(self, shards: int, step) -> int:
        """Smallest capacity whose greedy filling by ``step`` takes all in."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, step)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def even(self, room: int, shards: int) -> list[int]:
        """Cuts of shards of at most ``room`` bytes, each as near as may be to an even share of what is left.

        Once all greedy cuts are known group ends, a filling exists at known ends; the earliest ends
        from which the rest still fits keep every choice feasible.
        """
        first = [self.total]
        for _ in range(shards - 1):
            first.append(int(self.ends[np.searchsorted(self.ends, max(0, first[-1] - room))]))
        out, at = [], 0
        for k in range(shards - 1):
            last = int(self.ends[np.searchsorted(self.ends, at + room, side="right") - 1])
            share = at + (self.total - at) / (shards - k)
            c = int(np.searchsorted(self.ends, share))
            near = min((int(e) for e in self.ends[max(0, c - 1) : c + 1]), key=lambda e: abs(e - share))
            at = min(max(near, first[shards - 1 - k]), last)
            out.append(at)
        return [*out, self.total]

    def unsettled(self, shards: int) -> np.ndarray:
        """Ranges into which a cut of the smallest capacity may fall."""
        first, last = self.least(shards, self.latest), self.least(shards, self.earliest)
        out = np.zeros(len(self.sums), bool)
        for a, b in zip(self.cuts(first, shards, self.earliest), self.cuts(last, shards, self.latest)):
            out |= (self.count > 1) & (self.ends[:-1] < b) & (self.ends[1:] > a)
        return out


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, text_crc32 and the text's two hashes, written once."""
    rows = id_text(docs).select(
        "doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("spanloom"), F.col("text")).alias("k2"),
    )
    return numbered(rows, "shard-rows", "row")


def _ranges(light: DataFrame, width: int, within: Column | None = None) -> list:
    """Sums over ranges of 2^width hashes: at most CELLS rows, by the caller's choice of width."""
    of = light if within is None else light.where(within)
    g = of.groupBy(F.shiftright("k1", width).alias("cell")).agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count("*").alias("n"))
    # A range of one group is that group: its last key is the range's end all the same.
    return [(r["s"], r["m"], r["n"], ((r["cell"] + 1) << width) - 1, LAST, -1 if r["n"] == 1 else width) for r in g.sort("cell").collect()]


def _order(cells: list) -> Order:
    cols = list(zip(*cells)) if cells else [[]] * 6
    return Order(*(np.array(c, dtype=np.int64) for c in cols))


def settle(heavy: list, light: DataFrame, shards: int, cells: int = CELLS) -> Order:
    """The order, with ranges fine enough that the smallest capacity and its cuts are exact."""
    width = 64 - (cells - 1).bit_length()
    order = _order([*heavy, *_ranges(light, width)])
    while (open_ := order.unsettled(shards)).any():
        at = np.flatnonzero(open_)
        lows = order.k1[at] - (1 << order.width[at].astype(object)) + 1
        spans: list[list[int]] = []
        for lo, hi in zip(map(int, lows), map(int, order.k1[at])):
            if spans and spans[-1][1] + 1 == lo:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        within = F.lit(False)
        for lo, hi in spans:
            within = within | F.col("k1").between(lo, hi)
        if int(order.count[at].sum()) <= cells or int(order.width[at].min()) == 0:
            # Few groups are left, or groups of one first hash: single ones.
            found = light.where(within).sort("k1", "k2").select("bytes", "k1", "k2").collect()
            new = [(r["bytes"], r["bytes"], 1, r["k1"], r["k2"], -1) for r in found]
        else:
            keys = sum(hi - lo + 1 for lo, hi in spans)
            finer = min(max(0, (keys // cells).bit_length()), int(order.width[at].min()) - 1)
            new = _ranges(light, finer, within)
        n_heavy = len(heavy)
        kept = [tuple(int(x[i]) for x in (order.sums, order.largest, order.count, order.k1, order.k2, order.width)) for i in range(n_heavy, len(order.sums)) if not open_[i]]
        order = _order([*heavy, *sorted([*kept, *new], key=lambda c: (c[3], c[4]))])
    return order


@dataclass
class Plan:
    """Shards of heavy groups by key, and the last keys of the shards of the others."""

    heavy: list[tuple[int, int, int]]
    base: int
    cuts: list[tuple[int, int]]
    capacity: int


def plan(groups: DataFrame, shards: int = SHARDS, grain: int = GRAIN, cells: int = CELLS) -> Plan:
    """Where to cut. ``groups`` has k1, k2 and bytes, one row a group."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    big = F.col("bytes") * (shards * grain) > F.lit(total)
    rows = groups.where(big).select("bytes", "k1", "k2").collect()  # fewer than shards * grain
    heavy = sorted(((r["bytes"], r["k1"], r["k2"]) for r in rows), key=lambda g: (-g[0], g[1], g[2]))
    own = 0
    while own < min(len(heavy), shards - 1) and heavy[own][0] * (shards - own) >= total:
        total -= heavy[own][0]
        own += 1
    placed = [(k1, k2, i) for i, (_, k1, k2) in enumerate(heavy[:own])]
    rest, left = heavy[own:], shards - own
    order = settle([(b, b, 1, k1, k2, -1) for b, k1, k2 in rest], groups.where(~big), left, cells)
    if not order.total:
        return Plan(placed, own, [], max((b for b, _, _ in heavy[:own]), default=0))
    room = order.least(left, order.latest)
    ends = order.even(room, left)
    for i, (_, k1, k2) in enumerate(rest):
        placed.append((k1, k2, own + int(np.searchsorted(ends, order.ends[i], side="right"))))
    start = int(order.ends[len(rest)])
    inner = [e for e in ends if start < e < order.total]
    at = [int(np.searchsorted(order.ends, e)) - 1 for e in inner]
    return Plan(placed, own + int(np.searchsorted(ends, start, side="right")), [(int(order.k1[c]), int(order.k2[c])) for c in at], max(room, *(b for b, _, _ in heavy[:own]), 0) if own else room)


def shard(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN, cells: int = CELLS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: one row per input row."""
    spark = docs.sparkSession
    rows = sized(docs)
    groups = materialize(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "shard-groups")
    p = plan(groups, shards, grain, cells)
    forget(groups)
    # Fewer than shards * grain rows: a proven bound.
    known = F.broadcast(spark.createDataFrame(p.heavy, "k1 long, k2 long, heavy_shard int"))
    # One row a cut, of which there are fewer than shards.
    cuts = F.array(*[F.struct(F.lit(k1).alias("k1"), F.lit(k2).alias("k2")) for k1, k2 in p.cuts]) if p.cuts else F.array().cast("array<struct<k1:long,k2:long>>")
    behind = F.lit(p.base) + F.size(F.filter(cuts, lambda c: (F.col("k1") > c["k1"]) | ((F.col("k1") == c["k1"]) & (F.col("k2") > c["k2"]))))
    dealt = rows.join(known, ["k1", "k2"], "left").select("row", "doc_id", "size", "text_crc32", F.coalesce("heavy_shard", behind).alias("shard"))
    most = dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, -(-most // range_rows))
    dealt = dealt.withColumn("range", F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int"))
    sizes = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("r", F.row_number().over(W.partitionBy("shard", "range").orderBy("row")) - 1)
    ranked = ranked.join(sizes.select("shard", "range", before.alias("b")), ["shard", "range"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("r") + F.col("b")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
