"""SetSketch near-duplicates over word shingles.

Registers are exponentially spaced levels of truncated minima: register i of a set holds
``clip(floor(1 - log_b(min_e x_i(e))), 0, q + 1)`` with x_i(e) exponential of rate a. They merge
by maximum, and two sets agree in a register with a chance close to their Jaccard similarity.

1. One pass over the texts gives each document its shingle count, a 128-bit fingerprint of the
   shingle set, and the registers. Documents of one fingerprint form a class.
2. Bands, subsets of registers, put classes into buckets.
3. Buckets are compared in blocks of bounded size: sizes, one bit a register, then the
   maximum-likelihood similarity of both classes' registers. A block emits a spanning forest
   of what passes, never pairs; its components are the groups that can hold links.
4. The groups are compared in blocks again, now with the full shingle sets; only the exact
   result makes a link, and again a block emits a spanning forest.
5. Components of the links, over class representatives.

Classes have numbers of their own, so unlike texts under one id are compared each for itself.
Shingles are 64-bit hashes and classes 128-bit digests of the sorted hashes: two unlike shingles of
a pair of sets of n shingles agree with a chance below n^2 / 2^64 (1e-11 at 20,000 words), two
unlike sets of a corpus of 10^11 with one below 1e-16.

Defined results: null and empty texts have an empty set and link with nothing; rows without id
are kept alone with a null component; repeated rows share their class; a row's component holds
the rows reachable from its own text, whatever other texts its id has; very long texts are read
whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_broadcast, documents, forget, id_text, materialize, numbered, row_marks, same
from .components import connected_components

MASK = (1 << 64) - 1
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Near:
    """Shingle length, similarity as a percentage, and the sketch's parameters."""

    words: int = 5
    percent: int = 80
    registers: int = 256
    base: float = 1.2
    rate: float = 20.0
    top: int = 254
    bands: int = 64
    #: Pairs whose estimated similarity is this far below the threshold are not intersected:
    #: seven standard errors of the estimate at 256 registers.
    margin: float = 0.17
    #: Rows and bytes of shingle sets in a chunk; two chunks meet in a block.
    chunk: int = 1024
    block_bytes: int = 32 << 20

    @property
    def band_width(self) -> int:
        """Registers a band: as many as still agree all with a chance of 0.2 at the threshold, so
        that 64 bands of unlike registers miss a pair there with a chance of 0.8^64, below 1e-6.
        (Bands share registers; the tests measure what that costs.)"""
        j = self.percent / 100
        return max(1, int(np.log(0.2) / np.log(j + (1 - j) * np.log(self.base) / 4)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hashes of words; forgotten when many, as words of a corpus never end."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def shingles(text: str, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(k, len(words))
    out = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for j in range(span):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return np.unique(out)


def _multipliers(near: Near) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, MASK, near.registers, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, MASK, near.registers, dtype=np.uint64, endpoint=True)


def sketch(hashes: np.ndarray, near: Near, family=None) -> np.ndarray:
    """Registers of a set of hashes, one byte each; blocks keep memory flat for any set."""
    a, b = family or _multipliers(near)
    least = np.full(near.registers, MASK, dtype=np.uint64)
    for i in range(0, len(hashes), 256):
        block = hashes[i : i + 256, None] * a[None, :]
        block += b[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / near.rate
    level = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(near.base))
    out = np.clip(level, 0, near.top + 1).astype(np.uint8)
    return out if len(hashes) else np.zeros(near.registers, dtype=np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hashes k1, k2 of both."""
    base = id_text(docs)
    return base.select("*", *row_marks(base))


def features(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, row hashes, n_shingles, fingerprint and registers of every row, in one pass over the texts."""

    def run(batches):
        from xxhash import xxh3_128_digest

        cache, family = _WordHash(), _multipliers(near)
        last: tuple[bytes, bytes] = (b"", b"")
        for pdf in batches:
            out = []
            for doc, k1, k2, text in zip(pdf.doc_id, pdf.k1, pdf.k2, pdf.text):
                s = shingles(text, near.words, cache)
                mark = xxh3_128_digest(s.tobytes())
                if mark != last[0]:
                    last = (mark, sketch(s, near, family).tobytes())
                out.append((doc, k1, k2, len(s), mark, last[1]))
            yield pd.DataFrame(out, columns=["doc_id", "k1", "k2", "n", "mark", "regs"]).astype({"doc_id": "Int64"})

    return marked(docs).mapInPandas(run, "doc_id long, k1 long, k2 long, n long, mark binary, regs binary")


def _band_keys(near: Near):
    rng = np.random.default_rng(7)
    picks = np.array([rng.permutation(near.registers)[: near.band_width] for _ in range(near.bands)])
    odd = rng.integers(0, MASK, near.band_width, dtype=np.uint64, endpoint=True) | np.uint64(1)

    @pandas_udf("array<long>")
    def keys(regs: pd.Series) -> pd.Series:
        if not len(regs):
            return pd.Series([], dtype=object)
        m = np.frombuffer(b"".join(regs), dtype=np.uint8).reshape(len(regs), -1)
        out = np.empty((len(regs), near.bands), dtype=np.uint64)
        for t in range(near.bands):
            out[:, t] = _mix((m[:, picks[t]].astype(np.uint64) * odd[None, :]).sum(axis=1, dtype=np.uint64) + np.uint64(t))
        return pd.Series(list(out.view(np.int64)))

    return keys


def _most_bits(near: Near) -> int:
    """Unlike bits at the threshold, plus seven standard deviations. Unlike minima still share
    a level in about a quarter of log(base) of the cases."""
    j = near.percent / 100
    unlike = near.registers * (1 - j) * (1 - np.log(near.base) / 4) / 2
    return int(np.ceil(unlike + 7 * np.sqrt(unlike)))


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from registers that are larger in a, in b, or equal.

    With u and v the sets' shares of the two sizes, a register is larger in a with chance
    p(u - v J), in b with p(v - u J), for p(x) = -log_b(1 - x (b - 1) / b). The log-likelihood
    has one maximum in J; a search by halving its derivative's sign finds it.
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    lo, hi, c, lb = np.zeros(len(u)), most.copy(), (base - 1) / base, np.log(base)

    def level(j):
        pu = -np.log1p(-np.clip(u - v * j, 0, 1) * c) / lb
        pd_ = -np.log1p(-np.clip(v - u * j, 0, 1) * c) / lb
        tiny = 1e-12
        return up * np.log(pu + tiny) + down * np.log(pd_ + tiny) + same * np.log(np.maximum(1 - pu - pd_, tiny))

    for _ in range(30):
        left, right = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = level(left) < level(right)
        lo, hi = np.where(better, left, lo), np.where(better, hi, right)
    return (lo + hi) / 2


def _likely(up, down, same, na, nb, base: float, least: float) -> np.ndarray:
    """Whether the estimate of joint_estimate is at least ``least``: its likelihood still rises there."""
    u, v = na / (na + nb), nb / (na + nb)
    c, step = (base - 1) / base, 1e-6

    def level(j):
        more, less = (np.maximum(-np.log1p(-np.clip(x, 0, 1) * c) / np.log(base), 1e-12) for x in (u - v * j, v - u * j))
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    return level(least + step) >= level(least - step)


class _Block:
    """Rows that meet, as arrays ordered by set size; sets only where the exact test is due."""

    def __init__(self, rows: pd.DataFrame, near: Near, table: np.ndarray, exact: bool):
        rows = rows.sort_values(["n", "rep"], ignore_index=True)
        self.near, self.rep, self.n = near, rows["rep"].to_numpy(), rows["n"].to_numpy(np.float64)
        self.side = rows["side"].to_numpy() if rows["side"].nunique() > 1 else None
        self.comp = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        self.regs = np.frombuffer(b"".join(rows["regs"]), dtype=np.uint8).reshape(len(rows), -1)
        self.bits = np.packbits(table[np.arange(self.regs.shape[1])[None, :], self.regs], axis=1).view(np.uint64)
        self.exact = exact
        if exact:
            at = np.cumsum([0, *(len(x) // 8 for x in rows["s"])])
            self.first, self.last = at[:-1], at[1:]
            kinds, self.ids = np.unique(np.frombuffer(b"".join(rows["s"]), dtype=np.uint64), return_inverse=True)
            self.mark = np.zeros(len(kinds), dtype=bool)

    def near_of(self, i: int, j: np.ndarray) -> np.ndarray:
        """Those of the rows j that pass the tests against row i."""
        near = self.near
        j = j[np.bitwise_count(self.bits[j] ^ self.bits[i]).sum(axis=1) <= _most_bits(near)]
        if len(j):
            a, b = self.regs[i][None, :], self.regs[j]
            up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
            j = j[_likely(up, down, near.registers - up - down, self.n[i], self.n[j], near.base, near.percent / 100 - near.margin)]
        if len(j) and self.exact:
            own = self.ids[self.first[i] : self.last[i]]
            self.mark[own] = True
            size = self.last[j] - self.first[j]
            both = np.add.reduceat(self.mark[np.concatenate([self.ids[self.first[k] : self.last[k]] for k in j])].astype(np.int64), np.cumsum(size) - size)
            self.mark[own] = False
            j = j[100 * both >= near.percent * (len(own) + size - both)]
        return j

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links between unlike components."""
        out, comp, left = [], self.comp, len(np.unique(self.comp))
        reach = np.searchsorted(self.n * self.near.percent, 100 * self.n, side="right")
        for i in range(len(comp)):
            if left < 2:
                break
            j = np.arange(i + 1, reach[i])
            j = j[comp[j] != comp[i]]
            if self.side is not None:
                j = j[self.side[j] != self.side[i]]
            j = self.near_of(i, j) if len(j) else j
            if len(j):
                joined, at = np.unique(comp[j], return_index=True)
                out += [(int(self.rep[i]), int(self.rep[k])) for k in j[at]]
                comp[np.isin(comp, joined)] = comp[i]
                left -= len(joined)
        return out


def _compare(rows: DataFrame, near: Near, exact: bool) -> DataFrame:
    """Links (u, v) inside each block of (key, c1, c2); a task holds one block at a time."""
    block = ["key", "c1", "c2"]

    def run(batches):
        level = np.arange(near.top + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        table = (_mix(level[None, :] + np.arange(near.registers, dtype=np.uint64)[:, None]) >> np.uint64(63)).astype(np.uint8)
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[block].to_numpy()
            cuts = [0, *(np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1), len(pdf)]
            out = []
            if held and tuple(held[-1][block].iloc[-1]) != tuple(ids[0]):
                out += _Block(pd.concat(held), near, table, exact).links()
                held = []
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                out += _Block(pd.concat([*held, pdf.iloc[a:b]]) if held else pdf.iloc[a:b], near, table, exact).links()
                held = []
            held.append(pdf.iloc[cuts[-2] :])
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
        if held and (out := _Block(pd.concat(held), near, table, exact).links()):
            yield pd.DataFrame(out, columns=["u", "v"])

    return rows.repartition(*block).sortWithinPartitions(*block).mapInPandas(run, "u long, v long")


def _sweep(members: DataFrame, payload: DataFrame, near: Near, exact: bool) -> DataFrame:
    """node, component of all links inside the groups of ``members`` (key, rep, w).

    w is the part of a block that a row fills. Groups of one block are compared at once. Larger
    groups are first compared within chunks that all hold the group's hub, which joins most of
    a dense group in time linear in its size. Then every pair of chunks meets, but for those
    whose rows are of one component already. Nothing is left out: a pair is compared or joined.
    """
    per = members.groupBy("key").agg(F.ceil(F.sum("w")).alias("chunks"), F.min("rep").alias("hub"))
    per = materialize(per, "near-per")
    large = per.where("chunks > 1")
    zero = F.lit(0).cast("long")
    rows = members.join(per, "key").select("key", F.pmod(F.xxhash64("rep"), "chunks").alias("c1"), "rep")
    hubs = large.select("key", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("c1"), F.col("hub").alias("rep"))
    met = rows.unionByName(hubs).distinct().withColumn("c2", F.col("c1")).withColumn("side", zero).withColumn("label", F.col("rep"))
    links = materialize(_compare(met.join(payload, "rep"), near, exact), "near-links")
    label = connected_components(links)
    if large.limit(1).count():
        now = members.join(large.select("key"), "key", "left_semi").join(label, F.col("rep") == F.col("node"), "left")
        now = materialize(now.select("key", "rep", "w", F.coalesce("component", "rep").alias("label")), "near-now")
        # A component that fills blocks has chunks of its own; small ones share chunks.
        own = now.groupBy("key", "label").agg(F.sum("w").alias("w"))
        own = own.withColumn("of", F.when(F.col("w") >= 1, F.col("label")))
        chunk = own.groupBy("key", "of").agg(F.ceil(F.sum("w")).alias("chunks"), F.count("*").alias("labels"))
        named = now.join(own.select("key", "label", "of"), ["key", "label"]).alias("r").join(chunk.alias("k"), F.expr("r.key = k.key and r.of <=> k.of"))
        named = named.select("r.key", "rep", "label", "r.of", F.pmod(F.xxhash64("rep"), "chunks").alias("c"))
        # Chunks are numbered by a hash of (component, number): any order serves.
        mark = lambda of, c: F.xxhash64(F.coalesce(of.cast("string"), F.lit("shared")), c)
        other = chunk.select("key", F.col("of").alias("of2"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("o"))
        other = other.select("key", "of2", mark(F.col("of2"), F.col("o")).alias("m2"))
        named = named.withColumn("m1", mark(F.col("of"), F.col("c")))
        pairs = named.join(other, "key").where("of is null or of2 is null or of <> of2")
        pairs = pairs.select("key", F.least("m1", "m2").alias("c1"), F.greatest("m1", "m2").alias("c2"), F.when(F.col("m1") != F.col("m2"), F.col("m1")).otherwise(zero).alias("side"), "rep", "label")
        more = materialize(_compare(pairs.join(payload, "rep"), near, exact), "near-more")
        label = connected_components(links.unionByName(more))
    return label


def _sets(docs: DataFrame, want: DataFrame, near: Near) -> DataFrame:
    """rep and s: the full shingle sets of the classes in ``want`` (rep, k1, k2 of one of its rows, mark)."""
    few = bounded_broadcast(want, want.count(), 48)

    def run(batches):
        from xxhash import xxh3_128_digest

        cache = _WordHash()
        for pdf in batches:
            sets = [shingles(t, near.words, cache).tobytes() for t in pdf.text]
            right = [xxh3_128_digest(x) == m for x, m in zip(sets, pdf["mark"])]
            yield pd.DataFrame({"rep": pdf.rep, "s": sets})[right]

    found = marked(docs).join(few, ["k1", "k2"]).select("rep", "mark", "text").mapInPandas(run, "rep long, s binary")
    return found.groupBy("rep").agg(F.first("s").alias("s"))  # repeated rows give one set


def near_rows(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per input row: doc_id, hashes k1 and k2 of id and text, n_shingles, component_id, kept."""
    rows = materialize(features(docs, near), "near-rows")
    full = rows.where("doc_id is not null and n > 0")
    least = F.min(F.struct("doc_id", "k1", "k2")).alias("x")
    classes = full.groupBy("mark").agg(least, F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = numbered(classes.select("mark", F.col("x.doc_id").alias("low"), "x.k1", "x.k2", "n", "regs"), "near-classes", "rep")
    keyed = materialize(classes.select("rep", F.explode(_band_keys(near)("regs")).alias("key")), "near-keys")
    # Buckets of the same members, by two 64-bit digests, are compared once.
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    shared = shared.where("size > 1").groupBy("size", "first", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = materialize(keyed.join(shared, "key").withColumn("w", F.lit(1 / near.chunk)), "near-members")
    forget(keyed)
    payload = classes.select("rep", "n", "regs")
    group = materialize(_sweep(members, payload, near, False), "near-groups")
    forget(members)
    weight = F.greatest(F.lit(1 / near.chunk), F.col("n") * 8 / near.block_bytes)
    met = group.join(classes, F.col("node") == F.col("rep"))
    grouped = materialize(met.select(F.col("component").alias("key"), "rep", weight.alias("w")), "near-grouped")
    sets = materialize(payload.join(_sets(docs, met.select("rep", "k1", "k2", "mark"), near), "rep"), "near-sets")
    label = materialize(_sweep(grouped, sets, near, True), "near-label")
    forget(group, grouped, sets)
    # Numbers mean nothing outside: a component is called by its smallest doc_id.
    lows = label.join(classes.select("rep", "low"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("low").alias("component_id"))
    label = label.join(lows, "component").select("node", "component_id")
    named = classes.select("mark", "rep", "low").join(label, F.col("rep") == F.col("node"), "left").select("mark", F.coalesce("component_id", "low").alias("component_id"))
    out = full.select("doc_id", "k1", "k2", "n", "mark").join(named, "mark").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("doc_id is null or n = 0").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return near_rows(docs, near).drop("k1", "k2")


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The input's rows but for near copies of an earlier document, with the input's columns.

    A row goes by its id and text, so other texts under its id stay. Rows without id or words stay.
    """
    found = near_rows(docs, near)
    gone = found.where(~F.col("kept")).select("k1", "k2").distinct()
    names = docs.columns
    packed = docs.select(F.struct(*[same(c).alias(c) for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = packed.select("row", *row_marks(packed, ["doc_id", "text"]))
    return packed.join(gone, ["k1", "k2"], "left_anti").select(*[F.col("row")[c].alias(c) for c in names])


#: The contract's shingles and threshold.
CONTRACT = Near(words=3, percent=85)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), CONTRACT)


def oracle(near: Near = CONTRACT) -> str:
    """Shingles as joined words, links by counting shared ones, components by a recursive query."""
    upper, k = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", near.words
    return f"""WITH RECURSIVE d AS (SELECT doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END AS s FROM d),
    kind AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s),
    class AS (SELECT min(doc_id) AS c, n, s FROM kind WHERE n > 0 AND doc_id IS NOT NULL GROUP BY n, s),
    each_ AS (SELECT c, n, unnest(s) AS x FROM class),
    pair AS (SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS held FROM each_ a JOIN each_ b ON a.x = b.x AND a.c < b.c GROUP BY ALL),
    link AS (SELECT x, y FROM pair WHERE 100 * held >= {near.percent} * (nx + ny - held)),
    two AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach(x, y) AS (SELECT c, c FROM class UNION SELECT reach.x, two.y FROM reach JOIN two ON two.x = reach.y),
    low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
    SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(low.component_id, k.doc_id) AS component_id,
      k.doc_id IS NOT DISTINCT FROM coalesce(low.component_id, k.doc_id) AS kept
    FROM kind k LEFT JOIN class ON k.n = class.n AND k.s = class.s AND k.n > 0 AND k.doc_id IS NOT NULL LEFT JOIN low ON low.x = class.c"""
