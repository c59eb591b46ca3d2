"""Fill-in-middle transformation by a parallel automaton scan.

A text's units are its lines. One byte automaton knows both where a line begins and whether a
sentinel stands anywhere. As its entry state is unknown inside a text, a stretch of bytes is scanned
from every state at once: it gives a function from entry to end state, and for each entry state the
number of lines that begin in it. Functions compose associatively, so stretches are scanned apart:

1. Short texts (up to ``chunk`` bytes): all stretches of many texts advance together, one byte a
   step, in one Arrow function; prefixes of functions are composed by doubling. The text itself
   stays in the JVM, and only the number of lines and two byte offsets come back. No shuffle.
2. Giant texts are cut into chunks, which are dealt over the cluster and scanned apart. Their
   functions are composed per stretch of 256 chunks, then over the stretches of a document, which
   resolves every chunk's entry state and the number of lines before it.
3. Selection: the chunk with the line sought follows from those numbers; it alone is scanned again,
   from its known state, for the byte where that line begins.

Cuts fall where lines begin, so no character is split. The output is put together by Spark
expressions from byte slices, and so is the way back (:func:`restored`).

Defined results: null and empty texts are plain and empty, with no lines; a text that holds a
sentinel is plain, whatever its size; rows without doc_id take their numbers from ``seed:`` with
nothing behind it; repeated rows give repeated results, as all is decided by id and text; very long
texts are scanned whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import documents, id_text, numbered

SEED, PERCENT, SPM = 7, 100, 50
#: Sentinels before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk of a giant text; bytes of a stretch that advances as one; bytes held as arrays at a time.
CHUNK, WIDTH, HELD = 32_768, 256, 4 << 20
#: Chunks whose functions are composed in one row before those of the document.
STRETCH = 256


class Automaton:
    """Lines and sentinels over bytes: state (at a line's start, longest sentinel prefix read or SEEN).

    ``next`` and ``emit`` are flat tables over class * states + state; ``emit`` is 1 where a line
    begins with this byte. The last class is padding, which changes nothing. State 0 begins a text.
    """

    def __init__(self, marks: tuple[str, ...] = MARKS):
        words = [m.encode() for m in marks]
        assert all(words), "a sentinel cannot be empty"
        prefixes = {w[:k] for w in words for k in range(len(w))}

        def step(state, byte):
            read = state[1]
            if read is not None:
                read += bytes([byte])
                if any(read.endswith(w) for w in words):
                    read = None
                else:
                    while read not in prefixes:
                        read = read[1:]
            return byte == 10, read

        first = (True, b"")
        number, todo, moves = {first: 0}, deque([first]), []
        while todo:
            state = todo.popleft()
            row = [step(state, b) for b in range(256)]
            for s in row:
                if s not in number:
                    number[s] = len(number)
                    todo.append(s)
            moves.append([number[s] for s in row])
        columns, self.classes = np.unique(np.array(moves).T, axis=0, return_inverse=True)
        self.states = len(number)
        self.pad = len(columns)
        kinds = np.uint8 if (self.pad + 1) * self.states <= 256 else np.uint16
        begins = np.array([s[0] for s in number])
        self.next = np.vstack([columns, np.arange(self.states)]).astype(kinds).ravel()
        self.emit = np.vstack([np.tile(begins, (self.pad, 1)), np.zeros(self.states, bool)]).astype(np.uint8).ravel()
        self.seen = np.array([s[1] is None for s in number])
        # Classes times states, so that a state is simply added.
        self.classes = (self.classes.ravel() * self.states).astype(kinds)
        self.pad = kinds(self.pad * self.states)

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Scan:
        return Scan(self, data, starts, ends)


class Scan:
    """Texts (byte ranges of ``data``) scanned from every state, stretch by stretch side by side."""

    def __init__(self, auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.auto = auto
        sizes = -(-(ends - starts) // WIDTH)
        self.first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(starts)), sizes)
        self.place = np.arange(len(of)) - self.first[of]
        begin = starts[of] + self.place * WIDTH
        at = begin[:, None] + np.arange(WIDTH)
        self.codes = np.where(at < ends[of][:, None], auto.classes[data[np.minimum(at, max(len(data) - 1, 0))]], auto.pad) if len(of) else np.zeros((0, WIDTH), auto.classes.dtype)
        to = np.tile(np.arange(auto.states, dtype=auto.next.dtype), (len(of), 1))
        n = np.zeros((len(of), auto.states), np.int64)
        count = np.zeros((len(of), auto.states), np.uint16)
        for column in np.ascontiguousarray(self.codes.T):
            key = column[:, None] + to
            count += auto.emit[key]
            to = auto.next[key]
        n += count
        # Inclusive prefixes by doubling: after the step of s, a function covers 2 s stretches.
        s = 1
        while s <= self.place.max(initial=0):
            rows = np.flatnonzero(self.place >= s)
            before = to[rows - s]
            through, more = to[rows[:, None], before], n[rows - s] + n[rows[:, None], before]
            to[rows], n[rows] = through, more
            s *= 2
        self.to, self.n, self.of, self.sizes = to, n, of, sizes

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text and entry state: the end state and the number of lines begun."""
        to = np.tile(np.arange(self.auto.states, dtype=np.int64), (len(self.sizes), 1))
        n = np.zeros_like(to)
        some = np.flatnonzero(self.sizes)
        last = self.first[some] + self.sizes[some] - 1
        to[some], n[some] = self.to[last], self.n[last]
        return to, n

    def select(self, texts: np.ndarray, states: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Byte, from the text's start, where line ``rank`` (from 0) of a text entered in ``state`` begins.

        Ranks must be less than the text's number of lines.
        """
        if not len(texts):
            return np.zeros(0, np.int64)
        # Per asked text a binary search over its stretches, all searches side by side.
        low, high = np.zeros(len(texts), np.int64), self.sizes[texts] - 1
        while (low < high).any():
            mid = (low + high) // 2
            there = self.n[self.first[texts] + mid, states] > ranks
            low, high = np.where(there, low, np.minimum(mid + 1, high)), np.where(there, mid, high)
        at = self.first[texts] + low
        inside = low > 0
        entry, done = states.astype(self.to.dtype), np.zeros(len(texts), np.int64)
        entry[inside], done[inside] = self.to[at[inside] - 1, states[inside]], self.n[at[inside] - 1, states[inside]]
        hits = np.zeros((len(texts), WIDTH), np.uint8)
        for j in range(WIDTH):
            key = self.codes[at, j] + entry
            hits[:, j], entry = self.auto.emit[key], self.auto.next[key]
        return low * WIDTH + (np.cumsum(hits, axis=1, dtype=np.int64) == (ranks - done + 1)[:, None]).argmax(axis=1)


def _ranges(texts: pa.Array):
    """The bytes of a string or binary array, and each value's range: no copy."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def _held(starts: np.ndarray, ends: np.ndarray):
    """Runs of texts of about HELD bytes, so that memory does not grow with the batch."""
    group = np.cumsum(ends - starts) // HELD
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    return [slice(a, b) for a, b in zip(edges, [*edges[1:], len(starts)])]


def cuts_of(auto: Automaton):
    """(text, u, v) to its number of lines, whether it holds a sentinel, and the byte offsets behind
    the smaller and the larger of u mod (lines + 1) and v mod (lines + 1) lines."""

    @arrow_udf("struct<n: bigint, marked: boolean, c1: bigint, c2: bigint>")
    def cuts(texts: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
        data, starts, ends = _ranges(texts)
        draws = np.stack([u.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)])
        out = [np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)]
        for part in _held(starts, ends):
            lo, hi = starts[part], ends[part]
            scan = auto.scan(data[lo[0] : hi[-1]], lo - lo[0], hi - lo[0])
            to, n = (x[:, 0] for x in scan.functions())
            ranks = np.sort(draws[:, part] % (n + 1), axis=0)
            out[0][part], out[1][part] = n, auto.seen[to]
            for k in (0, 1):
                at = np.where(ranks[k] == n, hi - lo, 0)
                inner = np.flatnonzero((ranks[k] > 0) & (ranks[k] < n))
                at[inner] = scan.select(inner, np.zeros(len(inner), np.int64), ranks[k][inner])
                out[2 + k][part] = at
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "marked", "c1", "c2"])

    return cuts


def functions_of(auto: Automaton):
    """A chunk to its function: end state and lines begun, by entry state."""

    @arrow_udf("struct<to: array<bigint>, n: array<bigint>>")
    def scanned(chunks: pa.Array) -> pa.Array:
        data, starts, ends = _ranges(chunks)
        found = [[], []]
        for part in _held(starts, ends):
            lo, hi = starts[part], ends[part]
            for have, new in zip(found, auto.scan(data[lo[0] : hi[-1]], lo - lo[0], hi - lo[0]).functions()):
                have.append(new.ravel())
        edges = pa.array(np.arange(len(chunks) + 1, dtype=np.int32) * auto.states)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, pa.array(x)) for x in flat], ["to", "n"])

    return scanned


def places_of(auto: Automaton):
    """(chunk, entry state, rank) to the byte where that line begins."""

    @arrow_udf("bigint")
    def place(chunks: pa.Array, states: pa.Array, ranks: pa.Array) -> pa.Array:
        data, starts, ends = _ranges(chunks)
        state, rank = states.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(chunks), np.int64)
        for part in _held(starts, ends):
            lo, hi = starts[part], ends[part]
            scan = auto.scan(data[lo[0] : hi[-1]], lo - lo[0], hi - lo[0])
            asked = np.flatnonzero(rank[part] >= 0)
            found = np.zeros(len(lo), np.int64)
            found[asked] = scan.select(asked, state[part][asked], rank[part][asked])
            out[part] = found
        return pa.array(out)

    return place


def then(f: Column, g: Column) -> Column:
    """The function of a stretch, then that of the next one. Associative."""
    to = F.transform(f["to"], lambda q: F.get(g["to"], q.cast("int")))
    n = F.zip_with(f["n"], f["to"], lambda k, q: k + F.get(g["n"], q.cast("int")))
    return F.struct(to.alias("to"), n.alias("n"))


def entries(chunks: DataFrame, states: int) -> DataFrame:
    """row, chunks (array of chunk, state, before: entry state and lines begun before), n, last state.

    ``chunks`` has row, chunk, to, n. One document's array is bounded: a value holds 2 GB at most,
    so 65,536 chunks, and composing it never reads the text.
    """
    none = F.struct(F.array(*[F.lit(q).cast("long") for q in range(states)]).alias("to"), F.array(*[F.lit(0).cast("long")] * states).alias("n"))
    sorted_list = lambda *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    each = chunks.groupBy("row", F.floor(F.col("chunk") / STRETCH).alias("stretch")).agg(sorted_list("chunk", "to", "n").alias("cs"))
    kind = "array<struct<chunk:bigint,f:struct<to:array<bigint>,n:array<bigint>>>>"
    start = F.struct(none.alias("f"), F.array().cast(kind).alias("each"))
    folded = F.aggregate(F.col("cs"), start, lambda a, c: F.struct(then(a["f"], c).alias("f"), F.concat(a["each"], F.array(F.struct(c["chunk"].alias("chunk"), a["f"].alias("f")))).alias("each")))
    each = each.select("row", "stretch", folded.alias("s")).select("row", "stretch", "s.f", "s.each")
    whole = each.groupBy("row").agg(sorted_list("stretch", "f", "each").alias("ss"))
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("q"), zero.alias("n"), F.array().cast("array<array<struct<chunk:bigint,state:bigint,before:bigint>>>").alias("each"))

    def step(a: Column, s: Column) -> Column:
        q = a["q"].cast("int")
        here = F.transform(s["each"], lambda c: F.struct(c["chunk"].alias("chunk"), F.get(c["f"]["to"], q).alias("state"), (a["n"] + F.get(c["f"]["n"], q)).alias("before")))
        return F.struct(F.get(s["f"]["to"], q).alias("q"), (a["n"] + F.get(s["f"]["n"], q)).alias("n"), F.concat(a["each"], F.array(here)).alias("each"))

    done = whole.select("row", F.aggregate(F.col("ss"), begin, step).alias("d"))
    return done.select("row", F.flatten("d.each").alias("chunks"), F.col("d.n").alias("n"), F.col("d.q").alias("last"))


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def cut_points(docs: DataFrame, seed: int = SEED, marks: tuple[str, ...] = MARKS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, h3, h4, n, marked, c1, c2: every text with its lines counted and its cuts as byte offsets."""
    auto = Automaton(marks)
    h = _draws(seed)
    base = id_text(docs).select("doc_id", "text", *[c.alias(f"h{k + 1}") for k, c in enumerate(h)])
    size = F.octet_length("text")
    short = base.where(size <= chunk).withColumn("c", cuts_of(auto)("text", "h1", "h2"))
    short = short.select("doc_id", "text", "h3", "h4", "c.n", "c.marked", "c.c1", "c.c2")
    long = numbered(base.where(size > chunk), "fim-long", "row")
    part = lambda k: F.substring(F.col("text").cast("binary"), (k * chunk + 1).cast("int"), F.lit(chunk))
    cut = long.select("row", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk))).alias("chunk"))
    cut = cut.select("row", "chunk", part(F.col("chunk")).alias("part")).repartition("row", "chunk")
    found = cut.select("row", "chunk", functions_of(auto)("part").alias("f")).select("row", "chunk", "f.to", "f.n")
    known = entries(found, auto.states)
    seen = F.get(F.array(*[F.lit(bool(x)) for x in auto.seen]), F.col("last").cast("int"))
    rows = long.join(known.select("row", "chunks", "n", seen.alias("marked")), "row")
    ranks = [F.col(f"h{k}") % (F.col("n") + 1) for k in (1, 2)]
    rows = rows.withColumn("a", F.least(*ranks)).withColumn("b", F.greatest(*ranks))

    def chunk_of(rank: str) -> Column:
        return F.element_at(F.filter(F.col("chunks"), lambda c: c["before"] <= F.col(rank)), -1)

    for rank, name in (("a", "c1"), ("b", "c2")):
        inner = (F.col(rank) > 0) & (F.col(rank) < F.col("n"))
        rows = rows.withColumn("_at", F.when(inner, chunk_of(rank)))
        text = F.when(inner, part(F.col("_at.chunk"))).otherwise(F.lit(b""))
        place = places_of(auto)(text, F.coalesce("_at.state", F.lit(0)), F.coalesce(F.col(rank) - F.col("_at.before"), F.lit(-1)))
        rows = rows.withColumn("_place", place)
        rows = rows.withColumn(name, F.when(inner, F.col("_at.chunk") * chunk + F.col("_place")).when(F.col(rank) == 0, 0).otherwise(size))
    return short.unionByName(rows.select(*short.columns))


def transform(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm: int = SPM, marks: tuple[str, ...] = MARKS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per input row.

    ``percent`` of the documents are transformed, ``spm`` percent of those with the suffix first.
    """
    p, s, m = (F.lit(x) for x in marks)
    cut = cut_points(docs, seed, marks, chunk)
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= percent)
    body = F.col("text").cast("binary")
    piece = lambda a, b: F.substring(body, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    zero, end = F.lit(0), F.octet_length("text")
    out = cut.select(
        "doc_id", "text", "n", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"),
        *[F.when(~plain, piece(a, b)).alias(name) for name, a, b in (("prefix", zero, F.col("c1")), ("middle", F.col("c1"), F.col("c2")), ("suffix", F.col("c2"), end))],
    )
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    )
    return out.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text, from its transformed form alone. Each sentinel stands once there: no text that holds
    one is transformed, and pieces are joined by sentinels only."""
    p, s, m = marks
    back = lambda first, second: (
        F.substring_index(F.substring_index(output, second, 1), first, -1),
        F.substring_index(F.substring_index(output, m, 1), second, -1),
    )
    middle = F.substring_index(output, m, -1)
    prefix, suffix = back(p, s)
    suffix_first, prefix_second = back(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_second, middle, suffix_first))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
