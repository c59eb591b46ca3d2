"""Array expressions that stay linear in the array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose sums are taken in one stretch, at least: long arrays have stretches of their root.
STRETCH = 16


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets it as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def running_sums(lengths: Column) -> Column:
    """Sums of the elements before each element (array<bigint>).

    Appending in a fold copies the array each time, so sums are taken within stretches as short
    as the array allows, then over the stretches.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("sum"), F.array().cast("array<long>").alias("at"))

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at")))

    def over(stretches: Column) -> Column:
        bases = fold(F.transform(stretches, lambda s: s["sum"]))["at"]
        return let(bases, lambda bs: F.flatten(F.transform(stretches, lambda s, i: F.transform(s["at"], lambda x: x + F.get(bs, i)))))

    def cut(xs: Column) -> Column:
        def stretches(size: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / size).cast("int"))
            return F.transform(numbers, lambda k: fold(F.slice(xs, k * size + 1, size)))

        return let(F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(F.size(xs))).cast("int")), stretches)

    return let(F.transform(lengths, lambda x: x.cast("long")), lambda xs: let(cut(xs), over))


def running_sums_sql(lengths: str) -> str:
    """:func:`running_sums` as SQL text, for expressions too wide to be built call by call."""
    start = "named_struct('sum', 0L, 'at', cast(array() as array<bigint>))"
    fold = lambda xs: f"aggregate({xs}, {start}, (acc, x) -> named_struct('sum', acc.sum + cast(x as bigint), 'at', concat(acc.at, array(acc.sum))))"
    last = "cast(floor((greatest(size(xs), 1) - 1) / sz) as int)"
    each = f"transform(sequence(0, {last}), k -> {fold('slice(xs, k * sz + 1, sz)')})"
    cut = f"transform(array({lengths}), xs -> transform(array(greatest({STRETCH}, cast(ceil(sqrt(size(xs))) as int))), sz -> {each})[0])[0]"
    over = f"transform(array({fold('transform(st, s -> s.sum)')}.at), bs -> flatten(transform(st, (s, i) -> transform(s.at, x -> x + get(bs, i)))))[0]"
    return f"transform(array({cut}), st -> {over})[0]"
