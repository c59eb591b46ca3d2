"""Tables in the cluster's shared folder, and keys of rows.

Intermediate results that are read more than once are written as Parquet tables below
``spark.checkpoint.dir``, a folder every executor sees, so a lost executor costs a re-read
and never a wrong or failed result. They go when the driver ends, or by :func:`forget`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Folders made for local sessions that name none, by application.
_LOCAL: dict[str, str] = {}
_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master, whose one machine runs every task, may
    do without the setting; elsewhere its absence is an error, as no other folder is shared."""
    context = spark.sparkContext
    found = context.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{SETTING} is not set; it must name a folder that the driver and all executors share")
        found = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spanloom-")
        _LOCAL[context.applicationId] = found
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder, which goes when the driver ends."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/spanloom/{context.applicationId}"
    if context.applicationId not in _ROOTS:
        _ROOTS.add(context.applicationId)
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        path = getattr(t, "_spanloom_path", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def same(c: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def _plain(c: str, kind) -> Column:
    """A form of the column that can be hashed: maps and variants have none of their own."""
    return F.to_json(F.struct(same(c).alias("v"))) if "map<" in kind or "variant" in kind else same(c)


def row_marks(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Two 64-bit hashes of a row, ``k1`` and ``k2``: rows with both equal are taken as equal.

    They tell rows of one id apart. Two unlike rows of one id agree with a chance of 2^-128.
    """
    kinds = dict(df.dtypes)
    cols = [_plain(c, kinds[c]) for c in (names or df.columns)]
    nulls = F.concat(*[F.when(same(c).isNull(), "0").otherwise("1") for c in (names or df.columns)])
    return [F.xxhash64(nulls, *cols).alias("k1"), F.xxhash64(F.lit("spanloom"), nulls, *cols).alias("k2")]


def numbered(df: DataFrame, name: str, by: str) -> DataFrame:
    """``df`` written with a unique number per row in column ``by``.

    The numbers are fixed by writing them: a task that runs again before the commit may number
    otherwise, but every reader sees the committed ones.
    """
    return materialize(df.withColumn(by, F.monotonically_increasing_id()), name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, for work that costs far more per byte than a shuffle does.

    A table of fewer splits than the cluster has cores leaves some idle; its rows are dealt by a hash
    of ``key``. Larger tables, whose splits are many, are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, key)
