"""Streaming ingest (an extension): new documents to facts, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def start(spark: SparkSession, folder: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Watch a Parquet folder; facts of every new batch are appended to ``target``.

    A document is stored once, whenever it comes: the ids of batches done are kept in
    ``<target>_ids``, and a batch leaves out those that another batch stored. A batch that runs
    again after a failure overwrites its own folders, so it neither loses nor doubles a document.
    """
    ids = target.rstrip("/") + "_ids"

    def each(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(["doc_id"])
        if _exists(spark, ids):
            old = spark.read.parquet(ids).where(f"batch <> {epoch}").select("doc_id")
            new = new.join(old, "doc_id", "left_anti")
        new.select("doc_id").write.mode("overwrite").parquet(f"{ids}/batch={epoch}")
        facts.propose(new).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
