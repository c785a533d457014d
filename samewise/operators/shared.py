"""Helpers for plans that outlive the loss of executors: tables in the shared folder, global ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of this many bytes at most may be broadcast; its size is read from its files first.
BROADCAST_BYTES = 16 << 20
#: A batch that goes to Python ends with the row that brings it to so many bytes.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a new local one, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='samewise-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Shuffle files go when the query that made them ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut in the lineage that any executor can read again.

    The shuffle files of the write are deleted with its end; the session's setting for that is put back.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/samewise/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._samewise_path = path
    return out


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that ``written`` made."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._samewise_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._samewise_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if the written table it comes from is of a size for it; else as it is."""
    return F.broadcast(df) if table_bytes(df if of is None else of) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bounds the rows and the bytes of the batches that go to Python, for plans that send whole texts there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ranked(df: DataFrame, keys: list, rank: str) -> DataFrame:
    """Adds the place (from 0) of each row in the order of ``keys``, without bringing all rows to one task.

    The rows are range-partitioned and sorted once and written; the counts of the partitions, as many rows
    as there are partitions, are summed up and added to the places within them.
    """
    at, own, n = (fresh(df, x) for x in ("at", "part", "before"))
    laid = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33)
    before = starts(laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")), "_part", "_n").toDF(own, n)
    return laid.withColumn(own, part).join(F.broadcast(before), own).withColumn(rank, F.col(n) + F.col(at) - F.shiftleft(F.col(own), 33)).drop(own, at, n)


def starts(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, _before): the sum of ``n`` over smaller keys. For a table with one row a partition."""
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(key, (F.sum(n).over(w) - F.col(n)).alias("_before"))
