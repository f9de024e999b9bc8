"""Session-level helpers: table loading and durable intermediate tables.

Intermediate results that must not be recomputed are written below the shared
folder named by ``spark.checkpoint.dir``.  Every executor can read them again,
so the loss of an executor costs a re-read, never a lost block.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  A local one is chosen only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridgeplan-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{scratch_dir(spark)}/ridgeplan/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage and also forgets the physical partitioning, so that
    later joins get ordinary exchanges, which adaptive execution may split.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, ord_col: str, name: str) -> DataFrame:
    """Rows of a written table with their place from 1 by ``ord_col``, a monotonically_increasing_id.

    Its upper bits are the partition: partitions are counted, and each numbers its own rows.
    """
    part = F.shiftright(F.col(ord_col), 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # one row per partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(ord_col))
    met = rows.withColumn("__part", part).withColumn("__own", own).join(offsets, "__part")
    return met.withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables (results that still read them are lost), and no others."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
