"""Scratch tables in the shared checkpoint folder, and joins whose broadcast is guarded by a count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a table of a few fixed-width columns is broadcast (16 bytes a row: 32 MB at most).
BROADCAST_ROWS = 2_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="relspan-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends at files that outlive any executor.

    The files are deleted when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/relspan-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], total: int, least: int = 1000, most: int = 20_000) -> DataFrame:
    """rows joined with counts(keys, n, ...), of which n is the number of rows of a key; total is that of all rows.

    Keys of over `least` rows, and of over a `most`-th of all, are met by a broadcast, so that none lands in one task:
    as they share the rows between them, there are at most `most` (or total / least) of these. Others are shuffled.
    """
    bound = max(least, total // most)
    hot = counts.where(F.col("n") > bound)
    if hot.isEmpty():
        return rows.join(counts, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counts.where(F.col("n") <= bound), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `bound` rows (they are counted), else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df
