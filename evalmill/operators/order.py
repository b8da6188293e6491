"""A global row number that isn't one task: range partitions, their sizes as running sums, a row number inside each."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a session in one process (tests) gets a folder of its own; on a cluster a local folder would be lost with
    its machine, so there this raises.
    """
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get()


#: With this setting a query's shuffle files go with its end; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back from there; lost executors don't lose it.

    Nothing reads the shuffles that made it again, so they are removed. The setting holds for frames made under it, hence the select.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEAN_UP, before)


def drop_cut(*cuts: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for tables that nothing reads any more."""
    for df in cuts:
        spark, written = df.sparkSession, df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if written.isDefined():
            place = spark._jvm.org.apache.hadoop.fs.Path(written.get())
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_index(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows`` with their place (from 0) in the given order, ties by a hash of the row. The partition numbers are fixed by a checkpoint."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(columns)], F.xxhash64(*rows.columns).alias("__tie")).repartitionByRange(parts, *[f"__o{i}" for i in range(len(columns))], "__tie").withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*[f"__o{i}" for i in range(len(columns))], "__tie")
    placed = dealt.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(bases), "__part")
    return placed.select(*rows.columns, (F.col("__base") + F.col("__i") - 1).alias(name))


def with_group_index(rows: DataFrame, name: str, groups: list[str], *order: str | Column) -> DataFrame:
    """``rows`` with their place (from 0) inside their group; a group of any size is dealt over ranges, and null is a group."""
    placed = cut_lineage(with_index(rows, "__at", *groups, *order))  # read twice
    firsts = placed.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min("__at").alias("__first"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)])
    return placed.join(firsts, same).select(*rows.columns, (F.col("__at") - F.col("__first")).alias(name))
