"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.operators.batches import map_frames  # noqa: F401
from evalmill.operators.order import cut_lineage, shared_folder  # noqa: F401

#: Rows of (8-byte id) that may be broadcast after a count; about 32 MB in an executor.
BROADCAST_ROWS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int | None = None) -> DataFrame:
    """Join a materialised ``right``: broadcast while it has at most ``limit`` narrow rows, otherwise a shuffled hash join.

    ``right`` must be cheap to read twice (a checkpoint). The shuffled form sends all columns of ``left`` but sorts nothing, so wide rows don't spill.
    """
    small = right.count() <= (BROADCAST_ROWS if limit is None else limit)
    return left.join(F.broadcast(right) if small else right.hint("shuffle_hash"), on, how)


def hot_keys(counts: DataFrame, key: str, rows: str, least: int = 1000, most: int = 1000) -> list:
    """The ``most`` keys with the most rows, as far as they have ``least`` rows; any other holds less than one in ``most`` of all."""
    return [r[0] for r in counts.filter(F.col(rows) >= least).orderBy(F.desc(rows), key).select(key).limit(most).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: list, how: str = "inner", parts: int = 64) -> DataFrame:
    """Join on ``key``, which ``right`` holds once: left rows of hot keys are dealt out by the hash of ``by`` over ``parts`` groups.

    The hot keys are few by their definition (``hot_keys``); right rows of such keys are sent to all groups.
    """
    if not hot:
        return left.join(right, key, how)
    dealt = left.withColumn("__part", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(0).cast("int"))
    copies = right.withColumn("__part", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "__part"], how).drop("__part")


def drop_losers(docs: DataFrame, digest: Column, verdict: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``verdict`` (a checkpoint of doc_id, digest, kept for every row) doesn't keep.

    What goes is named by (doc_id, digest). Rows that agree in both are one document; where one of them is kept and others
    aren't, a last aggregation picks one. It is run on those rows only.
    """
    columns = docs.columns
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    stays = verdict.filter("kept").select("doc_id", "digest")
    goes = cut_lineage(verdict.filter("NOT kept").select("doc_id", "digest").distinct())
    repeated = cut_lineage(goes.join(stays, same(goes, stays), "left_semi"))
    lost = cut_lineage(goes.join(repeated, same(goes, repeated), "left_anti").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__lost")))
    tagged = docs.withColumn("__digest", digest)
    left = sized_join(tagged, lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__lost")), "left_anti", limit=BROADCAST_ROWS // 4)
    if not repeated.isEmpty():
        twice = repeated.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__twice"))
        met = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__twice"))
        others, one = (sized_join(left, twice, met, how, limit=BROADCAST_ROWS // 4) for how in ("left_anti", "left_semi"))
        left = others.unionByName(one.dropDuplicates(["doc_id", "__digest"]))
    return left.select(*columns)
