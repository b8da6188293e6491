"""Errors at a threshold, threshold sweeps and ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.metrics import checked
from evalmill.operators.order import cut_lineage, with_index


def error_summary(scores: DataFrame, keys: list[str] = (), threshold: float = 0.5, score: str = "score") -> DataFrame:
    """AGG-11: false positives and negatives, their rates and the balanced accuracy."""
    real, fake = F.col("label") == 0, F.col("label") == 1
    flat = scores.groupBy(*keys).agg(F.count_if(real).alias("n_real"), F.count_if(fake).alias("n_fake"), F.count_if(real & (F.col(score) >= threshold)).alias("n_fp"), F.count_if(fake & (F.col(score) < threshold)).alias("n_fn"))
    fpr, fnr = F.try_divide(F.col("n_fp").cast("double"), F.col("n_real").cast("double")), F.try_divide(F.col("n_fn").cast("double"), F.col("n_fake").cast("double"))
    return flat.select(*keys, "n_real", "n_fake", "n_fp", "n_fn", fpr.alias("fp_rate"), fnr.alias("fn_rate"), (1 - 0.5 * (fpr + fnr)).alias("balanced_accuracy"))


def group_errors(scores: DataFrame, keys: list[str], group: Column, wrong: Column, score: str = "score") -> DataFrame:
    """AGG-12, UDF-03: rows, errors by any predicate, error rate and mean score of each group."""
    return scores.groupBy(*keys, "label", group.alias("group_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("n_errors"), (F.count_if(wrong) / F.count(F.lit(1)).cast("double")).alias("error_rate"), F.round(F.avg(score), 9).alias("mean_score"))


def threshold_sweep(scores: DataFrame, group: Column, score: str = "score", ranges: int = 256, best_only: bool = False) -> DataFrame:
    """AGG-13/14 for every candidate threshold in {0, 0.5, 1} and the scores: balanced accuracy and the lowest group recall.

    Counts by (group, score range) give each group's count below a range. Only groups with rows in a range change inside it;
    they meet the range's thresholds after one shuffle by range, and running counts give their recalls. With ``best_only`` the
    sums by range bound what a range's thresholds can reach, real groups' recalls rising and generators' falling, and only
    ranges that may hold the highest minimum recall are gone through.
    """
    cells = checked(scores, score).groupBy(group.alias("g"), "label", F.col(score).alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.floor(F.col("t") * ranges).cast("int"))
    cells = cut_lineage(cells)  # read several times
    sums = cells.groupBy("g", "label", "r").agg(F.sum("n").alias("m"))
    groups = sums.groupBy("g", "label").agg(F.sum("m").alias("total"))
    dense = groups.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(ranges)))).join(sums, ["g", "label", "r"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    before = Window.partitionBy("g", "label").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
    real, share = F.col("label") == 0, lambda c: c / F.col("total").cast("double")
    low = F.when(real, share(F.col("base"))).otherwise(share(F.col("total") - F.col("base") - F.col("m")))
    high = F.when(real, share(F.col("base") + F.col("m"))).otherwise(share(F.col("total") - F.col("base")))
    of = lambda v, c: F.sum(F.when(F.col("label") == v, F.col(c)))
    slots = dense.groupBy("r").agg(F.min(F.when(F.col("m") == 0, low)).alias("rest"), F.min(low).alias("low"), F.min(high).alias("high"), *[of(v, c).alias(f"{c}{v}") for v in (0, 1) for c in ("base", "total")])
    slots = cut_lineage(slots.coalesce(1))  # one row for each range
    fixed = scores.sparkSession.range(1).select(F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("t")).select("t", F.floor(F.col("t") * ranges).cast("int").alias("r"))
    marks = cells.select("t", "r").unionByName(fixed).distinct()
    if best_only:
        held = slots.join(sums.select("r").unionByName(fixed.select("r")).distinct(), "r")  # ranges with a candidate
        slots = held.crossJoin(F.broadcast(held.agg(F.max("low").alias("reached")))).filter("high >= reached")
        marks, cells = (df.join(F.broadcast(slots.select("r")), "r", "left_semi") for df in (marks, cells))
    known = cells.join(dense.filter("m > 0").select("g", "label", "r", "base", "total"), ["g", "label", "r"])
    member = F.struct("g", "label", "base", "total")
    both = known.select("r", "t", "n", member.alias("x")).unionByName(marks.select("r", "t", F.lit(0).cast("long").alias("n"), F.lit(None).cast("struct<g:string,label:int,base:bigint,total:bigint>").alias("x")))
    here = both.repartition("r").withColumn("xs", F.collect_set("x").over(Window.partitionBy("r"))).withColumn("mark", F.col("x").isNull())
    here = here.withColumn("x", F.explode_outer(F.when(F.col("mark"), F.col("xs")).otherwise(F.array("x")))).drop("xs")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("r", "x.g", "x.label").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.coalesce(F.sum("n").over(Window.partitionBy("r", "x.g", "x.label", "t")), F.lit(0))
    placed = here.withColumn("inside", below).filter("mark")
    right = F.when(F.col("x.label") == 0, F.col("x.base") + F.col("inside")).otherwise(F.col("x.total") - F.col("x.base") - F.col("inside"))
    within = lambda v: F.coalesce(F.sum(F.when(F.col("x.label") == v, F.col("inside"))), F.lit(0))
    by = placed.groupBy("r", F.col("t").alias("threshold")).agg(F.min(right / F.col("x.total").cast("double")).alias("there"), within(0).alias("i0"), within(1).alias("i1")).join(F.broadcast(slots), "r")
    accuracy = 0.5 * ((F.col("base0") + F.col("i0")) / F.col("total0").cast("double") + (F.col("total1") - F.col("base1") - F.col("i1")) / F.col("total1").cast("double"))
    return by.select("threshold", F.least("there", "rest").alias("min_recall"), accuracy.alias("balanced_accuracy"))


def select_threshold(swept: DataFrame) -> DataFrame:
    """AGG-14: the highest minimum recall, then balanced accuracy, then closeness to a half, then the smaller threshold."""
    return swept.orderBy(F.desc("min_recall"), F.desc("balanced_accuracy"), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def ranked_errors(scores: DataFrame, keys: list[str], limit: int, threshold: float = 0.5, score: str = "score", tie: str = "path") -> DataFrame:
    """TOP-01/02: the highest reals, lowest fakes and worst errors of both kinds, ``limit`` of each."""
    real, s = F.col("label") == 0, F.col(score)
    lists = F.array_compact(F.array(F.when(real, F.lit("top_real")), F.when(~real, F.lit("bottom_fake")), F.when(real & (s >= threshold), F.lit("false_positive")), F.when(~real & (s < threshold), F.lit("false_negative"))))
    order = Window.partitionBy(*keys, "list_name").orderBy(F.when(real, -s).otherwise(s), tie)
    rows = scores.withColumn("list_name", F.explode(lists)).withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= limit).select(*keys, "list_name", "place", tie, s.alias("score"))


def ranked_sides(rows: DataFrame, keys: list[str], value: str, limit: int, tie: str) -> DataFrame:
    """AGG-26: the ``limit`` lowest and highest rows of each key, and the mean of all of its rows beside them."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))
    side = lambda name, order: rows.withColumn("side", F.lit(name)).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).filter(F.col("place") <= limit)
    return side("bottom", F.asc(value)).unionByName(side("top", F.desc(value))).join(means, keys)


def lowest(rows: DataFrame, keys: list[str], value: str, limit: int | None, *ties: str) -> DataFrame:
    """TOP-03/04/07: the ``limit`` lowest rows of each key, ties by the given columns; None ranks all rows, without keys over ranges."""
    if limit is None and not keys:
        return with_index(rows, "__i", F.col(value).isNull(), value, *ties).withColumn("place", (F.col("__i") + 1).cast("int")).drop("__i")
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(value).asc_nulls_last(), *ties)
    placed = rows.withColumn("place", F.row_number().over(order))
    return placed if limit is None else placed.filter(F.col("place") <= limit)
