"""Sampling by hash rank, quotas, strata and weights. A row's rank depends on its identity alone, so results don't depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.columns import hash_rank, hash_uniform
from evalmill.operators.order import cut_lineage, with_group_index, with_index


def lowest_ranked(rows: DataFrame, groups: list[str], k: int, rank: Column) -> DataFrame:
    """SMP-01/03..07: the k rows of lowest rank of each group; the filter is pushed below the shuffle as a group limit."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy(rank))).filter(F.col("place") <= k)


def shortages(rows: DataFrame, groups: list[str], k: int) -> DataFrame:
    """SMP-01's error case: groups with fewer than k rows."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < k)


def global_top(rows: DataFrame, k: int, rank: Column) -> DataFrame:
    """SMP-02: the k lowest ranks of all rows, as a bounded top-k of each task."""
    return rows.withColumn("rank", rank).orderBy("rank").limit(k)


def rank_window(rows: DataFrame, groups: list[str], start: int, k: int, rank: Column) -> DataFrame:
    """SMP-03/13: ranks [start, start + k) of each group."""
    place = F.row_number().over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy(rank))
    return rows.withColumn("place", place).filter(F.col("place").between(start + 1, start + k))


def allocate(rows: DataFrame, group: str, total: int, rank: Column) -> DataFrame:
    """SMP-08: ``total`` rows dealt equally over the sorted groups, the remainder to the first ones."""
    names = rows.select(group).distinct().withColumn("number", F.row_number().over(Window.orderBy(group)) - 1)
    sized = names.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    quota = F.floor(F.lit(total) / F.col("groups")) + F.when(F.col("number") < F.lit(total) % F.col("groups"), 1).otherwise(0)
    return lowest_ranked(rows, [group], total, rank).join(sized.select(group, quota.alias("quota")), group).filter(F.col("place") <= F.col("quota"))


def matched_strata(rows: DataFrame, strata: list[str], rank: Column) -> DataFrame:
    """SMP-09: of each stratum as many rows of either label as the rarer one has."""
    sizes = rows.groupBy(*strata).agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("quota")).filter("quota > 0")
    placed = with_group_index(rows, "__at", [*strata, "label"], rank).withColumn("place", (F.col("__at") + 1).cast("int")).drop("__at")
    return placed.join(sizes, strata).filter("place <= quota")


def spread_windows(rows: DataFrame, order: list[str], count: int, blocks: int, seed: int) -> DataFrame:
    """SMP-10: ``count`` rows in contiguous runs, one in each of ``blocks`` equal stretches of the ordered table."""
    placed = with_index(rows, "at", *order).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    block = placed.withColumn("block", F.floor(F.col("at") * blocks / F.col("n")))
    spans = block.groupBy("block").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("size"))
    size = F.lit(count // blocks)
    start = F.col("low") + F.floor(hash_uniform(seed, "window", F.col("block")) * F.greatest(F.lit(1), F.col("size") - size + 1))
    return block.join(spans.select("block", start.alias("start")), "block").filter(F.col("at").between(F.col("start"), F.col("start") + size - 1)).drop("n", "start")


def first_valid(rows: DataFrame, groups: list[str], order: list[str], valid: Column, k: int) -> DataFrame:
    """SMP-11: the first k valid rows of each group in order and, as rejected, the invalid ones before the k-th.

    Rows are dealt by ranges of (groups, order). Counts of valid rows by group and range tell which ranges come before the k-th; only
    those rows are put in order, each range by itself, so no task sorts a whole group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__g{i}" for i in range(len(groups))]
    dealt = cut_lineage(rows.withColumn("valid", valid).repartitionByRange(parts, *groups, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("__part").alias("__at")).agg(F.sum(F.col("valid").cast("int")).alias("n"))
    earlier = Window.partitionBy(*names).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(F.col("__before") < k).drop("n")
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)], F.col("__part") == F.col("__at"))
    upto = Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.join(needed, same).withColumn("n_valid", F.col("__before") + F.coalesce(F.sum(F.col("valid").cast("int")).over(upto), F.lit(0)))
    found = counted.filter((F.col("valid") & (F.col("n_valid") <= k)) | (~F.col("valid") & (F.col("n_valid") < k))).withColumn("kept", F.col("valid"))
    return found.drop("__part", "__at", "__before", *names)


def first_per_group(rows: DataFrame, group: str, order: str, k: int, skip: Column) -> DataFrame:
    """SMP-12, SRC-07: rows in scan order with the reason for which one is skipped, or null; the cap counts accepted rows."""
    marked = rows.withColumn("reason", skip)
    place = F.row_number().over(Window.partitionBy(group, F.col("reason").isNull()).orderBy(order))
    return marked.withColumn("place", place).withColumn("reason", F.coalesce("reason", F.when(F.col("place") > k, F.lit("cap"))))


def balanced_weights(rows: DataFrame, group: Column) -> DataFrame:
    """SMP-15: weight 1 / (groups of the label * rows of the group); each label's mass is 1."""
    named = rows.withColumn("group_name", group)
    sizes = named.groupBy("label", "group_name").agg(F.count(F.lit(1)).alias("n_in_group"))
    counted = sizes.withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("label")))
    return named.join(counted, ["label", "group_name"]).withColumn("weight", 1 / (F.col("n_groups") * F.col("n_in_group")).cast("double"))


def block_weights(rows: DataFrame, block: Column, group: Column, mass: dict[str, float]) -> DataFrame:
    """SMP-16..18, AGG-36: a block's mass spread equally over its (label, group)s, then over their rows; half to either label."""
    named = rows.withColumn("block", block).withColumn("group_name", group)
    sizes = named.groupBy("block", "label", "group_name").agg(F.count(F.lit(1)).alias("n_in_group"))
    counted = sizes.withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("block", "label")))
    share = F.create_map(*[F.lit(x) for pair in mass.items() for x in pair])
    return named.join(counted, ["block", "label", "group_name"]).withColumn("weight", 0.5 * share[F.col("block")] / (F.col("n_groups") * F.col("n_in_group")).cast("double"))


def with_replacement(rows: DataFrame, weight: str, draws: int, seed: int, *identity: str) -> DataFrame:
    """SMP-19: how often each row is drawn: a Poisson number with mean draws * weight, by inverting its distribution at a hashed uniform.

    Rows are independent of each other, so there is no cumulative weight to order by; the sum is ``draws`` in expectation.
    """
    total = rows.agg(F.sum(weight).alias("__total"))
    mean = F.col(weight) / F.col("__total") * draws
    u = hash_uniform(seed, "draw", *[F.col(c) for c in identity])
    start = lambda m: F.struct(F.lit(0).alias("k"), F.exp(-m).alias("p"), F.exp(-m).alias("c"))
    grow = lambda a, i: F.when(a["c"] > F.col("__u"), a).otherwise(F.struct((a["k"] + 1).alias("k"), (a["p"] * F.col("__m") / (a["k"] + 1)).alias("p"), (a["c"] + a["p"] * F.col("__m") / (a["k"] + 1)).alias("c")))
    ready = rows.crossJoin(F.broadcast(total)).withColumn("__m", mean).withColumn("__u", u)
    upto = F.sequence(F.lit(1), (F.col("__m") + 12 * F.sqrt("__m") + 20).cast("int"))
    return ready.withColumn("times", F.aggregate(upto, start(F.col("__m")), grow)["k"]).drop("__total", "__m", "__u")


def exact_draws(rows: DataFrame, weight: str, draws: int, seed: int, *identity: str, unit: float = 1e-12) -> DataFrame:
    """SMP-19: how often each row is drawn in exactly ``draws`` draws with replacement, each by weight.

    Weights become whole numbers of ``unit``. Rows lie one after the other on a line, in the order of ``identity``, cut into ranges with known
    sums; a draw is a hashed place on the line. Draws find their range by an equi-join on a grid of cells, and inside a range rows and
    draws are put in one order, in which a draw belongs to the row before it. Null and negative weights count as none.
    """
    spark, wide = rows.sparkSession, "decimal(38,0)"
    units = F.greatest(F.lit(0), F.coalesce(F.round(F.col(weight) / unit), F.lit(0.0))).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__u", units).repartitionByRange(parts, *identity, F.xxhash64(*rows.columns)).withColumn("__part", F.spark_partition_id())
    dealt = cut_lineage(dealt.withColumn("__row", F.monotonically_increasing_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = dealt.groupBy("__part").agg(F.sum(F.col("__u").cast(wide)).alias("sum"))
    bases = cut_lineage(sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)).cast(wide)).filter("sum > 0"))
    total = bases.agg(F.sum("sum")).first()[0]
    if total is None:
        return dealt.select(*rows.columns, F.lit(0).cast("long").alias("times"))
    total, grid = int(total), 4 * parts
    whole = lambda c, by: ((c - F.pmod(c, F.lit(by).cast(wide))) / F.lit(by).cast(wide)).cast(wide)
    cell = lambda c: whole(c.cast(wide), -(-total // grid)).cast("int")
    cells = bases.withColumn("cell", F.explode(F.sequence(cell(F.col("base")), cell(F.col("base") + F.col("sum") - 1))))
    number = F.conv(F.substring(hash_rank(seed, "draw", F.col("id")), 1, 12), 16, 10).cast("decimal(15,0)")
    thrown = spark.range(draws).select(whole((number * F.lit(total).cast("decimal(22,0)")).cast(wide), 1 << 48).alias("at"))
    found = thrown.withColumn("cell", cell(F.col("at"))).join(F.broadcast(cells), "cell").filter("at >= base AND at < base + sum")
    inside = Window.partitionBy("__part").orderBy(*identity, "__row").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.filter("__u > 0").withColumn("start", F.coalesce(F.sum(F.col("__u").cast(wide)).over(inside), F.lit(0)).cast(wide))
    line = starts.select("__part", F.col("start").alias("place"), F.lit(0).alias("kind"), F.col("__row").alias("own"))
    line = line.unionByName(found.select("__part", (F.col("at") - F.col("base")).cast(wide).alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("own")))
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("__part").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0))
    times = line.withColumn("__row", last).filter("kind = 1").groupBy("__row").agg(F.count(F.lit(1)).alias("times"))
    return dealt.join(times, "__row", "left").select(*rows.columns, F.coalesce("times", F.lit(0)).alias("times"))


def random_condition(rows: DataFrame, names: list[str], weights: list[float], probability: float, seed: int, *identity: str) -> DataFrame:
    """SMP-20: clean with 1 - probability, otherwise one condition by cumulative weight, at hashed uniforms."""
    total = sum(weights)
    bounds, running = [], 0.0
    for name, weight in zip(names, weights):
        running += weight / total
        bounds.append((running, name))
    apply, pick = (hash_uniform(seed, n, *[F.col(c) for c in identity]) for n in ("apply", "pick"))
    chosen = F.coalesce(*[F.when(pick < bound, F.lit(name)) for bound, name in bounds[:-1]], F.lit(bounds[-1][1]))
    return rows.withColumn("train_condition", F.when(apply < probability, chosen).otherwise("clean"))


def rank_of(seed: int, namespace: str, *identity: str) -> Column:
    return hash_rank(seed, namespace, *[F.col(c) for c in identity])
