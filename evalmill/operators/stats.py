"""Summaries, variance shares and replicate statistics. Replicates are dealt to tasks; only beyond ``PACKED`` rows they go in waves, each a distributed aggregation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.batches import map_frames
from evalmill.operators.contracts import ContractError
from evalmill.operators.order import cut_lineage, drop_cut, with_index


def cell_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear quantiles of each key: (__k0, ..., a column for each point); null is a key.

    Equal values are one cell with a count before anything is ordered, so a frequent value weighs nothing. Cells are dealt by ranges of (key,
    value); sums by key and range give where a range begins in its key, and only inside a range cells are put in order.
    """
    names, v = [f"__k{i}" for i in range(len(keys))], F.col(value)
    cells = rows.filter(v.isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], v.cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(cells.repartitionByRange(parts, *names, "__v").withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*names, "__part").agg(F.sum("__n").alias("__s"))
    whole = Window.partitionBy(*names)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(n).alias(f"__b{i}") for i, n in enumerate(names)], F.col("__part").alias("__at"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__base"), F.sum("__s").over(whole).alias("__total"))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"__b{i}")) for i, n in enumerate(names)], F.col("__part") == F.col("__at"))
    inside = Window.partitionBy(*names, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(bases, same).withColumn("__upto", F.col("__base") + F.sum("__n").over(inside))
    holds = lambda x: (F.col("__upto") - F.col("__n") <= x) & (x < F.col("__upto"))
    place = {n: (F.col("__total") - 1) * F.lit(p) for n, p in points.items()}
    low = {n: F.max(F.when(holds(F.floor(x)), F.col("__v"))) for n, x in place.items()}
    high = {n: F.max(F.when(holds(F.ceil(x)), F.col("__v"))) for n, x in place.items()}
    part = {n: F.max(x - F.floor(x)) for n, x in place.items()}
    met = placed.filter(reduce(Column.__or__, [holds(F.floor(x)) | holds(F.ceil(x)) for x in place.values()]))
    return met.groupBy(*names).agg(*[(low[n] + (high[n] - low[n]) * part[n]).alias(n) for n in points])


def _same_keys(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])


def distribution(rows: DataFrame, keys: list[str], value: str, digits: int = 9) -> DataFrame:
    """AGG-19: count, mean, population deviation, extremes and exact linear quantiles, share of values from a half on."""
    if not keys:
        return distribution(rows.withColumn("__all", F.lit(0)), ["__all"], value, digits).drop("__all")
    v = F.col(value)
    flat = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_pop(v), digits).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.try_divide(F.count_if(v >= 0.5).cast("double"), F.count(value).cast("double")).alias("share_from_half"))
    points = {"q05": 0.05, "median": 0.5, "q95": 0.95}
    quantiles = cell_quantiles(rows, keys, value, points)
    return flat.join(quantiles, _same_keys(keys), "left").select(*keys, "n", "mean", "std", "min", *[F.round(n, digits).alias(n) for n in points], "max", "share_from_half")


def container_summary(rows: DataFrame, levels: dict[str, Column], numbers: list[str]) -> DataFrame:
    """AGG-15: count and min, median, max of each number, per label and per source."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.cast("string").alias("level_key")) for n, c in levels.items()]))
    named = rows.select(each.alias("__l"), *numbers).filter("__l.level_key IS NOT NULL").select("__l.level", "__l.level_key", *numbers)
    keys = ["level", "level_key"]
    made = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[a for n in numbers for a in (F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}"))])
    for n in numbers:
        made = made.join(cell_quantiles(named, keys, n, {f"median_{n}": 0.5}), _same_keys(keys), "left").drop("__k0", "__k1")
    return made.select(*keys, "n_rows", *[f"{f}_{n}" for n in numbers for f in ("min", "median", "max")])


def top_values(rows: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """AGG-15: the most frequent values of each key, ties by value."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("n_rows"), value)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def inventory_digest(rows: DataFrame, line: Column, keys: list[str] = (), prefix: int = 4) -> DataFrame:
    """AGG-20: (keys, n_lines, digest), any size: a tree of digests, its leaves the lines by the first digits of their own hash.

    With each level ``prefix`` more digits split a leaf's lines, so a leaf holds one line in 16 ** prefix or so.
    """
    keys = list(keys)
    digest = lambda parts: F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256).alias("digest")
    level = rows.select(*keys, line.alias("line")).withColumn("part", F.substring(F.sha2("line", 256), 1, prefix)).groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), digest("line"))
    for width in range(prefix - 2, -1, -2):
        level = level.withColumn("up", F.substring("part", 1, width)).groupBy(*keys, "up").agg(F.sum("n").alias("n"), digest(F.concat("part", "digest"))).withColumnRenamed("up", "part")
    return level.select(*keys, F.col("n").alias("n_lines"), "digest")


def inventory_digest_ranged(rows: DataFrame, line: Column, prefix: int = 2) -> DataFrame:
    """AGG-20 with one level of ``prefix`` digits."""
    return inventory_digest(rows, line, [], prefix)


def balanced_effects(cells: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """AGG-21: shares of the sum of squares of a complete two-way table: both factors, the rest."""
    v = F.col(value)
    means = cells.select(a, b, v.alias("v"), F.avg(v).over(Window.partitionBy(a)).alias("ma"), F.avg(v).over(Window.partitionBy(b)).alias("mb")).crossJoin(F.broadcast(cells.agg(F.avg(v).alias("m"))))
    sq = lambda c: F.sum(c * c)
    sums = means.agg(sq(F.col("v") - F.col("m")).alias("t"), sq(F.col("ma") - F.col("m")).alias("sa"), sq(F.col("mb") - F.col("m")).alias("sb"))
    share = lambda c: F.round(F.coalesce(F.try_divide(c, F.col("t")), F.lit(0.0)), 9)
    return sums.select(share(F.col("sa")).alias(f"{a}_share"), share(F.col("sb")).alias(f"{b}_share"), share(F.greatest(F.lit(0.0), F.col("t") - F.col("sa") - F.col("sb"))).alias("rest_share"))


def balance_report(cells: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-21: whether a two-way table holds each cell once: names of either side, cells, missing and repeated ones. Rows without a name are counted apart."""
    named = F.col(a).isNotNull() & F.col(b).isNotNull()
    counts = cells.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(
        F.count_distinct(F.when(named, F.col(a))).alias("n_a"), F.count_distinct(F.when(named, F.col(b))).alias("n_b"), F.count_if(named).alias("n_cells"),
        F.count_if(named & (F.col("n") > 1)).alias("n_repeated"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("n_unnamed"),
    )
    missing = F.col("n_a") * F.col("n_b") - F.col("n_cells")
    return one.withColumn("n_missing", missing).withColumn("balanced", (F.col("n_missing") == 0) & (F.col("n_repeated") == 0) & (F.col("n_unnamed") == 0) & (F.col("n_cells") > 0))


def demand_balance(cells: DataFrame, a: str, b: str, limit: int = 5) -> None:
    """AGG-21: raises where a two-way table isn't balanced, with a few of the broken cells by name."""
    report = balance_report(cells, a, b).first()
    if not report["balanced"]:
        shown = "; ".join(f"{a}={r[a]}, {b}={r[b]}: {r['n_rows']} rows" for r in grid_gaps(cells, a, b).orderBy(a, b).limit(limit).collect())
        raise ContractError(f"not every cell is there once ({report['n_missing']} missing, {report['n_repeated']} repeated, {report['n_unnamed']} rows without a name): {shown}")


def grid_gaps(cells: DataFrame, a: str, b: str) -> DataFrame:
    """JN-20: cells of the full table a x b that don't hold exactly one row; rows without a name are in no cell.

    Missing cells are the names of the side with fewer names, as one array, less those that a name of the other side has; names with
    a full row make none. So only the array is broadcast, and it is no longer than the square root of the full table.
    """
    counts = cells.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n_rows"))
    n_a, n_b = counts.agg(F.count_distinct(a), F.count_distinct(b)).first()
    few, many = (a, b) if n_a <= n_b else (b, a)
    every = counts.agg(F.collect_set(few).alias("__every"))
    held = counts.groupBy(many).agg(F.collect_set(few).alias("__held")).filter(F.size("__held") < min(n_a, n_b))
    missing = held.crossJoin(F.broadcast(every)).select(many, F.explode(F.array_except("__every", "__held")).alias(few), F.lit(0).cast("long").alias("n_rows"))
    return counts.filter("n_rows > 1").select(a, b, "n_rows").unionByName(missing)


def between_share(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """AGG-22: between-group sum of squares over the total, from count, sum and sum of squares of each group."""
    v = F.col(value)
    return share_of(rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")), keys)


def share_of(groups: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-22 from the sums (keys, n, s, q) of groups."""
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    return groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.round(F.coalesce(F.try_divide(between, total), F.lit(0.0)), 9).alias("share"))


#: Rows up to which a task holds the table for its replicates, replicates of such a task, keys hashed at a time; rows times replicates that are shuffled at a time beyond that.
PACKED, BATCH, HASHED, WAVE = 2_000_000, 250, 65_536, 20_000_000


def hash_order(keys: list[bytes], head: bytes) -> np.ndarray:
    """The order of the SHA-256 of head + key, equal ones by place. Eight bytes of each are held; the others are made again where those are equal."""
    start, lead = hashlib.sha256(head), np.empty(len(keys), np.uint64)
    for at in range(0, len(keys), HASHED):
        digests = []
        for k in keys[at : at + HASHED]:
            own = start.copy()
            own.update(k)
            digests.append(own.digest())
        lead[at : at + HASHED] = np.frombuffer(b"".join(digests), dtype=">u8")[::4]
    order = np.argsort(lead)
    ranked = lead[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    if same.any():
        tied = np.flatnonzero(same | np.append(same[1:], False))
        order[tied] = sorted(order[tied].tolist(), key=lambda i: (lead[i], hashlib.sha256(head + keys[i]).digest(), i))
    return order


def permuted_sums(rows: DataFrame, key: str, group: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, n, s, q): sums of each group and replicate, for at most ``PACKED`` rows.

    A task deals values to labels for ``BATCH`` replicates; rows are sent once for each such batch, and what leaves a task are sums.
    """
    kind = dict(rows.dtypes)[group]
    placed = cut_lineage(with_index(rows.select(key, group, value), "at", key))
    sent = placed.select("at", F.concat(F.lit(":"), F.col(key).cast("string")).alias("key"), F.col(group).alias("group"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    parts = max(1, -(-replicates // BATCH))
    batches = sent.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, "batch").sortWithinPartitions("at")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, groups, values, first = [], [], [], 0
        for frame in frames:
            if len(frame):
                keys += [b"" if k is None else k.encode() for k in frame["key"]]
                groups.append(frame["group"])
                values.append(frame["v"].to_numpy())
                first = int(frame["batch"].iloc[0]) * BATCH
        if not keys:
            return
        v = np.concatenate(values)
        codes, names = pd.factorize(pd.concat(groups, ignore_index=True), use_na_sentinel=False)
        count = np.bincount(codes, minlength=len(names))
        del groups, values
        for replicate in range(first, min(first + BATCH, replicates)):
            dealt = v[hash_order(keys, f"{seed}:{replicate}".encode())]
            yield pd.DataFrame({"replicate": replicate, "group": names, "n": count, "s": np.bincount(codes, dealt, len(names)), "q": np.bincount(codes, dealt * dealt, len(names))})

    return map_frames(batches, deal, f"replicate int, group {kind}, n long, s double, q double")


def shuffled_shares(rows: DataFrame, key: str, group: str, value: str, replicates: int, seed: int, n: int) -> DataFrame:
    """(replicate, share) for any number ``n`` of rows: both places come from windows over (replicate), and rows times replicates are shuffled.

    That goes in waves of as many replicates as make ``WAVE`` rows, one at least; a wave's files go with its end, so disk doesn't grow with the replicates.
    """
    base = cut_lineage(rows.select(key, group, value))
    labels = cut_lineage(with_index(base, "at", key).select("at", group))
    wave, shares = max(1, WAVE // n), []
    order = F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")), 256))
    for first in range(0, replicates, wave):
        many = base.select(key, value).withColumn("replicate", F.explode(F.sequence(F.lit(first), F.lit(min(first + wave, replicates) - 1))))
        shuffled = many.withColumn("at", F.row_number().over(Window.partitionBy("replicate").orderBy(order)) - 1)
        done = cut_lineage(between_share(shuffled.join(labels, "at"), ["replicate"], group, value).select("replicate", "share"))
        shares += [(r["replicate"], r["share"]) for r in done.collect()]
        drop_cut(done)
    drop_cut(base, labels)
    return rows.sparkSession.createDataFrame(shares, "replicate int, share double")


def permutation_test(rows: DataFrame, key: str, group: str, value: str, replicates: int, seed: int) -> DataFrame:
    """AGG-24: how often relabelled groups reach the observed share: (exceeding + 1) / (replicates + 1).

    In a replicate, values are dealt to the group labels by hash order. The position of a label is its row's place by key. Up to ``PACKED`` rows, tasks
    hold the table and no row is shuffled for each replicate; beyond that rows times replicates are shuffled, in waves of bounded size.
    """
    base = rows.select(key, group, value)
    n = base.count()
    shares = share_of(permuted_sums(base, key, group, value, replicates, seed), ["replicate"]) if n <= PACKED else shuffled_shares(base, key, group, value, replicates, seed, n)
    observed = between_share(base, [], group, value).select(F.col("share").alias("observed"))
    return shares.crossJoin(F.broadcast(observed)).agg(F.max("observed").alias("observed"), F.count_if(F.col("share") >= F.col("observed")).alias("n_exceed"), ((F.count_if(F.col("share") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1).cast("double")).alias("p_value"))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """AGG-23: normalised mean vector of each group."""
    means = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.withColumn("norm", F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))).select(group, "i", F.round(F.coalesce(F.try_divide(F.col("m"), F.col("norm")), F.lit(0.0)), 6).alias("value"))
