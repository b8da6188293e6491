"""Tie-exact ROC AUC and everything that is rolled up from it.

Counts stay integers until one last division. Scores are collapsed to cells (keys, score) first, so repeated scores cross the
shuffle once. Scores lie in [0, 1]; a key is split into score ranges, so that one with most of the rows isn't one task. A score
that is null, NaN or infinite, or a label other than 0 and 1, is an error: such rows have no rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.order import cut_lineage, with_index

RANGES = 256

WIDE = "decimal(38,0)"


def ratio(wins2: Column, pairs: Column) -> Column:
    """The AUC from doubled wins and pair counts; null where a label is missing."""
    return F.try_divide(wins2.cast("double"), 2 * pairs.cast("double"))


def checked(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``scores`` as they are; reading a row without a finite score or a binary label raises."""
    fine = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.abs(F.col(score)) < float("inf")) & F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    return scores.withColumn(score, F.when(fine, F.col(score)).otherwise(F.raise_error(F.lit("a score that isn't finite or a label that isn't 0 or 1"))))


def auc(scores: DataFrame, keys: list[str] = (), score: str = "score", label: str = "label", ranges: int = RANGES) -> DataFrame:
    """AGG-01..04: (keys, n_pos, n_neg, auc)."""
    keys = list(keys)
    one = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0))
    cells = checked(scores, score, label).groupBy(*keys, F.col(score).alias("__s")).agg(one(1).alias("p"), one(0).alias("n"))
    cells = cells.withColumn("__r", F.floor(F.col("__s") * ranges))
    inside = Window.partitionBy(*keys, "__r").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # wins2 = sum p (2 (base + before) + n), with the base of a range still to come
    parts = local.groupBy(*keys, "__r").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum((F.col("p") * (2 * F.col("before") + F.col("n"))).cast(WIDE)).alias("w"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0)))
    total = based.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("w") + 2 * F.col("p").cast(WIDE) * F.col("base")).alias("w"))
    return total.select(*keys, "n_pos", "n_neg", ratio(F.col("w"), F.col("n_pos").cast(WIDE) * F.col("n_neg")).alias("auc"))


def wins(scores: DataFrame, keys: list[str], fake: str = "generator", real: str = "real_source", score: str = "score", label: str = "label", ranges: int = RANGES) -> DataFrame:
    """AGG-07: (keys, fake, real, wins2, pairs): doubled wins of each generator's rows over each source's rows.

    Wins over lower score ranges come from sums by range. Wins inside a range come from its cells: they are dealt out by (keys,
    range), and fakes are repeated for the range's sources after that shuffle, not before it. No task holds a whole source.
    """
    keys, g = list(keys), "__g"
    rows = checked(scores, score, label).withColumn(g, F.floor(F.col(score) * ranges))
    named = F.when(F.col(label) == 0, F.col(real)).otherwise(F.col(fake)).alias("name")
    counts = cut_lineage(rows.groupBy(*keys, g, F.col(label).alias("__l"), named, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n")))  # read several times
    reals = counts.filter("__l = 0").select(*keys, g, F.col("name").alias("r"), "s", "n")
    fakes = counts.filter("__l = 1").select(*keys, g, F.col("name").alias("f"), "s", F.col("n").alias("p"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    cells = reals.select(*keys, g, "s", "r", "n", none.alias("f"), zero.alias("p")).unionByName(fakes.select(*keys, g, "s", none.alias("r"), zero.alias("n"), "f", "p"))
    here = cells.repartition(*keys, g).withColumn("rs", F.collect_set("r").over(Window.partitionBy(*keys, g)))
    here = here.withColumn("r", F.explode(F.when(F.col("p") > 0, F.col("rs")).otherwise(F.array("r")))).drop("rs")
    part = [*keys, g, "r"]
    placed = here.withColumn("le", F.sum("n").over(Window.partitionBy(*part).orderBy("s"))).withColumn("eq", F.sum("n").over(Window.partitionBy(*part, "s")))
    inside = placed.filter("p > 0").groupBy(*keys, "f", "r").agg(F.sum(F.col("p").cast(WIDE) * (2 * F.col("le") - F.col("eq"))).alias("wins2"))

    m, q = reals.groupBy(*keys, g, "r").agg(F.sum("n").alias("m")), fakes.groupBy(*keys, g, "f").agg(F.sum("p").alias("q"))
    sources = m.groupBy(*keys).agg(F.collect_set("r").alias("rs"))
    spread = (q.join(sources, keys) if keys else q.crossJoin(F.broadcast(sources))).select(*keys, g, F.explode("rs").alias("r"), zero.alias("m"), "f", "q")
    sums = m.select(*keys, g, "r", "m", none.alias("f"), zero.alias("q")).unionByName(spread)
    over = Window.partitionBy(*keys, "r")
    based = sums.withColumn("below", F.coalesce(F.sum("m").over(over.orderBy(g).rangeBetween(Window.unboundedPreceding, -1)), zero)).withColumn("tot", F.sum("m").over(over)).filter("q > 0")
    lower = based.groupBy(*keys, "f", "r").agg(F.sum(F.col("q").cast(WIDE) * 2 * F.col("below")).alias("wins2"), F.sum(F.col("q").cast(WIDE) * F.col("tot")).alias("pairs"))
    whole = lower.unionByName(inside.withColumn("pairs", F.lit(0).cast(WIDE))).groupBy(*keys, F.col("f").alias(fake), F.col("r").alias(real))
    return whole.agg(F.sum("wins2").alias("wins2"), F.sum("pairs").alias("pairs"))


def grouped_auc(scores: DataFrame, keys: list[str], fake: str = "generator", real: str = "real_source", score: str = "score") -> DataFrame:
    """AGG-05..07: (keys, level, generator, real_source, auc) for pairs, generators, sources and all, from one wins table."""
    keys = list(keys)
    won = wins(scores, keys, fake, real, score)
    sets = [[*keys, fake, real], [*keys, fake], [*keys, real], keys]
    rolled = won.groupingSets([[F.col(c) for c in s] for s in sets], *[*keys, fake, real]).agg(F.sum("wins2").alias("w"), F.sum("pairs").alias("n"), F.grouping(fake).alias("gf"), F.grouping(real).alias("gr"))
    level = F.when(F.col("gf") + F.col("gr") == 0, "pair").when(F.col("gf") == 0, "generator").when(F.col("gr") == 0, "source").otherwise("all")
    return rolled.select(*keys, level.alias("level"), fake, real, ratio(F.col("w"), F.col("n")).alias("auc"))


def rates(scores: DataFrame, keys: list[str], group: Column, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """AGG-05/06: rows and the rate on the right side of the threshold: >= for label 1, < for label 0."""
    right = F.when(F.col("label") == 1, F.col(score) >= threshold).otherwise(F.col(score) < threshold)
    return scores.groupBy(*keys, "label", group.alias("group_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(right).alias("n_right"))


def worst(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-08: the lowest AUC of each level."""
    pick = lambda level: F.min(F.when(F.col("level") == level, F.col("auc")))
    return grouped.groupBy(*keys).agg(pick("generator").alias("worst_generator_auc"), pick("source").alias("worst_source_auc"), pick("pair").alias("worst_pair_auc"))


def pooled(scores: DataFrame) -> DataFrame:
    """AGG-04: every condition but clean as one."""
    return scores.withColumn("view", F.when(F.col("condition") == "clean", "clean").otherwise("pooled"))


def official(scores: DataFrame, keys: list[str] = (), score: str = "score") -> DataFrame:
    """AGG-02: half the clean AUC plus half the pooled AUC of the perturbed conditions."""
    by = auc(pooled(scores), [*keys, "view"], score)
    pick = lambda view, c: F.max(F.when(F.col("view") == view, F.col(c)))
    flat = by.groupBy(*keys).agg(pick("clean", "auc").alias("clean_auc"), pick("pooled", "auc").alias("pooled_auc"), F.max(F.when(F.col("view") == "clean", F.col("n_pos") + F.col("n_neg"))).alias("n_clean"), F.max(F.when(F.col("view") == "pooled", F.col("n_pos") + F.col("n_neg"))).alias("n_pooled"))
    return flat.withColumn("official_score", 0.5 * F.col("clean_auc") + 0.5 * F.col("pooled_auc"))


def unpivot_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-09: one row for each candidate's score."""
    return scores.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("value")) for c in columns]))).select(*[c for c in scores.columns if c not in columns], F.col("__c.candidate").alias("candidate"), F.col("__c.value").alias("score"))


def paired_accuracy(pairs: DataFrame, keys: list[str] = (), score: str = "score") -> DataFrame:
    """AGG-28, JN-25: 1 where a pair's fake scores higher, a half on ties."""
    side = lambda v: F.max(F.when(F.col("label") == v, F.col(score)))
    flat = pairs.groupBy(*keys, "pair_id").agg(side(1).alias("fake"), side(0).alias("real")).filter("fake IS NOT NULL AND real IS NOT NULL")
    doubled = F.when(F.col("fake") > F.col("real"), 2).when(F.col("fake") == F.col("real"), 1).otherwise(0)
    return flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), (F.sum(doubled) / (2 * F.count(F.lit(1)))).alias("paired_accuracy"))


def class_means(scores: DataFrame, keys: list[str] = (), score: str = "score") -> DataFrame:
    """AGG-27: mean scores of both labels and whether authentic rows score higher."""
    mean = lambda v: F.avg(F.when(F.col("label") == v, F.col(score)))
    return scores.groupBy(*keys).agg(F.round(mean(0), 9).alias("real_mean"), F.round(mean(1), 9).alias("fake_mean"), (F.round(mean(0), 9) > F.round(mean(1), 9)).alias("inverted"))


def subgroup_auc(scores: DataFrame, subgroups: dict[str, Column], keys: list[str] = (), score: str = "score") -> DataFrame:
    """AGG-30: AUC of overlapping subgroups, a row counting in each that it belongs to; null where a label is missing."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in subgroups.items()]))
    return auc(scores.withColumn("subgroup", F.explode(names)), [*keys, "subgroup"], score)


def drift(a: DataFrame, b: DataFrame, key: str, score: str = "score", label: str = "label", tolerance: float = 1e-6) -> DataFrame:
    """AGG-32: how two runs of the same rows differ: changes of scores, ranks and AUC, whether equal and whether within ``tolerance``."""
    ranked = lambda df, n: with_index(df.select(key, F.col(score).alias("s")), "rank", "s", key).select(key, F.col("s").alias(f"s{n}"), F.col("rank").alias(f"r{n}"))
    both = ranked(a, 1).join(ranked(b, 2), key)
    change = F.abs(F.col("s1") - F.col("s2"))
    flat = both.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.max(change), 9).alias("max_change"), F.round(F.avg(change), 9).alias("mean_change"), F.max(F.abs(F.col("r1") - F.col("r2"))).alias("max_rank_change"), (F.max(change) == 0).alias("exact"))
    one = lambda df, n: auc(df, [], score, label).select(F.col("auc").alias(n))
    wide = flat.crossJoin(F.broadcast(one(a, "__a"))).crossJoin(F.broadcast(one(b, "__b")))
    moved = F.round(F.abs(F.col("__a") - F.col("__b")), 9)
    return wide.select(*flat.columns, moved.alias("auc_change"), ((F.col("max_change") <= tolerance) & (moved <= tolerance)).alias("within"))
