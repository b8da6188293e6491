"""Composed jobs: functions from DataFrames and parameters to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.operators import auction, curate, decide, metrics, neighbours, sample, score
from evalmill.operators.order import cut_lineage, with_group_index, with_index
from evalmill.sources import sinks


@dataclass(frozen=True)
class GateSpec:
    """UDF-06: what a gate's evaluation is made of. ``valid`` gives violations, ``metrics`` one wide row, ``rules`` judge it."""

    valid: Callable[[DataFrame], DataFrame]
    metrics: Callable[[DataFrame], DataFrame]
    rules: tuple


def evaluate_gate(scores: DataFrame, gate: GateSpec) -> DataFrame:
    """JOB-24: violations stop the job, otherwise the gate's checks are returned."""
    if not gate.valid(scores).isEmpty():
        raise ValueError("the gate's contract has violations")
    return decide.decide(gate.metrics(scores), [], gate.rules)


def count_by_predicate(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """UDF-04: rows that each named predicate accepts, in one scan."""
    flat = rows.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(n).alias("n_rows")) for n in predicates])).alias("x")).select("x.*")


def base_mixture(rows: DataFrame, per_generator: int, seed: int) -> DataFrame:
    """JOB-01: a hash-ranked quota of each generator and as many reals as fakes."""
    rank = sample.rank_of(seed, "mix", "sample_id")
    fakes = sample.lowest_ranked(rows.filter("label = 1"), ["generator"], per_generator, rank)
    size = fakes.agg(F.count(F.lit(1)).alias("n_fakes"))
    reals = with_index(rows.filter("label = 0"), "__at", rank).withColumn("place", (F.col("__at") + 1).cast("int")).drop("__at")
    return fakes.unionByName(reals.join(F.broadcast(size), F.col("place") <= F.col("n_fakes")).drop("n_fakes"))


def permissive_mixture(rows: DataFrame, terms: list[str], per_label: int, seed: int, license_id: str) -> DataFrame:
    """JOB-05: no forbidden term, one row for each content, a quota of each label, stamped."""
    allowed = rows.filter(~C.has_forbidden_term(F.col("text"), terms)).drop("text")
    once = curate.first_of_each(allowed, "content_sha256", ["sample_id"])
    return curate.stamp(sample.lowest_ranked(once, ["label"], per_label, sample.rank_of(seed, "permissive", "sample_id")), license_id=license_id, training_allowed=True)


def balanced_gate(rows: DataFrame, per_group: int, seed: int) -> DataFrame:
    """JOB-09: the same hash-ranked quota of every generator and source."""
    named = rows.withColumn("group_name", C.group_key(F.col("label"), F.col("generator"), F.col("real_source")))
    return sample.lowest_ranked(named, ["label", "group_name"], per_group, sample.rank_of(seed, "gate", "sample_id"))


def matched_pairs(rows: DataFrame, key: str, vector: str, epsilon: float = 0.01) -> DataFrame:
    """JOB-16: fakes and reals matched one to one by similarity, in total at most pairs x epsilon from the best; two rows for each pair."""
    taken = auction.Assignment(rows.filter("label = 1"), rows.filter("label = 0"), key, vector, epsilon=epsilon).pairs().withColumn("similarity", F.round("similarity", 6))
    named = taken.withColumn("pair_id", F.substring(F.sha2(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 12))
    sides = F.array(F.struct(F.lit(0).alias("label"), F.col("b").alias(key)), F.struct(F.lit(1).alias("label"), F.col("a").alias(key)))
    return named.select("pair_id", "similarity", F.explode(sides).alias("s")).select("pair_id", "similarity", "s.*")


def condition_matrix(scores: DataFrame) -> DataFrame:
    """JOB-19: AUC of every condition by generator, source, pair and all, and each condition's worst pair."""
    grouped = cut_lineage(metrics.grouped_auc(scores, ["condition"]))  # read twice
    low = metrics.worst(grouped, ["condition"]).select("condition", F.lit("worst_pair").alias("level"), F.lit(None).cast("string").alias("generator"), F.lit(None).cast("string").alias("real_source"), F.col("worst_pair_auc").alias("auc"))
    return grouped.unionByName(low)


def resumed_matrix(spark: SparkSession, conditions: list[str], score: Callable[[list[str]], DataFrame], folder: str, own: Column) -> DataFrame:
    """JOB-19 with SNK-04: conditions that ``folder`` holds under the same signature aren't scored again; others are, and written.

    A folder with conditions of other inputs is refused.
    """
    done = spark.read.parquet(folder) if sinks.exists(spark, folder) else score([]).withColumn("signature", own)
    left, foreign = sinks.remaining_conditions(spark, conditions, done, own)
    if not foreign.isEmpty():
        raise ValueError(f"{folder} holds conditions of another run")
    todo = [r["condition"] for r in left.collect()]  # names of the catalogue
    if todo:
        sinks.write_condition(score(todo), folder, own)
    return condition_matrix(spark.read.parquet(folder))


def blend_matrix(scores: DataFrame, a: str, b: str, weight: float) -> DataFrame:
    """JOB-20: AUC of a fixed blend of two finished matrices."""
    return metrics.auc(scores.withColumn("score", C.blend(F.col(a), F.col(b), weight)), ["condition"])


def matched_subset_scores(meta: DataFrame, scores: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """JOB-10/21: AUC over the metadata-matched subset of a finished matrix."""
    chosen = sample.matched_strata(meta, strata, sample.rank_of(seed, "strata", "sample_id")).select("sample_id")
    return metrics.auc(scores.join(chosen, "sample_id", "left_semi"), ["condition"])


def mixture_with_holdout(rows: DataFrame, per_label: int, seed: int) -> DataFrame:
    """JOB-03: one generator kept whole as a holdout, a quota of each label from the rest."""
    held = rows.agg(F.min("generator").alias("__held"))
    tagged = rows.crossJoin(F.broadcast(held)).withColumn("role", F.when(F.col("generator").eqNullSafe(F.col("__held")), "holdout").otherwise("train")).drop("__held")
    train = sample.lowest_ranked(tagged.filter("role = 'train'"), ["label"], per_label, sample.rank_of(seed, "holdout", "sample_id")).drop("place")
    return train.unionByName(tagged.filter("role = 'holdout'"))


def cross_source_gates(rows: DataFrame, per_label: int, seed: int) -> DataFrame:
    """JOB-07: for each real source a gate of its rows and of fakes, ranked by the gate's own name."""
    gates = rows.filter("label = 0").select(F.col("real_source").alias("gate")).distinct()
    names = gates.agg(F.collect_set("gate").alias("gates"))
    fakes = rows.filter("label = 1").crossJoin(F.broadcast(names)).withColumn("gate", F.explode("gates")).drop("gates")
    both = rows.filter("label = 0").withColumn("gate", F.col("real_source")).unionByName(fakes)
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("gate"), F.col("sample_id").cast("string")), 256)
    return sample.lowest_ranked(both, ["gate", "label"], per_label, rank)


def fresh_matched_gate(held: DataFrame, used: DataFrame) -> DataFrame:
    """JOB-13: one row for each unused content, the lowest content hashes, as many of either label."""
    fresh = held.join(used.select("content_sha256"), "content_sha256", "left_anti")
    one = fresh.groupBy("content_sha256", "label").agg(F.min("sample_id").alias("sample_id"))
    size = one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n_each"))
    placed = with_group_index(one, "__at", ["label"], "content_sha256").withColumn("place", (F.col("__at") + 1).cast("int")).drop("__at")
    return placed.join(F.broadcast(size), F.col("place") <= F.col("n_each"))


def equal_reals(fakes: DataFrame, reals: DataFrame, seed: int, name: str) -> DataFrame:
    """As many reals as there are fakes, dealt equally over the real sources by hash rank."""
    return sample.allocate(reals, "real_source", fakes.count(), sample.rank_of(seed, name, "sample_id")).drop("place", "quota")


def paired_control(pool: DataFrame, used: DataFrame, holdout: str, per_generator: int, seed: int) -> DataFrame:
    """JOB-02: unused contents only; a quota of each generator but the holdout, paired with equally dealt reals."""
    fresh = pool.join(used.select("content_sha256").distinct(), "content_sha256", "left_anti")
    known = fresh.filter((F.col("label") == 1) & (F.col("generator") != holdout))
    fakes = sample.lowest_ranked(known, ["generator"], per_generator, sample.rank_of(seed, "paired", "sample_id")).drop("place")
    return fakes.unionByName(equal_reals(fakes, fresh.filter("label = 0"), seed, "paired"))


def breadth_gate(fakes: DataFrame, reals: DataFrame, prior: DataFrame, identities: list[str], seed: int) -> DataFrame:
    """JOB-11: all fakes and equally dealt reals, without rows that share an identity with a prior manifest."""
    gate = fakes.unionByName(equal_reals(fakes, reals, seed, "breadth"))
    return curate.without_shared_identity(gate, prior.drop("sample_id"), "sample_id", identities)


def equal_source_gate(fakes: DataFrame, reals: DataFrame, training: DataFrame, seed: int) -> DataFrame:
    """JOB-12: fakes and equally dealt reals, each with whether training has its content and whether the gate repeats it."""
    gate = fakes.unionByName(equal_reals(fakes, reals, seed, "audit"))
    repeats = gate.groupBy("content_sha256").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    known = training.select("content_sha256").distinct().withColumn("in_training", F.lit(True))
    return gate.join(repeats, "content_sha256").join(known, "content_sha256", "left").fillna(False, ["in_training"])


def class_balanced_gate(rows: DataFrame, listed: DataFrame, kind: str, per_class: int, order: Column) -> DataFrame:
    """JOB-14: of unlisted contents, the first ``per_class`` of each class and label for the gate, the next for the repair block."""
    fresh = curate.path_or_hash_excluded(rows, listed)
    placed = sample.rank_window(fresh, ["label", kind], 0, 2 * per_class, order)
    return placed.withColumn("role", F.when(F.col("place") <= per_class, "gate").otherwise("repair"))


def label_balanced_sample(rows: DataFrame, used: DataFrame, per_label: int, seed: int, name: str) -> DataFrame:
    """JOB-15: of contents that no earlier audit used, one row each, the lowest hash ranks of either label."""
    fresh = rows.join(used.select("content_sha256").distinct(), "content_sha256", "left_anti")
    once = curate.first_of_each(fresh, "content_sha256", ["sample_id"])
    return sample.lowest_ranked(once, ["label"], per_label, sample.rank_of(seed, name, "sample_id"))


def canonical_view(rows: DataFrame, key: str, pixels: str, shape: tuple[int, int], digits: int = 6) -> DataFrame:
    """JOB-06: the canonical square of each image, its digest, and how many rows and labels share it."""
    square = score.apply_kernel(rows, key, pixels, shape, "canonical_4")
    digest = F.sha2(F.to_json(F.transform(pixels, lambda x: F.round(x, digits))), 256)
    derived = rows.select(key, "label").join(square.select(key, digest.alias("derived_sha256")), key)
    shared = derived.groupBy("derived_sha256").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_labels"))
    return derived.join(shared, "derived_sha256")


def evaluate_gates(scores: DataFrame, gates: dict[str, tuple[Column, GateSpec]]) -> DataFrame:
    """JOB-24: one evaluator for every gate: its rows, its contract, its metrics, its rules."""
    parts = [evaluate_gate(scores.filter(rows), spec).withColumn("gate", F.lit(name)) for name, (rows, spec) in gates.items()]
    return curate.union_manifests(*parts)
