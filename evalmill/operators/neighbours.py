"""Near pairs of 64-bit hashes by exact banding, and greedy one-to-one matching."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.columns import hamming
from evalmill.operators.cosine import cosine_top
from evalmill.operators.order import cut_lineage, with_index


#: Pairs that a cell of a greedy pass finds, at most, unless one left row sees more.
SEEN = 262_144


def band_plan(bits: int, radius: int, rows: int) -> tuple[int, int]:
    """(bands, flips): with m bands two hashes within the radius differ in at most radius // m bits of one band.

    Few wide bands need many flipped values on one side, many narrow ones meet many rows; the plan with the least of both is taken.
    """

    def work(m: int) -> float:
        width = -(-bits // m)
        return m * sum(comb(width, k) for k in range(radius // m + 1)) * (1 + rows / 2.0**width)

    return (lambda m: (m, radius // m))(min(range(1, radius + 2), key=work))


#: Hashes of a side in one cell, comparisons of a cell that are held at a time, and what a joined row costs in comparisons.
SIDE, HELD, JOINED = 32_768, 4_000_000, 64

#: Values that flipped bits can make of a hash's bands, at most: they are literals of the plan.
CHANGES = 512


def banding_pays(bits: int, radius: int, rows: int) -> bool:
    """Whether the bands of ``band_plan`` meet so few rows that comparing a hash with all ``rows`` costs more."""
    bands, flips = band_plan(bits, radius, rows)
    width = -(-bits // bands)
    changes = bands * sum(comb(width, k) for k in range(flips + 1))
    return changes <= CHANGES and changes * (1 + rows / 2.0**width) * JOINED < rows


def compared(a: DataFrame, b: DataFrame, radius: int, n_a: int, n_b: int, nearest: bool = False) -> DataFrame:
    """(hash_a, hash_b, distance) within the radius of distinct hashes (hash_a) and (hash_b), every one with every one.

    The grid has cells of ``SIDE`` hashes a side, so the product is dealt to many tasks and a task's memory doesn't grow with the
    tables. ``nearest``: b has a column ``b``, and of a cell's pairs only the nearest one of each hash_a is kept, ties by b, as (hash_a, b, distance).
    """
    n_slices, n_blocks = max(1, -(-n_a // SIDE)), max(1, -(-n_b // SIDE))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lefts = a.select("hash_a").withColumn("slice", own("hash_a", n_slices)).withColumn("block", every(n_blocks))
    rights = b.withColumn("block", own("hash_b", n_blocks)).withColumn("slice", every(n_slices))
    name = "b" if nearest else "hash_b"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if nearest:
            right = right.sort_by("b")
        x, y = (t.column(c).to_numpy() for t, c in ((left, "hash_a"), (right, "hash_b")))
        rows, columns, found = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, np.int32)]
        step = max(1, HELD // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            far = np.bitwise_count((x[at : at + step, None] ^ y[None, :]).view(np.uint64))
            if nearest:
                j = far.argmin(axis=1)
                i = np.flatnonzero(far[np.arange(len(j)), j] <= radius)
                j = j[i]
            else:
                i, j = np.nonzero(far <= radius)
            rows.append(i + at)
            columns.append(j)
            found.append(far[i, j].astype(np.int32))
        i, j = np.concatenate(rows), np.concatenate(columns)
        return pa.table({"hash_a": pa.array(x[i], pa.int64()), name: right.column(name).combine_chunks().take(pa.array(j)), "distance": pa.array(np.concatenate(found), pa.int32())})

    kind = dict(b.dtypes)[name]
    return lefts.groupBy("slice", "block").cogroup(rights.groupBy("slice", "block")).applyInArrow(meet, f"hash_a long, `{name}` {kind}, distance int")


def hash_pairs(left: DataFrame, right: DataFrame, hash_: str, radius: int, bits: int = 64) -> DataFrame:
    """(hash_a, hash_b, distance) of the different hashes of either side that lie within the radius: exact, by equi-joins on bands.

    Where bands would meet too many rows, all hashes are compared with all (``compared``). The left side goes with every value of a band that few flipped bits can make. A pair is taken from the first band in which it
    agrees that far, which needs no distinct.
    """
    a, b = (df.select(F.col(hash_).alias(f"hash_{side}")).filter(F.col(f"hash_{side}").isNotNull()).distinct() for df, side in ((left, "a"), (right, "b")))
    n_b = b.count()
    if not banding_pays(bits, radius, n_b):
        return compared(a, b, radius, a.count(), n_b)
    n, flips = band_plan(bits, radius, n_b)
    edges = [round(i * bits / n) for i in range(n + 1)]
    mask = lambda width: -1 if width == 64 else (1 << width) - 1
    part = lambda c, i: F.shiftrightunsigned(c, edges[i]).bitwiseAND(F.lit(mask(edges[i + 1] - edges[i])).cast("long"))
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    changed = lambda width: [signed(sum(1 << k for k in ks)) for f in range(flips + 1) for ks in combinations(range(width), f)]

    def banded(df: DataFrame, side: str, probe: bool) -> DataFrame:
        own = lambda i: F.transform(F.array(*[F.lit(m).cast("long") for m in (changed(edges[i + 1] - edges[i]) if probe else [0])]), lambda m: F.struct(F.lit(i).alias("band"), part(F.col(f"hash_{side}"), i).bitwiseXOR(m).alias("value")))
        return df.select(f"hash_{side}", F.explode(F.concat(*[own(i) for i in range(n)])).alias("x")).select(f"hash_{side}", "x.band", "x.value")

    met = banded(a, "a", True).join(banded(b, "b", False), ["band", "value"]).withColumn("distance", hamming(F.col("hash_a"), F.col("hash_b"))).filter(F.col("distance") <= radius)
    agree = F.array(*[hamming(part(F.col("hash_a"), i), part(F.col("hash_b"), i)) <= flips for i in range(n)])
    return met.filter(F.array_position(agree, True) == F.col("band") + 1).select("hash_a", "hash_b", "distance")


def hamming_pairs(left: DataFrame, right: DataFrame, key: str, hash_: str, radius: int, bits: int = 64) -> DataFrame:
    """JN-12: pairs (a, b, distance) of rows within the radius. Equal hashes are one node until the last joins name their rows."""
    of = lambda df, side: df.select(F.col(key).alias(side), F.col(hash_).alias(f"hash_{side}"))
    return hash_pairs(left, right, hash_, radius, bits).join(of(left, "a"), "hash_a").join(of(right, "b"), "hash_b").select("a", "b", "distance")


def overlap_audit(left: DataFrame, right: DataFrame, key: str, label: str, difference: str, average: str, radius: int = 4, average_radius: int = 4, examples: int = 100, bits: int = 63) -> DataFrame:
    """JN-12: (n_pairs, n_cross_label, examples) of pairs within both radii; copies are counted by their numbers, not expanded.

    Rows with equal hashes and label are one node. Examples name the nearest nodes' first rows, ties by key.
    """

    def nodes(df: DataFrame, side: str) -> DataFrame:
        names = {difference: "d", average: "v", label: "label"}
        return df.groupBy(*[F.col(c).alias(f"{n}_{side}") for c, n in names.items()]).agg(F.count(F.lit(1)).alias(f"n_{side}"), F.min(key).alias(f"first_{side}"))

    near = hash_pairs(left, right, difference, radius, bits).withColumnsRenamed({"hash_a": "d_a", "hash_b": "d_b"})
    both = near.join(nodes(left, "a"), "d_a").join(nodes(right, "b"), "d_b").withColumn("average_distance", hamming(F.col("v_a"), F.col("v_b"))).filter(F.col("average_distance") <= average_radius)
    pairs = both.withColumn("n", F.col("n_a") * F.col("n_b")).withColumn("crosses", F.col("label_a") != F.col("label_b"))
    counts = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("crosses"), F.col("n"))), F.lit(0)).alias("n_cross_label"))
    shown = pairs.select("distance", "average_distance", "first_a", "first_b").orderBy("distance", "average_distance", "first_a", "first_b").limit(examples)
    listed = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "average_distance", "first_a", "first_b"))), lambda x: F.concat_ws(":", x["first_a"], x["first_b"], x["distance"], x["average_distance"])), ",").alias("examples"))
    return counts.crossJoin(F.broadcast(listed))


def nearest_hash(left: DataFrame, right: DataFrame, key: str, hash_: str, radius: int, bits: int = 64) -> DataFrame:
    """JN-14: for each left row the nearest right one within the radius, ties by its key; found by hash, then named for each row."""
    first = right.groupBy(F.col(hash_).alias("hash_b")).agg(F.min(key).alias("b"))
    first, n_b = first.filter(F.col("hash_b").isNotNull()), first.count()
    if banding_pays(bits, radius, n_b):
        met = hash_pairs(left, right, hash_, radius, bits).join(first, "hash_b")
    else:
        a = left.select(F.col(hash_).alias("hash_a")).filter(F.col("hash_a").isNotNull()).distinct()
        met = compared(a, first.filter(F.col("b").isNotNull()), radius, a.count(), n_b, nearest=True)
    best = met.groupBy("hash_a").agg(F.min(F.struct("distance", "b")).alias("best"))
    return left.select(F.col(key).alias("a"), F.col(hash_).alias("hash_a")).join(best, "hash_a").select("a", "best.b", "best.distance")


def greedy_flows(scored: DataFrame) -> DataFrame:
    """(a, b, similarity, flow) of rows (a, b, similarity, room_a, room_b): greedy by similarity, ties by a hash of the pair and ids.

    Every round takes what both ends of a pair want: the room that the better pairs of a node can't use up. That is what going
    through all pairs one by one gives. The best open pair is always taken, so the loop ends when no pair with room is left.
    """
    open_, taken = cut_lineage(scored.select("a", "b", "similarity", F.col("room_a").cast("long"), F.col("room_b").cast("long"))), []
    order = (F.desc("similarity"), F.xxhash64("a", "b"), "a", "b")
    while True:
        before = {s: Window.partitionBy(s).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for s in "ab"}
        wants = lambda s, o: F.least(f"room_{o}", F.col(f"room_{s}") - F.coalesce(F.sum(f"room_{o}").over(before[s]), F.lit(0)))
        mutual = cut_lineage(open_.withColumn("flow", F.least(wants("a", "b"), wants("b", "a"))).filter("flow > 0").select("a", "b", "similarity", "flow"))
        if mutual.isEmpty():
            break
        taken.append(mutual)
        if len(taken) == 16:
            taken = [cut_lineage(_union(taken))]
        for s in "ab":
            used = mutual.groupBy(s).agg(F.sum("flow").alias("used"))
            open_ = open_.join(used, s, "left").withColumn(f"room_{s}", F.col(f"room_{s}") - F.coalesce("used", F.lit(0))).drop("used").filter(F.col(f"room_{s}") > 0)
        open_ = cut_lineage(open_.select("a", "b", "similarity", "room_a", "room_b"))
    return cut_lineage(_union(taken)) if taken else open_.select("a", "b", "similarity", F.col("room_a").alias("flow")).limit(0)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def greedy_assignment(scored: DataFrame, capacity: int = 1) -> DataFrame:
    """(a, b, similarity) of given pairs with each b once and each a ``capacity`` times at most, greedy by similarity."""
    return greedy_flows(scored.withColumn("room_a", F.lit(capacity)).withColumn("room_b", F.lit(1))).select("a", "b", "similarity")


def _nodes(df: DataFrame, key: str, vector: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Rows (at, key) numbered so that copies of a vector follow each other, and its nodes (node, vector, room): one for each vector, named by its first number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(key, vector, F.sha2(F.col(vector).cast("string"), 256).alias("copy"))
    numbered = cut_lineage(with_index(rows, "at", "copy", key))
    nodes = numbered.groupBy("copy").agg(F.min("at").alias("node"), F.any_value(vector).alias(vector), (F.count(F.lit(1)) * capacity).alias("room"))
    return numbered.select("at", key), cut_lineage(nodes.drop("copy"))


def assignment(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, capacity: int = 1, cell: int = 2_000_000) -> DataFrame:
    """JN-16/17: (a, b, similarity) with each b once and each a ``capacity`` times, until all of one side is used up.

    Copies of a vector are one node with room for all of them. A pass matches every open left node greedily among its best open
    right nodes; those that found theirs taken meet the right nodes that are still open in the next pass. Passes see ``k`` right
    nodes, more when fewer left ones remain, so that no pass has more pairs than the first, nor 4,096 left ones more than ``cell``; a
    task's share of them is ``SEEN``.
    Rows without a finite vector are none. The total is not promised to be optimal.
    """
    (left_rows, lefts), (right_rows, rights) = _nodes(left, key, vector, capacity), _nodes(right, key, vector, 1)
    most, flows = k * left_rows.count(), []
    while (n := lefts.count()) and not rights.isEmpty():
        seen = max(k, min(most // n, cell // min(n, 4096)))
        found = cosine_top(lefts, rights, "node", vector, seen, most_blocks=1, cell=max(1, min(4096, SEEN // seen))).select("a", "b", "similarity")
        rooms = [df.select(F.col("node").alias(s), F.col("room").alias(f"room_{s}")) for df, s in ((lefts, "a"), (rights, "b"))]
        got = greedy_flows(found.join(rooms[0], "a").join(rooms[1], "b"))
        flows.append(got)
        left_over = lambda df, s: cut_lineage(df.join(got.groupBy(F.col(s).alias("node")).agg(F.sum("flow").alias("used")), "node", "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0))).drop("used").filter("room > 0"))  # noqa: B023, E731
        lefts, rights = left_over(lefts, "a"), left_over(rights, "b")
    if not flows:
        kind = dict(left.dtypes)[key]
        return left.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    edges = _union(flows).groupBy("a", "b", "similarity").agg(F.sum("flow").alias("flow"))
    start = lambda s: F.coalesce(F.sum("flow").over(Window.partitionBy(s).orderBy(F.desc("similarity"), "a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = edges.withColumn("sa", start("a")).withColumn("sb", start("b"))
    part = 65536  # copies of both ends make one pair of nodes many rows: it is dealt out in parts
    parts = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("flow") - 1, F.lit(part).cast("long")))).repartition("a", "b", "from")
    units = parts.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + part, F.col("flow")) - 1)))
    pairs = units.select(F.expr(f"a + (sa + i) div {capacity}").alias("at_a"), (F.col("b") + F.col("sb") + F.col("i")).alias("at_b"), "similarity")
    named = lambda df, s: df.select(F.col("at").alias(f"at_{s}"), F.col(key).alias(s))
    return pairs.join(named(left_rows, "a"), "at_a").join(named(right_rows, "b"), "at_b").select("a", "b", "similarity")


def top_summary(found: DataFrame, group: str) -> DataFrame:
    """AGG-35: mean, lowest and highest similarity of each row's best matches."""
    return found.groupBy(F.col("a").alias(group)).agg(F.round(F.avg("similarity"), 5).alias("mean_similarity"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"))
