"""JN-15: exact top k by cosine that skips blocks of rows which can't hold one of the k.

Right rows are cut into blocks of near vectors: each goes to its nearest anchor. A block is known by its anchor, its radius (the
widest angle between the anchor and a row of it) and its size; that is all the driver holds, for at most ``most_blocks`` blocks.
By the triangle inequality of angles, no row of a block is more similar to a left row than cos(angle to the anchor - radius).

There are two rounds, whatever the data are. In the first a left row meets its nearest blocks, as many as hold k rows, which gives
it a k-th similarity; in the second it meets every other block whose bound reaches that. Where vectors don't cluster, nothing
can be skipped, and the two rounds together are the full product, each pair once.

Blocks that are near each other share a bin of at most ``bin_rows`` rows (a larger block is cut by hash into pieces), and the visitors of a bin
are cut by hash into slices of about ``cell`` rows, so a block with most of the rows, or one that everybody visits, is many tasks. A
left row is sent once to a bin, with the blocks that it visits there and its k-th similarity so far; a bin sends at most k rows on for
it, and none below that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.operators.order import cut_lineage

#: Allowances for rounding: of an angle in radians, and of a similarity beyond the nine digits by which rows are ranked.
ANGLE, SIMILARITY = 1e-6, 1e-8

#: Similarities of a cell that are held at a time (4 bytes each), pairs computed in double precision at a time, and kept ones that wait for a sort.
HELD, EXACT, WAITING = 4_000_000, 8_192, 500_000


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column at length 1; a zero vector stays zero, so it has similarity 0 with everything."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.min_max(pc.list_value_length(lists)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} and {lengths['max']} entries in one search")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    flat = flat / np.maximum(1e-300, np.abs(flat).max(axis=1, keepdims=True, initial=0))
    return flat / np.maximum(1e-300, np.linalg.norm(flat, axis=1, keepdims=True))


def angles(vectors: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ anchors.T, -1.0, 1.0))


def whole(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))


def _with_block(anchors: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds block and angle to the anchor of it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = angles(units(batch.column("vb")), anchors)
                block = found.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(found[np.arange(len(block)), block])], names=[*batch.schema.names, "block", "angle"])

    return run


def _to_visit(anchors: np.ndarray, radii: np.ndarray, sizes: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the blocks to visit: without a k-th similarity the nearest ones that hold k rows, else all whose bound reaches it and that weren't visited."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = angles(units(batch.column("va")), anchors)
            if "visited" in batch.schema.names:
                bound = np.cos(np.clip(found - radii - ANGLE, 0.0, np.pi))
                least = pc.fill_null(batch.column("kth"), float("-inf")).to_numpy(zero_copy_only=False)
                wanted = bound >= least[:, None] - SIMILARITY
                for i, before in enumerate(batch.column("visited").to_pylist()):
                    wanted[i, before] = False
            else:
                order = np.argsort(found, axis=1, kind="stable")
                held = sizes[order]
                wanted = np.zeros(found.shape, dtype=bool)
                np.put_along_axis(wanted, order, np.cumsum(held, axis=1) - held < k, axis=1)
            blocks = pa.array([np.flatnonzero(w).tolist() for w in wanted], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("va"), batch.column("kth"), blocks], names=["a", "va", "kth", "blocks"])

    return run


class _Best:
    """The k best of every left row of a cell, block by block.

    Products in single precision, whose error is bounded, say what can reach a row's k-th similarity so far; that is computed in double
    precision and kept if it does. A row that has none yet gets one from every fourth column, so that a few times k similarities
    are kept for it. Once many wait, all but the k best of each row are dropped.
    """

    def __init__(self, va: np.ndarray, vb: np.ndarray, kth: np.ndarray, k: int, rank: np.ndarray):
        self.k, self.kth, self.rank = k, kth, rank
        self.va, self.vb, self.near_a, self.near_b = va, vb, va.astype(np.float32), vb.astype(np.float32)
        # Of a sum of products of unit vectors' entries, each entry rounded once: at most (entries + 2) roundings, here twice that.
        self.error = 2 * (va.shape[1] + 2) * 2.0**-24
        self.i, self.j, self.value = np.empty(0, int), np.empty(0, int), np.empty(0)
        self.waiting, self.n_waiting = [], 0

    def meet(self, rows: np.ndarray, columns: np.ndarray, them: np.ndarray) -> None:
        found = self.near_a[rows] @ them
        least = self.kth[rows]
        some = found[:, :: 4 if self.k <= 64 and found.shape[1] >= 4 * self.k else 1]
        if some.shape[1] >= self.k and len(new := np.flatnonzero(np.isneginf(least))):
            at = some.shape[1] - self.k
            least[new] = np.partition(some[new], at, axis=1)[:, at] - self.error
        i, j = np.divmod(np.flatnonzero(found >= (least - self.error - SIMILARITY).astype(np.float32)[:, None]), found.shape[1])
        for at in range(0, len(i), EXACT):
            x, y = i[at : at + EXACT], columns[j[at : at + EXACT]]
            value = np.einsum("ij,ij->i", self.va[rows[x]], self.vb[y])
            enough = np.round(value, 9) >= least[x]
            self.waiting.append((rows[x[enough]], y[enough], value[enough]))
            self.n_waiting += int(enough.sum())
        if self.n_waiting > max(WAITING, 2 * len(self.i)):
            self.settle()

    def settle(self) -> None:
        i, j, value = (np.concatenate(x) for x in zip((self.i, self.j, self.value), *self.waiting))
        near = np.round(value, 9)
        order = np.lexsort((self.rank[j], -near, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.kth[i[last]] = np.maximum(self.kth[i[last]], near[order[last]])
        order = order[place < self.k]
        self.i, self.j, self.value = i[place < self.k], j[order], value[order]
        self.waiting, self.n_waiting = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle()
        return self.i, self.j, self.value


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        ids_a, ids_b = lefts.column("a").combine_chunks(), rights.column("b").combine_chunks()
        rank = np.empty(len(ids_b), int)
        rank[pc.sort_indices(ids_b).to_numpy()] = np.arange(len(ids_b))
        if not len(ids_a) or not len(ids_b):
            return pa.table({"a": ids_a[:0], "b": ids_b[:0], "similarity": np.empty(0), "near": np.empty(0)})
        kth = pc.fill_null(lefts.column("kth"), float("-inf")).to_numpy().copy()
        best = _Best(units(lefts.column("va")), units(rights.column("vb")), kth, k, rank)
        visits = lefts.column("blocks").combine_chunks()
        visitor, visited = np.repeat(np.arange(len(visits)), pc.list_value_length(visits).to_numpy()), visits.flatten().to_numpy()
        block = rights.column("block").to_numpy()
        for number in np.unique(block):
            rows, columns = visitor[visited == number], np.flatnonzero(block == number)
            step, them = max(1, HELD // len(columns)), best.near_b[columns].T
            for at in range(0, len(rows), step):
                best.meet(rows[at : at + step], columns, them)
        i, j, value = best.result()
        return pa.table({"a": ids_a.take(pa.array(i)), "b": ids_b.take(pa.array(j)), "similarity": value, "near": np.round(value, 9)})

    return run


def _bins(anchors: np.ndarray, sizes: list[int], bin_rows: int) -> list[int]:
    """The bin of each block: blocks in a chain of nearest anchors fill bins up to ``bin_rows``."""
    bins, number, filled, at, open_ = [0] * len(sizes), 0, 0, 0, set(range(len(sizes)))
    while open_:
        open_.remove(at)
        if filled and filled + sizes[at] > bin_rows:
            number, filled = number + 1, 0
        bins[at], filled = number, filled + sizes[at]
        if open_:
            rest = np.array(sorted(open_))
            at = int(rest[(anchors[rest] @ anchors[at]).argmax()])
    return bins


def _cells(chosen: DataFrame, blocks: DataFrame, sizes: list[int], bins: list[int], kinds: str, k: int, cell: int, bin_rows: int) -> DataFrame:
    """(a, b, similarity, near): the k best of every bin for each of its visitors, for rows (a, va, kth, blocks) and (b, vb, block)."""
    table = F.array(*[F.lit(n) for n in bins])
    of = lambda x: F.get(table, x)
    visits = chosen.withColumn("bin", F.explode(F.array_distinct(F.transform("blocks", of)))).withColumn("blocks", F.filter("blocks", lambda x: of(x) == F.col("bin")))
    visitors = visits.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a bin
    held = np.bincount(bins, weights=sizes)
    dealt = F.broadcast(chosen.sparkSession.createDataFrame([(r["bin"], -(-r["n"] // cell), int(-(-held[r["bin"]] // bin_rows))) for r in visitors], "bin int, slices int, pieces int"))
    own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ("bin", "slice", "piece")
    left = visits.join(dealt, "bin").withColumn("slice", own("a", "slices")).withColumn("piece", every("pieces")).select(*key, "a", "va", "kth", "blocks")
    right = blocks.withColumn("bin", of("block")).join(dealt, "bin").withColumn("piece", own("b", "pieces")).withColumn("slice", every("slices")).select(*key, "b", "vb", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), f"{kinds}, similarity double, near double")


def _placed(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _search(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, block: int, most_blocks: int, cell: int, bin_rows: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The k best (a, b, similarity, near, place), the blocks that each left row visits (a, blocks) in either round, and the sizes of blocks."""
    spark, kind = left.sparkSession, dict(left.dtypes)[key]
    kinds = f"a {kind}, b {dict(right.dtypes)[key]}"
    rows = lambda df, id_, name: df.filter(F.col(key).isNotNull() & whole(vector)).select(F.col(key).alias(id_), F.col(vector).cast("array<double>").alias(name))
    a, b = rows(left, "a", "va"), rows(right, "b", "vb")
    n_right = b.count()
    if not n_right:
        return spark.createDataFrame([], f"{kinds}, similarity double, near double, place int"), spark.createDataFrame([], f"a {kind}, blocks array<int>"), []
    n_blocks = min(most_blocks, -(-n_right // block))
    if n_blocks == 1:
        chosen = a.select("a", "va", F.lit(None).cast("double").alias("kth"), F.array(F.lit(0)).alias("blocks"))
        return _placed(_cells(chosen, b.withColumn("block", F.lit(0)), [n_right], [0], kinds, k, cell, bin_rows), k), chosen.select("a", "blocks"), [n_right]

    drawn = b.orderBy(F.xxhash64("b"), "b").select("vb").limit(n_blocks).toArrow()  # at most most_blocks vectors
    anchors = units(drawn.column("vb"))
    blocks = cut_lineage(b.mapInArrow(_with_block(anchors), f"b {dict(b.dtypes)['b']}, vb array<double>, block int, angle double"))
    shape = {r["block"]: (r["radius"], r["n"]) for r in blocks.groupBy("block").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(shape)  # anchors that are copies of others have no rows
    anchors, radii, sizes = anchors[names], np.array([shape[n][0] for n in names]), [shape[n][1] for n in names]
    bins = _bins(anchors, sizes, bin_rows)
    numbers = F.broadcast(spark.createDataFrame([(old, new) for new, old in enumerate(names)], "block int, number int"))
    blocks = blocks.join(numbers, "block").select("b", "vb", F.col("number").alias("block"))
    visit = lambda df: cut_lineage(df.mapInArrow(_to_visit(anchors, radii, np.array(sizes), k), f"a {kind}, va array<double>, kth double, blocks array<int>"))

    first = visit(a.withColumn("kth", F.lit(None).cast("double")))
    early = cut_lineage(_placed(_cells(first, blocks, sizes, bins, kinds, k, cell, bin_rows), k))
    kth = early.filter(F.col("place") == k).select("a", F.col("near").alias("kth"))
    second = visit(first.drop("kth").withColumnRenamed("blocks", "visited").join(kth, "a", "left"))
    late = _cells(second, blocks, sizes, bins, kinds, k, cell, bin_rows)
    return _placed(early.drop("place").unionByName(late), k), first.select("a", "blocks").unionByName(second.select("a", "blocks")), sizes


def cosine_top(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, block: int = 1024, most_blocks: int = 1024, cell: int = 4096, bin_rows: int = 32768) -> DataFrame:
    """JN-15: (a, b, similarity, place), the k most similar right rows of each left row, ties at nine digits by the right key.

    Rows without a key or a vector, or with a null or infinite entry in it, have no neighbours and are none. A zero vector has similarity 0
    with all. Keys of a side are unique. Vectors of different lengths raise.
    """
    found = _search(left, right, key, vector, k, block, most_blocks, cell, bin_rows)[0]
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"), "place")


def search_work(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, block: int = 1024, most_blocks: int = 1024, cell: int = 4096, bin_rows: int = 32768) -> DataFrame:
    """What the search of ``cosine_top`` costs: blocks, visits of blocks by left rows, pairs compared, and the share of all visits that bounds made needless."""
    visits, sizes = _search(left, right, key, vector, k, block, most_blocks, cell, bin_rows)[1:]
    spark = left.sparkSession
    held = F.broadcast(spark.createDataFrame(list(enumerate(sizes)), "block int, n long"))
    n_left = left.filter(F.col(key).isNotNull() & whole(vector)).agg(F.count(F.lit(1)).alias("n_left"))
    done = visits.select(F.explode("blocks").alias("block")).join(held, "block").agg(F.count(F.lit(1)).alias("n_visits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_compared"))
    n_right = sum(sizes)
    skipped = F.round(1 - F.coalesce(F.try_divide(F.col("n_visits"), F.col("n_left") * len(sizes)), F.lit(1.0)), 6)
    return n_left.crossJoin(F.broadcast(done)).select("n_left", F.lit(n_right).cast("long").alias("n_right"), F.lit(len(sizes)).alias("n_blocks"), "n_visits", "n_compared", (F.col("n_left") * n_right).alias("n_pairs"), skipped.alias("share_skipped"))
