"""JN-16/17: one-to-one assignment by a distributed auction with prices, and its certificate.

The smaller side bids, the other side's rows are the objects. An object's price is the last bid for it; what a bidder gains from an object is
their similarity less the price. Bids raise a price so far that the object is worth ``epsilon`` less to its new holder than the
next best one, so a holder never misses more than epsilon, and no unsold object has a price. Whatever the prices p are, the sum of
all bidders' best gains and all prices bounds every assignment's total from above (linear programming duality); at the end
that bound is at most bidders x epsilon above the total that was found.

Bidders know a list of their best objects and a bound for the gain from all others, which stays a bound while prices rise. In a
round every block of bidders, holders too, holds its own auction among their lists, in one task, from the prices that all
know; prices only rise, so the highest bid of all blocks for an object may stand whatever happened elsewhere. Losers bid again in the next
round, in blocks drawn anew. A list is read again, at the prices of that time, once less than half of it beats its bound: prices
rise everywhere, and a last bidder's chain of displaced holders then seldom meets one whose list is used up. Bidders with the same vector are one,
with room for as many objects; rooms are cut into parts of at most ``PART``.

Lists are read in slices of up to ``SLICE`` bidders: a task holds its slice and the best objects so far while all objects stream by, so an
object is sent once for each slice, and nothing but a bidder's finished list leaves the task. A list is one row, eight bytes an object. Tables
that a round replaces are deleted at once.

One block holds ``BLOCK`` bidders with lists of ``LIST`` objects and one place, some thirty-four million entries. Where all bidders are one block, a few rounds are enough,
each of them lists read again. Beyond that the bound stays what it is, but the last bidders' price war goes on between blocks, a step a round,
and rounds grow with the number of bidders.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evalmill.operators.cosine import EXACT, SIMILARITY, units
from evalmill.operators.order import cut_lineage, drop_cut, with_index

#: Places of a bidder; objects on a list besides those that fill its places; bidders that hold one auction in one task.
PART, LIST, BLOCK = 256, 64, 524_288

#: Bidders that read their lists in one task, and at least so many where more tasks could run; rows and columns of a product of the search.
SLICE, FEW, ROWS, COLUMNS = 32_768, 1_024, 1_024, 4_096

#: Similarities on a list are whole numbers of these.
UNIT = 1e9

STATE = "a long, b long, similarity double, price double"
LISTS = "a long, room int, bound double, near array<int>, b array<int>"


class _Gains:
    """The objects with the highest gain for each of some bidders; those of equal gain by number.

    Products in single precision, whose error is bounded, say which gains are computed in double precision. Once as many objects wait as are held, all but the
    best of each bidder are dropped.
    """

    def __init__(self, va: np.ndarray, take: np.ndarray):
        self.va, self.take, self.least = va, take, np.full(len(take), -np.inf)
        self.near_a = np.column_stack([va, np.full(len(va), -1.0)]).astype(np.float32)  # the price is an entry more
        self.i, self.b, self.near, self.gain = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
        self.waiting, self.n_waiting = [], 0

    def meet(self, ids: np.ndarray, vb: np.ndarray, near_b: np.ndarray, price: np.ndarray) -> None:
        found, most = self.near_a @ near_b, int(self.take.max())
        # Of a sum of products, each entry rounded once: at most (entries + 2) roundings of what is at most 1 and the price, here twice that.
        error = 2 * (len(near_b) + 2) * 2.0**-24 * (1 + np.abs(price).max(initial=0)) + SIMILARITY
        least = self.least
        if found.shape[1] >= most and len(new := np.flatnonzero(np.isneginf(least))):
            at = found.shape[1] - most
            least[new] = np.partition(found[new], at, axis=1)[:, at] - error
        i, j = np.divmod(np.flatnonzero(found >= (least - error).astype(np.float32)[:, None]), found.shape[1])
        for at in range(0, len(i), EXACT):
            x, y = i[at : at + EXACT], j[at : at + EXACT]
            near = np.rint(np.einsum("ij,ij->i", self.va[x], vb[y]) * UNIT).astype(np.int32)
            gain = near / UNIT - price[y]
            enough = gain >= least[x]
            self.waiting.append((x[enough].astype(np.int32), ids[y[enough]], near[enough], gain[enough]))
            self.n_waiting += int(enough.sum())
        if self.n_waiting > len(self.i):
            self.settle()

    def settle(self) -> None:
        i, b, near, gain = (np.concatenate(x) for x in zip((self.i, self.b, self.near, self.gain), *self.waiting))
        order = np.lexsort((b, -gain, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.take[i] - 1
        self.least[i[last]] = np.maximum(self.least[i[last]], gain[order[last]])
        held = place < self.take[i]
        order = order[held]
        self.i, self.b, self.near, self.gain = i[held], b[order], near[order], gain[order]
        self.waiting, self.n_waiting = [], 0

    def lists(self, a: np.ndarray, room: np.ndarray) -> pa.RecordBatch:
        """A row for each bidder; no object that isn't on the list gains more than its bound."""
        self.settle()
        first = np.searchsorted(self.i, np.arange(len(a) + 1))
        full = np.diff(first) == self.take
        bound = np.where(full, self.gain[np.maximum(first[1:] - 1, 0)], -np.inf)
        listed = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in (self.near, self.b)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(room, pa.int32()), pa.array(bound), *listed], names=["a", "room", "bound", "near", "b"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bidders come first (side 0; take in n), then objects (side 1; price in x)."""
    bidders, some = [], None
    for batch in batches:
        cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
        if cut:
            bidders.append(batch.slice(0, cut))
        if cut == batch.num_rows or not bidders:
            continue
        if some is None:
            whole = pa.Table.from_batches(bidders)
            a, room, take = (whole.column(c).to_numpy() for c in ("id", "room", "take"))
            va = units(whole.column("v"))
            some = [_Gains(va[at : at + ROWS], take[at : at + ROWS]) for at in range(0, len(a), ROWS)]
        objects = batch.slice(cut)
        ids, price, vb = objects.column("id").to_numpy(), objects.column("price").to_numpy(), units(objects.column("v"))
        if ids.max() >= 2**31:
            raise ValueError(f"object {ids.max()} has a number beyond 32 bits")
        ids = ids.astype(np.int32)
        for at in range(0, len(ids), COLUMNS):
            own = slice(at, at + COLUMNS)
            near_b = np.ascontiguousarray(np.column_stack([vb[own], price[own]]).astype(np.float32).T)
            for s in some:
                s.meet(ids[own], vb[own], near_b, price[own])
    for k, s in enumerate(some or []):
        yield s.lists(a[k * ROWS : (k + 1) * ROWS], room[k * ROWS : (k + 1) * ROWS])


def dealt(first: DataFrame, then: DataFrame, names: list[str], parts: int) -> DataFrame:
    """Rows of ``then`` once in each of ``parts`` tasks, behind the rows of ``first`` (side 0) that have its number in ``at``; columns that a side lacks are null."""
    every = then.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(1))
    both = first.withColumn("side", F.lit(0)).unionByName(every, allowMissingColumns=True)
    return both.repartitionById(parts, "at").sortWithinPartitions("side").select("side", *names)


def priced_lists(bidders: DataFrame, objects: DataFrame) -> DataFrame:
    """``LISTS``: for each of (a, va, room, take) the ``take`` objects (b, vb, price) with the highest gain, and a bound for all others."""
    n = bidders.count()
    slices = max(1, -(-n // SLICE), min(-(-n // FEW), bidders.sparkSession.sparkContext.defaultParallelism))
    left = bidders.select(F.pmod(F.xxhash64("a"), F.lit(slices)).cast("int").alias("at"), F.col("a").alias("id"), F.col("va").alias("v"), F.col("room").cast("int").alias("room"), F.col("take").cast("int").alias("take"))
    right = objects.select(F.col("b").alias("id"), F.col("vb").alias("v"), "price")
    return dealt(left, right, ["id", "v", "room", "take", "price"], slices).mapInArrow(_read, LISTS)


class _Market:
    """Bidders by place, their lists one after the other (list i from first[i] on), and prices and holders (places, or -1) of all objects by number."""

    def __init__(self, room: np.ndarray, bound: np.ndarray, first: np.ndarray, what: np.ndarray, near: np.ndarray, unit: float, price: np.ndarray, holder: np.ndarray, worth: np.ndarray):
        self.room, self.bound, self.first, self.what, self.near, self.unit, self.price, self.holder, self.worth = room, bound, first, what, near, unit, price, holder, worth
        # What a bidder holds counts as on its list.
        held = np.flatnonzero(holder >= 0)
        start, size, there = first[holder[held]], np.diff(first)[holder[held]], np.zeros(len(held), dtype=bool)
        for j in range(int(size.max(initial=0))):
            there |= (j < size) & (what[np.minimum(start + j, len(what) - 1)] == held)
        more = held[~there]
        if len(more):
            more = more[np.argsort(holder[more], kind="stable")]
            behind = first[holder[more] + 1]
            self.what, self.near = np.insert(what, behind, more), np.insert(near, behind, worth[more])
            self.first = first + np.append(0, np.cumsum(np.bincount(holder[more], minlength=len(room))))

    def hold(self, epsilon: float) -> None:
        room, bound, first, what, near, unit, price, holder, worth = self.room, self.bound, self.first, self.what, self.near, self.unit, self.price, self.holder, self.worth
        wants = room - np.bincount(holder[holder >= 0], minlength=len(room))
        open_ = deque(np.flatnonzero(wants > 0).tolist())
        queued = wants > 0
        while open_:
            a = open_.popleft()
            queued[a] = False
            own = slice(first[a], first[a + 1])
            ids, similar = what[own], near[own]
            gain = similar / unit - price[ids]
            good = np.flatnonzero((gain >= bound[a]) & (holder[ids] != a))
            if not len(good):
                continue
            good = good[np.argsort(-gain[good], kind="stable")]
            taken, rest = good[: wants[a]], good[wants[a] :]
            next_best = gain[rest[0]] if len(rest) else max(bound[a], gain[taken[-1]]) if np.isinf(bound[a]) else bound[a]
            price[ids[taken]] += gain[taken] - next_best + epsilon
            for x in holder[ids[taken]].tolist():
                if x >= 0:
                    wants[x] += 1
                    if not queued[x]:
                        queued[x] = True
                        open_.append(x)
            holder[ids[taken]], worth[ids[taken]] = a, similar[taken]
            wants[a] -= len(taken)

    def good(self) -> np.ndarray:
        """How many objects of each list beat its bound."""
        counts = []
        for at in range(0, len(self.room), ROWS):
            first = self.first[at : at + ROWS + 1]
            who = np.repeat(np.arange(at, at + len(first) - 1), np.diff(first))
            own = slice(first[0], first[-1])
            beats = self.near[own] / self.unit - self.price[self.what[own]] >= self.bound[who]
            counts.append(np.bincount(who[beats] - at, minlength=len(first) - 1))
        return np.concatenate(counts).astype(float)


def block_auction(bidders: pd.DataFrame, lists: pd.DataFrame, epsilon: float) -> pd.DataFrame:
    """An auction among bidders (a, room, bound) and their lists (a, b, similarity, price, mine): who holds what at which price."""
    names, who = np.unique(lists["a"].to_numpy(), return_inverse=True)
    objects, what = np.unique(lists["b"].to_numpy(), return_inverse=True)
    order = np.lexsort((what, who))
    who, what, near = who[order], what[order], lists["similarity"].to_numpy()[order]
    price, holder, worth = np.zeros(len(objects)), np.full(len(objects), -1), np.zeros(len(objects))
    price[what] = lists["price"].to_numpy()[order]
    mine = lists["mine"].to_numpy(dtype=bool)[order]
    holder[what[mine]], worth[what[mine]] = who[mine], near[mine]
    told = bidders.set_index("a").reindex(names)
    market = _Market(told["room"].to_numpy().astype(int), told["bound"].to_numpy(), np.searchsorted(who, np.arange(len(names) + 1)), what, near, 1.0, price, holder, worth)
    market.hold(epsilon)
    held = holder >= 0
    sold = pd.DataFrame({"a": names[holder[held]], "b": objects[held], "similarity": worth[held], "price": price[held]})
    return pd.concat([sold, pd.DataFrame({"a": names, "b": -1, "similarity": market.good(), "price": 0.0})])


def _hold(epsilon: float):
    """Rows of the state come first (side 0), then lists, each once; the block's auction gives its part of the next state, and for each bidder (b -1) how many of its list are good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, told = [], []
        for batch in batches:
            cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if cut:
                told.append([batch.slice(0, cut).column(c).to_numpy() for c in ("a", "room", "bound")] + [x for c in ("near", "listed") for x in _flat(batch.slice(0, cut).column(c))])
            if cut < batch.num_rows:
                states.append([batch.slice(cut).column(c).to_numpy() for c in ("a", "b", "similarity", "price")])
        if not told:
            return
        a, room, bound, size, near, _, what = (np.concatenate(x) for x in zip(*told))
        del told
        first = np.append(0, np.cumsum(size))
        owner, b, similarity, paid = (np.concatenate(x) for x in zip(*states)) if states else (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0))
        n = 1 + max(int(what.max(initial=-1)), int(b.max(initial=-1)))
        price, holder, worth = np.zeros(n), np.full(n, -1), np.zeros(n, np.int32)
        price[b] = paid
        order = np.argsort(a)
        at = np.minimum(np.searchsorted(a, owner, sorter=order), len(a) - 1)
        mine = a[order[at]] == owner
        holder[b[mine]], worth[b[mine]] = order[at[mine]], np.rint(similarity[mine] * UNIT)
        market = _Market(room.astype(int), bound, first, what, near, UNIT, price, holder, worth)
        del what, near
        market.hold(epsilon)
        held = np.flatnonzero(holder >= 0)
        columns = ((a[holder[held]], held, worth[held] / UNIT, price[held]), (a, np.full(len(a), -1), market.good(), np.zeros(len(a))))
        for some in columns:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], names=["a", "b", "similarity", "price"])

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """How long each list is, and their values one after the other, as copies."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().copy()


def auction(bidders: DataFrame, objects: DataFrame, epsilon: float, block: int = BLOCK, listed: int = LIST) -> tuple[DataFrame, int]:
    """(a, b, similarity, price) of bidders (a, va, room) and objects (b, vb), no fewer than all rooms, and the number of rounds."""
    n, rooms = bidders.agg(F.count(F.lit(1)), F.coalesce(F.sum("room"), F.lit(0))).first()
    n_blocks = max(1, -(-(rooms + n * listed) // (block * (listed + 1))))
    state = cut_lineage(objects.sparkSession.createDataFrame([], STATE))
    lists = bids = None
    rounds, wanted = 0, (F.col("room") + listed).cast("int")
    while rooms and state.count() < rooms:
        rounds += 1
        stale = bidders
        if rounds > 1:
            held = state.groupBy("a").agg(F.count(F.lit(1)).alias("held"))
            good = bids.filter("b < 0").select("a", F.col("similarity").alias("good"))
            worn = (2 * F.coalesce("good", F.lit(0.0)) < wanted) | (F.coalesce("held", F.lit(0)) < F.col("room"))
            stale = bidders.join(held, "a", "left").join(good, "a", "left").filter(worn).select("a", "va", "room")
        stale = cut_lineage(stale.withColumn("take", wanted))
        priced = objects.join(state.select("b", "price"), "b", "left").fillna(0.0, ["price"])
        fresh = cut_lineage(priced_lists(stale, priced))
        drop_cut(stale)
        if lists is None:
            lists = fresh
        else:
            before, lists = lists, cut_lineage(lists.join(fresh.select("a"), "a", "left_anti").unionByName(fresh))
            drop_cut(before, fresh, bids)
        at = F.pmod(F.xxhash64("a", F.lit(rounds)), F.lit(n_blocks)).cast("int").alias("at")
        known = dealt(lists.select(at, "a", "room", "bound", "near", F.col("b").alias("listed")), state, ["a", "room", "bound", "near", "listed", "b", "similarity", "price"], n_blocks)
        bids = cut_lineage(known.mapInArrow(_hold(epsilon), STATE))
        best = bids.filter("b >= 0").groupBy("b").agg(F.max_by(F.struct("a", "similarity", "price"), F.struct("price", "a")).alias("x"))
        before, state = state, cut_lineage(best.select("x.a", "b", "x.similarity", "x.price"))
        drop_cut(before)
    drop_cut(*[x for x in (lists, bids) if x is not None])
    return state, rounds


def assignment_bound(state: DataFrame, bidders: DataFrame, objects: DataFrame) -> DataFrame:
    """One row (total, bound): what was found, and what no assignment can exceed at these prices; reads all pairs once more."""
    priced = objects.join(state.select("b", "price"), "b", "left").fillna(0.0, ["price"])
    best = priced_lists(bidders.withColumn("take", F.lit(1)), priced)
    gains = best.agg(F.coalesce(F.sum(F.col("bound") * F.col("room")), F.lit(0.0)).alias("gains"))
    paid = state.agg(F.coalesce(F.sum("similarity"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("prices"))
    return paid.crossJoin(F.broadcast(gains)).select("total", (F.col("gains") + F.col("prices")).alias("bound"))


class Assignment:
    """The pairs (a, b, similarity, price, a_bids), and the certificate (total, bound, epsilon, n, rounds), each as a table."""

    def __init__(self, left: DataFrame, right: DataFrame, key: str, vector: str, capacity: int = 1, epsilon: float = 0.01, block: int = BLOCK, listed: int = LIST):
        single = all(df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) for df in (left, right))
        kind = "array<float>" if single else "array<double>"
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        usable = lambda df: df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))
        slots = usable(left).select("*", F.explode(F.sequence(F.lit(1), F.lit(capacity))).alias("slot"))
        number = lambda df: cut_lineage(with_index(df.withColumn("copy", F.sha2(F.col("v").cast("array<double>").cast("string"), 256)), "at", "copy", "id", "slot"))
        sides = [number(slots), number(usable(right).withColumn("slot", F.lit(1)))]
        counts = [s.count() for s in sides]
        self.swapped = counts[1] < counts[0]
        own, others = sides[::-1] if self.swapped else sides
        # Bidders with one vector, in parts: rows of a part follow each other in number.
        first = own.groupBy("copy").agg(F.min("at").alias("first"))
        parted = own.join(first, "copy").withColumn("part", F.expr(f"(at - first) div {PART}")).withColumn("a", F.col("first") + F.col("part") * PART)
        self.rows = cut_lineage(parted.select("at", "id", "a"))
        self.bidders = cut_lineage(parted.groupBy("a").agg(F.any_value("v").alias("va"), F.count(F.lit(1)).alias("room")))
        self.objects = cut_lineage(others.select(F.col("at").alias("b"), F.col("v").alias("vb"), F.col("id").alias("object")))
        drop_cut(*sides)
        self.epsilon, self.n = epsilon, min(counts)
        self.state, self.rounds = auction(self.bidders, self.objects.select("b", "vb"), epsilon, block, listed)

    def pairs(self) -> DataFrame:
        """(a, b, similarity, price): a left row, a right row; left rows ``capacity`` times at most, right rows once."""
        nth = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
        placed = self.state.withColumn("at", F.col("a") + F.row_number().over(nth) - 1)
        named = placed.join(self.rows.select("at", F.col("id").alias("bidder")), "at").join(self.objects.select("b", "object"), "b")
        a, b = ("object", "bidder") if self.swapped else ("bidder", "object")
        return named.select(F.col(a).alias("a"), F.col(b).alias("b"), "similarity", "price")

    def certificate(self) -> DataFrame:
        return assignment_bound(self.state, self.bidders, self.objects.select("b", "vb")).select("total", "bound", F.lit(self.epsilon).alias("epsilon"), F.lit(self.n).cast("long").alias("n"), F.lit(self.rounds).alias("rounds"))


def assignment_properties(made: Assignment, left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: pairs, left and right rows in them, and whether all similarities are those of the vectors and the total keeps its bound."""
    pairs = cut_lineage(made.pairs())
    of = lambda df, side: df.select(F.col(key).alias(side), F.col(vector).alias(f"v{side}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, z: t + z)
    both = pairs.join(of(left, "a"), "a").join(of(right, "b"), "b")
    again = dot("va", "vb") / F.greatest(F.lit(1e-300), F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    counted = both.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("a").alias("left_used"), F.count_distinct("b").alias("right_used"), F.coalesce(F.max(F.abs(again - F.col("similarity"))) < 1e-6, F.lit(True)).alias("similarities_hold"))
    proof = made.certificate().select(((F.col("bound") >= F.col("total") - 1e-6) & (F.col("bound") <= F.col("total") + F.col("n") * F.col("epsilon") + 1e-6)).alias("within_bound"))
    return counted.crossJoin(F.broadcast(proof))
