"""Near-duplicate detection with DartMinHash signatures and banded joining.

A text is the multiset of its 5-word shingles (A-Z lower-cased, words of letters and digits); similarity is the weighted
Jaccard index, 0.8 or more makes a link, classes are the connected components.

Signature: each unit of weight (a shingle and its how-manieth occurrence) is a region onto which darts are thrown by a hashed
Poisson process: exponential gaps between hashed arrivals. Only arrivals before a horizon are looked at, which for a long text
are few of its regions; each dart falls on one of K coordinates, and the earliest one on each coordinate is kept. Two
texts agree in a coordinate with the probability of their similarity. If a coordinate stays empty, the horizon is doubled, which
changes nothing that was found. R coordinates make a band; texts that share a band are candidates (at 0.8 a pair shares none of
the 40 bands of 6 with probability 5e-6).

No group is expanded into pairs. Copies (same words) are one node. In a band's bucket every member is compared with the
bucket's leader only; the exact similarity decides. Buckets whose members then lie in several components are searched on:
nodes whose units can't make up a link to another component are left out; where much is left outside the buckets' largest
components, further leaders, each from outside, are compared with the other components' members until a round finds little; and
what is left outside meets all members of other components, block by block, by bit maps of units whose differences bound the
similarity from above. Pairs that pass are compared exactly. So no link between different components that share a bucket is
lost, members of one component are never paired, and arrays of units are sent only for pairs that the bit maps let through.

Cases: a text of one to four words is one shingle; texts without words (null too) are each their own class; the row with the
smallest doc_id of a class stays (null is smallest), one of several rows with equal id and words; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import ascii_lower, cut_lineage, drop_losers, hot_keys, let, map_frames, sized_join, spread_join, table

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6

#: Comparisons of bit maps for each row of a bucket that are no more work than a round of leaders.
EACH = 64

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ODD1, ODD2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiply and shift twice."""
    x = (x ^ (x >> np.uint64(30))) * ODD1
    x = (x ^ (x >> np.uint64(27))) * ODD2
    return x ^ (x >> np.uint64(31))


def units(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Distinct numbers for (shingle, occurrence), from hashes of a text's words."""
    words = words.astype(np.int64).view(np.uint64)
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    shingles = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        shingles = mix(shingles * STEP + words[k : len(words) - size + 1 + k])
    shingles.sort()
    first = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    occurrence = np.arange(len(shingles)) - np.maximum.accumulate(np.where(first, np.arange(len(shingles)), 0))
    return mix(shingles + occurrence.astype(np.uint64) * STEP)


def signature(regions: np.ndarray, k: int) -> np.ndarray:
    """Ids of the earliest dart on each of k coordinates."""
    horizon = (k * np.log(k) + 3 * k) / len(regions)
    while True:
        width = int(horizon + 4 * horizon**0.5) + 1
        left, clock, thrown = regions, np.zeros(len(regions)), 0
        ids, times = [], []
        while len(left):
            number = np.arange(thrown, thrown + width, dtype=np.uint64)
            dart = mix(left[:, None] ^ mix(number * STEP + ODD2)[None, :])
            when = clock[:, None] + np.cumsum(-np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1)
            hit = when < horizon
            ids.append(dart[hit])
            times.append(when[hit])
            more = hit[:, -1]
            left, clock, thrown = left[more], when[more, -1], thrown + width
        ids, times = np.concatenate(ids), np.concatenate(times)
        order = np.argsort(times, kind="stable")
        coordinate, at = np.unique(mix(ids[order] + STEP) % np.uint64(k), return_index=True)
        if len(coordinate) == k:
            return ids[order][at]
        horizon *= 2


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A number for each band, of the band's place and its rows."""
    parts = sketch.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for column in range(rows):
        key = mix(key * STEP + parts[:, column])
    return key.view(np.int64)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def digest(words: Column) -> Column:
    """16 bytes that stand for the word sequence; null without words."""
    return F.when(F.size(words) > 0, F.unhex(F.md5(F.array_join(words, " "))))


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, words as hashes)."""
    read = docs.select("doc_id", let(word_list(F.col("text")), lambda w: F.struct(digest(w).alias("digest"), F.transform(w, lambda x: F.xxhash64(x)).alias("words"))).alias("w"))
    return read.select("doc_id", "w.digest", "w.words")


def sketches(docs: DataFrame, band_count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, digest, n, keys): n units, a key for each band; rows without words have none."""

    def run(batches):
        for batch in batches:
            sizes, keys = [], []
            for words in batch["words"]:
                own = units(np.asarray(words))
                sizes.append(len(own))
                keys.append(bands(signature(own, band_count * rows), rows) if len(own) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n": sizes, "keys": keys})

    made = map_frames(hashed_words(docs), run, "doc_id long, digest binary, n long, keys array<long>")
    return cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))


def bit_map(own: np.ndarray) -> np.ndarray:
    """Parities of the units' numbers, each modulo a power of two of at least 256 and twice the units, as 64-bit words.

    Bits in which two maps differ are at most the units in which the sets differ. Words folded by exclusive or are the map of half
    the size, so maps of different sizes can be compared.
    """
    size = max(256, 1 << int(2 * len(own) - 1).bit_length())
    odd = np.bincount((mix(own) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_units(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, units, bits) of the nodes in ``named`` (node, doc_id, digest), from their texts, which are read again."""

    def run(batches):
        for batch in batches:
            own = [units(np.asarray(w)) for w in batch["words"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "units": [u.view(np.int64) for u in own], "bits": [bit_map(u) for u in own]})

    ids = named.select(F.col("doc_id").alias("__id"))
    some = sized_join(docs.select("doc_id", "text"), ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    read = map_frames(hashed_words(some), run, "doc_id long, digest binary, units array<long>, bits array<long>")
    key = named.select("node", F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    return cut_lineage(read.join(key, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "units", "bits"))


def similar_pairs(pairs: DataFrame, read: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity is high enough; ``read`` holds their units."""
    left, right = (read.select(F.col("node").alias(x), F.col("units").alias(f"units_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("units_a", "units_b"))
    return both.select("a", "b", common.alias("common"), (F.size("units_a") + F.size("units_b")).alias("sizes")).filter(F.col("common") >= similarity * (F.col("sizes") - F.col("common"))).select("a", "b").distinct()


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of edges given as two arrays."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (a, b, before[a], before[b]):
            np.minimum.at(root, x, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def components(edges: DataFrame, part: int = 500_000) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), the component named by its smallest node.

    Each task first reduces its edges, ``part`` of them or so, to stars; where all edges are one part, this is the answer. Otherwise
    large-star and small-star steps alternate until nothing changes; what a step keeps is written to the checkpoint folder.
    """

    def reduce_(batches):
        found = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
        if found:
            nodes, roots = star_forest(*(np.concatenate(x) for x in zip(*found)))
            yield pd.DataFrame({"u": nodes, "v": roots})

    state = cut_lineage(edges.select("a", "b"))
    parts = max(1, -(-state.count() // part))
    state = cut_lineage(state.coalesce(parts).mapInPandas(reduce_, "u long, v long"))
    if parts == 1:
        return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = cut_lineage(state.filter("u != v").distinct())
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        state = cut_lineage(small.select("e.u", "e.v").filter("u != v").distinct())
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after further links (a, b); a node that it hasn't is its own component."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = cut_lineage(components(named))
    known = found.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut_lineage(known.unionByName(moved.join(found, "node", "left_anti")))


def split_buckets(rows: DataFrame, found: DataFrame, hot: list) -> DataFrame:
    """``rows`` of the buckets that hold several components, with component, the bucket's largest one and its rows ``outside`` that one."""
    tagged = cut_lineage(rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))  # read twice
    counted = tagged.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n_in"))
    split = counted.groupBy("key").agg(F.max_by("component", F.struct("n_in", "component")).alias("largest"), (F.sum("n_in") - F.max("n_in")).alias("outside"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return spread_join(tagged, split.drop("parts"), "key", "node", hot)


def possible_members(open_: DataFrame, read: DataFrame, similarity: float, hot: list) -> DataFrame:
    """(key, node, n, met, low, high, bits) of the members that may have a link to another component of their bucket.

    A unit that only one component's nodes have can't be common to such a pair. With v of a node's n units found in other
    components, the common part is at most the smaller v, so a similarity of s needs (1 + s) min(v, v') >= s (n + n'). This
    bounds the sizes n' of a partner by ``low`` and ``high``; a node is out if its bucket has no member of such a size.
    """
    parts = read.join(open_.select("node", "component").distinct(), "node").select("node", "component", F.explode("units").alias("unit"))
    across = parts.groupBy("unit").agg(F.min("component").alias("lowest"), F.max("component").alias("highest")).filter("lowest < highest").select("unit")
    common = parts.select("node", "unit").join(across, "unit").groupBy("node").agg(F.count_distinct("unit").alias("v"))
    most = F.col("v") * ((1 + similarity) / similarity) - F.col("n")
    low, high = F.ceil(F.col("n") * similarity - 1e-9), F.floor(F.least(F.col("n") / similarity, most) + 1e-9)
    sized = open_.join(common, "node").withColumn("low", low).withColumn("high", high).filter("low <= high")
    ready = cut_lineage(sized.select("key", "node", "n", "met", "low", "high"))
    sizes = ready.groupBy("key").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = spread_join(ready, sizes, "key", "node", hot).filter("high >= least_n AND low <= most_n")
    # All maps of a bucket get the size of its smallest member's.
    words = F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2("least_n") - 1e-9)) / 32).cast("int")
    folded = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.aggregate(F.sequence(i, F.size("bits") - 1, F.col("words")), F.lit(0).cast("long"), lambda x, at: x.bitwiseXOR(F.get("bits", at))))
    return cut_lineage(met.join(read.select("node", "bits"), "node").withColumn("words", words).select("key", "node", "n", "met", "low", "high", folded.alias("bits")))


def may_link(x: str, y: str, similarity: float) -> Column:
    """Whether sizes and bit maps of two members allow the similarity; a necessary condition."""
    of = lambda side, name: F.col(f"{side}.{name}")
    sizes = of(y, "n").between(of(x, "low"), of(x, "high")) & of(x, "n").between(of(y, "low"), of(y, "high"))
    differing = F.aggregate(F.zip_with(of(x, "bits"), of(y, "bits"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    return (of(x, "component") != of(y, "component")) & sizes & (differing <= (1 - similarity) / (1 + similarity) * (of(x, "n") + of(y, "n")) + 1e-9)


def leader_pairs(split: DataFrame, similarity: float, hot: list) -> DataFrame:
    """Possible pairs (a, b) of a bucket's next leader, the best met member outside its largest component, and the others."""
    whole = F.struct("met", "node", "n", "low", "high", "component", "bits")
    leaders = split.filter("component != largest").groupBy("key").agg(F.max(whole).alias("l"))
    met = spread_join(split.select("key", "node", F.struct("n", "low", "high", "component", "bits").alias("m")), leaders, "key", "node", hot)
    return met.filter(may_link("l", "m", similarity)).select(F.least("l.node", "node").alias("a"), F.greatest("l.node", "node").alias("b")).distinct()


def outside_pairs(split: DataFrame, similarity: float, block: int = 512) -> DataFrame:
    """Possible pairs (a, b) of members outside a bucket's largest component with members of its other components.

    A bucket's outside members are cut by hash into blocks, and all its members are sent to each: a task's group is one block
    however large the bucket is.
    """
    sized = split.withColumn("blocks", F.ceil(F.col("outside") / block).cast("int"))
    x = sized.filter("component != largest").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).alias("x")
    y = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & once & may_link("x", "y", similarity))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def further_links(buckets: DataFrame, found: DataFrame, docs: DataFrame, named, similarity: float, hot: list) -> DataFrame:
    """``found`` after the links across components of a bucket, from (key, node, n, met) rows of buckets of three members or more.

    All that is left meets at once if that is at most ``EACH`` comparisons and one possible pair for each row. Otherwise rounds of further
    leaders come first, as long as one links at least one in a hundred of the nodes outside.
    """
    open_ = cut_lineage(split_buckets(buckets, found, hot))
    if open_.isEmpty():
        return found
    read = node_units(named(open_.select("node").distinct()), docs)
    members = possible_members(open_, read, similarity, hot)
    while True:
        split = cut_lineage(split_buckets(members, found, hot))
        rows, compared, outside = split.agg(F.count(F.lit(1)), F.sum("outside"), F.approx_count_distinct(F.expr("CASE WHEN component != largest THEN node END"))).first()
        if not rows:
            return found
        if compared <= EACH * rows:
            pairs = cut_lineage(outside_pairs(split, similarity))
            if pairs.count() <= rows:
                return merged(found, similar_pairs(pairs, read, similarity))
        links = cut_lineage(similar_pairs(leader_pairs(split, similarity, hot), read, similarity))
        linked = links.count()
        found = merged(found, links) if linked else found
        if linked * 100 < outside:
            break
    split = split_buckets(members, found, hot) if linked else split
    links = similar_pairs(outside_pairs(cut_lineage(split) if linked else split, similarity), read, similarity)
    return merged(found, links)


def classes(docs: DataFrame, similarity: float = SIMILARITY, band_count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, row, class_id, class_size, kept) for every row of ``docs``."""
    made = sketches(docs, band_count, rows)
    first = cut_lineage(made.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("rows")))
    membership = cut_lineage(spread_join(made.select("doc_id", "row", "digest"), first.select("digest", "node"), "digest", "row", hot_keys(first, "digest", "rows"), "left").withColumn("node", F.coalesce("node", "row")))
    nodes = sized_join(made.filter("digest IS NOT NULL"), membership.filter("row != node").select("row"), "row", "left_anti").withColumnRenamed("row", "node")
    fits = lambda x, y: (F.least(x, y) >= similarity * F.greatest(x, y))  # noqa: E731  sizes that allow the similarity
    named = lambda ids: cut_lineage(nodes.select("node", "doc_id", "digest").join(ids, "node", "left_semi"))

    exploded = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = cut_lineage(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    hot = hot_keys(shared, "key", "members")
    placed = cut_lineage(spread_join(exploded, shared, "key", "node", hot))
    # The leader is the member that meets most others in all its buckets: of edited copies, one close to what was edited.
    popular = placed.groupBy("node").agg(F.sum("members").alias("met"))
    ranked = cut_lineage(placed.join(popular, "node"))
    leaders = ranked.groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("leader"))
    pairs = spread_join(ranked, leaders, "key", "node", hot).filter((F.col("node") != F.col("leader.node")) & fits(F.col("n"), F.col("leader.n")))
    pairs = cut_lineage(pairs.select(F.least("leader.node", "node").alias("a"), F.greatest("leader.node", "node").alias("b")).distinct())
    read = node_units(named(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), docs)
    found = components(similar_pairs(pairs, read, similarity))
    found = further_links(ranked.filter("members > 2").drop("members"), found, docs, named, similarity, hot)

    linked = cut_lineage(membership.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))  # read twice
    sizes = cut_lineage(linked.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size")))
    return spread_join(linked, sizes, "component", "row", hot_keys(sizes, "component", "class_size")).select("doc_id", "digest", "row", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class."""
    verdict = cut_lineage(classes(docs, similarity).select("doc_id", "digest", "kept"))
    return drop_losers(docs, digest(word_list(F.col("text"))), verdict)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
