"""Best-fit packing: patterns of few pieces, repeat counts by non-negative least squares, best fit for the rest.

Documents become pieces of at most ``size`` tokens. Only the histogram of piece lengths (``size`` numbers, whatever the corpus)
goes to the driver. There, patterns are the ways to fill a sequence exactly with one to three lengths; how often each is
repeated is the non-negative least squares fit to the histogram, rounded down and cut to what is there. What remains is packed
by best fit, longest first, still on counts. The plan is a list of runs: the pieces of a length with ranks a to b lie at one
offset of the sequences s, s+1, ... Pieces get their rank within their length from counts by bucket and a window inside a
bucket, so a length that a third of all pieces have is no single task; then each looks up its run.

Cases: a null text is empty, its one piece holds the end token alone; only longer documents are cut, the first piece takes the
remainder; repeated rows and ids are packed as they are; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.common import cut_lineage, map_frames, table
from evalmill.llm.token_counts import ODD
from evalmill.llm.tokenizers_bpe import LONG_BLANKS, read_ranks

SIZE, END_ID = 1024, 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoders(json_path: str, ranks_path: str, pattern: str):
    """(fast, exact) encoders of one vocabulary for each Python worker; they agree but for ODD characters' classes and LONG_BLANKS, which fast refuses."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    specials = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=specials)
    return fast, exact


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every whole text; ids stay in the task that made them, only their checksum leaves it."""

    def run(batches):
        fast, exact = encoders(json_path, ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = exact.encode(text, add_special_tokens=False).ids if ODD.search(text) or LONG_BLANKS.search(text) else fast.encode(text, allowed_special="all")
                ids.append(end_id)
                ids = np.asarray(ids, dtype="<u4")
                ends = range((len(ids) - 1) % size + 1, len(ids) + 1, size)
                begin = 0
                for number, end in enumerate(ends):
                    rows.append((doc_id, number, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                    begin = end
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_frames(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, PIECES)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), longest first, that fill a sequence exactly, from the lengths that occur."""
    there = np.zeros(size + 1, dtype=bool)
    there[present] = True
    there[0] = True
    a, b = np.meshgrid(np.arange(1, size + 1), np.arange(0, size + 1), indexing="ij")
    c = size - a - b
    fits = (c >= 0) & (b <= a) & (c <= b)
    rows = np.stack([a[fits], b[fits], c[fits]], axis=1)
    return rows[there[rows].all(axis=1)]


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x with the least squared error between the lengths used, sum of x over patterns, and ``counts``.

    Accelerated projected gradient; the matrix has at most three entries in a column, so a round is a few sums over them.
    """
    size = len(counts) - 1
    use = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), size + 1)
    mask = np.ones(size + 1)
    mask[0] = 0
    degree = np.bincount(rows.ravel(), minlength=size + 1)[1:].max(initial=1)
    step = 1.0 / (3.0 * 3.0 * degree)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(rounds):
        gradient = ((use(y) - counts) * mask)[rows].sum(axis=1)
        new = np.maximum(0.0, y - step * gradient)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def plan(counts: np.ndarray, size: int = SIZE) -> pd.DataFrame:
    """Runs (length, rank, repeats, sequence, offset): pieces of ``length`` with ranks from ``rank`` on lie in as many sequences."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(size + 1, dtype=np.int64)
    runs: list[tuple] = []
    sequence = 0

    def place(lengths: tuple, repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            runs.append((length, used[length], repeats, sequence, offset))
            used[length] += repeats
            left[length] -= repeats
            offset += length
        sequence += repeats

    rows = patterns(np.flatnonzero(left), size)
    if len(rows):
        # Equal lengths in a pattern take different ranks: they are placed one after the other.
        x = fit(left.astype(float), rows)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths = tuple(int(v) for v in rows[k] if v)
            need = {v: lengths.count(v) for v in lengths}
            repeats = min(int(x[k]), *(int(left[v]) // n for v, n in need.items()))
            if repeats > 0:
                place(lengths, repeats)
    while left.any():
        # Best fit on counts: the longest piece left, filled with the longest that fit, repeated while all are there.
        room, lengths = size, []
        free = left.copy()
        while room > 0:
            fitting = np.flatnonzero(free[: room + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            if lengths and (pair := _pair(free, room)) and sum(pair) > best:
                best = max(pair)
            lengths.append(best)
            free[best] -= 1
            room -= best
        need = {v: lengths.count(v) for v in lengths}
        place(tuple(lengths), min(int(left[v]) // n for v, n in need.items()))
    return pd.DataFrame(runs, columns=["length", "rank", "repeats", "sequence", "offset"]).astype("int64")


def _pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths at hand with the largest sum that fits."""
    have = np.flatnonzero(free[: room + 1])
    if not len(have):
        return None
    partner = have[np.searchsorted(have, room - have, side="right") - 1]
    ok = (have + partner <= room) & (partner >= have[0]) & ((partner != have) | (free[have] > 1)) & (np.searchsorted(have, room - have, side="right") > 0)
    if not ok.any():
        return None
    k = np.argmax(np.where(ok, have + partner, -1))
    return int(have[k]), int(partner[k])


def pack(cut: DataFrame, size: int = SIZE, buckets: int | None = None) -> DataFrame:
    """``cut`` (checkpointed pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    buckets = buckets or max(8, cut.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = cut_lineage(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    runs = plan(counts, size)
    shared = spark.sparkContext.broadcast({int(k): v.to_numpy() for k, v in runs.sort_values(["length", "rank"]).groupby("length")[["rank", "sequence", "offset"]]})
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside).cast("long") - 1).join(bases, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("inside")).alias("rank"))

    def look_up(batches):
        found = shared.value
        for batch in batches:
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            ranks = batch["rank"].to_numpy()
            for length, at in batch.groupby("length").indices.items():
                mine = found[int(length)]
                k = np.searchsorted(mine[:, 0], ranks[at], side="right") - 1
                sequence[at], offset[at] = mine[k, 1] + ranks[at] - mine[k, 0], mine[k, 2]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return map_frames(ranked, look_up, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces of ``docs`` with their places, by the public 50k byte-level vocabulary."""
    import public_tokenizers as public

    cut = cut_lineage(pieces(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, size))
    return pack(cut, size)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
