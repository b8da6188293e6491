"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z. Each partition keeps a Misra-Gries summary of its digests; merged, the
summaries name at most ``counters`` candidates, among them every digest of more than 2 n / counters rows. Their true counts
and winners are then computed (map-side combined) and broadcast: rows of frequent digests are settled where they lie, and only
the rest, whose groups are small by that guarantee, is shuffled by digest.

Cases: a null text counts as empty; of equal texts the largest doc_id stays (null is smallest), of rows with the same doc_id
and text exactly one; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.common import ascii_lower, cut_lineage, drop_losers, table

#: Counters of a Misra-Gries summary; also the most rows that are broadcast (about 60 bytes each).
COUNTERS = 512


def text_digest() -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): ``row`` tells apart rows that are otherwise equal; fixed, because it is read from the checkpoint."""
    return cut_lineage(docs.select("doc_id", text_digest().alias("digest"), F.monotonically_increasing_id().alias("row")))


def _shrink(counts: pd.Series, counters: int) -> pd.Series:
    """The Misra-Gries step: with too many counters, take the first surplus one's count off all of them."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts - counts.iloc[counters]
    return counts[counts > 0]


def frequent(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` candidate digests; a digest of over 2 n / counters rows is always among them."""

    def summary(batches):
        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = _shrink(kept.add(batch["digest"].map(bytes).value_counts(), fill_value=0).astype("int64"), counters)
        yield pd.DataFrame({"digest": list(kept.index), "n": kept.to_numpy()})

    partial = hashed.select("digest").mapInPandas(summary, "digest binary, n long")
    return partial.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def assign(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, row, keep_id, group_size, kept) for every row."""
    last = F.max(F.struct("doc_id", "row"))
    candidates = cut_lineage(frequent(hashed, counters))
    winners = cut_lineage(hashed.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size")))
    marked = hashed.join(F.broadcast(winners), "digest", "left")
    cold = Window.partitionBy("digest")
    rest = marked.filter("last IS NULL").select("doc_id", "digest", "row", last.over(cold).alias("last"), F.count(F.lit(1)).over(cold).alias("group_size"))
    both = marked.filter("last IS NOT NULL").select("doc_id", "digest", "row", "last", "group_size").unionByName(rest)
    return both.select("doc_id", "digest", "row", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps."""
    verdict = cut_lineage(assign(digests(docs)).select("doc_id", "digest", "kept"))
    return drop_losers(docs, text_digest(), verdict)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(digests(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
