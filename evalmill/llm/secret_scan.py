"""Secret scans with an incremental blob ledger.

Each version of a document is addressed by the SHA-256 of its text. The ledger is a table (blob, rule_version, findings) that
grows by appending: a blob is scanned only if its pair with the current rule version isn't there, once however many paths hold
it, and findings are joined back to all paths of all versions. Changing a rule changes RULE_VERSION, which makes all pairs
unseen. ``scan_snapshot`` adds a snapshot of documents to a ledger and to the history (doc_id, version, blob) beside it.

Scanning is DataFrame functions: for each kind, the pieces that the pattern leaves and its matches give lengths; running sums
of these numbers give places in code points. Which rows are read for a scan is named by (doc_id, blob); beyond a size where that
list can be broadcast, texts are shuffled once to meet it. Rows of frequent blobs are settled before, so no task gets a hot one.

Cases: a null text is empty and has no findings; rows with the same doc_id are separate paths; matches that fail the length
of their kind are dropped after matching, so that what they cover isn't searched again; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.common import cut_lineage, hot_keys, let, shared_folder, sized_join, spread_join, table

#: Kind: pattern, group whose length counts, least length. The first three are the base; order is that of ties.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "stripe": (r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 50),
}
BASE = ("assign", "access", "hex")

RULE_VERSION = hashlib.sha256(repr(KINDS).encode()).hexdigest()[:16]

#: Cheap tests that a text with a finding of the kind passes.
GATES = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "github": "gh[pousr]_",
    "slack": "xox[abprs]-",
    "google": "AIza",
    "stripe": "[sr]k_(?:live|test)_",
    "jwt": r"[A-Za-z0-9_-]\.eyJ",
    "pem": "PRIVATE KEY-----",
}

FINDINGS = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"
#: Columns of a ledger, for the caller that keeps one as a table.
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"


def _cells(kind: str) -> Column:
    """(piece before, match, counted part) lengths of each match of one kind in ``text``."""
    pattern, group, _ = KINDS[kind]
    sizes = lambda n: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(n)), lambda x: F.length(x))
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
    cells = F.arrays_zip(gaps.alias("gap"), sizes(0).alias("size"), sizes(group).alias("counted"))
    return F.when(F.col("text").rlike(GATES[kind]), F.filter(cells, lambda c: c["size"].isNotNull()))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, findings): a row for each distinct text with findings, in order of start, then kind."""
    all_kinds = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.lit(kind).alias("kind"), F.lit(KINDS[kind][2]).alias("least"), _cells(kind).alias("cells")) for i, kind in enumerate(KINDS)])
    opened = blobs.select("blob", F.explode(all_kinds).alias("k")).select("blob", "k.kind_no", "k.kind", "k.least", F.posexplode("k.cells").alias("n", "c"))
    opened = opened.dropDuplicates(["blob", "kind_no", "n"])  # rows may be repeated whole
    upto = Window.partitionBy("blob", "kind_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("c.gap") + F.col("c.size")).over(upto)
    placed = opened.select("blob", "kind_no", "kind", "least", "c.counted", (end - F.col("c.size")).alias("start"), end.alias("end"))
    held = placed.filter("counted >= least").groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("findings"))
    return held


#: Rows of (doc_id, blob) that may be broadcast, about 100 bytes each; secrets whose places may be.
NAMED_ROWS, PLACES = 200_000, 400_000


def scan_new(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list]:
    """(paths, additions, hot): (doc_id, blob) of every row, the ledger's new rows for pairs that it hasn't, blobs of very many rows."""
    text = F.coalesce("text", F.lit(""))
    paths = cut_lineage(docs.select("doc_id", F.sha2(text, 256).alias("blob")))
    blobs = cut_lineage(paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    hot, first = hot_keys(blobs, "blob", "n"), blobs.select("blob", "doc_id")
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        first = first.join(seen, "blob", "left_anti")
    first = cut_lineage(first)
    texts = docs.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))
    if hot:  # at most 1,000 rows
        chosen = F.broadcast(first.filter(F.col("blob").isin(hot)).select(F.col("blob").alias("__hot"), F.col("doc_id").alias("__first")))
        texts = texts.join(chosen, F.col("blob") == F.col("__hot"), "left").filter(~F.col("blob").isin(hot) | (F.col("__hot").isNotNull() & F.col("doc_id").eqNullSafe(F.col("__first")))).drop("__hot", "__first")
    # Of what is to be scanned and what isn't, the shorter list names the rows.
    named = first.select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob"))
    meets = (F.col("blob") == F.col("__blob")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    if 2 * first.count() > paths.count():
        others = paths.alias("p").join(first.alias("f"), (F.col("p.blob") == F.col("f.blob")) & F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")), "left_anti")
        if hot:
            others = others.filter(~F.col("blob").isin(hot))
        skip = cut_lineage(others.distinct().select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob")))
        chosen_texts = sized_join(texts, skip, meets, "left_anti", limit=NAMED_ROWS)
    else:
        chosen_texts = sized_join(texts, named, meets, "left_semi", limit=NAMED_ROWS)
    found = cut_lineage(scan_blobs(chosen_texts.select("blob", "text")))
    additions = first.select("blob").join(found, "blob", "left").select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    return paths, additions, hot


def joined_back(paths: DataFrame, ledger: DataFrame, hot: list) -> DataFrame:
    """``paths`` with the findings of their blobs under the current rules, null where there are none."""
    known = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])
    return spread_join(paths, known, "blob", "doc_id", hot, "left")


def findings_by_path(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, blob, findings or null) for every row, additions to the ledger)."""
    paths, additions, hot = scan_new(docs, ledger)
    known = additions.unionByName(ledger) if ledger is not None else additions
    return joined_back(paths, known, hot), additions


def scan_snapshot(docs: DataFrame, folder: str, version: int) -> tuple[DataFrame, list]:
    """(paths of this snapshot, hot blobs) after the ledger and the history in ``folder`` have taken it in; what they know isn't scanned."""
    spark = docs.sparkSession
    paths, additions, hot = scan_new(docs, read_ledger(spark, folder) if version else None)
    additions.write.mode("append").parquet(f"{folder}/ledger")
    paths.select("doc_id", F.lit(version).alias("version"), "blob").write.mode("append").parquet(f"{folder}/history")
    return paths, hot


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` and n_chars made to fit; overlapping spans are one."""
    columns = docs.columns
    _, additions, hot = scan_new(docs)
    held = cut_lineage(additions.filter(F.size("findings") > 0).select(F.col("blob").alias("__sha"), F.col("findings").alias("__found")))
    tagged = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    few = (held.agg(F.sum(F.size("__found") + 2)).first()[0] or 0) <= PLACES
    joined = tagged.join(F.broadcast(held), "__sha", "left") if few else spread_join(tagged, held.hint("shuffle_hash"), "__sha", "doc_id", hot, "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pair = lambda s, e: F.struct(s.alias("start"), e.alias("end"))

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(pair(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > x["start"]), grown).otherwise(F.concat(done, F.array(pair(x["start"], x["end"]))))

    spans = F.aggregate("__found", empty, merge)
    begin = lambda s, i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0).cast("long"))
    piece = lambda s, i: F.substring(F.col("text"), (begin(s, i) + 1).cast("int"), (F.coalesce(F.get(s, i)["start"], F.length("text").cast("long")) - begin(s, i)).cast("int"))
    rebuilt = let(spans, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: piece(s, i)), mark))
    out = joined.withColumn("text", F.when(F.col("__found").isNotNull(), rebuilt).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots go into a fresh ledger: the documents of half of the sources, then all documents, of which it knows a part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    folder = f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    scan_snapshot(docs.filter(F.xxhash64("source") > 0), folder, 0)
    paths, hot = scan_snapshot(docs, folder, 1)
    found = joined_back(paths, read_ledger(spark, folder), hot)
    listed = lambda kinds: F.array_join(F.transform(F.filter("findings", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    clean = found.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))
    return clean.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(tuple(KINDS)).alias("spans"),
    )


def _sql() -> str:
    """The same in SQL: pieces and matches side by side, running sums of their lengths."""
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
SELECT row_no, {i} AS kind_no, '{kind}' AS kind, n, length(gaps[n]) AS gap, length(whole[n]) AS size, length(counted[n]) >= {least} AS good
FROM (SELECT row_no, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', 0) AS whole, regexp_extract_all(text, '{quoted}', {group}) AS counted FROM d
  WHERE regexp_matches(text, '{quoted}')), LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS n)""")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT row_no, kind_no, kind, good, sum(gap + size) OVER (PARTITION BY row_no, kind_no ORDER BY n) AS e, size FROM m),
s AS (SELECT row_no, kind_no, kind, CAST(e - size AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE good),
g AS (SELECT row_no, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, kind_no) FILTER (WHERE kind_no < 3) AS base,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, kind_no) AS spans FROM s GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_no)
"""


OP9_SQL = _sql()
