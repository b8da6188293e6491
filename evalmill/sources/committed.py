"""SNK-01/05/07: outputs that appear whole or not at all, as a Python data source with commit and abort.

A task writes its rows to files of its own name below ``data`` and reports their names, rows and digests. Nothing reads them
there: readers go by ``_manifest.json`` alone. When all tasks are done, the commit adds up the rows, holds them against the number
of input rows that was asked for, and publishes by putting one new manifest in the place of the old one; files of a
failed task, of an attempt that ran twice, or of a refused commit are in no manifest, and an abort deletes what was reported.
Files go through pyarrow's file systems, so tasks and the commit need no mounted folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from evalmill.operators.order import cut_lineage
from evalmill.operators.stats import inventory_digest

MANIFEST = "_manifest.json"


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


def read_manifest(root: str) -> dict:
    """What is published at ``root``; no files where nothing is."""
    fs, path = file_system(root)
    if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"rows": 0, "commits": 0, "files": []}
    with fs.open_input_stream(f"{path}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class CommittedWriter(DataSourceArrowWriter):
    """``expected``: rows that a commit must have; ``partition``: a column whose values get folders; ``append``: whether rows may be there."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.expected = options["path"], options.get("expected")
        self.partition, self.append = options.get("partition"), options.get("append") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.root)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        open_: dict[str, tuple] = {}
        rows: dict[str, int] = {}
        try:
            for batch in iterator:
                groups = {"": batch}
                if self.partition:
                    values = batch.column(batch.schema.get_field_index(self.partition)).cast(pa.string())
                    groups = {f"{self.partition}={v}/": batch.filter(pc.equal(values, v)) for v in values.unique().to_pylist()}
                for folder, part in groups.items():
                    if folder not in open_:
                        fs.create_dir(f"{path}/data/{folder}", recursive=True)
                        open_[folder] = pq.ParquetWriter(f"{path}/data/{folder}{name}", part.schema, filesystem=fs)
                    open_[folder].write_batch(part)
                    rows[folder] = rows.get(folder, 0) + part.num_rows
        except BaseException:
            for folder, writer in open_.items():
                writer.close()
                fs.delete_file(f"{path}/data/{folder}{name}")
            raise
        files = []
        for folder, writer in open_.items():
            writer.close()
            digest = hashlib.sha256()
            with fs.open_input_stream(f"{path}/data/{folder}{name}") as file:
                while block := file.read(1 << 20):
                    digest.update(block)
            files.append({"name": f"data/{folder}{name}", "rows": rows[folder], "sha256": digest.hexdigest()})
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        rows, before = sum(f["rows"] for f in files), read_manifest(self.root)
        why = None
        if self.expected is not None and rows != int(self.expected):
            why = f"{rows} rows were written, {self.expected} were expected; nothing is published"
        elif before["commits"] and not self.append:
            why = f"{self.root} is published; nothing is overwritten"
        if why:
            self.abort(messages)
            raise ValueError(why)
        fs, path = file_system(self.root)
        fs.create_dir(path, recursive=True)
        made = {"rows": before["rows"] + rows, "commits": before["commits"] + 1, "files": sorted(before["files"] + files, key=lambda f: f["name"])}
        part = f"{path}/.{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as file:
            file.write(json.dumps(made, indent=1).encode())
        fs.move(part, f"{path}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.root)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{path}/{f['name']}")


class CommittedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evalmill_committed"

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options, schema)


def write_committed(rows: DataFrame, root: str, expected: int | None = None, partition: str | None = None, append: bool = False) -> None:
    """Publish ``rows`` at ``root`` in one commit."""
    rows.sparkSession.dataSource.register(CommittedSource)
    options = {"path": root, "append": str(append).lower()} | ({"expected": str(expected)} if expected is not None else {}) | ({"partition": partition} if partition else {})
    rows.write.format(CommittedSource.name()).options(**options).mode("append").save()


def read_committed(spark: SparkSession, root: str) -> DataFrame:
    """The published rows and no others."""
    files = [f"{root}/{f['name']}" for f in read_manifest(root)["files"]]
    if not files:
        raise ValueError(f"nothing is published at {root}")
    return spark.read.parquet(*files)


def write_predictions(scores: DataFrame, inputs: DataFrame, root: str, path: str, score: Column) -> None:
    """SNK-01: {image_path, pred} for every input, once: a missing, second or foreign prediction publishes nothing."""
    made = scores.select(F.col(path).alias("image_path"), score.alias("pred"))
    wanted = inputs.select(F.col(path).alias("image_path"))
    odd = wanted.withColumn("side", F.lit(0)).unionByName(made.select("image_path", F.lit(1).alias("side"))).groupBy("image_path").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m")).filter("n <> 1 OR m <> 1")
    if first := odd.first():
        raise ValueError(f"{first['image_path']} has {first['n']} inputs and {first['m']} predictions")
    write_committed(made, root, expected=inputs.count())


def write_contents(rows: DataFrame, root: str, digest: str, path: str, size: str) -> DataFrame:
    """SNK-05/07: every content once at ``root``, by the first two digits of its digest; what is there already is compared, not
    written again. Returns (digest, status) with status new or known; contents of unequal size raise."""
    spark = rows.sparkSession
    ending = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    one = rows.groupBy(F.col(digest).alias("sha256")).agg(F.min(size).alias("bytes"), F.max(size).alias("most"), F.min_by(ending, path).alias("ending"), F.count(F.lit(1)).alias("n_paths"))
    one = cut_lineage(one.withColumn("prefix", F.substring("sha256", 1, 2)).withColumn("archive_path", F.concat(F.lit("images/"), "prefix", F.lit("/"), "sha256", "ending")))
    known = read_committed(spark, root).select("sha256", F.col("bytes").alias("known")) if read_manifest(root)["commits"] else one.limit(0).select("sha256", F.col("bytes").alias("known"))
    met = cut_lineage(one.join(known, "sha256", "left"))
    if bad := met.filter("bytes <> most OR bytes <> known").first():
        raise ValueError(f"content {bad['sha256']} has more than one size")
    fresh = met.filter("known IS NULL").select("sha256", "bytes", "archive_path", "n_paths", "prefix")
    write_committed(fresh.repartition("prefix"), root, expected=fresh.count(), partition="prefix", append=True)
    return met.select("sha256", F.when(F.col("known").isNull(), "new").otherwise("known").alias("status"))


def packaged_names(manifests: list[str]) -> dict[str, str]:
    """Manifest path -> its name in a package: the file's name, with the folder's before it where the name is taken."""
    found, used = {}, set()
    for path in manifests:
        folder, _, name = path.rpartition("/")
        name = f"{folder.rpartition('/')[2]}-{name}" if name in used else name
        if name in used:
            raise ValueError(f"no free name for manifest {path}")
        used.add(name)
        found[path] = name
    return found


def write_package(manifests: dict[str, DataFrame], root: str, digest: str, path: str, size: str) -> DataFrame:
    """SNK-05: contents once below root/contents, manifests with archive paths below root/manifests/name.

    Returns (source_manifest, packaged_manifest, n_lines, digest) for each manifest, the digest over its rewritten lines.
    """
    names = packaged_names(list(manifests))
    tagged = [m.withColumn("__manifest", F.lit(n)) for n, m in manifests.items()]
    everything = tagged[0]
    for t in tagged[1:]:
        everything = everything.unionByName(t, allowMissingColumns=True)
    write_contents(everything, f"{root}/contents", digest, path, size)
    contents = read_committed(everything.sparkSession, f"{root}/contents").select(F.col("sha256").alias("__d"), "archive_path")
    reports = None
    for source, rows in manifests.items():
        others = sorted(c for c in rows.columns if c not in (path, digest))
        rewritten = rows.join(contents, F.col(digest) == F.col("__d")).select(*others, F.concat(F.lit("../"), "archive_path").alias("path"), F.col(digest).alias("image_sha256"))
        write_committed(rewritten, f"{root}/manifests/{names[source]}", expected=rows.count())
        back = read_committed(rows.sparkSession, f"{root}/manifests/{names[source]}")
        report = inventory_digest(back, F.to_json(F.struct(*sorted(back.columns)))).select(F.lit(source).alias("source_manifest"), F.lit(names[source]).alias("packaged_manifest"), "n_lines", "digest")
        reports = report if reports is None else reports.unionByName(report)
    return reports
