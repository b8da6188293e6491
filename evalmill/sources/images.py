"""Image headers, content checks and pixel kernels over binary files; Python gets single files' bytes, in Arrow batches."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _header(data: bytes) -> tuple:
    """(format, width, height, mode) from the first bytes; nulls if they aren't a known image."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) > 25:
        width, height, _, color = struct.unpack(">IIBB", data[16:26])
        return "PNG", width, height, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
                return "JPEG", width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts)
            at += 2 + size
        return "JPEG", None, None, None
    if data[:2] == b"BM" and len(data) > 26:
        return "BMP", *struct.unpack("<ii", data[18:26]), "RGB"
    return None, None, None, None


def file_metadata(spark: SparkSession, root: str) -> DataFrame:
    """SRC-19: path, bytes, format, width, height, mode of every file; only the first 64 KiB go to Python."""

    def parse(batches):
        for batch in batches:
            found = [_header(bytes(x)) for x in batch["head"]]
            out = pd.DataFrame(found, columns=["format", "width", "height", "mode"])
            out[["width", "height"]] = out[["width", "height"]].astype("Int32")
            out.insert(0, "path", batch["path"].to_numpy())
            out.insert(1, "bytes", batch["bytes"].to_numpy())
            yield out

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    heads = files.select("path", F.col("length").alias("bytes"), F.substring("content", 1, 65536).alias("head"))
    return heads.mapInPandas(parse, "path string, bytes long, format string, width int, height int, mode string")


def content_report(spark: SparkSession, root: str, pins: DataFrame) -> DataFrame:
    """CON-10/11: each pinned name with what is there: missing, other size, other digest, unexpected or ok."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    state = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found_bytes") != F.col("bytes"), "size").when(F.col("found_sha256") != F.col("sha256"), "digest").otherwise("ok")
    return pins.join(there, "name", "full").select("name", state.alias("state"))


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """Pixels of PNG, JPEG and BMP files by Spark's image source; invalid files have height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(root).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def write_png(rgb: bytes, width: int, height: int) -> bytes:
    """A small PNG from raw RGB bytes, for fixtures."""
    raw = b"".join(b"\x00" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_pictures(rows: DataFrame, root: str, kind: str, name: str, pixels: str, width: int, height: int) -> str:
    """One PNG for each row at root/kind/name.png, grey levels from the first pixels in [-1, 1]; each task writes its own rows.

    The Hadoop file system isn't open to Python tasks, so ``root`` must be a mounted folder that all executors share.
    """
    folder = "/" + root.removeprefix("file:").lstrip("/")
    if ":" in folder.split("/")[1]:
        raise ValueError(f"{root} is no mounted folder")

    def run(batches):
        for batch in batches:
            for a, b, values in zip(batch["__k"], batch["__n"], batch["__p"]):
                grey = np.clip(np.asarray(values, dtype=float)[: width * height] * 0.5 + 0.5, 0, 1)
                os.makedirs(f"{folder}/{a}", exist_ok=True)
                part = f"{folder}/{a}/.{b}-{uuid.uuid4().hex}"  # a task may run twice: whole files only
                with open(part, "wb") as file:
                    file.write(write_png(np.repeat((grey * 255).astype(np.uint8), 3).tobytes(), width, height))
                os.replace(part, f"{folder}/{a}/{b}.png")
            yield pd.DataFrame({"n": [len(batch)]})

    written = rows.select(F.col(kind).cast("string").alias("__k"), F.col(name).cast("string").alias("__n"), F.col(pixels).alias("__p")).mapInPandas(run, "n long")
    written.agg(F.sum("n")).first()
    return root
