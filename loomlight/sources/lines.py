"""Lines of files of any size: numbered over byte splits, so that several tasks read one file.

A scan cuts a file to blocks, each read by one task in order. Counting lines and bytes by block
and adding them up over the blocks before gives every line its physical number and byte
offset, whatever the cuts; a line that crosses a cut belongs to the block in which it begins.
Only the table of blocks is shuffled; it is broadcast to the lines while it is small (a row for each block). Lines end at a line feed; a
carriage return before it is a part of the raw line and not of its text.

Both passes must see the same blocks. If a file is appended to or cut otherwise in between, the lines
fail with an error instead of getting wrong numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import small, written

_RAW = "file string, block long, length long, size long, at long, start long, raw binary"
#: Endings of files whose sizes say nothing of their text.
_PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
BOM_BYTES = 3


def _scanned(spark: SparkSession, path: str | list[str]) -> DataFrame:
    of = lambda name: F.col(f"_metadata.{name}")
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return text.select(of("file_path").alias("file"), of("file_block_start").alias("block"), of("file_block_length").alias("length"), of("file_size").alias("size"), F.col("value").cast("binary").alias("raw"))


def _placed(scanned: DataFrame) -> DataFrame:
    """at (lines) and start (bytes) of each line in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, start = None, 0, 0
        for batch in batches:
            places, starts = [], []
            sizes = pc.binary_length(batch.column("raw")).to_pylist()
            for file, block, size in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), sizes, strict=True):
                if (file, block) != now:
                    now, at, start = (file, block), 0, 0
                places.append(at)
                starts.append(start)
                at, start = at + 1, start + size + 1
            columns = [batch.column(c) for c in ("file", "block", "length", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), pa.array(starts, pa.int64()), batch.column("raw")], names=[c.split()[0] for c in _RAW.split(", ")])

    return scanned.mapInArrow(run, _RAW)


def _blocks(scanned: DataFrame) -> DataFrame:
    """Lines and bytes before each block of a file, and whether the file begins with a byte order mark and ends with a line feed."""
    own = scanned.groupBy("file", "block", "length", "size").agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw") + F.lit(1)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # what the file holds besides the lines and a line feed after each
    rest = F.col("size") - F.sum("bytes").over(whole)
    plain = ~F.col("file").rlike(_PACKED)
    rows = own.select("file", "block", "length", "lines", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.sum("lines").over(whole).alias("file_lines"), rest.alias("rest"), plain.alias("plain"))
    mark = F.when(F.col("plain") & (F.col("rest") >= BOM_BYTES - 1), BOM_BYTES).otherwise(0)
    return rows.select("file", "block", "length", "lines_before", (F.col("bytes_before") + mark).alias("bytes_before"), "file_lines", (F.col("plain") & F.col("rest").isin(-1, BOM_BYTES - 1)).alias("open_end"))


def physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1), byte_offset, raw, terminated (false for a last line without a line feed) of every line, blank ones too."""
    scanned = _scanned(spark, path)
    joined = _placed(scanned).join(small(written(_blocks(scanned))), ["file", "block", "length"], "left")
    same = F.when(F.col("lines_before").isNull(), F.raise_error(F.concat(F.lit("blocks changed while lines were numbered: "), F.col("file"))).cast("long")).otherwise(F.col("lines_before"))
    line = (same + F.col("at") + 1).alias("line")
    return joined.select("file", line, (F.col("bytes_before") + F.col("start")).alias("byte_offset"), "raw", "file_lines", "open_end").select("file", "line", "byte_offset", "raw", (~(F.col("open_end") & (F.col("line") == F.col("file_lines")))).alias("terminated"))


def text_of(raw: Column) -> Column:
    """A line's text, without the carriage return at its end."""
    return F.regexp_replace(raw.cast("string"), "\r$", "")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line, value of every line that isn't blank; physical line numbers."""
    return physical_lines(spark, path).select("file", "line", text_of(F.col("raw")).alias("value")).filter(F.trim("value") != "")


_RECEIPT = "file string, line long, byte_offset long, byte_length long, sha256 string, reason string"


def corruption_receipts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line, byte_offset, byte_length, sha256, reason of every line that isn't UTF-8 or JSON; the content itself is never shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(x.split() for x in _RECEIPT.split(", ")), strict=True)
        for batch in batches:
            rows = []
            for file, line, offset, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "line", "byte_offset", "raw")), strict=True):
                own = raw.removesuffix(b"\r")
                if own.strip():
                    try:
                        json.loads(own.decode("utf-8"))
                    except ValueError as why:
                        rows.append((file, line, offset, len(own), hashlib.sha256(own).hexdigest(), "not UTF-8" if isinstance(why, UnicodeDecodeError) else "not JSON"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return physical_lines(spark, path).select("file", "line", "byte_offset", "raw").mapInArrow(run, _RECEIPT)


def json_lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """file, line, v (variant) of every line that isn't blank and is JSON; strict: any other line is an error that names file and line."""
    rows = numbered_lines(spark, path).select("file", "line", F.try_parse_json("value").alias("v"))
    if not strict:
        return rows.filter("v is not null")
    refused = F.raise_error(F.concat(F.lit("malformed JSON: "), F.col("file"), F.lit(":"), F.col("line").cast("string")))
    return rows.withColumn("v", F.when(F.col("v").isNull(), F.parse_json(refused.cast("string"))).otherwise(F.col("v")))


def first_json(spark: SparkSession, path: str, n: int) -> DataFrame:
    """value of the first n lines of one file that are JSON. Spark reads the first block, and more only while lines are missing."""
    text = spark.read.option("lineSep", "\n").text(path).select(text_of(F.col("value")).alias("value"))
    return spark.createDataFrame(text.filter("try_parse_json(value) is not null and trim(value) <> ''").take(n), "value string")


def source_binding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, size and a digest of every line at its offset; two calls before and after a parse must agree.

    Digests of lines are added up, so the parts of a large file are read by several tasks.
    """
    rows = physical_lines(spark, path)
    digest = F.sha2(F.concat(F.col("byte_offset").cast("string").cast("binary"), F.lit(b":"), F.col("raw")), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    of = rows.groupBy("file").agg(F.count("*").cast("string").alias("n"), F.min("terminated").cast("string").alias("ended"), *(part(i).alias(f"d{i}") for i in range(4)))
    return of.select(F.col("file").alias("path"), F.sha2(F.concat_ws(":", "n", "ended", *(f"d{i}" for i in range(4))), 256).alias("sha256"))
