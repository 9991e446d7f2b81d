"""Log files as rows: file (its whole path, so that files of one name stay apart), line_no, value, shard and node.

Plain and gzip files are read by the text source, zip files by unpacking their members on the executors.  A path
that doesn't exist is skipped and reported.  ``line_no`` grows along a file: it is made from the byte at
which a split begins and the place in the split, so it needs no shuffle; ``exact`` numbers, or a limit of lines
of each file, cost a window over each file.
"""

from __future__ import annotations

import gzip
import io
import sys
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import file_system, new_folder

#: Lines of so many characters or more are passed over and counted.
LONGEST = 1 << 20
GREP_PREFIX = r'^[^:{]*:(?=\{"t":)'
SHARD = r"shard-(\d+)-(\d+)"
ZIP_ROWS = 5000


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths, globs included, that exist and those that don't, on any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, missing = [], []
    for path in paths:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            found = p.getFileSystem(conf).globStatus(p)
            (there if found is not None and len(found) else missing).append(path)
        except Exception:  # py4j wraps whatever the file system throws; a bad path doesn't stop the rest
            missing.append(path)
    return there, missing


def strip_prefix(value: Column) -> Column:
    """Undo grep's ``file:`` prefix."""
    return F.regexp_replace(value, GREP_PREFIX, "")


def base_name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def with_shard(lines: DataFrame) -> DataFrame:
    """shard and node from the file's name, null without a match."""
    found = lambda k: F.regexp_extract(base_name(F.col("file")), SHARD, k)
    number = lambda k: F.when(found(k) != "", found(k))
    return lines.withColumn("shard", number(1)).withColumn("node", number(2))


def _zipped(spark: SparkSession, paths: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, numbers, values, n = [], [], [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.endswith("/"):
                            continue
                        file, n = f"{path}!{member}", 0
                        with archive.open(member) as raw:
                            stream = gzip.GzipFile(fileobj=raw) if member.endswith(".gz") else raw
                            for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None):
                                names.append(file)
                                numbers.append(n)
                                values.append(line.rstrip("\n"))
                                n += 1
                                if len(values) >= ZIP_ROWS:
                                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(numbers, pa.int64()), pa.array(values)], ["file", "line_no", "value"])
                                    names, numbers, values = [], [], []
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(numbers, pa.int64()), pa.array(values)], ["file", "line_no", "value"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "file string, line_no long, value string")


def read_lines(spark: SparkSession, paths: list[str], line_limit: int | None = None, exact: bool = False, rebalance: int | None = None) -> tuple[DataFrame, list[str]]:
    """Lines of all files, and the paths that were skipped.

    ``rebalance`` deals lines out to so many partitions, for a few large files that can't be split.
    """
    there, missing = existing(spark, paths)
    plain, zips = [p for p in there if not p.endswith(".zip")], [p for p in there if p.endswith(".zip")]
    lines = spark.createDataFrame([], "file string, line_no long, value string")
    if plain:
        # fewer rows than bytes fit between two splits of a file, so the sum grows along it
        at = F.col("_metadata.file_block_start") * 4 + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        text = spark.read.text(plain).select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), "value")
        lines = text if not zips else text.unionByName(_zipped(spark, zips))
    elif zips:
        lines = _zipped(spark, zips)
    if exact or line_limit is not None:
        lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long"))
    if line_limit is not None:
        lines = lines.filter(F.col("line_no") <= line_limit)
    if rebalance:
        lines = lines.repartition(rebalance)
    return with_shard(lines), missing


def read_stdin(spark: SparkSession, stream=None) -> tuple[DataFrame, list[str]]:
    """Standard input by way of a file in the shared folder, written piece by piece."""
    path = f"{new_folder(spark, 'input')}.log"
    system, where = file_system(spark, path)
    out = system.create(where)
    try:
        for piece in iter(lambda: (stream or sys.stdin).read(1 << 20), ""):
            out.write(bytearray(piece.encode()))
    finally:
        out.close()
    return read_lines(spark, [path])
