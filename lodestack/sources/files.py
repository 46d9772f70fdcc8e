"""Listings of files as DataFrames, with or without content: trees below a plain path by tasks that walk and read
them, other file systems by Spark's binaryFile source."""

from __future__ import annotations

import fnmatch
import logging
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: Directories or files that a task walks, tasks a core at least, and bytes of content in a batch, but for a larger file.
UNITS_A_TASK, TASKS_A_CORE, BATCH_BYTES, BATCH_FILES = 4000, 4, 16 << 20, 500


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """One row a file below ``root`` that matches a pattern: path, modificationTime, length, content. As with Spark's
    sources, empty files and those whose name starts with a dot or an underline have none.

    A missing root gives an empty table and a warning. Where content isn't needed, or of some files only, ``listing`` and
    ``with_content`` read less.
    """
    if "://" in root:
        return _binary(spark, root, patterns)
    return with_content(listing(spark, root, patterns))


def listing(spark: SparkSession, root: str, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """scan without content.

    Below a plain path the driver lists only as many levels as give each task directories of its own. Spark's source
    lists all files on the driver, up to 10 000 tasks in between, and makes a task of 32 small files.
    """
    if "://" in root:
        return _binary(spark, root, patterns).drop("content")
    if not os.path.isdir(root):
        log.warning("no such directory: %s", root)
        return spark.createDataFrame([], SCHEMA).drop("content")
    patterns, cores = tuple(patterns), spark.sparkContext.defaultParallelism
    dirs, found = [os.path.abspath(root)], []
    while dirs and len(dirs) < 4 * TASKS_A_CORE * cores:
        below: list[str] = []
        for d in dirs:
            _entries(d, patterns, below, found)
        dirs = below
    units = dirs + found
    n = max(1, min(len(units), max(TASKS_A_CORE * cores, len(units) // UNITS_A_TASK)))
    k = max(1, min(64, len(units) // (8 * n)))
    chunks = pa.table({"units": pa.array([units[i : i + k] for i in range(0, len(units), k)], pa.list_(pa.string()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_pylist():
                rows, left = [], chunk
                while left:
                    nxt: list[str] = []
                    for at in left:
                        own: list[str] = []
                        try:
                            _entries(at, patterns, nxt, own)
                        except NotADirectoryError:
                            own = [at]
                        except FileNotFoundError:  # deleted since
                            continue
                        for f in own:
                            try:
                                st = os.stat(f)
                            except FileNotFoundError:  # deleted since, or a link to nothing
                                continue
                            if st.st_size:
                                rows.append((f"file:{f}", st.st_mtime_ns // 1_000_000, st.st_size))
                    left = nxt
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "ms", "length"])

    d = spark.createDataFrame(chunks).repartition(n).mapInArrow(run, "path string, ms long, length long")
    return d.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")


def with_content(listed: DataFrame, path: str = "path", missing: str = "raise") -> DataFrame:
    """Rows with a path of a plain file system, and its content; ``missing="drop"`` leaves out those that aren't there.

    A batch holds BATCH_BYTES of content, or one larger file.
    """
    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])
    drop = missing == "drop"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, content, size = [], [], 0
            for i, p in enumerate(b.column(b.schema.get_field_index(path)).to_pylist()):
                try:
                    with open("/" + p[5:].lstrip("/") if p.startswith("file:/") else p, "rb") as f:
                        raw = f.read()
                except FileNotFoundError:
                    if drop:
                        continue
                    raise
                if at and (size + len(raw) > BATCH_BYTES or len(at) >= BATCH_FILES):
                    yield _joined(b, at, content)
                    at, content, size = [], [], 0
                at.append(i)
                content.append(raw)
                size += len(raw)
            if at:
                yield _joined(b, at, content)

    return listed.mapInArrow(run, schema)


def read_below(spark: SparkSession, records: DataFrame, root: str, rel: str, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """records with the content of the file at the path ``rel`` below ``root``; those without such a file are left out.

    Below a plain path each file is opened by name, without another walk of the tree. records are counted first, so that
    tasks are as many as they need.
    """
    if "://" in root:
        lead = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
        f = scan(spark, root, patterns).select(F.substr(clean_path(F.col("path")), F.lit(len(lead) + 1)).alias(rel), "content")
        return records.join(f, rel)
    rows = records.count()
    n = max(1, min(rows, max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, rows // UNITS_A_TASK)))
    at = records.withColumn("__at", F.concat(F.lit(os.path.abspath(root).rstrip("/") + "/"), rel)).repartition(n)
    return with_content(at, "__at", "drop").drop("__at")


def _joined(b: pa.RecordBatch, rows: list[int], content: list[bytes]) -> pa.RecordBatch:
    own = b.take(pa.array(rows, pa.int32()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(content, pa.binary())], [*own.schema.names, "content"])


def _entries(d: str, patterns: tuple[str, ...], dirs: list[str], found: list[str]) -> None:
    """Add the directories and the matching files in d, without those that Spark's sources hide."""
    with os.scandir(d) as entries:
        for e in entries:
            n = e.name
            if (n[0] == "." or n[0] == "_" and "=" not in n or n.endswith("._COPYING_")) and not (n.startswith(("_metadata", "_common_metadata")) and e.is_dir()):
                continue
            if e.is_dir():
                dirs.append(e.path)
            elif any(fnmatch.fnmatchcase(n, p) for p in patterns):
                found.append(e.path)


def _binary(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    glob = "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def clean_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def part(path: Column, n: int) -> Column:
    """The n-th last part of a path, from 1."""
    return F.try_element_at(F.split(path, "/"), F.lit(-n))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """(study_id, text) of the .txt files below ``root``; the id is the file's name without its ending."""
    f = scan(spark, root, ("*.txt",))
    return f.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("study_id"), _lenient(F.col("content")).alias("text"))


def _lenient(content: Column) -> Column:
    """UTF-8 with replacement characters for what isn't."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


def resolve(records: DataFrame, raw: DataFrame, processed: DataFrame | None = None, path: str = "filepath") -> DataFrame:
    """records with file_exists, file_size_bytes and resolved_root: a listing of raw wins over processed.

    Listings have (path, length) relative to their roots.
    """
    r = raw.select(F.col("path").alias("__p"), F.col("length").alias("__raw"))
    d = records.join(r, F.col(path) == F.col("__p"), "left").drop("__p")
    if processed is not None:
        p = processed.select(F.col("path").alias("__p"), F.col("length").alias("__done"))
        d = d.join(p, F.col(path) == F.col("__p"), "left").drop("__p")
    else:
        d = d.withColumn("__done", F.lit(None).cast("long"))
    size = F.coalesce("__raw", "__done")
    return d.withColumns({"file_exists": size.isNotNull(), "file_size_bytes": size, "resolved_root": F.when(F.col("__raw").isNotNull(), "raw").when(F.col("__done").isNotNull(), "processed").otherwise("raw")}).drop("__raw", "__done")
