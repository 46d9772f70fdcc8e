"""Immutable releases: file entries, an order-free dataset hash, totals, verification and the index."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def file_entries(df: DataFrame, path: str, sha: str, size: str, owner: str, item: str) -> DataFrame:
    """path, sha256, size_bytes (0 for null), patient_id, modality of the rows that have a hash."""
    return df.where(F.col(sha).isNotNull() & (F.col(sha) != "")).select(F.col(path).cast("string").alias("path"), F.col(sha).alias("sha256"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size_bytes"), F.col(owner).cast("string").alias("patient_id"), F.col(item).cast("string").alias("modality"))


def dataset_hash(entries: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """One row: sha256 of the sorted lines "path:sha", joined by line ends.

    Lines are sorted by range over all tasks; one task then reads the ranges in order and hashes them as a stream, so the
    hash is that of the whole list while no task ever holds it.
    """
    def run(batches):
        h, first = hashlib.sha256(), True
        for b in batches:
            for x in b.column(0).to_pylist():
                h.update(("" if first else "\n").encode() + x.encode())
                first = False
        yield pa.record_batch([pa.array([h.hexdigest()])], names=["h"])

    lines = entries.select(F.concat_ws(":", path, sha).alias("line")).orderBy("line")
    return lines.coalesce(1).mapInArrow(run, "h string").agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("dataset_hash"))


def totals(df: DataFrame, sha: str, size: str, owner: str) -> DataFrame:
    has = F.col(sha).isNotNull() & (F.col(sha) != "")
    return df.agg(F.count_if(has).alias("n_files"), F.count_distinct(owner).alias("n_subjects"), F.coalesce(F.sum(F.when(has, F.col(size).cast("long"))), F.lit(0)).alias("total_bytes"))


def class_balance(df: DataFrame, labels: str) -> DataFrame:
    """(label, n) over an array column, labels as text."""
    return df.select(F.explode(labels).alias("l")).groupBy(F.col("l").cast("string").alias("label")).agg(F.count("*").alias("n"))


def modality_counts(df: DataFrame, item: str) -> DataFrame:
    return df.groupBy(F.col(item).cast("string").alias("modality")).agg(F.count("*").alias("n"))


def verify(entries: DataFrame, disk: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """(path, problem) of entries that are missing on disk or have another hash there."""
    d = disk.select(F.col(path).alias("path"), F.col(sha).alias("__sha"), F.lit(True).alias("__there"))
    j = entries.select(F.col(path).alias("path"), F.col(sha).alias("sha256")).join(d, "path", "left")
    problem = F.when(F.col("__there").isNull(), F.concat(F.lit("missing: "), F.col("path"))).when(~F.col("sha256").eqNullSafe(F.col("__sha")), F.concat(F.lit("hash mismatch: "), F.col("path"), F.lit(" (manifest "), F.substring("sha256", 1, 12), F.lit(", disk "), F.substring("__sha", 1, 12), F.lit(")")))
    return j.select("path", problem.alias("problem")).where("problem is not null")


def upsert_index(index: DataFrame, new: DataFrame, key: str = "version", order: str = "created_at") -> DataFrame:
    """The union with the last row of each key by ``order``; of equal ones the new."""
    u = index.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    cols = [F.col(c) for c in index.columns]
    g = u.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*cols), F.struct(F.col(order), F.col("__n"))).alias("r"))
    return g.select("r.*").orderBy(order, key)


def label_classes(columns: dict[int, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in columns.items())))


def fusion_records(df: DataFrame, findings: Sequence[str], subject: str = "subject_id", study: str = "study_id") -> DataFrame:
    """Rows of a fusion table as manifest records; label_classes holds the positions of the findings present."""
    return df.select(F.col(subject).cast("string").alias("patient_id"), F.col(study).cast("string").alias("study_uid"), label_classes({i: F.col(f"label_{f}") == 1 for i, f in enumerate(findings)}).alias("label_classes"))
