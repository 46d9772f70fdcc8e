"""Joining images and reports, with orphan diagnostics, label matrices and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import binarise

JOIN_ALARM = 0.95


def filter_views(df: DataFrame, view: str, allowed: Sequence[str]) -> DataFrame:
    """Rows of the allowed views, in any case; an empty list keeps all."""
    return df.where(F.upper(F.coalesce(F.col(view).cast("string"), F.lit(""))).isin([a.upper() for a in allowed])) if allowed else df


def fuse(images: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """One row an image that has a report; aggregates of the report's lists if it has them."""
    r = reports
    if "recommendations" in r.columns:
        r = r.withColumn("n_recommendations", F.size(F.coalesce("recommendations", F.array().cast("array<string>"))))
    if "measurements" in r.columns:
        r = r.withColumn("max_measurement", F.array_max("measurements"))
    return images.join(r, key)


def join_stats(images: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """One row: n_images, n_reports, n_joined, n_orphan_images, n_orphan_reports (distinct keys), join_rate, low.

    Both sides are reduced to counts by key first, so one small full join gives everything.
    """
    a = images.groupBy(key).agg(F.count("*").alias("na"))
    b = reports.groupBy(key).agg(F.count("*").alias("nb"))
    j = a.join(b, key, "full_outer").agg(F.coalesce(F.sum("na"), F.lit(0)).alias("n_images"), F.coalesce(F.sum("nb"), F.lit(0)).alias("n_reports"), F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("n_joined"), F.count_if(F.col("nb").isNull()).alias("n_orphan_images"), F.count_if(F.col("na").isNull()).alias("n_orphan_reports"))
    rate = F.when(F.col("n_images") == 0, 0.0).otherwise(F.col("n_joined") / F.col("n_images"))
    return j.withColumn("join_rate", F.round(rate, 4)).withColumn("low", rate < JOIN_ALARM)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def binarise_labels(df: DataFrame, columns: Sequence[str], policy: str = "zeros") -> DataFrame:
    return df.withColumns({c: binarise(F.col(c), policy) for c in columns})


def prevalence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """finding, positive, negative, uncertain, not_mentioned, prevalence of each label column, in one pass."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.count_if(F.col(c) == v).alias(f"{c}|{k}") for k, v in (("p", 1), ("n", 0), ("u", -1))] + [F.count_if(F.col(c).isNull()).alias(f"{c}|x")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("finding"), *(F.col(f"`{c}|{k}`").alias(a) for k, a in (("p", "positive"), ("n", "negative"), ("u", "uncertain"), ("x", "not_mentioned"))), F.col("n").alias("n")) for c in columns]
    e = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return e.withColumn("prevalence", F.round(F.when(F.col("n") > 0, F.col("positive") / F.col("n")).otherwise(0.0), 4)).drop("n")


def timeline(df: DataFrame, subject: str, study: str, columns: Sequence[str] = ()) -> DataFrame:
    """study_order (from 1, by study) and n_studies (rows) of every row of a subject."""
    w = Window.partitionBy(subject)
    return df.select(subject, study, F.row_number().over(w.orderBy(study)).cast("long").alias("study_order"), F.count(study).over(w).alias("n_studies"), *columns)


def structured_columns(df: DataFrame, base: Sequence[str], prefixes: Sequence[str] = ("label_", "severity_")) -> DataFrame:
    return df.select([c for c in df.columns if c in base or c.startswith(tuple(prefixes))])
