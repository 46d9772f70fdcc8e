"""Grouped and stratified splits without leakage.

Subjects are ordered by a seeded md5, which any engine can repeat, and cut by position. Positions within a stratum come
from hash buckets and prefix sums of their counts, so that a stratum can be larger than a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "val", "test")
TRAIN, VAL, SEED = 0.7, 0.15, 42


class LeakageError(RuntimeError):
    pass


def allocate_stratified(n: Column, train: float = TRAIN, val: float = VAL) -> tuple[Column, Column]:
    """Sizes of train and val: halves to even; from three on, each of the three gets one at least."""
    t, v = F.bround(n * F.lit(train)).cast("long"), F.bround(n * F.lit(val)).cast("long")
    t3 = F.greatest(F.lit(1).cast("long"), F.least(t, n - 2))
    v3 = F.greatest(F.lit(1).cast("long"), F.least(v, n - t3 - 1))
    return F.when(n >= 3, t3).otherwise(t), F.when(n >= 3, v3).otherwise(v)


def allocate_grouped(n: Column, train: float = TRAIN, val: float = VAL) -> tuple[Column, Column]:
    """The simpler rule: fewer than three all go to train; val isn't capped."""
    t, v = F.greatest(F.lit(1).cast("long"), F.bround(n * F.lit(train)).cast("long")), F.greatest(F.lit(1).cast("long"), F.bround(n * F.lit(val)).cast("long"))
    return F.when(n >= 3, F.least(t, n - 2)).otherwise(n), F.when(n >= 3, v).otherwise(F.lit(0).cast("long"))


def _positioned(subjects: DataFrame, subject: str, stratum: Column, seed: int) -> DataFrame:
    """subjects with __s, __n (size of the stratum) and __pos (from 0, by md5 then subject)."""
    d = subjects.withColumn("__s", stratum).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(subject).cast("string")))).withColumn("__b", F.substring("__h", 1, 2))
    size = d.groupBy("__s", "__b").agg(F.count("*").alias("__c"))  # at most 256 rows a stratum
    w = Window.partitionBy("__s")
    size = size.select("__s", "__b", F.coalesce(F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(w).alias("__n"))
    own = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", subject)) - 1
    return d.withColumn("__own", own).join(F.broadcast(size), ["__s", "__b"]).withColumn("__pos", F.col("__before") + F.col("__own"))


def _cut(d: DataFrame, sizes: tuple[Column, Column]) -> Column:
    t, v = sizes
    return F.when(F.col("__pos") < t, "train").when(F.col("__pos") < t + v, "val").otherwise("test")


def split_grouped(df: DataFrame, subject: str, train: float = TRAIN, val: float = VAL, seed: int = SEED) -> DataFrame:
    """(subject, split) of every distinct subject."""
    d = _positioned(df.select(subject).where(F.col(subject).isNotNull()).distinct(), subject, F.lit("all"), seed)
    return d.select(subject, _cut(d, allocate_grouped(F.col("__n"), train, val)).alias("split"))


def tertile_strata(df: DataFrame, subject: str, value: str) -> DataFrame:
    """(subject, stratum): low, mid or high by tertiles of the subjects' means; "all" without a value, or with fewer
    than three distinct means."""
    m = df.groupBy(subject).agg(F.avg(value).alias("__m"))
    e = m.agg(F.percentile("__m", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__e"), F.count_distinct("__m").alias("__k"))
    s = F.when(F.col("__m").isNull() | (F.col("__k") < 3), "all").when(F.col("__m") <= F.col("__e")[0], "low").when(F.col("__m") <= F.col("__e")[1], "mid").otherwise("high")
    return m.crossJoin(F.broadcast(e)).select(subject, s.alias("stratum"))


def category_strata(df: DataFrame, subject: str, value: str, order: str | None = None) -> DataFrame:
    """(subject, stratum): the subject's first value as text, by ``order`` and then by itself; "all" without one.

    Empty texts, zeros and false count as no value.
    """
    v = F.when(~F.col(value).cast("string").isin("", "0", "0.0", "-0.0", "false"), F.col(value).cast("string"))
    first = F.min(F.when(v.isNotNull(), F.struct(*([F.col(order).alias("o")] if order else []), v.alias("v"))))["v"]
    return df.groupBy(subject).agg(first.alias("__v")).select(subject, F.coalesce("__v", F.lit("all")).alias("stratum"))


def strata(df: DataFrame, subject: str, value: str, order: str | None = None) -> DataFrame:
    """Tertiles of a number, and any other column as it is: (subject, stratum)."""
    return tertile_strata(df, subject, value) if isinstance(df.schema[value].dataType, T.NumericType) else category_strata(df, subject, value, order)


def split_stratified(df: DataFrame, subject: str, value: str, train: float = TRAIN, val: float = VAL, seed: int = SEED, order: str | None = None) -> DataFrame:
    """(subject, stratum, split), each stratum cut by itself."""
    d = _positioned(strata(df, subject, value, order), subject, F.col("stratum"), seed)
    return d.select(subject, "stratum", _cut(d, allocate_stratified(F.col("__n"), train, val)).alias("split"))


def leaks(assigned: DataFrame, subject: str) -> DataFrame:
    """Subjects in more than one split."""
    return assigned.groupBy(subject).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def verify_no_leakage(assigned: DataFrame, subject: str) -> None:
    bad = [r[0] for r in leaks(assigned, subject).orderBy(subject).limit(5).collect()]
    if bad:
        raise LeakageError(f"subjects in more than one split: {bad}")


def assign(df: DataFrame, splits: DataFrame, subject: str) -> DataFrame:
    return df.join(splits.select(subject, "split"), subject, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def summary(df: DataFrame, splits: DataFrame, subject: str, item: str, burden: str) -> DataFrame:
    """One row a split, empty ones too: n_subjects, n_series, mean_burden (1 place), modalities (sorted)."""
    d = df.join(splits.select(subject, "split"), subject)
    g = d.groupBy("split").agg(F.count_distinct(subject).alias("n_subjects"), F.count("*").alias("n_series"), F.round(F.avg(burden), 1).alias("mean_burden"), F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ",").alias("modalities"))
    names = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(g, "split", "left").select("split", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_subjects", "n_series")), F.coalesce("mean_burden", F.lit(0.0)).alias("mean_burden"), F.coalesce("modalities", F.lit("")).alias("modalities"))
