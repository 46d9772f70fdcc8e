"""Declarative cohorts with an attrition trail, and their shift against the archive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criterion:
    name: str
    expression: str
    rationale: str = ""


@dataclass(frozen=True)
class CohortSpec:
    name: str
    criteria: tuple[Criterion, ...]
    description: str = ""

    def to_dict(self) -> dict:
        return {"name": self.name, "description": self.description, "criteria": [vars(c) for c in self.criteria]}


STRICT = CohortSpec("adult_contrast_labelled", (Criterion("adult", "age >= 18"), Criterion("contrast", "contrast"), Criterion("labelled", "has_label"), Criterion("quality", "quality_score >= 65")))
PERMISSIVE = CohortSpec("any_readable", (Criterion("quality", "quality_score >= 30"),))


def _flags(df: DataFrame, spec: CohortSpec):
    out, so_far = [], None
    for c in spec.criteria:
        try:
            one = F.coalesce(F.expr(c.expression).cast("boolean"), F.lit(False))
            df.select(one)
        except (AnalysisException, ParseException) as e:
            raise ValueError(f"criterion {c.name!r} can't be evaluated: {c.expression}") from e
        so_far = one if so_far is None else so_far & one
        out.append(so_far)
    return out


def members(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Rows that meet every criterion; null compares false. A criterion that can't be evaluated raises ValueError."""
    flags = _flags(df, spec)
    return df.where(flags[-1]) if flags else df


def attrition(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row a step: step, criterion, expression, n_before, n_after, n_removed; step 0 is everything. One pass."""
    flags = _flags(df, spec)
    counts = df.agg(F.count("*").alias("n0"), *(F.count_if(f).alias(f"n{i}") for i, f in enumerate(flags, 1)))
    steps = [F.struct(F.lit(0).cast("long").alias("step"), F.lit("all").alias("criterion"), F.lit("").alias("expression"), F.col("n0").alias("n_before"), F.col("n0").alias("n_after"))]
    for i, c in enumerate(spec.criteria, 1):
        steps.append(F.struct(F.lit(i).cast("long").alias("step"), F.lit(c.name).alias("criterion"), F.lit(c.expression).alias("expression"), F.col(f"n{i - 1}").alias("n_before"), F.col(f"n{i}").alias("n_after")))
    return counts.select(F.explode(F.array(*steps)).alias("s")).select("s.*").withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def retention(trail: DataFrame, alarm: float = 0.20) -> DataFrame:
    """One row: kept share and whether it is below the alarm."""
    r = F.max_by("n_after", "step") / F.nullif(F.max(F.when(F.col("step") == 0, F.col("n_after"))), F.lit(0))
    return trail.agg(F.round(F.coalesce(r, F.lit(0.0)), 4).alias("retention")).withColumn("low", F.col("retention") < alarm)


def shift(df: DataFrame, member: str, columns: Sequence[str]) -> DataFrame:
    """Share of each value of each attribute in the cohort and in all of ``df``, and the difference.

    ``member`` is a boolean column; null values are "unknown". Both shares come from one aggregation over the
    attributes unpivoted.
    """
    u = df.select(F.col(member).alias("__m"), F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("unknown")))))).alias("attribute", "value"))
    g = u.groupBy("attribute", "value").agg(F.count("*").alias("a"), F.count_if("__m").alias("c"))
    t = g.groupBy("attribute").agg(F.sum("a").alias("ta"), F.sum("c").alias("tc"))
    cohort = F.when(F.col("tc") > 0, F.col("c") / F.col("tc")).otherwise(0.0)
    full = F.col("a") / F.col("ta")
    return g.join(F.broadcast(t), "attribute").select("attribute", "value", F.round(cohort, 4).alias("cohort_share"), F.round(full, 4).alias("archive_share"), F.round(cohort - full, 4).alias("delta"))
