"""Study quality: six components in [0, 1], a weighted score, a grade and reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import grade

WEIGHTS = {"continuity": 0.10, "contrast": 0.15, "integrity": 0.30, "metadata": 0.15, "noise": 0.15, "spacing": 0.15}
REQUIRED_METADATA = ("age", "institution", "patient_id", "scanner", "sex", "shape", "voxel_spacing")
EPS = 1e-8


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def sorted_finite(volume: Column) -> Column:
    return F.array_sort(F.filter(volume, lambda x: x.isNotNull() & finite(x)))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once a row. A column that is used once in a lambda is moved into it by the
    optimiser, which drops the projection before it, and is then computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def percentile_of(sorted_values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array; null if empty."""

    def at(s: Column) -> Column:
        pos = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(pos).cast("int")
        a = F.try_element_at(s, lo + 1)
        b = F.coalesce(F.try_element_at(s, lo + 2), a)
        return F.when(F.size(s) > 0, a + (b - a) * (pos - lo))

    return let(sorted_values, at)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def std_of(values: Column, mean: Column | None = None) -> Column:
    """Population standard deviation. A lambda evaluates what it refers to for each element: give the mean as a column
    that a projection below has computed."""
    m = mean_of(values) if mean is None else mean
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(values), F.lit(0)))


def integrity(volume: Column) -> Column:
    """0 for a null or empty volume, one with a value that isn't finite, or a constant one."""
    bad = volume.isNull() | (F.size(volume) == 0) | F.exists(volume, lambda x: x.isNull() | ~finite(x))
    return F.when(bad | (F.array_max(volume) == F.array_min(volume)), 0.0).otherwise(1.0)


def missing_metadata(df: DataFrame, fields: tuple[str, ...] = REQUIRED_METADATA) -> Column:
    """How many fields are null, empty text, an empty array or NaN."""
    total, kinds = F.lit(0), dict(df.dtypes)
    for f in fields:
        c, kind = F.col(f), kinds[f]
        gone = c.isNull()
        if kind == "string":
            gone = gone | (c == "")
        elif kind.startswith("array"):
            gone = gone | (F.size(c) == 0)
        elif kind in ("double", "float"):
            gone = gone | F.isnan(c)
        total = total + F.coalesce(gone, F.lit(True)).cast("int")
    return total


def metadata(df: DataFrame, fields: tuple[str, ...] = REQUIRED_METADATA) -> Column:
    return 1 - missing_metadata(df, fields) / F.lit(float(len(fields)))


def spacing(s: Column, max_mm: float = 5.0) -> Column:
    hi, lo = F.array_max(s), F.array_min(s)
    bad = s.isNull() | (F.size(s) < 3) | (lo <= 0)
    return F.when(bad, 0.0).otherwise(0.5 * clip01(1 - (hi / lo - 1) / 5) + 0.5 * clip01(1 - (hi - 1) / max_mm))


def spacing_reason(s: Column, max_mm: float = 5.0) -> Column:
    hi, lo = F.array_max(s), F.array_min(s)
    return F.when(s.isNull() | (F.size(s) < 3), "voxel spacing unavailable").when(lo <= 0, "invalid spacing").when(hi / lo > 3, F.format_string("anisotropic voxels (ratio %.1f:1)", hi / lo)).when(hi > max_mm, F.format_string("coarse spacing (%.1f mm)", hi))


def with_snr(df: DataFrame, values: str, out: str) -> DataFrame:
    """df with |mean| / (std + eps) of the sorted values above their 60th percentile; null if fewer than 10 or constant.

    Each step is a projection of its own that the next refers to more than once, so none is evaluated per element.
    """
    v = F.col(values)
    d = df.withColumn("__cut", percentile_of(v, 0.6)).withColumn("__fg", F.filter(v, lambda x: x > F.col("__cut")))
    d = d.withColumn("__m", mean_of(F.col("__fg"))).withColumn("__sd", std_of(F.col("__fg"), F.col("__m")))
    r = F.when((F.size("__fg") >= 10) & (F.col("__sd") > 0), F.abs("__m") / (F.col("__sd") + EPS))
    return d.withColumn(out, r).drop("__cut", "__fg", "__m", "__sd")


def noise(values: Column, ratio: Column) -> Column:
    return F.when(F.size(values) == 0, 0.0).when(ratio.isNull(), 0.5).otherwise(clip01(ratio / 10))


def contrast(values: Column) -> Column:
    full = F.array_max(values) - F.array_min(values)
    return F.when((F.size(values) > 0) & (full > 0), clip01((percentile_of(values, 0.75) - percentile_of(values, 0.25)) / (0.25 * full))).otherwise(0.0)


def with_continuity(df: DataFrame, diffs: str, out: str) -> DataFrame:
    """df with the continuity score of the mean absolute differences of neighbouring slices.

    1 for fewer than two, 0 if one isn't finite or all are zero; else 0.15 off for each duplicate (< 1e-6) and 0.10 for
    each jump (8 median absolute deviations from the median).
    """
    x = F.col(diffs)
    median = lambda v: percentile_of(F.array_sort(v), 0.5)
    far = lambda dev: let(8 * (median(dev) + EPS), lambda most: F.size(F.filter(dev, lambda v: v > most)))
    jumps = let(median(x), lambda m: let(F.transform(x, lambda v: F.abs(v - m)), far))
    dups = F.size(F.filter(x, lambda v: v < 1e-6))
    bad = F.exists(x, lambda v: ~finite(v)) | (mean_of(x) == 0)
    r = F.when(x.isNull() | (F.size(x) < 2), 1.0).when(bad, 0.0).otherwise(clip01(1 - (0.15 * dups + 0.10 * jumps)))
    return df.withColumn(out, r)


def slice_differences(slices: DataFrame, volume_id: str, index: str, values: str) -> DataFrame:
    """(volume_id, diffs): mean absolute difference of each slice from the one before, in order."""
    before = F.lag(values).over(Window.partitionBy(volume_id).orderBy(index))
    d = slices.withColumn("__p", before).where("__p is not null")
    d = d.withColumn("__d", mean_of(F.transform(F.arrays_zip(F.col(values).alias("a"), F.col("__p").alias("b")), lambda z: F.abs(z["a"].cast("double") - z["b"].cast("double")))))
    return d.groupBy(volume_id).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, "__d"))), lambda x: x["__d"]).alias("diffs"))


def score(components: dict[str, Column]) -> Column:
    """100 times the weighted sum."""
    out = F.lit(0.0)
    for name, w in WEIGHTS.items():
        out = out + w * components[name]
    return 100 * out


def score_studies(df: DataFrame, volume: str = "volume", diffs: str | None = None, spacing_col: str = "voxel_spacing", fields: tuple[str, ...] = REQUIRED_METADATA, max_mm: float = 5.0) -> DataFrame:
    """df with q_score (2 places), q_<component> (3 places), q_grade and q_reasons, joined by "; " in a fixed order."""
    d = df.withColumn("__v", F.col(volume).cast("array<double>")).withColumn("__s", F.coalesce(sorted_finite(F.col("__v")), F.array().cast("array<double>")))
    v, s, sp = F.col("__v"), F.col("__s"), F.col(spacing_col)
    d = with_snr(d, "__s", "__snr")
    d = with_continuity(d, diffs, "__c") if diffs else d.withColumn("__c", F.lit(1.0))
    d = d.withColumns({"__q_integrity": integrity(v), "__q_metadata": metadata(df, fields), "__q_spacing": spacing(sp, max_mm), "__q_noise": noise(s, F.col("__snr")), "__q_contrast": contrast(s), "__q_continuity": F.col("__c")})
    q = {k: F.col(f"__q_{k}") for k in WEIGHTS}
    d = d.withColumn("__score", score(q))
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))
    reasons = F.concat_ws(
        "; ",
        F.when(v.isNull(), "volume unreadable").when(F.exists(v, lambda x: x.isNull() | ~finite(x)), "non-finite voxels").when(q["integrity"] == 0, "volume is constant (no signal)"),
        F.when(q["metadata"] < 1, F.concat(F.lit("missing metadata: "), F.array_join(missing, ", "))),
        spacing_reason(sp, max_mm),
        F.when(F.size(s) == 0, "no finite voxels").when(F.col("__snr").isNull(), "insufficient foreground to estimate SNR").when(F.col("__snr") < 3, F.format_string("low SNR (%.1f)", F.col("__snr"))),
        F.when(q["contrast"] < 0.3, "low tissue contrast"),
        F.when(q["continuity"] < 1, "slice discontinuity"),
    )
    out = {"q_score": F.round("__score", 2), **{f"q_{k}": F.round(c, 3) for k, c in q.items()}, "q_grade": grade(F.col("__score")), "q_reasons": reasons}
    return d.withColumns(out).drop("__v", "__s", "__snr", "__c", "__score", *(f"__q_{k}" for k in WEIGHTS))


def grade_counts(df: DataFrame, score_col: str) -> DataFrame:
    return df.groupBy(grade(F.col(score_col)).alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg(score_col), 1).alias("mean_score"))
