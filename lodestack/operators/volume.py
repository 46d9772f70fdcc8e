"""Numeric operators on volumes as arrays or as (id, index, value) rows: normalisation, regions, overlap, surfaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import mean_of, percentile_of

#: Nested regions of a label map, in channel order.
REGIONS = {"TC": (1, 4), "WT": (1, 2, 4), "ET": (4,)}


def normalised(df: DataFrame, key: str, values: str, method: str = "zscore", lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """(key, values): clip to percentiles of the foreground (> 0), then scale by its statistics.

    Without foreground unchanged. zscore: no spread leaves x - mean; minmax: no span gives zeros; none: unchanged. Every
    statistic is a column that a projection computes once a row.
    """
    if method not in ("none", "zscore", "minmax"):
        raise ValueError(f"unknown method: {method}")
    if method == "none":
        return df.select(key, F.col(values).cast("array<double>").alias(values))
    d = df.select(key, F.col(values).cast("array<double>").alias("v")).withColumn("fg", F.array_sort(F.filter("v", lambda x: x > 0)))
    d = d.withColumns({"a": percentile_of(F.col("fg"), lo), "b": percentile_of(F.col("fg"), hi)}).withColumn("c", F.transform("v", lambda x: F.greatest(F.col("a"), F.least(F.col("b"), x))))
    d = d.withColumn("g", F.filter("c", lambda x: x > 0)).withColumns({"m": mean_of(F.col("g")), "lo": F.array_min("g"), "span": F.array_max("g") - F.array_min("g")})
    d = d.withColumn("s", F.sqrt(F.aggregate("g", F.lit(0.0), lambda t, x: t + (x - F.col("m")) * (x - F.col("m"))) / F.nullif(F.size("g"), F.lit(0))))
    out = F.transform("c", lambda x: F.when(F.col("s") > 0, (x - F.col("m")) / F.col("s")).otherwise(x - F.col("m"))) if method == "zscore" else F.transform("c", lambda x: F.when(F.col("span") > 0, (x - F.col("lo")) / F.col("span")).otherwise(0.0))
    return d.select(key, F.when(F.size("fg") == 0, F.col("v")).otherwise(out).alias(values))


def display_normalise(sorted_values: Column, x: Column) -> Column:
    """x between the 1st and 99th percentile, scaled to 0 to 1 for display; 0 where they are equal."""
    a, b = percentile_of(sorted_values, 0.01), percentile_of(sorted_values, 0.99)
    return F.when(b > a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))).otherwise(0.0)


def regions(label: Column) -> dict[str, Column]:
    return {n: F.coalesce(label.isin(*k), F.lit(False)) for n, k in REGIONS.items()}


def overlap(voxels: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """(key, dice, iou) of boolean columns; two empty masks give 1, one empty gives 0."""
    both, p, t = F.count_if(F.col(pred) & F.col(target)), F.count_if(pred), F.count_if(target)
    g = voxels.groupBy(key).agg(both.alias("i"), p.alias("p"), t.alias("t"))
    dice = F.when(F.col("p") + F.col("t") == 0, 1.0).otherwise(2 * F.col("i") / (F.col("p") + F.col("t")))
    union = F.col("p") + F.col("t") - F.col("i")
    return g.select(key, F.round(dice, 6).alias("dice"), F.round(F.when(union == 0, 1.0).otherwise(F.col("i") / F.nullif(union, F.lit(0))), 6).alias("iou"))


def surface(mask: DataFrame, key: str, axes: tuple[str, ...]) -> DataFrame:
    """Points of a mask (rows that are set) that lack a neighbour along an axis; the border counts as background."""
    steps = F.array(*(F.struct(*((F.col(a) + (s if a == b else 0)).alias(a) for a in axes)) for b in axes for s in (-1, 1)))
    near = mask.select(key, F.explode(steps).alias("p")).select(key, "p.*")
    full = near.groupBy(key, *axes).agg(F.count("*").alias("n")).where(F.col("n") == 2 * len(axes)).drop("n")
    return mask.join(full, [key, *axes], "left_anti")


#: Points whose nearest ones are sought together.
BLOCK = 256


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each point of x to the nearest of y, exact: sorted blocks meet only what lies near along one axis.

    The axis is that of the widest spread. A block's window around it doubles until no point beyond can be nearer.
    """
    axis = int(np.argmax(np.ptp(y, axis=0)))
    y = y[np.argsort(y[:, axis], kind="stable")]
    order = np.argsort(x[:, axis], kind="stable")
    out = np.empty(len(x))
    step = max(float(np.ptp(y[:, axis])) / 64, 1e-9)
    for i in range(0, len(x), BLOCK):
        todo, width = order[i : i + BLOCK], step
        while len(todo):
            own = x[todo]
            s, e = int(np.searchsorted(y[:, axis], own[0, axis] - width, "left")), int(np.searchsorted(y[:, axis], own[-1, axis] + width, "right"))
            best = np.full(len(todo), np.inf)
            for k in range(s, e, 4096):
                d = np.zeros((len(todo), min(4096, e - k)))
                for c in range(x.shape[1]):
                    d += (own[:, c, None] - y[None, k : min(k + 4096, e), c]) ** 2
                best = np.minimum(best, d.min(1))
            best = np.sqrt(best)
            done = (best <= width) | (s == 0 and e == len(y))
            out[todo[done]] = best[done]
            todo, width = todo[~done], width * 2
    return out


def hausdorff95(pred: DataFrame, target: DataFrame, key: str, axes: tuple[str, ...], spacing: tuple[float, ...] | None = None) -> DataFrame:
    """(key, hd95): the larger of the 95th percentiles of nearest distances both ways; infinite if one mask is empty.

    Keys of neither mask don't occur (distance 0 by definition). The surface points of a key meet in one task, which
    compares near ones only.
    """
    scale = np.array(spacing or (1.0,) * len(axes))
    a, b = (surface(m, key, axes).select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(axes)), F.lit(k).alias("side")) for k, m in enumerate((pred, target)))

    def one(t: pa.Table) -> pa.Table:
        xs, side = np.column_stack([t.column(f"x{i}").to_numpy() for i in range(len(scale))]) * scale, t.column("side").to_numpy()
        x, y = xs[side == 0], xs[side == 1]
        h = max(float(np.percentile(nearest(p, q), 95)) for p, q in ((x, y), (y, x))) if len(x) and len(y) else float("inf")
        return pa.table({"key": t.column("key").slice(0, 1), "h": pa.array([h])})

    kind = pred.schema[key].dataType.simpleString()
    return a.unionByName(b).groupBy("key").applyInArrow(one, f"key {kind}, h double").select(F.col("key").alias(key), F.round("h", 6).alias("hd95"))


def evaluate(voxels: DataFrame, key: str, axes: tuple[str, ...], pred: str, target: str, spacing: tuple[float, ...] | None = None) -> DataFrame:
    """One row a subject: dice, iou and hd95 of each nested region of two label columns, as <measure>_<region>.

    Two empty masks are at distance 0, one empty mask at infinity.
    """
    p, t = regions(F.col(pred)), regions(F.col(target))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("region"), p[r].alias("p"), t[r].alias("t")) for r in REGIONS)))
    v = voxels.select(F.col(key).cast("string").alias("__id"), *axes, each.alias("m")).select(F.concat_ws("|", "__id", "m.region").alias("__k"), "__id", F.col("m.region").alias("region"), *axes, F.col("m.p").alias("p"), F.col("m.t").alias("t"))
    h = hausdorff95(v.where("p").select("__k", *axes), v.where("t").select("__k", *axes), "__k", axes, spacing)
    o = overlap(v, "__k", "p", "t").join(h, "__k", "left").withColumn("hd95", F.coalesce("hd95", F.lit(0.0)))
    o = o.select(F.regexp_extract("__k", r"^(.*)\|", 1).alias(key), F.regexp_extract("__k", r"\|([^|]*)$", 1).alias("region"), "dice", "iou", "hd95")
    wide = o.groupBy(key).pivot("region", list(REGIONS)).agg(*(F.first(m).alias(m) for m in ("dice", "iou", "hd95")))
    return wide.select(F.col(key).cast(voxels.schema[key].dataType).alias(key), *(F.col(f"{r}_{m}").alias(f"{m}_{r.lower()}") for r in REGIONS for m in ("dice", "iou", "hd95")))


def finite_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means with infinite values left out."""
    return df.agg(*(F.avg(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in columns))


def centre_crop(voxels: DataFrame, key: str, axes: tuple[str, ...], shape: tuple[int, ...], roi: tuple[int, ...], value: str) -> DataFrame:
    """Dense rows of a centred crop; axes shorter than the region are padded with zeros. Offsets are floored."""
    spark = voxels.sparkSession
    grid = None
    for a, n in zip(axes, roi):
        r = spark.range(n).withColumnRenamed("id", a)
        grid = r if grid is None else grid.crossJoin(r)
    moved = voxels
    for a, have, want in zip(axes, shape, roi):
        by = (have - want) // 2 if have >= want else -((want - have) // 2)
        moved = moved.withColumn(a, F.col(a).cast("long") - by).where((F.col(a) >= 0) & (F.col(a) < want))
    keys = voxels.select(key).distinct()
    return keys.crossJoin(F.broadcast(grid)).join(moved.select(key, *axes, value), [key, *axes], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def best_slice(voxels: DataFrame, key: str, axis: str, labelled: Column, n: Column) -> DataFrame:
    """(key, slice) of most labelled voxels, the first of equals; the middle if none is labelled."""
    g = voxels.groupBy(key, axis).agg(F.count_if(labelled).alias("c"), F.first(n).alias("n"))
    top = F.max(F.struct("c", (-F.col(axis)).alias("a")))
    return g.groupBy(key).agg(top.alias("t"), F.first("n").alias("n")).select(key, F.when(F.col("t.c") > 0, -F.col("t.a")).otherwise(F.floor(F.col("n") / 2)).cast("long").alias("slice"))


def histogram(df: DataFrame, value: str, bins: int = 30, median: bool = False) -> DataFrame:
    """(bin, n) of equal-width bins between the least and largest finite value; the last bin is closed.

    With ``median`` also has_median, which marks the bin that the median would fall in.
    """
    d = df.where(~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf"))).select(F.col(value).cast("double").alias("v"))
    e = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), *([F.percentile("v", 0.5).alias("mid")] if median else []))
    b = lambda v: F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).otherwise(0).cast("long")
    marks = [F.max(b("mid") == b("v")).alias("has_median")] if median else []
    return d.crossJoin(F.broadcast(e)).groupBy(b("v").alias("bin")).agg(F.count("*").alias("n"), *marks)
