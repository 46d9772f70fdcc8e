"""Representation and outcome-disparity audits with effect sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import AGE_EDGES

DOMINANCE = 0.50
DISPARITY = 2.0
REFERENCE = {"age_band": dict(zip((e[2] for e in AGE_EDGES), (0.20, 0.30, 0.35, 0.15))), "sex": dict.fromkeys("FM", 0.5)}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null as "unknown"."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def representations(df: DataFrame, columns: Sequence[str], references: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row an attribute: its top value and share, chi-square against the reference and Cramer's V, in one scan.

    The test needs two reference values that occur and expected counts of at least 5; without a reference only the
    dominance of one value counts. Ties for the top go to the smallest value. held: whether any value isn't null.
    p-values: ``with_p_value``.
    """
    references = {c: (references or {}).get(c) or REFERENCE.get(c) or {} for c in columns}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("own")) for c in columns))).alias("x")
    c = df.select(each).groupBy("x.attribute", F.coalesce("x.own", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"), F.max(F.col("x.own").isNotNull()).alias("held"))
    spark = df.sparkSession
    ref = spark.createDataFrame([(a, k, float(v)) for a, r in references.items() for k, v in r.items()], "attribute string, value string, w double")
    c = c.join(F.broadcast(ref), ["attribute", "value"], "left")
    seen = F.col("w").isNotNull()
    t = c.groupBy("attribute").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.max("n").alias("top0"), F.sum(F.when(seen, F.col("n"))).alias("obs"), F.sum("w").alias("wsum"), F.count("w").alias("kr"), F.max("held").alias("held"), F.collect_list(F.struct("value", "n", "w")).alias("cells"))
    t = spark.createDataFrame([(a,) for a in columns], "attribute string").join(F.broadcast(t), "attribute", "left").fillna(0, ["total", "k", "kr"]).fillna(False, ["held"])
    t = t.withColumn("top", F.get(F.array_sort(F.filter("cells", lambda x: x["n"] == F.col("top0"))), 0)["value"])
    expected = lambda x: x["w"] / F.col("wsum") * F.col("obs")
    cells = F.filter("cells", lambda x: x["w"].isNotNull())
    fit = (F.col("kr") > 1) & F.forall(cells, lambda x: expected(x) >= 5)
    chi = F.when(fit, F.aggregate(cells, F.lit(0.0), lambda a, x: a + (x["n"] - expected(x)) * (x["n"] - expected(x)) / expected(x)))
    t = t.withColumn("statistic", chi).withColumn("df", F.when(F.col("statistic").isNotNull(), F.col("kr") - 1))
    t = t.withColumn("effect_size", F.sqrt(F.col("statistic") / (F.col("obs") * F.greatest(F.col("kr") - 1, F.lit(1)))))
    share = F.col("top0") / F.col("total")
    return t.select("attribute", F.lit("representation").alias("kind"), "total", F.col("k").alias("n_values"), "top", F.round(share, 4).alias("top_share"), F.round("statistic", 4).alias("statistic"), "df", F.round("effect_size", 4).alias("effect_size"), F.coalesce((share > DOMINANCE) & (F.col("k") > 1), F.lit(False)).alias("dominates"), "held")


def representation(df: DataFrame, column: str, reference: dict[str, float] | None = None) -> DataFrame:
    """The row of one attribute of ``representations``."""
    return representations(df, [column], {column: reference} if reference else None).drop("held")


def _chi2_tail(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution


def with_p_value(findings: DataFrame) -> list[dict]:
    """Collected findings (a row an attribute) with p_value, severity and message."""
    dist, out = _chi2_tail(findings.sparkSession), []
    for r in findings.collect():
        d = r.asDict()
        d["p_value"] = None if d["statistic"] is None else round(1 - dist(float(d["df"])).cumulativeProbability(float(d["statistic"])), 5)
        d["severity"], d["message"] = "INFO", "no data"
        if d["kind"] == "representation" and d["total"]:
            d["message"] = f"{d['top']} has {d['top_share']:.0%} of the cohort"
            if d["p_value"] is not None and d["p_value"] < 0.05 and d["effect_size"] > 0.1:
                d["severity"], d["message"] = "WARN", f"{d['attribute']} departs from its reference (V {d['effect_size']:.2f})"
            if d["dominates"]:
                d["severity"], d["message"] = "WARN", f"{d['top']} dominates {d['attribute']}: {d['top_share']:.0%}"
        elif d["kind"] == "disparity":
            d["message"] = "too few groups" if d["n_groups"] < 2 else f"medians {d['lo']:.1f} to {d['hi']:.1f}"
            if d["n_groups"] >= 2 and (d["effect_size"] is None or d["effect_size"] > DISPARITY or (d["p_value"] is not None and d["p_value"] < 0.05)):
                d["severity"] = "WARN"
        out.append(d)
    return out


def disparity(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """One row: Kruskal-Wallis H with tie correction over groups of two or more outcomes, and the ratio of medians.

    Null groups are "unknown"; the ratio is null (infinite) when the least median isn't positive; H is null when all
    outcomes are equal. Ranks come from counts of equal values, so only distinct values are sorted.
    """
    d = df.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("g"), F.col(outcome).cast("double").alias("v")).where("v is not null")
    big = d.groupBy("g").agg(F.count("*").alias("ng"), F.median("v").alias("med")).where("ng >= 2")
    d = d.join(F.broadcast(big.select("g")), "g")
    ties = d.groupBy("v").agg(F.count("*").alias("t"))
    rank = _running(ties)
    r = d.join(rank, "v").groupBy("g").agg(F.sum("r").alias("rs"), F.count("*").alias("n"))
    h = r.agg(F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"))
    tie = ties.agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    m = big.agg(F.count("*").alias("n_groups"), F.min("med").alias("lo"), F.max("med").alias("hi"))
    x = m.crossJoin(F.broadcast(h)).crossJoin(F.broadcast(tie))
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    fix = 1 - F.col("tie") / (n * n * n - n)
    ok = (F.col("n_groups") >= 2) & (fix > 0)
    return x.select(F.lit(group).alias("attribute"), F.lit("disparity").alias("kind"), F.lit(outcome).alias("outcome"), "n_groups", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round(F.when(ok, raw / fix), 4).alias("statistic"), F.when(ok, F.col("n_groups") - 1).alias("df"), F.round(F.when((F.col("n_groups") >= 2) & (F.col("lo") > 0), F.col("hi") / F.col("lo")), 4).alias("effect_size"))


#: Ranges that running counts are built over, side by side.
RANGES = 64


def _running(ties: DataFrame) -> DataFrame:
    """(v, r): average rank of each distinct value; prefix sums within value ranges, then over the few ranges."""
    cut = ties.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("__cut"))
    t = ties.crossJoin(F.broadcast(cut)).withColumn("__p", F.aggregate("__cut", F.lit(0), lambda a, x: a + F.when(x < F.col("v"), 1).otherwise(0))).drop("__cut")
    size = t.groupBy("__p").agg(F.sum("t").alias("__s"))
    before = size.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.coalesce(F.sum("t").over(Window.partitionBy("__p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("__o", own).join(F.broadcast(before), "__p").select("v", (F.col("__b") + F.col("__o") + (F.col("t") + 1) / 2).alias("r"))


def audit(df: DataFrame, attributes: Sequence[str], outcomes: Sequence[str] = (), groups: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Representation of every attribute with any value, and disparity of every outcome by every group."""
    rep = representations(df, attributes).where("held").drop("held") if attributes else None
    dis = None
    for o in outcomes:
        for g in groups:
            one = disparity(df, g, o)
            dis = one if dis is None else dis.unionByName(one)
    return rep, dis


def cramers_v(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """One row: n, chi-square and Cramer's V of a two-way table; 0 without rows. Null is a value of its own.

    The table is aggregated, so the driver and single tasks see only its cells.
    """
    cell = df.groupBy(F.col(rows).alias("r"), F.col(columns).alias("c")).agg(F.count("*").cast("double").alias("n"))
    of = lambda k: cell.groupBy(F.col(k).alias(f"{k}2")).agg(F.sum("n").alias(f"n{k}"))
    r, c, total = of("r"), of("c"), cell.agg(F.sum("n").alias("total"))
    # empty cells add their expectation: the sum over all cells of observed squared by expected, less the total
    x = cell.join(F.broadcast(r), F.col("r").eqNullSafe(F.col("r2"))).join(F.broadcast(c), F.col("c").eqNullSafe(F.col("c2"))).crossJoin(F.broadcast(total))
    x = x.agg(F.sum(F.col("n") * F.col("n") * F.col("total") / (F.col("nr") * F.col("nc"))).alias("s"), F.max("total").alias("total"))
    k = r.agg(F.count("*").alias("kr")).crossJoin(c.agg(F.count("*").alias("kc")))
    chi = F.coalesce(F.col("s") - F.col("total"), F.lit(0.0))
    v = F.when(F.col("total") > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("total") * F.greatest(F.least(F.col("kr"), F.col("kc")) - 1, F.lit(1))))).otherwise(0.0)
    return x.crossJoin(k).select(F.coalesce("total", F.lit(0.0)).cast("long").alias("n"), F.round(chi, 4).alias("statistic"), F.round(v, 4).alias("effect_size"))
