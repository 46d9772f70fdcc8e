"""Queries of numeric operators, over embeddings as 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import volume
from .registry import Tables, query

_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::double * 100, 2)) AS v FROM embeddings)"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 100, 2)).alias("v"))


def _summary(d: DataFrame) -> DataFrame:
    """Order-free facts of the normalised arrays, rounded."""
    s = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    return d.select("vec_id", F.round(s(lambda x: x), 3).alias("total"), F.round(s(lambda x: x * x), 3).alias("squares"), F.round(F.array_max("v"), 4).alias("top"), F.round(F.array_min("v"), 4).alias("low"))


_NORM = f"""{_V}, u AS (SELECT vec_id, unnest(v) AS x FROM v), p AS (SELECT vec_id, quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b FROM u WHERE x > 0 GROUP BY 1),
c AS (SELECT vec_id, CASE WHEN a IS NULL THEN x ELSE greatest(a, least(b, x)) END AS x, a FROM u LEFT JOIN p USING (vec_id)), g AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) - min(x) AS span FROM c WHERE x > 0 AND a IS NOT NULL GROUP BY 1)"""
_SUM = "SELECT vec_id, round(sum(y), 3) AS total, round(sum(y * y), 3) AS squares, round(max(y), 4) AS top, round(min(y), 4) AS low FROM n GROUP BY 1"


@query(f"WITH {_NORM}, n AS (SELECT vec_id, CASE WHEN m IS NULL THEN x WHEN s > 0 THEN (x - m) / s ELSE x - m END AS y FROM c LEFT JOIN g USING (vec_id)) {_SUM}")
def normalise_zscore(t: Tables) -> DataFrame:
    return _summary(volume.normalised(_vectors(t), "vec_id", "v", "zscore"))


@query(f"WITH {_NORM}, n AS (SELECT vec_id, CASE WHEN m IS NULL THEN x WHEN span > 0 THEN (x - lo) / span ELSE 0.0::double END AS y FROM c LEFT JOIN g USING (vec_id)) {_SUM}")
def normalise_minmax(t: Tables) -> DataFrame:
    return _summary(volume.normalised(_vectors(t), "vec_id", "v", "minmax"))


@query(f"WITH {_V}, n AS (SELECT vec_id, unnest(v) AS y FROM v) {_SUM}")
def normalise_none(t: Tables) -> DataFrame:
    return _summary(volume.normalised(_vectors(t), "vec_id", "v", "none"))


def _voxels(t: Tables) -> DataFrame:
    """(vec_id, z, y, label): labels 0, 1, 2, 4 by value."""
    d = t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "x"))
    lab = F.when(F.col("x") > 0.15, 4).when(F.col("x") > 0.08, 2).when(F.col("x") > 0.0, 1).otherwise(0)
    return d.select("vec_id", F.floor(F.col("p") / 8).alias("z"), (F.col("p") % 8).cast("long").alias("y"), lab.alias("label"))


_X = """w AS (SELECT vec_id, p // 8 AS z, p % 8 AS y, CASE WHEN x > 0.15::double THEN 4 WHEN x > 0.08::double THEN 2 WHEN x > 0 THEN 1 ELSE 0 END AS label
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS x FROM embeddings))"""


@query(f"WITH {_X} SELECT vec_id, count(*) FILTER (label IN (1, 4)) AS tc, count(*) FILTER (label IN (1, 2, 4)) AS wt, count(*) FILTER (label = 4) AS et FROM w GROUP BY 1")
def region_masks(t: Tables) -> DataFrame:
    r = volume.regions(F.col("label"))
    return _voxels(t).groupBy("vec_id").agg(*(F.count_if(c).alias(n.lower()) for n, c in r.items()))


def _pairs(t: Tables) -> DataFrame:
    w = _voxels(t)
    nxt = w.select((F.col("vec_id") - 1).alias("vec_id"), "z", "y", F.col("label").alias("other"))
    return w.join(nxt, ["vec_id", "z", "y"])


@query(f"""
WITH {_X}, j AS (SELECT a.vec_id, a.label > 0 AS p, b.label > 0 AS q FROM w a JOIN w b ON b.vec_id = a.vec_id + 1 AND a.z = b.z AND a.y = b.y),
g AS (SELECT vec_id, count(*) FILTER (p AND q) AS i, count(*) FILTER (p) AS a, count(*) FILTER (q) AS b FROM j GROUP BY 1)
SELECT vec_id, round(CASE WHEN a + b = 0 THEN 1.0::double ELSE 2 * i / (a + b)::double END, 6) AS dice, round(CASE WHEN a + b - i = 0 THEN 1.0::double ELSE i / (a + b - i)::double END, 6) AS iou FROM g""")
def region_dice_iou(t: Tables) -> DataFrame:
    d = _pairs(t).select("vec_id", (F.col("label") > 0).alias("p"), (F.col("other") > 0).alias("q"))
    return volume.overlap(d, "vec_id", "p", "q")


def _surf_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT * FROM {source} m WHERE (SELECT count(*) FROM {source} o WHERE o.vec_id = m.vec_id AND abs(o.z - m.z) + abs(o.y - m.y) = 1) < 4)"""


@query(f"""
WITH {_X}, a0 AS (SELECT vec_id, z, y FROM w WHERE label >= 2), b0 AS (SELECT vec_id - 1 AS vec_id, z, y FROM w WHERE label >= 2), {_surf_sql("a", "a0")}, {_surf_sql("b", "b0")},
d AS (SELECT a.vec_id, a.z AS az, a.y AS ay, b.z AS bz, b.y AS by_, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) * 4.0::double) AS d FROM a JOIN b USING (vec_id)),
h1 AS (SELECT vec_id, quantile_cont(d, 0.95) AS h FROM (SELECT vec_id, min(d) AS d FROM d GROUP BY vec_id, az, ay) GROUP BY 1), h2 AS (SELECT vec_id, quantile_cont(d, 0.95) AS h FROM (SELECT vec_id, min(d) AS d FROM d GROUP BY vec_id, bz, by_) GROUP BY 1)
SELECT k.vec_id, round(CASE WHEN h1.h IS NULL THEN 'infinity'::double ELSE greatest(h1.h, h2.h) END, 6) AS hd95 FROM (SELECT vec_id FROM a UNION SELECT vec_id FROM b) k LEFT JOIN h1 USING (vec_id) LEFT JOIN h2 USING (vec_id)""")
def hausdorff95(t: Tables) -> DataFrame:
    w = _voxels(t).where("label >= 2")
    a = w.select("vec_id", "z", "y")
    b = w.select((F.col("vec_id") - 1).alias("vec_id"), "z", "y")
    return volume.hausdorff95(a, b, "vec_id", ("z", "y"), (1.0, 2.0))


@query(f"WITH {_X} SELECT vec_id, z - 2 AS z, y - 2 AS y, label FROM w WHERE z BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def center_crop(t: Tables) -> DataFrame:
    return volume.centre_crop(_voxels(t), "vec_id", ("z", "y"), (8, 8), (4, 4), "label")


@query(f"WITH {_X}, g AS (SELECT vec_id, z, y FROM (SELECT DISTINCT vec_id FROM w), (SELECT unnest(range(12)) AS z), (SELECT unnest(range(12)) AS y)) SELECT g.*, coalesce(label, 0) AS label FROM g LEFT JOIN w ON g.vec_id = w.vec_id AND g.z = w.z + 2 AND g.y = w.y + 2")
def center_pad(t: Tables) -> DataFrame:
    return volume.centre_crop(_voxels(t), "vec_id", ("z", "y"), (8, 8), (12, 12), "label")


@query(f"WITH {_X}, g AS (SELECT vec_id, z, count(*) FILTER (label = 4) AS c FROM w GROUP BY ALL) SELECT vec_id, CASE WHEN max(c) > 0 THEN min(z) FILTER (c = m) ELSE 4 END AS slice FROM (SELECT *, max(c) OVER (PARTITION BY vec_id) AS m FROM g) GROUP BY 1")
def best_slice(t: Tables) -> DataFrame:
    return volume.best_slice(_voxels(t), "vec_id", "z", F.col("label") == 4, F.lit(8))


@query("""
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(29, floor((value - lo) / ((hi - lo) / 30)))::bigint AS bin, count(*) AS n FROM events, e GROUP BY 1""")
def histogram_values(t: Tables) -> DataFrame:
    return volume.histogram(t.events, "value", 30)


@query(f"WITH {_X}, m AS (SELECT vec_id, count(*) FILTER (label > 0) AS n FROM w GROUP BY 1) SELECT round(avg(CASE WHEN vec_id % 4 <> 0 THEN n::double END), 6) AS n FROM m")
def finite_means(t: Tables) -> DataFrame:
    m = _voxels(t).groupBy("vec_id").agg(F.count_if(F.col("label") > 0).alias("c")).select(F.when(F.col("vec_id") % 4 == 0, float("inf")).otherwise(F.col("c")).alias("n"))
    return volume.finite_mean(m, ["n"]).select(F.round("n", 6).alias("n"))


_EV = f"""WITH {_X}, rg AS (SELECT * FROM (VALUES ('TC', [1, 4]), ('WT', [1, 2, 4]), ('ET', [4])) AS rg(region, ks)),
a0 AS (SELECT vec_id, region, z, y FROM w, rg WHERE list_contains(ks, label) AND vec_id < (SELECT max(vec_id) FROM embeddings)), b0 AS (SELECT vec_id - 1 AS vec_id, region, z, y FROM w, rg WHERE list_contains(ks, label) AND vec_id >= 1),
a AS (SELECT * FROM a0 m WHERE (SELECT count(*) FROM a0 o WHERE o.vec_id = m.vec_id AND o.region = m.region AND abs(o.z - m.z) + abs(o.y - m.y) = 1) < 4),
b AS (SELECT * FROM b0 m WHERE (SELECT count(*) FROM b0 o WHERE o.vec_id = m.vec_id AND o.region = m.region AND abs(o.z - m.z) + abs(o.y - m.y) = 1) < 4),
d AS (SELECT a.vec_id, region, a.z AS az, a.y AS ay, b.z AS bz, b.y AS by_, sqrt(((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y))::double) AS d FROM a JOIN b USING (vec_id, region)),
h1 AS (SELECT vec_id, region, quantile_cont(d, 0.95) AS h FROM (SELECT vec_id, region, min(d) AS d FROM d GROUP BY vec_id, region, az, ay) GROUP BY ALL), h2 AS (SELECT vec_id, region, quantile_cont(d, 0.95) AS h FROM (SELECT vec_id, region, min(d) AS d FROM d GROUP BY vec_id, region, bz, by_) GROUP BY ALL),
k AS (SELECT DISTINCT vec_id, region FROM w, rg WHERE vec_id < (SELECT max(vec_id) FROM embeddings)), na AS (SELECT vec_id, region, count(*) AS n FROM a0 GROUP BY ALL), nb AS (SELECT vec_id, region, count(*) AS n FROM b0 GROUP BY ALL), ni AS (SELECT vec_id, region, count(*) AS n FROM a0 JOIN b0 USING (vec_id, region, z, y) GROUP BY ALL),
m AS (SELECT vec_id, region, coalesce(na.n, 0) AS a, coalesce(nb.n, 0) AS b, coalesce(ni.n, 0) AS i, h1.h AS h1, h2.h AS h2 FROM k LEFT JOIN na USING (vec_id, region) LEFT JOIN nb USING (vec_id, region) LEFT JOIN ni USING (vec_id, region) LEFT JOIN h1 USING (vec_id, region) LEFT JOIN h2 USING (vec_id, region)),
e AS (SELECT vec_id, region, round(CASE WHEN a + b = 0 THEN 1.0::double ELSE 2 * i / (a + b)::double END, 6) AS dice, round(CASE WHEN a + b - i = 0 THEN 1.0::double ELSE i / (a + b - i)::double END, 6) AS iou, CASE WHEN a + b = 0 THEN 0.0::double WHEN h1 IS NULL THEN 'infinity'::double ELSE round(greatest(h1, h2), 6) END AS hd95 FROM m)
SELECT vec_id, """ + ", ".join(f"max({m}) FILTER (region = '{r}') AS {m}_{r.lower()}" for r in ("TC", "WT", "ET") for m in ("dice", "iou", "hd95")) + " FROM e GROUP BY 1"


@query(_EV)
def evaluate_subjects(t: Tables) -> DataFrame:
    return volume.evaluate(_pairs(t), "vec_id", ("z", "y"), "label", "other")


@query(f"""
WITH {_V}, u AS (SELECT vec_id, unnest(v) AS x FROM v), p AS (SELECT vec_id, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM u GROUP BY 1),
n AS (SELECT vec_id, CASE WHEN b > a THEN greatest(0.0::double, least(1.0::double, (x - a) / (b - a))) ELSE 0.0::double END AS y FROM u JOIN p USING (vec_id)) {_SUM}""")
def display_scaled(t: Tables) -> DataFrame:
    d = _vectors(t).withColumn("o", F.array_sort("v"))
    return _summary(d.select("vec_id", F.transform("v", lambda x: volume.display_normalise(F.col("o"), x)).alias("v")))


@query("SELECT value_bin, count(*) AS n, bool_or(value_bin = median_bin) AS has_median FROM (SELECT least(29, floor((value - lo) / ((hi - lo) / 30)))::bigint AS value_bin, least(29, floor((mid - lo) / ((hi - lo) / 30)))::bigint AS median_bin FROM events, (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS mid FROM events)) GROUP BY 1")
def histogram_median(t: Tables) -> DataFrame:
    return volume.histogram(t.events, "value", 30, median=True).select(F.col("bin").alias("value_bin"), "n", "has_median")
