"""Queries of cohorts, joins, labels, timelines and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort, fusion, split
from .registry import Tables, query

SPEC = cohort.CohortSpec(
    "clean_english",
    (
        cohort.Criterion("english", "lang = 'en'", "one language"),
        cohort.Criterion("long enough", "n_chars >= 200", "short texts carry little"),
        cohort.Criterion("labelled", "quality is not null", "quality must be known"),
        cohort.Criterion("good", "quality = 1", "rated good"),
        cohort.Criterion("harmless", "toxic = 0", "rated harmless"),
    ),
)
_D = "d AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_C = [c.expression for c in SPEC.criteria]


def _docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


def _trail_sql() -> str:
    n = ["count(*)"] + [f"count(*) FILTER ({' AND '.join(_C[: i + 1])})" for i in range(len(_C))]
    rows = [f"SELECT 0::bigint AS step, 'all' AS criterion, '' AS expression, {n[0]} AS n_before, {n[0]} AS n_after, 0::bigint AS n_removed FROM d"]
    for i, c in enumerate(SPEC.criteria, 1):
        e = c.expression.replace("'", "''")
        rows.append(f"SELECT {i}, '{c.name}', '{e}', {n[i - 1]}, {n[i]}, {n[i - 1]} - {n[i]} FROM d")
    return f"WITH {_D} " + " UNION ALL ".join(rows)


@query(_trail_sql())
def cohort_attrition(t: Tables) -> DataFrame:
    return cohort.attrition(_docs(t), SPEC)


@query(f"WITH {_D} SELECT round(count(*) FILTER ({' AND '.join(_C)}) / count(*)::double, 4) AS retention, count(*) FILTER ({' AND '.join(_C)}) / count(*)::double < 0.2 AS low FROM d")
def cohort_retention(t: Tables) -> DataFrame:
    return cohort.retention(cohort.attrition(_docs(t), SPEC))


@query(f"WITH {_D} SELECT doc_id, lang, source, n_chars FROM d WHERE {' AND '.join(_C)}")
def cohort_members(t: Tables) -> DataFrame:
    return cohort.members(_docs(t), SPEC).select("doc_id", "lang", "source", "n_chars")


@query(f"""
WITH {_D}, m AS (SELECT *, coalesce(quality = 1 AND toxic = 0 AND n_chars >= 200, false) AS m FROM d),
u AS (SELECT 'lang' AS attribute, coalesce(lang, 'unknown') AS value, m FROM m UNION ALL SELECT 'source', coalesce(source, 'unknown'), m FROM m),
g AS (SELECT attribute, value, count(*) FILTER (m) / (SELECT count(*) FROM m WHERE m)::double AS c, count(*) / (SELECT count(*) FROM m)::double AS a FROM u GROUP BY 1, 2)
SELECT attribute, value, round(c, 4) AS cohort_share, round(a, 4) AS archive_share, round(c - a, 4) AS delta FROM g""")
def cohort_shift(t: Tables) -> DataFrame:
    d = _docs(t).withColumn("m", F.coalesce(F.expr("quality = 1 and toxic = 0 and n_chars >= 200"), F.lit(False)))
    return cohort.shift(d, "m", ("lang", "source"))


@query("SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels l USING (doc_id)")
def fusion_join(t: Tables) -> DataFrame:
    return fusion.fuse(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query("""
WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT a.n AS na, b.n AS nb FROM a FULL JOIN b USING (k))
SELECT sum(na)::bigint AS n_images, sum(nb)::bigint AS n_reports, sum(na * nb)::bigint AS n_joined, count(*) FILTER (nb IS NULL) AS n_orphan_images, count(*) FILTER (na IS NULL) AS n_orphan_reports,
  round(sum(na * nb) / sum(na)::double, 4) AS join_rate, sum(na * nb) / sum(na)::double < 0.95 AS low FROM j""")
def fusion_stats(t: Tables) -> DataFrame:
    return fusion.join_stats(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fusion_orphans(t: Tables) -> DataFrame:
    return fusion.orphans(t.documents, t.labels, "doc_id")


def _states(t: Tables) -> DataFrame:
    doubt = F.col("doc_id") % 7 == 0
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", *(F.when(F.col(c).isNotNull() & doubt, -1).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")))


_S = "s AS (SELECT doc_id, CASE WHEN quality IS NOT NULL AND doc_id % 7 = 0 THEN -1 ELSE quality END AS quality, CASE WHEN toxic IS NOT NULL AND doc_id % 7 = 0 THEN -1 ELSE toxic END AS toxic FROM documents LEFT JOIN labels USING (doc_id))"


def _binary_sql(doubt: str) -> str:
    return f"WITH {_S} SELECT doc_id, " + ", ".join(f"CASE WHEN {c} = 1 THEN 1.0::double WHEN {c} = -1 THEN {doubt} ELSE 0.0::double END AS {c}" for c in ("quality", "toxic")) + " FROM s"


@query(_binary_sql("0.0::double"))
def binarise_zeros(t: Tables) -> DataFrame:
    return fusion.binarise_labels(_states(t), ("quality", "toxic"), "zeros")


@query(_binary_sql("1.0::double"))
def binarise_ones(t: Tables) -> DataFrame:
    return fusion.binarise_labels(_states(t), ("quality", "toxic"), "ones")


@query(_binary_sql("NULL::double"))
def binarise_ignore(t: Tables) -> DataFrame:
    """The operator gives NaN; the query shows null, which every engine compares alike."""
    return fusion.binarise_labels(_states(t), ("quality", "toxic"), "ignore").replace(float("nan"), None)


@query(f"WITH {_S} " + " UNION ALL ".join(f"SELECT '{c}' AS finding, count(*) FILTER ({c} = 1) AS positive, count(*) FILTER ({c} = 0) AS negative, count(*) FILTER ({c} = -1) AS uncertain, count(*) FILTER ({c} IS NULL) AS not_mentioned, round(count(*) FILTER ({c} = 1) / count(*)::double, 4) AS prevalence FROM s" for c in ("quality", "toxic")))
def label_prevalence(t: Tables) -> DataFrame:
    return fusion.prevalence(_states(t), ("quality", "toxic"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS study_order, count(*) OVER (PARTITION BY o_custkey) AS n_studies, o_orderstatus FROM orders")
def patient_timeline(t: Tables) -> DataFrame:
    return fusion.timeline(t.orders, "o_custkey", "o_orderkey", ("o_orderstatus",))


_POS = "row_number() OVER (PARTITION BY {s} ORDER BY md5('42:' || {k}), {k}) - 1 AS pos, count(*) OVER (PARTITION BY {s}) AS n"


@query(f"""
WITH p AS (SELECT c_custkey, {_POS.format(s="1", k="c_custkey")} FROM (SELECT DISTINCT c_custkey FROM customer)),
s AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(1, round_even(n * 0.7::double, 0)::bigint), n - 2) ELSE n END AS t, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15::double, 0)::bigint) ELSE 0 END AS v FROM p)
SELECT c_custkey, CASE WHEN pos < t THEN 'train' WHEN pos < t + v THEN 'val' ELSE 'test' END AS split FROM s""")
def split_grouped(t: Tables) -> DataFrame:
    return split.split_grouped(t.customer, "c_custkey")


_STRATA = """m AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1), e AS (SELECT quantile_cont(m, 1 / 3.0::double) AS lo, quantile_cont(m, 2 / 3.0::double) AS hi, count(DISTINCT m) AS d FROM m),
st AS (SELECT k, CASE WHEN m IS NULL OR d < 3 THEN 'all' WHEN m <= lo THEN 'low' WHEN m <= hi THEN 'mid' ELSE 'high' END AS stratum FROM m, e)"""
_SPLIT = f"""{_STRATA}, p AS (SELECT k, stratum, {_POS.format(s="stratum", k="k")} FROM st),
a AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.7::double, 0)::bigint, n - 2)) ELSE round_even(n * 0.7::double, 0)::bigint END AS t FROM p),
b AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.15::double, 0)::bigint, n - t - 1)) ELSE round_even(n * 0.15::double, 0)::bigint END AS v FROM a),
sp AS (SELECT k AS o_custkey, stratum, CASE WHEN pos < t THEN 'train' WHEN pos < t + v THEN 'val' ELSE 'test' END AS split FROM b)"""


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def split_stratified(t: Tables) -> DataFrame:
    return split.split_stratified(t.orders, "o_custkey", "o_totalprice")


@query(f"""WITH {_SPLIT}, g AS (SELECT split, count(DISTINCT o_custkey) AS a, count(*) AS b, round(avg(o_totalprice), 1) AS c, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS d FROM orders JOIN sp USING (o_custkey) GROUP BY 1)
SELECT split, coalesce(a, 0) AS n_subjects, coalesce(b, 0) AS n_series, coalesce(c, 0) AS mean_burden, coalesce(d, '') AS modalities FROM (SELECT unnest(['train', 'val', 'test']) AS split) LEFT JOIN g USING (split)""")
def split_summary(t: Tables) -> DataFrame:
    return split.summary(t.orders, split.split_stratified(t.orders, "o_custkey", "o_totalprice"), "o_custkey", "o_orderpriority", "o_totalprice")


def _cut_sql(strata: str) -> str:
    """Stratified splits of ``st`` (k, stratum)."""
    return f"""{strata}, p AS (SELECT k, stratum, {_POS.format(s="stratum", k="k")} FROM st),
a AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.7::double, 0)::bigint, n - 2)) ELSE round_even(n * 0.7::double, 0)::bigint END AS t FROM p),
b AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.15::double, 0)::bigint, n - t - 1)) ELSE round_even(n * 0.15::double, 0)::bigint END AS v FROM a),
sp AS (SELECT k, stratum, CASE WHEN pos < t THEN 'train' WHEN pos < t + v THEN 'val' ELSE 'test' END AS split FROM b)"""


_FIRST = "st AS (SELECT o_custkey AS k, coalesce(min_by(v, o_orderkey) FILTER (v IS NOT NULL), 'all') AS stratum FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS v FROM orders) GROUP BY 1)"


@query(f"WITH {_cut_sql(_FIRST)} SELECT k AS o_custkey, stratum, split FROM sp")
def split_by_category(t: Tables) -> DataFrame:
    """Strata are the priorities of the first order that has one."""
    d = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("v"))
    return split.split_stratified(d, "o_custkey", "v", order="o_orderkey")


_LEAKY = f"{_SPLIT}, w AS (SELECT o_custkey, split FROM sp UNION ALL SELECT o_custkey, 'val' FROM sp WHERE o_custkey % 11 = 0)"


@query(f"WITH {_LEAKY}, l AS (SELECT o_custkey, count(DISTINCT split) AS n FROM w GROUP BY 1) SELECT (SELECT count(*) FROM (SELECT o_custkey FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n_leaks, count(*) FILTER (n > 1) AS n_leaks_planted, count(*) AS n_subjects FROM l")
def split_leakage(t: Tables) -> DataFrame:
    """Leaks of the assignment, and of one in which each eleventh subject is in val as well."""
    s = split.split_stratified(t.orders, "o_custkey", "o_totalprice").select("o_custkey", "split")
    planted = s.unionByName(s.where("o_custkey % 11 = 0").select("o_custkey", F.lit("val").alias("split")))
    n = lambda d, name: split.leaks(d, "o_custkey").agg(F.count("*").alias(name))
    return n(s, "n_leaks").crossJoin(n(planted, "n_leaks_planted")).crossJoin(s.agg(F.count_distinct("o_custkey").alias("n_subjects")))


@query("""
WITH r AS (SELECT unnest(range(1, 41))::bigint AS n), a AS (SELECT n, round_even(n * 0.7::double, 0)::bigint AS t, round_even(n * 0.15::double, 0)::bigint AS v FROM r),
b AS (SELECT n, CASE WHEN n >= 3 THEN greatest(1, least(t, n - 2)) ELSE t END AS strat_train, v, CASE WHEN n >= 3 THEN least(greatest(1, t), n - 2) ELSE n END AS group_train, CASE WHEN n >= 3 THEN greatest(1, v) ELSE 0 END AS group_val FROM a)
SELECT n, strat_train, CASE WHEN n >= 3 THEN greatest(1, least(v, n - strat_train - 1)) ELSE v END AS strat_val, group_train, group_val FROM b""")
def split_small_rule(t: Tables) -> DataFrame:
    d = t.spark.range(1, 41).withColumnRenamed("id", "n")
    (a, b), (c, e) = split.allocate_stratified(F.col("n")), split.allocate_grouped(F.col("n"))
    return d.select("n", a.alias("strat_train"), b.alias("strat_val"), c.alias("group_train"), e.alias("group_val"))


@query(f"WITH {_SPLIT} SELECT c_custkey, coalesce(split, 'unassigned') AS split FROM customer LEFT JOIN sp ON c_custkey = o_custkey")
def split_assign(t: Tables) -> DataFrame:
    s = split.split_stratified(t.orders, "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    return split.assign(t.customer.select("c_custkey"), s, "c_custkey")
