"""Queries of bias audits and quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bias, quality
from .registry import Tables, query

_LANG = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
_SEG = {"AUTOMOBILE": 0.2, "BUILDING": 0.2, "FURNITURE": 0.2, "HOUSEHOLD": 0.2, "MACHINERY": 0.2}


def _rep_sql(table: str, column: str, ref: dict[str, float] | None) -> str:
    values = ", ".join(f"('{k}', {v}::double)" for k, v in ref.items()) if ref else "(NULL::varchar, NULL::double)"
    return f"""
SELECT '{column}' AS attribute, 'representation' AS kind, total::bigint AS total, k AS n_values, top, round(topn / total::double, 4) AS top_share,
  round(stat, 4) AS statistic, CASE WHEN stat IS NOT NULL THEN kr - 1 END AS df, round(sqrt(stat / (obs * greatest(kr - 1, 1))), 4) AS effect_size, topn / total::double > 0.5 AND k > 1 AS dominates
FROM (SELECT *, CASE WHEN kr > 1 AND least_e >= 5 THEN stat0 END AS stat FROM (
  SELECT sum(n) AS total, count(*) AS k, max(n) AS topn, (SELECT min(value) FROM c0 WHERE n = (SELECT max(n) FROM c0)) AS top, sum(n) FILTER (w IS NOT NULL) AS obs, count(w) AS kr,
    sum((n - e) * (n - e) / e) AS stat0, min(e) AS least_e FROM (
      WITH c0 AS (SELECT coalesce({column}, 'unknown') AS value, count(*) AS n FROM {table} GROUP BY 1), r AS (SELECT * FROM (VALUES {values}) AS r(value, w))
      SELECT c0.*, w, w / sum(w) OVER () * sum(CASE WHEN w IS NOT NULL THEN n END) OVER () AS e FROM c0 LEFT JOIN r USING (value)),
  ))""".replace("FROM c0 WHERE n = (SELECT max(n) FROM c0)", f"FROM (SELECT coalesce({column}, 'unknown') AS value, count(*) AS n FROM {table} GROUP BY 1) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY coalesce({column}, 'unknown')))").replace("),\n  ))", ")))")


@query(_rep_sql("documents", "lang", _LANG))
def bias_representation_lang(t: Tables) -> DataFrame:
    return bias.representation(t.documents, "lang", _LANG)


@query(_rep_sql("customer", "c_mktsegment", _SEG))
def bias_representation_segment(t: Tables) -> DataFrame:
    return bias.representation(t.customer, "c_mktsegment", _SEG)


@query(_rep_sql("documents", "source", None))
def bias_representation_source(t: Tables) -> DataFrame:
    return bias.representation(t.documents, "source")


def _dis_sql(table: str, group: str, outcome: str) -> str:
    return f"""
WITH d0 AS (SELECT coalesce({group}, 'unknown') AS g, {outcome}::double AS v FROM {table} WHERE {outcome} IS NOT NULL), big AS (SELECT g, median(v) AS med FROM d0 GROUP BY g HAVING count(*) >= 2),
d AS (SELECT d0.* FROM d0 JOIN big USING (g)), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::double AS r FROM d),
q AS (SELECT sum(rs * rs / n) AS q, sum(n)::double AS n FROM (SELECT g, sum(r) AS rs, count(*)::double AS n FROM r GROUP BY g)), tie AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT count(*)::double AS t FROM d GROUP BY v)),
m AS (SELECT count(*) AS k, min(med) AS lo, max(med) AS hi FROM big)
SELECT '{group}' AS attribute, 'disparity' AS kind, '{outcome}' AS outcome, k AS n_groups, round(lo, 4) AS lo, round(hi, 4) AS hi,
  round(CASE WHEN k >= 2 AND 1 - tie / (n * n * n - n) > 0 THEN (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) END, 4) AS statistic,
  CASE WHEN k >= 2 AND 1 - tie / (n * n * n - n) > 0 THEN k - 1 END AS df, round(CASE WHEN k >= 2 AND lo > 0 THEN hi / lo END, 4) AS effect_size FROM m, q, tie"""


@query(_dis_sql("customer", "c_mktsegment", "c_acctbal"))
def bias_disparity_balance(t: Tables) -> DataFrame:
    return bias.disparity(t.customer, "c_mktsegment", "c_acctbal")


@query(_dis_sql("documents", "lang", "n_chars"))
def bias_disparity_length(t: Tables) -> DataFrame:
    return bias.disparity(t.documents, "lang", "n_chars")


@query("SELECT coalesce(event_type, 'unknown') AS value, count(*) AS n FROM events GROUP BY 1")
def category_counts(t: Tables) -> DataFrame:
    return bias.value_counts(t.events, "event_type")


def _studies(t: Tables) -> DataFrame:
    """Embeddings as studies: values are the volume, metadata is planted by id."""
    i = F.col("vec_id")
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 100 + 50, 3))
    v = F.when(i % 23 == 0, F.transform(v, lambda x: F.lit(7.0))).when(i % 29 != 0, v)
    return t.embeddings.select(
        F.col("vec_id").alias("patient_id"),
        F.when(i % 5 != 0, (i % 90).cast("double")).alias("age"),
        F.when(i % 7 == 0, "").otherwise("F").alias("sex"),
        F.when(i % 2 == 0, "A").alias("institution"),
        F.lit("GE").alias("scanner"),
        F.when(i % 11 == 0, F.array(F.lit(1.0), F.lit(1.0))).when(i % 13 == 0, F.array(F.lit(0.5), F.lit(1.0), F.lit(6.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0), F.lit(2.5))).alias("voxel_spacing"),
        F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(4), F.lit(4), F.lit(4))).alias("shape"),
        v.alias("volume"),
    )


_Q = """s AS (SELECT vec_id AS i, CASE WHEN vec_id % 23 = 0 THEN list_transform(embedding, lambda x: 7.0::double) WHEN vec_id % 29 <> 0 THEN list_transform(embedding, lambda x: round(x::double * 100 + 50, 3)) END AS v FROM embeddings),
u AS (SELECT i, unnest(v) AS x FROM s), p AS (SELECT i, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.6) AS p60, quantile_cont(x, 0.75) AS p75, max(x) - min(x) AS span FROM u GROUP BY i),
fg AS (SELECT i, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM u JOIN p USING (i) WHERE x > p60 GROUP BY i),
c AS (SELECT s.i, CASE WHEN v IS NULL OR span = 0 THEN 0.0::double ELSE 1.0::double END AS integrity,
  1 - ((s.i % 5 = 0)::int + (s.i % 7 = 0)::int + (s.i % 2 <> 0)::int + (s.i % 3 = 0)::int) / 7.0::double AS metadata,
  CASE WHEN s.i % 11 = 0 THEN 0.0::double WHEN s.i % 13 = 0 THEN 0.0::double ELSE 0.5::double * (1 - 1.5::double / 5) + 0.5::double * (1 - 1.5::double / 5) END AS spacing,
  CASE WHEN v IS NULL THEN 0.0::double WHEN n >= 10 AND sd > 0 THEN least(1.0::double, abs(m) / (sd + 1e-8::double) / 10) ELSE 0.5::double END AS noise,
  CASE WHEN v IS NULL OR span = 0 THEN 0.0::double ELSE least(1.0::double, (p75 - p25) / (0.25::double * span)) END AS contrast
  FROM s LEFT JOIN p USING (i) LEFT JOIN fg USING (i)),
q AS (SELECT *, 100 * (0.30::double * integrity + 0.15::double * metadata + 0.15::double * spacing + 0.15::double * noise + 0.15::double * contrast + 0.10::double) AS score FROM c)"""
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END"


@query(f"WITH {_Q} SELECT i AS patient_id, round(score, 2) AS q_score, round(integrity, 3) AS q_integrity, round(metadata, 3) AS q_metadata, round(spacing, 3) AS q_spacing, round(noise, 3) AS q_noise, round(contrast, 3) AS q_contrast, 1.0::double AS q_continuity, {_GRADE} AS q_grade FROM q")
def quality_components(t: Tables) -> DataFrame:
    s = quality.score_studies(_studies(t))
    return s.select("patient_id", "q_score", *(f"q_{k}" for k in quality.WEIGHTS), "q_grade")


@query(f"WITH {_Q} SELECT {_GRADE} AS grade, count(*) AS n FROM q GROUP BY 1")
def quality_grades(t: Tables) -> DataFrame:
    return quality.score_studies(_studies(t)).groupBy(F.col("q_grade").alias("grade")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
d AS (SELECT label, list_sum(list_transform(list_zip(embedding, p), lambda z: abs(z[1]::double - z[2]::double))) / len(embedding) AS d FROM s WHERE p IS NOT NULL),
m AS (SELECT label, median(d) AS med, avg(d) AS mean, count(*) AS n FROM d GROUP BY 1), a AS (SELECT label, median(abs(d - med)) + 1e-8::double AS mad FROM d JOIN m USING (label) GROUP BY 1)
SELECT label, round(CASE WHEN any_value(n) < 2 THEN 1.0::double WHEN any_value(mean) = 0 THEN 0.0::double ELSE greatest(0.0::double, least(1.0::double, 1 - (0.15::double * count(*) FILTER (d < 1e-6) + 0.10::double * count(*) FILTER (abs(d - med) > 8 * mad)))) END, 4) AS continuity
FROM d JOIN m USING (label) JOIN a USING (label) GROUP BY 1""")
def slice_continuity(t: Tables) -> DataFrame:
    d = quality.slice_differences(t.embeddings, "label", "vec_id", "embedding")
    return quality.with_continuity(d, "diffs", "c").select("label", F.round("c", 4).alias("continuity"))


@query("""
WITH c AS (SELECT lang AS r, source AS c, count(*)::double AS n FROM documents GROUP BY ALL), nr AS (SELECT r, sum(n) AS nr FROM c GROUP BY 1), nc AS (SELECT c, sum(n) AS nc FROM c GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
g AS (SELECT nr.r, nc.c, coalesce(c.n, 0) AS n, nr * nc / total AS e FROM nr CROSS JOIN nc CROSS JOIN t LEFT JOIN c ON c.r IS NOT DISTINCT FROM nr.r AND c.c IS NOT DISTINCT FROM nc.c),
x AS (SELECT sum((n - e) * (n - e) / e) AS chi FROM g)
SELECT total::bigint AS n, round(chi, 4) AS statistic, round(sqrt(chi / (total * greatest(least((SELECT count(*) FROM nr), (SELECT count(*) FROM nc)) - 1, 1))), 4) AS effect_size FROM x, t""")
def bias_cramers_two_way(t: Tables) -> DataFrame:
    return bias.cramers_v(t.documents, "lang", "source")


@query(" UNION ALL ".join(f"SELECT * FROM ({_rep_sql('documents', c, r)})" for c, r in (("lang", _LANG), ("source", None))))
def bias_representations(t: Tables) -> DataFrame:
    """All attributes of the audit in one scan."""
    return bias.representations(t.documents, ["lang", "source"], {"lang": _LANG}).where("held").drop("held")
