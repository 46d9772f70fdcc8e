"""Queries on record fields: normalisation, nesting, ages, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import fusion
from .registry import Tables, query


@query("""
SELECT doc_id, lower(trim(lang)) AS modality,
  CASE WHEN source IS NULL THEN NULL WHEN upper(substr(trim(source), 1, 1)) IN ('M', 'F') THEN upper(substr(trim(source), 1, 1)) ELSE 'U' END AS sex,
  CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::double) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::double) ELSE printf('%.1f MB', n_chars / 1048576.0::double) END AS size,
  CASE WHEN starts_with('raw/' || source || '/' || doc_id, 'raw/') THEN substr('raw/' || source || '/' || doc_id, 5) END AS path
FROM documents""")
def manifest_normalise(t: Tables) -> DataFrame:
    p = F.concat_ws("/", F.lit("raw"), "source", F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", S.normalise_modality(F.col("lang")).alias("modality"), S.normalise_sex(F.col("source")).alias("sex"), S.human_size(F.col("n_chars")).alias("size"), S.relative_to(p, "raw").alias("path"))


@query("""
SELECT vec_id, len(embedding)::bigint AS n, round(list_sum(list_transform(embedding, lambda x: round(x::double, 4))), 2) AS total FROM embeddings""")
def manifest_nested_roundtrip(t: Tables) -> DataFrame:
    text = S.encode_nested(F.transform("embedding", lambda x: F.round(x.cast("double"), 4)))
    back = S.decode_list(text)
    return t.embeddings.select("vec_id", F.size(back).cast("long").alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


_AGE = "CASE p_partkey % 6 WHEN 0 THEN lpad(p_size::varchar, 3, '0') || 'Y' WHEN 1 THEN lpad(p_size::varchar, 3, '0') || 'M' WHEN 2 THEN lpad(p_size::varchar, 3, '0') || 'W' WHEN 3 THEN p_size || 'd' WHEN 4 THEN p_size::varchar ELSE 'x' || p_size END"


@query(f"""
WITH a AS (SELECT p_partkey, upper(trim({_AGE})) AS raw FROM part)
SELECT p_partkey, round(try_cast(regexp_replace(raw, '[YMWD]$', '') AS double) / CASE right(raw, 1) WHEN 'M' THEN 12.0::double WHEN 'W' THEN 52.0::double WHEN 'D' THEN 365.0::double ELSE 1.0::double END, 6) AS age FROM a""")
def parse_age(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lpad(n, 3, "0"), F.lit("Y"))).when(k == 1, F.concat(F.lpad(n, 3, "0"), F.lit("M"))).when(k == 2, F.concat(F.lpad(n, 3, "0"), F.lit("W"))).when(k == 3, F.concat(n, F.lit("d"))).when(k == 4, n).otherwise(F.concat(F.lit("x"), n))
    return t.part.select("p_partkey", F.round(S.parse_age(raw), 6).alias("age"))


@query("""
SELECT CASE WHEN a >= 0 AND a < 40 THEN '<40' WHEN a >= 40 AND a < 60 THEN '40-59' WHEN a >= 60 AND a < 80 THEN '60-79' WHEN a >= 80 AND a < 200 THEN '80+' ELSE 'unknown' END AS age_band, count(*) AS n
FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 5.0::double END AS a FROM part) GROUP BY 1""")
def age_band_counts(t: Tables) -> DataFrame:
    a = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") * 5.0)
    return t.part.groupBy(S.age_band(a).alias("age_band")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events WHERE upper(coalesce(event_type, '')) IN ('CLICK', 'PURCHASE')")
def views_filter(t: Tables) -> DataFrame:
    return fusion.filter_views(t.events.select("event_id", "user_id", "event_type"), "event_type", ("click", "purchase"))


@query("""
SELECT doc_id, CASE WHEN m = '' THEN NULL ELSE lower(m) END AS modality FROM (
  SELECT doc_id, regexp_extract(f, '(?i)_(flair|seg|t1ce|t1|t2)\\.nii(\\.gz)?$', 1) AS m FROM (
    SELECT doc_id, 'sub' || doc_id || CASE doc_id % 7 WHEN 0 THEN '_t1.nii' WHEN 1 THEN '_T1CE.nii.gz' WHEN 2 THEN '_t2.nii.gz' WHEN 3 THEN '_flair.NII' WHEN 4 THEN '_seg.nii.gz' WHEN 5 THEN '.nii' ELSE '_t1ce.txt' END AS f FROM documents))""")
def parse_modality(t: Tables) -> DataFrame:
    ends = ("_t1.nii", "_T1CE.nii.gz", "_t2.nii.gz", "_flair.NII", "_seg.nii.gz", ".nii", "_t1ce.txt")
    f = F.concat(F.lit("sub"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % 7 + 1).cast("int")))
    return t.documents.select("doc_id", S.file_modality(f).alias("modality"))


@query("""
SELECT json_extract_string(props, '$.k')::bigint AS k, count(*) AS n FROM events GROUP BY 1""")
def json_field_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))
