"""Queries of releases: entries, hashes, totals, verification, index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, release
from .registry import Tables, query

_D = "d AS (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 19 <> 0 THEN sha256(text) END AS sha, CASE WHEN doc_id % 23 <> 0 THEN n_chars END AS size, source, lang, doc_id FROM documents)"


def _docs(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return t.documents.select(F.concat(F.lit("doc/"), i.cast("string")).alias("path"), F.when(i % 19 != 0, F.sha2("text", 256)).alias("sha"), F.when(i % 23 != 0, F.col("n_chars")).alias("size"), "source", "lang", "doc_id")


def _entries(t: Tables) -> DataFrame:
    return release.file_entries(_docs(t), "path", "sha", "size", "source", "lang")


@query(f"WITH {_D} SELECT path, sha AS sha256, coalesce(size, 0) AS size_bytes, source AS patient_id, lang AS modality FROM d WHERE sha IS NOT NULL")
def release_files(t: Tables) -> DataFrame:
    return _entries(t)


@query(f"WITH {_D} SELECT sha256(string_agg(path || ':' || sha, chr(10) ORDER BY path || ':' || sha)) AS dataset_hash FROM d WHERE sha IS NOT NULL")
def release_hash(t: Tables) -> DataFrame:
    return release.dataset_hash(_entries(t))


@query(f"WITH {_D} SELECT count(sha) AS n_files, count(DISTINCT source) AS n_subjects, sum(CASE WHEN sha IS NOT NULL THEN size END)::bigint AS total_bytes FROM d")
def release_totals(t: Tables) -> DataFrame:
    return release.totals(_docs(t), "sha", "size", "source")


@query("SELECT c::varchar AS label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality = 1 THEN 1 END, CASE WHEN toxic = 1 THEN 2 END], lambda x: x IS NOT NULL)) AS c FROM labels) GROUP BY 1")
def class_balance(t: Tables) -> DataFrame:
    d = t.labels.select(release.label_classes({1: F.col("quality") == 1, 2: F.col("toxic") == 1}).alias("label_classes"))
    return release.class_balance(d, "label_classes")


@query("SELECT lang AS modality, count(*) AS n FROM documents GROUP BY 1")
def modality_counts(t: Tables) -> DataFrame:
    return release.modality_counts(t.documents, "lang")


@query(f"""
WITH {_D}, k AS (SELECT path, CASE WHEN doc_id % 50 = 0 THEN sha256('changed' || doc_id) ELSE sha END AS disk, doc_id FROM d WHERE doc_id % 97 <> 0)
SELECT d.path, CASE WHEN k.path IS NULL THEN 'missing: ' || d.path ELSE 'hash mismatch: ' || d.path || ' (manifest ' || substr(sha, 1, 12) || ', disk ' || substr(disk, 1, 12) || ')' END AS problem
FROM d LEFT JOIN k USING (path) WHERE sha IS NOT NULL AND (k.path IS NULL OR sha IS DISTINCT FROM disk)""")
def release_verify(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    disk = _docs(t).where(i % 97 != 0).select("path", F.when(i % 50 == 0, F.sha2(F.concat(F.lit("changed"), i.cast("string")), 256)).otherwise(F.col("sha")).alias("sha256"))
    return release.verify(_entries(t), disk)


@query("""
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS version, min(o_orderkey) AS n_files, min(o_orderdate)::date::varchar AS created_at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT strftime(o_orderdate, '%Y-%m') AS version, max(o_orderkey) AS n_files, max(o_orderdate)::date::varchar AS created_at FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
u AS (SELECT *, 0 AS k FROM a UNION ALL SELECT *, 1 FROM b)
SELECT version, n_files, created_at FROM u QUALIFY row_number() OVER (PARTITION BY version ORDER BY created_at DESC, k DESC) = 1""")
def release_index_upsert(t: Tables) -> DataFrame:
    v = F.date_format("o_orderdate", "yyyy-MM").alias("version")
    day = lambda f: F.date_format(f("o_orderdate"), "yyyy-MM-dd").alias("created_at")
    a = t.orders.where("o_orderkey % 2 = 0").groupBy(v).agg(F.min("o_orderkey").alias("n_files"), day(F.min))
    b = t.orders.where("o_orderkey % 3 = 0").groupBy(v).agg(F.max("o_orderkey").alias("n_files"), day(F.max))
    return release.upsert_index(a, b)


@query("SELECT CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 65 THEN 'C' WHEN s >= 50 THEN 'D' ELSE 'F' END AS grade, count(*) AS n, round(avg(s), 1) AS mean_score FROM (SELECT p_size * 2.0::double AS s FROM part) GROUP BY 1")
def dataset_card_grades(t: Tables) -> DataFrame:
    return quality.grade_counts(t.part.select((F.col("p_size") * 2.0).alias("s")), "s")


@query("""
SELECT doc_id::varchar AS patient_id, (doc_id % 13)::varchar AS study_uid, array_to_string(list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL), ',') AS classes FROM labels""")
def fusion_release_records(t: Tables) -> DataFrame:
    """Rows of a fusion table as manifest records."""
    d = t.labels.select("doc_id", (F.col("doc_id") % 13).alias("study"), F.col("quality").alias("label_quality"), F.col("toxic").alias("label_toxic"))
    r = release.fusion_records(d, ("quality", "toxic"), "doc_id", "study")
    return r.select("patient_id", "study_uid", F.array_join(F.transform("label_classes", lambda x: x.cast("string")), ",").alias("classes"))
