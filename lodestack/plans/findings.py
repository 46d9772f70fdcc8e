"""Queries of the quality-control engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import qc
from .registry import Tables, query

_EXPECTED = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _doc_rules():
    n = F.col("n_chars")
    return {
        "file_readable": qc.emit(F.col("text").isNull() | (n == 0), "ERROR", "text is empty"),
        "dimensions": qc.emit(n < 100, "ERROR", F.concat(F.lit("length "), n.cast("string"), F.lit(" below minimum 100"))),
        "orientation": qc.emit(F.lower("lang") != "en", "WARN", F.concat(F.lit("language "), F.col("lang"))),
        "spacing": qc.emit(n > 20000, "WARN", F.concat(F.lit("length "), n.cast("string"), F.lit(" exceeds 20000"))),
        "missing_mask": qc.emit(F.col("quality").isNull(), "WARN", "no label"),
        "empty_mask": qc.emit((F.col("quality") == 0) & (F.col("toxic") == 1), "ERROR", "label rejects the document"),
    }


def _docs(t: Tables) -> DataFrame:
    lab = t.labels.select("doc_id", "quality", "toxic")
    return t.documents.join(lab, "doc_id", "left").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))


def _doc_findings(t: Tables) -> DataFrame:
    return qc.run_rules(_docs(t), _doc_rules(), owner="source", item="lang", path="path")


_D = "d AS (SELECT d.*, l.quality, l.toxic, 'doc/' || d.doc_id AS path FROM documents d LEFT JOIN labels l USING (doc_id))"
_F = f"""{_D}, f AS (
  SELECT source AS patient_id, lang AS modality, 'file_readable' AS "check", 'ERROR' AS severity, 'text is empty' AS message, path AS filepath FROM d WHERE text IS NULL OR n_chars = 0
  UNION ALL SELECT source, lang, 'dimensions', 'ERROR', 'length ' || n_chars || ' below minimum 100', path FROM d WHERE n_chars < 100
  UNION ALL SELECT source, lang, 'orientation', 'WARN', 'language ' || lang, path FROM d WHERE lower(lang) <> 'en'
  UNION ALL SELECT source, lang, 'spacing', 'WARN', 'length ' || n_chars || ' exceeds 20000', path FROM d WHERE n_chars > 20000
  UNION ALL SELECT source, lang, 'missing_mask', 'WARN', 'no label', path FROM d WHERE quality IS NULL
  UNION ALL SELECT source, lang, 'empty_mask', 'ERROR', 'label rejects the document', path FROM d WHERE quality = 0 AND toxic = 1)"""


@query(f"WITH {_F} SELECT * FROM f")
def qc_all_rules(t: Tables) -> DataFrame:
    return _doc_findings(t)


@query(f"""WITH {_F} SELECT * FROM f WHERE "check" IN ('dimensions', 'spacing')""")
def qc_some_rules(t: Tables) -> DataFrame:
    rules = _doc_rules()
    return qc.run_rules(_docs(t), {k: rules[k] for k in ("dimensions", "spacing")}, owner="source", item="lang", path="path")


def _volumes(t: Tables) -> DataFrame:
    """Embeddings as 4 x 4 x 4 volumes with defects planted by id."""
    v, i = F.col("embedding").cast("array<double>"), F.col("vec_id")
    n = F.lit(64.0)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    wild = F.when(i % 13 == 0, float("nan")).otherwise(F.array_max(v))
    return t.embeddings.select(
        F.concat(F.lit("v"), i.cast("string")).alias("patient_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("modality"),
        F.concat(F.lit("vec/"), i.cast("string")).alias("filepath"),
        (i % 17 != 0).alias("file_exists"),
        F.when(i % 19 == 0, 0).otherwise(256).alias("file_size_bytes"),
        F.when(i % 11 != 0, F.array_min(v)).alias("intensity_min"),
        wild.alias("intensity_max"),
        mean.alias("intensity_mean"),
        F.when(i % 23 == 0, 0.0).otherwise(1.0).alias("intensity_std"),
        F.when(i % 29 == 0, F.array(F.lit(4), F.lit(4))).when(i % 31 == 0, F.array(F.lit(4), F.lit(4), F.lit(2))).when(i % 37 != 0, F.array(F.lit(4), F.lit(4), F.lit(4))).alias("shape"),
        F.when(i % 7 == 0, "las").otherwise("RAS").alias("orientation"),
        F.when(i % 41 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))).when(i % 43 == 0, F.array(F.lit(1.0), F.lit(6.5), F.lit(1.0))).when(i % 47 != 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0))).alias("voxel_spacing"),
        (i % 5 != 0).alias("mask_available"),
        F.when(i % 3 == 0, 10.0).otherwise(100.0).alias("tumor_volume_mm3"),
    )


_CFG = qc.QCConfig(min_shape=(4, 4, 4))
_V = """v AS (SELECT 'v' || vec_id AS patient_id, 'c' || label AS modality, 'vec/' || vec_id AS filepath, vec_id AS i FROM embeddings),
f AS (
  SELECT patient_id, modality, 'file_readable' AS "check", 'ERROR' AS severity, CASE WHEN i % 17 = 0 THEN 'file missing: ' || filepath ELSE 'file is zero bytes' END AS message, filepath FROM v WHERE i % 17 = 0 OR i % 19 = 0
  UNION ALL SELECT patient_id, modality, 'corrupt_volume', 'ERROR', CASE WHEN i % 11 = 0 THEN 'intensity statistics unavailable' ELSE 'non-finite intensity values' END, filepath FROM v WHERE i % 11 = 0 OR i % 13 = 0
  UNION ALL SELECT patient_id, modality, 'empty_volume', 'ERROR', 'volume is constant (zero variance)', filepath FROM v WHERE i % 23 = 0
  UNION ALL SELECT patient_id, modality, 'dimensions', 'ERROR', CASE WHEN i % 29 = 0 THEN 'expected 3D volume, got 2D' WHEN i % 31 = 0 THEN 'shape [4, 4, 2] below minimum [4, 4, 4]' ELSE 'shape unavailable' END, filepath FROM v WHERE i % 29 = 0 OR i % 31 = 0 OR i % 37 = 0
  UNION ALL SELECT patient_id, modality, 'orientation', 'WARN', 'orientation las != expected RAS', filepath FROM v WHERE i % 7 = 0
  UNION ALL SELECT patient_id, modality, 'spacing', CASE WHEN i % 41 = 0 THEN 'ERROR' ELSE 'WARN' END, CASE WHEN i % 41 = 0 THEN 'non-positive voxel spacing [1.0, 0.0, 1.0]' WHEN i % 43 = 0 THEN 'coarse spacing [1.0, 6.5, 1.0] mm exceeds 5.0 mm' ELSE 'voxel spacing unavailable' END, filepath FROM v WHERE i % 41 = 0 OR i % 43 = 0 OR i % 47 = 0
  UNION ALL SELECT patient_id, modality, 'missing_mask', 'WARN', 'no segmentation mask for this subject', filepath FROM v WHERE i % 5 = 0
  UNION ALL SELECT patient_id, modality, 'empty_mask', 'ERROR', 'mask has ~' || CASE WHEN i % 43 = 0 AND i % 41 <> 0 THEN '2' ELSE '5' END || ' labelled voxels, below minimum 10', filepath FROM v WHERE i % 5 <> 0 AND i % 3 = 0 AND i % 41 <> 0 AND NOT (i % 47 = 0 AND i % 43 <> 0))"""


@query(f"WITH {_V} SELECT * FROM f")
def qc_volume_rules(t: Tables) -> DataFrame:
    return qc.run_rules(_volumes(t), cfg=_CFG)


@query("""
WITH d AS (SELECT *, sha256(text) AS sha FROM documents), g AS (SELECT sha, min(source) AS a, max(source) AS b FROM d GROUP BY sha HAVING count(*) > 1)
SELECT source AS patient_id, lang AS modality, 'duplicate_content' AS "check", CASE WHEN a = b THEN 'WARN' WHEN source = a THEN 'INFO' ELSE 'ERROR' END AS severity,
  CASE WHEN a = b THEN 'same content more than once for this owner' WHEN source = a THEN 'content shared with other owners; retained' ELSE 'content identical to that of ' || a END AS message, 'doc/' || doc_id AS filepath
FROM d JOIN g USING (sha)""")
def qc_duplicate_content(t: Tables) -> DataFrame:
    d = t.documents.select("source", "lang", F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return qc.duplicate_content(d, owner="source", item="lang", path="path")


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS occurrence FROM lineitem QUALIFY occurrence > 1""")
def qc_duplicate_series(t: Tables) -> DataFrame:
    d = qc.duplicate_series(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_orderkey", "l_linenumber", ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return d.withColumn("occurrence", F.col("occurrence").cast("long"))


@query(f"""
WITH e AS (SELECT unnest([{", ".join(repr(x.lower()) for x in _EXPECTED)}]) AS p), c AS (SELECT DISTINCT o_custkey FROM orders),
m AS (SELECT o_custkey, p FROM c, e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND lower(o.o_orderpriority) = e.p))
SELECT o_custkey, string_agg(p, ',' ORDER BY p) AS missing FROM m GROUP BY 1""")
def qc_missing_modalities(t: Tables) -> DataFrame:
    m = qc.missing_sets(t.orders, _EXPECTED, "o_custkey", "o_orderpriority")
    return m.select("o_custkey", F.array_join("missing", ",").alias("missing"))


@query("""
SELECT conv_id, string_agg(r, ',' ORDER BY r) AS missing FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['assistant', 'system', 'user']) AS r)
WHERE (conv_id, r) NOT IN (SELECT conv_id, lower(role) FROM conversations) GROUP BY 1""")
def qc_missing_roles(t: Tables) -> DataFrame:
    m = qc.missing_sets(t.conversations, ("user", "assistant", "system"), "conv_id", "role")
    return m.select("conv_id", F.array_join("missing", ",").alias("missing"))


@query(f"""
WITH {_F}, r AS (SELECT source, lang, max(CASE severity WHEN 'ERROR' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS w, string_agg(DISTINCT "check", ',' ORDER BY "check") AS flags FROM (SELECT DISTINCT source, lang FROM d) JOIN f ON source = patient_id AND lang = modality GROUP BY 1, 2)
SELECT doc_id, CASE coalesce(w, 0) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS qc_status, coalesce(flags, '') AS qc_flags FROM d LEFT JOIN r USING (source, lang)""")
def qc_apply_findings(t: Tables) -> DataFrame:
    a = qc.apply_findings(t.documents.select("doc_id", "source", "lang"), _doc_findings(t), owner="source", item="lang")
    return a.select("doc_id", "qc_status", F.array_join("qc_flags", ",").alias("qc_flags"))


@query(f"""
WITH {_V} SELECT (SELECT count(*) FROM v) AS n_records, (SELECT count(DISTINCT patient_id) FROM v) AS n_subjects, count(*) AS n_findings,
  count(*) FILTER (severity = 'ERROR') AS n_errors, count(*) FILTER (severity = 'WARN') AS n_warnings, count(*) FILTER (severity = 'INFO') AS n_infos,
  coalesce(string_agg(DISTINCT patient_id, ',' ORDER BY patient_id) FILTER (severity = 'ERROR'), '') AS failed,
  round(1 - count(DISTINCT CASE WHEN severity = 'ERROR' THEN patient_id END) / (SELECT count(DISTINCT patient_id) FROM v)::double, 6) AS pass_rate FROM f""")
def qc_summary(t: Tables) -> DataFrame:
    v = _volumes(t)
    return qc.summarise(qc.run_rules(v, cfg=_CFG), v).withColumns({"failed": F.array_join("failed", ","), "pass_rate": F.round("pass_rate", 6)})


@query(f"""WITH {_V} SELECT "check", count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1""")
def qc_by_check(t: Tables) -> DataFrame:
    return qc.by_check(qc.run_rules(_volumes(t), cfg=_CFG))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3)""")
def complete_subjects(t: Tables) -> DataFrame:
    return qc.complete_owners(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ("1-URGENT", "2-HIGH", "5-LOW"), "o_custkey", "o_orderpriority").drop("o_orderpriority")


def _tags(t: Tables) -> DataFrame:
    i = F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        F.when(i % 3 == 0, F.col("c_name")).alias("PatientName"),
        F.when(i % 4 == 0, F.lit("  ")).when(i % 5 == 0, F.lit("1 Main St")).alias("PatientAddress"),
        F.when(i % 7 == 0, F.lit("Dr X")).alias("ReferringPhysicianName"),
        i.cast("string").alias("PatientID"),
        F.lit("21000101").alias("StudyDate"),
    )


_TAGS = """g AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 <> 0 THEN 'PatientAddress' END, CASE WHEN c_custkey % 3 = 0 AND trim(c_name) <> '' THEN 'PatientName' END, CASE WHEN c_custkey % 7 = 0 THEN 'ReferringPhysicianName' END], lambda x: x IS NOT NULL) AS l FROM customer)"""


def _flagged(t: Tables) -> DataFrame:
    tags = _tags(t)
    return tags.select("c_custkey", F.array_sort(qc.audit_phi({n: F.col(n) for n in qc.PHI_TAGS if n in tags.columns})).alias("phi_flags"))


@query(f"WITH {_TAGS} SELECT c_custkey, array_to_string(l, ',') AS phi_flags FROM g")
def phi_audit(t: Tables) -> DataFrame:
    return _flagged(t).withColumn("phi_flags", F.array_join("phi_flags", ","))


@query(f"WITH {_TAGS} SELECT count(*) AS n_scanned, count(*) FILTER (len(l) > 0) AS n_flagged, count(*) FILTER (len(l) > 0) = 0 AS clean, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(l) AS x FROM g)) AS tags FROM g")
def phi_summary(t: Tables) -> DataFrame:
    return qc.phi_summary(_flagged(t)).withColumn("tags", F.array_join("tags", ","))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' END AS PatientName, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN '' END AS PatientAddress, CASE WHEN c_custkey % 7 = 0 THEN '' END AS ReferringPhysicianName,
  c_custkey::varchar AS PatientID, '21000101' AS StudyDate, 'YES' AS PatientIdentityRemoved, 'basic profile subset (PS3.15 Annex E)' AS DeidentificationMethod FROM customer""")
def deidentify(t: Tables) -> DataFrame:
    return qc.deidentify(_tags(t))
