"""Queries of sources and sinks: each writes a small tree of real files from the tables, and scans it back."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qc
from ..sinks import reports
from ..sources import dicom, files, imaging, manifest, nifti
from .registry import Tables, query


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that executors share; a temporary one where none is set, on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lodestack-", dir=at.removeprefix("file://") if at else None)


def _put(d: DataFrame, root: str, make: Callable[[pd.Series], list[tuple[str, bytes]]]) -> None:
    """Write the files, by path below root, that each row makes."""
    def run(batches):
        for b in batches:
            n = 0
            for r in b.itertuples(index=False):
                for path, raw in make(r):
                    to = os.path.join(root, path)
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with open(to, "wb") as f:
                        f.write(raw)
                    n += 1
            yield pd.DataFrame({"n": [n]})

    d.mapInPandas(run, "n long").agg(F.sum("n")).collect()


@query("""
SELECT doc_id::varchar AS study_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256, length(text) AS n_chars, 'reports' AS parent FROM documents WHERE doc_id % 5 = 0""")
def scan_report_files(t: Tables) -> DataFrame:
    root = _folder(t.spark)
    _put(t.documents.where("doc_id % 5 = 0").select("doc_id", "text"), root, lambda r: [(f"{r.doc_id % 7}/reports/{r.doc_id}.txt", r.text.encode()), (f"{r.doc_id % 7}/reports/{r.doc_id}.log", b"no report")])
    f = files.scan(t.spark, root, ("*.txt",)).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("study_id"), F.col("length").alias("n_bytes"), files.digest(F.col("content")).alias("sha256"), files.part(files.clean_path(F.col("path")), 2).alias("parent"))
    return f.join(files.read_reports(t.spark, root).select("study_id", F.length("text").cast("long").alias("n_chars")), "study_id")


def _volume(r, scale: int = 1000) -> np.ndarray:
    return np.rint(np.array(r.embedding[:64], float).reshape(4, 4, 4) * scale).astype(np.int16)


def _mri_files(r) -> list[tuple[str, bytes]]:
    """A 4 x 4 x 4 image, every third one left-posterior, every fifth one cut short; and a mask but for every fourth."""
    x, a = _volume(r), np.diag([1.0, 2.0, 0.5, 1.0])
    if r.vec_id % 3 == 0:
        x, a = nifti.reorient(x, a, "LPS")
    raw = nifti.write(np.ascontiguousarray(x), a)
    out = [(f"s{r.vec_id}/s{r.vec_id}_t1.nii.gz", raw[:50] if r.vec_id % 5 == 0 else raw)]
    if r.vec_id % 4:
        m = np.where(_volume(r) > 100, 4, np.where(_volume(r) > 0, 1, 0)).astype(np.uint8)
        out.append((f"s{r.vec_id}/s{r.vec_id}_seg.nii.gz", nifti.write(m, np.diag([1.0, 2.0, 0.5, 1.0]))))
    return out


_E = "e AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: round_even(x::double * 1000, 0)) AS v FROM embeddings)"


@query(f"""
WITH {_E}, u AS (SELECT vec_id, unnest(v) AS x FROM e), g AS (SELECT vec_id, min(x) AS lo, max(x) AS hi, avg(x) AS mean, count(*) FILTER (x > 0) AS n, count(*) FILTER (x > 100) AS n4, count(*) FILTER (x > 0 AND x <= 100) AS n1 FROM u GROUP BY 1)
SELECT 's' || vec_id AS patient_id, 's' || vec_id || '/s' || vec_id || '_t1.nii.gz' AS filepath, CASE WHEN vec_id % 5 <> 0 THEN '4x4x4' END AS shape, CASE WHEN vec_id % 5 <> 0 THEN '1.0,2.0,0.5' END AS spacing,
  CASE WHEN vec_id % 5 <> 0 THEN CASE WHEN vec_id % 3 = 0 THEN 'LPS' ELSE 'RAS' END END AS orientation, CASE WHEN vec_id % 5 <> 0 THEN lo END AS intensity_min, CASE WHEN vec_id % 5 <> 0 THEN hi END AS intensity_max, CASE WHEN vec_id % 5 <> 0 THEN round(mean, 4) END AS intensity_mean,
  vec_id % 4 <> 0 AS mask_available, CASE WHEN vec_id % 4 <> 0 AND vec_id % 5 <> 0 THEN n::double END AS tumor_volume_mm3,
  CASE WHEN vec_id % 4 <> 0 AND vec_id % 5 <> 0 THEN array_to_string(list_filter([CASE WHEN n1 > 0 THEN 1 END, CASE WHEN n4 > 0 THEN 4 END], lambda x: x IS NOT NULL), ',') ELSE '' END AS classes FROM g""")
def scan_mri_tree(t: Tables) -> DataFrame:
    root = _folder(t.spark)
    _put(t.embeddings.select("vec_id", "embedding"), root, _mri_files)
    d = imaging.scan_mri(t.spark, root)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return d.select("patient_id", "filepath", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), text("voxel_spacing").alias("spacing"), "orientation", "intensity_min", "intensity_max", F.round("intensity_mean", 4).alias("intensity_mean"), "mask_available", "tumor_volume_mm3", text("label_classes").alias("classes"))


@query(f"""
WITH {_E}, u AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS p, unnest(v) AS x FROM e)
SELECT vec_id, p // 16 AS i, p // 4 % 4 AS j, p % 4 AS k, x::bigint AS x FROM u""")
def volume_reorient(t: Tables) -> DataFrame:
    """Volumes are turned to left-posterior-superior, written, read and turned back."""
    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                y, a = nifti.reorient(_volume(r), np.eye(4), "LPS")
                x, a = nifti.reorient(*nifti.read(nifti.write(np.ascontiguousarray(y), a))[:2], "RAS")
                i, j, k = np.indices(x.shape).reshape(3, -1)
                yield pd.DataFrame({"vec_id": r.vec_id, "i": i, "j": j, "k": k, "x": x.ravel().astype(np.int64)})

    return t.embeddings.select("vec_id", "embedding").mapInPandas(run, "vec_id long, i long, j long, k long, x long")


@query(f"""
WITH {_E}, g AS (SELECT a.i, b.j, c.k FROM range(8) a(i), range(8) b(j), range(8) c(k)), ax AS (SELECT *, floor(i * 3 / 7.0::double + 0.5)::int AS a, floor(j * 3 / 7.0::double + 0.5)::int AS b, floor(k * 3 / 7.0::double + 0.5)::int AS c FROM g)
SELECT vec_id, sum((v[16 * a + 4 * b + c + 1] > 0)::int)::bigint AS n_labelled, sum(CASE WHEN v[16 * a + 4 * b + c + 1] > 0 THEN 64 * i + 8 * j + k ELSE 0 END)::bigint AS places FROM e, ax GROUP BY 1""")
def volume_resample_labels(t: Tables) -> DataFrame:
    """Label maps from 2 mm to 1 mm, by the nearest voxel."""
    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                y, _ = nifti.resample((_volume(r) > 0).astype(np.uint8), np.diag([2.0, 2.0, 2.0, 1.0]), (2, 2, 2), (1, 1, 1), labels=True)
                rows.append((r.vec_id, int(y.sum()), int(np.flatnonzero(y).sum())))
            yield pd.DataFrame(rows, columns=["vec_id", "n_labelled", "places"])

    return t.embeddings.select("vec_id", "embedding").mapInPandas(run, "vec_id long, n_labelled long, places long")


def _dicom_file(r) -> list[tuple[str, bytes]]:
    tags = {"PatientID": f"p{r.o_custkey}", "Modality": "CR", "ViewPosition": "PA" if r.o_orderkey % 2 else "LATERAL", "PatientSex": "MF"[r.o_orderkey % 2], "PatientAge": f"{r.o_orderkey % 90:03}Y", "PixelSpacing": r"0.25\0.5", "StudyInstanceUID": f"1.2.{r.o_orderkey}"}
    if r.o_orderkey % 3 == 0:
        tags |= {"PatientName": "Doe^J", "InstitutionName": "General"}
    raw = dicom.write(tags, np.zeros((3 + r.o_orderkey % 4, 5), np.uint16))
    return [(f"p{r.o_custkey}/s{r.o_orderkey}/i.dcm", raw if r.o_orderkey % 11 else raw[:140] + b"\xff" * 9)]


@query("""
SELECT 's' || o_orderkey AS study_id, 'p' || o_custkey AS subject_id, 'CR' AS modality, CASE WHEN o_orderkey % 2 = 1 THEN 'PA' ELSE 'LATERAL' END AS view_position, CASE WHEN o_orderkey % 2 = 1 THEN 'F' ELSE 'M' END AS sex,
  (o_orderkey % 90)::double AS age, (3 + o_orderkey % 4)::int AS "rows", 5 AS "columns", 0.25::double AS pixel_spacing_mm, o_orderkey % 3 = 0 AS has_phi FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % 11 <> 0""")
def scan_dicom_headers(t: Tables) -> DataFrame:
    root = _folder(t.spark)
    _put(t.orders.where("o_orderkey % 20 = 0").select("o_orderkey", "o_custkey"), root, _dicom_file)
    d = dicom.parse(files.scan(t.spark, root, ("*.dcm",)), root)
    return d.select("study_id", "subject_id", "modality", "view_position", "sex", "age", "rows", "columns", "pixel_spacing_mm", F.array_contains("phi_flags", "PatientName").alias("has_phi"))


@query(f"""
WITH {_E}, u AS (SELECT vec_id, count(*) FILTER (x > 100) AS n FROM (SELECT vec_id, unnest(v) AS x FROM e) GROUP BY 1)
SELECT 'c' || vec_id AS patient_id, vec_id % 4 <> 0 AS has_label, vec_id % 6 <> 0 AS file_exists, CASE WHEN vec_id % 6 <> 0 THEN 2.0::double END AS slice_thickness, CASE WHEN vec_id % 4 <> 0 AND vec_id % 6 <> 0 THEN n::double END AS tumour_volume_mm3 FROM u""")
def scan_clinical_table(t: Tables) -> DataFrame:
    """A clinical CSV joined to the headers and label counts of its files, some of which are missing."""
    root = _folder(t.spark)

    def make(r) -> list[tuple[str, bytes]]:
        a = np.diag([1.0, 2.0, 0.5, 1.0])
        image = [(f"vol/v{r.vec_id}.nii.gz", nifti.write(_volume(r), a))] if r.vec_id % 6 else []
        return image + ([(f"lab/l{r.vec_id}.nii.gz", nifti.write(np.where(_volume(r) > 100, 2, 1).astype(np.uint8), a))] if r.vec_id % 4 else [])

    _put(t.embeddings.select("vec_id", "embedding"), root, make)
    i = F.col("vec_id").cast("string")
    row = t.embeddings.select(F.concat(F.lit("c"), i).alias("patient_id"), F.lit(50.0).alias("age"), F.lit("F").alias("sex"), F.lit("x").alias("institution"), F.lit("y").alias("scanner"), F.lit(True).alias("contrast"), F.concat(F.lit("vol/v"), i, F.lit(".nii.gz")).alias("volume_path"), F.concat(F.lit("lab/l"), i, F.lit(".nii.gz")).alias("label_path"))
    row.write.option("header", True).csv(f"{root}/clinical.csv")
    return imaging.clinical_table(t.spark, f"{root}/clinical.csv", root).select("patient_id", "has_label", "file_exists", "slice_thickness", "tumour_volume_mm3")


@query("""
WITH r AS (SELECT doc_id::varchar AS patient_id, lang AS modality, CASE WHEN doc_id % 3 = 0 THEN '' ELSE doc_id % 7 || ',' || doc_id % 11 END AS shape, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS split, 'a "quoted", ' || doc_id AS scanner, n_chars::double AS age FROM documents)
SELECT f AS format, r.* FROM r, (SELECT unnest(['parquet', 'csv', 'json']) AS f)""")
def manifest_formats(t: Tables) -> DataFrame:
    """Records with arrays, maps, quotes and nulls, written and read in all three formats."""
    i, root = F.col("doc_id"), _folder(t.spark)
    shape = F.when(i % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((i % 7).cast("int"), (i % 11).cast("int")))
    extra = F.when(i % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("split"), F.col("source")))
    d = manifest.conform(t.documents.select(i.cast("string").alias("patient_id"), F.col("lang").alias("modality"), shape.alias("shape"), extra.alias("extra"), F.concat(F.lit('a "quoted", '), i.cast("string")).alias("scanner"), F.col("n_chars").alias("age")))
    out = None
    for kind, path in manifest.write(d, f"{root}/m").items():
        one = manifest.read(t.spark, path).select(F.lit(kind).alias("format"), "patient_id", "modality", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), F.col("extra")["split"].alias("split"), "scanner", "age")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'd' || doc_id AS owner, 'short, "text"' AS message, n_chars::varchar AS value FROM documents WHERE n_chars < 300""")
def findings_csv(t: Tables) -> DataFrame:
    """Findings written as CSV and read back, with commas and quotes."""
    path = f"{_folder(t.spark)}/findings.csv"
    given = {"owner": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "message": F.lit('short, "text"'), "value": F.col("n_chars").cast("string")}
    names = dict(zip(qc.FINDING_COLUMNS, qc.FINDING_COLUMNS))
    own = {c: given["owner" if k == 0 else "message" if k == 1 else "value"] if k < 3 else F.lit(c) for k, c in enumerate(names)}
    reports.write_findings(t.documents.where("n_chars < 300").select(*(v.alias(c) for c, v in own.items())), path)
    d = t.spark.read.option("header", True).option("escape", "\\").csv(path)
    a, b, c = qc.FINDING_COLUMNS[:3]
    return d.select(F.col(a).alias("owner"), F.col(b).alias("message"), F.col(c).alias("value"))


@query(f"""
WITH {_E}, u AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS p, unnest(v) AS x FROM e WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0)
SELECT 's' || vec_id AS patient_id, '4x4x4' AS shape, 2 AS n_channels, sum(x * (p + 1))::bigint AS t1, sum(2 * x * (p + 1))::bigint AS t2, sum(CASE WHEN vec_id % 4 <> 0 AND x > 100 THEN 4 WHEN vec_id % 4 <> 0 AND x > 0 THEN 1 ELSE 0 END)::bigint AS mask, 64 AS n_mask FROM u GROUP BY vec_id""")
def training_arrays(t: Tables) -> DataFrame:
    """Two channels a subject, and a mask of zeros where there is none."""
    root = _folder(t.spark)

    def make(r) -> list[tuple[str, bytes]]:
        (_, raw), *mask = _mri_files(r)
        return [(f"s{r.vec_id}/s{r.vec_id}_t1.nii.gz", raw), (f"s{r.vec_id}/s{r.vec_id}_t2.nii.gz", nifti.write(_volume(r) * 2, np.diag([1.0, 2.0, 0.5, 1.0]))), *mask]

    _put(t.embeddings.where("vec_id % 5 <> 0 and vec_id % 3 <> 0").select("vec_id", "embedding"), root, make)
    m = imaging.scan_mri(t.spark, root).withColumn("extra", F.create_map(F.lit("split"), F.lit("train")))
    d = imaging.training_set(t.spark, m, root, "train", ("t1", "t2"))
    weighed = lambda c: F.aggregate(F.transform(c, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    total = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("patient_id", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), F.size("image").alias("n_channels"), weighed(F.col("image")[0]).alias("t1"), weighed(F.col("image")[1]).alias("t2"), total.alias("mask"), F.size("mask").alias("n_mask"))
