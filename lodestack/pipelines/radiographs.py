"""Radiographs and reports: headers, views, identifiers, reports, fusion, split, release."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import fusion, qc, release, split, text
from ..sinks import releases, reports
from ..sources import dicom, files, manifest

FINDINGS = tuple("pneumonia edema cardiomegaly pleural_effusion".split())


def run(spark: SparkSession, cfg: Config, views: Iterable[str] = ("PA", "AP"), version: str = "v1.0.0") -> dict:
    raw = cfg.paths.raw
    if not Path(raw).is_dir():
        raise FileNotFoundError(raw)
    cfg.paths.mkdirs()
    images = dicom.parse(files.scan(spark, raw, ("*.dcm",)), str(Path(raw).resolve()))
    images.write.mode("overwrite").parquet(f"{cfg.paths.interim}/headers.parquet")
    images = fusion.filter_views(spark.read.parquet(f"{cfg.paths.interim}/headers.parquet"), "view_position", list(views))
    phi = qc.phi_summary(images).first().asDict()
    reports.write_phi(images, f"{cfg.paths.outputs}/PHI_AUDIT.csv", mode="overwrite")
    parsed = text.parse_reports(files.read_reports(spark, raw), "study_id", "text")
    parsed.write.mode("overwrite").parquet(f"{cfg.paths.interim}/reports.parquet")
    parsed = spark.read.parquet(f"{cfg.paths.interim}/reports.parquet")
    stats = fusion.join_stats(images, parsed, "study_id").first().asDict()
    table = fusion.fuse(images, parsed, "study_id")
    if not stats["n_joined"]:
        return {"error": "no image has a report", "stats": stats}
    splits = split.split_grouped(table, "subject_id", cfg.split.train, cfg.split.val, cfg.split.seed)
    table = split.assign(table, splits, "subject_id")
    table.write.mode("overwrite").parquet(f"{cfg.paths.interim}/fusion.parquet")
    table = spark.read.parquet(f"{cfg.paths.interim}/fusion.parquet")
    split.verify_no_leakage(table, "subject_id")
    labels = [f"label_{f}" for f in FINDINGS]
    prevalence = [r.asDict() for r in fusion.prevalence(table, labels).collect()]
    reports.write_fusion(table, fusion.timeline(table, "subject_id", "study_id", labels), cfg.paths.processed, mode="overwrite")
    extra = F.create_map(F.lit("split"), F.col("split"))
    records = table.select(
        F.col("subject_id").alias("patient_id"), F.col("study_id").alias("study_uid"), F.coalesce("modality", F.lit("cr")).alias("modality"), "filepath", "sex", "age", "institution", "sha256", "file_size_bytes", release.label_classes({i: F.col(c) == 1 for i, c in enumerate(labels)}).alias("label_classes"), extra.alias("extra")
    )
    doc = releases.assemble(cfg.name, version, manifest.conform(records), cfg, table.select("subject_id", "split").distinct(), [releases.node("fusion", "images with reports", **{k: str(v) for k, v in stats.items()})], qc_summary=phi)
    try:
        releases.write(doc, cfg.paths.releases)
    except FileExistsError:
        doc["skipped"] = True
    return {"stats": stats, "phi": phi, "prevalence": prevalence, "release": doc}
