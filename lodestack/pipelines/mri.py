"""Multi-modality MRI: ingest, quality control, gate, preprocess, split, release."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import qc, split
from ..sinks import releases, reports, volumes
from ..sources import files, imaging, manifest

STAGES = tuple("ingest qc preprocess split all".split())


def qc_config(cfg: Config) -> qc.QCConfig:
    q = cfg.qc
    return qc.QCConfig(tuple(q.min_shape), q.expected_orientation, q.max_spacing_mm, q.min_tumor_voxels, tuple(q.expected_modalities))


def findings(records: DataFrame, cfg: Config) -> DataFrame:
    """Rules, duplicates across and within owners, and missing modalities."""
    d = records.withColumn("file_exists", F.lit(True))
    out = qc.run_rules(d, cfg=qc_config(cfg)).unionByName(qc.duplicate_content(d))
    again = qc.duplicate_series(d, "patient_id", "modality", ("filepath",))
    none = F.lit(None).cast("string")
    out = out.unionByName(again.select("patient_id", "modality", F.lit("duplicate_series").alias("check"), F.lit("WARN").alias("severity"), F.concat(F.lit("series number "), F.col("occurrence").cast("string")).alias("message"), none.alias("filepath")))
    if cfg.qc.expected_modalities:
        miss = qc.missing_sets(d, cfg.qc.expected_modalities, "patient_id", "modality").withColumn("missing", F.array_join("missing", ","))
        out = out.unionByName(miss.select("patient_id", F.col("missing").alias("modality"), F.lit("missing_modalities").alias("check"), F.lit("ERROR").alias("severity"), F.concat(F.lit("missing: "), F.col("missing")).alias("message"), none.alias("filepath")))
    return out


def run(spark: SparkSession, cfg: Config, stage: str = "all", version: str = "v1.0.0") -> dict:
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    if not Path(cfg.paths.raw).is_dir():
        raise FileNotFoundError(cfg.paths.raw)
    cfg.paths.mkdirs()
    stem = f"{cfg.paths.interim}/manifest"
    manifest.write(imaging.scan_mri(spark, cfg.paths.raw), f"{stem}_raw", mode="overwrite")
    records = manifest.read(spark, f"{stem}_raw.parquet")
    if stage == "ingest":
        return {"n_records": records.count()}
    found = findings(records, cfg)
    found.write.mode("overwrite").parquet(f"{cfg.paths.interim}/findings.parquet")
    found = spark.read.schema(qc.FINDING_SCHEMA).parquet(f"{cfg.paths.interim}/findings.parquet")
    stamped = qc.apply_findings(records.drop("qc_status", "qc_flags"), found)
    manifest.write(manifest.conform(stamped), f"{stem}_qc", mode="overwrite")
    stamped = manifest.read(spark, f"{stem}_qc.parquet")
    reports.write_findings(found, f"{cfg.paths.outputs}/QC_REPORT.csv", mode="overwrite")
    reports.write_html(found, stamped, f"{cfg.paths.outputs}/QC_REPORT.html", cfg.name)
    summary = qc.summarise(found, stamped).first().asDict()
    good = stamped.where("qc_status != 'fail'")
    if good.isEmpty() and cfg.qc.fail_on == "error":
        raise RuntimeError("no record passes quality control")
    if stage == "qc":
        return {"summary": summary}
    good = qc.complete_owners(good, [m.lower() for m in cfg.qc.expected_modalities], "patient_id", "modality")
    raw = files.scan(spark, cfg.paths.raw, ("*.nii", "*.nii.gz"))
    lead = str(Path(cfg.paths.raw).resolve()) + "/"
    raw = raw.select(F.substr(files.clean_path(F.col("path")), F.lit(len(lead) + 1)).alias("filepath"), "content")
    images = volumes.write_processed(raw.join(good.select("filepath"), "filepath", "left_semi"), cfg.paths.processed, cfg.preprocess)
    masks = volumes.write_processed(raw.join(good.select(F.col("mask_path").alias("filepath")).distinct(), "filepath", "left_semi"), cfg.paths.processed, cfg.preprocess, labels=True)
    images.write.mode("overwrite").parquet(f"{cfg.paths.interim}/images.parquet")
    masks.write.mode("overwrite").parquet(f"{cfg.paths.interim}/masks.parquet")
    done = spark.read.parquet(f"{cfg.paths.interim}/images.parquet").drop("out_path")
    good = manifest.conform(good.drop(*[c for c in done.columns if c != "filepath"]).join(done, "filepath"))
    if stage == "preprocess":
        return {"summary": summary, "n_processed": good.count()}
    s = cfg.split
    splits = split.split_stratified(good, "patient_id", s.stratify_by, s.train, s.val, s.seed, order="filepath") if s.stratify_by else split.split_grouped(good, "patient_id", s.train, s.val, s.seed)
    splits.write.mode("overwrite").parquet(f"{cfg.paths.interim}/splits.parquet")
    splits = spark.read.parquet(f"{cfg.paths.interim}/splits.parquet").select("patient_id", "split")
    split.verify_no_leakage(splits, "patient_id")
    final = split.assign(good, splits, "patient_id").withColumn("extra", F.create_map(F.lit("split"), F.col("split"))).drop("split")
    manifest.write(manifest.conform(final), f"{stem}_processed", mode="overwrite")
    final = manifest.read(spark, f"{stem}_processed.parquet")
    if stage == "split":
        return {"summary": summary, "splits": {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}}
    lineage = [releases.node("ingest", "files to records"), releases.node("qc", "rules", checks=qc.registered()), releases.node("preprocess", "geometry and intensity"), releases.node("split", "by subject", seed=s.seed)]
    doc = releases.assemble(cfg.name, version, final, cfg, splits, lineage, qc_summary=summary)
    try:
        releases.write(doc, cfg.paths.releases)
    except FileExistsError:
        doc["skipped"] = True
    return {"summary": summary, "release": doc}
