"""CT cohort: clinical table, quality, cohort with attrition, bias, split, release, card."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import age_band
from ..operators import bias, cohort, quality, split
from ..sinks import card, releases
from ..sources import files, imaging, manifest, nifti

COHORTS = {c.name: c for c in (cohort.STRICT, cohort.PERMISSIVE)}


def volumes(spark: SparkSession, root: str) -> DataFrame:
    """(volume_path, volume, diffs): values and differences of neighbouring slices along the first axis."""
    lead = str(Path(root).resolve()) + "/"
    f = files.scan(spark, root, ("*.nii", "*.nii.gz")).select(F.substr(files.clean_path(F.col("path")), F.lit(len(lead) + 1)).alias("volume_path"), "content")

    def run(batches):
        import numpy as np

        for b in batches:
            v, d = [], []
            for c in b["content"]:
                try:
                    x = nifti.read(bytes(c))[0].astype(float)
                    v.append(x.ravel().tolist())
                    d.append(np.abs(np.diff(x, axis=0)).mean(tuple(range(1, x.ndim))).tolist() if x.ndim == 3 and len(x) > 2 else None)
                except Exception:  # noqa: BLE001
                    v.append(None)
                    d.append(None)
            yield b[["volume_path"]].assign(volume=v, diffs=d)

    return f.mapInPandas(run, "volume_path string, volume array<double>, diffs array<double>")


def run(spark: SparkSession, cfg: Config, cohort_name: str = cohort.STRICT.name, version: str = "v1.0.0") -> dict:
    if cohort_name not in COHORTS:
        raise ValueError(f"unknown cohort: {cohort_name}; there are {sorted(COHORTS)}")
    spec = COHORTS[cohort_name]
    raw = cfg.paths.raw
    cfg.paths.mkdirs()
    t = imaging.clinical_table(spark, f"{raw}/clinical_metadata.csv", raw)
    t = t.withColumn("voxel_spacing", F.col("spacing")).join(volumes(spark, raw), "volume_path", "left")
    s = quality.score_studies(t, "volume", "diffs").drop("volume", "diffs", "voxel_spacing").withColumnRenamed("q_score", "quality_score")
    s = s.withColumn("age_band", age_band(F.col("age")))
    s.write.mode("overwrite").parquet(f"{cfg.paths.interim}/scored.parquet")
    s = spark.read.parquet(f"{cfg.paths.interim}/scored.parquet")
    trail = [r.asDict() for r in cohort.attrition(s, spec).orderBy("step").collect()]
    chosen = cohort.members(s, spec)
    if not trail[-1]["n_after"]:
        return {"error": "the cohort is empty", "attrition": trail}
    rep, dis = bias.audit(chosen, ("age_band", "contrast", "institution", "scanner", "sex"), ("quality_score", "tumour_volume_mm3"), ("age_band", "institution", "scanner", "sex"))
    audits = (bias.with_p_value(rep) if rep is not None else []) + (bias.with_p_value(dis) if dis is not None else [])
    inside = chosen.select("patient_id").distinct().withColumn("__in", F.lit(True))
    shift = [r.asDict() for r in cohort.shift(s.join(inside, "patient_id", "left").withColumn("__m", F.coalesce("__in", F.lit(False))), "__m", ("sex", "institution")).orderBy("attribute", "value").collect()]
    splits = split.split_grouped(chosen, "patient_id", cfg.split.train, cfg.split.val, cfg.split.seed)
    final = split.assign(chosen, splits, "patient_id")
    labelled = F.when(F.col("has_label"), F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    records = final.select("patient_id", F.lit("ct").alias("modality"), F.col("volume_path").alias("filepath"), "shape", F.col("spacing").alias("voxel_spacing"), "sex", "age", "institution", "scanner", "sha256", "file_size_bytes", "quality_score", F.col("has_label").alias("mask_available"), F.col("label_path").alias("mask_path"), F.col("tumour_volume_mm3").alias("tumor_volume_mm3"), labelled.alias("label_classes"), F.create_map(F.lit("split"), F.col("split")).alias("extra"))
    manifest.write(manifest.conform(records), f"{cfg.paths.processed}/manifest", mode="overwrite")
    records = manifest.read(spark, f"{cfg.paths.processed}/manifest.parquet")
    doc = releases.assemble(cfg.name, version, records, cfg, splits, [releases.node("cohort", spec.name, criteria=[c.expression for c in spec.criteria])])
    try:
        releases.write(doc, cfg.paths.releases)
    except FileExistsError:  # the card then tells of the release that stands
        doc = releases.read(Path(cfg.paths.releases) / version / "manifest.json") | {"skipped": True}
    grades = [r.asDict() for r in quality.grade_counts(chosen, "quality_score").collect()]
    text = card.build(cfg.name, version, spec.description or spec.name, doc["dataset_hash"], trail[-1]["n_after"], doc["n_subjects"], spec.to_dict(), trail, grades, audits, {k: len(v) for k, v in doc["splits"].items()}, shift=shift)
    card.write(text, f"{cfg.paths.outputs}/DATASET_CARD.md")
    return {"attrition": trail, "bias": audits, "shift": shift, "release": doc}
