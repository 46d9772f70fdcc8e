"""Scans of image trees and clinical tables into records."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import file_modality, voxel_volume
from . import files, nifti
from .manifest import conform

MODALITIES = tuple("t1 t1ce t2 flair".split())


def scan_mri(spark: SparkSession, root: str) -> DataFrame:
    """One record a subject and modality of <root>/<subject>/*_<modality>.nii[.gz]; seg is attached as the mask.

    Images and masks are decoded once each; a mask's volume uses the image's spacing and is left out where the image
    can't be read.
    """
    far = "://" in root
    f = (files.scan if far else files.listing)(spark, root, ("*.nii", "*.nii.gz")).withColumn("path", files.clean_path(F.col("path")))
    read = (lambda d: d) if far else files.with_content
    lead = os.path.abspath(root).rstrip("/") + "/"
    f = f.withColumns({"patient_id": files.part(F.col("path"), 2), "modality": file_modality(files.part(F.col("path"), 1)), "filepath": F.when(F.col("path").startswith(lead), F.substr("path", F.lit(len(lead) + 1))).otherwise(F.col("path"))}).where("modality is not null")
    keys = ("patient_id", "modality", "filepath", "length")
    image = nifti.probe(read(f.where(F.col("modality").isin(*MODALITIES))), keys)
    mask = nifti.probe_masks(read(f.where("modality = 'seg'")), ("patient_id", "filepath")).withColumnRenamed("filepath", "mask_path")
    d = image.join(mask, "patient_id", "left")
    ok = F.col("readable") & F.col("mask_path").isNotNull()
    voxel = F.when(F.size("voxel_spacing") > 0, voxel_volume(F.col("voxel_spacing"))).otherwise(1.0)
    d = d.withColumns({
        "study_uid": F.col("patient_id"), "series_uid": F.concat_ws("_", "patient_id", "modality"), "file_size_bytes": F.col("length"), "mask_available": F.col("mask_path").isNotNull(),
        "tumor_volume_mm3": F.when(ok, F.col("n_labelled") * voxel), "label_classes": F.when(ok, F.col("label_classes")).otherwise(F.array().cast("array<int>")), "ingested_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
    })
    return conform(d)


CLINICAL = "patient_id string, age double, sex string, institution string, scanner string, contrast boolean, volume_path string, label_path string"


def clinical_table(spark: SparkSession, csv: str, root: str, tumour_label: int = 2) -> DataFrame:
    """Every row of the clinical CSV with has_label, file_exists, spacing, shape, slice_thickness, tumour_volume_mm3,
    sha256 and file_size_bytes of its files below ``root``; without a readable image the volume is null. A missing CSV
    raises FileNotFoundError."""
    if "://" not in csv and not os.path.exists(csv):
        raise FileNotFoundError(csv)
    rows = spark.read.schema(CLINICAL).option("header", True).csv(csv)
    lead = os.path.abspath(root).rstrip("/") + "/"
    f = files.scan(spark, root, ("*.nii", "*.nii.gz")).withColumn("rel", F.substr(files.clean_path(F.col("path")), F.lit(len(lead) + 1)))
    want = lambda c: f.join(rows.select(F.col(c).alias("rel")).distinct(), "rel", "left_semi")
    vol = nifti.probe(want("volume_path"), ("rel", "length")).select(F.col("rel").alias("volume_path"), F.col("voxel_spacing").alias("spacing"), "shape", "sha256", F.col("length").alias("file_size_bytes"), F.lit(True).alias("__v"))

    def count(batches):
        import numpy as np

        for b in batches:
            got = []
            for c in b["content"]:
                try:
                    got.append(int(np.count_nonzero(nifti.read(bytes(c))[0] == tumour_label)))
                except Exception:  # noqa: BLE001
                    got.append(None)
            yield b[["rel"]].assign(n=got)

    lab = want("label_path").select("rel", "content").mapInPandas(count, "rel string, n double").select(F.col("rel").alias("label_path"), F.col("n").alias("__n"), F.lit(True).alias("__l"))
    d = rows.join(vol, "volume_path", "left").join(lab, "label_path", "left")
    return d.select(*rows.columns, F.coalesce("__l", F.lit(False)).alias("has_label"), F.coalesce("__v", F.lit(False)).alias("file_exists"), "spacing", "shape", F.array_max("spacing").alias("slice_thickness"), F.when(F.size("spacing") > 0, F.col("__n") * voxel_volume(F.col("spacing"))).alias("tumour_volume_mm3"), "sha256", "file_size_bytes")


def channel_table(manifest: DataFrame, split: str, channels: tuple[str, ...] = MODALITIES) -> DataFrame:
    """One row a subject of a split (extra.split): a path a channel, in order, and the mask's. A subject that lacks a
    channel raises KeyError."""
    own = F.col("extra")["split"] == split
    path = lambda c: F.first(F.when(own & (F.col("modality") == c), F.col("filepath")), ignorenulls=True).alias(c)
    d = manifest.where("patient_id is not null").groupBy("patient_id").agg(*map(path, channels), F.max("mask_path").alias("mask_path"), F.max(own).alias("__own")).where("__own").drop("__own")
    d = d.persist()  # the manifest may be a scan, which the check and the result would each repeat
    missing = d.where(" or ".join(f"`{c}` is null" for c in channels)).select("patient_id").limit(5).collect()
    if missing:
        raise KeyError(f"subjects without all channels: {[r[0] for r in missing]}")
    return d


def training_set(spark: SparkSession, manifest: DataFrame, root: str, split: str, channels: tuple[str, ...] = MODALITIES) -> DataFrame:
    """One row a subject of a split: shape, image (the voxels of each channel, in order) and mask, as flat arrays.

    Files are below ``root``. A subject without a mask has one of zeros; one that lacks a channel raises KeyError, as does
    ``channel_table``. Each file is decoded once, by the tasks that read it.
    """
    t = channel_table(manifest, split, channels)
    want = t.select("patient_id", F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").alias("rel")) for i, c in enumerate((*channels, "mask_path"))))).alias("x")).select("patient_id", "x.*").where("rel is not null")

    def decode(batches):
        for b in batches:
            data = [nifti.read(bytes(c))[0] for c in b["content"]]
            yield b[["patient_id", "at"]].assign(shape=[list(x.shape) for x in data], v=[x.ravel().astype("f4") for x in data])

    one = files.read_below(spark, want, root, "rel", ("*.nii", "*.nii.gz")).select("patient_id", "at", "content").mapInPandas(decode, "patient_id string, at int, shape array<int>, v array<float>")
    n = len(channels)
    g = one.groupBy("patient_id").agg(F.max_by("shape", -F.col("at")).alias("shape"), F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x"))
    mask = F.get(F.filter("x", lambda e: e["at"] == n), 0)["v"]
    size = F.aggregate("shape", F.lit(1), lambda a, k: a * k)
    return g.select("patient_id", "shape", F.transform(F.filter("x", lambda e: e["at"] < n), lambda e: e["v"]).alias("image"), F.coalesce(F.transform(mask, lambda v: v.cast("int")), F.array_repeat(F.lit(0), size)).alias("mask"))
