"""The record manifest: its schema, and reading and writing it in three formats that agree."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = (
    "patient_id string, study_uid string, series_uid string, modality string, filepath string, shape array<int>, voxel_spacing array<double>, orientation string, affine array<array<double>>, intensity_min double, intensity_max double, intensity_mean double, intensity_std double, mask_available boolean, mask_path string, "
    "tumor_volume_mm3 double, label_classes array<int>, scanner string, institution string, age double, sex string, file_size_bytes long, sha256 string, ingested_at string, qc_status string, qc_flags array<string>, quality_score double, extra map<string,string>"
)
FORMATS = ("parquet", "csv", "json")
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def schema() -> T.StructType:
    """The fields of a record; parsing them needs a session."""
    return T.StructType.fromDDL(DDL)


def conform(df: DataFrame) -> DataFrame:
    """All fields of the schema in order; missing ones are null (mask_available false, qc_status pending)."""
    given = {"mask_available": F.lit(False), "qc_status": F.lit("pending")}
    return df.select(*((F.col(f.name) if f.name in df.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema()))


def flatten(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name) for f in df.schema))


def unflatten(df: DataFrame, fields: T.StructType | None = None) -> DataFrame:
    """Back from JSON text; what can't be decoded is an empty array or map."""
    out = []
    for f in fields or schema():
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            empty = F.array() if isinstance(f.dataType, T.ArrayType) else F.create_map()
            c = F.coalesce(F.from_json(c, f.dataType), empty.cast(f.dataType))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def write(df: DataFrame, stem: str, formats: Iterable[str] = FORMATS, mode: str = "errorifexists") -> dict[str, str]:
    """Write <stem>.<format> of each format; nested columns stay native in Parquet and JSON."""
    formats = tuple(formats)
    for f in formats:
        if f not in FORMATS:
            raise ValueError(f"unknown format: {f}")
    out = {}
    for f in formats:
        out[f] = f"{stem}.{f}"
        if f == "csv":
            flatten(df).write.mode(mode).option("header", True).option("escape", '"').csv(out[f])
        else:
            getattr(df.write.mode(mode), f)(out[f])
    return out


def read(spark: SparkSession, path: str, fields: T.StructType | None = None) -> DataFrame:
    """By the ending; the schema is declared, never inferred."""
    fields = fields or schema()
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.schema(fields).parquet(path)
    if kind == "json":
        return spark.read.schema(fields).json(path)
    if kind == "csv":
        text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, _NESTED) else f.dataType) for f in fields])
        return unflatten(spark.read.schema(text).option("header", True).option("escape", '"').csv(path), fields)
    raise ValueError(f"unknown ending: {path}")
