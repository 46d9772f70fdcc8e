"""Release documents: an immutable manifest with checksums, and the index of releases."""

from __future__ import annotations

import json
import platform
import subprocess
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, dump
from ..operators import release as R

INDEX = tuple("dataset version created_at dataset_hash n_files n_subjects parent_version".split())
FILE = "array<struct<path:string,sha256:string,size_bytes:bigint,patient_id:string,modality:string>>"
SCHEMA = (
    f"dataset string, version string, schema_version string, created_at string, dataset_hash string, n_files long, n_subjects long, total_bytes long, files {FILE}, splits map<string,array<string>>, class_balance map<string,bigint>, modality_counts map<string,bigint>, qc_summary map<string,string>, config_snapshot map<string,string>, lineage array<struct<stage:string,description:string,timestamp:string,inputs:array<string>,outputs:array<string>,params:map<string,string>>>, parent_version string, environment map<string,string>"
)


def node(stage: str, description: str, inputs: list[str] | None = None, outputs: list[str] | None = None, **params: Any) -> dict:
    return {"stage": stage, "description": description, "timestamp": datetime.now(UTC).isoformat(), "inputs": inputs or [], "outputs": outputs or [], "params": params}


def revision() -> str:
    try:
        return subprocess.run(["git", "describe", "--always", "--abbrev=40"], text=True, check=True, timeout=5, capture_output=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def assemble(dataset: str, version: str, records: DataFrame, cfg: Config | None = None, splits: DataFrame | None = None, lineage: list[dict] | None = None, qc_summary: dict | None = None, parent_version: str | None = None) -> dict:
    """A release of manifest records. The list of its files is part of the document, so it comes to the driver."""
    entries = R.file_entries(records, "filepath", "sha256", "file_size_bytes", "patient_id", "modality")
    total = R.totals(records, "sha256", "file_size_bytes", "patient_id").crossJoin(R.dataset_hash(entries)).first()
    return {
        "dataset": dataset,
        "version": version,
        "schema_version": R.SCHEMA_VERSION,
        "created_at": datetime.now(UTC).isoformat(),
        **{k: total[k] for k in ("dataset_hash", "n_files", "n_subjects", "total_bytes")},
        "files": [r.asDict() for r in entries.orderBy("path").toLocalIterator()],
        "splits": {} if splits is None else {r["split"]: r["s"] for r in splits.groupBy("split").agg(F.array_sort(F.collect_set(F.col(splits.columns[0]).cast("string"))).alias("s")).collect()},
        "class_balance": {r["label"]: r["n"] for r in R.class_balance(records, "label_classes").collect()},
        "modality_counts": {r["modality"]: r["n"] for r in R.modality_counts(records, "modality").collect()},
        "qc_summary": qc_summary or {},
        "config_snapshot": dump(cfg) if cfg else {},
        "lineage": list(lineage or []),
        "parent_version": parent_version,
        "environment": {"python": platform.python_version(), "platform": platform.platform(), "git_revision": revision()},
    }


def write(release: dict, root: str | Path) -> Path:
    """<root>/<version>/manifest.json and SHA256SUMS, and the index; a version that exists is never overwritten."""
    at = Path(root) / release["version"]
    if (at / "manifest.json").exists():
        raise FileExistsError(f"release {release['version']} exists; take another version")
    at.mkdir(parents=True, exist_ok=True)
    (at / "manifest.json").write_text(json.dumps(release, indent=2), "utf-8")
    (at / "SHA256SUMS").write_text("".join(f"{f['sha256']}  {f['path']}\n" for f in release["files"]), "utf-8")
    update_index(Path(root), release)
    return at / "manifest.json"


def update_index(root: Path, release: dict) -> None:
    """One row a version, oldest first; an index that can't be read is started anew."""
    at = root / "releases.json"
    try:
        rows = json.loads(at.read_text("utf-8")) if at.exists() else []
    except ValueError:
        rows = []
    rows = [r for r in rows if r.get("version") != release["version"]] + [{k: release.get(k) for k in INDEX}]
    at.write_text(json.dumps(sorted(rows, key=lambda r: r["created_at"]), indent=2), "utf-8")


def read(path: str | Path) -> dict:
    return json.loads(Path(path).read_text("utf-8"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as nested rows."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def verify(spark: SparkSession, release: dict, root: str) -> list[str]:
    """Problems of the release's files below ``root``, hashed again on the executors."""
    from ..sources import files

    lead = str(Path(root).resolve()) + "/"
    disk = files.scan(spark, root).select(F.substr(files.clean_path(F.col("path")), F.lit(len(lead) + 1)).alias("path"), F.sha2("content", 256).alias("sha256"))
    entries = spark.createDataFrame([(f["path"], f["sha256"]) for f in release["files"]], "path string, sha256 string")
    return [r["problem"] for r in R.verify(entries, disk).orderBy("path").collect()]
