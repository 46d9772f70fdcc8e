"""Preprocessed volumes: reorient, resample and normalise images, and masks once each, written by the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import Preprocess
from ..sources import nifti

OUT = "filepath string, out_path string, shape array<int>, voxel_spacing array<double>, orientation string, intensity_min double, intensity_max double, intensity_mean double, intensity_std double, sha256 string, file_size_bytes long"


def write_processed(files: DataFrame, out: str, cfg: Preprocess, labels: bool = False) -> DataFrame:
    """files (filepath, content) to <out>/<filepath>, a folder that all executors share; one row a written file.

    A file is written under another name and renamed, so a repeated task leaves the same file. Files that can't be
    decoded have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    data, affine, spacing = nifti.read(bytes(r.content))
                except Exception:  # noqa: BLE001
                    continue
                before = nifti.axis_codes(affine)
                data, affine = nifti.reorient(data, affine, cfg.target_orientation)
                kind = {"L": 0, "R": 0, "P": 1, "A": 1, "I": 2, "S": 2}
                spacing = tuple(spacing[[kind[c] for c in before].index(kind[t])] for t in cfg.target_orientation)
                data, affine = nifti.resample(data, affine, spacing, tuple(cfg.target_spacing), labels)
                if not labels:
                    data = nifti.normalise(data, cfg.intensity_norm, tuple(cfg.clip_percentiles))
                raw = nifti.write(data, affine)
                path = os.path.join(out, r.filepath)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                temp = f"{path}.{os.getpid()}"
                with open(temp, "wb") as f:
                    f.write(raw)
                os.replace(temp, path)
                p = nifti.probe_bytes(raw)
                rows.append((r.filepath, path, p["shape"], p["voxel_spacing"], p["orientation"], p["intensity_min"], p["intensity_max"], p["intensity_mean"], p["intensity_std"], hashlib.sha256(raw).hexdigest(), len(raw)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])

    return files.select("filepath", "content").mapInPandas(run, OUT)
