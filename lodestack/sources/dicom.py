"""DICOM headers: a reader of little-endian part-10 files that stops before the pixels, and the pixel reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_age
from ..operators.qc import PHI_TAGS, audit_phi
from .files import clean_path, part

TAGS = {
    0x00080020: "StudyDate", 0x00080030: "StudyTime", 0x00080021: "SeriesDate", 0x00080022: "AcquisitionDate", 0x00080023: "ContentDate", 0x00080050: "AccessionNumber", 0x00080060: "Modality", 0x00080070: "Manufacturer",
    0x00080080: "InstitutionName", 0x00080081: "InstitutionAddress", 0x00080090: "ReferringPhysicianName", 0x00081050: "PerformingPhysicianName", 0x00081070: "OperatorsName", 0x00100010: "PatientName", 0x00100020: "PatientID",
    0x00100030: "PatientBirthDate", 0x00100040: "PatientSex", 0x00101000: "OtherPatientIDs", 0x00101001: "OtherPatientNames", 0x00101010: "PatientAge", 0x00101040: "PatientAddress", 0x00102154: "PatientTelephoneNumbers", 0x00180015: "BodyPartExamined",
    0x00185101: "ViewPosition", 0x0020000D: "StudyInstanceUID", 0x0020000E: "SeriesInstanceUID", 0x00280002: "SamplesPerPixel", 0x00280004: "PhotometricInterpretation", 0x00280010: "Rows", 0x00280011: "Columns", 0x00280030: "PixelSpacing", 0x00280100: "BitsAllocated", 0x00280103: "PixelRepresentation",
}
_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UR", b"UT", b"UN"}
_SHORTS = {"SamplesPerPixel", "Rows", "Columns", "BitsAllocated", "PixelRepresentation"}
_PIXELS = 0x7FE00010


def read(raw: bytes, pixels: bool = False) -> dict:
    """Tags by name, text stripped and numbers as int; with ``pixels`` also the raw PixelData. ValueError if it isn't
    DICOM, is cut short, or has another transfer syntax than uncompressed little endian."""
    if len(raw) < 132 or raw[128:132] != b"DICM":
        raise ValueError("not DICOM")
    out, at, explicit, syntax = {}, 132, True, "1.2.840.10008.1.2.1"
    while at + 8 <= len(raw):
        group, element = struct.unpack_from("<HH", raw, at)
        if group != 2 and explicit and syntax == "1.2.840.10008.1.2":
            explicit = False
        if explicit:
            vr = raw[at + 4 : at + 6]
            size, start = (struct.unpack_from("<I", raw, at + 8)[0], at + 12) if vr in _LONG else (struct.unpack_from("<H", raw, at + 6)[0], at + 8)
        else:
            vr, size, start = b"", struct.unpack_from("<I", raw, at + 4)[0], at + 8
        tag = group << 16 | element
        if tag == _PIXELS:
            if pixels:
                if size == 0xFFFFFFFF:
                    raise ValueError("compressed pixels")
                out["PixelData"] = raw[start : start + size]
            break
        if size == 0xFFFFFFFF:  # a sequence of open length ends with its delimiter
            end = raw.find(b"\xfe\xff\xdd\xe0\0\0\0\0", start)
            if end < 0:
                raise ValueError("open sequence")
            at = end + 8
            continue
        if start + size > len(raw):
            raise ValueError("cut short")
        value = raw[start : start + size]
        if tag == 0x00020010:
            syntax = value.rstrip(b"\0 ").decode("ascii", "replace")
            if syntax not in ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1") and pixels:
                raise ValueError(f"transfer syntax {syntax}")
        name = TAGS.get(tag)
        if name:
            out[name] = struct.unpack_from("<H", value)[0] if name in _SHORTS and len(value) >= 2 else value.decode("utf-8", "replace").strip("\0 ")
        at = start + size
    return out


def write(tags: dict, pixels: np.ndarray | None = None) -> bytes:
    """An explicit little-endian file of these tags, for fixtures."""
    number = {n: t for t, n in TAGS.items()}

    def element(tag: int, vr: bytes, v: bytes) -> bytes:
        v += (b" " if vr not in (b"OW", b"UI", b"OB") else b"\0") * (len(v) & 1)
        head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr
        return head + (b"\0\0" + struct.pack("<I", len(v)) if vr in _LONG else struct.pack("<H", len(v))) + v

    body = b""
    if pixels is not None:
        tags = {"SamplesPerPixel": 1, "BitsAllocated": pixels.dtype.itemsize * 8, "PixelRepresentation": 0, "Rows": pixels.shape[0], "Columns": pixels.shape[1], **tags}
    for t, n in sorted((number[n], n) for n in tags):
        body += element(t, b"US", struct.pack("<H", tags[n])) if n in _SHORTS else element(t, b"UI" if n.endswith("UID") else b"LO", str(tags[n]).encode())
    if pixels is not None:
        body += element(_PIXELS, b"OW", pixels.tobytes())
    return b"\0" * 128 + b"DICM" + element(0x00020010, b"UI", b"1.2.840.10008.1.2.1") + body


def load_pixels(raw: bytes) -> np.ndarray:
    """float32 in [0, 1]; MONOCHROME1 is inverted; a constant image stays as it is."""
    d = read(raw, pixels=True)
    kind = ("i" if d.get("PixelRepresentation") else "u") + str(d["BitsAllocated"] // 8)
    x = np.frombuffer(d["PixelData"], "<" + kind, d["Rows"] * d["Columns"]).reshape(d["Rows"], d["Columns"]).astype(np.float32)
    if d.get("PhotometricInterpretation") == "MONOCHROME1":
        x = x.max() - x
    span = x.max() - x.min()
    return (x - x.min()) / span if span > 0 else x


def parse(files: DataFrame, root: str = "") -> DataFrame:
    """Header rows of files (with content); files that can't be read are left out.

    The study is the parent directory and the subject the one above it. Only headers are decoded; phi_flags names the
    identifiers that are populated.
    """
    names = sorted(set(TAGS.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    d = read(bytes(r.content))
                except (ValueError, struct.error):
                    continue
                rows.append((r.path, r.length, r.sha256, *(None if d.get(n) is None else str(d[n]) for n in names)))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256", *names])

    d = files.select(clean_path(F.col("path")).alias("path"), "length", F.sha2("content", 256).alias("sha256"), "content")
    h = d.mapInPandas(run, "path string, length long, sha256 string, " + ", ".join(f"{n} string" for n in names))
    p = F.col("path")
    lead = root.rstrip("/") + "/" if root else ""
    rel = F.when(p.startswith(lead), F.substr(p, F.lit(len(lead) + 1))).otherwise(p) if lead else p
    text = lambda n: F.nullif(F.col(n), F.lit(""))
    return h.select(
        part(p, 2).alias("study_id"), part(p, 3).alias("subject_id"), rel.alias("filepath"), F.col("Modality").alias("modality"), F.col("ViewPosition").alias("view_position"), F.col("BodyPartExamined").alias("body_part"), text("PatientSex").alias("sex"), parse_age(F.col("PatientAge")).alias("age"),
        F.col("Manufacturer").alias("manufacturer"), F.col("InstitutionName").alias("institution"), F.col("Rows").try_cast("int").alias("rows"), F.col("Columns").try_cast("int").alias("columns"), F.split(text("PixelSpacing"), r"\\")[0].try_cast("double").alias("pixel_spacing_mm"),
        F.col("StudyInstanceUID").alias("study_uid"), F.col("SeriesInstanceUID").alias("series_uid"), "sha256", F.col("length").alias("file_size_bytes"), audit_phi({n: F.col(n) for n in PHI_TAGS}).alias("phi_flags"),
    )
