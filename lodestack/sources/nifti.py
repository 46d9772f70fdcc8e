"""NIfTI-1 volumes: decoding, geometry and writing in numpy, and the probes that run over binary columns."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_CODES = {v: k for k, v in _TYPES.items()}
PROBE = "shape array<int>, voxel_spacing array<double>, orientation string, affine array<array<double>>, intensity_min double, intensity_max double, intensity_mean double, intensity_std double, readable boolean"


def read(raw: bytes) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """(data, 4 x 4 affine, spacing); raises ValueError for what isn't NIfTI-1."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < 348:
        raise ValueError("too short")
    e = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    if struct.unpack_from(e + "i", raw)[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not NIfTI-1")
    dim = struct.unpack_from(e + "8h", raw, 40)
    kind = struct.unpack_from(e + "h", raw, 70)[0]
    pix = struct.unpack_from(e + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(e + "3f", raw, 108)
    q, s = struct.unpack_from(e + "2h", raw, 252)
    shape = tuple(dim[1 : 1 + dim[0]])
    if kind not in _TYPES or not 1 <= dim[0] <= 7:
        raise ValueError("kind of data not supported")
    n = int(np.prod(shape))
    dtype = np.dtype(_TYPES[kind]).newbyteorder(e)
    if len(raw) < int(offset) + n * dtype.itemsize:
        raise ValueError("data cut short")
    data = np.frombuffer(raw, dtype, n, int(offset)).reshape(shape, order="F")
    data = data.astype(data.dtype.newbyteorder("="))
    if slope not in (0.0, 1.0) and np.isfinite(slope) or slope and inter:
        data = data * slope + inter
    if s > 0:
        affine = np.vstack([np.array(struct.unpack_from(e + "12f", raw, 280)).reshape(3, 4), [0, 0, 0, 1]])
    elif q > 0:
        affine = _quaternion(struct.unpack_from(e + "6f", raw, 256), pix)
    else:
        affine = np.diag([*pix[1:4], 1.0])
        affine[:3, 3] = -0.5 * (np.array((*shape, 1, 1, 1)[:3]) - 1) * pix[1:4]
    return data, affine.astype(float), tuple(abs(float(x)) for x in pix[1 : 1 + min(3, dim[0])])


def _quaternion(p, pix) -> np.ndarray:
    b, c, d, *off = p
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    out = np.eye(4)
    out[:3, :3] = r @ np.diag([pix[1], pix[2], pix[3] * (pix[0] if pix[0] in (1, -1) else 1)])
    out[:3, 3] = off
    return out


def write(data: np.ndarray, affine: np.ndarray, compress: bool = True) -> bytes:
    if data.dtype.str[1:] not in _CODES:
        data = data.astype("f4")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *([1] * (7 - data.ndim)))
    struct.pack_into("<2h", head, 70, _CODES[data.dtype.str[1:]], data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(0)), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.astype(data.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(raw, mtime=0) if compress else raw


def axis_codes(affine: np.ndarray) -> str:
    """The anatomical direction that each array axis points to, strongest axes first taken."""
    m = affine[:3, :3] / np.maximum(np.sqrt((affine[:3, :3] ** 2).sum(0)), 1e-12)
    codes, left = [""] * 3, [0, 1, 2]
    for col in np.argsort(-np.abs(m).max(0), kind="stable"):
        row = max(left, key=lambda r: abs(m[r, col]))
        left.remove(row)
        codes[col] = ("LR", "PA", "IS")[row][int(m[row, col] > 0)]
    return "".join(codes)


def reorient(data: np.ndarray, affine: np.ndarray, target: str = "RAS") -> tuple[np.ndarray, np.ndarray]:
    """Permute and flip axes to the target codes, with the affine of the same world coordinates."""
    now = axis_codes(affine)
    pair = {"L": "LR", "R": "LR", "P": "PA", "A": "PA", "I": "IS", "S": "IS"}
    order = [next(i for i, c in enumerate(now) if pair[c] == pair[t]) for t in target]
    move = np.zeros((4, 4))
    move[3, 3] = 1
    out = data.transpose(*order, *range(3, data.ndim))
    for k, (i, t) in enumerate(zip(order, target)):
        flip = now[i] != t
        move[i, k] = -1 if flip else 1
        if flip:
            move[i, 3] = data.shape[i] - 1
            out = np.flip(out, k)
    return out, affine @ move


def resample(data: np.ndarray, affine: np.ndarray, spacing: tuple[float, ...], target: tuple[float, ...], labels: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """To the target spacing: nearest for labels (uint8), linear for images; unchanged within 1e-3.

    Sizes are round(n * spacing / target), and the ends of an axis stay its ends.
    """
    now, want = np.asarray(spacing[:3], float), np.asarray(target, float)
    if np.allclose(now, want, atol=1e-3):
        return data, affine
    out = data if labels else data.astype(np.float32)
    for k in range(3):
        n = out.shape[k]
        m = max(1, int(round(n * now[k] / want[k])))
        at = np.linspace(0, n - 1, m) if m > 1 else np.zeros(1)
        if labels:
            out = out.take(np.minimum(np.floor(at + 0.5).astype(int), n - 1), k)
        else:
            lo = np.minimum(at.astype(int), n - 1)
            w = (at - lo).reshape([-1 if a == k else 1 for a in range(out.ndim)]).astype(np.float32)
            out = out.take(lo, k) * (1 - w) + out.take(np.minimum(lo + 1, n - 1), k) * w
    new = affine.copy()
    new[:3, :3] *= want / now
    return (np.rint(out).astype(np.uint8) if labels else out), new


def normalise(data: np.ndarray, method: str = "zscore", clip=(0.5, 99.5)) -> np.ndarray:
    """Scale by statistics of the foreground (> 0) after clipping to its percentiles."""
    if method not in ("none", "zscore", "minmax"):
        raise ValueError(f"unknown method: {method!r}")
    x = data.astype(np.float32)
    fg = x[x > 0]
    if method == "none" or not fg.size:
        return x
    x = np.clip(x, *np.percentile(fg, clip))
    fg = x[x > 0]
    if method == "zscore":
        return (x - fg.mean()) / (fg.std() or 1.0)
    span = fg.max() - fg.min()
    return (x - fg.min()) / span if span else np.zeros_like(x)


def probe_bytes(raw: bytes | None) -> dict:
    """Facts of one volume over its finite voxels; all null if it can't be decoded."""
    none = dict.fromkeys((x.split()[0] for x in PROBE.split(", ")), None) | {"readable": False}
    try:
        data, affine, spacing = read(raw or b"")
        own = data[np.isfinite(data)] if data.dtype.kind == "f" else data
        if not own.size:
            raise ValueError("no finite voxel")
        return {"shape": list(map(int, data.shape)), "voxel_spacing": list(spacing), "orientation": axis_codes(affine), "affine": affine.tolist(), "intensity_min": float(own.min()), "intensity_max": float(own.max()), "intensity_mean": float(own.mean()), "intensity_std": float(own.std()), "readable": True}
    except Exception:  # noqa: BLE001  a damaged file is a row of nulls
        return none


def mask_stats(raw: bytes | None) -> tuple[list[int] | None, int | None]:
    """(classes but 0, labelled voxels) of a label volume; ([], None) if it can't be decoded."""
    try:
        data = read(raw or b"")[0]
        return sorted(int(c) for c in np.unique(data) if c != 0), int(np.count_nonzero(data))
    except Exception:  # noqa: BLE001
        return [], None


def probe(files: DataFrame, keep: tuple[str, ...] = ("path", "length")) -> DataFrame:
    """files (with content) with their probe columns and sha256, one decode a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([probe_bytes(bytes(c)) for c in b["content"]], index=b.index)
            yield pd.concat([b.drop(columns="content"), rows], axis=1)

    d = files.withColumn("sha256", F.sha2("content", 256)).select(*keep, "sha256", "content")
    kinds = ", ".join(f"{n} {t}" for n, t in d.drop("content").dtypes)
    return d.mapInPandas(run, f"{kinds}, {PROBE}")


def probe_masks(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """files with label_classes and n_labelled, decoded once a mask and not once a series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [mask_stats(bytes(c)) for c in b["content"]]
            yield b.drop(columns="content").assign(label_classes=[g[0] for g in got], n_labelled=pd.array([g[1] for g in got], "Int64"))

    d = files.select(*keep, "content")
    kinds = ", ".join(f"{n} {t}" for n, t in d.drop("content").dtypes)
    return d.mapInPandas(run, f"{kinds}, label_classes array<int>, n_labelled long")
