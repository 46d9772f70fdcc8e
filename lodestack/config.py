"""Layered configuration: base file, pipeline file, dotted overrides; validated and dumped for release snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints


class ConfigError(ValueError):
    pass


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass
class Paths:
    """Input and output roots; the input is never created, so that a typo in it shows."""

    raw: str
    interim: str
    processed: str
    outputs: str
    releases: str

    def mkdirs(self) -> None:
        for name, at in vars(self).items():
            if name != "raw":
                Path(at).mkdir(parents=True, exist_ok=True)


@dataclass
class QC:
    min_tumor_voxels: int = 10
    expected_modalities: list[str] = field(default_factory=list)
    expected_orientation: str = "RAS"
    max_spacing_mm: float = 5.0
    min_shape: list[int] = field(default_factory=lambda: [16, 16, 16])
    fail_on: str = "error"

    def __post_init__(self):
        _check(self.min_tumor_voxels >= 0, "min_tumor_voxels must not be negative")
        _check(self.max_spacing_mm > 0, "max_spacing_mm must be positive")
        _check(len(self.expected_orientation) == 3 and set(self.expected_orientation.upper()) <= set("RASLPI"), f"orientation needs three of RASLPI: {self.expected_orientation!r}")
        _check(self.fail_on in ("error", "warn", "never"), f"fail_on: {self.fail_on!r}")
        self.expected_orientation = self.expected_orientation.upper()


@dataclass
class Preprocess:
    target_spacing: list[float] = field(default_factory=lambda: [1.0] * 3)
    target_orientation: str = "RAS"
    intensity_norm: str = "zscore"
    clip_percentiles: list[float] = field(default_factory=lambda: [0.5, 99.5])

    def __post_init__(self):
        _check(self.intensity_norm in ("zscore", "minmax", "none"), f"intensity_norm: {self.intensity_norm!r}")


@dataclass
class Split:
    seed: int = 42
    test: float = 0.15
    train: float = 0.7
    val: float = 0.15
    stratify_by: str | None = None
    group_by: str | None = "patient_id"

    def __post_init__(self):
        total = self.train + self.val + self.test
        _check(abs(total - 1) <= 1e-6, f"splits must sum to 1, not {total}")


@dataclass
class Config:
    name: str
    paths: Paths
    json_logs: bool = False
    log_level: str = "INFO"
    seed: int = 42
    qc: QC = field(default_factory=QC)
    preprocess: Preprocess = field(default_factory=Preprocess)
    split: Split = field(default_factory=Split)
    extra: dict[str, Any] = field(default_factory=dict)


def build(cls: type, tree: dict[str, Any]):
    """A dataclass from a tree; unknown keys are ignored, missing ones without default raise."""
    hints, kw = get_type_hints(cls), {}
    for f in fields(cls):
        if f.name in tree:
            kw[f.name] = build(hints[f.name], tree[f.name] or {}) if is_dataclass(hints[f.name]) else tree[f.name]
    try:
        return cls(**kw)
    except TypeError as e:
        raise ConfigError(str(e)) from e


def merge(base: dict, over: dict) -> dict:
    """Dicts merge, everything else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(tree: dict, dotted: str) -> None:
    """Apply "a.b=value", the value read as YAML."""
    import yaml

    key, eq, raw = dotted.partition("=")
    if not eq or not key.strip():
        raise ConfigError(f"override must be key=value: {dotted!r}")
    try:
        value = yaml.safe_load(raw)
    except yaml.YAMLError:
        value = raw
    *way, last = key.strip().split(".")
    for k in way:
        if not isinstance(tree.get(k), dict):
            tree[k] = {}
        tree = tree[k]
    tree[last] = value


def load(path: str | Path, overrides: Sequence[str] = (), base: str | Path | None = None) -> Config:
    """base.yaml beside the file is the base unless another is given."""
    import yaml

    if not (path := Path(path)).exists():
        raise FileNotFoundError(f"no such config: {path}")
    if base is None and path.name != "base.yaml" and (path.parent / "base.yaml").exists():
        base = path.parent / "base.yaml"
    tree = (yaml.safe_load(Path(base).read_text("utf-8")) or {}) if base else {}
    tree = merge(tree, yaml.safe_load(path.read_text("utf-8")) or {})
    for o in overrides:
        override(tree, o)
    return build(Config, tree)


def dump(cfg: Config) -> dict[str, Any]:
    return asdict(cfg)
