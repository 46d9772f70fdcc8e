"""Quality-control engine: rules emit finding rows, findings stamp records.

A rule is a function of a config that gives a column: a struct (severity, message), or null where the row passes. All
rules of a run are evaluated in one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import voxel_volume

SEVERITIES = ("ERROR", "WARN", "INFO")
FINDING_COLUMNS = tuple("patient_id modality check severity message filepath".split())
FINDING_SCHEMA = ", ".join(f"{c} string" for c in FINDING_COLUMNS)


@dataclass(frozen=True)
class QCConfig:
    min_shape: tuple[int, ...] = (16, 16, 16)
    expected_orientation: str = "RAS"
    max_spacing_mm: float = 5.0
    min_tumor_voxels: int = 10
    expected_modalities: tuple[str, ...] = ()


RuleFn = Callable[[QCConfig], Column]
_RULES: dict[str, RuleFn] = {}


def rule(name: str) -> Callable[[RuleFn], RuleFn]:
    """Register a rule; a name can be taken once."""

    def add(fn: RuleFn) -> RuleFn:
        if name in _RULES:
            raise ValueError(f"duplicate rule: {name}")
        _RULES[name] = fn
        return fn

    return add


def registered() -> list[str]:
    return sorted(_RULES)


def finding(severity: str, message: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def emit(cond: Column, severity: str, message: Column | str) -> Column:
    return F.when(cond, finding(severity, message))


def _py_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


@rule("file_readable")
def _readable(cfg: QCConfig) -> Column:
    """Needs file_exists and file_size_bytes, as joined from a listing."""
    c = F.col
    return emit(~F.coalesce(c("file_exists"), F.lit(False)), "ERROR", F.concat(F.lit("file missing: "), c("filepath"))).when(c("file_size_bytes") == 0, finding("ERROR", "file is zero bytes"))


@rule("corrupt_volume")
def _corrupt(cfg: QCConfig) -> Column:
    stats = [F.col(f"intensity_{s}") for s in ("min", "max", "mean")]
    none = stats[0].isNull() | stats[1].isNull() | stats[2].isNull()
    wild = [F.isnan(s) | (F.abs(s) == float("inf")) for s in stats]
    return emit(none, "ERROR", "intensity statistics unavailable").when(wild[0] | wild[1] | wild[2], finding("ERROR", "non-finite intensity values"))


@rule("empty_volume")
def _constant(cfg: QCConfig) -> Column:
    return emit(F.col("intensity_std") == 0, "ERROR", "volume is constant (zero variance)")


@rule("dimensions")
def _dimensions(cfg: QCConfig) -> Column:
    s = F.col("shape")
    small = F.coalesce(F.exists(F.zip_with(s, F.array(*map(F.lit, cfg.min_shape)), lambda a, b: F.coalesce(a < b, F.lit(False))), lambda x: x), F.lit(False))
    out = emit(s.isNull() | (F.size(s) == 0), "ERROR", "shape unavailable")
    out = out.when(F.size(s) != 3, finding("ERROR", F.concat(F.lit("expected 3D volume, got "), F.size(s).cast("string"), F.lit("D"))))
    return out.when(small, finding("ERROR", F.concat(F.lit("shape "), _py_list(s), F.lit(f" below minimum {list(cfg.min_shape)}"))))


@rule("orientation")
def _orientation(cfg: QCConfig) -> Column:
    o = F.col("orientation")
    return emit((o != "") & (F.upper(o) != cfg.expected_orientation), "WARN", F.concat(F.lit("orientation "), o, F.lit(f" != expected {cfg.expected_orientation}")))


@rule("spacing")
def _spacing(cfg: QCConfig) -> Column:
    s = F.col("voxel_spacing")
    out = emit(s.isNull() | (F.size(s) == 0), "WARN", "voxel spacing unavailable")
    out = out.when(F.exists(s, lambda x: x <= 0), finding("ERROR", F.concat(F.lit("non-positive voxel spacing "), _py_list(s))))
    return out.when(F.exists(s, lambda x: x > cfg.max_spacing_mm), finding("WARN", F.concat(F.lit("coarse spacing "), _py_list(F.transform(s, lambda x: F.round(x, 2))), F.lit(f" mm exceeds {cfg.max_spacing_mm} mm"))))


@rule("missing_mask")
def _no_mask(cfg: QCConfig) -> Column:
    return emit(~F.coalesce(F.col("mask_available"), F.lit(False)), "WARN", "no segmentation mask for this subject")


@rule("empty_mask")
def _empty_mask(cfg: QCConfig) -> Column:
    voxel = voxel_volume(F.col("voxel_spacing"))
    n = F.col("tumor_volume_mm3") / F.when(voxel > 0, voxel)
    return emit(F.col("mask_available") & (n < cfg.min_tumor_voxels), "ERROR", F.concat(F.lit("mask has ~"), F.format_string("%.0f", n), F.lit(f" labelled voxels, below minimum {cfg.min_tumor_voxels}")))


def run_rules(records: DataFrame, rules: dict[str, Column] | Sequence[str] | None = None, cfg: QCConfig | None = None, owner: str = "patient_id", item: str = "modality", path: str = "filepath") -> DataFrame:
    """One row a finding, from one scan. ``rules`` are columns by name, or names of registered rules (default: all)."""
    cfg = cfg or QCConfig()
    if not isinstance(rules, dict):
        rules = {n: _RULES[n](cfg) for n in (rules if rules is not None else registered())}
    each = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("check"), c["severity"].alias("severity"), c["message"].alias("message"))) for n, c in rules.items()]
    if not each:
        return records.sparkSession.createDataFrame([], FINDING_SCHEMA)
    f = records.select(F.col(owner).cast("string").alias("patient_id"), F.col(item).cast("string").alias("modality"), F.explode(F.array_compact(F.array(*each))).alias("f"), F.col(path).cast("string").alias("filepath"))
    return f.select("patient_id", "modality", "f.check", "f.severity", "f.message", "filepath")


def run_python_rule(records: DataFrame, name: str, fn: Callable[[dict], tuple[str, str] | None], owner: str = "patient_id", item: str = "modality", path: str = "filepath") -> DataFrame:
    """A rule in Python, batch by batch; an exception in it becomes an ERROR finding of its row."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    hit = fn(row)
                except Exception as e:  # noqa: BLE001
                    hit = ("ERROR", f"check raised {type(e).__name__}: {e}")
                if hit:
                    out.append((str(row[owner]), str(row[item]), name, hit[0], hit[1], str(row[path])))
            yield pd.DataFrame(out, columns=list(FINDING_COLUMNS))

    return records.mapInPandas(run, FINDING_SCHEMA)


def duplicate_content(records: DataFrame, digest: str = "sha256", owner: str = "patient_id", item: str = "modality", path: str = "filepath") -> DataFrame:
    """Findings of rows that share a digest.

    Across owners the rows of the first owner are INFO and those of the others ERROR; within one owner all are WARN.
    Null and empty digests are ignored. Groups come from an aggregate that is joined back, so that no window has to
    hold a group.
    """
    d = records.where((F.col(digest).isNotNull()) & (F.col(digest) != ""))
    o = F.col(owner).cast("string")
    g = d.groupBy(F.col(digest).alias("__d")).agg(F.count("*").alias("__n"), F.min(o).alias("__first"), F.max(o).alias("__last")).where("__n > 1")
    j = d.join(g, F.col(digest) == F.col("__d"))
    many = F.col("__first") != F.col("__last")
    sev = F.when(~many, "WARN").when(o == F.col("__first"), "INFO").otherwise("ERROR")
    msg = F.when(~many, F.lit("same content more than once for this owner")).when(o == F.col("__first"), F.lit("content shared with other owners; retained")).otherwise(F.concat(F.lit("content identical to that of "), F.col("__first")))
    return j.select(o.alias("patient_id"), F.col(item).cast("string").alias("modality"), F.lit("duplicate_content").alias("check"), sev.alias("severity"), msg.alias("message"), F.col(path).cast("string").alias("filepath"))


def duplicate_series(records: DataFrame, owner: str, item: str, order: Sequence[str]) -> DataFrame:
    """(owner, item, occurrence) of the second and later rows of each pair, in the order of ``order``."""
    w = Window.partitionBy(owner, item).orderBy(*order)
    return records.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1").select(owner, item, "occurrence")


def missing_sets(records: DataFrame, expected: Sequence[str], owner: str, item: str) -> DataFrame:
    """(owner, missing): the expected items, in lower case, that an owner lacks, sorted; none for a complete owner."""
    want = F.array(*(F.lit(e.lower()) for e in expected)).cast("array<string>")
    have = records.groupBy(owner).agg(F.collect_set(F.lower(item)).alias("__have"))
    return have.select(owner, F.array_sort(F.array_except(want, "__have")).alias("missing")).where(F.size("missing") > 0)


def complete_owners(records: DataFrame, required: Sequence[str], owner: str, item: str) -> DataFrame:
    """The rows of owners that have every required item; all rows if nothing is required."""
    need = sorted(set(required))
    if not need:
        return records
    ok = records.where(F.col(item).isin(need)).groupBy(owner).agg(F.count_distinct(item).alias("__n")).where(F.col("__n") == len(need)).select(owner)
    return records.join(ok, owner, "left_semi")


def apply_findings(records: DataFrame, findings: DataFrame, owner: str = "patient_id", item: str = "modality", key: str = "filepath") -> DataFrame:
    """records with qc_status (fail, warn, pass) and qc_flags (sorted distinct checks).

    A finding concerns the rows of its owner whose item it names, or all of them if it names none or is about missing
    items. ``key`` identifies a row.
    """
    whole = findings.where((F.coalesce("modality", F.lit("")) == "") | F.col("check").startswith("missing_modalities"))
    single = findings.join(whole.select("patient_id", "modality", "check", "severity"), ["patient_id", "modality", "check", "severity"], "left_anti")
    rank = F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARN", 1).otherwise(0)

    def roll(f: DataFrame, *by: str) -> DataFrame:
        return f.groupBy(*by).agg(F.max(rank).alias("r"), F.collect_set("check").alias("c"))

    one = roll(single, "patient_id", "modality").toDF("__o1", "__i1", "__r1", "__c1")
    all_ = roll(whole, "patient_id").toDF("__o2", "__r2", "__c2")
    j = records.join(one, (F.col(owner).cast("string") == F.col("__o1")) & (F.col(item).cast("string") == F.col("__i1")), "left").join(all_, F.col(owner).cast("string") == F.col("__o2"), "left")
    worst = F.greatest(F.coalesce("__r1", F.lit(0)), F.coalesce("__r2", F.lit(0)))
    none = F.array().cast("array<string>")
    return j.withColumns({"qc_status": F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass"), "qc_flags": F.array_sort(F.array_union(F.coalesce("__c1", none), F.coalesce("__c2", none)))}).drop("__o1", "__i1", "__r1", "__c1", "__o2", "__r2", "__c2")


def summarise(findings: DataFrame, records: DataFrame, owner: str = "patient_id") -> DataFrame:
    """One row: n_records, n_subjects, n_findings, n_errors, n_warnings, n_infos, failed (sorted owners), pass_rate."""
    r = records.agg(F.count("*").alias("n_records"), F.count_distinct(owner).alias("n_subjects"))
    sev = F.col("severity")
    f = findings.agg(F.count("*").alias("n_findings"), *(F.count_if(sev == s).alias(f"n_{n}") for s, n in zip(SEVERITIES, ("errors", "warnings", "infos"))), F.array_sort(F.collect_set(F.when(sev == "ERROR", F.col("patient_id")))).alias("failed"))
    return r.crossJoin(F.broadcast(f)).withColumn("pass_rate", F.when(F.col("n_subjects") == 0, 0.0).otherwise(1 - F.size("failed") / F.col("n_subjects")))


def by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check")


PHI_TAGS = ("AccessionNumber", "InstitutionAddress", "OperatorsName", "OtherPatientIDs", "OtherPatientNames", "PatientAddress", "PatientBirthDate", "PatientName", "PatientTelephoneNumbers", "PerformingPhysicianName", "ReferringPhysicianName")
#: Populated on purpose in shifted or surrogate form, so not audited.
PHI_EXEMPT = ("AcquisitionDate", "ContentDate", "PatientID", "SeriesDate", "StudyDate", "StudyTime")


def audit_phi(tags: dict[str, Column]) -> Column:
    """Names of the identifiers that are populated; blank after trimming is clean."""
    return F.array_compact(F.array(*(F.when(F.trim(c.cast("string")) != "", F.lit(n)) for n, c in tags.items())))


def phi_summary(df: DataFrame, flags: str = "phi_flags") -> DataFrame:
    """One row: n_scanned, n_flagged, clean, tags (sorted distinct)."""
    e = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.size(flags) > 0, F.col(flags))))))
    return df.agg(F.count("*").alias("n_scanned"), F.count_if(F.size(flags) > 0).alias("n_flagged"), e.alias("tags")).select("n_scanned", "n_flagged", (F.col("n_flagged") == 0).alias("clean"), "tags")


def deidentify(df: DataFrame, keep_uids: bool = True, tags: Sequence[str] = PHI_TAGS + PHI_EXEMPT) -> DataFrame:
    """Blank the identifiers that are present, but PatientID and StudyDate with ``keep_uids``; stamp the method."""
    kept = ("PatientID", "StudyDate") if keep_uids else ()
    blank = {t: F.when(F.col(t).isNotNull(), F.lit("")) for t in tags if t in df.columns and t not in kept}
    return df.withColumns({**blank, "PatientIdentityRemoved": F.lit("YES"), "DeidentificationMethod": F.lit("basic profile subset (PS3.15 Annex E)")})

