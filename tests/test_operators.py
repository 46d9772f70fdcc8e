"""Operators on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from lodestack.functions import scalar as S
from lodestack.operators import bias, cohort, fusion, qc, quality, release, split, text, volume


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [("058Y", 58), ("012M", 1), ("100Y", 100), ("", None), (None, None), ("abc", None), ("26W", 0.5), ("73", 73), (" 365d ", 1)])
def test_parse_age(spark, raw, want):
    got = one(spark, raw, "string", S.parse_age)
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("raw,want", [("male", "M"), (" f ", "F"), ("", "U"), ("x", "U"), (None, None)])
def test_sex(spark, raw, want):
    assert one(spark, raw, "string", S.normalise_sex) == want


@pytest.mark.parametrize("age,want", [(25.0, "<40"), (40.0, "40-59"), (79.9, "60-79"), (85.0, "80+"), (None, "unknown"), (-1.0, "unknown"), (200.0, "unknown")])
def test_age_band(spark, age, want):
    assert one(spark, age, "double", S.age_band) == want


@pytest.mark.parametrize("n,want", [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (1280, "1.2 KB"), (3 << 40, "3.0 TB"), (1 << 51, "2.0 PB")])
def test_human_size(spark, n, want):
    assert one(spark, n, "long", S.human_size) == want


@pytest.mark.parametrize("raw,want", [("[1, 2.5]", [1.0, 2.5]), ("3", [3.0]), ("oops", []), (None, []), ("", [])])
def test_decode_list(spark, raw, want):
    assert one(spark, raw, "string", S.decode_list) == want


def test_relative_to(spark):
    f = lambda c: S.relative_to(c, "/data/raw")
    assert one(spark, "/data/raw/a/b.nii", "string", f) == "a/b.nii"
    assert one(spark, "/else/b.nii", "string", f) == "/else/b.nii"


RECORD = "patient_id string, modality string, filepath string, file_exists boolean, file_size_bytes long, intensity_min double, intensity_max double, intensity_mean double, intensity_std double, shape array<int>, orientation string, voxel_spacing array<double>, mask_available boolean, tumor_volume_mm3 double"
GOOD = ("p", "t1", "p/t1", True, 10, 0.0, 1.0, 0.5, 0.2, [64, 64, 64], "RAS", [1.0, 1.0, 1.0], True, 5000.0)


def changed(**kw):
    names = [x.split()[0] for x in RECORD.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD))


@pytest.mark.parametrize(
    "change,check,severity",
    [
        ({"file_exists": False}, "file_readable", "ERROR"), ({"file_size_bytes": 0}, "file_readable", "ERROR"), ({"intensity_min": None}, "corrupt_volume", "ERROR"), ({"intensity_max": math.inf}, "corrupt_volume", "ERROR"), ({"intensity_mean": math.nan}, "corrupt_volume", "ERROR"),
        ({"intensity_std": 0.0}, "empty_volume", "ERROR"), ({"shape": []}, "dimensions", "ERROR"), ({"shape": None}, "dimensions", "ERROR"), ({"shape": [64, 64]}, "dimensions", "ERROR"), ({"shape": [8, 64, 64]}, "dimensions", "ERROR"), ({"orientation": "LAS"}, "orientation", "WARN"),
        ({"voxel_spacing": None}, "spacing", "WARN"), ({"voxel_spacing": [1.0, 0.0, 1.0]}, "spacing", "ERROR"), ({"voxel_spacing": [1.0, 1.0, 6.0]}, "spacing", "WARN"), ({"mask_available": False}, "missing_mask", "WARN"), ({"tumor_volume_mm3": 3.0}, "empty_mask", "ERROR"),
    ],
)
def test_rules(spark, change, check, severity):
    got = qc.run_rules(spark.createDataFrame([GOOD, changed(**change)], RECORD)).collect()
    assert [(r["check"], r["severity"]) for r in got] == [(check, severity)]


def test_rule_registry():
    assert qc.registered() == sorted(qc.registered()) and len(qc.registered()) == 8
    with pytest.raises(ValueError):
        qc.rule("spacing")(lambda cfg: None)


def test_python_rule_reports_exceptions(spark):
    d = spark.createDataFrame([("p", "t1", "f", 0), ("q", "t1", "g", 1)], "patient_id string, modality string, filepath string, n int")
    got = qc.run_python_rule(d, "inverse", lambda r: None if 1 / r["n"] > 0 else ("WARN", "low")).collect()
    assert len(got) == 1 and got[0]["patient_id"] == "p" and "ZeroDivisionError" in got[0]["message"]


def test_duplicates(spark):
    d = spark.createDataFrame([("a", "t1", "1", "x"), ("b", "t1", "2", "x"), ("c", "t1", "3", "y"), ("c", "t2", "4", "y"), ("d", "t1", "5", ""), ("e", "t1", "6", None)], "patient_id string, modality string, filepath string, sha256 string")
    got = {(r["patient_id"], r["modality"]): r["severity"] for r in qc.duplicate_content(d).collect()}
    assert got == {("a", "t1"): "INFO", ("b", "t1"): "ERROR", ("c", "t1"): "WARN", ("c", "t2"): "WARN"}


def test_missing_and_complete(spark):
    d = spark.createDataFrame([("a", "T1"), ("a", "t2"), ("b", "t1")], "o string, m string")
    assert [tuple(r) for r in qc.missing_sets(d, ("t1", "T2"), "o", "m").collect()] == [("b", ["t2"])]
    assert qc.missing_sets(d, (), "o", "m").count() == 0
    assert {r["o"] for r in qc.complete_owners(d, ("T1", "t2"), "o", "m").collect()} == {"a"}
    assert qc.complete_owners(d, (), "o", "m").count() == 3


def test_apply_and_summarise(spark):
    r = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1"), ("c", "t1")], "patient_id string, modality string")
    f = spark.createDataFrame([("a", "t1", "spacing", "ERROR", "", ""), ("b", "t1", "orientation", "WARN", "", ""), ("b", "t1", "duplicate_content", "INFO", "", ""), ("c", "t2,flair", "missing_modalities", "ERROR", "", "")], qc.FINDING_SCHEMA)
    got = {(x["patient_id"], x["modality"]): (x["qc_status"], x["qc_flags"]) for x in qc.apply_findings(r, f).collect()}
    assert got == {("a", "t1"): ("fail", ["spacing"]), ("a", "t2"): ("pass", []), ("b", "t1"): ("warn", ["duplicate_content", "orientation"]), ("c", "t1"): ("fail", ["missing_modalities"])}
    s = qc.summarise(f, r).first()
    assert (s["n_records"], s["n_subjects"], s["n_errors"], s["failed"]) == (4, 3, 2, ["a", "c"]) and s["pass_rate"] == pytest.approx(1 / 3)
    empty = qc.summarise(f.limit(0), r.limit(0)).first()
    assert empty["pass_rate"] == 0.0 and empty["failed"] == []


COHORT = "patient_id string, age double, sex string, contrast boolean, has_label boolean, quality_score double, institution string"


def cohort_frame(spark):
    return spark.createDataFrame([(f"p{i}", 20.0 + 6 * i, "F" if i % 4 == 0 else "M", i % 3 != 0, True, 50.0 + 4 * i, "A" if i < 8 else "B") for i in range(12)], COHORT)


def test_attrition(spark):
    t = cohort.attrition(cohort_frame(spark), cohort.STRICT).orderBy("step").collect()
    assert [r["n_after"] for r in t] == [12, 12, 8, 8, 6]
    assert all(r["n_before"] - r["n_removed"] == r["n_after"] for r in t)
    assert cohort.members(cohort_frame(spark), cohort.STRICT).count() == 6
    with pytest.raises(ValueError, match="ghost"):
        cohort.attrition(cohort_frame(spark), cohort.CohortSpec("x", (cohort.Criterion("ghost", "no_such_column > 1"),)))
    assert cohort.retention(cohort.attrition(cohort_frame(spark).limit(0), cohort.STRICT)).first()["low"]


def test_bias(spark):
    d = spark.createDataFrame([("M",)] * 19 + [("F",)], "sex string")
    r = bias.with_p_value(bias.representation(d, "sex"))[0]
    assert r["severity"] == "WARN" and "dominates" in r["message"] and r["statistic"] == pytest.approx(16.2)
    even = bias.with_p_value(bias.representation(spark.createDataFrame([("M",)] * 10 + [("F",)] * 10, "sex string"), "sex"))[0]
    assert even["severity"] == "INFO" and even["statistic"] == 0
    assert bias.with_p_value(bias.representation(d.limit(0), "sex"))[0]["message"] == "no data"
    small = bias.representation(spark.createDataFrame([("M",), ("F",)], "sex string"), "sex").first()
    assert small["statistic"] is None


def test_disparity(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", 12.0), (None, 5.0), ("c", None)], "g string, v double")
    r = bias.disparity(d, "g", "v").first()
    assert (r["n_groups"], r["lo"], r["hi"], r["statistic"]) == (2, 1.5, 11.0, pytest.approx(2.4))
    flat = bias.disparity(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double"), "g", "v").first()
    assert flat["statistic"] is None and flat["effect_size"] == 1
    assert bias.disparity(d.where("g = 'a'"), "g", "v").first()["statistic"] is None
    neg = bias.with_p_value(bias.disparity(spark.createDataFrame([("a", -1.0), ("a", -2.0), ("b", 1.0), ("b", 2.0)], "g string, v double"), "g", "v"))[0]
    assert neg["effect_size"] is None and neg["severity"] == "WARN"


STUDY = "patient_id string, age double, sex string, institution string, scanner string, voxel_spacing array<double>, shape array<int>, volume array<double>, diffs array<double>"


def test_quality(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(100, 5, 64).tolist()
    rows = [("a", 50.0, "F", "X", "GE", [1.0, 1.0, 1.0], [4, 4, 4], v, [1.0, 1.1, 0.9]), ("b", None, "", None, None, None, [], None, None), ("c", 1.0, "M", "X", "GE", [1.0, 1.0, 4.0], [4], [3.0] * 64, [0.0, 0.0, 0.0]), ("d", 1.0, "M", "X", "GE", [1.0, 1.0, 1.0], [4], v, [1.0, 1.0, 0.0, 1.0, 50.0, 1.0])]
    got = {r["patient_id"]: r for r in quality.score_studies(spark.createDataFrame(rows, STUDY), diffs="diffs").collect()}
    assert got["a"]["q_integrity"] == 1 and got["a"]["q_spacing"] == 1 and got["a"]["q_continuity"] == 1
    own = np.array(v)
    fg = own[own > np.percentile(own, 60)]
    assert got["a"]["q_noise"] == pytest.approx(min(1, abs(fg.mean()) / (fg.std() + 1e-8) / 10), abs=1e-3)
    assert got["a"]["q_contrast"] == pytest.approx(min(1, (np.percentile(own, 75) - np.percentile(own, 25)) / (0.25 * np.ptp(own))), abs=1e-3)
    assert got["b"]["q_score"] == pytest.approx(100 * (0.15 / 7 + 0.10), abs=0.01) and got["b"]["q_grade"] == "F"
    assert got["c"]["q_integrity"] == 0 and got["c"]["q_continuity"] == 0 and got["c"]["q_noise"] == 0.5
    assert got["d"]["q_continuity"] == pytest.approx(1 - 0.15 - 0.2, abs=1e-3)
    assert sum(quality.WEIGHTS.values()) == pytest.approx(1)


FUSED = [("p1", "s1", 1, 0, None, -1), ("p1", "s2", 0, 1, 1, 0), ("p2", "s3", -1, 0, 0, 1), ("p3", "s4", 1, 1, 0, 0)]


def test_fusion(spark):
    t = spark.createDataFrame(FUSED, "subject string, study string, pneumonia int, edema int, cardiomegaly int, effusion int")
    for policy, want in (("zeros", 0.0), ("ones", 1.0), ("ignore", math.nan)):
        r = {x["study"]: x for x in fusion.binarise_labels(t, ("pneumonia", "cardiomegaly"), policy).collect()}
        assert r["s3"]["pneumonia"] == want or math.isnan(want) and math.isnan(r["s3"]["pneumonia"])
        assert r["s1"]["cardiomegaly"] == 0
    with pytest.raises(ValueError):
        fusion.binarise_labels(t, ("edema",), "other")
    p = {r["finding"]: r for r in fusion.prevalence(t, ("cardiomegaly",)).collect()}["cardiomegaly"]
    assert (p["positive"], p["negative"], p["uncertain"], p["not_mentioned"], p["prevalence"]) == (1, 2, 0, 1, 0.25)
    tl = {r["study"]: (r["study_order"], r["n_studies"]) for r in fusion.timeline(t, "subject", "study").collect()}
    assert tl == {"s1": (1, 2), "s2": (2, 2), "s3": (1, 1), "s4": (1, 1)}
    a, b = spark.createDataFrame([("s1",), ("s2",)], "k string"), spark.createDataFrame([("s1",), ("s3",)], "k string")
    s = fusion.join_stats(a, b, "k").first()
    assert (s["n_joined"], s["n_orphan_images"], s["n_orphan_reports"], s["join_rate"], s["low"]) == (1, 1, 1, 0.5, True)
    assert fusion.join_stats(a.limit(0), b, "k").first()["join_rate"] == 0
    assert fusion.filter_views(spark.createDataFrame([("pa",), (None,)], "v string"), "v", ("PA",)).count() == 1
    assert fusion.filter_views(spark.createDataFrame([("pa",), (None,)], "v string"), "v", ()).count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 20, 300])
def test_split_sizes(spark, n):
    d = spark.createDataFrame([(f"p{i}", float(i)) for i in range(n) for _ in range(2)], "s string, v double")
    got = split.split_grouped(d, "s")
    assert got.count() == n and split.leaks(got, "s").count() == 0
    c = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    if n >= 3:
        t = min(max(1, round(n * 0.7)), n - 2)
        assert (c["train"], c["val"]) == (t, max(1, round(n * 0.15)))
    elif n:
        assert c == {"train": n}
    again = {r["s"]: r["split"] for r in split.split_grouped(d.orderBy("v"), "s").collect()}
    assert again == {r["s"]: r["split"] for r in got.collect()}
    st = split.split_stratified(d, "s", "v")
    assert st.count() == n
    if n >= 9:
        assert {r["stratum"] for r in st.collect()} == {"low", "mid", "high"}


def test_leak_raises(spark):
    with pytest.raises(split.LeakageError):
        split.verify_no_leakage(spark.createDataFrame([("a", "train"), ("a", "test")], "s string, split string"), "s")


@pytest.mark.parametrize(
    "report,want",
    [
        ("No pleural effusion.", {"pleural_effusion": 0}), ("Large pleural effusion.", {"pleural_effusion": 1}), ("Pneumonia cannot be excluded.", {"pneumonia": -1}), ("No pleural effusion. Findings compatible with pneumonia.", {"pleural_effusion": -1, "pneumonia": -1}),
        ("Possible atelectasis.", {"atelectasis": -1}), ("No pneumothorax or effusion.", {"pneumothorax": 0, "pleural_effusion": 0}), ("No effusion, but consolidation is present.", {"pleural_effusion": 0, "pneumonia": 1}), ("Heart size is normal.", {}),
        ("Small bilateral pleural effusions.", {}), ("Cardiac silhouette is enlarged.", {}), ("Cardiomegaly without acute process.", {"cardiomegaly": 1}), ("FINDINGS: no edema.\nIMPRESSION: mild edema.", {"edema": 1}), ("INDICATION: pneumonia.\nFINDINGS: clear lungs.", {}),
    ],
)
def test_labels(spark, report, want):
    d = spark.createDataFrame([(1, report)], "k int, t string").withColumn("s", text.sections(F.col("t"))).select("k", text.label_text(F.col("t"), F.col("s")).alias("t"))
    assert {r["finding"]: r["label"] for r in text.labels(d, "k", "t").collect()} == want


def test_report_parts(spark):
    d = spark.createDataFrame([(1, "intro\nFINDINGS: Moderate effusion of 3.2 cm and 5 mm.\nimpression: first\nIMPRESSION: Recommend another film. Ok."), (2, ""), (3, None)], "k int, t string")
    r = {x["k"]: x for x in text.parse_reports(d, "k", "t").collect()}
    assert r[1]["sections"] == {"preamble": "intro", "findings": "Moderate effusion of 3.2 cm and 5 mm.", "impression": "Recommend another film. Ok."}
    assert r[1]["measurements"] == [3.2, 0.5] and r[1]["severity_pleural_effusion"] == 3 and r[1]["positive_findings"] == ["pleural_effusion"]
    assert len(r[1]["recommendations"]) == 1 and r[2]["sections"] == {"preamble": ""} and r[3]["sections"] is None


def test_release(spark):
    rows = [("a", "x1", 1, "p", "t1"), ("b", "x2", None, "p", "t2"), ("c", None, 5, "q", "t1"), ("d", "", 5, "q", "t1")]
    d = spark.createDataFrame(rows, "path string, sha string, size long, owner string, item string")
    e = release.file_entries(d, "path", "sha", "size", "owner", "item")
    assert e.count() == 2 and release.dataset_hash(e).first()[0] == release.dataset_hash(e.orderBy(F.desc("path"))).first()[0]
    t = release.totals(d, "sha", "size", "owner").first()
    assert (t["n_files"], t["n_subjects"], t["total_bytes"]) == (2, 2, 1)
    disk = spark.createDataFrame([("a", "other")], "path string, sha256 string")
    p = {r["path"]: r["problem"] for r in release.verify(e, disk).collect()}
    assert p["b"] == "missing: b" and p["a"].startswith("hash mismatch: a")
    i = spark.createDataFrame([("v1", "h1", "2024")], "version string, dataset_hash string, created_at string")
    n = spark.createDataFrame([("v1", "h2", "2025"), ("v2", "h3", "2023")], i.schema)
    assert [tuple(r) for r in release.upsert_index(i, n).collect()] == [("v2", "h3", "2023"), ("v1", "h2", "2025")]


def test_volume(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0, 2.0, 4.0, 6.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0])], "k int, v array<double>")
    z = {r["k"]: r["v"] for r in volume.normalised(d, "k", "v").collect()}
    assert sum(z[1]) == pytest.approx(0, abs=1e-9) and z[2] == [0, 0] and z[3] == [0, 0]
    assert {r["k"]: r["v"] for r in volume.normalised(d, "k", "v", "minmax").collect()}[3] == [0, 0]
    with pytest.raises(ValueError):
        volume.normalised(d, "k", "v", "other")
    m = spark.createDataFrame([(1, True, True), (1, True, False), (2, False, False), (3, True, False)], "k int, p boolean, t boolean")
    assert {r["k"]: (r["dice"], r["iou"]) for r in volume.overlap(m, "k", "p", "t").collect()} == {1: (pytest.approx(2 / 3), 0.5), 2: (1, 1), 3: (0, 0)}
    a = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 3, 4)], "k int, x int, y int")
    assert {r["k"]: r["hd95"] for r in volume.hausdorff95(a, b, "k", ("x", "y")).collect()} == {1: 5.0, 2: math.inf}
    h = volume.histogram(spark.createDataFrame([(float(i),) for i in range(11)] + [(math.nan,)], "v double"), "v", 10)
    assert {r["bin"]: r["n"] for r in h.collect()} == {**{i: 1 for i in range(9)}, 9: 2}


def test_strata_of_a_category(spark):
    rows = [(1, "b", 2), (1, "a", 3), (1, None, 1), (2, "", 1), (3, None, 1), (4, "c", 1), (4, "a", 1)]
    d = spark.createDataFrame(rows, "s long, v string, o int")
    assert dict(map(tuple, split.strata(d, "s", "v", "o").collect())) == {1: "b", 2: "all", 3: "all", 4: "a"}
    assert dict(map(tuple, split.strata(d, "s", "v").collect())) == {1: "a", 2: "all", 3: "all", 4: "a"}
    got = split.split_stratified(spark.createDataFrame([(i, "xy"[i % 2]) for i in range(40)], "s long, v string"), "s", "v").groupBy("stratum", "split").count().collect()
    assert {(r["stratum"], r["split"]): r["count"] for r in got} == {(k, p): n for k in "xy" for p, n in (("train", 14), ("val", 3), ("test", 3))}
    assert split.split_stratified(d.limit(0), "s", "v").count() == 0


def test_entry_imports_only_what_is_missing(monkeypatch):
    import builtins
    import importlib
    import sys

    import pytest

    plain = builtins.__import__
    for missing, ok in (("corpus_pipeline", True), ("ahocorasick", False)):
        def fail(name, *a, missing=missing, **k):
            if name in (missing, "corpus_pipeline"):
                raise ModuleNotFoundError(f"no {missing}", name=missing)
            return plain(name, *a, **k)

        monkeypatch.setattr(builtins, "__import__", fail)
        monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
        if ok:
            assert "pipeline" not in importlib.import_module("__spark_entry__").queries()
        else:
            with pytest.raises(ModuleNotFoundError):
                importlib.import_module("__spark_entry__")
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)


def test_nearest_points_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m, d in ((1, 1, 2), (5, 900, 3), (700, 300, 3), (2000, 2500, 1)):
        x, y = rng.integers(0, 60, (n, d)) * 1.5, rng.integers(20, 90, (m, d)) * 1.5
        want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2).min(1))
        assert np.abs(volume.nearest(x, y) - want).max() == 0


def test_distances_of_large_surfaces_take_seconds(spark):
    """Two shells of 10 000 points each: all pairs would be 10^8."""
    import numpy as np
    import time

    z, y, x = np.mgrid[0:60, 0:60, 0:60]
    r = np.sqrt((z - 30.0) ** 2 + (y - 30.0) ** 2 + (x - 30.0) ** 2)
    a, b = (np.argwhere((r < k) & (r >= k - 1)).astype(float) for k in (28, 26))
    began = time.perf_counter()
    d = volume.nearest(a, b)
    assert len(a) > 8000 and 1 < d.min() <= d.max() < 4 and time.perf_counter() - began < 10


def test_dataset_hash_is_that_of_the_whole_list(spark):
    import hashlib

    rows = [(f"p{i % 97}/{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(5000)]
    d = spark.createDataFrame(rows, "path string, sha256 string").repartition(7)
    assert release.dataset_hash(d).first()[0] == hashlib.sha256("\n".join(sorted(f"{p}:{s}" for p, s in rows)).encode()).hexdigest()
    assert release.dataset_hash(d.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_cramers_v_of_a_table(spark):
    d = spark.createDataFrame([("a", "x")] * 30 + [("b", "y")] * 30 + [("b", None)] * 5 + [(None, "x")] * 2, "r string, c string")
    assert bias.cramers_v(d.where("r is not null and c is not null"), "r", "c").first()["effect_size"] == 1.0
    o = [[30, 0, 0], [0, 30, 5], [2, 0, 0]]
    n, chi = 67, 0.0
    for row in o:
        for k, x in enumerate(row):
            e = sum(row) * sum(r[k] for r in o) / n
            chi += (x - e) ** 2 / e
    assert bias.cramers_v(d, "r", "c").first()["effect_size"] == round(math.sqrt(chi / (n * 2)), 4)
    assert tuple(bias.cramers_v(d.limit(0), "r", "c").first()) == (0, 0.0, 0.0)


def test_continuity_of_long_volumes_takes_seconds(spark):
    """Medians are computed once a volume; once a slice, 1500 of them took minutes."""
    import time

    import numpy as np

    rng = np.random.default_rng(5)
    rows = {k: rng.normal(10, 1, 1500) for k in ("plain", "jumps", "copies")}
    rows["jumps"][[100, 700, 701]] = 90.0
    rows["copies"][[3, 4, 5, 6]] = 0.0
    rows |= {"two": np.array([1.0, 3.0]), "one": np.array([1.0]), "none": np.array([])}
    want = {"one": 1.0, "none": 1.0}
    for k, x in rows.items():
        if len(x) > 1:
            dev = np.abs(x - np.median(x))
            want[k] = max(0.0, 1 - 0.15 * (x < 1e-6).sum() - 0.10 * (dev > 8 * (np.median(dev) + 1e-8)).sum())
    d = spark.createDataFrame([(k, x.tolist()) for k, x in rows.items()] + [("null", None)], "id string, diffs array<double>").repartition(1)
    began = time.time()
    got = {r["id"]: r["c"] for r in quality.with_continuity(d, "diffs", "c").collect()}
    assert time.time() - began < 30
    assert got == pytest.approx(want | {"null": 1.0}) and 0 < got["jumps"] < 1 and 0 <= got["copies"] < 1
