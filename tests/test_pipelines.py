"""Files, manifests, configuration, releases, streams and the three pipelines, on small real files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import config
from lodestack.pipelines import ct, mri, radiographs
from lodestack.sinks import card, logs, releases, reports
from lodestack.sources import dicom, files, imaging, manifest, nifti
from lodestack.streaming import ingest


def phantom(rng, n=16, spacing=1.0, codes="RAS"):
    x = np.zeros((n, n, n), np.float32)
    x[3:-3, 3:-3, 3:-3] = rng.normal(100, 10, (n - 6, n - 6, n - 6))
    a = np.diag([spacing, spacing, spacing, 1.0])
    return nifti.reorient(x, a, codes)


def put(path, raw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(raw)


def make_config(root, **kw):
    paths = {p: f"{root}/{p}" for p in ("raw", "interim", "processed", "outputs", "releases")}
    return config.build(config.Config, {"name": "demo", "paths": paths, **kw})


@pytest.mark.parametrize("codes", ["RAS", "LPS", "PIR", "ASL"])
def test_nifti_round_trip_and_orientation(codes):
    rng = np.random.default_rng(1)
    x, a = rng.normal(size=(4, 5, 6)).astype(np.float32), np.diag([1.0, 2.0, 3.0, 1.0])
    y, b = nifti.reorient(x, a, codes)
    assert nifti.axis_codes(b) == codes
    z, c, spacing = nifti.read(nifti.write(np.ascontiguousarray(y), b))
    np.testing.assert_array_equal(y, z)
    back, d = nifti.reorient(z, c, "RAS")
    np.testing.assert_array_equal(back, x)
    np.testing.assert_allclose(d, a, atol=1e-5)


def test_resample_keeps_labels():
    m = np.zeros((8, 8, 8), np.uint8)
    m[2:6, 2:6, 2:6] = 4
    out, a = nifti.resample(m, np.diag([2.0, 2.0, 2.0, 1.0]), (2, 2, 2), (1, 1, 1), labels=True)
    assert out.shape == (16, 16, 16) and set(np.unique(out)) <= {0, 4} and a[0, 0] == 1
    same, _ = nifti.resample(m, np.eye(4), (1, 1, 1), (1.0005, 1, 1))
    assert same is m


@pytest.mark.parametrize("method", ["zscore", "minmax", "none"])
def test_normalise_is_finite(method):
    for x in (np.zeros((3, 3, 3)), np.full((3, 3, 3), 7.0), np.arange(27.0).reshape(3, 3, 3)):
        assert np.isfinite(nifti.normalise(x, method)).all()


@pytest.fixture(scope="module")
def mri_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("mri")
    rng = np.random.default_rng(2)
    for i in range(8):
        for m in imaging.MODALITIES:
            if (i, m) == (2, "flair"):
                continue
            x, a = phantom(rng, codes="LAS" if i == 3 else "RAS")
            raw = nifti.write(np.full_like(x, 5) if (i, m) == (4, "t2") else np.ascontiguousarray(x), a)
            put(f"{root}/raw/sub{i}/sub{i}_{m}.nii.gz", raw[:60] if (i, m) == (1, "t1") else raw)
        mask = np.zeros((16, 16, 16), np.uint8)
        if i != 5:
            mask[5:9, 5:9, 5:9] = 4
        put(f"{root}/raw/sub{i}/sub{i}_seg.nii.gz", nifti.write(mask, np.eye(4)))
    for m in imaging.MODALITIES:
        with open(f"{root}/raw/sub0/sub0_{m}.nii.gz", "rb") as f:
            put(f"{root}/raw/sub9/sub9_{m}.nii.gz", f.read())
    return str(root)


def test_mri_pipeline(spark, mri_root):
    cfg = make_config(mri_root, qc={"expected_modalities": list(imaging.MODALITIES)})
    out = mri.run(spark, cfg)
    found = {(r["patient_id"], r["check"], r["severity"]) for r in spark.read.parquet(f"{cfg.paths.interim}/findings.parquet").collect()}
    for want in (("sub1", "corrupt_volume", "ERROR"), ("sub2", "missing_modalities", "ERROR"), ("sub3", "orientation", "WARN"), ("sub4", "empty_volume", "ERROR"), ("sub5", "empty_mask", "ERROR"), ("sub9", "duplicate_content", "ERROR"), ("sub9", "missing_mask", "WARN"), ("sub0", "duplicate_content", "INFO")):
        assert want in found
    doc = out["release"]
    assert {f["patient_id"] for f in doc["files"]} == {"sub0", "sub3", "sub6", "sub7"} and doc["n_subjects"] == 4
    assert sorted(sum(doc["splits"].values(), [])) == ["sub0", "sub3", "sub6", "sub7"]
    done = manifest.read(spark, f"{cfg.paths.interim}/manifest_processed.parquet")
    assert {r["orientation"] for r in done.collect()} == {"RAS"}
    assert releases.verify(spark, doc, cfg.paths.processed) == []
    with open(f"{cfg.paths.processed}/{doc['files'][0]['path']}", "ab") as f:
        f.write(b"x")
    assert releases.verify(spark, doc, cfg.paths.processed)[0].startswith("hash mismatch")
    assert mri.run(spark, cfg)["release"]["skipped"]
    assert mri.run(spark, cfg, "ingest") == {"n_records": 8 * 4 - 1 + 4}
    assert os.path.exists(f"{cfg.paths.outputs}/QC_REPORT.html")
    t = imaging.channel_table(manifest.read(spark, f"{cfg.paths.interim}/manifest_processed.parquet"), "train")
    assert t.columns == ["patient_id", *imaging.MODALITIES, "mask_path"]
    with pytest.raises(FileNotFoundError):
        mri.run(spark, make_config(mri_root + "/none"))
    assert releases.read_table(spark, f"{cfg.paths.releases}/v1.0.0/manifest.json").first()["dataset_hash"] == doc["dataset_hash"]


def test_radiograph_pipeline(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = ["FINDINGS: Large effusion.", "FINDINGS: No edema.", "IMPRESSION: possible pneumonia.", "Clear."]
    for i in range(6):
        tags = {"Modality": "CR", "ViewPosition": "LL" if i == 5 else "PA", "PatientAge": "058Y", "PatientSex": "F", "PhotometricInterpretation": "MONOCHROME1" if i else "MONOCHROME2"}
        if i == 1:
            tags["PatientName"] = "Doe"
        put(f"{tmp_path}/raw/p{i // 2}/s{i}/image.dcm", dicom.write(tags, rng.integers(0, 4000, (8, 8)).astype(np.uint16)))
        if i < 4:
            put(f"{tmp_path}/raw/reports/s{i}.txt", texts[i].encode())
    put(f"{tmp_path}/raw/p9/s9/broken.dcm", b"nope")
    out = radiographs.run(spark, make_config(tmp_path))
    assert out["stats"]["n_joined"] == 4 and out["stats"]["n_orphan_images"] == 1 and out["stats"]["low"]
    assert out["phi"]["n_flagged"] == 1 and out["phi"]["tags"] == ["PatientName"]
    assert {p["finding"]: p["positive"] for p in out["prevalence"]}["label_pleural_effusion"] == 1
    px = dicom.load_pixels(dicom.write({"PhotometricInterpretation": "MONOCHROME1"}, np.array([[0, 10]], np.uint16)))
    assert px.tolist() == [[1.0, 0.0]]
    assert dicom.load_pixels(dicom.write({}, np.array([[3, 3]], np.uint16))).tolist() == [[3.0, 3.0]]


def test_ct_pipeline(spark, tmp_path):
    rng = np.random.default_rng(4)
    lines = ["patient_id,age,sex,institution,scanner,contrast,volume_path,label_path"]
    for i in range(8):
        x, a = phantom(rng)
        put(f"{tmp_path}/raw/v{i}.nii.gz", b"bad" if i == 3 else nifti.write(np.ascontiguousarray(x), a))
        m = np.zeros((16, 16, 16), np.uint8)
        m[4:6, 4:6, 4:6] = 2
        if i != 2:
            put(f"{tmp_path}/raw/l{i}.nii.gz", nifti.write(m, a))
        lines.append(f"p{i},{40 + 5 * i},{'M' if i else 'F'},Site,GE,{'false' if i == 1 else 'true'},v{i}.nii.gz,l{i}.nii.gz")
    put(f"{tmp_path}/raw/clinical_metadata.csv", "\n".join(lines).encode())
    out = ct.run(spark, make_config(tmp_path))
    assert [t["n_after"] for t in out["attrition"]][:4] == [8, 8, 7, 6]
    assert out["release"]["n_subjects"] == out["attrition"][-1]["n_after"] == 5
    text = open(f"{tmp_path}/outputs/DATASET_CARD.md").read()
    assert all(f"## {s}" in text for s in card.SECTIONS)
    with pytest.raises(ValueError):
        ct.run(spark, make_config(tmp_path), "no such cohort")
    with pytest.raises(FileNotFoundError):
        imaging.clinical_table(spark, f"{tmp_path}/none.csv", str(tmp_path))


def test_manifest_formats_agree(spark, tmp_path):
    d = manifest.conform(spark.createDataFrame([("p", "t1", [1, 2], [1.0, 2.5], {"a": "b"}), ("q", None, None, None, None)], "patient_id string, modality string, shape array<int>, voxel_spacing array<double>, extra map<string,string>"))
    paths = manifest.write(d, f"{tmp_path}/m")
    got = {k: sorted(manifest.read(spark, p).select("patient_id", "modality", F.coalesce("shape", F.array().cast("array<int>")).alias("s"), F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("e")).collect(), key=str) for k, p in paths.items()}
    assert got["parquet"] == got["csv"] == got["json"]
    for bad in (lambda: manifest.write(d, "x", ("xml",)), lambda: manifest.read(spark, "x.xml")):
        with pytest.raises(ValueError):
            bad()


def test_missing_root_is_empty(spark):
    assert files.scan(spark, "/no/such/place").count() == 0


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("seed: 1\nqc: {min_tumor_voxels: 3, max_spacing_mm: 4}\npaths: {raw: r, interim: i, processed: p, outputs: o, releases: v}\n")
    (tmp_path / "a.yaml").write_text("name: a\nqc: {min_tumor_voxels: 5}\n")
    c = config.load(tmp_path / "a.yaml", ["split.seed=7", "qc.expected_modalities=[t1, t2]"])
    assert (c.seed, c.qc.min_tumor_voxels, c.qc.max_spacing_mm, c.split.seed, c.qc.expected_modalities) == (1, 5, 4, 7, ["t1", "t2"])
    for bad in ("split.train=0.9", "qc.fail_on=never2", "qc.max_spacing_mm=0", "qc.expected_orientation=XYZ", "novalue"):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "a.yaml", [bad])
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")
    assert config.dump(c)["qc"]["min_tumor_voxels"] == 5


def test_release_index(tmp_path):
    doc = {"dataset": "d", "version": "v1", "created_at": "2024", "dataset_hash": "h", "n_files": 0, "n_subjects": 0, "parent_version": None, "files": []}
    releases.write(doc, tmp_path)
    with pytest.raises(FileExistsError):
        releases.write(doc, tmp_path)
    (tmp_path / "releases.json").write_text("{broken")
    releases.write(doc | {"version": "v2"}, tmp_path)
    assert [r["version"] for r in json.loads((tmp_path / "releases.json").read_text())] == ["v2"]


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([("<p>", "t1", "spacing", "WARN", "m", "f")], "patient_id string, modality string, check string, severity string, message string, filepath string")
    r = spark.createDataFrame([("<p>",)], "patient_id string")
    page = open(reports.write_html(f, r, f"{tmp_path}/a.html")).read()
    assert "&lt;p&gt;" in page and "<p>t1" not in page
    assert "No findings" in open(reports.write_html(f.limit(0), r, f"{tmp_path}/b.html")).read()
    assert "further rows omitted" in card.table([{"a": i} for i in range(30)]) and card.bullets([]) == "- none found"


def test_logs():
    import logging

    r = logging.makeLogRecord({"msg": "x", "name": "n", "levelname": "INFO"})
    r.extra_field = 1
    assert json.loads(logs.JsonFormatter().format(r))["extra_field"] == 1
    assert logs.get_logger("n").process("m", {"extra": {"name": 1, "k": 2}})[1]["extra"] == {"name_": 1, "k": 2}


def test_streaming(spark, sf_dir, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(f"{tmp_path}/in")
    s = ingest.stream_records(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("at", F.col("ts").cast("timestamp"))
    q = ingest.write_available(ingest.rolling_counts(s, "at", "event_type", "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
    q = ingest.write_available(ingest.first_seen(s, "user_id", "at", "3650 days").select("user_id"), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    q.awaitTermination(120)
    got = [r[0] for r in spark.read.parquet(f"{tmp_path}/out2").collect()]
    assert len(got) == len(set(got)) == spark.read.parquet(f"{tmp_path}/in").select("user_id").distinct().count()


def test_scan_is_that_of_spark_in_few_tasks(spark, tmp_path):
    """A task for 32 files made most of the time of a scan of many small ones."""
    for i in range(1000):
        put(f"{tmp_path}/in/p{i % 300}/s{i}/a.dcm", b"x" * (i % 7))
    for name in ("top.dcm", "p1/.hidden.dcm", "_dir/x.dcm", "_k=v/x.dcm", ".dir/x.dcm", "p 2/ä b.dcm", "p3/X.DCM", "p4/x.txt", "_metadata.dcm", "p5/_x.dcm", "a/b/c/d/e/deep.dcm"):
        put(f"{tmp_path}/in/{name}", name.encode())
    os.makedirs(f"{tmp_path}/in/empty")
    os.symlink(f"{tmp_path}/nowhere", f"{tmp_path}/in/p6/broken.dcm")
    os.symlink(f"{tmp_path}/in/top.dcm", f"{tmp_path}/in/p7/link.dcm")
    for patterns in (("*.dcm",), ("*.dcm", "*.txt"), ("*",)):
        got, plain = files.scan(spark, f"{tmp_path}/in", patterns), files._binary(spark, f"file://{tmp_path}/in", patterns)
        assert got.schema == plain.schema
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        assert got.rdd.getNumPartitions() <= 16 < plain.rdd.getNumPartitions()
    flat = files.listing(spark, f"{tmp_path}/in/a/b/c/d/e")
    assert [r["length"] for r in flat.collect()] == [18] and files.listing(spark, f"{tmp_path}/in/empty").count() == 0
    gone = flat.withColumn("path", F.concat("path", F.lit("x"))).union(flat)
    assert [bytes(r["content"]) for r in files.with_content(gone, missing="drop").collect()] == [b"a/b/c/d/e/deep.dcm"]


def test_content_comes_in_bounded_batches(spark, tmp_path, monkeypatch):
    for i in range(40):
        put(f"{tmp_path}/in/f{i}", bytes([i]) * (1 << 20))
    monkeypatch.setattr(files, "BATCH_BYTES", 2 << 20)
    sizes = files.scan(spark, f"{tmp_path}/in").coalesce(1).mapInArrow(lambda bs: bs, "path string, modificationTime timestamp, length long, content binary")
    assert sorted(r["content"][0] for r in sizes.select("content").collect()) == list(range(40))


def test_training_set_computes_the_manifest_once(spark, tmp_path):
    """The check of channels and the result each computed it twice, and with it the scan that it came from."""
    for i in range(3):
        for c in ("t1", "t2", *["seg"] * (i > 0)):
            put(f"{tmp_path}/in/s{i}/s{i}_{c}.nii.gz", nifti.write(np.full((2, 2, 1), i + 1 if c != "seg" else 4, np.int16), np.eye(4)))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    m = imaging.scan_mri(spark, f"{tmp_path}/in").select("patient_id", "modality", "filepath", "mask_path")
    m = m.mapInPandas(count, m.schema).withColumn("extra", F.create_map(F.lit("split"), F.when(F.col("patient_id") != "s2", "train").otherwise("test")))
    got = {r["patient_id"]: r for r in imaging.training_set(spark, m, f"{tmp_path}/in", "train", ("t1", "t2")).collect()}
    assert seen.value == 6
    assert {k: (r["shape"], r["image"], r["mask"]) for k, r in got.items()} == {"s0": ([2, 2, 1], [[1.0] * 4] * 2, [0] * 4), "s1": ([2, 2, 1], [[2.0] * 4] * 2, [4] * 4)}
    with pytest.raises(KeyError):
        imaging.training_set(spark, m, f"{tmp_path}/in", "train", ("t1", "flair"))
    os.remove(f"{tmp_path}/in/s0/s0_t1.nii.gz")
    os.remove(f"{tmp_path}/in/s0/s0_t2.nii.gz")
    assert [r["patient_id"] for r in imaging.training_set(spark, m, f"{tmp_path}/in", "train", ("t1", "t2")).collect()] == ["s1"]
