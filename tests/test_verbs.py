"""Rasters to alerts, end to end on a planted change, and the files in between."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixeltide.plans import verbs as V
from pixeltide.sources import models as M, scenes, tiff
from pixeltide.streaming.arrivals import each_arrival

H, W = 12, 10
BANDS = ("r", "n")


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(0)
    days = pd.date_range("2018-01-05", "2020-12-20", freq="21D")
    rows = []
    for d in days:
        season = 0.1 * np.cos(2 * np.pi * (d - days[0]).days / 365.25)
        for p in range(H * W):
            rows.append((p, d.date(), float(0.4 + season + rng.normal(0, 0.01)), float(0.5 - season + rng.normal(0, 0.01))))
    return spark.createDataFrame(rows, "pixel_id int, acq_date date, r double, n double").repartition(4).cache()


@pytest.fixture(scope="module")
def config():
    return V.Config(bands=BANDS, height=H, width=W, input_quality_screened=True, min_stable_pixels=60, state_source="observation", scales=((5, 3),))


def test_train_calibrate_detect(spark, cube, config, tmp_path):
    meta, coef = V.train(cube, config)
    path = str(tmp_path / "model")
    M.write_model(path, meta, coef)
    meta, coef = M.read_model(spark, path)
    M.check_contract(meta, 2)
    predict = V.predictor(meta, coef)
    profile, audit = V.calibrate(cube, predict, config)
    M.embed_profile(path, profile)
    profile = spark.read.schema(M.PROFILE_SCHEMA).json(f"{path}/profile")
    row = profile.first()
    assert row["alpha"] == 0.01 and row["fusion_threshold"] > 0 and audit.where("accepted").count() >= 4
    assert len(row) == 26
    burnt = {3 * W + 4, 3 * W + 5, 4 * W + 4, 4 * W + 5}
    late = cube.groupBy("pixel_id").agg(F.max_by("r", "acq_date").alias("r"), F.max_by("n", "acq_date").alias("n"), F.max("acq_date").alias("acq_date"))
    late = late.withColumn("n", F.when(F.col("pixel_id").isin(*burnt), F.col("n") - 0.3).otherwise(F.col("n"))).withColumn("r", F.when(F.col("pixel_id").isin(*burnt), F.col("r") + 0.2).otherwise(F.col("r")))
    decided = V.detect(late, predict, profile, config)
    hits = {r["pixel_id"] for r in decided.where("mask").collect()}
    assert burnt <= hits and len(hits) <= len(burnt) + 3
    summary = V.summarised(decided, config)
    alert = json.loads(M.alerts(summary, "2021-01-01T00:00:00Z").first()["alert"])
    assert alert["type"] == "anomaly" and alert["regions"] >= 1
    points = spark.createDataFrame([(4.5, 3.5, 1), (0.5, 0.5, 0)], "x double, y double, label int")
    m = V.evaluate(decided, points, config).first()
    assert (m["tp"], m["n"]) == (1, 2)
    rmse = V.extrapolation_rmse(cube, predict, config, "2020-06-01", "2020-12-31").collect()
    assert rmse and all(r["rmse"] < 0.03 for r in rmse)
    far = V.query_points(spark.createDataFrame([(5, "2023-06-01")], "pixel_id int, d string").select("pixel_id", F.to_date("d").alias("acq_date")), meta, coef).first()
    assert 0.2 < far["r_mean"] < 0.6 and far["r_std"] > 0


def test_contracts(cube, config):
    with pytest.raises(ValueError, match="input_quality_screened"):
        V.train(cube, V.Config(bands=BANDS, height=H, width=W))
    with pytest.raises(ValueError, match="n_bands.*mode"):
        M.check_contract({"n_bands": 3}, 2)


def test_profile_versions(spark):
    with pytest.raises(ValueError, match="older"):
        M.profile_from(spark, {"schema_version": 3})
    with pytest.raises(ValueError, match="rule"):
        M.profile_from(spark, {"schema_version": 4, "decision_rule": "x"})
    row = M.profile_from(spark, {"schema_version": 4, "decision_rule": M.D.DECISION_RULE, "alpha": 0.01, "unheard_of": 1}).first()
    assert row["alpha"] == 0.01


@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("kind", ["u2", "i2", "f4"])
def test_tiff_round_trip(deflate, kind):
    values = (np.random.default_rng(1).random((7, 5, 3)) * 100).astype(kind)
    back = tiff.read(tiff.write(values, (0.5, 0, 10, 0, -0.25, 20), deflate=deflate))
    assert np.array_equal(back.values, values) and back.transform == (0.5, 0, 10, 0, -0.25, 20) and back.crs == "EPSG:4326"


def test_scenes_to_cube(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {}
    for name in ("S2_a_2020-01-05_1030.tif", "S2_b_2020-01-05_1100.tif", "S2_a_2020-02-01_1030.tif", "undated.tif"):
        made[name] = rng.integers(0, 12000, (6, 5, 3)).astype("u2")
        (tmp_path / name).write_bytes(tiff.write(made[name]))
    cube = scenes.load_cube(spark, str(tmp_path), [1, 3], ["x", "y"], start="2020-01-01", end="2020-01-31")
    got = {(r["row"], r["col"]): (r["x"], r["y"]) for r in cube.collect()}
    pair = np.stack([made[n][..., [0, 2]] * 1e-4 for n in list(made)[:2]])
    pair[(pair <= 0) | (pair > 1)] = np.nan
    with np.errstate(all="ignore"):
        want = np.nanmedian(pair, axis=0)
    assert len(got) == 30
    for (r, c), v in got.items():
        for a, b in zip(v, want[r, c], strict=True):
            assert (a is None and np.isnan(b)) or a == pytest.approx(b, abs=1e-6)
    facts = scenes.scenes(scenes.files(spark, str(tmp_path))).collect()
    assert {(r["height"], r["width"], r["n_bands"]) for r in facts} == {(6, 5, 3)}
    assert scenes.dated_before(scenes.files(spark, str(tmp_path)), "2020-01-05T11:00:00").count() == 2
    window = scenes.load_cube(spark, str(tmp_path), [1], ["x"], window=(1, 2, 3, 2), end="2020-01-31").collect()
    assert {(r["row"], r["col"]) for r in window} == {(r, c) for r in range(2) for c in range(3)}
    with pytest.raises(ValueError, match="source_band_indices"):
        scenes.observations(scenes.files(spark, str(tmp_path)), [], [])
    zero = scenes.observations(scenes.files(spark, str(tmp_path), "S2_a_2020-02*"), [2], ["x"], mode="zero").agg(F.min("x"), F.max("x")).first()
    assert zero[0] >= 0 and zero[1] <= 1


def test_container_header(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(M.container({"n_bands": 5, "name": "é"}, b"\x00\xff"))
    row = M.container_headers(spark, str(tmp_path)).first()
    assert json.loads(row["header"]) == {"n_bands": 5, "name": "é"}


def test_quantized_coefficients(spark):
    coef = spark.createDataFrame([(1, [0.5, -0.25, 1.0]), (2, [0.1, 0.2, -1.0])], "pixel_id int, beta array<double>")
    back = M.dequantized_coefficients(M.quantized_coefficients(coef)).orderBy("pixel_id").collect()
    assert np.allclose([r["beta"] for r in back], [[0.5, -0.25, 1.0], [0.1, 0.2, -1.0]], atol=1e-4)


def test_labels_and_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text("FID,Lon,LAT,GT_Label\n1,2.5,3.5,1\n")
    assert tuple(M.read_labels(spark, str(tmp_path / "l.csv")).first()) == (2.5, 3.5, 1)
    rec = spark.createDataFrame([('["a","b"]', "c"), (None, "c")], "source_paths string, path string")
    assert [r["paths"] for r in M.source_paths(rec).collect()] == [["a", "b"], ["c"]]
    with pytest.raises(Exception, match="empty source_paths"):
        M.source_paths(spark.createDataFrame([("[]", "c")], "source_paths string, path string")).collect()


def test_check_reports_problems(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    for n, t in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / "d" / n).write_text(t)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (tmp_path / "m.csv").write_text(f"path,sha256\na,{digest('1')}\nb,{digest('x')}\nz,{digest('9')}\n")
    got = {r["path"]: r["status"] for r in V.check(spark, str(tmp_path / "d"), str(tmp_path / "m.csv")).collect()}
    assert got == {"b": "modified", "c": "untracked", "z": "missing"}


def test_arrivals_equal_batch(spark, cube, tmp_path):
    cube.limit(500).write.partitionBy("acq_date").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(cube.schema).parquet(str(tmp_path / "in"))
    each_arrival(source, lambda df: df.where("r > 0.4"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == spark.read.parquet(str(tmp_path / "in")).where("r > 0.4").count()


def test_failing_batches_are_recorded(spark, cube, tmp_path):
    cube.limit(50).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(cube.schema).parquet(str(tmp_path / "in"))
    each_arrival(source, lambda df: df.select("nothing"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert "nothing" in spark.read.parquet(str(tmp_path / "out/errors")).first()["error"]


@pytest.mark.parametrize("mode", ["no_spatial", "no_temporal", "no_prob"])
def test_ablations(spark, cube, config, mode):
    from dataclasses import replace

    meta, coef = V.train(cube, replace(config, mode=mode))
    rows = V.query_points(cube.where("pixel_id < 2"), meta, coef).collect()
    assert meta["mode"] == mode and len(rows) == cube.where("pixel_id < 2").count()
    if mode == "no_spatial":
        assert len({round(r["r_mean"], 9) for r in rows}) == len(rows) / 2
    if mode == "no_temporal":
        assert len({round(r["r_mean"], 9) for r in rows}) == 2
    if mode == "no_prob":
        assert all(r["r_std"] > 0.9 for r in rows)
    with pytest.raises(ValueError, match="mode"):
        M.check_contract(meta, 2)


def test_pictures(spark):
    from pixeltide.sources import pictures

    rows = spark.createDataFrame([(1, r, c, 0.1 * c, 0.2, 0.3, float(c), c == 3) for r in range(3) for c in range(4)], "acq_date int, row int, col int, x double, y double, z double, score double, mask boolean")
    flat = tiff.read(bytes(pictures.single_band(rows, "score", 3, 5).first()["tiff"])).values
    assert flat.shape == (3, 5, 1) and flat[1, 2, 0] == 2 and np.isnan(flat[0, 4, 0])
    shown = tiff.read(bytes(pictures.overlay(rows, ["x", "y", "z"], 3, 5).first()["tiff"])).values
    assert shown.shape == (3, 5, 3) and shown.dtype == np.uint8 and shown[0, 3, 0] > 200


@pytest.mark.parametrize("kind,tolerance", [("float32", 0), ("float16", 1e-3), ("int16", 1e-4), ("int8", 2e-2)])
def test_containers(spark, tmp_path, kind, tolerance):
    from pixeltide.sources import container as K

    w = np.random.default_rng(0).normal(size=50).astype(np.float32)
    data = K.weights_file(w, {"n_bands": 3}, kind)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "m.bin").write_bytes(K.with_profile(data, {"alpha": 0.01}))
    row = K.read_weights(spark, str(tmp_path / "w")).first()
    assert np.allclose(row["weights"], w, atol=max(tolerance, 1e-9) * max(1, np.abs(w).max()))
    assert json.loads(row["header"])["empirical_null_profile"] == {"alpha": 0.01}
    assert K.split(data)[1] == K.split(K.with_profile(data, {}))[1]
    with pytest.raises(ValueError, match="expected"):
        K.weights_of(data, 49)
    with pytest.raises(ValueError, match="too short"):
        K.split(data[:-1])
    r = np.random.default_rng(1).normal(0, 0.1, (2, 3, 4, 2)).astype(np.float32)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "r.bin").write_bytes(K.residual_file(r, {}, kind))
    got = {(x["frame_id"], x["pixel_id"]): x["residual"] for x in K.read_residuals(spark, str(tmp_path / "r")).collect()}
    assert len(got) == 24 and np.allclose([got[t, p] for t in range(2) for p in range(12)], r.reshape(24, 2), atol=6e-3 if kind == "int8" else 1e-3)


def test_command_line(spark, cube, tmp_path):
    from pixeltide import cli

    cube.write.parquet(str(tmp_path / "cube"))
    (tmp_path / "c.yaml").write_text(f"bands: [r, n]\nheight: {H}\nwidth: {W}\ninput_quality_screened: true\nmin_stable_pixels: 60\nstate_source: observation\nloss: nll\nharmonics: 2\n")
    base = ["--cube", str(tmp_path / "cube"), "--config", str(tmp_path / "c.yaml")]
    assert cli.main(["train", *base, "--out", str(tmp_path / "m")]) == 0
    assert cli.main(["calibrate", *base, "--model", str(tmp_path / "m")]) == 0
    assert cli.main(["detect", *base, "--model", str(tmp_path / "m"), "--out", str(tmp_path / "o")]) == 0
    days = cube.select("acq_date").distinct().count()
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "o" / "alerts")).collect()]
    assert len(lines) == days and {x["type"] for x in lines} <= {"anomaly", "no_anomaly"}
    assert spark.read.json(str(tmp_path / "o" / "summary")).first()["scenes"] == days


def test_input_messages(spark):
    from pixeltide.functions import masks

    df = spark.createDataFrame([(0, 3, 2, "d"), (5, 2, 2, "d"), (5, 3, 1, "d"), (5, 3, 2, None), (5, 3, 2, "d")], "n int, dims int, bands int, d string")
    got = [r[0] for r in df.select(masks.input_message(F.col("n"), F.col("dims"), F.col("bands"), 2, F.col("d"))).collect()]
    assert got == ["empty image", "image must have three dimensions", "expected 2 bands", "missing acquisition date", None]


def test_check_compares_relative_paths(spark, tmp_path):
    import hashlib

    for name, text in (("a/x.tif", "1"), ("b/x.tif", "2"), ("c/y.tif", "3"), ("z.tif", "4")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in "1234"}
    listed = [("a/x.tif", digest["2"]), ("b/x.tif", digest["2"]), ("d/y.tif", digest["3"]), ("./z.tif", digest["4"])]
    manifest = tmp_path / "manifest.csv"
    manifest.write_text("relative_path,sha256\n" + "".join(f"{p},{h}\n" for p, h in listed))
    from pixeltide import check

    found = {tuple(r) for r in check(spark, str(tmp_path), str(manifest)).collect()}
    assert found == {("a/x.tif", "modified"), ("c/y.tif", "untracked"), ("d/y.tif", "missing")}


def test_settings(tmp_path):
    from pixeltide import Config

    path = tmp_path / "run.yaml"
    path.write_text("bands: [a, b]\nheight: 3\nwidth: 4\nscales: [[5, 3]]\nalpha: 0.001\nstates: {min_days: 10}\n")
    made = Config.from_yaml(str(path))
    assert (made.bands, made.scales, made.alpha, made.states.min_days) == (("a", "b"), ((5, 3),), 0.001, 10)
    path.write_text("bands: [a]\nheight: 3\nwidth: 4\nalhpa: 0.1\n")
    with pytest.raises(ValueError, match="alhpa"):
        Config.from_yaml(str(path))
    path.write_text("bands: [a]\nheight: 3\nwidth: 4\nloss: mse\n")
    with pytest.raises(ValueError):
        Config.from_yaml(str(path))


def test_no_machine_local_tables_on_a_cluster():
    from types import SimpleNamespace

    from pixeltide.plans.shared import folder

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="elsewhere", master="spark://host:7077"), conf={})
    with pytest.raises(ValueError, match="checkpoint"):
        folder(session)
