"""Rules and edge cases of the operators on small hand-made inputs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS
from gridspark.operators import align, blocks, derive, filters, labels, missing, ml, outliers, scaling, scoring, stats, temporal, text
from gridspark.plans import cleaning, workflow
from gridspark.sources import readers, sinks

DAY = dt.date(2020, 1, 1)


def slice_frame(spark, lats, lons, z, time=DAY):
    rows = [(time, float(la), float(lo), None if z[i][j] is None else float(z[i][j]))
            for i, la in enumerate(lats) for j, lo in enumerate(lons)]
    return spark.createDataFrame(rows, "time date, lat double, lon double, v double")


def test_nearest_fill_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    lats = np.cumsum(rng.choice([0.25, 0.5, 2.0], 23))
    lons = np.cumsum(rng.choice([0.25, 1.0, 3.0], 150))  # more than two strips
    z = rng.normal(size=(23, 150))
    mask = rng.random((23, 150)) < 0.8
    mask[5:14, 20:120] = True  # a wide empty area
    df = slice_frame(spark, lats, lons, [[None if mask[i, j] else z[i, j] for j in range(150)] for i in range(23)])
    got = {(r.lat, r.lon): r.v for r in align.fill_spatial_nearest(df, "v").collect()}
    ok = [(lats[i], lons[j], z[i, j]) for i in range(23) for j in range(150) if not mask[i, j]]
    for i in range(23):
        for j in range(150):
            want = z[i, j] if not mask[i, j] else min(
                ((la - lats[i]) ** 2 + (lo - lons[j]) ** 2, la, lo, v) for la, lo, v in ok)[3]
            assert got[lats[i], lons[j]] == want


def test_nearest_fill_ties_and_few_valid_cells(spark):
    z = [[None] * 5 for _ in range(5)]
    z[1][2], z[2][1], z[2][3], z[3][2] = 1.0, 2.0, 3.0, 4.0
    df = slice_frame(spark, range(5), range(5), z)
    filled = {(r.lat, r.lon): r.v for r in align.fill_spatial_nearest(df, "v", 4).collect()}
    assert filled[2.0, 2.0] == 1.0 and filled[4.0, 2.0] == 4.0 and filled[3.0, 1.0] == 2.0
    assert align.fill_spatial_nearest(df, "v", 10).where("v IS NULL").count() == 21


def test_gradient_on_uneven_axis_equals_numpy(spark):
    lats, lons = [0.0, 1.0, 3.0, 3.5, 7.0], [0.0, 2.0, 4.0, 9.0]
    z = np.random.default_rng(1).normal(size=(5, 4))
    df = slice_frame(spark, lats, lons, z.tolist())
    got = derive.differentiate(df, ["v"], "lat").toPandas().pivot(index="lat", columns="lon", values="v_lat_gradient")
    np.testing.assert_allclose(got.to_numpy(), np.gradient(z, lats, axis=0), atol=1e-12)
    got = derive.differentiate(df, ["v"], "lon").toPandas().pivot(index="lat", columns="lon", values="v_lon_gradient")
    np.testing.assert_allclose(got.to_numpy(), np.gradient(z, lons, axis=1), atol=1e-12)


def test_euphotic_depth_edges(spark):
    df = spark.createDataFrame([(0.0,), (None,), (0.01,), (-1.0,), (1.0,)], "kd490 double")
    got = [r[0] for r in df.select(derive.euphotic_depth_clipped()).collect()]
    assert got == [200.0, 0.0, 200.0, 0.0, 4.605]
    assert [r[0] for r in df.select(derive.euphotic_depth()).limit(2).collect()] == [None, None]


def test_season_numbers(spark):
    df = spark.createDataFrame([(dt.date(2020, m, 1),) for m in range(1, 13)], "time date")
    assert [r[0] for r in df.select(derive.season()).collect()] == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]


def test_threshold_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 3.0, 10.0, 25.0, 0.1)], "chl double")
    assert [r.level for r in labels.label_by_threshold(df, "four").collect()] == [
        "LOW", "MEDIUM", "HIGH", "CRITICAL", "LOW"]
    edge = spark.createDataFrame([(x,) for x in (0.0, 1.0, 3.0, 5.0, 101.0, None)], "chl double")
    by = {s: [r[0] for r in edge.select(labels.level(F.col("chl"), s)).collect()] for s in labels.THRESHOLDS}
    assert by["api"] == ["LOW", "MEDIUM", "HIGH", "HIGH", "HIGH", None]
    assert by["series"] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]
    assert by["map"] == [None, "LOW", "MEDIUM", "HIGH", None, None]
    assert by["closed"] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", None]
    with pytest.raises(ValueError):
        labels.label_by_threshold(df, "other")


def test_index_weights_fall_back():
    assert labels.index_weights(["CHL", "pp"]) == pytest.approx({"CHL": 0.6, "pp": 0.4})
    assert labels.index_weights(["my_chl"]) == {"my_chl": 1.0}
    assert labels.index_weights(["a", "b"]) == {"a": 0.5, "b": 0.5}


def test_constant_indicator_keeps_its_weight(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "chl double, pp double")
    got = [r.pollution_index for r in labels.pollution_index(df, ["chl", "pp"]).orderBy("chl").collect()]
    assert got == pytest.approx([0.0, 0.6])


def test_risk_levels(spark):
    df = spark.createDataFrame([("LOW", 0.9), ("HIGH", 0.6), ("CRITICAL", 0.7), ("?", 0.1), (None, None)],
                               "level string, confidence double")
    assert [r[0] for r in df.select(labels.risk_level()).collect()] == [
        "LOW_RISK", "HIGH_RISK_LOW_CONFIDENCE", "CRITICAL_RISK", "UNKNOWN_LOW_CONFIDENCE", "UNKNOWN"]


def test_cleaning_removes_outliers_and_gaps(spark):
    rng = np.random.default_rng(42)
    a = np.concatenate([rng.normal(0, 1, 90), [100, -100]])
    pdf = pd.DataFrame({"A": a, "B": rng.normal(10, 2, 92), "C": rng.exponential(1, 92)})
    rows = [tuple(map(float, r)) for r in pdf.to_numpy()] + [(None, 1.0, 1.0), (float("inf"), 10.0, 1.0)]
    got = outliers.drop_outliers(spark.createDataFrame(rows, "A double, B double, C double"), ["A", "B", "C"]).toPandas()
    assert 0 < len(got) <= 90 and not got.isnull().any().any() and np.isfinite(got.to_numpy()).all()


def test_unknown_methods_are_refused(spark):
    df = spark.createDataFrame([(DAY, 0.0, 0.0, 1.0)], "time date, lat double, lon double, v double")
    for call in (lambda: missing.fill_missing(df, ["v"], "cubic"), lambda: outliers.outlier_flags(df, ["v"], "isolation_forest"),
                 lambda: outliers.handle_outliers(df, ["v"], "drop"), lambda: scaling.scale(df, ["v"], "quantile"),
                 lambda: stats.spatial_series(df, "v", "mode"), lambda: derive.productivity("x"),
                 lambda: missing.impute_features(df, ["chl"], variant="x"), lambda: sinks.write_grid(df, "x", "zarr"),
                 lambda: workflow.run([df], ["deploy"])):
        with pytest.raises(ValueError):
            call()


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (1.0, 6.0)], "a double, b double")
    got = [(r.a, r.b) for r in scaling.scale(df, ["a", "b"], "minmax", (0, 10)).collect()]
    assert got == [(1.0, 0.0), (1.0, None), (1.0, 10.0)]
    assert [r.a for r in scaling.scale(df, ["a"], "standard").collect()] == [0.0] * 3
    params = scaling.fit_scaler(df, ["a", "b"])
    assert params.first()["a_std"] == 1.0
    assert [r.b for r in scaling.apply_scaler(df, params, ["b"]).collect()] == [-1.0, None, 1.0]


def test_parse_kv_keeps_last_and_drops_bad(spark):
    df = spark.createDataFrame([("chl=1.5 PP=300 x KD490=bad chl=2",), ("PP = 3, kd490=0.1,CDM=",), ("",)], "s string")
    got = [r[0] for r in df.select(text.parse_kv("s")).collect()]
    assert got[0] == {"PP": 300.0, "CHL": 2.0} and got[2] == {}
    assert df.select(text.parse_kv("s", ",")).collect()[1][0] == {"PP": 3.0, "KD490": 0.1}


def test_share_links(spark):
    urls = ["https://h/file/d/AB_c-1/view", "https://h/open?id=Z9", "https://h/d/q1/", "https://h/d/q2", "https://h/none/x.nc?y=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.file_id("u")).collect()] == ["AB_c-1", "Z9", "q1", "q2", None]
    assert [r[0] for r in df.select(text.file_name("u")).collect()] == [None, None, None, None, "x.nc"]


def test_impute_variants(spark):
    df = spark.createDataFrame([(2.0, None)], "chl double, pp double")
    names = ["CHL_uncertainty", "xPP", "GREEN", "my_CDM", "KD_x", "other", "pp"]
    cli = missing.impute_features(df, names, {"other": 9.0}, "cli").select(*names).first()
    api = missing.impute_features(df, names, {}, "api").select(*names).first()
    assert tuple(cli) == pytest.approx((0.2, 0.0, 0.02, 0.0, 0.2, 9.0, 200.0))
    assert tuple(api) == pytest.approx((0.0, 200.0, 0.0, 0.014, 0.2, 0.0, 200.0))


def test_merge_keeps_the_first_column(spark):
    s = "time date, lat double, lon double, flags double, {} double"
    a = spark.createDataFrame([(DAY, 0.0, 0.0, 1.0, 2.0)], s.format("x"))
    b = spark.createDataFrame([(DAY, 0.0, 0.0, 5.0, 3.0), (DAY, 1.0, 0.0, 6.0, 4.0)], s.format("y"))
    got = sorted((r.lat, r.flags, r.x, r.y) for r in align.merge_grids([a, b]).collect())
    assert got == [(0.0, 1.0, 2.0, 3.0), (1.0, None, None, 4.0)]


def test_bbox_works_on_any_axis_name_and_direction(spark):
    df = spark.createDataFrame([(DAY, float(x), 0.0) for x in range(5)], "time date, latitude double, longitude double")
    assert filters.filter_bbox(df, {"latitude": (3, 1)}).count() == 3
    assert filters.canonical_coords(df).schema["lat"].metadata["units"] == "degrees_north"


def test_variable_lists(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "b"), ("b", "x"), ("a", "x")], "file string, var string")
    assert {r.file: r.variables for r in align.file_variables(df).collect()} == {"a": ["b", "x"], "b": ["x"]}
    assert [r["var"] for r in align.common_variables(df).collect()] == ["x"]


def test_filter_that_would_empty_a_column_leaves_it(spark):
    rows = [(DAY + dt.timedelta(days=i), 0.0, 0.0, float(i) if i % 3 else None, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "time date, lat double, lon double, v double, w double")
    got = temporal.temporal_filter(df, ["v", "w"], "moving_avg", 5).orderBy("time").collect()
    assert [r.v for r in got] == [r[3] for r in rows]
    assert [r.w for r in got] == [None, None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None, None]


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(DAY, 1.0, 2.0, 3.0, 4.0)], "time date, latitude double, lon double, CHL double, PP double")
    df.write.parquet(str(tmp_path / "g"))
    got = readers.read_grid(spark, str(tmp_path / "g"), ["chl", "none"], (DAY, DAY), {"lat": (0, 2)})
    assert got.columns == ["time", "lat", "lon", "chl"] and got.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = readers.read_grid(spark, str(tmp_path / "g"), ["chl"], (DAY, DAY), {"lat": (0, 2)}
                             )._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(latitude,0.0)" in plan and "GreaterThanOrEqual(time,2020-01-01)" in plan
    assert "PP" not in plan


def test_nan_becomes_null_at_the_source(spark):
    df = spark.createDataFrame([(DAY, 0.0, 0.0, float("nan"))], "time date, lat double, lon double, V double")
    assert readers.canonical(df).first()["v"] is None


def test_sample_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PP,CHL,extra\n1,2.5,x\n,bad,y\n")
    got = readers.read_samples(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["chl", "pp"] and [tuple(r) for r in got.collect()] == [(2.5, 1.0), (None, None)]
    (tmp_path / "b.csv").write_text("PP\n1\n")
    with pytest.raises(ValueError):
        readers.read_samples(spark, str(tmp_path / "b.csv"))


def test_unreadable_files_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([(DAY, 0.0, 0.0, 1.0)], "time date, lat double, lon double, chl double")
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all")
    assert readers.read_grids(spark, str(tmp_path)).count() == 1


def test_forecast_shape_and_file(spark, tmp_path):
    rng = np.random.default_rng(42)
    rows = [(DAY + dt.timedelta(days=i), 1.0, 2.0, float(rng.exponential())) for i in range(40)]
    df = spark.createDataFrame(rows, "time date, lat double, lon double, chl double")
    got = scoring.forecast(df, "2024-01-01", 3)
    assert got.count() == 3 and {"date", "predicted_level", "confidence", "risk_level"} <= set(got.columns)
    path = sinks.write_forecast(got, str(tmp_path))
    saved = spark.read.option("header", True).csv(path)
    assert saved.count() == 3 and saved.columns == got.columns
    first = got.orderBy("date").first()
    factor = 1 + 0.1 * math.sin(2 * math.pi / 365)
    assert first["features"]["chl"] == pytest.approx(rows[-1][3] * factor)
    assert first["features"]["lat"] == pytest.approx(factor)


def test_scores_fall_back_to_rules(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, chl double, pp double")
    coded = labels.encode_labels(labels.label_by_threshold(df, "series"), names=["LOW", "MEDIUM", "HIGH"], out="label")
    model = ml.train_classifier(coded, ["chl", "pp"], trees=3, max_depth=4)
    got = scoring.score_or_rules(df, model, ["chl", "pp"], classes=["HIGH", "LOW", "MEDIUM"])
    assert got.where("source = 'model' AND confidence BETWEEN 0 AND 1").count() == 200
    few = scoring.score_or_rules(df, model, ["chl", "pp"], classes=["HIGH"])
    assert few.where("source = 'rules'").count() > 0 and few.where("level IS NULL").count() == 0
    assert scoring.score_scenarios(spark).count() == 5


def test_profile_of_metadata_and_catalog(spark):
    df = spark.createDataFrame([(DAY, 0.0, 0.0, 1.0), (DAY, 1.0, 0.0, None)], "time date, lat double, lon double, v double")
    df = df.withMetadata("v", {"units": "mg", "_FillValue": -1, "valid_range": [0.0, 5.0]})
    assert stats.profile_nulls(df).first().asDict() == {
        "var": "v", "null_count": 1, "null_pct": 50.0, "dtype": "double", "has_fill_value": True}
    assert stats.profile_stats(df).select("valid_min", "valid_max", "has_null").first() == (0.0, 5.0, True)
    assert stats.catalog({"f": df}).first()["attrs"]["units"] == "mg"


def test_validation_reports_missing_dimensions(spark):
    got = {(r.severity, r["rule"], r["var"]) for r in stats.validate(
        spark.createDataFrame([(1.0, None)], "lat double, chl double")).collect()}
    assert ("issue", "missing_dimension", "time") in got and ("warning", "null_pct", "chl") in got


def test_empty_summaries(spark):
    none = spark.createDataFrame([], "level string, confidence double")
    assert stats.summary(none).first()["risk_assessment"] is None
    assert stats.batch_stats(none).first()["success_rate"] == 0.0
    assert [r.n for r in stats.level_counts(none).collect()] == [0, 0, 0]


def test_corr_matrix_drops_twins_only_when_wide(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [tuple(map(float, [*r, r[0] * 2])) for r in base]
    cols = [f"c{i}" for i in range(17)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    assert "c16" not in {r.a for r in stats.corr_matrix(df, cols).collect()}
    assert {r.a for r in stats.corr_matrix(df, ["c0", "c16"]).collect()} == {"c0", "c16"}


def test_histogram_of_a_constant(spark):
    got = stats.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 0, 2, 0] and got[0].left_edge == 1.5 and got[3].right_edge == 2.5


def test_block_functions_see_whole_tiles(spark):
    df = slice_frame(spark, range(8), range(8), [[float(i * 8 + j) for j in range(8)] for i in range(8)])
    got = blocks.apply_overlap(df, lambda p: p.assign(v=p["v"] + len(p)), 4.0, 1.0).toPandas()
    assert len(got) == 64
    # tile plus one halo row on each side, mirrored at the edge of the grid
    assert ((got["v"] - (got["lat"] * 8 + got["lon"])) == 36).all()
    total = blocks.reduce_blocks(df, lambda p: pd.DataFrame({"v": [p["v"].sum()]}), "v double", 2.0, fan_in=2)
    assert total.first()["v"] == sum(range(64))


def test_cleaning_plan_options(spark):
    rows = [(DAY + dt.timedelta(days=30 * t), float(y), float(x), float(t + y) if (t + x) % 5 else None, 5.0 + t, float(t * x))
            for t in range(9) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "time date, lat double, lon double, chl double, kd490 double, pp double")
    got = cleaning.clean(df, plan=cleaning.CleaningPlan(derive_first=True, smoothing=None))
    assert got.data.where("chl IS NULL").count() == 0 and "pp" in got.data.columns
    assert "euphotic_depth" in got.created and "pp" not in got.scaled
    row = cleaning.summary_info(got).first()
    assert row["scalers_applied"] == len(got.scaled) and row["feature_count"] == len(got.created)


def test_models_round_trip(spark, tmp_path):
    rows = [(i, float(i % 10), float(i % 3), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    model = ml.train_classifier(df, ["a", "b"], trees=3, max_depth=3)
    sinks.save_model(model, str(tmp_path / "m"), ["a", "b"], ["even", "odd"], spark, accuracy=0.5)
    loaded, info = sinks.load_model(spark, str(tmp_path / "m"))
    assert info["features"] == ["a", "b"] and info["accuracy"] == 0.5
    same = model.transform(df).select("id", "prediction").exceptAll(loaded.transform(df).select("id", "prediction"))
    assert same.count() == 0
    assert ml.importance(loaded, ["a", "b"]).count() == 2
    assert ml.tree_count(100) == 50 and ml.tree_count(7000) == 70 and ml.tree_count(10**6) == 200


def test_tree_spread_and_bootstrap(spark):
    rows = [(i, float(i % 17), float((i % 17) * 2 + i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    model = ml.train_regressor(df, ["a"], "y", trees=5, max_depth=4)
    got = ml.predict_uncertainty(model, df)
    direct = model.transform(df).select("id", F.round("prediction", 9)).exceptAll(got.select("id", F.round("prediction", 9)))
    assert direct.count() == 0 and got.where("uncertainty < 0").count() == 0
    row = ml.bootstrap(df, "y", ["id"], 300).first()
    y = np.array([r[2] for r in rows])
    assert row["low"] < y.mean() < row["high"] and abs(row["std_error"] - y.std() / math.sqrt(300)) < 0.25 * row["std_error"]


def test_nearest_fill_of_many_variables_scans_as_often_as_of_one(spark, tmp_path):
    path = str(tmp_path / "g")
    spark.range(400).selectExpr("date'2020-01-01' AS time", "double(id div 20) AS lat", "double(id % 20) AS lon",
                                "IF(id % 3 = 0, NULL, double(id)) AS a", "IF(id % 5 = 0, NULL, double(id)) AS b").write.parquet(path)
    grid = spark.read.parquet(path)
    leaves = [align.fill_spatial_nearest(grid, v)._jdf.queryExecution().optimizedPlan().collectLeaves().size() for v in ("a", ["a", "b"])]
    assert leaves[0] == leaves[1]
    both = align.fill_spatial_nearest(grid, ["a", "b"])
    for v in "ab":
        one = align.fill_spatial_nearest(grid, v)
        assert both.select(*COORDS, v).exceptAll(one.select(*COORDS, v)).count() == 0 == both.where(f"{v} IS NULL").count()


def test_time_ranges_prune_years(spark, tmp_path):
    path = str(tmp_path / "y")
    sinks.write_grid(spark.range(900).selectExpr("date_add(date'2019-06-01', int(id)) AS time", "0D AS lat", "1D AS lon", "double(id) AS chl"), path)
    grid = readers.read_grid(spark, path, time_range=("2020-03-01", "2020-04-30"))
    assert grid.columns == ["time", "lat", "lon", "chl"] and grid.count() == 61
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_files_without_rows(spark, tmp_path):
    from gridspark.sources.readers import files_without_rows, read_grids
    spark.createDataFrame([("2020-01-01", 1.0, 2.0, 3.0)], "time string, lat double, lon double, chl double").coalesce(1).write.parquet(str(tmp_path / "a b"))
    (tmp_path / "broken.parquet").write_bytes(b"no parquet at all")
    assert read_grids(spark, str(tmp_path)).count() == 1
    rows = files_without_rows(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["size_bytes"]) for r in rows] == [("broken.parquet", 17)]


def test_box_stats_of_many_groups(spark):
    rows = [(g if g else None, float(v)) for g in range(1200) for v in (1, 2, 3, 4, 100)] + [(5, None), (9999, None)] + [(7, float(v)) for v in range(500)]
    got = {r["g"]: r for r in stats.box_stats(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()}
    assert len(got) == 1201 and got[9999]["n"] == 0 and got[9999]["mean"] is None and got[9999]["q1"] is None
    for g in (None, 5, 1199):
        assert tuple(got[g])[1:] == (5, 22.0, 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    own = np.array([v for g, v in rows if g == 7])
    assert got[7]["n"] == 505 and got[7]["mean"] == pytest.approx(own.mean()) and got[7]["median"] == np.median(own)


def test_boxes_prune_what_is_read(spark, tmp_path):
    from pathlib import Path

    import pyarrow.parquet as pq

    grid = spark.range(24 * 40 * 40).selectExpr(
        "add_months(date'2020-01-01', int(id div 1600)) AS time", "double(id div 40 % 40) AS lat", "double(id % 40) - 20 AS lon", "rand(3) AS chl")
    box = {"lat": (3.0, 9.0), "lon": (-4.0, 2.0)}
    seen = {}
    for order in ("boxes", "time"):
        path = str(tmp_path / order)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sinks.write_grid(grid, path, order=order)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        got = readers.read_grid(spark, path, ["chl"], bbox=box)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, narrowed(grid, box).collect()))
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        plan = readers.read_grid(spark, path, ["chl"], bbox=box)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert all(f"GreaterThanOrEqual({c}" in plan and f"LessThanOrEqual({c}" in plan for c in ("lat", "lon"))
        rows = total = 0
        for file in Path(path).rglob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                ends = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
                total += group.num_rows
                if all(ends[d].min <= hi and ends[d].max >= lo for d, (lo, hi) in box.items()):
                    rows += group.num_rows
        seen[order] = rows / total
    assert seen["boxes"] <= 0.6 * seen["time"]


def narrowed(grid, box):
    for d, (lo, hi) in box.items():
        grid = grid.where(F.col(d).between(lo, hi))
    return grid.select("time", "lat", "lon", "chl")


def test_box_codes_interleave_bits(spark):
    rows = [(f"2020-01-{1 + t:02d}", float(y), float(x)) for t in range(4) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "time string, lat double, lon double").withColumn("time", F.to_date("time"))
    held, code = sinks.box_code(df)
    place = {0: 0, 1: 341, 2: 682, 3: 1023}     # quarters of the range, cut into 1,024 parts
    bits = lambda v, at: sum((place[v] >> i & 1) << (3 * i + at) for i in range(10))
    for r in held.select(F.dayofmonth("time").alias("t"), "lat", "lon", code.alias("c")).collect():
        assert r["c"] == bits(r["t"] - 1, 2) | bits(int(r["lat"]), 1) | bits(int(r["lon"]), 0)


def test_default_cleaning_by_a_plain_version(spark):
    """Fill in time, then from the nearest cell; clip at 1 and 99 percent; scale all but the target; smooth along time."""
    rng = np.random.default_rng(12)
    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(20)]
    days = np.array([d.toordinal() for d in months], dtype=float)
    v = {c: np.abs(rng.normal(5, 2, (20, 2, 6))) for c in ("chl", "sst", "pp")}
    v["sst"][:, :, 0] = np.nan                       # cells without any value: the nearest one is next to them
    for c, t, y, x in (("chl", 4, 0, 2), ("chl", 5, 0, 2), ("pp", 9, 1, 3), ("sst", 17, 1, 5)):
        v[c][t, y, x] = np.nan
    v["chl"][3, 1, 1], v["pp"][7, 0, 4] = 90.0, -40.0
    cell = lambda c, t, y, x: None if np.isnan(v[c][t, y, x]) else float(v[c][t, y, x])
    rows = [(months[t], 10.0 + y, 20.0 + x, *(cell(c, t, y, x) for c in v)) for t in range(20) for y in range(2) for x in range(6)]
    df = spark.createDataFrame(rows, "time date, lat double, lon double, chl double, sst double, pp double")
    got = cleaning.clean(df)
    want = {}
    for c, a in v.items():
        a = a.copy()
        for y in range(2):
            for x in range(6):
                known = ~np.isnan(a[:, y, x])
                if known.any():
                    a[:, y, x] = np.interp(days, days[known], a[known, y, x])
        if c == "sst":
            a[:, :, 0] = a[:, :, 1]
        a = np.clip(a, *np.percentile(a, [1, 99]))
        if c != "pp":
            a = (a - a.mean()) / (a.std() + 1e-10)
        out = np.empty_like(a)
        for y in range(2):
            for x in range(6):
                for t in range(20):
                    s = min(max(t - 3, 0), 13)      # the window of an edge stays inside
                    out[t, y, x] = np.polyval(np.polyfit(np.arange(s, s + 7), a[s:s + 7, y, x], 2), t)
        want[c] = out
    spot = {d: i for i, d in enumerate(months)}
    seen = got.data.select("time", "lat", "lon", *v).collect()
    assert len(seen) == 240
    for r in seen:
        at = spot[r["time"]], int(r["lat"]) - 10, int(r["lon"]) - 20
        assert all(abs(r[c] - want[c][at]) < 1e-6 for c in v)
    assert set(got.scaled) == {"chl", "sst"} and "season_sin" in got.created


def test_file_digests_come_from_the_bytes_and_hold_above_two_gigabytes(spark, tmp_path):
    import hashlib

    from gridspark.sources import readers

    (tmp_path / "deep dir").mkdir()
    known = {"a.txt": b"one\ntwo", "deep dir/b %41.txt": bytes(range(256)) * 9000, "packed.gz": b"\x1f\x8bno gzip"}
    for name, data in known.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.bin").touch()  # not listed
    size = (2 << 30) + 5
    with open(tmp_path / "large.dat", "wb") as f:  # a hole but for its end
        f.truncate(size - 3)
        f.seek(size - 3)
        f.write(b"end")
    want = {n.split("/")[-1]: (len(d), hashlib.md5(d).hexdigest()) for n, d in known.items()}
    digest = hashlib.md5()
    for _ in range(2 << 10):
        digest.update(bytes(1 << 20))
    digest.update(b"\0\0end")
    want["large.dat"] = (size, digest.hexdigest())
    rows = readers.file_inventory(spark, str(tmp_path)).collect()
    assert {r["filename"]: (r["size_bytes"], r["md5"]) for r in rows} == want
    assert "md5" not in readers.file_inventory(spark, str(tmp_path), checksum=False).columns


def test_small_files_come_together_in_tasks_by_their_number(spark, tmp_path):
    import hashlib

    from gridspark.sources import readers

    known = {f"{i}.txt": f"file {i}\n".encode() * (1 + i % 3) for i in range(600)}
    for name, data in known.items():
        (tmp_path / name).write_bytes(data)
    listed = readers.file_inventory(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() == 8  # a task per core; the scan alone makes 19
    assert {r["filename"]: (r["size_bytes"], r["md5"]) for r in listed.collect()} == {
        n: (len(d), hashlib.md5(d).hexdigest()) for n, d in known.items()}


def test_line_files_hold_a_row_each_and_come_from_all_tasks(spark, tmp_path, monkeypatch):
    from collections import Counter

    import pandas as pd

    from gridspark.sources import readers, sinks

    texts = ["a|1", "a|1", None, "", "two\nlines", "\u00fc \u20ac", *map(str, range(94))]
    want = Counter(((x or "") + "\n").encode() for x in texts)
    rows = spark.createDataFrame([(x,) for x in texts], "v string").coalesce(1)
    held = lambda at: Counter(f.read_bytes() for f in at.rglob("[!.]*.txt"))
    sinks.write_line_files(rows, str(tmp_path / "plain"))
    assert held(tmp_path / "plain") == want
    assert len([*(tmp_path / "plain").iterdir()]) == 4  # tasks
    with pytest.raises(FileExistsError):
        sinks.write_line_files(rows, str(tmp_path / "plain"))

    # what a lost attempt has written is not listed, and another attempt does not touch it
    monkeypatch.setattr(sinks, "FOLDER_FILES", 2)
    lost = [[*sinks._line_files(str(tmp_path / "plain"))(iter([pd.DataFrame({"line": [b"x", b"y", b"z"]})]))] for _ in range(2)]
    folders = [tmp_path / "plain" / f"_{x['name'][0]}" for (x,) in lost]
    assert all(sorted(str(f.relative_to(d)) for f in d.rglob("*.txt")) == ["0/0.txt", "0/1.txt", "1/2.txt"] for d in folders)
    assert readers.file_inventory(spark, str(tmp_path / "plain")).count() == len(texts)

    sinks.write_line_files(rows.limit(0), str(tmp_path / "none"))
    assert readers.file_inventory(spark, str(tmp_path / "none")).count() == 0

    # a store that only Spark writes to
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./out", f"file://{tmp_path}")
    sinks.write_line_files(rows, "viewfs://store/out/far")
    assert held(tmp_path / "far") == want
    assert len({f.name[:10] for f in (tmp_path / "far").glob("part-*")}) == 4


def test_src_6_digests_writes_its_files_from_all_tasks(spark, tmp_path, monkeypatch):
    import hashlib
    from collections import Counter

    import __spark_entry__ as entry
    from gridspark.checks import grid_queries

    rows = [("one", 1), ("one", 1), (None, 2), ("no key", None), (None, None), *((f"s{i}", i) for i in range(50))]
    spark.createDataFrame(rows, "s_name string, s_suppkey int").coalesce(1).write.parquet(str(tmp_path / "in/supplier.parquet"))
    monkeypatch.setattr(grid_queries, "shared_folder", lambda *_: str(tmp_path / "files"))
    got = entry.queries()["src_6_digests"](spark, str(tmp_path / "in")).collect()
    texts = [("|".join(str(x) for x in r if x is not None) + "\n").encode() for r in rows]
    assert Counter(map(tuple, got)) == Counter((len(t), "txt", hashlib.md5(t).hexdigest()) for t in texts)
    assert len([x for x in (tmp_path / "files").iterdir() if x.is_dir()]) == 4  # tasks
