"""Percentiles, draws and series helpers against numpy and pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions.draws import draw, draw_cuts
from gridspark.functions.frames import shared_folder
from gridspark.functions.quantiles import percentiles
from gridspark.operators import missing, sampling, temporal
from gridspark.operators.filters import every_nth
from gridspark.operators.series import in_blocks, position

PROBS = [0.0, 0.01, 0.25, 0.33, 0.5, 0.66, 0.95, 1.0]


def values(kind: str) -> np.ndarray:
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(35, 0.01, 4000),
        "heavy": np.concatenate([rng.pareto(0.3, 3000) * 1e6, -rng.pareto(0.3, 1000)]),
        "ties": np.concatenate([np.full(3000, 2.5), rng.integers(0, 5, 1000).astype(float)]),
        "constant": np.full(50, -7.25),
        "single": np.array([3.0]),
        "tiny": rng.normal(0, 1e-12, 500),
        "fill": np.concatenate([rng.normal(1, 0.1, 500), [1e20]]),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "constant", "single", "tiny", "fill"])
def test_ranked_percentiles_equal_numpy(spark, kind):
    v = values(kind)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    row = percentiles(df, ["v"], PROBS).first()
    assert np.allclose(row["v"], np.percentile(v, [100 * p for p in PROBS]), rtol=1e-12, atol=0)


def test_percentiles_have_the_same_bits_at_every_size(spark):
    v = [float(x) for x in values("normal")]
    once = spark.createDataFrame([(x,) for x in v], "v double")
    many = once.crossJoin(spark.range(100)).select("v").repartition(7)
    ranks = [k / (len(v) - 1) for k in (0, 17, 1000, len(v) - 1)]
    low = percentiles(once, ["v"], ranks).first()["v"]
    assert low == [sorted(v)[k] for k in (0, 17, 1000, len(v) - 1)]
    again = percentiles(many, ["v"], [(100 * k + 50) / (100 * len(v) - 1) for k in (0, 17, 1000, len(v) - 1)]).first()["v"]
    assert again == low


def test_percentiles_of_odd_values(spark):
    v = [float("-inf"), -1e308, -2.0, -5e-324, 0.0, -0.0, 5e-324, 1.0, 2.0, 1.7976931348623157e308, float("inf"), float("inf")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = percentiles(df, ["v"], [k / 11 for k in range(12)]).first()["v"]
    assert got == sorted(v)


def _stages(plan):
    """Leaves of the plan that ran: a scan counts once, however often its exchange is read again."""
    scans, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif not name.startswith("ReusedExchange"):
            scans += name.startswith("Scan")
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return scans


@pytest.mark.parametrize("cols", [["a"], ["a", "b"]])
def test_percentiles_scan_twice(spark, tmp_path, cols):
    """Once for the sketch, which is a scalar subquery, and once for the counts, whose exchange serves all buckets."""
    path = str(tmp_path / "p")
    spark.range(40_000).selectExpr("double(id) AS a", "double(id % 7) AS b").write.parquet(path)
    df = percentiles(spark.read.parquet(path), cols, [0.1, 0.9])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert _stages(plan) == 1
    row = df.first()
    assert row["a"] == [3999.9, 35999.1] and ("b" not in cols or row["b"] == [0.0, 6.0])


@pytest.mark.parametrize("shape", ["normal", "one value", "mostly zero", "few values", "two scales", "infinite"])
def test_brackets_keep_the_wanted_ranks(spark, shape):
    rng = np.random.default_rng(6)
    n = 60_000
    v = {"normal": rng.normal(size=n), "one value": np.full(n, -3.25), "mostly zero": np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n)),
         "few values": np.round(rng.exponential(size=n), 1), "two scales": np.concatenate([rng.normal(size=n // 2) * 1e-9, rng.normal(size=n // 2) * 1e9]),
         "infinite": np.concatenate([rng.normal(size=n - 40), np.full(20, np.inf), np.full(20, -np.inf)])}[shape]
    df = spark.createDataFrame(pd.DataFrame({"v": rng.permutation(v), "w": np.where(np.arange(n) % 3, np.nan, v)})).select("v", F.nanvl("w", F.lit(None)).alias("w")).repartition(7)
    probs = [0.0, 0.0001, 0.01, 0.33, 0.5, 0.95, 0.9999, 1.0]
    row = percentiles(df, ["v", "w"], probs).first()
    def plain(x):
        spots = [(len(x) - 1) * p for p in probs]
        lo, hi = [[np.sort(x)[int(f(s))] for s in spots] for f in (np.floor, np.ceil)]
        return [a if a == b else a + (b - a) * (s - np.floor(s)) for a, b, s in zip(lo, hi, spots)]
    assert np.allclose(row["v"], plain(v), rtol=1e-12, atol=0)
    assert np.allclose(row["w"], plain(v[np.arange(n) % 3 == 0]), rtol=1e-12, atol=0)


def test_ranked_percentiles_by_group_and_column(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900, p=[0.8, 0.1, 0.1]), "x": rng.normal(size=900),
                        "y": rng.integers(0, 9, 900).astype(float)})
    df = spark.createDataFrame([tuple(None if r is None else r for r in t) for t in pdf.itertuples(index=False)],
                               "g string, x double, y double")
    df = df.union(spark.createDataFrame([("empty", None, None)], "g string, x double, y double"))
    got = {r["g"]: r for r in percentiles(df, ["x", "y"], [0.1, 0.5], by=["g"]).collect()}
    assert set(got) == {"a", "b", None, "empty"}
    assert got["empty"]["x"] is None
    for g in ("a", "b", None):
        part = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        for c in ("x", "y"):
            assert np.allclose(got[g][c], np.percentile(part[c], [10, 50]))


def test_ranked_percentiles_of_nothing(spark):
    row = percentiles(spark.createDataFrame([], "v double"), ["v"], [0.5]).collect()
    assert len(row) == 1 and row[0]["v"] is None


def test_shared_folder_is_under_the_cluster_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a.startswith(base) and a != b


def test_draw_cuts_pick_exact_numbers(spark):
    df = spark.range(1237).withColumn("c", (F.col("id") % 3 == 0).cast("int"))
    cuts = draw_cuts(df, 1, ["id"], {"none": F.lit(0), "some": F.lit(100), "all": F.col("n")}).first()
    h = df.select(draw(1, ["id"]).alias("h"))
    assert cuts["none"] == ""
    assert h.where(F.col("h") <= cuts["some"]).count() == 100
    assert h.where(F.col("h") <= cuts["all"]).count() == 1237


def test_split_sizes_are_exact_and_disjoint(spark):
    got = sampling.split(spark.range(1000), ["id"], 0.2, 0.1).cache()
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {
        "test": 200, "val": 100, "train": 700}
    assert got.select("id").distinct().count() == 1000
    again = sampling.split(spark.range(1000).repartition(7), ["id"], 0.2, 0.1)
    assert got.exceptAll(again).count() == 0


def test_stratified_split_and_small_classes(spark):
    df = spark.range(103).withColumn("label", F.when(F.col("id") < 3, 1).otherwise(0))
    got = {(r["label"], r["split"]): r["count"] for r in
           sampling.split_stratified(df, "label", ["id"]).groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 20, (0, "train"): 80, (1, "train"): 3}


def test_folds_have_equal_sizes(spark):
    df = spark.range(100).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    got = sampling.folds(df, ["id"], 5, "label").groupBy("label", "fold").count().collect()
    assert {(r["label"], r["fold"]): r["count"] for r in got} == {
        **{(0, i): 15 for i in range(5)}, **{(1, i): 5 for i in range(5)}}


def test_sample_larger_than_the_data(spark):
    df = spark.range(10).withColumn("v", F.when(F.col("id") > 3, 1.0))
    assert sampling.sample_cells(df, "v", 50, keys=["id"]).count() == 6
    assert sampling.sample_cells(df, "v", 2, keys=["id"]).count() == 2


def test_temporal_split_keeps_steps_together(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("time"))
    got = {r["time"]: r["split"] for r in sampling.split_temporal(df).distinct().collect()}
    assert [got[t] for t in range(10)] == ["train"] * 7 + ["val"] + ["test"] * 2 or len(got) == 10
    assert got[9] == "test" and got[0] == "train"


@pytest.fixture(scope="module")
def station(spark):
    """One long irregular series that holds most rows, and short ones, with gaps."""
    rng = np.random.default_rng(11)
    rows = []
    for name, n in (("hot", 900), ("mid", 8), ("one", 1)):
        day = dt.date(1990, 1, 1)
        for _ in range(n):
            day += dt.timedelta(days=int(rng.integers(1, 40)))
            rows.append((name, day, None if rng.random() < 0.45 else float(rng.normal(3, 1)), float(rng.normal())))
    return spark.createDataFrame(rows, "cell string, time date, v double, w double").cache()


def as_pandas(df):
    return df.toPandas().sort_values(["cell", "time"]).reset_index(drop=True)


def test_position_counts_within_series(station):
    got = as_pandas(position(station, ["cell"]))
    assert (got["_rn"] == got.groupby("cell").cumcount()).all()


@pytest.mark.parametrize("op, reach", [
    (lambda d, k: missing.ffill(d, ["v"], 3, k), 3), (lambda d, k: missing.bfill(d, ["v"], 3, k), 3),
    (lambda d, k: temporal.moving_avg(d, ["v", "w"], 5, k), 4), (lambda d, k: temporal.savgol(d, ["w"], 7, 2, k), 6),
    (lambda d, k: temporal.median_filter(d, ["v", "w"], 7, k), 6), (lambda d, k: temporal.diff_time(d, ["w"], 1, k), 1)])
def test_blocks_give_the_results_of_whole_series(station, op, reach):
    whole = as_pandas(op(station, ["cell"]))
    cut = as_pandas(in_blocks(station, op, reach, cell=["cell"], block_rows=50))
    pd.testing.assert_frame_equal(whole, cut[whole.columns])


def test_long_interpolation_equals_plain(station):
    plain = as_pandas(missing.interpolate_time(station, ["v"], cell=["cell"]))
    long = as_pandas(missing.interpolate_time(station, ["v"], cell=["cell"], long_series=True))
    pd.testing.assert_frame_equal(plain, long[plain.columns])


def test_interpolation_limits_each_gap(spark):
    v = [None, 1.0, None, None, None, None, 6.0, None, 8.0, None]
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(v)]
    got = as_pandas(missing.interpolate_time(spark.createDataFrame(rows, "cell string, time date, v double"), ["v"], 3, ["cell"]))
    want = [None, 1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0, None]
    assert [None if math.isnan(x) else round(x, 9) for x in got["v"]] == want


@pytest.mark.parametrize("piece, rows", [(None, None), (5000.0, 200), (40.0, 160)])
def test_ewm_equals_pandas(station, piece, rows):
    got = as_pandas(temporal.ewm(station, ["v", "w"], 7, ["cell"], piece=piece, rows=rows))
    src = as_pandas(station)
    for name, part in src.groupby("cell"):
        for c in ("v", "w"):
            want = part[c].ewm(span=7, adjust=True).mean() if len(part) >= 7 else part[c]
            np.testing.assert_allclose(got.loc[got.cell == name, c].to_numpy(), want.to_numpy(), rtol=1e-9)


def test_ewm_keeps_the_mean_over_a_gap_longer_than_a_piece(spark):
    v = [1.0, 3.0] + [None] * 700 + [5.0] * 3
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(v)]
    got = as_pandas(temporal.ewm(spark.createDataFrame(rows, "cell string, time date, v double"), ["v"], 7, ["cell"], rows=200))
    want = pd.Series(v, dtype=float).ewm(span=7, adjust=True).mean()
    np.testing.assert_allclose(got["v"], want, rtol=1e-9)


def test_savgol_reproduces_a_parabola(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i * i - 3 * i)) for i in range(12)]
    got = as_pandas(temporal.savgol(spark.createDataFrame(rows, "cell string, time date, v double"), ["v"], cell=["cell"]))
    np.testing.assert_allclose(got["v"], [i * i - 3 * i for i in range(12)], atol=1e-9)


def test_short_series_stay_as_they_are(spark):
    rows = [("a", dt.date(2020, 1, 1 + i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "cell string, time date, v double")
    for kind in temporal.FILTERS:
        got = as_pandas(temporal.temporal_filter(df, ["v"], kind, 7, cell=["cell"]))
        assert list(got["v"]) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_every_nth_over_a_hot_series(station):
    got = as_pandas(every_nth(station, 30, cell=["cell"]))
    assert got.groupby("cell").size().to_dict() == {"hot": 30, "mid": 1, "one": 1}


def test_qq_line_and_points_use_every_row(spark):
    from statistics import NormalDist
    v = np.sort(np.concatenate([np.random.default_rng(8).normal(5, 2, 150), np.full(70, 4.5)]))
    n = len(v)
    top = 0.5 ** (1 / n)
    m = [1 - top, *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], top]
    z = np.array([NormalDist().inv_cdf(p) for p in m])
    slope, intercept = np.polyfit(z, v, 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = temporal.qq_points(df, "v", 12, chunk=16).toPandas().sort_values("i")
    assert len(got) == 12 and list(got["i"])[0] == 1 and list(got["i"])[-1] == n
    np.testing.assert_allclose(got["theoretical"], z[got["i"] - 1], rtol=1e-9)
    np.testing.assert_allclose(got["value"], v[got["i"] - 1])
    np.testing.assert_allclose([got["slope"][0], got["intercept"][0], got["r"][0]],
                               [slope, intercept, np.corrcoef(z, v)[0, 1]], rtol=1e-9)
