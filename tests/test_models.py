"""Forests, boosting, kernel machines and searches against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import boosting, forests, kernels, ml, search, trees

NAMES = list("abcde")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    n = 1500
    x = np.round(rng.normal(size=(n, 5)), 2)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    y = 2 * x[:, 0] + np.sin(x[:, 1]) + 0.1 * rng.normal(size=n)
    rows = [(i, *map(float, x[i]), int(label[i]), float(y[i])) for i in range(n)]
    path = str(tmp_path_factory.mktemp("models") / "rows")
    spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, label int, y double").write.parquet(path)
    return spark.read.parquet(path), x, label, y


def _walk(nodes, tree, row):
    at = nodes[tree, 0]
    while at["feature"] >= 0:
        at = nodes[tree, at["left"] if row[at["feature"]] <= at["cut"] else at["right"]]
    return np.array(at["value"])


@pytest.mark.parametrize("node_rows", [50_000, 250])
def test_forest_scores_and_left_out_votes_are_those_of_its_nodes(spark, data, node_rows):
    df, x, label, _ = data
    forest = forests.fit_forest(df, NAMES, "label", keys=["id"], trees=12, subset=2, node_rows=node_rows)
    assert bool(forest.tops) == (node_rows == 250)
    nodes = {(r["tree"], r["id"]): r for r in forest.nodes.collect()}
    cells = trees.binned(x.T, forest.edges)
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64(F.col("id").cast("string"))).collect()])
    bags = [trees.bag(keys, t, 42) for t in range(12)]
    got = {r["id"]: r for r in forests.predict(forest, df).collect()}
    out = {r["id"]: r for r in forests.predict(forest, df, left_out=True).collect()}
    right = total = 0
    for i in range(len(x)):
        each = [_walk(nodes, t, cells[i]) for t in range(12)]
        assert np.allclose(got[i]["probabilities"], np.mean(each, axis=0))
        free = [v for v, b in zip(each, bags) if not b[i]]
        if not free:
            assert out[i]["prediction"] is None
            continue
        assert np.allclose(out[i]["probabilities"], np.mean(free, axis=0))
        total += 1
        right += out[i]["prediction"] == label[i]
    oob = forests.out_of_bag(forest, df, "label").first()
    assert (oob["rows"], round(oob["accuracy"] * total)) == (total, right) and 0.8 < oob["accuracy"] < 1
    # a tree without a limit is pure on its own bag
    for t in range(3):
        assert all(_walk(nodes, t, cells[i])[label[i]] > 0.5 for i in np.flatnonzero(bags[t])[::9])


def test_numeric_forest_does_not_depend_on_where_it_is_grown(spark, data):
    df, x, _, y = data
    two = [forests.fit_forest(df, NAMES, "y", "number", keys=["id"], trees=5, node_rows=n) for n in (50_000, 200)]
    got = [{r["id"]: (r["prediction"], r["uncertainty"]) for r in forests.predict(f, df).collect()} for f in two]
    assert all(np.allclose(got[0][i], got[1][i], atol=1e-6) for i in range(len(y)))
    nodes = {(r["tree"], r["id"]): r for r in two[1].nodes.collect()}
    cells = trees.binned(x.T, two[1].edges)
    for i in range(0, len(y), 50):
        each = [_walk(nodes, t, cells[i])[0] for t in range(5)]
        assert np.allclose(got[1][i], (np.mean(each), np.std(each)), atol=1e-6)
    again = forests.fit_forest(df, NAMES, "y", "number", keys=["id"], trees=5)
    assert forests.out_of_bag(two[0], df, "y").first() == forests.out_of_bag(again, df, "y").first()
    ranked = [r["feature"] for r in forests.importance(two[0], 5).collect()]
    assert ranked[0] == "a" and set(ranked) == set(NAMES)


def test_a_split_is_the_best_of_all_cuts():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (60, 3)).astype(np.uint8)
    label = rng.integers(0, 3, 60)
    stats = np.eye(3)[label]
    growth = trees.Growth("class", bins=9, min_leaf=4)
    feature, cut, gain = (v[0] for v in trees.best_splits(trees.histograms(x, stats, np.zeros(60, dtype=int), 1, 9), growth, np.zeros(1, dtype=int)))
    gini = lambda s: (np.bincount(s, minlength=3) ** 2).sum() / len(s)
    every = {(f, c): gini(label[x[:, f] <= c]) + gini(label[x[:, f] > c]) - gini(label) for f in range(3) for c in range(8)
             if 4 <= (x[:, f] <= c).sum() <= 56}
    assert max(every, key=every.get) == (feature, cut) and abs(every[feature, cut] - gain) < 1e-9


def test_tried_features_give_the_splits_of_the_whole_histogram():
    rng = np.random.default_rng(5)
    x, slot = rng.integers(0, 16, (400, 6)).astype(np.uint8), rng.integers(0, 30, 400)
    stats, growth, names = np.eye(3)[rng.integers(0, 3, 400)], trees.Growth("class", bins=16, subset=2), np.arange(30) * 77
    whole = trees.best_splits(trees.histograms(x, stats, slot, 30, 16), growth, names)
    assert all(np.array_equal(a, b) for a, b in zip(whole, trees._split_rows(x, stats, slot, growth, names)))


def test_empty_and_odd_rows(spark):
    kind = "id long, a double, b double, label int"
    rows = [(i, None if i % 5 == 0 else float(i % 7), float("nan") if i % 6 == 0 else 1.0, None if i % 4 == 0 else i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, kind)
    forest = forests.fit_forest(df, ["a", "b"], "label", keys=["id"], trees=3, classes=2)
    assert forests.predict(forest, df).count() == 80
    assert forests.predict(forest, df.limit(0)).count() == 0


def test_boosting_is_that_of_one_machine_and_lowers_the_loss(spark, data):
    df, x, label, _ = data
    model = boosting.fit_boosted(df, NAMES, rounds=4, depth=3, rate=0.3, node_rows=300)   # some levels over all rows, the rest in tasks
    cells, m = trees.binned(x.T, model.edges), np.zeros((len(x), 3))
    growth, losses = trees.Growth("boost", depth=3, min_leaf=1), []
    for _ in range(4):
        p = boosting.softmax(m)
        losses.append(-np.log(p[np.arange(len(x)), label]).mean())
        for k in range(3):
            made, at = trees.grow(cells, boosting.gradients(p, label, k), growth)
            m[:, k] += 0.3 * made.value[at, 0]
    p = boosting.softmax(m)
    losses.append(-np.log(p[np.arange(len(x)), label]).mean())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    got = {r["id"]: r for r in model.transform(df).collect()}
    assert all(np.allclose(got[i]["probabilities"], p[i]) and abs(sum(got[i]["probabilities"]) - 1) < 1e-9 for i in range(len(x)))
    for rounds in (1, 4):
        seen = boosting.predict(model, df, rounds).agg(boosting.log_loss()).first()[0]
        assert abs(seen - losses[rounds]) < 1e-9


def test_gradients_are_derivatives_of_the_loss():
    rng = np.random.default_rng(1)
    m, y, e = rng.normal(size=(6, 3)), np.array([0, 1, 2, 0, 1, 2]), 1e-5
    loss = lambda v: -np.log(boosting.softmax(v)[np.arange(6), y])
    for k in range(3):
        step = np.zeros((6, 3))
        step[:, k] = e
        g = boosting.gradients(boosting.softmax(m), y, k)
        assert np.allclose(g[:, 1], (loss(m + step) - loss(m - step)) / (2 * e), atol=1e-7)
        assert np.allclose(g[:, 2], (loss(m + step) - 2 * loss(m) + loss(m - step)) / e**2, atol=1e-4)


def test_fourier_features_come_near_the_kernel(spark, data):
    df, x, _, _ = data
    mean, dev, gamma, count = x.mean(axis=0), x.std(axis=0), 0.2, 1024
    z = df.where("id < 60").orderBy("id").select(kernels.fourier_features(NAMES, mean, dev, gamma, count).alias("z")).collect()
    z, s = np.array([r["z"] for r in z]), ((x - mean) / dev)[:60]
    exact = np.exp(-gamma * ((s[:, None] - s[None]) ** 2).sum(axis=2))
    error = np.abs(z @ z.T - exact)
    bound = np.sqrt(8 * np.log(2 * 60 * 60 / 0.001) / count)    # all pairs at once, but for one case in a thousand
    assert error.max() < bound and error.mean() < 0.03
    few, many = kernels.fourier_weights(5, 4, gamma)[0], kernels.fourier_weights(5, 9, gamma)[0]
    assert np.array_equal(few, many[:4])


def test_kernel_machine_bends(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    rows = [(float(a), float(b), int(a * a + b * b > 1.2)) for a, b in x]    # no line separates a disc
    df = spark.createDataFrame(rows, "a double, b double, label int")
    scored = kernels.fit_kernel_svm(df, ["a", "b"], count=128, gamma=0.7).transform(df)
    got = ml.classification_metrics(scored).first()
    assert got["f1"] > 0.93 and {"probability", "prediction"} <= set(scored.columns) and not [c for c in scored.columns if c[0] == "_"]


def _plain_f1(actual, said):
    out = 0.0
    for c in set(actual):
        hit, support, mine = ((actual == c) & (said == c)).sum(), (actual == c).sum(), (said == c).sum()
        out += support * (2 * hit / (support + mine))
    return out / len(actual)


def test_first_trees_stand_for_smaller_forests(spark, data):
    df, *_ = data
    grid = {"trees": (3, 7), "max_depth": (2, 6), "min_split": (2, 20)}
    got = {(r["trees"], r["max_depth"], r["min_split"]): r for r in search.search_forest(df, NAMES, keys=["id"], grid=grid, k=2).collect()}
    assert len(got) == 8
    fold, key, x, y = search._sample(df, NAMES, "label", ["id"], 2, 50_000, 32, 42)
    for (count, depth, least), row in got.items():   # each cut model by itself
        scores = []
        for f in range(2):
            train, test, votes = np.flatnonzero(fold != f), np.flatnonzero(fold == f), 0
            for t in range(count):
                times = trees.bag(key[train], t, 42)
                rows = train[times > 0]
                made, _ = trees.grow(x[rows], np.eye(3)[y[rows]] * times[times > 0][:, None], trees.Growth("class", 32, depth, least, 1, 2), t << 32)
                votes = votes + made.value[made.leaves(x[test])]
            scores.append(_plain_f1(y[test], np.round(votes, 9).argmax(axis=1)))
        assert abs(row["f1"] - np.mean(scores)) < 1e-9 and abs(row["f1_std"] - np.std(scores)) < 1e-9


def test_first_rounds_stand_for_shorter_boosting(spark, data):
    df, *_ = data
    grid = {"rounds": (2, 5), "max_depth": (2,), "rate": (0.1, 0.5)}
    got = {(r["rounds"], r["rate"]): r["f1"] for r in search.search_boosted(df, NAMES, keys=["id"], grid=grid, k=2).collect()}
    fold, _, x, y = search._sample(df, NAMES, "label", ["id"], 2, 50_000, 32, 42)
    for (rounds, rate), f1 in got.items():
        scores = []
        for f in range(2):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m, left = np.zeros((len(train), 3)), np.zeros((len(test), 3))
            for _ in range(rounds):
                p = boosting.softmax(m)
                for k in range(3):
                    made, at = trees.grow(x[train], boosting.gradients(p, y[train], k), trees.Growth("boost", 32, 2))
                    m[:, k] += rate * made.value[at, 0]
                    left[:, k] += rate * made.value[made.leaves(x[test]), 0]
            scores.append(_plain_f1(y[test], left.argmax(axis=1)))
        assert abs(f1 - np.mean(scores)) < 1e-9
    best = search.search_boosted(df, NAMES, keys=["id"], grid=grid, k=2).first()
    assert best["f1"] == max(got.values())


def test_metric_intervals_by_their_definition(spark, data):
    import hashlib

    df, x, label, y = data
    few = df.where("id < 200").withColumn("prediction", F.when(F.col("id") % 9 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")).cast("double"))
    few = few.unionByName(few.limit(3).withColumn("id", F.col("id") + 1000).withColumn("prediction", F.lit(None).cast("double")))
    said = np.array([(label[i] + 1) % 3 if i % 9 == 0 else label[i] for i in range(200)])
    cuts, total, term = [], 0.0, 0.36787944117144233
    for i in range(12):
        total += term
        cuts.append(int(total * 2**32))
        term /= i + 1
    times = np.zeros((8, 200), dtype=int)
    for rep in range(8):
        for i in range(200):
            u = int(hashlib.md5(f"42|{i}|{rep // 4}".encode()).hexdigest()[8 * (rep % 4):8 * (rep % 4) + 8], 16)
            times[rep, i] = sum(u >= c for c in cuts)
    taken = [np.repeat(np.arange(200), w) for w in times]
    r2 = lambda r: 1 - ((y[r] - 2 * x[r, 0]) ** 2).sum() / ((y[r] - y[r].mean()) ** 2).sum()
    plain = {"f1": lambda r: _plain_f1(label[r], said[r]), "accuracy": lambda r: (label[r] == said[r]).mean(), "r2": r2}
    for metric, figure in plain.items():
        rows = few if metric != "r2" else few.withColumn("prediction", 2 * F.col("a")).where("id < 1000")
        got = ml.bootstrap_metric(rows, metric, ["id"], label="y" if metric == "r2" else "label", replicates=8).first()
        reps = [figure(r) for r in taken]
        want = (figure(np.arange(200)), 200, np.mean(reps), np.std(reps, ddof=1), *np.percentile(reps, [2.5, 97.5]))
        assert got["metric"] == metric and np.allclose([got[c] for c in ("point", "samples", "boot_mean", "std_error", "low", "high")], want)


def test_normal_quantile_in_columns(spark):
    from statistics import NormalDist

    from gridspark.operators.temporal import normal_quantile

    p = [1e-300, 1e-20, 1e-12, 1e-5, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9249, 0.9251, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, -1.0, None]], "p double").withColumn("z", normal_quantile(F.col("p")))
    got = {r["p"]: r["z"] for r in df.collect()}
    assert all(abs(got[x] - NormalDist().inv_cdf(x)) < 1e-12 * max(1, abs(got[x])) for x in p)
    assert got[0.0] is got[1.0] is got[-1.0] is got[None] is None
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
