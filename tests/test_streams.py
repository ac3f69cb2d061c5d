"""Streams give the batch results, over several files and restarts."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.functions.frames import shared_folder
from gridspark.operators.filters import recent, split_valid
from gridspark.operators.labels import score_rules
from gridspark.operators.scoring import score_or_rules
from gridspark.streaming import keyed, models
from gridspark.streaming import scoring as streams

SCHEMA = "id long, chl double, pp double, ts timestamp"


def samples(spark, start, n):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, float(i * 7 % 60), -1.0 if i % 13 == 0 else None, t0 + dt.timedelta(hours=i * 11 % 2000))
            for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


def drain(spark, source, out):
    stream = streams.sample_stream(spark, source, SCHEMA, files_per_batch=1)
    streams.write_scores(streams.score_stream(stream), f"{out}/scores").awaitTermination()
    streams.write_counters(streams.history_counters(stream, window="10 days"), f"{out}/counters").awaitTermination()
    q = streams.keep_recent(score_rules(stream), f"{out}/recent", 20)
    q.awaitTermination()
    return int(q.lastProgress["batchId"])


def test_streams_equal_batch_after_a_restart(spark):
    source, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    samples(spark, 0, 150).coalesce(1).write.parquet(f"{source}")
    samples(spark, 150, 90).coalesce(1).write.mode("append").parquet(f"{source}")
    drain(spark, source, out)
    samples(spark, 240, 60).coalesce(1).write.mode("append").parquet(f"{source}")
    drain(spark, source, out)

    every = spark.read.schema(SCHEMA).parquet(source)
    batch = score_or_rules(split_valid(every)[0]).select("id", "level", "confidence")
    got = spark.read.parquet(f"{out}/scores/data").select("id", "level", "confidence")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0

    want = score_rules(every).groupBy(F.window("ts", "10 days").start.alias("window_start")).agg(
        F.count("*").alias("total"), F.count("level").alias("successful"),
        F.count_if(F.col("level") == "HIGH").alias("high_risk"))
    assert len(spark.read.parquet(f"{out}/counters/state").select("turn").distinct().collect()) == 2
    counters = streams.read_counters(spark, f"{out}/counters")
    assert counters.count() == want.count() and counters.exceptAll(want).count() == 0

    newest = streams.read_recent(spark, f"{out}/recent").select("id")
    assert newest.exceptAll(recent(every, 20).select("id")).count() == 0 and newest.count() == 20


def keyed_stream(spark, source):
    rows = streams.sample_stream(spark, source, SCHEMA, files_per_batch=1)
    return rows.withColumn("site", F.when(F.col("id") % 3 != 0, F.col("id") % 4))  # a third of the rows has no site


def test_newest_per_key_outlives_a_restart(spark):
    source, state = shared_folder(spark, "in"), shared_folder(spark, "state")
    samples(spark, 0, 150).coalesce(1).write.parquet(source)
    late = samples(spark, 150, 90).withColumn("ts", F.when(F.col("id") % 10 != 0, F.col("ts")))
    late.coalesce(1).write.mode("append").parquet(source)
    keyed.keep_newest(keyed_stream(spark, source), state, ["site"], 7, parts=3).awaitTermination()
    samples(spark, 240, 60).coalesce(1).write.mode("append").parquet(source)
    keyed.keep_newest(keyed_stream(spark, source), state, ["site"], 7, parts=3).awaitTermination()

    every = spark.read.schema(SCHEMA).parquet(source).withColumn("site", F.when(F.col("id") % 3 != 0, F.col("id") % 4))
    order = Window.partitionBy("site").orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("id"))
    want = every.withColumn("at", F.row_number().over(order)).where("at <= 7").drop("at")
    got = keyed.read_newest(spark, state, ["site"], 7)
    assert got.count() == want.count() == 35 and got.exceptAll(want.select(got.columns)).count() == 0


def test_timers_clear_keys_that_went_quiet(spark):
    source, state = shared_folder(spark, "in"), shared_folder(spark, "state")
    t0 = dt.datetime(2024, 1, 1)
    for part, (site, day) in enumerate([(1, 0), (2, 1), (2, 40), (2, 41)]):
        rows = [(part * 10 + i, float(site), 1.0, t0 + dt.timedelta(days=day, hours=i)) for i in range(5)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.sample_stream(spark, source, SCHEMA)
        keyed.keep_newest(stream, state, ["chl"], 7, keep=dt.timedelta(days=10), lateness="1 day", parts=1).awaitTermination()
    got = keyed.read_newest(spark, state, ["chl"], 7)
    assert [r[0] for r in got.select("chl").distinct().collect()] == [2.0]
    assert sorted(r[0] for r in got.select("id").collect()) == [23, 24, 30, 31, 32, 33, 34]


def test_a_published_model_counts_from_the_next_batch(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    def fitted(low):
        rows = [(float(i), float(low if i < 30 else 2 - low)) for i in range(60)] + [(1.0, 1.0)]
        stages = [VectorAssembler(inputCols=["chl"], outputCol="features"), DecisionTreeClassifier(labelCol="label", maxDepth=3)]
        return Pipeline(stages=stages).fit(spark.createDataFrame(rows, "chl double, label double"))

    source, at, out = (shared_folder(spark, n) for n in ("in", "models", "out"))
    for number, low in enumerate([None, 0, 2]):
        if low is not None:
            assert models.publish_model(spark, fitted(low), at, ["chl"], {"chl": 1.0}) == number
        samples(spark, number * 50, 50).coalesce(1).write.mode("append").parquet(source)
        models.write_current_scores(streams.sample_stream(spark, source, SCHEMA), at, out).awaitTermination()
    got = models.read_scores(spark, out)
    assert got.count() == split_valid(spark.read.schema(SCHEMA).parquet(source))[0].count()
    by = {(r["v"], r["far"]): (set(r["levels"]), set(r["sources"])) for r in got.groupBy(
        F.col("model_version").alias("v"), (F.col("chl") >= 30).alias("far")).agg(
        F.collect_set("level").alias("levels"), F.collect_set("source").alias("sources")).collect()}
    assert by[(None, True)] == ({"HIGH"}, {"rules"})
    assert by[(1, False)] == ({"LOW"}, {"model"}) and by[(1, True)] == ({"HIGH"}, {"model"})
    assert by[(2, False)] == ({"HIGH"}, {"model"}) and by[(2, True)] == ({"LOW"}, {"model"})
