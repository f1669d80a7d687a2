"""Keyed state over streams: any cut into micro-batches gives what the batch operator gives."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewright.operators import ai, drift
from clausewright.streaming import stateful


def files(spark, folder, rows, schema, cuts):
    """The rows as one file for each range between cuts, oldest first."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        name = f"{folder}/part{len(os.listdir(folder)) if os.path.isdir(folder) else 0}-{i}"
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(name)
        for f in os.listdir(name):
            os.utime(f"{name}/{f}", (1_700_000_000 + a, 1_700_000_000 + a))


def run(spark, folder, schema, make, out, each=1):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/*")
    with stateful.with_store(spark):
        q = make(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    assert q.awaitTermination(180) in (True, None)
    return sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{out}/rows").collect())))


def events(n=60):
    r = random.Random(3)
    return [(r.choice(["a", "b", None]), i, r.choice([None, *range(6)])) for i in range(n)]


EVENTS = "g string, at int, v int"


def wrong(spark):
    before = F.lag("v").over(Window.partitionBy("g").orderBy("at"))
    df = spark.createDataFrame(events(), EVENTS).withColumn("before", before).where("v <= before").select("g", "at", "v", "before")
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("cuts,each", [([], 1), ([1, 2, 31], 1), ([10, 20, 30, 40], 2)])
def test_sequences_in_any_cut(spark, tmp_path, cuts, each):
    files(spark, f"{tmp_path}/in", events(), EVENTS, cuts)
    assert run(spark, f"{tmp_path}/in", EVENTS, lambda s: stateful.sequences(s, "g", "v", "at"), tmp_path, each) == wrong(spark)


def test_sequences_go_on_from_the_checkpoint(spark, tmp_path):
    make = lambda s: stateful.sequences(s, "g", "v", "at")
    files(spark, f"{tmp_path}/in", events()[:25], EVENTS, [10])
    part = run(spark, f"{tmp_path}/in", EVENTS, make, tmp_path)
    files(spark, f"{tmp_path}/in", events()[25:], EVENTS, [20])
    whole = run(spark, f"{tmp_path}/in", EVENTS, make, tmp_path)
    assert set(part) < set(whole) and whole == wrong(spark)


def test_a_silent_group_is_forgotten(spark, tmp_path):
    import time

    rows = [("a", 1, 5), ("b", 1, 5), ("a", 2, 4), ("b", 2, 3)]
    files(spark, f"{tmp_path}/in", rows[:2], EVENTS, [])
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*")
    with stateful.with_store(spark):
        q = stateful.sequences(stream, "g", "v", "at", ttl_ms=1).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()

    def taken(n):
        end = time.time() + 60
        while sum(p.numInputRows for p in q.recentProgress) < n and time.time() < end:
            time.sleep(0.2)

    taken(2)
    files(spark, f"{tmp_path}/in", rows[2:], EVENTS, [])
    taken(4)
    q.stop()
    assert sum(p.numInputRows for p in q.recentProgress) == 4 and spark.table("silent").count() == 0


def test_trends_equal_the_batch_operator(spark, tmp_path):
    r = random.Random(5)
    runs = [(r.choice("xy"), f"2025-01-{i + 1:02d}", r.choice([None, 0.1, 0.2, 0.5])) for i in range(28)]
    schema = "contract_id string, run_date string, rate double"
    files(spark, f"{tmp_path}/in", runs, schema, [3, 4, 20])
    want = ai.trend(spark.createDataFrame(runs, schema), "run_date", "rate", ["contract_id"]).collect()
    assert run(spark, f"{tmp_path}/in", schema, lambda s: stateful.trends(s, "contract_id", "run_date", "rate"), tmp_path) == sorted(str(tuple(x)) for x in want)


def test_drifts_equal_the_batch_operator(spark, tmp_path):
    r = random.Random(7)
    runs = [("c", col, i, r.choice([1.0, 2.0, 9.0]) if col != "k" else 4.0 + i, r.choice([0.5, 1.0, 3.0]) if col != "k" or i < 6 else 0.0, r.choice([3, 9, 20])) for i in range(20) for col in "xk"]
    runs += [("d", "x", 0, None, None, 0), ("d", "x", 1, 1.0, None, 9), ("d", "x", 2, 99.0, 1.0, 9)]
    runs.sort(key=lambda x: x[2])
    schema = "contract_id string, column string, run int, mean double, stddev double, n bigint"
    files(spark, f"{tmp_path}/in", runs, schema, [5, 6, 30])
    want = drift.successive(spark.createDataFrame(runs, schema)).collect()
    assert len(want) > 3 and {x.column for x in want if x.contract_id == "d"} == set()
    assert run(spark, f"{tmp_path}/in", schema, stateful.drifts, tmp_path) == sorted(str(tuple(x)) for x in want)


def test_running_baselines_are_those_of_all_rows(spark, tmp_path):
    rows = [(float(i % 7), i, "t") for i in range(30)]
    schema, c = "x double, i int, s string", {"id": "c", "schema": {"x": {"type": "number"}, "i": {"type": "integer"}, "s": {"type": "string"}}}
    files(spark, f"{tmp_path}/in", rows, schema, [3, 17])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stateful.running_baselines(stream, c).writeStream.format("memory").queryName("baselines").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    want = {r.column: r for r in drift.moments(spark.createDataFrame(rows, schema), c).collect()}
    got = {r.column: r for r in spark.table("baselines").collect()}
    assert set(got) == {"x", "i"} and all(got[k].mean == pytest.approx(want[k].mean) and got[k].stddev == pytest.approx(want[k].stddev) and got[k].n == 30 for k in got)
