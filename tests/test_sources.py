"""Readers, writers, artefacts and streaming ingestion."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators.logs import log_features_twopass
from ebbtide.session import stage, staging_dir
from ebbtide.sources import files
from ebbtide.sources.layouts import LAYOUTS
from ebbtide.streaming.log_state import compact_log_state, ingest_log_drops, log_features_from_state, read_log_state


def test_csv_drop_has_its_declared_layout(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text("msno,city,bd,gender,registered_via,registration_init_time\na,1,20,male,3,20160101\nb,2,,,4,20160102\n")
    df = files.read_drop(spark, "members", str(path))
    assert df.schema == LAYOUTS["members"]
    assert [(r["msno"], r["bd"], r["gender"]) for r in df.collect()] == [("a", 20, "male"), ("b", None, None)]
    assert files.read_drop(spark, "members", str(path), columns=["msno"]).columns == ["msno"]


def test_union_keeps_all_rows_and_tags(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    got = sorted((r["x"], r["source"]) for r in files.union_drops({"v1": a, "v2": b}).collect())
    assert got == [(1, "v1"), (1, "v1"), (2, "v2")]


def test_table_sink_prunes_splits_and_refuses_its_own_input(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.createDataFrame([(1, "train"), (2, "val")], "x int, split string")
    files.write_table(df, path, ["split"])
    back = files.read_table(spark, path)
    only = back.filter("split = 'val'")
    assert [r["x"] for r in only.collect()] == [2]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError):
        files.write_table(back.withColumn("y", F.lit(1)), path)


def test_report_sink_and_idempotent_merge(spark, tmp_path):
    first = spark.createDataFrame([("lr", 0.9), ("rf", 0.95)], "model string, auc double")
    more = spark.createDataFrame([("rf", 0.97), ("gbt", 0.98)], "model string, auc double")
    merged = files.merge_report(first, more, "model")
    again = files.merge_report(merged, more, "model")
    want = {"lr": 0.9, "rf": 0.97, "gbt": 0.98}
    assert {r["model"]: r["auc"] for r in merged.collect()} == want == {r["model"]: r["auc"] for r in again.collect()}
    assert again.count() == 3
    path = str(tmp_path / "report")
    files.write_report(again.orderBy("model"), path)
    assert spark.read.csv(path, header=True).count() == 3


def test_key_value_round_trip(spark, tmp_path):
    row = spark.createDataFrame([(10.1182871, 883630)], "ratio double, n long")
    pairs = files.as_key_values(row, {"ratio": "%.6f", "n": "%d"})
    files.write_key_values(pairs, str(tmp_path / "kv"))
    got = {r["key"]: r["value"] for r in files.read_key_values(spark, str(tmp_path / "kv")).collect()}
    assert got == {"ratio": "10.118287", "n": "883630"}


def test_stage_reads_back_the_same_table_from_the_named_folder(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    staged = stage(df, "t")
    assert staged.exceptAll(df).count() == 0 and staged.count() == 10
    assert all(staging_dir(spark).split(":", 1)[-1] in f for f in staged.inputFiles())


LOGS = [
    ("a", 20170101, 1, 0, 0, 0, 3, 2, 100.0),
    ("a", 20170301, 0, 0, 0, 0, 2, 1, 10.0),
    ("b", 20170105, 1, 1, 1, 1, 1, 5, 90000.0),
    ("b", 20170106, 1, 1, 1, 1, 1, 5, 95000.0),
    ("c", 20170302, 2, 0, 0, 0, 2, 4, 20.0),
]


def test_streaming_ingestion_equals_batch(spark, tmp_path):
    layout = LAYOUTS["user_logs"]
    landing, state, checkpoint = (str(tmp_path / n) for n in ("landing", "state", "checkpoint"))
    first, second = spark.createDataFrame(LOGS[:3], layout), spark.createDataFrame(LOGS[3:], layout)
    labels = spark.createDataFrame([("a", 0), ("b", 0)], "msno string, is_churn int")
    first.write.csv(landing, header=True, mode="append")
    assert ingest_log_drops(spark, landing, state, checkpoint, files_per_batch=1).awaitTermination(120)
    second.write.csv(landing, header=True, mode="append")
    assert ingest_log_drops(spark, landing, state, checkpoint).awaitTermination(120)
    # nothing new: the state does not change
    assert ingest_log_drops(spark, landing, state, checkpoint).awaitTermination(120)
    got = log_features_from_state(spark, state, labels, "2017-03-31")
    want = log_features_twopass([first, second], labels, "2017-03-31")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2
    compact_log_state(spark, state, str(tmp_path / "compacted"))
    small = read_log_state(spark, str(tmp_path / "compacted"))
    assert small.exceptAll(read_log_state(spark, state)).count() == 0 and small.count() == 3
