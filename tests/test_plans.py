"""What the physical plans must look like at any size."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ebbtide.operators import logs, master, members, ordering, transactions
from ebbtide.session import stage
from ebbtide.sources import star_schema

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


def exchanges(df) -> list[str]:
    """Operator right below each shuffle."""
    lines = plan(df).splitlines()
    return [re.sub(r"^[\s:+\-]*(\*\(\d+\) )?", "", lines[i + 1]) for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "tx": stage(star_schema.transactions(spark, SMALL), "tx"),
        "logs": stage(star_schema.user_logs(spark, SMALL), "logs"),
        "labels": stage(star_schema.train_labels(spark, SMALL), "labels"),
    }


@pytest.fixture()
def nothing_fits(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_raw_rows_are_combined_before_any_shuffle(tables, nothing_fits):
    df = transactions.transaction_features(tables["tx"], tables["labels"])
    below = exchanges(df)
    # two for the distinct count, one for the label ids
    assert len(below) == 3
    assert sum(b.startswith("HashAggregate") for b in below) == 2
    two_pass = logs.log_features_twopass([tables["logs"], tables["logs"].filter("date > 0")], tables["labels"], "2024-01-31")
    below = exchanges(two_pass)
    # merging the partials needs no shuffle of its own
    assert len(below) == 3 and sum(b.startswith("HashAggregate") for b in below) == 2


def test_few_labels_filter_the_scan(tables):
    text = plan(transactions.transaction_features(tables["tx"], tables["labels"]))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(logs.log_partial(tables["logs"]).select("msno", "max_secs"))
    assert "GreaterThan(total_secs,0.0)" in text and "LessThanOrEqual(total_secs,90000.0)" in text
    assert re.search(r"ReadSchema: struct<msno:bigint,total_secs:double>", text)
    text = plan(transactions.transaction_features(tables["tx"], tables["labels"], cutoff=20000101))
    assert "LessThan(transaction_date,20000101)" in text


def test_master_joins_reuse_the_partitioning_of_the_features(spark, tables, nothing_fits):
    tx = transactions.transaction_features(tables["tx"], tables["labels"])
    lg = logs.log_features_twopass([tables["logs"]], tables["labels"], "2024-01-31")
    mem = stage(members.member_features(star_schema.members(spark, SMALL), "2001-08-01"), "members")
    df = master.master_features(tables["labels"], tx, lg, mem)
    # features: 2 + 1, label ids (a second use may be a reused exchange), labels, members
    assert len(exchanges(df)) <= 7


def test_ranges_split_one_hot_group(spark):
    df = spark.range(2000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    out = ordering.running_totals(df, "v", ["n"], ["g"], rows_per_range=100)
    assert "hashpartitioning(g" in plan(out) and "_range" in plan(out)
    spread = out.filter("cum_n = v + 1 and all_n = 2000")
    assert spread.count() == 2000


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_only_a_session_in_one_process_may_use_a_temporary_folder():
    from ebbtide.session import in_one_process

    assert all(in_one_process(m) for m in ("local", "local[8]", "local[*]", "local[4,2]"))
    assert not any(in_one_process(m) for m in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://https://host", "localhost"))
