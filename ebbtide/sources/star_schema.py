"""The raw drops laid over the generated star-schema tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.dates import as_yyyymmdd

# first day of the second drop
DROP_BOUNDARY_TRANSACTIONS = "2000-01-01"
DROP_BOUNDARY_LOGS = "2024-01-22"
LABEL_START = "2000-01-01"
EARLIER_LABEL_START = "1999-01-01"


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _drops(moment: str, boundary: str) -> dict[str, Column]:
    """Conditions on a raw time column, so that each drop's scan reads its own part; a missing time is in none."""
    first = F.lit(boundary).cast("timestamp_ntz")
    return {"v1": F.col(moment) < first, "v2": F.col(moment) >= first}


def transactions(spark: SparkSession, sf_dir: str, part: Column | None = None) -> DataFrame:
    """All rows, or those of lineitem that meet ``part``."""
    lines = _read(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    if part is not None:
        lines = lines.filter(part)
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    price = F.col("l_extendedprice")
    paid = price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    shipped = F.to_date("l_shipdate")
    plan_days = F.col("l_quantity").cast("int")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("msno"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"),
        plan_days.alias("payment_plan_days"),
        F.round(price).cast("bigint").alias("plan_list_price"),
        F.round(paid).cast("bigint").alias("actual_amount_paid"),
        (F.col("l_returnflag") == "N").cast("int").alias("is_auto_renew"),
        as_yyyymmdd(shipped).alias("transaction_date"),
        as_yyyymmdd(F.date_add(shipped, plan_days)).alias("membership_expire_date"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_cancel"),
    )


def transaction_drops(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {tag: transactions(spark, sf_dir, part) for tag, part in _drops("l_shipdate", DROP_BOUNDARY_TRANSACTIONS).items()}


def user_logs(spark: SparkSession, sf_dir: str, part: Column | None = None) -> DataFrame:
    """One row a user and day, of all events or of those that meet ``part``, a condition on whole days."""
    events = _read(spark, sf_dir, "events", "user_id", "ts", "event_type", "value", "props")
    if part is not None:
        events = events.filter(part)
    kind = F.col("event_type")
    daily = events.groupBy(F.col("user_id").alias("msno"), as_yyyymmdd(F.col("ts")).alias("date")).agg(
        F.count_if(kind == "error").alias("num_25"),
        F.count_if(kind == "click").alias("num_50"),
        F.count_if(kind == "view").alias("num_75"),
        F.count_if((kind == "signup") & (F.col("value") >= 50)).alias("num_985"),
        F.count_if(kind == "purchase").alias("num_100"),
        F.countDistinct("props").alias("num_unq"),
        F.round(F.sum("value") * 200 - 2000).alias("total_secs"),
    )
    return daily


def log_drops(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {tag: user_logs(spark, sf_dir, part) for tag, part in _drops("ts", DROP_BOUNDARY_LOGS).items()}


def _labels_from(spark: SparkSession, sf_dir: str, start: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer", "c_custkey")
    orders = _read(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    renewed = orders.filter(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")).select("o_custkey").distinct()
    return customers.join(renewed, customers.c_custkey == renewed.o_custkey, "left").select(
        F.col("c_custkey").alias("msno"), F.col("o_custkey").isNull().cast("int").alias("is_churn")
    )


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_from(spark, sf_dir, LABEL_START)


def earlier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_from(spark, sf_dir, EARLIER_LABEL_START)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit; those in debt stand for labelled ids with no member record."""
    customers = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    segment = F.col("c_mktsegment")
    registered = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 37 % 1800).cast("int"))
    return customers.filter(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("msno"),
        F.col("c_nationkey").alias("city"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"),
        F.when(segment.isin("HOUSEHOLD", "FURNITURE"), "male")
        .when(segment.isin("MACHINERY", "BUILDING"), "female")
        .alias("gender"),
        (F.col("c_nationkey") % 7 + 3).alias("registered_via"),
        as_yyyymmdd(registered).alias("registration_init_time"),
    )
