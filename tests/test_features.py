"""Feature operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from ebbtide.config import StudyConfig
from ebbtide.operators import logs, master, members, quality, transactions
from ebbtide.plans.study import Study
from ebbtide.sources.files import union_drops

TX = (
    "msno string, payment_method_id int, payment_plan_days int, plan_list_price int, actual_amount_paid int, "
    "is_auto_renew int, transaction_date int, membership_expire_date int, is_cancel int"
)
LOG = (
    "msno string, date int, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int, num_unq int, total_secs double"
)
LABEL = "msno string, is_churn int"


def rows(df, key="msno"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(
        [
            ("a", 1, 30, 100, 80, 1, 20170101, 20170131, 0),
            ("a", 2, 30, 100, 150, 0, 20170301, 20170331, 1),
            ("a", 2, 60, 0, 10, 1, 20170201, 20170401, 0),
            ("b", 3, 7, 0, 0, 0, 20170115, 20170122, 0),
            ("z", 9, 7, 50, 50, 0, 20170115, 20170122, 0),
        ],
        TX,
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], LABEL)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_transaction_features_on_both_join_routes(spark, tx, labels, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = rows(transactions.transaction_features(tx, labels))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["total_paid"], a["max_payment"], a["n_transactions"], a["n_payment_methods"]) == (240, 150, 3, 2)
    # overpaid counts as no discount, list price 0 does not count
    assert a["discount_rate"] == pytest.approx((0.2 + 0.0) / 2)
    assert a["avg_plan_days"] == pytest.approx(40)
    assert a["auto_renew_rate"] == pytest.approx(2 / 3)
    assert (a["first_transaction"], a["last_transaction"], a["last_expire_date"]) == (20170101, 20170301, 20170401)
    assert a["days_as_member"] == 59
    assert b["discount_rate"] is None and b["days_as_member"] == 0


def test_cutoff_drops_later_rows(tx, labels):
    got = rows(transactions.transaction_features(tx, labels, cutoff=20170201))
    assert got["a"]["n_transactions"] == 1 and got["a"]["total_paid"] == 80


def test_repeated_labels_do_not_multiply_rows(spark, tx, labels):
    once, twice = (rows(transactions.transaction_features(tx, x)) for x in (labels, labels.unionByName(labels)))
    assert once == twice


@pytest.fixture(scope="module")
def log_drops(spark):
    v1 = spark.createDataFrame(
        [
            ("a", 20170101, 1, 0, 0, 0, 3, 2, 100.0),
            ("a", 20170102, 0, 0, 0, 0, 0, 0, 50.0),
            ("a", 20170103, 5, 0, 0, 0, 5, 5, 90001.0),
            ("b", 20170105, 1, 1, 1, 1, 1, 5, 90000.0),
            ("d", 20170105, 1, 1, 1, 1, 1, 5, -3.0),
        ],
        LOG,
    )
    v2 = spark.createDataFrame(
        [("a", 20170301, 0, 0, 0, 0, 2, 1, 10.0), ("c", 20170302, 2, 0, 0, 0, 2, 4, 20.0), ("d", 20170302, 2, 0, 0, 0, 2, 4, 0.0)],
        LOG,
    )
    return {"v1": v1, "v2": v2}


def test_two_pass_log_features(spark, log_drops):
    labels = spark.createDataFrame([(m, 0) for m in "abcd"], LABEL)
    got = rows(logs.log_features_twopass(log_drops.values(), labels, "2017-03-31"))
    # d has no row within (0, 90000]
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a["total_secs"], a["max_daily_secs"], a["active_days"]) == (160.0, 100.0, 3)
    assert a["completion_rate"] == pytest.approx(5 / 6) and a["skip_rate"] == pytest.approx(1 / 6)
    # the day without songs has no ratio
    assert a["unique_songs_ratio"] == pytest.approx((2 / 4 + 1 / 2) / 2)
    assert (a["first_log_date"], a["last_log_date"], a["days_since_last_log"]) == (20170101, 20170301, 30)
    assert got["b"]["last_log_date"] == 20170105 and got["c"]["first_log_date"] == 20170302


def test_merging_partials_equals_one_pass(spark, log_drops):
    split = logs.merge_log_partials([logs.log_partial(d) for d in log_drops.values()])
    whole = logs.log_partial(union_drops(log_drops).drop("source"))
    assert rows(split) == {k: {c: v[c] for c in split.columns} for k, v in rows(whole).items()}


def test_single_pass_keeps_corrupt_rows_and_counts_dates(spark, log_drops):
    labels = spark.createDataFrame([("a", 0)], LABEL)
    doubled = log_drops["v1"].unionByName(log_drops["v1"].filter("date = 20170101"))
    a = rows(logs.log_features_single(doubled, labels))["a"]
    assert a["active_days"] == 3 and a["max_daily_secs"] == 90001.0
    only_silent = log_drops["v1"].filter("date = 20170102")
    silent = rows(logs.log_features_single(only_silent, labels))["a"]
    assert silent["completion_rate"] is None and silent["unique_songs_ratio"] is None


MEMBER = "msno string, city int, bd int, gender string, registered_via int, registration_init_time int"


@pytest.fixture(scope="module")
def member_rows(spark):
    return spark.createDataFrame(
        [
            ("a", 1, 4, "male", 3, 20160101),
            ("b", 1, 5, "female", 3, 20151231),
            ("c", 2, 100, None, 4, 20160630),
            ("d", 2, 101, "male", 5, 20160701),
            ("e", 3, 30, "male", 6, 20170401),
            ("f", 3, 40, "male", 7, 123),
            ("g", 3, 50, "male", 8, 20150101),
            ("h", None, 50, "male", None, 20150101),
        ],
        MEMBER,
    )


def test_member_features(member_rows):
    got = rows(members.member_features(member_rows, "2017-03-31"))
    assert [got[m]["age"] for m in "abcde"] == [None, 5, 100, None, 30]
    assert [got[m]["city_freq_rank"] for m in "aceh"] == [2, 3, 1, None]
    # future and unreadable dates have no tenure
    assert got["e"]["membership_tenure"] is None and got["f"]["membership_tenure"] is None
    assert got["b"]["membership_tenure"] == 456
    assert (got["c"]["gender_male"], got["c"]["gender_female"], got["c"]["gender_unknown"]) == (0, 0, 1)
    # top five: 3, then 4..7 by value; 8 and missing are other
    assert got["a"]["reg_via_3"] == 1 and got["g"]["reg_via_other"] == 1 and got["h"]["reg_via_other"] == 1
    assert got["f"]["reg_via_7"] == 1 and got["f"]["reg_via_other"] == 0


def test_fit_on_changes_only_the_fitted_ranks(member_rows):
    got = rows(members.member_features(member_rows, "2017-03-31", fit_on=F.col("registration_init_time") < 20160101))
    # earlier members: city 1 (b), city 3 (f, g) and one without a city
    assert got["e"]["city_freq_rank"] == 1 and got["a"]["city_freq_rank"] == 2 and got["c"]["city_freq_rank"] is None


def test_study_has_no_nulls_and_keeps_every_label(spark, tx, log_drops, member_rows):
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("nobody", 1)], LABEL)
    study = Study({"v1": tx}, log_drops, labels, member_rows, StudyConfig())
    raw, full = study.master_raw(), study.master()
    assert full.count() == 4
    left = full.select([F.count_if(F.isnull(c)).alias(c) for c in full.columns]).first().asDict()
    never_paid = {c for c, n in left.items() if n}
    # only subscribers without any transaction keep gaps, and only in payment columns
    assert never_paid <= set(master.TRANSACTION_FEATURES) | {"first_transaction", "last_transaction", "last_expire_date"}
    got = rows(full)
    assert got["nobody"]["days_since_last_log"] == 820 and got["nobody"]["active_days"] == 0
    assert (got["nobody"]["gender_unknown"], got["nobody"]["city_freq_rank"], got["nobody"]["split"]) == (1, 1, "train")
    # median over joined rows: b is 5, c is 100
    assert got["a"]["age"] == pytest.approx(52.5)
    assert (got["a"]["split"], got["b"]["split"], got["c"]["split"]) == ("val", "train", "val")
    flags = master.missing_feature_flags(raw).first()
    assert flags["n_without_transactions"] == 2 and flags["n_without_member"] == 1


def test_quality_checks(spark, tx, log_drops, member_rows, labels):
    assert quality.overpaid(tx).first()["n_overpaid"] == 1
    assert quality.invalid_ages(member_rows.withColumn("bd", F.col("bd") - 4)).first()["n_invalid"] == 1
    zero = quality.zero_seconds(log_drops["v2"]).first()
    assert (zero["n_rows"], zero["n_zero"]) == (3, 1) and zero["pct"] == pytest.approx(100 / 3)
    overlap = quality.key_overlap(labels.unionByName(labels), member_rows).first()
    assert overlap.asDict() == {"n_left": 3, "n_right": 8, "n_both": 3, "n_only_left": 0, "n_only_right": 5}


def test_null_counts_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y")], "a double, b string")
    got = rows(master.null_counts(df), "column_name")
    assert (got["a"]["nulls"], got["b"]["nulls"]) == (2, 1)
    assert master.nan_to_null(df).filter("a is null").count() == 2
