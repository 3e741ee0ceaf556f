"""Column layouts of the raw drops (CSV headers in this order)."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def _layout(**columns) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


# Column names and types of the raw files.
TRANSACTIONS = _layout(
    msno=StringType,
    payment_method_id=IntegerType,
    payment_plan_days=IntegerType,
    plan_list_price=IntegerType,
    actual_amount_paid=IntegerType,
    is_auto_renew=IntegerType,
    transaction_date=IntegerType,
    membership_expire_date=IntegerType,
    is_cancel=IntegerType,
)
USER_LOGS = _layout(
    msno=StringType,
    date=IntegerType,
    num_25=IntegerType,
    num_50=IntegerType,
    num_75=IntegerType,
    num_985=IntegerType,
    num_100=IntegerType,
    num_unq=IntegerType,
    total_secs=DoubleType,
)
LABELS = _layout(msno=StringType, is_churn=IntegerType)
MEMBERS = _layout(
    msno=StringType,
    city=IntegerType,
    bd=IntegerType,
    gender=StringType,
    registered_via=IntegerType,
    registration_init_time=IntegerType,
)
LAYOUTS = {"transactions": TRANSACTIONS, "user_logs": USER_LOGS, "train_labels": LABELS, "members": MEMBERS}
