"""The registered queries as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from ebbtide.config import STAR_SCHEMA as C
from ebbtide.operators.audit import AUDITED, SEGMENTS
from ebbtide.operators.master import LOG_FEATURES, MEMBER_FEATURES, TRANSACTION_FEATURES
from ebbtide.operators.segments import CLUSTER_FEATURES
from ebbtide.plans import rules
from ebbtide.plans.catalog import DIGITS, NEWTON_FEATURES, NEWTON_STEPS

_YMD = "CAST(strftime({0}, '%Y%m%d') AS INTEGER)"
_DAY = "CAST(strptime(CAST({0} AS VARCHAR), '%Y%m%d') AS DATE)"
_SONGS = "(num_25 + num_50 + num_75 + num_985 + num_100)"
_VIA = [f"reg_via_top{i}" for i in range(1, 6)] + ["reg_via_other"]


def ymd(x: str) -> str:
    return _YMD.format(x)


def day(x: str) -> str:
    return _DAY.format(x)


def prob(coefficients: dict) -> str:
    z = str(coefficients["intercept"])
    for name, weight in coefficients.items():
        if name != "intercept":
            z += f" + {name} * CAST({weight} AS DOUBLE)"
    return f"round(1.0 / (1.0 + exp(-(CAST({z.split(' + ')[0]} AS DOUBLE){z[len(z.split(' + ')[0]):]}))), 6)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS.get(name, 6)}) AS {name}"


def binned(value: str, edges, labels) -> str:
    whens = " ".join(f"WHEN {value} <= {hi} THEN '{label.replace(chr(39), chr(39) * 2)}'" for hi, label in zip(edges[1:], labels))
    return f"CASE WHEN {value} <= {edges[0]} THEN NULL {whens} END"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for d in CTES[name][0]:
                visit(d)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


cte("transactions", [], f"""
SELECT o_custkey AS msno,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_method_id,
       CAST(l_quantity AS INTEGER) AS payment_plan_days,
       CAST(round(l_extendedprice) AS BIGINT) AS plan_list_price,
       CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS BIGINT) AS actual_amount_paid,
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS is_auto_renew,
       {ymd('l_shipdate')} AS transaction_date,
       {ymd('CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER)')} AS membership_expire_date,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_cancel
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("transactions_src", ["transactions"], """
SELECT *, CASE WHEN transaction_date < 20000101 THEN 'v1' ELSE 'v2' END AS source FROM transactions""")
cte("user_logs", [], f"""
SELECT user_id AS msno, {ymd('ts')} AS date,
       count(*) FILTER (event_type = 'error') AS num_25,
       count(*) FILTER (event_type = 'click') AS num_50,
       count(*) FILTER (event_type = 'view') AS num_75,
       count(*) FILTER (event_type = 'signup' AND value >= 50) AS num_985,
       count(*) FILTER (event_type = 'purchase') AS num_100,
       count(DISTINCT props) AS num_unq,
       round(sum(value) * 200 - 2000) AS total_secs
FROM events GROUP BY 1, 2""")
cte("user_logs_src", ["user_logs"], """
SELECT *, CASE WHEN date < 20240122 THEN 'v1' ELSE 'v2' END AS source FROM user_logs""")
for _name, _start in (("labels_v2", "2000-01-01"), ("labels_v1", "1999-01-01")):
    cte(_name, [], f"""
SELECT c_custkey AS msno,
       CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '{_start}')
            THEN 0 ELSE 1 END AS is_churn
FROM customer""")
cte("members", [], f"""
SELECT c_custkey AS msno, c_nationkey AS city, CAST(floor(c_acctbal / 100) AS INTEGER) AS bd,
       CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'male'
            WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'female' END AS gender,
       c_nationkey % 7 + 3 AS registered_via,
       {ymd("DATE '1995-01-01' + CAST(c_custkey * 37 % 1800 AS INTEGER)")} AS registration_init_time
FROM customer WHERE c_acctbal >= 0""")


def _tx(extra: str = "") -> str:
    return f"""
SELECT msno, CAST(sum(actual_amount_paid) AS BIGINT) AS total_paid, avg(actual_amount_paid) AS avg_payment,
       max(actual_amount_paid) AS max_payment,
       avg(CASE WHEN plan_list_price > 0
                THEN greatest({div('plan_list_price - actual_amount_paid', 'plan_list_price')}, 0) END) AS discount_rate,
       count(*) AS n_transactions, avg(payment_plan_days) AS avg_plan_days,
       avg(CAST(is_auto_renew AS DOUBLE)) AS auto_renew_rate, avg(CAST(is_cancel AS DOUBLE)) AS cancel_rate,
       min(transaction_date) AS first_transaction, max(transaction_date) AS last_transaction,
       max(membership_expire_date) AS last_expire_date, count(DISTINCT payment_method_id) AS n_payment_methods,
       CAST(datediff('day', {day('min(transaction_date)')}, {day('max(transaction_date)')}) AS BIGINT) AS days_as_member
FROM transactions JOIN labels_v2 USING (msno) {extra} GROUP BY msno"""


cte("tx", ["transactions", "labels_v2"], _tx())
cte("tx_cut", ["transactions", "labels_v2"], _tx(f"WHERE transaction_date < {C.label_cutoff}"))
cte("logs_single", ["user_logs", "labels_v2"], f"""
SELECT msno, sum(total_secs) AS total_secs, avg(total_secs) AS avg_daily_secs, max(total_secs) AS max_daily_secs,
       CAST(sum({_SONGS}) AS BIGINT) AS total_songs_played,
       {div('sum(num_100)', f'sum({_SONGS})')} AS completion_rate,
       {div('sum(num_25)', f'sum({_SONGS})')} AS skip_rate,
       avg({div('num_unq', _SONGS)}) AS unique_songs_ratio,
       count(DISTINCT date) AS active_days, max(date) AS last_log_date, min(date) AS first_log_date
FROM user_logs JOIN labels_v2 USING (msno) GROUP BY msno""")
cte("partial", ["user_logs_src"], f"""
SELECT msno, source, sum(total_secs) AS sum_secs, count(*) AS n_rows, max(total_secs) AS max_secs,
       sum(CAST({_SONGS} AS DOUBLE)) AS total_songs, sum(CAST(num_100 AS DOUBLE)) AS sum_num100,
       sum(CAST(num_25 AS DOUBLE)) AS sum_num25, sum({div('num_unq', _SONGS)}) AS sum_unq_ratio,
       count(CASE WHEN {_SONGS} > 0 THEN 1 END) AS n_unq_ratio_rows,
       max(date) AS last_log_date, min(date) AS first_log_date
FROM user_logs_src WHERE total_secs > {C.secs_above} AND total_secs <= {C.secs_up_to} GROUP BY msno, source""")


def _both(column: str) -> str:
    return f"(coalesce(a.{column}, 0) + coalesce(b.{column}, 0))"


# the two-pass features by the other route: full outer join of the two drops, zeros filled in
cte("logs", ["partial", "labels_v2"], f"""
SELECT msno, {_both('sum_secs')} AS total_secs,
       {div(_both('sum_secs'), _both('n_rows'))} AS avg_daily_secs,
       greatest(coalesce(a.max_secs, 0), coalesce(b.max_secs, 0)) AS max_daily_secs,
       {_both('total_songs')} AS total_songs_played,
       {div(_both('sum_num100'), _both('total_songs'))} AS completion_rate,
       {div(_both('sum_num25'), _both('total_songs'))} AS skip_rate,
       {div(_both('sum_unq_ratio'), _both('n_unq_ratio_rows'))} AS unique_songs_ratio,
       {_both('n_rows')} AS active_days,
       greatest(coalesce(a.last_log_date, 0), coalesce(b.last_log_date, 0)) AS last_log_date,
       least(coalesce(a.first_log_date, b.first_log_date), coalesce(b.first_log_date, a.first_log_date)) AS first_log_date,
       CAST(datediff('day', {day('greatest(coalesce(a.last_log_date, 0), coalesce(b.last_log_date, 0))')},
                     DATE '{C.log_snapshot}') AS BIGINT) AS days_since_last_log
FROM (SELECT * FROM partial WHERE source = 'v1') a
FULL OUTER JOIN (SELECT * FROM partial WHERE source = 'v2') b USING (msno)
WHERE msno IN (SELECT msno FROM labels_v2)""")
cte("city_rank", ["members"], """
SELECT city, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, city) AS city_freq_rank
FROM members GROUP BY city""")
cte("via_rank", ["members"], """
SELECT registered_via, row_number() OVER (ORDER BY count(*) DESC, registered_via) AS rk
FROM members GROUP BY registered_via""")
_via_cols = ", ".join(
    [f"CASE WHEN rk = {i} THEN 1 ELSE 0 END AS reg_via_top{i}" for i in range(1, 6)]
    + ["CASE WHEN rk <= 5 THEN 0 ELSE 1 END AS reg_via_other"]
)
_tenure = f"datediff('day', {day('registration_init_time')}, DATE '{C.tenure_snapshot}')"
cte("member_feats", ["members", "city_rank", "via_rank"], f"""
SELECT msno, city_freq_rank, CASE WHEN bd >= 5 AND bd <= 100 THEN bd END AS age,
       CASE WHEN {_tenure} >= 0 THEN CAST({_tenure} AS BIGINT) END AS membership_tenure,
       CASE WHEN gender = 'male' THEN 1 ELSE 0 END AS gender_male,
       CASE WHEN gender = 'female' THEN 1 ELSE 0 END AS gender_female,
       CASE WHEN gender IS NULL THEN 1 ELSE 0 END AS gender_unknown,
       {_via_cols}, registration_init_time
FROM members LEFT JOIN city_rank USING (city) LEFT JOIN via_rank USING (registered_via)""")
_LOGS = [*LOG_FEATURES[:-1], "last_log_date", "first_log_date", "days_since_last_log"]
_TX = [
    "total_paid", "avg_payment", "max_payment", "discount_rate", "n_transactions", "avg_plan_days", "auto_renew_rate",
    "cancel_rate", "first_transaction", "last_transaction", "last_expire_date", "n_payment_methods", "days_as_member",
]
_MEM = [*MEMBER_FEATURES, *_VIA, "registration_init_time"]
MASTER_COLUMNS = ["msno", "is_churn", *_TX, *_LOGS, *_MEM]
cte("master_raw", ["labels_v2", "tx", "logs", "member_feats"], f"""
SELECT {', '.join(MASTER_COLUMNS)}
FROM labels_v2 LEFT JOIN tx USING (msno) LEFT JOIN logs USING (msno) LEFT JOIN member_feats USING (msno)""")


def _filled(c: str) -> str:
    if c == "days_since_last_log":
        return f"coalesce({c}, {C.max_log_days}) AS {c}"
    if c in _LOGS or c in TRANSACTION_FEATURES or c in _VIA or c in ("gender_male", "gender_female", "registration_init_time"):
        return f"coalesce({c}, 0) AS {c}"
    if c in ("gender_unknown", "city_freq_rank"):
        return f"coalesce({c}, 1) AS {c}"
    if c in ("age", "membership_tenure"):
        return f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM master_raw)) AS {c}"
    return c


cte("master", ["master_raw"], f"""
SELECT {', '.join(_filled(c) for c in MASTER_COLUMNS)},
       CASE WHEN coalesce(registration_init_time, 0) < {C.val_from} THEN 'train'
            WHEN registration_init_time < {C.test_from} THEN 'val' ELSE 'test' END AS split
FROM master_raw""")
_stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CLUSTER_FEATURES)
cte("scaled", ["master"], f"""
SELECT master.*, {', '.join(f'({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1) AS z_{c}' for c in CLUSTER_FEATURES)}
FROM master, (SELECT {_stats} FROM master)""")


def _distance(centroid) -> str:
    return " + ".join(f"(z_{c} - ({x})) * (z_{c} - ({x}))" for c, x in zip(CLUSTER_FEATURES, centroid))


_dists = ", ".join(f"CAST({_distance(c)} AS DOUBLE) AS d{i}" for i, c in enumerate(rules.CENTROIDS))
_k = range(len(rules.CENTROIDS))
_least = f"least({', '.join(f'd{i}' for i in _k)})"
cte("clustered", ["scaled"], f"""
SELECT * EXCLUDE ({', '.join(f'd{i}' for i in _k)}), {_least} AS distance,
       CASE {' '.join(f'WHEN d{i} = {_least} THEN {i}' for i in _k)} END AS cluster
FROM (SELECT *, {_dists} FROM scaled)""")
cte("profile", ["clustered"], f"""
SELECT cluster, {', '.join(f'avg({c}) AS {c}' for c in CLUSTER_FEATURES)} FROM clustered GROUP BY cluster""")
cte("dormant", ["profile"], "SELECT cluster FROM profile ORDER BY days_since_last_log DESC, cluster LIMIT 1")
cte("power", ["profile", "dormant"], """
SELECT cluster FROM profile WHERE cluster NOT IN (SELECT cluster FROM dormant)
ORDER BY completion_rate DESC, cluster LIMIT 1""")
cte("at_risk", ["profile", "dormant", "power"], """
SELECT cluster FROM profile
WHERE cluster NOT IN (SELECT cluster FROM dormant) AND cluster NOT IN (SELECT cluster FROM power)
ORDER BY days_since_last_log DESC, cluster LIMIT 1""")
cte("names", ["profile", "dormant", "power", "at_risk"], """
SELECT cluster, CASE WHEN cluster IN (SELECT cluster FROM dormant) THEN 'Dormant'
                     WHEN cluster IN (SELECT cluster FROM power) THEN 'Power Users'
                     WHEN cluster IN (SELECT cluster FROM at_risk) THEN 'At-Risk'
                     ELSE 'Casual Listeners' END AS segment_label
FROM profile""")
cte("segmented", ["clustered", "names"], "SELECT * FROM clustered JOIN names USING (cluster)")
cte("scores", ["master"], f"SELECT msno, is_churn, split, {prob(rules.MAIN)} AS churn_prob FROM master")
cte("models", ["master"], " UNION ALL ".join(
    f"SELECT msno, is_churn, split, '{n}' AS model, {prob(c)} AS churn_prob FROM master" for n, c in rules.MODELS.items()))
cte("clv_raw", ["master"], """
SELECT msno, split, total_paid / (days_as_member / CAST(30 AS DOUBLE)) * 12 AS clv_raw
FROM master WHERE is_churn = 0 AND days_as_member > 0""")
cte("clv", ["clv_raw"], f"""
SELECT *, least(clv_raw, (SELECT quantile_cont(clv_raw, {C.clv_cap_quantile}) FROM clv_raw WHERE split = 'train')) AS clv
FROM clv_raw""")
cte("vals", ["clv"], f"""
SELECT msno, split, clv AS actual_clv, clv * CAST({rules.VALUE_FACTOR} AS DOUBLE) AS predicted_clv FROM clv""")
cte("campaign", ["scores", "vals", "sweep"], """
SELECT msno, is_churn, churn_prob, CASE WHEN churn_prob >= (SELECT threshold FROM sweep ORDER BY business_cost, threshold LIMIT 1)
            THEN 1 ELSE 0 END AS predicted_churn, coalesce(predicted_clv, 0) AS predicted_clv
FROM (SELECT * FROM scores WHERE split = 'test') LEFT JOIN (SELECT msno, predicted_clv FROM vals) USING (msno)""")
cte("target", ["campaign"], f"""
SELECT *, CASE WHEN predicted_churn = 1 AND is_high_value = 1 THEN 1 ELSE 0 END AS is_target
FROM (SELECT *, CASE WHEN predicted_clv >= (SELECT quantile_cont(predicted_clv, {C.high_value_quantile}) FROM campaign
                                            WHERE predicted_clv > 0) THEN 1 ELSE 0 END AS is_high_value FROM campaign)""")
_ev = f"sum(churn_prob * predicted_clv * {C.retention_rate} - {C.offer_cost})"
_roi = f"""count(*) AS n_predicted_churners, avg(predicted_clv) AS mean_clv, avg(churn_prob) AS mean_churn_prob,
       coalesce({_ev}, 0) AS net_roi, count(*) * CAST({C.offer_cost} AS DOUBLE) AS campaign_cost,
       coalesce({_ev} * 100 / nullif(count(*) * CAST({C.offer_cost} AS DOUBLE), 0), 0) AS roi_pct"""
cte("roi", ["target"], f"SELECT {_roi} FROM target WHERE is_target = 1")
cte("seg_roi", ["campaign", "segmented"], f"""
SELECT coalesce(segment_label, 'Unknown') AS segment, {_roi}
FROM campaign LEFT JOIN (SELECT msno, segment_label FROM segmented) USING (msno)
WHERE predicted_churn = 1 GROUP BY 1""")
_cum = "ORDER BY churn_prob DESC RANGE UNBOUNDED PRECEDING"
cte("ranked", ["models"], f"""
SELECT model, churn_prob, pos, neg,
       sum(pos) OVER (PARTITION BY model {_cum}) AS cp, sum(neg) OVER (PARTITION BY model {_cum}) AS cn,
       sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn
FROM (SELECT model, churn_prob, CAST(sum(is_churn) AS DOUBLE) AS pos, CAST(sum(1 - is_churn) AS DOUBLE) AS neg
      FROM models GROUP BY model, churn_prob)""")


def auc_sql(source: str, by: list[str], score: str = "churn_prob") -> str:
    """Pairs ranked right, by the mean rank of the positives (Mann-Whitney), not by running sums."""
    keys = ", ".join(by)
    return f"""
SELECT {keys}, (sum(CASE WHEN is_churn = 1 THEN rk END) - p * (p + 1) / 2) / nullif(p * n, 0) AS auc
FROM (SELECT {keys}, is_churn,
             rank() OVER (PARTITION BY {keys} ORDER BY {score})
               + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / CAST(2 AS DOUBLE) AS rk,
             CAST(sum(is_churn) OVER (PARTITION BY {keys}) AS DOUBLE) AS p,
             CAST(sum(1 - is_churn) OVER (PARTITION BY {keys}) AS DOUBLE) AS n
      FROM {source} WHERE {score} IS NOT NULL)
GROUP BY {keys}, p, n"""


_cells = f"""
count(*) FILTER (is_churn = 0 AND churn_prob < {C.default_threshold}) AS tn,
count(*) FILTER (is_churn = 0 AND churn_prob >= {C.default_threshold}) AS fp,
count(*) FILTER (is_churn = 1 AND churn_prob < {C.default_threshold}) AS fn,
count(*) FILTER (is_churn = 1 AND churn_prob >= {C.default_threshold}) AS tp"""
_P = f"coalesce({div('tp', 'tp + fp')}, 0)"
_R = f"coalesce({div('tp', 'tp + fn')}, 0)"
_F1 = f"coalesce({div('2 * tp', '2 * tp + fp + fn')}, 0)"
cte("cells", ["models"], f"SELECT model, split, {_cells} FROM models GROUP BY model, split")
cte("val_models", ["models"], "SELECT * FROM models WHERE split = 'val'")
cte("val_auc", ["val_models"], auc_sql("val_models", ["model"]))
cte("comparison", ["val_auc", "cells"], f"""
SELECT model, auc, {_F1} AS f1, {_P} AS precision, {_R} AS recall
FROM val_auc JOIN (SELECT * FROM cells WHERE split = 'val') USING (model)""")
cte("sweep", ["scores"], f"""
SELECT *, fn * {C.fn_cost} + fp * {C.fp_cost} AS business_cost, {_F1} AS f1, {_P} AS precision, {_R} AS recall
FROM (SELECT threshold,
             count(*) FILTER (is_churn = 1 AND churn_prob >= threshold) AS tp,
             count(*) FILTER (is_churn = 0 AND churn_prob >= threshold) AS fp,
             count(*) FILTER (is_churn = 1 AND churn_prob < threshold) AS fn,
             count(*) FILTER (is_churn = 0 AND churn_prob < threshold) AS tn
      FROM scores, (SELECT k / CAST(20 AS DOUBLE) AS threshold FROM range(2, 19) g(k))
      WHERE split = 'val' GROUP BY threshold)""")


def _contribution(name: str, weight: float) -> str:
    return f"""SELECT msno, '{name}' AS feature,
       ({name} - (SELECT avg({name}) FROM master)) * CAST({weight} AS DOUBLE) AS contribution, CAST({name} AS DOUBLE) AS value
FROM master"""


cte("attributions", ["master"], " UNION ALL ".join(_contribution(n, w) for n, w in rules.weights(rules.MAIN).items()))

ORACLES: dict[str, str] = {}


def oracle(name: str, needs: list[str], body: str) -> None:
    ORACLES[name] = with_ctes(needs, body)


def _nulls(source: str, columns: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct{extra} FROM {source}"
        for c in columns
    )


_DOUBLE = {
    "avg_payment", "discount_rate", "avg_plan_days", "auto_renew_rate", "cancel_rate", "total_secs", "avg_daily_secs",
    "max_daily_secs", "total_songs_played", "completion_rate", "skip_rate", "unique_songs_ratio",
}


def _rounded(columns, also=()) -> str:
    return ", ".join(r(c, c) if c in _DOUBLE or c in also else c for c in columns)


oracle("union_all_sources", ["transactions_src"], """
SELECT msno, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew,
       transaction_date, membership_expire_date, is_cancel, source FROM transactions_src""")
oracle("row_counts_by_source", ["transactions_src", "user_logs_src"], """
SELECT source, count(*) AS n, 'transactions' AS table_name FROM transactions_src GROUP BY source
UNION ALL SELECT source, count(*), 'user_logs' FROM user_logs_src GROUP BY source""")
_TXRAW = [
    "msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew",
    "transaction_date", "membership_expire_date", "is_cancel",
]
_LOGRAW = ["msno", "date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"]
_MEMRAW = ["msno", "city", "bd", "gender", "registered_via", "registration_init_time"]
oracle("null_profile", ["transactions", "user_logs", "members"], " UNION ALL ".join(
    _nulls(t, cols, f", '{t}' AS table_name")
    for t, cols in (("transactions", _TXRAW), ("user_logs", _LOGRAW), ("members", _MEMRAW))))
oracle("table_profile", ["members"], " UNION ALL ".join(
    _nulls("members", [c], f", {i} AS position, '{t}' AS data_type")
    for i, (c, t) in enumerate(zip(_MEMRAW, ["bigint", "int", "int", "string", "int", "int"]))))
oracle("qc_invalid_age", ["members"], """
SELECT count(*) AS n_rows, count(*) FILTER (bd <= 0 OR bd > 120) AS n_invalid,
       round(100.0 * count(*) FILTER (bd <= 0 OR bd > 120) / count(*), 6) AS pct FROM members""")
oracle("qc_overpaid", ["transactions"], """
SELECT n_rows, n_overpaid, round(100.0 * n_overpaid / n_rows, 6) AS pct
FROM (SELECT count(*) AS n_rows,
             count(*) FILTER (actual_amount_paid > plan_list_price AND plan_list_price > 0) AS n_overpaid FROM transactions)""")
oracle("qc_zero_secs", ["user_logs"], """
SELECT n_rows, n_zero, round(100.0 * n_zero / n_rows, 6) AS pct
FROM (SELECT count(*) AS n_rows, count(*) FILTER (total_secs = 0) AS n_zero FROM user_logs)""")
oracle("qc_key_overlap", ["labels_v2", "members"], """
SELECT count(DISTINCT l.msno) AS n_left, count(DISTINCT m.msno) AS n_right,
       count(DISTINCT CASE WHEN l.msno = m.msno THEN l.msno END) AS n_both,
       count(DISTINCT CASE WHEN m.msno IS NULL THEN l.msno END) AS n_only_left,
       count(DISTINCT CASE WHEN l.msno IS NULL THEN m.msno END) AS n_only_right
FROM labels_v2 l FULL OUTER JOIN members m ON l.msno = m.msno""")
oracle("qc_churn_rate", ["labels_v1", "labels_v2"], """
SELECT count(*) AS n, round(avg(is_churn) * 100, 6) AS churn_rate_pct, 'train_v2' AS label_file FROM labels_v2
UNION ALL SELECT count(*), round(avg(is_churn) * 100, 6), 'train' FROM labels_v1""")
oracle("transaction_features", ["tx"], f"SELECT msno, {_rounded(_TX)} FROM tx")
oracle("transaction_features_cutoff", ["tx_cut"], f"SELECT msno, {_rounded(_TX)} FROM tx_cut")
oracle("log_features_single", ["logs_single"], """
SELECT msno, round(total_secs, 6) AS total_secs, round(avg_daily_secs, 6) AS avg_daily_secs,
       round(max_daily_secs, 6) AS max_daily_secs, total_songs_played, round(completion_rate, 6) AS completion_rate,
       round(skip_rate, 6) AS skip_rate, round(unique_songs_ratio, 6) AS unique_songs_ratio, active_days, last_log_date,
       first_log_date FROM logs_single""")
oracle("log_features_partial", ["partial", "labels_v2"], """
SELECT msno, source, round(sum_secs, 6) AS sum_secs, n_rows, round(max_secs, 6) AS max_secs, total_songs, sum_num100,
       sum_num25, round(sum_unq_ratio, 6) AS sum_unq_ratio, n_unq_ratio_rows, last_log_date, first_log_date
FROM partial WHERE msno IN (SELECT msno FROM labels_v2)""")
oracle("log_features_twopass", ["logs"], f"SELECT msno, {_rounded(_LOGS)} FROM logs")
oracle("log_coverage", ["labels_v2", "logs"], """
SELECT n_labelled, n_with_logs, n_labelled - n_with_logs AS n_without_logs,
       round(100.0 * n_with_logs / n_labelled, 6) AS pct_with_logs,
       round(100.0 * (n_labelled - n_with_logs) / n_labelled, 6) AS pct_without_logs
FROM (SELECT (SELECT count(*) FROM labels_v2) AS n_labelled, (SELECT count(*) FROM logs) AS n_with_logs)""")
oracle("city_frequency_rank", ["city_rank"], "SELECT city, n_rows, city_freq_rank FROM city_rank")
oracle("registered_via_onehot", ["member_feats"], f"SELECT msno, {', '.join(_VIA)} FROM member_feats")
oracle("member_features", ["member_feats"], f"SELECT msno, {', '.join(_MEM)} FROM member_feats")
oracle("master_features", ["master_raw"], f"SELECT {_rounded(MASTER_COLUMNS)} FROM master_raw")
oracle("master_features_imputed", ["master"], f"SELECT {_rounded(MASTER_COLUMNS, ('age', 'membership_tenure'))} FROM master")
oracle("null_audit", ["master_raw"], _nulls("master_raw", MASTER_COLUMNS))
oracle("feature_null_audit", ["master_raw", "master"], f"""
SELECT column_name, a.nulls AS nulls_before, b.nulls AS nulls_after, b.nulls = 0 AS passed
FROM ({_nulls('master_raw', MASTER_COLUMNS)}) a JOIN ({_nulls('master', MASTER_COLUMNS)}) b USING (column_name)""")
oracle("missing_feature_flags", ["master_raw"], """
SELECT count(*) AS n_labelled, count(*) - count(n_transactions) AS n_without_transactions,
       count(*) - count(active_days) AS n_without_logs, count(*) - count(registration_init_time) AS n_without_member
FROM master_raw""")

_q = lambda c, p: f"quantile_cont(CAST({c} AS DOUBLE), {p})"
oracle("numeric_summary", ["master"], " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS n, {r(f'avg(CAST({c} AS DOUBLE))', 'mean')}, {r(f'stddev_samp({c})', 'std')},
       {r(f'CAST(min({c}) AS DOUBLE)', 'min')}, {r(f'CAST(max({c}) AS DOUBLE)', 'max')},
       {r(_q(c, 0.25), 'p25')}, {r(_q(c, 0.5), 'p50')}, {r(_q(c, 0.75), 'p75')} FROM master"""
    for c in (*TRANSACTION_FEATURES, *LOG_FEATURES)))
oracle("quantiles", ["master"], " UNION ALL ".join(
    f"SELECT is_churn, '{c}' AS feature, CAST({p} AS DOUBLE) AS share, {r(_q(c, p), 'quantile')} FROM master GROUP BY is_churn"
    for c in ("total_paid", "n_transactions", "avg_daily_secs", "age") for p in (0.5, 0.75, 0.9, 0.99)))
oracle("clip_p99", ["master"], """
SELECT msno, total_paid,
       round(least(total_paid, (SELECT quantile_cont(CAST(total_paid AS DOUBLE), 0.99) FROM master)), 6) AS total_paid_capped
FROM master""")


def _hist(source: str, bins: int) -> str:
    return f"""
SELECT bin, round(lo + bin * width, 6) AS bin_from, round(lo + bin * width + width, 6) AS bin_to, count(*) AS n
FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / nullif(width, 0)), {bins - 1}) END AS BIGINT) AS bin, lo, width
      FROM (SELECT v, lo, hi, (hi - lo) / CAST({bins} AS DOUBLE) AS width
            FROM ({source}), (SELECT min(v) AS lo, max(v) AS hi FROM ({source}))))
GROUP BY bin, lo, width"""


oracle("histogram", ["master"], _hist(
    "SELECT least(CAST(total_paid AS DOUBLE), (SELECT quantile_cont(CAST(total_paid AS DOUBLE), 0.99) FROM master)) AS v FROM master", 60))
oracle("registration_histogram", ["master"], _hist(
    "SELECT CAST(registration_init_time AS DOUBLE) AS v FROM master WHERE registration_init_time > 0", 40))
oracle("rate_histogram", ["master"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round_even({c}, 1) AS rate, count(*) AS n FROM master GROUP BY 2"
    for c in ("auto_renew_rate", "cancel_rate")))
_bucket = binned("auto_renew_rate", (-0.001, 0.25, 0.75, 1.001), ("Low (0-0.25)", "Mid (0.25-0.75)", "High (0.75-1.0)"))
oracle("churn_by_auto_renew", ["tx", "labels_v2"], f"""
SELECT {_bucket} AS auto_renew_bucket, count(*) AS n_customers, CAST(sum(is_churn) AS BIGINT) AS churned,
       round(100.0 * sum(is_churn) / count(*), 6) AS churn_rate
FROM tx JOIN labels_v2 USING (msno) GROUP BY 1""")
oracle("churn_rate_by_dimension", ["labels_v2", "members"], " UNION ALL ".join(f"""
(SELECT '{d}' AS dimension, CAST(k AS VARCHAR) AS category, count(*) AS n_customers, CAST(sum(is_churn) AS BIGINT) AS churned,
        round(100.0 * sum(is_churn) / count(*), 6) AS churn_rate
 FROM (SELECT is_churn, {e} AS k FROM labels_v2 JOIN members USING (msno)) GROUP BY k
 ORDER BY 100.0 * sum(is_churn) / count(*) DESC, k LIMIT 10)"""
    for d, e in (("city", "city"), ("registered_via", "registered_via"), ("gender", "coalesce(gender, 'unknown')"))))
_ENG = ("completion_rate", "skip_rate", "days_since_last_log")
oracle("engagement_by_churn", ["logs", "labels_v2"], " UNION ALL ".join(f"""
SELECT CASE is_churn WHEN 0 THEN 'Retained' ELSE 'Churned' END AS churn_label, '{c}' AS feature, {r(_q(c, 0.5), 'median')}
FROM logs JOIN labels_v2 USING (msno) GROUP BY is_churn""" for c in _ENG))
oracle("engagement_boxplot", ["logs", "labels_v2"], " UNION ALL ".join(f"""
SELECT is_churn, '{c}' AS feature, count(v) AS n, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
       round(least(min(CASE WHEN v >= q1 - (q3 - q1) * 1.5 THEN v END), q1), 6) AS whisker_low,
       round(greatest(max(CASE WHEN v <= q3 + (q3 - q1) * 1.5 THEN v END), q3), 6) AS whisker_high
FROM (SELECT is_churn, CAST({c} AS DOUBLE) AS v FROM logs JOIN labels_v2 USING (msno))
JOIN (SELECT is_churn, {_q(c, 0.25)} AS q1, {_q(c, 0.5)} AS med, {_q(c, 0.75)} AS q3
      FROM logs JOIN labels_v2 USING (msno) GROUP BY is_churn) USING (is_churn)
GROUP BY is_churn, q1, med, q3""" for c in _ENG))
_hash = "md5(concat('42|', CAST(msno AS VARCHAR)))"
oracle("stratified_sample", ["master"], f"""
SELECT msno, is_churn FROM master QUALIFY row_number() OVER (PARTITION BY is_churn ORDER BY {_hash}, msno) <= 100""")
oracle("uniform_sample", ["master"], f"""
SELECT msno, is_churn FROM master QUALIFY row_number() OVER (ORDER BY {_hash}, msno) <= 300""")
oracle("oof_fold_assignment", ["master"], f"""
SELECT msno, is_churn, CAST((row_number() OVER (PARTITION BY is_churn ORDER BY {_hash}, msno) - 1) % 5 AS INTEGER) AS fold
FROM master WHERE split = 'train'""")
oracle("temporal_split", ["master"], "SELECT msno, registration_init_time, split FROM master")
oracle("split_summary", ["master"], """
SELECT split, n, churned, round(100.0 * n / sum(n) OVER (), 6) AS pct_of_rows, round(rate, 6) AS churn_rate_pct,
       round(max(rate) OVER () - min(rate) OVER (), 6) AS spread_pp, max(rate) OVER () - min(rate) OVER () > 5 AS spread_warning
FROM (SELECT split, count(*) AS n, CAST(sum(is_churn) AS BIGINT) AS churned, 100.0 * sum(is_churn) / count(*) AS rate
      FROM master GROUP BY split)""")
_balance = f"""count(*) AS n_total, CAST(sum(is_churn) AS BIGINT) AS n_minority,
       CAST(count(*) - sum(is_churn) AS BIGINT) AS n_majority,
       {r(div('count(*) - sum(is_churn)', 'sum(is_churn)'), 'class_weight_ratio')},
       {r('avg(is_churn)', 'overall_churn_rate')}"""
oracle("class_balance", ["master"], f"SELECT split, {_balance} FROM master GROUP BY split")
oracle("kv_artifact", ["master"], f"""
SELECT key, value FROM (SELECT {_balance} FROM master),
LATERAL (VALUES ('class_weight_ratio', printf('%.6f', class_weight_ratio)), ('n_majority', CAST(n_majority AS VARCHAR)),
                ('n_minority', CAST(n_minority AS VARCHAR)), ('overall_churn_rate', printf('%.6f', overall_churn_rate))) t(key, value)""")
oracle("leakage_cutoff_contrast", ["master"], f"""
SELECT CASE WHEN last_expire_date <= {C.label_cutoff} THEN 'up_to_cutoff' ELSE 'after_cutoff' END AS side,
       count(*) AS n, round(avg(is_churn) * 100, 6) AS churn_rate_pct
FROM master WHERE last_expire_date IS NOT NULL GROUP BY 1""")
_long = " UNION ALL ".join(
    f"SELECT is_churn, '{c}' AS feature, {'-' if inv else ''}CAST({c} AS DOUBLE) AS score FROM master" for c, inv in AUDITED.items())
oracle("single_feature_auc", ["master"], f"""
SELECT feature, round(greatest(auc, 1 - auc), 6) AS effective_auc FROM ({auc_sql(f'({_long})', ['feature'], 'score')})""")
oracle("leakage_expiry_bins", ["master"], f"""
SELECT * FROM (SELECT {binned('last_expire_date', C.expiry_edges, C.expiry_labels)} AS bin, count(*) AS n,
                      round(avg(is_churn) * 100, 6) AS churn_rate_pct FROM master GROUP BY 1) WHERE bin IS NOT NULL""")
oracle("scaler_stats", ["master"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg({c})', 'mean')}, {r(f'stddev_pop({c})', 'std')} FROM master WHERE split = 'train'"
    for c in (*TRANSACTION_FEATURES, *LOG_FEATURES, *MEMBER_FEATURES)))
oracle("standardize", ["scaled"], f"SELECT msno, {', '.join(r(f'z_{c}', f'z_{c}') for c in CLUSTER_FEATURES)} FROM scaled")
# K-Means passes from the rules' centres: the nearest centre of each row (the first of equals), then each centre at its rows' mean
_Z = [f"z_{c}" for c in CLUSTER_FEATURES]
cte("km0", [], "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(f'{float(x)}::DOUBLE' for x in c)})" for i, c in enumerate(rules.CENTROIDS)) + ") t(cluster, " + ", ".join(f"m{i}" for i in range(len(_Z))) + ")")
for _n in range(4):
    cte(f"kn{_n}", ["scaled", f"km{_n}"], f"""
SELECT msno, {', '.join(_Z)}, cluster, {' + '.join(f'({z} - m{i}) * ({z} - m{i})' for i, z in enumerate(_Z))} AS far
FROM scaled CROSS JOIN km{_n} QUALIFY row_number() OVER (PARTITION BY msno ORDER BY far, cluster) = 1""")
    cte(f"km{_n + 1}", [f"km{_n}", f"kn{_n}"], f"""
SELECT k.cluster, {', '.join(f'coalesce(avg({z}), any_value(k.m{i})) AS m{i}' for i, z in enumerate(_Z))} FROM km{_n} k LEFT JOIN kn{_n} p USING (cluster) GROUP BY k.cluster""")
oracle("kmeans_fixed_passes", ["km3", "kn3"], f"""
SELECT k.cluster, count(p.msno) AS n_rows, round(coalesce(sum(p.far), 0), 4) AS cost, {', '.join(f'round(any_value(k.m{i}), 6) AS c{i}' for i in range(len(_Z)))}
FROM km3 k LEFT JOIN kn3 p USING (cluster) GROUP BY k.cluster""")
oracle("assign_centroid", ["clustered"], "SELECT msno, cluster, round(distance, 6) AS distance FROM clustered")
oracle("name_segments", ["names"], "SELECT cluster, segment_label FROM names")
_segprof = f"""segment_label, {', '.join(f'avg({c}) AS {c}' for c in CLUSTER_FEATURES)}, count(*) AS n_customers,
       avg(is_churn) * 100 AS churn_rate_pct FROM segmented GROUP BY segment_label"""
oracle("segment_profiles", ["segmented"], f"""
SELECT segment_label, n_customers, {', '.join(r(c, c) for c in (*CLUSTER_FEATURES, 'churn_rate_pct'))} FROM (SELECT {_segprof})""")
oracle("segment_onehot", ["segmented"], "SELECT msno, " + ", ".join(
    f"CASE WHEN segment_label = '{s}' THEN 1 ELSE 0 END AS segment_{s.replace(' ', '_').replace('-', '_')}" for s in SEGMENTS)
    + " FROM segmented")
oracle("normalize_columns", ["segmented"], "SELECT split, " + ", ".join(
    f"count(*) FILTER (segment_label = '{s}') AS {s.replace(' ', '_').replace('-', '_')}" for s in SEGMENTS)
    + " FROM segmented GROUP BY split")
oracle("roc_auc", ["models"], f"SELECT model, split, round(auc, 6) AS auc FROM ({auc_sql('models', ['model', 'split'])})")
oracle("classification_metrics", ["cells"], f"""
SELECT model, split, {r(div('tp + tn', 'tn + fp + fn + tp'), 'accuracy')}, {r(_P, 'precision')}, {r(_R, 'recall')}, {r(_F1, 'f1')}
FROM cells""")
oracle("confusion_matrix", ["cells"], "SELECT *, " + ", ".join(
    r(div(f"100 * {c}", "tn + fp + fn + tp"), f"{c}_pct") for c in ("tn", "fp", "fn", "tp")) + " FROM cells")
oracle("class_report", ["scores"], f"""
WITH c AS (SELECT {_cells} FROM scores),
per AS (
  SELECT 'Not Churn' AS class_name, coalesce({div('tn', 'tn + fn')}, 0) AS p, coalesce({div('tn', 'tn + fp')}, 0) AS rc,
         coalesce({div('2 * tn', '2 * tn + fn + fp')}, 0) AS f, tn + fp AS s FROM c
  UNION ALL SELECT 'Churn', {_P}, {_R}, {_F1}, tp + fn FROM c)
SELECT class_name, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, s AS support FROM per
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT round({div('tp + tn', 'tn + fp + fn + tp')}, 6) AS a, tn + fp + fn + tp AS n FROM c)
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(rc * s) / sum(s), 6), round(sum(f * s) / sum(s), 6),
                 CAST(sum(s) AS BIGINT) FROM per""")
ORACLES["class_report"] = ORACLES["class_report"].replace("\n\nWITH c AS", ",\nc AS")
oracle("roc_curve", ["ranked"], """
SELECT model, churn_prob AS threshold, round(cn / nn, 6) AS fpr, round(cp / np, 6) AS tpr FROM ranked
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked""")
oracle("pr_curve", ["ranked"], """
SELECT model, churn_prob AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / np, 6) AS recall FROM ranked
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked""")
oracle("average_precision", ["ranked"], """
SELECT model, round(sum(pos / np * cp / (cp + cn)), 6) AS average_precision, round(max(np / (np + nn)), 6) AS baseline_precision
FROM ranked GROUP BY model""")
_sweepcols = f"tp, fp, fn, tn, business_cost, {r('f1', 'f1')}, {r('precision', 'precision')}, {r('recall', 'recall')}"
oracle("threshold_sweep", ["sweep"], f"SELECT round(threshold, 6) AS threshold, {_sweepcols} FROM sweep")
oracle("optimal_threshold", ["sweep"], f"""
SELECT round(threshold, 6) AS optimal_threshold, {_sweepcols},
       (SELECT round(threshold, 6) FROM sweep ORDER BY sweep.f1 DESC, threshold LIMIT 1) AS best_f1_threshold
FROM sweep ORDER BY business_cost, threshold LIMIT 1""")
oracle("threshold_savings", ["sweep"], f"""
SELECT o.threshold AS optimal_threshold, d.business_cost AS cost_default, o.business_cost AS cost_optimal,
       d.business_cost - o.business_cost AS savings,
       {r(div('100 * (d.business_cost - o.business_cost)', 'd.business_cost'), 'savings_pct')}
FROM (SELECT * FROM sweep ORDER BY business_cost, threshold LIMIT 1) o, (SELECT * FROM sweep WHERE threshold = 0.5) d""")
oracle("model_comparison_merge", ["comparison"], """
SELECT model, round(auc, 4) AS auc, round(f1, 4) AS f1, round(precision, 4) AS precision, round(recall, 4) AS recall FROM comparison""")
oracle("select_final_model", ["comparison"], f"""
SELECT CASE WHEN e.auc - s.auc >= 0.005 THEN '{rules.ENSEMBLE}' ELSE s.model END AS final_model,
       round(CASE WHEN e.auc - s.auc >= 0.005 THEN e.auc ELSE s.auc END, 6) AS auc,
       round((e.auc - s.auc) * 100, 6) AS ensemble_gain_pp
FROM (SELECT * FROM comparison WHERE model <> '{rules.ENSEMBLE}' ORDER BY auc DESC, model LIMIT 1) s,
     (SELECT * FROM comparison WHERE model = '{rules.ENSEMBLE}') e""")
oracle("clv_target", ["clv"], "SELECT msno, split, round(clv_raw, 6) AS clv_raw, round(clv, 6) AS clv FROM clv")
_FEATS = [*TRANSACTION_FEATURES, *LOG_FEATURES, *MEMBER_FEATURES, *_VIA]
oracle("clv_training_set", ["master", "clv"], f"""
SELECT msno, master.split, {_rounded(_FEATS, ('age', 'membership_tenure'))}, round(clv, 6) AS clv
FROM master JOIN (SELECT msno, clv FROM clv) USING (msno)""")
oracle("regression_metrics", ["vals"], """
SELECT split, count(*) AS n, round(sqrt(avg(power(actual_clv - predicted_clv, 2))), 2) AS rmse,
       round(avg(abs(actual_clv - predicted_clv)), 2) AS mae,
       round(1 - sum(power(actual_clv - predicted_clv, 2)) / (var_pop(actual_clv) * count(*)), 6) AS r2
FROM vals GROUP BY split""")
oracle("residuals", ["vals"], """
SELECT msno, split, round(actual_clv, 6) AS actual_clv, round(predicted_clv, 6) AS predicted_clv,
       round(actual_clv - predicted_clv, 6) AS residual FROM vals""")
cte("seg_clv", ["vals", "segmented"], """
SELECT coalesce(segment_label, 'Unknown') AS segment_label, avg(predicted_clv) AS mean_clv, count(*) AS n_customers,
       quantile_cont(predicted_clv, 0.5) AS median_clv
FROM vals LEFT JOIN (SELECT msno, segment_label FROM segmented) USING (msno) GROUP BY 1""")
oracle("segment_clv", ["seg_clv"], """
SELECT segment_label, round(mean_clv, 2) AS mean_clv, n_customers, round(median_clv, 2) AS median_clv,
       CAST(row_number() OVER (ORDER BY seg_clv.mean_clv DESC, segment_label) AS INTEGER) AS position FROM seg_clv""")
oracle("segment_priority", ["seg_clv", "segmented"], """
SELECT segment_label, round(mean_clv, 2) AS mean_clv, round(churn_rate, 6) AS churn_rate,
       round(mean_clv * churn_rate, 2) AS priority_score,
       CAST(row_number() OVER (ORDER BY seg_clv.mean_clv * churn_rate DESC, segment_label) AS INTEGER) AS position
FROM seg_clv JOIN (SELECT segment_label, avg(is_churn) AS churn_rate FROM segmented GROUP BY 1) USING (segment_label)""")
oracle("campaign_scoring", ["campaign"], """
SELECT msno, is_churn, churn_prob, predicted_churn, round(predicted_clv, 6) AS predicted_clv FROM campaign""")
oracle("campaign_target", ["target"], """
SELECT msno, is_churn, churn_prob, predicted_churn, round(predicted_clv, 6) AS predicted_clv, is_high_value, is_target FROM target""")
_roicols = ", ".join(["n_predicted_churners"] + [r(c, c) for c in ("mean_clv", "mean_churn_prob", "net_roi", "campaign_cost", "roi_pct")])
oracle("campaign_roi", ["roi"], f"SELECT {_roicols} FROM roi")
oracle("roi_sensitivity", ["target"], """
SELECT retention_rate, offer_cost, round(net, 2) AS net_roi, abs(net) < 10000 AS near_breakeven
FROM (SELECT k / CAST(20 AS DOUBLE) AS retention_rate, CAST(c AS DOUBLE) AS offer_cost,
             sum(CASE WHEN is_target = 1 THEN churn_prob * predicted_clv * (k / CAST(20 AS DOUBLE)) - c ELSE 0 END) AS net
      FROM target, range(2, 9) a(k), range(4, 21, 2) b(c) GROUP BY k, c)""")
oracle("segment_roi", ["seg_roi"], f"""
SELECT segment, {_roicols}, CASE WHEN net_roi >= 0 THEN 'gain' ELSE 'loss' END AS outlook,
       CAST(row_number() OVER (ORDER BY seg_roi.net_roi DESC, segment) AS INTEGER) AS position FROM seg_roi""")
oracle("recommended_segment", ["seg_roi"], f"""
SELECT segment, {_roicols}, CASE WHEN net_roi >= 0 THEN 'gain' ELSE 'loss' END AS outlook
FROM seg_roi ORDER BY seg_roi.net_roi DESC, segment LIMIT 1""")
oracle("roi_summary", ["roi", "seg_roi"], f"""
SELECT 'ALL (high-value target)' AS segment, {_roicols} FROM roi UNION ALL SELECT segment, {_roicols} FROM seg_roi""")
oracle("kpi_overview", ["master", "comparison", "roi"], """
SELECT 1 AS position, 'Customers Analysed' AS kpi, format('{:,}', count(*)) AS value FROM master
UNION ALL SELECT 2, 'Test Set Churn Rate', printf('%.1f%%', round(avg(is_churn) * 100, 1)) FROM master WHERE split = 'test'
UNION ALL SELECT 3, 'Best Model ROC-AUC', printf('%.4f', round(max(auc), 4)) FROM comparison
UNION ALL SELECT 4, 'Campaign Net ROI', printf('$%.0fk', round(net_roi / 1000)) FROM roi""")
oracle("report_segments", ["segmented"], f"""
SELECT segment_label AS segment, format('{{:,}}', n_customers) AS customers, printf('%.2f', round(churn_rate_pct, 2)) AS churn_rate_pct,
       format('{{:,.0f}}', round(avg_daily_secs)) AS avg_daily_secs, printf('%.2f%%', round(completion_rate * 100, 2)) AS completion_rate,
       printf('%.2f%%', round(skip_rate * 100, 2)) AS skip_rate, format('{{:,.0f}}', round(active_days)) AS active_days,
       format('{{:,.0f}}', round(days_since_last_log)) AS days_since_last_log
FROM (SELECT {_segprof})""")
oracle("report_roi", ["seg_roi"], """
SELECT segment, format('{:,}', n_predicted_churners) AS predicted_churners, '$' || format('{:,.0f}', round(mean_clv)) AS mean_clv,
       printf('%.1f%%', round(mean_churn_prob * 100, 1)) AS mean_churn_prob, '$' || format('{:,.0f}', round(net_roi)) AS net_roi,
       format('{:,.0f}', round(roi_pct)) || '%' AS roi_pct FROM seg_roi""")
oracle("linear_attributions", ["attributions"], """
SELECT msno, feature, round(contribution, 6) AS contribution, round(value, 6) AS value FROM attributions""")
_a, _b = NEWTON_FEATURES
cte("newton_rows", ["master"], f"""
SELECT (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS u, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS v, y,
       count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w
FROM (SELECT CAST({_a} AS DOUBLE) AS a, CAST({_b} AS DOUBLE) AS b, CAST(is_churn AS DOUBLE) AS y FROM master WHERE split = 'train')""")
cte("newton0", [], "SELECT CAST(0 AS DOUBLE) AS c0, CAST(0 AS DOUBLE) AS c1, CAST(0 AS DOUBLE) AS c2")
for _k in range(1, NEWTON_STEPS + 1):  # Cramer's rule on three unknowns; the penalty is 1, the intercept is free
    cte(f"newton{_k}", ["newton_rows", f"newton{_k - 1}"], f"""
SELECT c0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS c0,
       c1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS c1,
       c2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS c2
FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d
      FROM (SELECT any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2,
                   sum(w * (p - y)) AS g0, sum(w * (p - y) * u) + any_value(c1) AS g1, sum(w * (p - y) * v) + any_value(c2) AS g2,
                   sum(q) AS h00, sum(q * u) AS h01, sum(q * v) AS h02, sum(q * u * u) + 1 AS h11, sum(q * u * v) AS h12, sum(q * v * v) + 1 AS h22
            FROM (SELECT *, w * p * (1 - p) AS q
                  FROM (SELECT *, 1 / (1 + exp(-(c0 + c1 * u + c2 * v))) AS p FROM newton_rows, newton{_k - 1}))))""")
oracle("newton_logistic_steps", [f"newton{_k}" for _k in range(1, NEWTON_STEPS + 1)], " UNION ALL ".join(
    f"SELECT {_k} AS step, '{_n}' AS feature, round({_c}, 6) AS coefficient FROM newton{_k}"
    for _k in range(1, NEWTON_STEPS + 1) for _n, _c in zip(("intercept", _a, _b), ("c0", "c1", "c2"))))
cte("importance", ["attributions"], "SELECT feature, avg(abs(contribution)) AS m FROM attributions GROUP BY feature")
oracle("attribution_importance", ["importance"], """
SELECT feature, round(m, 6) AS mean_abs_contribution,
       CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS importance_rank FROM importance""")
oracle("top_risk_customers", ["scores"], """
SELECT msno, is_churn, split, churn_prob FROM scores ORDER BY churn_prob DESC, msno LIMIT 100""")
cte("case_a", ["scores"], "SELECT 'A' AS case_id, 'highest risk' AS case_type, * FROM scores ORDER BY churn_prob DESC, msno LIMIT 1")
cte("case_b", ["scores"], "SELECT 'B' AS case_id, 'lowest risk' AS case_type, * FROM scores ORDER BY churn_prob, msno LIMIT 1")
cte("case_c", ["scores"], f"""
SELECT 'C' AS case_id, CASE WHEN is_churn = 1 THEN 'false negative' ELSE 'false positive' END AS case_type, *
FROM scores WHERE (is_churn = 1) <> (churn_prob >= {C.default_threshold})
ORDER BY is_churn DESC, churn_prob DESC, msno LIMIT 1""")
oracle("explanation_cases", ["case_a", "case_b", "case_c", "attributions"], """
SELECT case_id, case_type, msno, churn_prob, is_churn, feature, round(contribution, 6) AS contribution, round(value, 6) AS value, place
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS place
      FROM (SELECT * FROM case_a UNION ALL SELECT * FROM case_b UNION ALL SELECT * FROM case_c) JOIN attributions USING (msno))
WHERE place <= 15""")
oracle("feature_place", ["importance"], """
SELECT feature, importance_rank, importance_rank <= 10 AS is_top
FROM (SELECT feature, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS importance_rank FROM importance)
WHERE feature = 'n_transactions'""")
oracle("report_threshold", ["sweep"], """
SELECT position, kpi, value FROM (SELECT * FROM sweep ORDER BY business_cost, threshold LIMIT 1) s,
LATERAL (VALUES (1, 'Optimal Threshold', printf('%.2f', round(threshold, 2))), (2, 'F1 @ Optimal', printf('%.4f', round(s.f1, 4))),
                (3, 'Precision', printf('%.4f', round(s.precision, 4))),
                (4, 'Recall (Sensitivity)', printf('%.4f', round(s.recall, 4)))) t(position, kpi, value)""")
oracle("report_campaign", ["roi"], """
SELECT position, kpi, value FROM roi,
LATERAL (VALUES (1, 'Target Segment Size', format('{:,}', n_predicted_churners)), (2, 'Mean CLV (Target)', '$' || format('{:,.0f}', round(mean_clv))),
                (3, 'Campaign Cost', '$' || format('{:,.0f}', round(campaign_cost))),
                (4, 'Net ROI', printf('$%.0fk', round(net_roi / 1000)))) t(position, kpi, value)""")
oracle("kv_threshold", ["sweep"], f"""
SELECT key, value FROM (SELECT * FROM sweep ORDER BY business_cost, threshold LIMIT 1) s,
LATERAL (VALUES ('optimal_threshold', printf('%.2f', round(threshold, 2))), ('business_cost', CAST(business_cost AS VARCHAR)),
                ('fn_cost_per_unit', '{C.fn_cost}'), ('fp_cost_per_unit', '{C.fp_cost}'), ('f1', printf('%.4f', round(s.f1, 4))),
                ('precision', printf('%.4f', round(s.precision, 4))), ('recall', printf('%.4f', round(s.recall, 4)))) t(key, value)""")
