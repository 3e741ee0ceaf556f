"""One study: raw drops in, feature table, scores, segments and values out.

Steps hand over written tables. A step asked for twice in a session is read
back from its table instead of being computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import STAR_SCHEMA, StudyConfig
from ebbtide.operators import audit, logs, master, members, segments, transactions, value
from ebbtide.plans import rules
from ebbtide.session import stage
from ebbtide.sources import star_schema

_STUDIES: dict[tuple[str, str], Study] = {}


class Study:
    """Lazily built tables over one set of raw drops."""

    def __init__(
        self,
        transaction_drops: dict[str, DataFrame],
        log_drops: dict[str, DataFrame],
        labels: DataFrame,
        members_raw: DataFrame,
        config: StudyConfig = StudyConfig(),
        all_transactions: DataFrame | None = None,
        via_naming: str = "value",
    ):
        self.transaction_drops = transaction_drops
        self.log_drops = log_drops
        self.labels = labels
        self.members_raw = members_raw
        self.config = config
        self.via_naming = via_naming
        self._all_transactions = all_transactions
        self._tables: dict[str, DataFrame] = {}
        # models that the catalogue has fitted on this study, by effort
        self.fitted: dict[str, object] = {}

    def _written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = stage(build(), name)
        return self._tables[name]

    def transactions(self) -> DataFrame:
        if self._all_transactions is not None:
            return self._all_transactions
        out = None
        for drop in self.transaction_drops.values():
            out = drop if out is None else out.unionByName(drop)
        return out

    def _fit_members(self):
        """Row condition on the member table for statistics, NULL-free."""
        if self.config.fit_on == "all":
            return None
        return F.col("registration_init_time") < self.config.val_from

    def _fit_master(self):
        if self.config.fit_on == "all":
            return None
        return F.coalesce("registration_init_time", F.lit(0)) < self.config.val_from

    def transaction_features(self) -> DataFrame:
        def build() -> DataFrame:
            return transactions.transaction_features(self.transactions(), self.labels, self.config.feature_cutoff)

        return self._written("transaction-features", build)

    def log_features(self) -> DataFrame:
        c = self.config
        drops = self.log_drops.values()
        if c.log_cutoff is not None:
            drops = [d.filter(F.col("date") < c.log_cutoff) for d in drops]

        def build() -> DataFrame:
            return logs.log_features_twopass(drops, self.labels, c.log_snapshot, c.secs_above, c.secs_up_to)

        return self._written("log-features", build)

    def member_features(self) -> DataFrame:
        return members.member_features(
            self.members_raw, self.config.tenure_snapshot, naming=self.via_naming, fit_on=self._fit_members()
        )

    def master_raw(self) -> DataFrame:
        return self._written(
            "master-raw",
            lambda: master.master_features(
                self.labels, self.transaction_features(), self.log_features(), self.member_features()
            ),
        )

    def master(self) -> DataFrame:
        """Imputed master table with its cohort split."""

        def build() -> DataFrame:
            filled = master.impute(self.master_raw(), self.config.max_log_days, self._fit_master())
            return audit.temporal_split(filled, "registration_init_time", self.config.val_from, self.config.test_from)

        return self._written("master", build)

    def clustered(self) -> DataFrame:
        """Master rows with the nearest of the fixed rule centroids."""
        columns = segments.CLUSTER_FEATURES
        scaled = segments.standardize(self.master(), columns)
        assigned = segments.assign_centroid(scaled, [f"z_{c}" for c in columns], rules.CENTROIDS)
        return assigned.drop(*[f"z_{c}" for c in columns])

    def segmented(self) -> DataFrame:
        """Master rows with ``cluster`` and ``segment_label``."""

        def build() -> DataFrame:
            clustered = self._written("clustered", self.clustered)
            names = stage(segments.name_segments(segments.cluster_profile(clustered)), "segment-names")
            return clustered.join(names, "cluster", "left")

        return self._written("segmented", build)

    def rule_scores(self) -> DataFrame:
        """msno, is_churn, split and the main rule's churn_prob."""
        return self.master().select("msno", "is_churn", "split", rules.probability(rules.MAIN).alias("churn_prob"))

    def rule_models(self) -> DataFrame:
        """The same for every rule, one row per subscriber and rule, with a ``model`` column."""
        pairs = F.array(
            *[F.struct(F.lit(n).alias("model"), rules.probability(c).alias("churn_prob")) for n, c in rules.MODELS.items()]
        )
        return self.master().select("msno", "is_churn", "split", F.inline(pairs))

    def clv(self) -> DataFrame:
        m = self.master()
        return self._written("clv", lambda: value.clv_target(m, m, self.config.clv_cap_quantile))

    def rule_values(self) -> DataFrame:
        """Actual and rule-predicted value of every valued subscriber."""
        return self.clv().select(
            "msno", "split", F.col("clv").alias("actual_clv"), (F.col("clv") * rules.VALUE_FACTOR).alias("predicted_clv")
        )


def star_schema_study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over the generated tables of one scale factor, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study(
            star_schema.transaction_drops(spark, sf_dir),
            star_schema.log_drops(spark, sf_dir),
            star_schema.train_labels(spark, sf_dir),
            star_schema.members(spark, sf_dir),
            STAR_SCHEMA,
            all_transactions=star_schema.transactions(spark, sf_dir),
            via_naming="rank",
        )
    return _STUDIES[key]


def forget_studies() -> None:
    """Start the next study from the raw tables again (for timings)."""
    _STUDIES.clear()
