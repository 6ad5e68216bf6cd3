"""Feature registry: ids, families and flags, plus the column-selection rules built on it.

Wide DataFrames name a feature ``A_txn_rate``; long ones carry the id ``A.txn_rate``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The registered features, by family, in registry order.
FAMILY_FEATURES = {
    "A": ["txn_rate", "rate_accel", "burst_duration", "interarrival_mean", "interarrival_cv",
          "interarrival_p05", "periodicity_score", "hour_of_week_dev"],
    "B": ["txn_count", "success_count", "failure_count", "unique_customers",
          "unique_instruments", "unique_devices", "unique_ips"],
    "C": ["failure_rate", "devices_per_txn", "accounts_per_txn", "instruments_per_txn",
          "ips_per_txn", "instrument_novelty", "account_novelty", "device_novelty",
          "coupon_rate", "cod_rate", "international_rate", "retry_rate"],
    "D": ["gmv", "amount_median", "amount_cv", "amount_entropy", "low_value_ratio",
          "high_value_ratio", "discount_to_gmv"],
    "E": ["country_entropy", "state_entropy", "geo_mix_jsd", "new_country_count", "geo_gini",
          "geo_transition_rate"],
    "F": ["accounts_per_device_max", "accounts_per_device_mean", "accounts_per_device_gini",
          "txn_per_device_max", "instruments_per_device_max", "device_reuse_rate"],
    "G": ["account_age_median", "account_age_p10", "new_account_rate", "txn_per_account_max",
          "accounts_per_address_max", "account_cohort_concentration"],
    "H": ["method_entropy", "method_mix_jsd", "card_share", "issuer_country_entropy",
          "bin_prefix_gini", "instrument_repeat_rate"],
    "I": ["decline_code_entropy", "decline_code_top_share", "decline_issuer_share",
          "refund_rate", "refund_latency_median", "refund_cohort_concentration",
          "dispute_rate", "rto_rate", "chargeback_rate"],
    "J": ["devices_per_account_max", "accounts_per_ip_max", "bipartite_gini", "cluster_count",
          "largest_cluster_size", "largest_cluster_vol_share", "cluster_density",
          "cluster_density_z", "entity_novelty_share", "cross_merchant_entities",
          "cross_merchant_fanout_max", "shared_address_clusters"],
}

# Features without a deviation twin, evidence-only and label-only features.
NO_TWIN = {"A.burst_duration", "A.interarrival_p05", "A.periodicity_score",
           "A.hour_of_week_dev", "E.geo_mix_jsd", "H.method_mix_jsd", "J.cluster_density_z"}
EVIDENCE_ONLY = {"B.success_count", "B.failure_count", "B.unique_customers",
                 "B.unique_instruments", "B.unique_devices", "B.unique_ips", "D.gmv",
                 "J.cluster_density"}
DOWNSTREAM_ONLY = {"I.dispute_rate", "I.rto_rate", "I.chargeback_rate"}

# Engineered names starting like this never enter a model.
BARRED_PREFIXES = ("I.dispute", "I.chargeback", "I.rto")
# Names that can be a model input at all: a registered family's, or the graph's.
ENGINEERED = re.compile(r"[A-J]\.[a-z]|graph_")
FEATURE_COLUMN = re.compile(r"[A-J]_[a-z]|graph_")
# Columns of labels and truth, which no model may see under any name.
LABEL_COLUMNS = {"y_true", "label", "scenario_id", "dominant_scenario_id", "is_abusive", "is_spike",
                 "n_abusive", "abusive_share", "n_spike", "spike_share"}


@dataclass(frozen=True)
class Feature:
    id: str
    family: str
    twin: bool
    evidence_only: bool
    downstream_only: bool

    @property
    def model_input(self) -> bool:
        return not (self.evidence_only or self.downstream_only)


FEATURES: dict[str, Feature] = {
    fid: Feature(fid, fam, fid not in NO_TWIN, fid in EVIDENCE_ONLY, fid in DOWNSTREAM_ONLY)
    for fam, names in FAMILY_FEATURES.items()
    for fid in (f"{fam}.{n}" for n in names)
}
FEATURE_IDS = list(FEATURES)
TWIN_IDS = [f.id for f in FEATURES.values() if f.twin]


class DownstreamLeak(AssertionError):
    """A label-only signal reached a model input."""


def col_of(feature_id: str) -> str:
    """Column name of a feature id in wide form."""
    return feature_id.replace(".", "_", 1)


def id_of(column: str) -> str:
    """Feature id of a wide column (``A_txn_rate_dev`` -> ``A.txn_rate_dev``)."""
    return column.replace("_", ".", 1) if len(column) > 2 and column[1] == "_" else column


def feature_table(spark: SparkSession) -> DataFrame:
    """The registry as a table of 79 rows (a fixed size, safe to broadcast)."""
    rows = [(f.id, f.family, f.twin, f.evidence_only, f.downstream_only, f.model_input,
             col_of(f.id), i) for i, f in enumerate(FEATURES.values())]
    return spark.createDataFrame(
        rows, "feature_id string, family string, deviation_twin boolean, evidence_only boolean, "
              "downstream_only boolean, model_input boolean, column_name string, position int")


def _base(name: str) -> str:
    return name[:-4] if name.endswith("_dev") else name


def split_columns(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Split feature ids into (model, evidence, dropped) by registry flags.

    The ``_dev`` suffix is stripped before the lookup, so the raw ``A.hour_of_week_dev``
    resolves to no feature and is dropped.
    """
    model, evidence, dropped = [], [], []
    for name in names:
        spec = FEATURES.get(_base(name))
        if spec is None or spec.downstream_only:
            dropped.append(name)
        elif spec.evidence_only:
            evidence.append(name)
        else:
            model.append(name)
    return model, evidence, dropped


def assert_no_downstream(names: list[str]) -> list[str]:
    """Raise when a label-only feature or its twin is among ``names``."""
    if isinstance(names, str):
        raise TypeError("expected a list of feature ids")
    names = list(names)
    leaked = sorted(n for n in names if n in DOWNSTREAM_ONLY or _base(n) in DOWNSTREAM_ONLY or n.replace(".", "_") in LABEL_COLUMNS)
    if leaked:
        raise DownstreamLeak(f"label-only signals in a model input: {leaked}")
    return names


def _learnable(name: str) -> bool:
    spec = FEATURES.get(_base(name))
    if spec is not None:
        return spec.model_input
    return bool(ENGINEERED.match(name)) and not name.startswith(BARRED_PREFIXES)


def fusion_columns(names: list[str]) -> list[str]:
    """All model inputs; engineered names of the registered families stay unless barred."""
    return assert_no_downstream([n for n in names if _learnable(n)])


def contextual_columns(names: list[str]) -> list[str]:
    """Model inputs without the relationship family."""
    return assert_no_downstream(
        [n for n in names if not n.startswith(("J.", "graph_")) and _learnable(n)])


def prefix_columns(names: list[str], prefixes: tuple[str, ...], exclude_dev: bool = False) -> list[str]:
    """Allow-list by prefix, for ablation arms."""
    return assert_no_downstream(
        [n for n in names if n.startswith(prefixes) and not (exclude_dev and n.endswith("_dev"))])
