import hashlib
import hmac
import statistics

import pytest
from pyspark.sql import functions as F

from surgelens import registry as R
from surgelens.functions import protect, ranking, stats
from surgelens.operators import baselines as B


def values(spark, vals, k="a"):
    return spark.createDataFrame([(k, float(v)) for v in vals], "k string, v double")


def test_gini_hand_cases(spark):
    g = lambda v: stats.gini(values(spark, v), ["k"], "v").first().gini
    assert abs(g([10, 10, 10, 10])) < 1e-12
    assert g([100, 0, 0, 0, 0]) > 0.7


def test_mad_is_robust(spark):
    base = [10 + (i % 3) * 0.5 for i in range(50)]
    a = stats.median_mad_large(values(spark, base), ["k"], "v").first()
    b = stats.median_mad_large(values(spark, base + [500, 600]), ["k"], "v").first()
    assert abs(a.expected_median - b.expected_median) < 0.5 and abs(a.variability_mad - b.variability_mad) < 1
    small = stats.median_mad(values(spark, base), ["k"], "v").first()
    assert abs(small.variability_mad - a.variability_mad) < 1e-12


@pytest.mark.parametrize("vals", [[3.0], [-5.5, 2.0, -5.5, 0.0], list(range(-20, 33)), [1e-9, 1e9, 7, 7, 7, 7]])
def test_exact_median_of_any_sign(spark, vals):
    assert ranking.exact_median(values(spark, vals), ["k"], "v").first().median == pytest.approx(statistics.median(vals))


def test_deviation_levels_and_guard(spark):
    long = spark.sql("select 'm' merchant_id, '5m' window_size, timestamp'2024-01-01 03:00:00' window_end, 'A.txn_rate' feature_id, 16D value "
                     "union all select 'n', '5m', timestamp'2024-01-01 03:00:00', 'A.txn_rate', 21D")
    own = spark.sql("select 'm' merchant_id, 'A.txn_rate' feature_id, '5m' window_size, 3 hour_of_week, 10D expected_median, 2D variability_mad, 30L sample_count, 'HIGH' confidence, timestamp'2023-12-31' fit_period_start, timestamp'2023-12-31' fit_period_end")
    peer = spark.sql("select 'retail' category, 'A.txn_rate' feature_id, '5m' window_size, 3 hour_of_week, 15D expected_median, 3D variability_mad")
    got = {r.merchant_id: r for r in B.deviation(long, own, peer).collect()}
    assert got["m"].deviation == 3.0 and got["m"].confidence == "HIGH"
    assert got["n"].deviation == 2.0 and got["n"].confidence == "LOW"
    late = own.withColumn("fit_period_end", F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    with pytest.raises(Exception, match="BaselineLeak"):
        B.deviation(long, late, peer).collect()
    assert B.deviation(long, late, peer, allow_in_sample=True).count() == 2


def test_registry_arithmetic():
    assert len(R.FEATURES) == 79 and len(R.TWIN_IDS) == 72
    names = R.FEATURE_IDS + [f + "_dev" for f in R.TWIN_IDS]
    model, evidence, _ = R.split_columns(names)
    assert len(model) == 128 and "A.hour_of_week_dev" not in model and "D.gmv" in evidence
    with pytest.raises(R.DownstreamLeak):
        R.assert_no_downstream(["A.txn_rate", "I.dispute_rate_dev"])
    assert not any(n.startswith("J.") for n in R.contextual_columns(model))
    assert R.prefix_columns(["J.cluster_count", "J.cluster_count_dev"], ("J.",), True) == ["J.cluster_count"]
    assert R.fusion_columns(["graph_x", "I.rto_mix"]) == ["graph_x"]


def test_tokens_equal_hmac(spark):
    got = spark.range(1).select(protect.instrument_token(F.lit("if_42"), "pep").alias("t"), protect.instrument_token(F.lit(""), "pep").alias("e")).first()
    key = hashlib.sha256(b"pep:global").digest()
    assert got.t == "ins_tok_" + hmac.new(key, b"if_42", hashlib.sha256).hexdigest()[:24] and got.e == ""


def test_redaction(spark):
    row = spark.range(1).select(protect.redact_map(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("note"), F.lit("card 4111 1111 1111 1111 ok"))).alias("m")).first().m
    assert row == {"api_key": "<redacted>", "note": "card <redacted-number> ok"}


def test_medians_of_a_large_group_meet_its_values_by_bucket(spark, monkeypatch):
    """No join by the group alone may take a group's values, which then lie in one task."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.pow(F.col("id") % 10_000, 1.5) - 3_000).alias("v"))
    plain, seen = type(df).join, []

    def join(self, other, on=None, how=None):
        if on == ["k"]:
            seen.append(self.count())
        return plain(self, other, on, how)

    monkeypatch.setattr(type(df), "join", join)
    got = stats.median_mad_large(df, ["k"], "v").first()
    monkeypatch.undo()
    v = sorted((i % 10_000) ** 1.5 - 3_000 for i in range(20_000))
    med = (v[9_999] + v[10_000]) / 2
    dev = sorted(abs(x - med) for x in v)
    assert abs(got.expected_median - med) < 1e-6 and abs(got.variability_mad - 1.4826 * (dev[9_999] + dev[10_000]) / 2) < 1e-6 and got.sample_count == 20_000
    assert seen and max(seen) < 3_000
