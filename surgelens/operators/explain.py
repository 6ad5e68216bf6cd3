"""Narratives, evidence cards and inspection views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from surgelens.operators.baselines import WINDOW
from surgelens.registry import FEATURES, TWIN_IDS


def top_deviations(deviations: DataFrame, k: int = 6) -> DataFrame:
    """Top k twins per window by absolute deviation rounded to two places; ties keep
    registry order. A window has at most 72 twins, so the ranking group is bounded."""
    position = F.lit(len(FEATURES))
    table = F.create_map(*[x for i, f in enumerate(TWIN_IDS) for x in (F.lit(f), F.lit(i))])
    position = F.try_element_at(table, F.col("feature_id"))
    # rounded through a decimal: halves go to even, as in the displayed values
    two = lambda c: F.bround(F.col(c).cast("decimal(38,10)"), 2).cast("double")
    w = Window.partitionBy(*WINDOW).orderBy(F.abs("deviation_mad").desc(), "_pos")
    return (deviations.withColumn("deviation_mad", two("deviation")).withColumn("raw_value", two("value"))
            .withColumn("direction", F.when(F.col("deviation") > 0, "HIGH").otherwise("LOW")).withColumn("_pos", position)
            .withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
            .select(*WINDOW, "position", "feature_id", "deviation_mad", "raw_value", "direction"))


def _pct(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100.0), F.lit("%"))


# Sentences of the explanation: (condition, text); {name} is filled from the window's values.
FINDINGS = [
    (lambda v: (v("J_largest_cluster_vol_share") > 0.40) | (v("J_bipartite_gini") > 0.50),
     "* Linked entities: one group of linked accounts and devices made {cluster} of the attempts (inequality of links {gini})."),
    (lambda v: v("C_failure_rate") > 0.40, "* Declines: {fail} of the attempts failed."),
    (lambda v: v("C_instrument_novelty") > 0.60, "* New instruments: {novelty} of the instruments had not been used here before."),
    (lambda v: v("C_coupon_rate") > 0.50, "* Coupons: {coupon} of the attempts carried one."),
]


def _filled(text: str, values: dict[str, Column]) -> Column:
    """A template as one concatenation."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def narrative(df: DataFrame) -> DataFrame:
    """An explanation per scored window, from templates. Needs feature columns, tier and exposure."""
    v = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    money = lambda c: F.concat(F.lit("₹"), F.format_number(c, 2))
    values = {"count": v("B_txn_count").cast("long").cast("string"), "gmv": money(v("D_gmv")), "size": F.col("window_size"),
              "rate": F.format_string("%+.1f", v("A_txn_rate_dev")), "cluster": _pct(v("J_largest_cluster_vol_share")), "gini": F.format_string("%.2f", v("J_bipartite_gini")),
              "fail": _pct(v("C_failure_rate"), 1), "novelty": _pct(v("C_instrument_novelty")), "coupon": _pct(v("C_coupon_rate")),
              "total": money(F.col("total_exposure")), "direct": money(F.col("direct_fraud_loss")), "handling": money(F.col("operational_loss")),
              "tier": F.col("action_tier"), "control": F.coalesce("recommended_control", F.lit("manual review")), "rationale": F.col("rationale")}
    head = _filled("{count} attempts worth {gmv} in {size}; their rate is {rate} deviations from this hour's usual.", values)
    points = F.array_compact(F.array(*[F.when(test(v), _filled(text, values)) for test, text in FINDINGS]))
    found = F.when(F.size(points) > 0, F.concat(F.lit("Findings:\n"), F.array_join(points, "\n"))).otherwise("Findings: volume alone stands out.")
    loss = _filled("Expected loss {total}: {direct} of the traffic itself and {handling} of handling.", values)
    act = F.when(F.col("action_tier").isin("RESTRICT", "REVIEW"), _filled("{tier}: {control}. {rationale}", values)).otherwise(_filled("{tier}: recorded, nothing to do.", values))
    return df.withColumn("explanation", F.concat_ws("\n\n", head, found, loss, act))


# Evidence rules (card, feature, lower bound, weight per unit, weight cap, tone).
EVIDENCE_RULES = [
    ("failure_rate", "C_failure_rate", 0.4, 100.0, None, "risk"),
    ("novelty", "C_instrument_novelty", 0.7, 80.0, None, "risk"),
    ("cluster", "J_largest_cluster_vol_share", 0.3, 110.0, None, "risk"),
    ("device_sharing", "F_accounts_per_device_max", 3.0, 8.0, 90.0, "risk"),
    ("cards_per_device", "F_instruments_per_device_max", 5.0, 6.0, 95.0, "risk"),
    ("micro_amounts", "D_low_value_ratio", 0.6, 60.0, None, "risk"),
    ("new_accounts", "G_new_account_rate", 0.7, 45.0, None, "risk"),
]


def evidence_cards(df: DataFrame, total: str = "B_txn_count") -> DataFrame:
    """Ranked evidence cards per window; features the frame lacks give no card."""
    cards = []
    card = lambda cond, i, ident, weight, tone: F.when(cond, F.struct(weight.cast("double").alias("weight"), F.lit(-i).alias("_o"), F.lit(ident).alias("card"), F.lit(tone).alias("tone")))
    for i, (ident, feature, bound, unit, top, tone) in enumerate(EVIDENCE_RULES):
        if feature in df.columns:
            weight = F.col(feature) * unit
            cards.append(card(F.col(feature) >= bound, i, ident, F.least(weight, F.lit(top)) if top else weight, tone))
    if "C_failure_rate" in df.columns:
        cards.append(card(F.col("C_failure_rate") <= 0.15, 20, "failure_rate_ok", F.lit(12.0), "benign"))
        if "I_decline_code_entropy" in df.columns:
            cards.append(card((F.col("C_failure_rate") > 0.3) & (F.col("I_decline_code_entropy") < 0.6), 21, "decline_concentration", F.lit(55.0), "risk"))
    if "A_txn_rate" in df.columns:
        cards.append(card(F.col("A_txn_rate") > 0, 22, "velocity", F.lit(20.0), "neutral"))
    found = F.array_compact(F.array(*cards))
    fallback = F.array(F.struct(F.lit(1.0).alias("weight"), F.lit(0).alias("_o"), F.lit("nothing_notable").alias("card"), F.lit("benign").alias("tone")))
    ranked = F.reverse(F.array_sort(F.when((F.size(found) == 0) & (F.col(total) > 0), fallback).otherwise(found)))
    return (df.select(*WINDOW, F.posexplode(ranked).alias("position", "_c"))
            .select(*WINDOW, (F.col("position") + 1).alias("position"), "_c.card", "_c.weight", "_c.tone"))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of a total order (a top-k, never a full sort)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def features_by_family(raw_long: DataFrame, deviations: DataFrame) -> DataFrame:
    """Feature rows with their family, flags and the deviation twin attached."""
    fam = F.substring("feature_id", 1, 1)
    flags = F.create_map(*[x for f in FEATURES.values() for x in (F.lit(f.id), F.struct(F.lit(f.model_input).alias("m"), F.lit(f.evidence_only).alias("e")))])
    dev = deviations.select(*WINDOW, "feature_id", F.col("deviation").alias("deviation_mad"))
    return (raw_long.join(dev, [*WINDOW, "feature_id"], "left")
            .select(*WINDOW, fam.alias("family"), "feature_id", "value", "deviation_mad",
                    flags[F.col("feature_id")]["m"].alias("is_model_input"), flags[F.col("feature_id")]["e"].alias("is_evidence_only")))


def window_summary(members: DataFrame, keys: list[str]) -> DataFrame:
    """Composition, time range and entity counts of each key's attempts."""
    distinct = {"customers": "customer_id", "devices": "device_fp", "instruments": "instrument_fp", "ips": "ip_fp"}
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_transactions"), F.count_if("is_abusive").alias("abusive_transactions"),
        F.count_if(~F.col("is_abusive")).alias("benign_transactions"), F.min("timestamp").alias("time_range_start"),
        F.max("timestamp").alias("time_range_end"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()])


def entity_ratios(summary: DataFrame) -> DataFrame:
    """Ratios of a summary, null on a zero denominator."""
    return summary.withColumn("instruments_per_customer", F.round(F.try_divide("instruments", "customers"), 4)).withColumn(
        "transactions_per_device", F.round(F.try_divide("total_transactions", "devices"), 4)).withColumn(
        "total_entities", F.col("customers") + F.col("devices") + F.col("instruments") + F.col("ips"))


def incident_list(incident_rows: DataFrame, merchant: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest incidents first, filtered by merchant and status."""
    out = incident_rows
    if merchant:
        out = out.filter(F.col("merchant_id") == merchant)
    if status:
        out = out.filter(F.col("status") == status)
    return out.orderBy(F.col("last_flag_time").desc(), "incident_id").limit(limit)


def incident_detail(incident_rows: DataFrame, merchants: list[str] | None = None) -> DataFrame:
    """What one incident's page shows. ``merchants`` are those the reader may see; other
    incidents are absent, as if they did not exist."""
    shown = incident_rows if merchants is None else incident_rows.filter(F.col("merchant_id").isin(merchants))
    return shown.select("incident_id", "merchant_id", F.get("window_sizes", F.lit(0)).alias("window_size"), F.col("last_flag_time").alias("window_end"),
                        "action_tier", "risk_score", "status", F.coalesce("analyst_notes", F.lit("")).alias("analyst_notes"))
