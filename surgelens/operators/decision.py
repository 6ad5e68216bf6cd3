"""Scores, thresholds, tiers, exposure and incident rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Default policy thresholds and economic assumptions.
DEFAULT_THRESHOLDS = (0.35, 0.60, 0.85)
CHARGEBACK_FEE, FULFILMENT_COST, SUPPORT_COST = "1500.00", "120.00", "50.00"
DEFAULT_LOSS, REVIEW_COST = 5000.0, 250.0

# Recommended control and rationale by dominant scenario in the top tier.
CONTROLS = [
    ("card_testing_burst", "RECOMMEND_INSTRUMENT_VELOCITY_CAP",
     "Extreme instrument novelty and issuer declines detected. Recommend applying a 5-attempt/minute cap per IP."),
    ("promo_coupon_harvesting", "RECOMMEND_SUSPEND_PROMO_COUPON",
     "Rapid redemption across new synthetic accounts. Recommend pausing coupon code."),
    ("device_farm_ring", "RECOMMEND_DEVICE_CHALLENGE",
     "High account concentration on small device cluster. Recommend step-up biometric/2FA."),
]
OTHER_CONTROL = ("RECOMMEND_STEP_UP_AUTHENTICATION", "High confidence fraud spike. Recommend step-up verification.")
RATIONALES = {
    "REVIEW": "Elevated risk score exceeding review threshold. Incident queued for analyst review.",
    "ALERT": "Moderate traffic anomaly detected. Notification sent to merchant dashboard.",
    "OBSERVE": "Traffic pattern within expected baseline tolerances.",
}


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-0.5 * (x - 3.0)))


def heuristic_score(rate_dev: Column, cluster_share: Column) -> Column:
    """Serving score without a model: a logistic in base 2.718 plus 0.4 of the cluster share."""
    base = F.when(rate_dev > 0, 1.0 / (1.0 + F.pow(F.lit(2.718), -0.5 * (rate_dev - 3.0)))).otherwise(0.05)
    return F.least(F.lit(1.0), base + cluster_share * 0.4)


def threshold_grid() -> list[float]:
    """81 points of the linear grid 0.10 .. 0.90."""
    step = (0.90 - 0.10) / 80
    return [0.10 + i * step for i in range(80)] + [0.90]


def sweep_thresholds(scores: DataFrame, y: str = "y_true", p: str = "y_prob", loss: str | None = None,
                     fp_cost: float = REVIEW_COST, keys: list[str] = ()) -> DataFrame:
    """Cost of every grid threshold from one pass over the scores, for each value of ``keys``.

    A score is reduced to the number of grid points it reaches, summed per such bucket (at
    most 82 rows), and accumulated; the scores are never multiplied by the grid.
    """
    points = threshold_grid()
    grid = F.array(*[F.lit(t) for t in points])
    reached = F.lit(0)
    guess = F.floor((F.col(p) - 0.10) / 0.01).cast("int")  # within one of the true bucket
    at = lambda i: F.try_element_at(grid, i + 1)
    for off in (1, 0, -1):
        i = F.least(F.lit(80), F.greatest(F.lit(0), guess + off))
        reached = F.greatest(reached, F.when(F.col(p) >= at(i), i + 1).otherwise(0))
    lost = F.col(loss) if loss else F.lit(DEFAULT_LOSS)
    buckets = (scores.withColumn("_b", reached).groupBy(*keys, "_b")
               .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 0).alias("neg"),
                    F.sum(F.when(F.col(y) == 1, lost).otherwise(0.0)).alias("loss")))
    table = scores.sparkSession.createDataFrame(list(enumerate(points)), "i int, threshold double")
    # 81 grid rows x at most 82 buckets
    joined = F.broadcast(table).crossJoin(buckets)
    flagged = F.col("_b") > F.col("i")
    return (joined.groupBy(*keys, "i", "threshold")
            .agg(F.sum("n").alias("n"), F.sum(F.when(flagged, F.col("n")).otherwise(0)).alias("flagged"),
                 F.sum(F.when(flagged, F.col("neg")).otherwise(0)).alias("fp"),
                 F.sum(F.when(flagged, 0.0).otherwise(F.col("loss"))).alias("fn_loss"))
            .select(*keys, "i", "threshold", (F.col("flagged") / F.col("n")).alias("review_rate"),
                    (F.col("fn_loss") + F.col("fp") * fp_cost).alias("total_cost")))


def choose_thresholds(scores: DataFrame, cap: float = 0.15, fp_cost: float = REVIEW_COST, y: str = "y_true",
                      p: str = "y_prob", loss: str | None = None, ordered: bool = False, keys: list[str] = ()) -> DataFrame:
    """One row (or one per value of ``keys``, each with a score): alert, review and restrict thresholds of least cost within the review cap.

    The first minimum wins. With no feasible point review is 0.50 and the loss infinite.
    The alert threshold may exceed the review one; ``ordered`` sorts the three.
    """
    feasible = F.when(F.col("review_rate") <= cap, F.struct("total_cost", "i", "threshold", "review_rate"))
    best = sweep_thresholds(scores, y, p, loss, fp_cost, keys).groupBy(*keys).agg(F.min(feasible).alias("b"))
    review = F.coalesce(F.col("b.threshold"), F.lit(0.50))
    out = best.select(*keys, F.greatest(F.lit(0.15), review - 0.20).alias("theta_alert"), review.alias("theta_review"),
                      F.least(F.lit(0.95), review + 0.20).alias("theta_restrict"),
                      F.coalesce(F.col("b.total_cost"), F.lit(float("inf"))).alias("expected_loss"),
                      F.coalesce(F.col("b.review_rate"), F.lit(0.0)).alias("review_rate"))
    if ordered:
        three = F.array_sort(F.array("theta_alert", "theta_review", "theta_restrict"))
        out = out.select(*keys, three[0].alias("theta_alert"), three[1].alias("theta_review"), three[2].alias("theta_restrict"),
                         "expected_loss", "review_rate")
    return out


def assign_tier(df: DataFrame, score: str = "risk_score", thresholds: tuple[float, float, float] = DEFAULT_THRESHOLDS,
                scenario: str | None = None) -> DataFrame:
    """Add action_tier, recommended_control and rationale."""
    alert, review, restrict = thresholds
    s = F.col(score)
    tier = F.when(s >= restrict, "RESTRICT").when(s >= review, "REVIEW").when(s >= alert, "ALERT").otherwise("OBSERVE")
    sc = F.col(scenario) if scenario else F.lit(None).cast("string")
    control, why = F.lit(OTHER_CONTROL[0]), F.lit(OTHER_CONTROL[1])
    for name, ctl, text in CONTROLS:
        control = F.when(sc == name, ctl).otherwise(control)
        why = F.when(sc == name, text).otherwise(why)
    rationale = F.when(F.col("action_tier") == "RESTRICT", why)
    for name, text in RATIONALES.items():
        rationale = rationale.when(F.col("action_tier") == name, text)
    return (df.withColumn("action_tier", tier)
            .withColumn("recommended_control", F.when(F.col("action_tier") == "RESTRICT", control))
            .withColumn("rationale", rationale))


def exposure(df: DataFrame, gmv: str = "gmv", n: str = "n_txns", p_loss: Column | str | None = None,
             promo: str | None = None) -> DataFrame:
    """Money at risk, half-even to two places."""
    p = (F.when(F.col("action_tier").isin("REVIEW", "RESTRICT"), F.lit("0.85")).otherwise(F.lit("0.20"))
         if p_loss is None else (F.col(p_loss) if isinstance(p_loss, str) else p_loss)).cast("decimal(6,4)")
    money = F.col(gmv).cast("decimal(20,4)")
    per_txn = sum(map(float, (CHARGEBACK_FEE, FULFILMENT_COST, SUPPORT_COST)))
    direct = (money * p).cast("decimal(30,8)")
    operational = (F.col(n).cast("decimal(18,0)") * F.lit(f"{per_txn:.2f}").cast("decimal(10,2)")).cast("decimal(30,8)")
    extra = (F.col(promo) if promo else F.lit(0)).cast("decimal(30,8)")
    two = lambda c: F.bround(c, 2).cast("decimal(20,2)")
    return (df.withColumn("p_loss", p.cast("double")).withColumn("direct_fraud_loss", two(direct))
            .withColumn("operational_loss", two(operational)).withColumn("promo_exposure", two(extra))
            .withColumn("total_exposure", two(direct + operational + extra)))


def incident_id(merchant: Column, kind: Column, end: Column) -> Column:
    """Stable id of a merchant's window."""
    at = F.date_format(end, "yyyy-MM-dd HH:mm:ssxxx")
    return F.concat(F.lit("inc_"), F.substring(F.sha2(F.concat_ws("|", merchant, kind, at), 256), 1, 26))


def incidents(scored: DataFrame) -> DataFrame:
    """Incident rows for windows in the two upper tiers. Horizons of one end share an id;
    the longest horizon wins, as the last one scored."""
    from surgelens.operators.grid import steps_of, window_start
    hot = scored.filter(F.col("action_tier").isin("REVIEW", "RESTRICT"))
    rows = hot.select(
        incident_id(F.col("merchant_id"), F.lit("spike"), F.col("window_end")).alias("incident_id"), "merchant_id",
        F.when(F.col("action_tier") == "RESTRICT", "high").otherwise("medium").alias("severity"),
        F.lit("OPEN").alias("status"), "action_tier",
        window_start(F.col("window_end"), F.col("window_size")).alias("first_flag_time"),
        F.col("window_end").alias("last_flag_time"), F.array("window_size").alias("window_sizes"), "risk_score",
        F.col("total_exposure").alias("exposure_amount"), steps_of("window_size").alias("_s"))
    w = Window.partitionBy("incident_id").orderBy(F.col("_s").desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_s")


def apply_actions(incident_rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest analyst action (incident_id, action, notes, acted_at) -> status and notes."""
    last = actions.groupBy("incident_id").agg(F.max_by(F.struct("action", "notes"), "acted_at").alias("_a"))
    status = (F.when(F.col("_a.action") == "ACKNOWLEDGE", "ACKNOWLEDGED").when(F.col("_a.action") == "APPLY_DEFENSE", "CONFIRMED")
              .when(F.col("_a.action") == "DISMISS", "DISMISSED").when(F.col("_a.action") == "RESOLVE", "CLOSED").otherwise(F.col("status")))
    notes = F.when(F.coalesce(F.col("_a.notes"), F.lit("")) == "", F.concat(F.lit("Applied action "), F.col("_a.action"))).otherwise(F.col("_a.notes"))
    return (incident_rows.join(last, "incident_id", "left").withColumn("status", status)
            .withColumn("analyst_notes", F.when(F.col("_a").isNotNull(), notes)).drop("_a"))
