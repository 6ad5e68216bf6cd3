"""Window labels from transaction truth, splits, coverage and true incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from surgelens.operators import sweep
from surgelens.operators.grid import ALL_SIZES, W, instant, minute, steps_of, window_spine
from surgelens.session import hold

NOT_EVALUATED = "NOT PRESENT — NOT EVALUATED"


def window_truth(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES) -> DataFrame:
    """Per scored window, empty ones included: totals, abusive and spike counts, dominant
    scenario (most attempts, then first seen)."""
    # the attempts are read once: minutes by scenario and truth, of which there are few, serve the windows, the sums and the scenarios
    ev = hold(events.groupBy("merchant_id", minute("timestamp").alias("m"), "scenario_id", "is_abusive", "is_spike")
              .agg(F.count(F.lit(1)).alias("c"), F.min(F.unix_micros("timestamp")).alias("us")))
    spine = window_spine(ev.select("merchant_id", instant("m").alias("timestamp")), sizes)
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("c")).otherwise(0))
    panes = ev.groupBy("merchant_id", "m").agg(F.sum("c").alias("n"), of("is_abusive").alias("abusive"), of("is_spike").alias("spike"))
    sums = sweep.sliding_sums(panes, ["merchant_id"], ["n", "abusive", "spike"], sizes, spine)
    by_scenario = ev.groupBy("merchant_id", "m", "scenario_id").agg(F.sum("c").alias("c"), F.min("us").alias("us"))
    ends = sweep.ends_of_all({s: (F.col("m") + 1, F.col("m") + n) for s, n in _steps(sizes).items()})
    # a handful of scenarios per minute, so minutes are spread over their windows here
    counts = (by_scenario.withColumn("_e", F.explode(ends))
              .groupBy("merchant_id", "_e.window_size", "_e.end_minute", "scenario_id")
              .agg(F.sum("c").alias("c"), F.min("us").alias("us")))
    top = (counts.groupBy(*W).agg(F.max_by("scenario_id", F.struct("c", -F.col("us"), "scenario_id")).alias("dominant")))
    return (sums.join(top, W, "left")
            .select("merchant_id", "window_size", instant("end_minute").alias("window_end"),
                    F.col("n").cast("long").alias("total_txns"), F.col("abusive").cast("long").alias("n_abusive"),
                    F.coalesce(F.try_divide("abusive", "n"), F.lit(0.0)).alias("abusive_share"),
                    F.col("spike").cast("long").alias("n_spike"),
                    F.coalesce(F.try_divide("spike", "n"), F.lit(0.0)).alias("spike_share"),
                    F.coalesce("dominant", F.lit("normal_day")).alias("dominant_scenario_id")))


def _steps(sizes: tuple[str, ...]) -> dict[str, int]:
    from surgelens.operators.grid import HORIZONS
    return {s: HORIZONS[s] for s in sizes}


def label_rule(k: F.Column | int, m: F.Column | float, rate: float = 0.001):
    """Abuse first, then spikes: card-free abuse is not a spike."""
    k = F.lit(k) if not hasattr(k, "alias") else k
    m = F.lit(m) if not hasattr(m, "alias") else m
    fraud = (F.col("n_abusive") >= k) & (F.col("abusive_share") >= F.greatest(m, F.lit(rate * 3.0)))
    legit = (F.col("n_spike") >= k) & (F.col("spike_share") >= m)
    return F.when(fraud, "FRAUD_SPIKE").when(legit, "LEGIT_SPIKE").otherwise("NORMAL")


def lift_labels(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, K: int = 5, M: float = 0.2,
                rate: float = 0.001) -> DataFrame:
    return window_truth(events, sizes).withColumn("label", label_rule(K, M, rate))


def label_sensitivity(events: DataFrame, k_grid=(3, 5, 10), m_grid=(0.1, 0.2, 0.4)) -> DataFrame:
    """Window counts per label over the (K, M) grid, 5-minute windows. Windows are
    aggregated once; the nine grid rows are a constant array."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("share")) for k in k_grid for m in m_grid])
    return (window_truth(events, ("5m",)).withColumn("_g", F.explode(grid))
            .select("*", "_g.k", "_g.share").withColumn("label", label_rule(F.col("k"), F.col("share")))
            .groupBy("k", "share", "label").agg(F.count(F.lit(1)).alias("windows")))


def split_bounds(start_us: int, end_us: int, train: float = 0.6, val: float = 0.2) -> tuple[int, int]:
    """Chronological bounds in epoch seconds: shares of the span in whole seconds."""
    seconds = (end_us - start_us) // 1000000
    t = start_us // 1000000 + int(seconds * train)
    return t, t + int(seconds * val)


def temporal_split(df: DataFrame, bound1: int, bound2: int, ts: str = "window_end") -> DataFrame:
    """Add ``split`` by epoch-second bounds; never random."""
    at = F.unix_micros(ts) / 1000000
    return df.withColumn("split", F.when(at < bound1, "train").when(at < bound2, "validation").otherwise("test"))


def coverage(labels: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per split: episodes by kind and scenario, windows by label and by dominant scenario."""
    ep = (episodes.withColumn("kind", F.when(F.col("is_attack"), "fraud_episode").otherwise("hard_negative_episode"))
          .rollup("split", "kind", "scenario_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
          .filter("_g in (0, 1)")
          .select("split", "kind", F.when(F.col("_g") == 1, "*").otherwise(F.col("scenario_id")).alias("item"), "n"))
    win = labels.groupBy("split", F.lit("windows_by_label").alias("kind"), F.col("label").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    sc = (labels.filter(F.col("dominant_scenario_id") != "normal_day")
          .groupBy("split", F.lit("windows_by_scenario").alias("kind"), F.col("dominant_scenario_id").alias("item"))
          .agg(F.count(F.lit(1)).alias("n")))
    return ep.unionByName(win).unionByName(sc)


def present_or_not(values: DataFrame, cover: DataFrame, value: str) -> DataFrame:
    """``value`` as text per (split, scenario_id), or the not-evaluated text when the
    scenario was not both injected and labelled in the split."""
    inj = cover.filter(F.col("kind").isin("fraud_episode", "hard_negative_episode") & (F.col("item") != "*")).select("split", F.col("item").alias("scenario_id")).distinct()
    lab = cover.filter(F.col("kind") == "windows_by_scenario").select("split", F.col("item").alias("scenario_id"))
    present = inj.join(lab, ["split", "scenario_id"]).withColumn("_p", F.lit(True))
    return (values.join(present, ["split", "scenario_id"], "left")
            .withColumn("reported", F.when(F.col("_p"), F.col(value).cast("string")).otherwise(NOT_EVALUATED)).drop("_p"))


def true_incidents(windows: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Runs of FRAUD_SPIKE windows per (merchant, scenario); a gap over ``gap_seconds``
    between ends starts a new incident. Needs gmv, label, dominant_scenario_id."""
    pos = windows.filter(F.col("label") == "FRAUD_SPIKE").withColumn("scenario_id", F.coalesce("dominant_scenario_id", F.lit("attack")))
    return runs(pos, ["merchant_id", "scenario_id"], gap_seconds).select(
        "merchant_id", "scenario_id", "start_time", "end_time", F.lit(True).alias("is_attack"), "total_gmv", "window_count")


def runs(windows: DataFrame, keys: list[str], gap_seconds: int, score: str | None = None) -> DataFrame:
    """Merge windows whose ends lie at most ``gap_seconds`` apart. The start is that of the
    first window (shortest first on equal ends).

    Windows of one end collapse first, so a run is found over at most one row per minute.
    """
    size = steps_of("window_size")
    ends = windows.groupBy(*keys, "window_end").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gmv").alias("gmv"), F.min(size).alias("steps"),
        *([F.max(score).alias("top")] if score else []))
    w = Window.partitionBy(*keys).orderBy("window_end")
    gap = F.unix_micros("window_end") - F.unix_micros(F.lag("window_end").over(w))
    numbered = ends.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds * 1000000), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    first_end = F.min("window_end")
    return (numbered.groupBy(*keys, "_run")
            .agg(F.timestamp_micros(F.unix_micros(first_end) - F.min_by("steps", "window_end") * 60000000).alias("start_time"),
                 F.max("window_end").alias("end_time"), F.sum("n").alias("window_count"), F.sum("gmv").alias("total_gmv"),
                 *([F.max("top").alias("max_risk_score")] if score else []))
            .drop("_run"))


def true_incident_spans(windows: DataFrame) -> DataFrame:
    """Simple form: one span per merchant over its FRAUD_SPIKE windows in row order
    (horizon from short to long, then end)."""
    order = F.struct(steps_of("window_size").alias("s"), F.unix_micros("window_end").alias("e"))
    pos = windows.filter(F.col("label") == "FRAUD_SPIKE")
    return (pos.groupBy("merchant_id")
            .agg(F.min_by("dominant_scenario_id", order).alias("scenario_id"),
                 F.timestamp_micros(F.min_by(F.unix_micros("window_end") - steps_of("window_size") * 60000000, order)).alias("start_time"),
                 F.max_by("window_end", order).alias("end_time"), F.sum("gmv").alias("total_gmv"))
            .withColumn("is_attack", F.lit(True)))
