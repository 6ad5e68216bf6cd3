"""Sliding windows without exploding events.

An event lies in 81 windows, but what it contributes to is a step function of the window
end: a count rises when a minute enters the window and falls when it leaves. So every
sliding aggregate is built from *deltas* at the two ends and one running sum:

- ``count_deltas``    +c at ``m+1``, -c at ``m+steps+1``;
- ``presence_deltas`` the same for "at least once", with touching stretches merged;
- ``steps_from_deltas`` the running sum, as segments ``[end_minute, next_end)``;
- ``histogram_deltas`` from per-item values to "how many items have value v".

Rows per key never exceed the number of minutes, whatever the traffic of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from surgelens.operators.grid import HORIZONS, steps_of


def count_deltas(panes: DataFrame, keys: list[str], values: list[str],
                 sizes: tuple[str, ...], minute_col: str = "m") -> DataFrame:
    """(keys, m, values) -> (keys, window_size, end_minute, values) with signed values."""
    m = F.col(minute_col)
    ends = F.array(*[F.struct(F.lit(s).alias("window_size"), (m + off).alias("end_minute"), F.lit(sign).alias("_sign"))
                     for s in sizes for off, sign in ((1, 1), (HORIZONS[s] + 1, -1))])
    return (panes.withColumn("_d", F.explode(ends))
            .select(*keys, "_d.window_size", "_d.end_minute",
                    *[(F.col(v) * F.col("_d._sign")).alias(v) for v in values]))


def presence_deltas(occ: DataFrame, keys: list[str], sizes: tuple[str, ...], minute_col: str = "m") -> DataFrame:
    """Distinct (keys, m) -> +1/-1 rows where the key becomes present in, or leaves, the window."""
    w = Window.partitionBy(*keys).orderBy(minute_col)
    m = F.col(minute_col)
    edges = []
    for s in sizes:
        n = HORIZONS[s]
        starts = F.col("_prev").isNull() | (m - F.col("_prev") > n)
        stops = F.col("_next").isNull() | (F.col("_next") - m > n)
        edges.append(F.when(starts, F.struct(F.lit(s).alias("window_size"), (m + 1).alias("end_minute"), F.lit(1).alias("delta"))))
        edges.append(F.when(stops, F.struct(F.lit(s).alias("window_size"), (m + n + 1).alias("end_minute"), F.lit(-1).alias("delta"))))
    return (occ.withColumn("_prev", F.lag(minute_col).over(w)).withColumn("_next", F.lead(minute_col).over(w))
            .withColumn("_d", F.explode(F.array(*edges))).filter("_d is not null")
            .select(*keys, "_d.window_size", "_d.end_minute", "_d.delta"))


def steps_from_deltas(deltas: DataFrame, keys: list[str], delta: str, value: str,
                      combine: bool = True) -> DataFrame:
    """Running sum of deltas per (keys, window_size): columns value, previous, next_end.

    ``combine`` adds up equal ends before the shuffle; leave it out when the input is
    already partitioned by the keys.
    """
    at = [*keys, "window_size", "end_minute"]
    if combine:
        deltas = deltas.groupBy(*at).agg(F.sum(delta).alias(delta)).filter(F.col(delta) != 0)
    w = Window.partitionBy(*keys, "window_size").orderBy("end_minute")
    running = deltas.withColumn(value, F.sum(delta).over(w))  # range frame: equal ends together
    if not combine:
        running = (running.withColumn("_n", F.lead("end_minute").over(w))
                   .filter(F.col("_n").isNull() | (F.col("_n") != F.col("end_minute"))))
    return running.select(*at, value, F.coalesce(F.lag(value).over(w), F.lit(0)).cast("long").alias("previous"),
                          F.lead("end_minute").over(w).alias("next_end"))


def steps_from_panes(panes: DataFrame, keys: list[str], count: str, value: str, sizes: tuple[str, ...],
                     minute_col: str = "m") -> DataFrame:
    """Step functions of a per-minute count. Rows are shuffled by the keys before they are
    doubled into deltas, so the deltas never cross the network."""
    local = panes.repartition(*keys)
    return steps_from_deltas(count_deltas(local, keys, [count], sizes, minute_col), keys, count, value, combine=False)


def histogram_deltas(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per-item steps -> deltas of the number of items at each value (value 0 is absence)."""
    moved = F.array(F.struct(F.col(value).alias("y"), F.lit(1).alias("delta")),
                    F.struct(F.col("previous").alias("y"), F.lit(-1).alias("delta")))
    return (steps.filter(F.col(value) != F.col("previous")).withColumn("_h", F.explode(moved))
            .select(*keys, "window_size", "end_minute", "_h.y", "_h.delta").filter("y > 0"))


def expand_steps(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Segments with a positive value -> one row per window end they hold for."""
    return (steps.filter(F.col(value) > 0)
            .select(*keys, "window_size", value,
                    F.explode(F.sequence(F.col("end_minute"), F.col("next_end") - 1)).alias("end_minute")))


def live_ends(panes: DataFrame, keys: list[str], sizes: tuple[str, ...], minute_col: str = "m") -> DataFrame:
    """Ends of all non-empty windows, each made once by the latest occupied minute in it."""
    w = Window.partitionBy(*keys).orderBy(minute_col)
    m = F.col(minute_col)
    ends = ends_of_all({s: (m + 1, F.least(m + HORIZONS[s], F.coalesce(F.col("_next"), m + HORIZONS[s]))) for s in sizes})
    return (panes.select(*keys, minute_col).withColumn("_next", F.lead(minute_col).over(w))
            .withColumn("_e", F.explode(ends))
            .select(*keys, "_e.window_size", "_e.end_minute"))


def sliding_sums(panes: DataFrame, keys: list[str], values: list[str], sizes: tuple[str, ...],
                 spine: DataFrame | None = None, lagged: tuple[str, ...] = (),
                 extra: DataFrame | None = None) -> DataFrame:
    """Sliding sums of additive minute values at every end of ``spine`` (default: all
    non-empty windows). ``lagged`` values also come as ``prev_<v>``: the sum over the window
    of equal length just before. ``extra`` holds ready-made delta columns to add."""
    spine = spine if spine is not None else live_ends(panes, keys, sizes)
    parts = [count_deltas(panes, keys, values, sizes)]
    if lagged:
        late = count_deltas(panes, keys, list(lagged), sizes)
        parts.append(late.select(*keys, "window_size", (F.col("end_minute") + steps_of("window_size")).alias("end_minute"),
                                 *[F.col(v).alias(f"prev_{v}") for v in lagged]))
    if extra is not None:
        parts.append(extra)
    parts.append(spine.select(*keys, "window_size", "end_minute", F.lit(1).alias("_on")))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    at = [*keys, "window_size", "end_minute"]
    names = [c for c in merged.columns if c not in at and c != "_on"]
    w = (Window.partitionBy(*keys, "window_size").orderBy("end_minute")
         .rowsBetween(Window.unboundedPreceding, 0))
    summed = merged.groupBy(*at).agg(*[F.sum(n).alias(n) for n in names], F.max("_on").alias("_on"))
    return (summed.select(*at, "_on", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names])
            .filter("_on = 1").drop("_on"))


def ends_of_all(spans: dict[str, tuple[Column, Column]]) -> Column:
    """Array of (window_size, end_minute) structs: for each horizon the ends first..last
    (none when last < first)."""
    def tagged(size: str, first: Column, last: Column) -> Column:
        run = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda e: F.struct(F.lit(size).alias("window_size"), e.alias("end_minute")))
    runs = [tagged(s, first, last) for s, (first, last) in spans.items()]
    return F.concat(*runs) if len(runs) > 1 else runs[0]
