"""Time grid: 60-second scoring cadence and the four half-open horizons.

Operators work on the integer epoch minute. A window ending at minute ``e`` with ``steps``
minutes covers minutes ``e - steps .. e - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Horizon name -> length in grid steps of one minute.
HORIZONS = {"1m": 1, "5m": 5, "15m": 15, "1h": 60}
ALL_SIZES = tuple(HORIZONS)
GRID_US = 60_000_000

W = ["merchant_id", "window_size", "end_minute"]


def minute(ts: Column | str) -> Column:
    """Epoch minute of an instant (floor)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(GRID_US)).cast("long")


def instant(m: Column | str) -> Column:
    """Instant at the start of an epoch minute."""
    m = F.col(m) if isinstance(m, str) else m
    return F.timestamp_micros(m * F.lit(GRID_US))


def align(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts)


def is_aligned(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts == align(ts)


def steps_of(size: Column | str) -> Column:
    """Grid steps of a horizon name column."""
    size = F.col(size) if isinstance(size, str) else size
    out = None
    for name, n in HORIZONS.items():
        cond = size == name
        out = F.when(cond, n) if out is None else out.when(cond, n)
    return out.cast("long")


def window_start(end: Column, size: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(end) - steps_of(size) * GRID_US)


def contains(end: Column, size: Column, ts: Column) -> Column:
    """Half-open membership ``start <= ts < end``."""
    return (window_start(end, size) <= ts) & (ts < end)


def hour_of_week(ts: Column | str) -> Column:
    """0..167 with Monday 00:00 = 0."""
    return (F.weekday(ts) * 24 + F.hour(ts)).cast("int")


def horizon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s * 60, s) for n, s in HORIZONS.items()],
                                 "window_size string, seconds int, grid_steps int")


def assign_windows(df: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, ts: str = "timestamp") -> DataFrame:
    """One row per (event, horizon, covering window): 81 rows per event for all horizons.

    For inspection and joins that need the members of a window. Feature operators do not
    use it: they sweep pre-aggregated minutes instead.
    """
    from surgelens.operators.sweep import ends_of_all
    ends = ends_of_all({s: (minute(ts) + 1, minute(ts) + HORIZONS[s]) for s in sizes})
    return (df.withColumn("_w", F.explode(ends))
            .select("*", "_w.window_size", "_w.end_minute").drop("_w")
            .withColumn("window_end", instant("end_minute")))


def grid(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Grid instants in ``[start, end)`` for each row of ``spans``."""
    first = F.ceil(F.unix_micros(start) / GRID_US).cast("long")
    last = F.ceil(F.unix_micros(end) / GRID_US).cast("long") - 1
    return (spans.withColumn("_m", F.explode(F.when(last >= first, F.sequence(first, last))
                                             .otherwise(F.array().cast("array<bigint>"))))
            .withColumn("grid_at", instant("_m")).drop("_m"))


def tiles(windows: DataFrame, end: str = "window_end", size: str = "window_size") -> DataFrame:
    """The one-minute window ends that tile each window."""
    e = F.floor(F.unix_micros(end) / GRID_US).cast("long")
    return (windows.withColumn("_m", F.explode(F.sequence(e - steps_of(size) + 1, e)))
            .withColumn("tile_end", instant("_m")).drop("_m"))


def window_spine(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, ts: str = "timestamp") -> DataFrame:
    """Scored window ends per merchant and horizon, empty windows included: from the first
    full window after the merchant's first event to the minute after its last one."""
    span = events.groupBy("merchant_id").agg(F.min(minute(ts)).alias("lo"), F.max(minute(ts)).alias("hi"))
    horizons = F.array(*[F.struct(F.lit(s).alias("window_size"), F.lit(HORIZONS[s]).cast("long").alias("steps"))
                         for s in sizes])
    return (span.withColumn("_h", F.explode(horizons)).select("merchant_id", "lo", "hi", "_h.*")
            .filter(F.col("lo") + F.col("steps") <= F.col("hi") + 1)
            .select("merchant_id", "window_size",
                    F.explode(F.sequence(F.col("lo") + F.col("steps"), F.col("hi") + 1)).alias("end_minute")))


def window_members(windows: DataFrame, events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events of each given window. Both sides meet on (merchant, minute), an equi-join."""
    tiled = windows.withColumn("_m", F.explode(F.sequence(
        F.col("end_minute") - steps_of("window_size"), F.col("end_minute") - 1)))
    return tiled.join(events.withColumn("_m", minute(ts)), ["merchant_id", "_m"]).drop("_m")
