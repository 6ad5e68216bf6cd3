"""Scoring of closed windows in a stream: medians, concentration and components do not add up, so windows are scored
as a whole once the watermark has passed their end, and again when a late event falls into them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surgelens.operators.grid import ALL_SIZES, HORIZONS, minute
from surgelens.operators.sweep import ends_of_all
from surgelens.session import release
from surgelens.sources.tables import KeyedTable

WINDOW = ["merchant_id", "window_size", "end_minute"]


def windows_of(minutes: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """(merchant_id, window_size, end_minute): windows that hold any of the (merchant_id, m) minutes."""
    ends = ends_of_all({s: (F.col("m") + 1, F.col("m") + HORIZONS[s]) for s in sizes})
    return minutes.select("merchant_id", F.explode(ends).alias("_w")).select("merchant_id", "_w.window_size", "_w.end_minute").distinct()


class ClosedWindows:
    """Handler of ``foreachBatch``: logs a micro-batch, finds the closed windows it concerns, scores and merges them.

    A batch concerns the windows that close with it (their end lies between the watermarks before and after it) and the closed
    windows that its own events fall into, however late they are. ``score`` maps events to rows with (merchant_id, window_size,
    window_end); it is given all events of the hours that the windows touch, nothing older. The store is merged by
    window, so late and repeated deliveries overwrite. The log and the progress of a batch lie in its own folder, progress last: a
    batch that Spark hands over again is logged anew only if it has no progress yet, and its windows are merged again.
    Events that arrive twice count once (by ``ident``).
    """

    def __init__(self, spark: SparkSession, folder: str, score: Callable[[DataFrame], DataFrame], lateness_seconds: int = 300,
                 sizes: tuple[str, ...] = ALL_SIZES, ident: str = "transaction_id"):
        self.spark, self.folder, self.score, self.sizes, self.ident = spark, folder.rstrip("/"), score, sizes, ident
        self.lateness = lateness_seconds * 1_000_000
        self.store = KeyedTable(spark, f"{self.folder}/scores", ["merchant_id", "window_size", "window_end"], "window_date", F.to_date("window_end"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self._score(batch, batch_id)
        finally:
            release()  # what the score function held

    def _score(self, batch: DataFrame, batch_id: int) -> None:
        logged = f"{self.folder}/log/batch={batch_id}"
        if not self._progress(F.col("batch") == batch_id).limit(1).count():
            batch.write.mode("overwrite").parquet(logged)
        mine = self.spark.read.schema(batch.schema).parquet(logged)
        newest = mine.agg(F.max(F.unix_micros("timestamp")).alias("newest"), F.count(F.lit(1)).alias("events"))
        newest.write.mode("overwrite").parquet(f"{self.folder}/progress/batch={batch_id}")
        before, now = self._watermark(batch_id - 1), self._watermark(batch_id)
        if now is None:
            return
        windows = self._concerned(mine, before, now)
        span = windows.agg(F.min(F.col("end_minute") - self._longest()).alias("lo"), F.max("end_minute").alias("hi")).first()  # one row
        if span.lo is None:
            return
        touched = windows.select("merchant_id", F.explode(F.sequence(F.floor((F.col("end_minute") - self._longest()) / 60), F.floor((F.col("end_minute") - 1) / 60))).alias("_h")).distinct()
        events = self.log(span.lo, span.hi).withColumn("_h", F.floor(minute("timestamp") / 60)).join(touched, ["merchant_id", "_h"], "left_semi").drop("_h")
        asked = windows.select("merchant_id", "window_size", F.timestamp_micros(F.col("end_minute") * 60_000_000).alias("window_end"))
        self.store.merge(self.score(events).join(asked, ["merchant_id", "window_size", "window_end"], "left_semi"))

    def log(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Logged events, each once, of the minutes ``[lo, hi)``; the bounds reach the scan."""
        rows = self.spark.read.parquet(f"{self.folder}/log").drop("batch")
        if lo is not None:
            at = lambda m: F.timestamp_micros(F.lit(m * 60_000_000))
            rows = rows.filter((F.col("timestamp") >= at(lo)) & (F.col("timestamp") < at(hi)))
        return rows.dropDuplicates([self.ident])

    def scores(self) -> DataFrame:
        return self.store.read().drop("window_date")

    def _longest(self) -> int:
        return max(HORIZONS[s] for s in self.sizes)

    def _watermark(self, up_to: int) -> int | None:
        """The last closed minute after a batch: the newest event of all batches so far, less the lateness."""
        newest = self._progress(F.col("batch") <= up_to).agg(F.max("newest")).first()[0]
        return None if newest is None else (newest - self.lateness) // 60_000_000

    def _progress(self, wanted: Column) -> DataFrame:
        """(batch, newest, events) of the batches that are logged."""
        try:
            return self.spark.read.parquet(f"{self.folder}/progress").filter(wanted)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], "newest long, events long, batch long")

    def _concerned(self, mine: DataFrame, before: int | None, now: int) -> DataFrame:
        own = windows_of(mine.select("merchant_id", minute("timestamp").alias("m")).distinct(), self.sizes)
        out = own.filter(F.col("end_minute") <= now)
        if before is not None and before < now:
            waiting = self.log(before - self._longest(), now).select("merchant_id", minute("timestamp").alias("m")).distinct()
            closing = windows_of(waiting, self.sizes).filter((F.col("end_minute") > before) & (F.col("end_minute") <= now))
            out = out.unionByName(closing).distinct()
        return out


def start(events: DataFrame, handler: ClosedWindows, checkpoint: str):
    """Run the handler over what is available."""
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
