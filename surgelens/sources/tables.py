"""Stores as written Parquet tables: merges by key that touch only the partitions of their updates.

A store is partitioned by a column that follows from its key, so an update's row can only lie in its own partition. A merge reads
those partitions, joins on the key and overwrites them by dynamic partition overwrite: files are staged and
swapped at the job's commit, and a merge repeated after a failure gives the same rows. One writer at a time per store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surgelens.functions.protect import stable_hash
from surgelens.sources.stores import feature_rows, latest_per_key, upsert

#: partitions of a store whose key is a hash
BUCKETS = 16


class KeyedTable:
    """A table at ``path`` with unique ``keys``; ``part`` names the partition column, ``place`` computes it from the keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], part: str, place: Column, update_cols: list[str] | None = None):
        self.spark, self.path, self.keys, self.part, self.place, self.update_cols = spark, path, keys, part, place, update_cols

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.path)
            return True
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def merge(self, updates: DataFrame, order: str | None = None) -> None:
        """New keys are added; of known ones the update columns change (default: all). Where updates repeat a key,
        ``order`` names the column whose largest value wins. An update without rows changes nothing."""
        if order:
            updates = latest_per_key(updates, self.keys, order).select(*updates.columns)
        new = updates.withColumn(self.part, self.place)
        if self.exists():
            touched = [r[0] for r in new.select(self.part).distinct().collect()]  # dates, versions or buckets of one update
            if not touched:
                return
            old = self.read().select(*new.columns).filter(F.col(self.part).isin(touched))
            new = upsert(old, new, self.keys, self.update_cols and [*self.update_cols])
        # rows of a partition meet before the write, so files are few; large partitions are split by the adaptive plan
        new.hint("rebalance", self.part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)


def _date(ts: str) -> Column:
    return F.to_date(ts)


class FeatureStore(KeyedTable):
    """Feature and evidence maps per window, by the window's hash; partitioned by date."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["id", "merchant_id", "window_size", "window_end"], "window_date", _date("window_end"))

    def save(self, wide: DataFrame, feature_cols: list[str], evidence_cols: list[str]) -> None:
        self.merge(feature_rows(wide, feature_cols, evidence_cols))

    def get(self, merchant: str, size: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """A merchant's windows that end in ``[start, end]``, ascending; the dates prune the partitions."""
        out = self.read().filter(F.col("merchant_id") == merchant)
        out = out if size is None else out.filter(F.col("window_size") == size)
        for bound, inside in ((start, lambda t, d: (F.col("window_end") >= t) & (F.col("window_date") >= d)), (end, lambda t, d: (F.col("window_end") <= t) & (F.col("window_date") <= d))):
            if bound is not None:
                out = out.filter(inside(F.to_timestamp(F.lit(bound)), F.to_date(F.lit(bound))))
        return out.orderBy("window_end", "window_size")


class BaselineStore(KeyedTable):
    """Profiles by merchant, feature, horizon, hour of the week and version; partitioned by version."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["merchant_id", "feature_id", "window_size", "hour_of_week", "version"], "fit_version", F.col("version"))

    def save(self, merchant_b: DataFrame, version: int) -> None:
        self.merge(merchant_b.withColumn("version", F.lit(version).cast("int")))

    def get(self, merchant: str, feature: str, size: str, hour: int, version: int = 1) -> DataFrame:
        return self.list(merchant, version).filter((F.col("feature_id") == feature) & (F.col("window_size") == size) & (F.col("hour_of_week") == hour))

    def list(self, merchant: str, version: int = 1) -> DataFrame:
        return self.read().filter((F.col("fit_version") == version) & (F.col("merchant_id") == merchant)).drop("fit_version")


class IncidentStore(KeyedTable):
    """Incidents by id. A later score of the same window replaces all but the first flag time and the creation time."""

    KEPT = ("first_flag_time", "created_at")

    def __init__(self, spark: SparkSession, path: str, columns: list[str]):
        bucket = F.crc32(F.col("incident_id").cast("binary")) % BUCKETS
        super().__init__(spark, path, ["incident_id"], "bucket", bucket.cast("int"), [c for c in columns if c not in ("incident_id", "merchant_id", *self.KEPT)])

    def get(self, incident: str) -> DataFrame:
        return self.read().filter((F.col("incident_id") == incident) & (F.col("bucket") == F.crc32(F.lit(incident).cast("binary")) % BUCKETS)).drop("bucket")

    def list(self, merchant: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
        """Newest first, as the incident list of ``explain``; ``limit`` is the list's own length."""
        out = self.read().drop("bucket")
        for col, wanted in (("merchant_id", merchant), ("status", status)):
            out = out if wanted is None else out.filter(F.col(col) == wanted)
        return out.orderBy(F.desc("last_flag_time"), "incident_id").limit(limit)


class EvalStore(KeyedTable):
    """Predictions by run, detector and window; partitioned by run. Saving a run again replaces its rows."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["eval_id", "run_id"], "run", F.col("run_id"))

    def save(self, run_id: str, rows: DataFrame) -> None:
        named = rows.withColumn("run_id", F.lit(run_id))
        self.merge(named.withColumn("eval_id", stable_hash(F.concat_ws("|", "run_id", "detector_name", "merchant_id", "window_size", F.unix_micros("window_end")))))

    def list(self, run_id: str, split: str | None = None) -> DataFrame:
        out = self.read().filter(F.col("run") == run_id).drop("run")
        return (out if split is None else out.filter(F.col("split") == split)).orderBy("window_end", "merchant_id", "window_size", "detector_name")
