"""Figures at stage borders, taken in the job that writes the stage: rows, nulls, and counts of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from surgelens.session import shared_path
from surgelens.sources import intake


class StageFigures:
    """Watches stages of a dataflow. A stage ends in a written table, so its figures cover all rows exactly once and no
    extra pass is made for them."""

    def __init__(self, spark: SparkSession):
        self.spark, self._seen = spark, {}

    def written(self, df: DataFrame, stage: str, nulls: list[str] = (), path: str | None = None, **counts: Column) -> DataFrame:
        """Write ``df`` as the stage's table and return it: counts rows, nulls of the named columns and rows of the named conditions."""
        seen = Observation(stage)
        what = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls], *[F.count_if(cond).alias(name) for name, cond in counts.items()]]
        path = path or shared_path(self.spark, f"stage-{stage}")
        df.observe(seen, *what).write.mode("overwrite").parquet(path)
        self._seen[stage] = seen
        return self.spark.read.parquet(path)

    def table(self) -> DataFrame:
        """(stage, figure, value) of the stages so far."""
        rows = [(stage, name, value) for stage, seen in self._seen.items() for name, value in seen.get.items()]
        return self.spark.createDataFrame(rows, "stage string, figure string, value long")


def watched_intake(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw log rows, figures): checks, claims and the log's form, each stage written and watched."""
    stages = StageFigures(events.sparkSession)
    checked = stages.written(intake.check_events(events), "checked", ["merchant_id"], rejected=F.size("reasons") > 0)
    claimed = stages.written(intake.dedupe(checked.filter(F.size("reasons") == 0).drop("reasons")), "claimed", duplicates=F.col("status") == "duplicate")
    raw = stages.written(intake.to_raw_rows(claimed.filter("status = 'accepted'")), "logged", ["transaction_id"])
    return raw, stages.table()
