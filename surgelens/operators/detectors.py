"""Detectors on Spark ML: volume only, contextual and fusion, and ablation arms."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surgelens.operators.decision import logistic
from surgelens.registry import FEATURE_COLUMN, assert_no_downstream, col_of, contextual_columns, fusion_columns, id_of, prefix_columns, split_columns

SEED = 42


class Detector:
    """Fits on a wide frame with a 0/1 ``y_true`` column; adds ``risk_score`` in [0, 1]."""

    def __init__(self, name: str, select: Callable[[list[str]], list[str]], learner: Callable[[int], object],
                 unfitted: Callable[[DataFrame], Column] = lambda df: F.lit(0.0)):
        self.name, self._select, self._learner, self._unfitted = name, select, learner, unfitted
        self.columns: list[str] = []
        self.model: PipelineModel | None = None

    def fit(self, df: DataFrame) -> "Detector":
        ids = sorted(id_of(c) for c in df.columns if FEATURE_COLUMN.match(c))
        self.columns = [col_of(i) for i in assert_no_downstream(self._select(ids))]
        n = df.count()
        stages = [VectorAssembler(inputCols=self.columns, outputCol="_x", handleInvalid="keep"), self._learner(n)]
        self.model = _without_summaries(Pipeline(stages=stages).fit(df.fillna(0.0, self.columns)), df.sparkSession)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("risk_score", self._unfitted(df))
        out = self.model.transform(df.fillna(0.0, self.columns))
        return out.withColumn("risk_score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def _without_summaries(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """A regression keeps the summary of its fit and with it the session, which no task can carry once the session has observed a query."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return model


def side_by_side(spark: SparkSession, fits: list[Callable[[], object]]) -> list:
    """What each fit returns, all run at once: boosting rounds are many small jobs, which leave a cluster idle one after the other."""
    with ThreadPool(max(1, len(fits))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits, chunksize=1)


def predict(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted", (F.col("risk_score") >= threshold).cast("int"))


def _boosting(rounds: int, step: float, seed: int = SEED, share: float = 1.0) -> Callable[[int], GBTClassifier]:
    # leaves hold at least max(1, min(10, n/4)) rows; trees of depth 5 keep the model small
    return lambda n: GBTClassifier(labelCol="y_true", featuresCol="_x", maxIter=rounds, stepSize=step, maxDepth=5,
                                   minInstancesPerNode=max(1, min(10, n // 4)), seed=seed, subsamplingRate=share)


def volume_only() -> Detector:
    pick = lambda ids: [next((i for i in ("A.txn_rate_dev", "B.txn_count_dev") if i in ids), ids[0])]
    rate = lambda df: logistic(F.coalesce(F.col("A_txn_rate_dev" if "A_txn_rate_dev" in df.columns else "A_txn_rate").cast("double"), F.lit(0.0)))
    return Detector("volume_only", pick, lambda n: LogisticRegression(labelCol="y_true", featuresCol="_x", regParam=1.0 / max(1, n), standardization=False), rate)


def contextual(rounds: int = 100, **sampling) -> Detector:
    return Detector("contextual_ml", contextual_columns, _boosting(rounds, 0.1, **sampling))


def fusion(rounds: int = 150, **sampling) -> Detector:
    return Detector("fusion", fusion_columns, _boosting(rounds, 0.08, **sampling))


def graph_only(rounds: int = 100, **sampling) -> Detector:
    return Detector("ablation_graph_only", lambda ids: prefix_columns(split_columns(ids)[0], ("J.",)), _boosting(rounds, 0.1, **sampling))


def contextual_without_twins(rounds: int = 100, **sampling) -> Detector:
    families = tuple(f"{x}." for x in "ABCDEFGHI")
    return Detector("ablation_contextual_no_dev", lambda ids: prefix_columns(split_columns(ids)[0], families, exclude_dev=True), _boosting(rounds, 0.1, **sampling))


def arms(rounds: int | None, seed: int, share: float = 0.8) -> list[Detector]:
    """The three detectors and the two ablation arms of one run, with the rounds of each detector unless ``rounds`` are given;
    each tree of a run sees a seeded share of the rows."""
    given = {"seed": seed, "share": share} | ({} if rounds is None else {"rounds": rounds})
    return [volume_only(), contextual(**given), fusion(**given), graph_only(**given), contextual_without_twins(**given)]
