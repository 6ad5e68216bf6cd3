"""The detectors as Spark ML stages: an estimator with params, a model with columns, both written and loaded."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from surgelens.operators import detectors as D

MAKERS = {"volume_only": D.volume_only, "contextual_ml": D.contextual, "fusion": D.fusion, "ablation_graph_only": D.graph_only, "ablation_contextual_no_dev": D.contextual_without_twins}


class _DetectorParams(Params):
    kind = Param(Params._dummy(), "kind", "which detector", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds; 0: the detector's own", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the trees' row samples", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of the rows that a tree sees", TypeConverters.toFloat)

    def detector(self) -> D.Detector:
        """The unfitted detector that the params describe."""
        kind = self.getOrDefault(self.kind)
        if kind == "volume_only":
            return MAKERS[kind]()
        rounds = self.getOrDefault(self.rounds)
        return MAKERS[kind](*([rounds] if rounds else []), seed=self.getOrDefault(self.seed), share=self.getOrDefault(self.share))


class DetectorEstimator(Estimator, _DetectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a detector on a wide frame with ``y_true``; columns are chosen from the registry, behind the label barrier."""

    @keyword_only
    def __init__(self, *, kind: str = "fusion", rounds: int = 0, seed: int = D.SEED, share: float = 1.0):
        super().__init__()
        self._setDefault(kind="fusion", rounds=0, seed=D.SEED, share=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "DetectorModel":
        fitted = self.detector().fit(dataset)
        return self._copyValues(DetectorModel(fitted.columns, fitted.model).setParent(self))


class DetectorModel(Model, _DetectorParams, MLReadable, MLWritable):
    """Adds ``risk_score``; the inner pipeline and the chosen columns travel with it."""

    def __init__(self, columns: list[str] | None = None, inner: PipelineModel | None = None):
        super().__init__()
        self._setDefault(kind="fusion", rounds=0, seed=D.SEED, share=1.0)
        self.columns, self.inner = columns or [], inner

    def setParent(self, parent: Estimator) -> "DetectorModel":
        self._resetUid(parent.uid)
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = self.detector()
        fitted.columns, fitted.model = self.columns, self.inner
        return fitted.score(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: DetectorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"columns": self.instance.columns})
        self.instance.inner.write().overwrite().save(f"{path}/inner")


class _Reader(MLReader):
    def load(self, path: str) -> DetectorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DetectorModel(metadata["columns"], PipelineModel.load(f"{path}/inner"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
