"""SAMME boosting as a Spark ML Estimator and Model, for use in a ``Pipeline``."""

from __future__ import annotations

import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable
from pyspark.sql import DataFrame, SparkSession

from pricelens.operators.boost import SammeModel, fit_samme


class _SammeParams(HasLabelCol, HasSeed):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns, in the model's order", TypeConverters.toListString)
    rounds = Param(Params._dummy(), "rounds", "most stages", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each stage's weight", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a stage's tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "split candidates of a feature", TypeConverters.toInt)
    parts = Param(Params._dummy(), "parts", "parts of the stored training rows", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="target", seed=42, rounds=100, learningRate=0.1, maxDepth=3, maxBins=256, parts=16)


class SammeClassifier(Estimator, _SammeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``SammeClassificationModel`` on the rows whose features and label are there."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="target", rounds=100, learningRate=0.1, maxDepth=3, maxBins=256, seed=42, parts=16):
        super().__init__()
        given = self._input_kwargs
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "SammeClassificationModel":
        get = self.getOrDefault
        names, label = get("inputCols"), get("labelCol")
        fitted = fit_samme(dataset.dropna(subset=[*names, label]), names, label, get("rounds"), get("learningRate"), get("maxDepth"), get("maxBins"),
                           get("seed"), get("parts"))
        return self._copyValues(SammeClassificationModel(fitted))


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.fitted.save(SparkSession.active(), os.path.join(path, "model"))


class _Reader(MLReader):
    def load(self, path: str) -> "SammeClassificationModel":
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = SammeClassificationModel(SammeModel.load(spark, os.path.join(path, "model")))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class SammeClassificationModel(Model, _SammeParams, MLReadable, MLWritable):
    """Adds ``decision``, ``prediction``, ``p_up``, ``confidence`` and ``direction`` to the rows."""

    def __init__(self, fitted: SammeModel | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    @property
    def featureImportances(self) -> dict[str, float]:
        return self.fitted.feature_importances

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()
