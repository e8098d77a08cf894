"""The feature encoder as a stage of a Spark ML pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FeatureEncoder


class EncoderStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector column ``outputCol`` of a fitted encoder's features; all input columns stay.  The
    encoder is a parameter of the stage (as JSON), so the stage is saved and loaded like any other."""

    encoderJson = Param(Params._dummy(), "encoderJson", "a fitted FeatureEncoder as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, encoder: FeatureEncoder | None = None, outputCol: str = "features"):  # noqa: N803
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(outputCol=outputCol)
        if encoder is not None:
            self._set(encoderJson=encoder.to_json())

    @property
    def encoder(self) -> FeatureEncoder:
        return FeatureEncoder.from_json(self.getOrDefault(self.encoderJson))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = [c.cast("double") for c in self.encoder.columns()]
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(*columns)))
