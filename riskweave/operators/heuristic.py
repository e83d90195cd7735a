"""Rule-based credit classifier."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HeuristicClassifier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Negative when any present rule fires, else positive.

    Rules: low bureau score, many enquiries, old credit, risky credit type. A
    rule whose column is absent is skipped; a missing value fires no rule.
    """

    scoreBelow = Param(Params._dummy(), "scoreBelow", "bureau score limit", TypeConverters.toFloat)
    enquiriesAbove = Param(Params._dummy(), "enquiriesAbove", "enquiry limit", TypeConverters.toFloat)
    ageAbove = Param(Params._dummy(), "ageAbove", "credit age limit in months", TypeConverters.toFloat)
    riskyType = Param(Params._dummy(), "riskyType", "risky credit type", TypeConverters.toString)
    positive = Param(Params._dummy(), "positive", "label of payers", TypeConverters.toInt)
    negative = Param(Params._dummy(), "negative", "label of defaulters", TypeConverters.toInt)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        scoreBelow=750.0,
        enquiriesAbove=6.0,
        ageAbove=6.0,
        riskyType="6",
        positive=1,
        negative=0,
        predictionCol="prediction",
    ):
        super().__init__()
        self._setDefault(
            scoreBelow=750.0, enquiriesAbove=6.0, ageAbove=6.0, riskyType="6",
            positive=1, negative=0, predictionCol="prediction",
        )
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        rules = {
            "puntaje_datacredito": lambda c: c < get(self.scoreBelow),
            "huella_consulta": lambda c: c > get(self.enquiriesAbove),
            "antiguedad_credito_meses": lambda c: c > get(self.ageAbove),
            "tipo_credito": lambda c: c.cast("string") == get(self.riskyType),
        }
        fired = [
            F.coalesce(rule(F.col(name)), F.lit(False))
            for name, rule in rules.items()
            if name in dataset.columns
        ]
        risky = reduce(lambda a, b: a | b, fired, F.lit(False))
        output = F.when(risky, get(self.negative)).otherwise(get(self.positive))
        return dataset.withColumn(get(self.predictionCol), output.cast("int"))
