"""Imputation and robust scaling as pyspark.ml estimators, whose models can be saved, loaded and undone.

A fit reads its input once: the columns that it needs are written, and exact quantiles are taken from
those. fit_preparation fits both with one reading.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.operators import series
from sedgeline.operators.storage import cut
from sedgeline.params import DEFAULT, FEATURES

#: Columns that are 0 where a flag is false, before medians fill the rest.
ZEROS = {"early_slope": "has_early_data"}


def _floats(value: list) -> list:
    return [None if x is None else float(x) for x in value]


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)
    zeroCols = Param(Params._dummy(), "zeroCols", "columns that are 0 where their flag is false", TypeConverters.toListString)
    flagCols = Param(Params._dummy(), "flagCols", "the flags of zeroCols", TypeConverters.toListString)

    def columns(self) -> tuple[str, ...]:
        return tuple(self.getOrDefault(self.inputCols))

    def zeros(self) -> dict[str, str]:
        return dict(zip(self.getOrDefault(self.zeroCols), self.getOrDefault(self.flagCols), strict=True))


class _Scaled(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "what the names of scaled columns end with", TypeConverters.toString)
    clip = Param(Params._dummy(), "clip", "scaled values lie between this and its negative", TypeConverters.toFloat)

    def columns(self) -> tuple[str, ...]:
        return tuple(self.getOrDefault(self.inputCols))


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Missing values become the column's exact median, or 0 where the column has a flag and that is false."""

    @keyword_only
    def __init__(self, *, inputCols=None, zeroCols=None, flagCols=None):
        super().__init__()
        zeros = {c: f for c, f in ZEROS.items() if c in FEATURES}
        self._setDefault(inputCols=list(FEATURES), zeroCols=list(zeros), flagCols=list(zeros.values()))
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        found = series.exact_quantiles(dataset, self.columns(), (0.5,))
        if missing := [c for c in self.columns() if found[c][0] is None]:
            raise ValueError(f"columns without any value: {missing}")
        model = MedianImputerModel()
        model._set(**{p.name: self.getOrDefault(p) for p in (self.inputCols, self.zeroCols, self.flagCols)}, medians=[found[c][0] for c in self.columns()])
        return model


class MedianImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "the median of each column", _floats)

    def filled(self, column: str, median: float) -> Column:
        flag = self.zeros().get(column)
        fill = F.when(F.col(flag), F.lit(median)).otherwise(0.0) if flag else F.lit(median)
        return F.coalesce(F.col(column).cast("double"), fill)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: self.filled(c, m) for c, m in zip(self.columns(), self.getOrDefault(self.medians), strict=True)})


class RobustScaler(Estimator, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    """(x - median) / IQR within limits, from exact quartiles; 0 for a column whose quartiles are equal."""

    @keyword_only
    def __init__(self, *, inputCols=None, suffix="_z", clip=DEFAULT.clip):
        super().__init__()
        self._setDefault(inputCols=list(FEATURES), suffix="_z", clip=float(DEFAULT.clip))
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RobustScalerModel:
        found = series.exact_quantiles(dataset, self.columns())
        model = RobustScalerModel()
        quartiles = {name: [found[c][k] for c in self.columns()] for k, name in enumerate(("q25", "medians", "q75"))}
        model._set(**{p.name: self.getOrDefault(p) for p in (self.inputCols, self.suffix, self.clip)}, **quartiles)
        return model


class RobustScalerModel(Model, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    q25 = Param(Params._dummy(), "q25", "first quartiles", _floats)
    medians = Param(Params._dummy(), "medians", "medians", _floats)
    q75 = Param(Params._dummy(), "q75", "third quartiles", _floats)

    def fitted(self) -> dict[str, tuple[float | None, float | None, float | None, float | None]]:
        """median, q25, q75 and IQR (None if the column is flat or empty) of each column."""
        values = zip(self.columns(), *[self.getOrDefault(p) for p in (self.medians, self.q25, self.q75)], strict=True)
        return {c: (m, a, b, None if a is None or b - a < 1e-12 else b - a) for c, m, a, b in values}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        clip = self.getOrDefault(self.clip)
        scaled = {}
        for c, (median, _, _, iqr) in self.fitted().items():
            z = (F.col(c) - F.lit(median)) / F.lit(iqr) if iqr else F.lit(0.0)
            scaled[c + self.getOrDefault(self.suffix)] = F.when(F.col(c).isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
        return dataset.withColumns(scaled)

    def inverse_transform(self, dataset: DataFrame) -> DataFrame:
        """The columns again from their scaled ones; what was clipped stays at its limit, flat columns are their median."""
        back = {}
        for c, (median, _, _, iqr) in self.fitted().items():
            z = F.col(c + self.getOrDefault(self.suffix))
            back[c] = F.when(z.isNotNull(), z * F.lit(iqr or 0.0) + F.lit(median))
        return dataset.withColumns(back)


def fit_preparation(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> PipelineModel:
    """Imputer and scaler as one model that can be saved; features are read once for both."""
    zeros = {c: f for c, f in ZEROS.items() if c in columns}
    narrow = cut(features.select(*columns, *zeros.values()))
    imputer = MedianImputer(inputCols=list(columns), zeroCols=list(zeros), flagCols=list(zeros.values())).fit(narrow)
    scaler = RobustScaler(inputCols=list(columns)).fit(imputer.transform(narrow))
    return PipelineModel([imputer, scaler])
