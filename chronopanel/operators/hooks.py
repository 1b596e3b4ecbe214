"""Places where a user's own function joins a job: features, learners, statistics, text scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_features(df: DataFrame, feature: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """df joined to the features that ``feature`` computes from it, one row per key."""
    return df.join(feature(df), keys, "left")


def statistic(fn: Callable, kind: str = "double") -> Callable[[Column | str], Column]:
    """A user's statistic of a group (pandas Series -> number) as an aggregate. A group must fit in one task."""
    return F.pandas_udf(fn, kind, F.PandasUDFType.GROUPED_AGG)


def text_scorer(load: Callable[[], Callable], schema: str) -> Callable[[Column | str], Column]:
    """A user's batch scorer (Series of texts -> frame of class probabilities); ``load`` runs once per task."""

    def score(batches):
        model = load()
        for texts in batches:
            yield model(texts)

    return F.pandas_udf(score, schema, F.PandasUDFType.SCALAR_ITER)
