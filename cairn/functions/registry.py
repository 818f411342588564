"""User-defined filename fields without Python UDFs.

A feature is a function from the stem column to a column; registered features
become extra columns of the scan and stay inside the same projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Feature = Callable[[Column], Column]


class FeatureRegistry:
    """Named column features over file stems."""

    def __init__(self) -> None:
        self._features: dict[str, Feature] = {}

    def register(self, name: str, feature: Feature) -> Feature:
        if not name or name in self._features:
            raise ValueError(f"feature name is empty or taken: {name!r}")
        self._features[name] = feature
        return feature

    def names(self) -> tuple[str, ...]:
        return tuple(self._features)

    def apply(self, df: DataFrame, stem: str = "stem") -> DataFrame:
        """Add every registered feature as a column."""
        return df.withColumns({name: fn(F.col(stem)) for name, fn in self._features.items()})
