"""Rewards as objects, so that a run can name the one it uses."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scores


class Reward(Protocol):
    """A reward and its diagnostics, from the columns of an answered step."""

    def compute(self, forecast: Column, truth: Column, crowd: Column, quality: Column) -> Column:
        """A struct with ``reward`` and other fields."""
        ...


@dataclass(frozen=True)
class ProperScore:
    """The proper score of a forecast, with a penalty for its format and for unknown tools."""

    metric: str = "brier"
    coef: float = 1.0
    tool_coef: float = 0.0
    tool_quality: Column | None = None

    def compute(self, forecast: Column, truth: Column, crowd: Column, quality: Column) -> Column:
        record = scores.score(forecast, truth, crowd, quality, self.metric, coef=self.coef)
        if self.tool_quality is None or not self.tool_coef:
            return record
        return record.withField("reward", scores.tool_penalty(record["reward"], F.coalesce(self.tool_quality, F.lit(1.0)), self.tool_coef))
