"""Aggregates that several checks ask for, run together.

The checks of a diagnosis read the same rows for different numbers.  They name what they need
here first; one aggregate over the table then answers all of them, so a table is scanned a few
times whatever the number of checks and columns.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame


class Asked:
    """Named aggregates of a table."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.made = df, {}

    def add(self, made: dict[Any, Column]) -> None:
        self.made |= made

    def answers(self) -> dict[Any, Any]:
        """The value of each, by its name, from one scan."""
        if not self.made:
            return {}
        row = self.df.agg(*[c.alias(f"_{i}") for i, c in enumerate(self.made.values())]).first()
        return dict(zip(self.made, row, strict=True))
