"""Stages over batches, chained with ``|``, in their order where asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Stage:
    """A function from a pandas batch to a pandas batch (or None, which drops it)."""

    def __init__(self, function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str):
        self.functions, self.schema = [function], schema

    def __or__(self, other: Stage) -> Stage:
        both = Stage(other.functions[0], other.schema)
        both.functions = [*self.functions, *other.functions]
        return both

    def run(self, rows: DataFrame, keep_order: str | None = None) -> DataFrame:
        """All stages in one pass over every partition. ``keep_order``: a sequence column of the result to sort by."""
        functions = self.functions

        def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for f in functions:
                    b = f(b)
                    if b is None:
                        break
                if b is not None:
                    yield b

        out = rows.mapInPandas(chained, self.schema)
        return out.orderBy(F.col(keep_order)) if keep_order else out
