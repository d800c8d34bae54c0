"""The Python escape hatch (X1/X2), for features built-ins cannot express.

Level 1 (one column -> one column) becomes an Arrow-batched ``pandas_udf``
(Series -> Series); level 3 (a function over a whole batch of rows with a
declared output schema) becomes ``mapInPandas``.  Row-at-a-time Python UDFs
are deliberately not offered.  Built-in ``Column`` expressions
(``functions.scalar``) remain the default: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_feature(fn: Callable[[pd.Series], pd.Series], return_type: str = "double") -> Callable[..., Column]:
    """X1 level 1: vectorised per-column function, applied to Arrow batches."""
    return F.pandas_udf(fn, return_type)


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """X1 level 2/3 and X2: a pandas function over each batch of a partition
    with a declared output schema (rows may be added, dropped or reshaped)."""

    def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(_run, schema)
