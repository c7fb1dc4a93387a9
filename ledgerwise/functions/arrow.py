"""Plain functions over text columns, in Arrow batches: for formulas and statements, which are metadata."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def each(f: Callable, kind: str = "string") -> Callable[..., Column]:
    """f of one row's values as a function of columns; a null argument comes as None."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if x is None or x is pd.NA or isinstance(x, float) and x != x else x for x in row)) for row in zip(*columns)], dtype=object)

    return run
