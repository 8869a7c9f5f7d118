"""Byte kernels as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def binary_kernel(f: Callable[[bytes], object], returns: str = "binary"):
    """A pandas UDF that applies a kernel to each payload of a batch; null stays null."""

    @F.pandas_udf(returns)
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else f(bytes(b)) for b in data])

    return run
