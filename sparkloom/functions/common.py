"""Arrow-batched scalar functions for what no builtin expresses."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def vectorized(kind: str, nulls: bool = False) -> Callable:
    """Makes a Python function of values a column function over Arrow batches; a null argument gives null unless
    ``nulls`` is set. The plain function stays at hand as ``.plain``."""

    def wrap(f: Callable) -> Callable:
        def batch(*columns: pd.Series) -> pd.Series:
            out = []
            for values in zip(*columns, strict=True):
                values = [None if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else v for v in values]
                out.append(f(*values) if nulls or all(v is not None for v in values) else None)
            return pd.Series(out, dtype=object)

        def column(*arguments):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                udf = F.pandas_udf(batch, kind, F.PandasUDFType.SCALAR)
            return udf(*[a if hasattr(a, "_jc") or not isinstance(a, (int, float)) else F.lit(a) for a in arguments])

        column.plain, column.__name__, column.__doc__ = f, f.__name__, f.__doc__
        return column

    return wrap
