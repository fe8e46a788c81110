"""Arrow UDFs that are made when they are first used, so that modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def arrow(returns: str) -> Callable:
    def mark(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*cols) -> Column:
            return pandas_udf(f, returns)(*cols)

        return call

    return mark
