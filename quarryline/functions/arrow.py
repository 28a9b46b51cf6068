"""Arrow-batched Python functions as the engine uses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def arrow_udf(returns: str) -> Callable:
    """A pandas UDF that runs once for each row.

    It is declared nondeterministic, so the optimizer neither copies it into a
    filter it derives from an explode or a null test, nor moves it under a
    repartition, where it would run on fewer cores.
    """

    def make(f: Callable):
        return F.pandas_udf(f, returns).asNondeterministic()

    return make
