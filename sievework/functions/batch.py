"""Plain functions of a text as columns, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def by_batch(f: Callable[[str | None], object], kind: str = "string") -> Callable[[Column], Column]:
    """``f`` as a column function; a batch's equal values are worked out once."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for v in values:
            v = None if v is None or v != v else v
            if v not in known:
                known[v] = f(v)
            out.append(known[v])
        return pd.Series(out, dtype=object)

    return run
