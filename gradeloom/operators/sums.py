"""Sums of packed vectors that partitions make."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(parts: DataFrame, keys: list[str], column: str, fan: int = 64) -> DataFrame:
    """(keys, column): the sum, place by place, of each key's `column`, doubles as bytes. `part` is the partition that made a row.

    Rows are added by groups of `fan` partitions and then the groups' sums, so that no task holds a row of every partition.
    """
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {column} binary"

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame[column].iloc[0]).copy()
        for data in frame[column].iloc[1:]:
            total += np.frombuffer(data)
        return frame[keys].iloc[:1].assign(**{column: [total.tobytes()]})

    near = parts.select(*keys, column, F.floor(F.col("part") / fan).alias("part")).groupBy(*keys, "part").applyInPandas(merge, schema)
    return near.groupBy(*keys).applyInPandas(merge, schema)
