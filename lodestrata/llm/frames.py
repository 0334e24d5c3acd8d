"""Small helpers for functions that run batch-wise in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pd.DataFrame]


def sampled(df: DataFrame, id_col: str, most: int, count: int, *then: str) -> DataFrame:
    """At most `most` rows of df, which has `count`, by the hashes of their ids.

    About twice as many pass a filter first, so that no task sends `most` rows to the driver, however many tasks there are.
    """
    share = min(1.0, 2 * most / max(count, 1))
    few = df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    return few.orderBy(F.xxhash64(id_col), id_col, *then).limit(most)


def filled(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run without its empty frames, whose column types pandas cannot know."""

    @wraps(run)
    def only(batches: Batches) -> Batches:
        return (out for out in run(batches) if len(out))

    return only
