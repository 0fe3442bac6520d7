"""Links in buckets, and rows of one key of a stream, for functions of its state.

A call for a key, with its value in state, costs as much as some thousand rows do. So links share keys: the calls of a micro-batch are
bounded, however many links there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

BUCKETS = 1 << 14  # of links; a stream that goes on from a checkpoint needs the same number
NO_LINK = -1  # the bucket of rows whose link is null


def link_bucket(link: Column) -> Column:
    return F.coalesce(F.when(link.isNotNull(), F.pmod(F.xxhash64(link), F.lit(BUCKETS)).cast("int")), F.lit(NO_LINK))


def of_key(frames: Iterator[pd.DataFrame], kinds: dict[str, str]) -> list[np.ndarray]:
    """The named columns of all frames, none of which has nulls."""
    held = [[frame[name].to_numpy() for name in kinds] for frame in frames if len(frame)]
    if len(held) == 1:
        return [values.astype(kind, copy=False) for values, kind in zip(held[0], kinds.values(), strict=True)]
    return [np.concatenate([values[n] for values in held] or [[]]).astype(kind, copy=False) for n, kind in enumerate(kinds.values())]


def links(bucket: int, values: np.ndarray) -> pd.Series:
    """The links of rows of a bucket."""
    return pd.Series(pd.arrays.IntegerArray(values, np.full(len(values), bucket == NO_LINK)), copy=False)


def whole(values: np.ndarray) -> pd.Series:
    """A column of whole numbers that Spark may put null rows below, which would make plain ones floating."""
    return pd.Series(pd.arrays.IntegerArray(values, np.zeros(len(values), bool)), copy=False)
