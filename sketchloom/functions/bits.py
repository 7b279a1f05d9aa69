"""Bit arithmetic on 64-bit keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_ODD = 0x5555555555555555
_LOW = 0xFFFFFFFF


def sections(a: Column, b: Column) -> Column:
    """Number of differing 2-bit groups of two keys."""
    x = a.bitwiseXOR(b).cast("long")
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_ODD)))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's step and finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@F.pandas_udf(LongType())
def hashed(ctx: pd.Series) -> pd.Series:
    """The hash of contexts, as signed longs. Its products wrap, which native expressions refuse under ANSI mode."""
    return pd.Series(mix64(ctx.to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64))


def sampled(df: DataFrame, ctx: str, fold: int) -> DataFrame:
    """The rows whose context is in the share 2**-fold that a sketch of this fold keeps."""
    return df.where(hashed(ctx).bitwiseAND(F.lit(_LOW)) <= F.lit(_LOW >> fold))
