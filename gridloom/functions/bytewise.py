"""Functions of single values that need bytes or 128 bits: Arrow-batched Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRINTABLE = bytes(b if 0x20 <= b <= 0x7E else 0x20 for b in range(256))
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@F.pandas_udf(T.StringType())
def printable(data: pd.Series) -> pd.Series:
    """Bytes outside of printable ASCII as spaces, one for each byte; null stays null."""
    return data.map(lambda b: None if b is None else bytes(b).translate(PRINTABLE).decode("ascii"))


def base62(high: int, low: int) -> str:
    """Digits of a 128-bit number of two 64-bit halves (negative ones wrap), lowest first, without the highest digit."""
    seed, out = (high % 2**64 << 64) + low % 2**64, []
    while seed >= 62:
        out.append(DIGITS[seed % 62])
        seed //= 62
    return "".join(out)


@F.pandas_udf(T.StringType())
def base62_text(high: pd.Series, low: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(h) or pd.isna(v) else base62(int(h), int(v)) for h, v in zip(high, low)], dtype=object)


def object_id(lat: Column, lon: Column) -> Column:
    """Identifier of a position, from its coordinates as float32 in hundred thousandths."""
    scaled = lambda c: (c.cast("float") * F.lit(100000.0).cast("float")).cast("bigint")
    return base62_text(scaled(lat), scaled(lon))
