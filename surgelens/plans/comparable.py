"""Results in a form two engines print alike: plain integers, rounded doubles, strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def r6_col(name: str, digits: int = 6):
    """A double rounded through a decimal, so that both engines round halves the same way."""
    return F.round(F.col(name).cast("double").cast("decimal(38,12)"), digits).cast("double") + F.lit(0.0)


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps become epoch seconds, decimals and doubles are rounded, integers widened."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp")) / 1000000.0
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = r6_col(f"`{f.name}`", digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
