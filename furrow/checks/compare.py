"""Shape query results so that two engines can be compared value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Whole numbers as BIGINT, fractions rounded (unless ``digits`` is None), times as text."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = c.cast("double") if digits is None else F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(t, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
