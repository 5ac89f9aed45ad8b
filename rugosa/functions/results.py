"""Results as text: JSON rows and ISO durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, which JSON can say."""
    return df.select(*[F.when((F.abs(c) < float("inf")) & ~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def json_rows(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, json): each row as an object with all its columns, nulls included; times in ISO form."""
    return finite(df).select(*keys, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("json"))


def iso_duration(microseconds: Column) -> Column:
    """A duration in microseconds as P1DT02H03M04S, with six digits of the second's fraction if there is one."""
    m = F.abs(microseconds.cast("long"))
    part = lambda size, of: F.pmod(F.floor(m / F.lit(size)).cast("long"), F.lit(of))
    days, rest = F.floor(m / F.lit(86_400_000_000)).cast("long"), F.pmod(m, F.lit(1_000_000))
    fraction = F.when(rest > 0, F.format_string(".%06d", rest)).otherwise("")
    text = F.format_string("P%dDT%02dH%02dM%02d%sS", days, part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60), fraction)
    return F.when(microseconds < 0, F.concat(F.lit("-"), text)).otherwise(text)
