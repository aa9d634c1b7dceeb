"""The session and the types of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.strings import col

# Names of types.
_NAMES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "real", "double": "real", "string": "text", "boolean": "boolean", "binary": "blob", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def now() -> Column:
    return F.current_timestamp()


def today() -> Column:
    return F.current_date()


def clock() -> Column:
    """Seconds since 1970, with their fraction."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def user() -> Column:
    return F.current_user()


def database() -> Column:
    return F.current_database()


def version() -> Column:
    return F.version()


def space(n: Column | str | int) -> Column:
    return F.repeat(F.lit(" "), F.lit(n) if isinstance(n, int) else col(n))


def type_of_column(c: Column, kind: str) -> Column:
    """integer, real, text, boolean, blob, datetime, or null for a missing value, of a column of a known type."""
    name = "real" if kind.startswith("decimal") else _NAMES.get(kind, kind)
    return F.when(c.isNull(), "null").otherwise(name)


def type_name(column: str, df: DataFrame) -> Column:
    return type_of_column(F.col(column), dict(df.dtypes)[column])
