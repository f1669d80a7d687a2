"""Column expressions that the operators share; all of them stay in the JVM."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named string formats in the order in which detection prefers them.
FORMATS: dict[str, str] = {
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "sha256": r"(?i)^[a-f0-9]{64}$",
    "sha256-40": r"(?i)^[a-f0-9]{40}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$",
    "semver": r"^\d+\.\d+\.\d+$",
}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def missing(c: Column, kind: T.DataType) -> Column:
    """Null, or NaN in a float column."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def numeric(c: Column, kind: T.DataType) -> Column:
    """As double; strings only where they are plain numbers, NaN as null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return c.try_cast("double")


def digest(c: Column, kind: T.DataType) -> Column:
    """A value to count or compare in its stead: strings and binaries as 128 bits, so that whole texts aren't shuffled; two texts of 10^12 are taken for one with a chance of 10^-15."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")))
    return c


def pattern_error(pattern: str) -> str | None:
    """What the engine's own compiler of expressions, which isn't Python's, says against a pattern; None if it takes it."""
    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        return str(e).splitlines()[0]
    return None


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def fixed(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", c)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def root(path: Column) -> Column:
    """The part of a field path before the first bracket and dot."""
    return F.split_part(F.split_part(path, F.lit("["), F.lit(1)), F.lit("."), F.lit(1))
