"""Profiles of columns: one fused aggregation for a whole table, unpivoted to a row for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import FORMATS, col, digest, is_integral, is_nested, is_numeric, missing, numeric
from clausewright.operators.quantiles import exact_quantiles

PROFILE = (
    "column string, dtype string, total bigint, non_null bigint, null_fraction double, min double, max double, mean double, stddev double, "
    "p25 double, p50 double, p75 double, p95 double, p99 double, cardinality bigint, keys array<string>, warning string"
)

POINTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}

#: Share of a column's strings that must match a format.
FORMAT_SHARE = 0.8

# Columns with known values, matched when either name contains the other.
KNOWN_ENUMS: dict[str, list[str]] = {
    "overall_verdict": ["PASS", "FAIL", "WARN"],
    "run_type": ["llm", "chain", "tool", "retriever", "embedding"],
    "relationship": ["IMPORTS", "CALLS", "READS", "WRITES", "PRODUCES", "CONSUMES"],
    "type": ["FILE", "TABLE", "SERVICE", "MODEL", "PIPELINE", "EXTERNAL"],
    "entity_type": ["PERSON", "ORG", "LOCATION", "DATE", "AMOUNT", "OTHER"],
    "aggregate_type": ["Document", "Loan", "Application", "User"],
}


def kind_of(field: T.DataType) -> tuple[str, list[str]]:
    """The profile's name of a type, and the first ten keys of objects."""
    if isinstance(field, T.ArrayType):
        inner = field.elementType
        return ("array_of_objects", inner.names[:10]) if isinstance(inner, T.StructType) else ("array", [])
    if isinstance(field, T.StructType):
        return "object", field.names[:10]
    if isinstance(field, T.MapType):
        return "object", []
    if isinstance(field, T.BooleanType):
        return "boolean", []
    if is_integral(field):
        return "integer", []
    return ("float", []) if is_numeric(field) else ("string", [])


def _warning(name: str, lo: Column, hi: Column, mean: Column) -> Column:
    if "confidence" not in name.lower():
        return F.lit(None).cast("string")
    return (
        F.when(hi > 1.0, F.format_string("max=%.2f, maybe on a scale of 0 to 100; 0 to 1 is expected", hi))
        .when(mean > 0.99, "mean above 0.99, values may be clamped")
        .when(mean < 0.01, "mean below 0.01, values may be broken")
    )


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, light: bool = False) -> DataFrame:
    """PROFILE rows of the columns, from one pass; beyond one string column, exact distinct counts are a plan for each, which reads that column alone, as one aggregation would repeat every row for every such column.

    Exact quantiles are worked out when this is called, by a few scans that count (quantiles.exact_quantiles), so no task buffers a
    column's values. exact=False takes approximate quantiles and distinct counts, from the one pass. light leaves out deviations, quantiles and distinct counts, which clauses without formats and enums don't need."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    quantiles = exact_quantiles(df, [f.name for f in fields if kind_of(f.dataType)[0] in ("integer", "float")], list(POINTS.values())) if exact and not light else {}
    aggs: list[Column] = [F.count(F.lit(1)).alias("total")]
    strings = [f.name for f in fields if kind_of(f.dataType)[0] == "string"]
    apart = strings if exact and len(strings) > 1 and not light else []
    rows = []
    null = lambda t="double": F.lit(None).cast(t)
    for i, f in enumerate(fields):
        dtype, keys = kind_of(f.dataType)
        c, tag = col(f.name), f"c{i}_"
        aggs.append(F.count_if(~missing(c, f.dataType)).alias(tag + "n"))
        measured = dict.fromkeys(("min", "max", "mean", "stddev", "p25", "p50", "p75", "p95", "p99"), null())
        cardinality = null("bigint")
        if dtype in ("integer", "float"):
            x = numeric(c, f.dataType)
            for name, a in (("min", F.min(x)), ("max", F.max(x)), ("mean", F.avg(x)), *([] if light else [("stddev", F.stddev_samp(x))])):
                aggs.append(a.alias(tag + name))
            if not light and not exact:
                aggs.append(F.percentile_approx(x, F.array(*map(F.lit, POINTS.values())), F.lit(10_000)).alias(tag + "q"))
            measured |= {m: F.col(tag + m) for m in ("min", "max", "mean")}
            if not light:
                measured |= {"stddev": F.col(tag + "stddev")} | {p: F.lit(quantiles[f.name][k]) if exact else F.get(F.col(tag + "q"), F.lit(k)) for k, p in enumerate(POINTS)}
        elif dtype == "string" and not light and f.name not in apart:
            aggs.append(_distinct(f, exact).alias(tag + "d"))
            cardinality = F.col(tag + "d")
        n = F.col(tag + "n")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(dtype).alias("dtype"), F.col("total").alias("total"), n.alias("non_null"),
                F.when(F.col("total") > 0, (F.col("total") - n) / F.col("total")).alias("null_fraction"),
                *[v.cast("double").alias(k) for k, v in measured.items()], cardinality.cast("bigint").alias("cardinality"),
                F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("keys"),
                _warning(f.name, measured["min"], measured["max"], measured["mean"]).alias("warning"),
            )
        )
    found = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if not apart:
        return found
    counts = reduce(DataFrame.unionByName, [df.agg(_distinct(df.schema[c], True).alias("n")).select(F.lit(c).alias("column"), "n") for c in apart])
    return found.join(counts, "column", "left").withColumn("cardinality", F.coalesce("n", "cardinality")).select(*found.columns)


def _distinct(field: T.StructField, exact: bool) -> Column:
    text = col(field.name).cast("string")
    return F.count_distinct(digest(text, T.StringType())) if exact else F.approx_count_distinct(text)


def top_values(df: DataFrame, column: str, n: int | None = 5) -> DataFrame:
    """value, cnt of the most frequent values, ties to the smaller value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count("*").alias("cnt"))
    ordered = counts.orderBy(F.desc("cnt"), "value")
    return ordered.limit(n) if n else ordered


def _format(value: Column, share: float) -> Column:
    """The first of FORMATS that enough of the aggregated values have, nulls aside, or null."""
    return F.coalesce(*[F.when(F.avg(value.rlike(p).cast("double")) >= share, F.lit(name)) for name, p in FORMATS.items()])


def detect_format(values: DataFrame, column: str, sample: int | None = None, share: float = FORMAT_SHARE) -> DataFrame:
    """format: the first of FORMATS that enough of the values have, or null. With a sample, only so many values are looked at, whichever come first."""
    v = values.select(col(column).cast("string").alias("v")).where("v is not null")
    return (v.limit(sample) if sample else v).agg(_format(F.col("v"), share).alias("format"))


def detect_formats(df: DataFrame, columns: list[str], share: float = FORMAT_SHARE) -> dict[str, str | None]:
    """The format of each column, over all values, from one pass."""
    return dict(zip(columns, df.agg(*[_format(col(c).cast("string"), share).alias(f"f{i}") for i, c in enumerate(columns)]).first())) if columns else {}


def observed_enums(df: DataFrame, columns: list[str], most: int = 10, cardinality: dict[str, int] | None = None) -> dict[str, list[str] | None]:
    """For each column the known values of that name if all its values are among them, else its values by frequency if they are few, else None.

    Only columns that can have so few values are grouped, all in one aggregation: by their cardinality where it is known, or else by
    an estimate for all of them from one scan. So the values that are shuffled and collected are few, however long the columns."""
    longest = max(most, *map(len, KNOWN_ENUMS.values()))
    if cardinality is None and columns:
        cardinality = dict(zip(columns, df.agg(*[F.approx_count_distinct(col(c).cast("string")) for c in columns]).first()))
    # Estimates of so few values are off by less than that.
    few = [c for c in columns if (cardinality or {}).get(c, 0) <= 4 * longest]
    seen: dict[str, list[str]] = {c: [] for c in few}
    if few:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(few)])).alias("p")).where("p.v is not null")
        counts = pairs.groupBy("p.i", "p.v").agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: (-r["n"], r["v"])):
            seen[few[r["i"]]].append(r["v"])
    return {c: _enum(c, seen[c], most) if c in seen else None for c in columns}


def _enum(column: str, seen: list[str], most: int) -> list[str] | None:
    name = column.lower()
    for key, values in KNOWN_ENUMS.items():
        if (key in name or name in key) and set(seen) <= set(values):
            return values
    return seen if 0 < len(seen) <= most else None


def observed_enum(df: DataFrame, column: str, most: int = 10) -> list[str] | None:
    """observed_enums() of one column."""
    return observed_enums(df, [column], most)[column]


def suspicious(profiles: DataFrame) -> DataFrame:
    """column, flag of the profiles whose distribution looks broken."""
    conf = F.lower("column").contains("confidence")
    flags = F.array(
        F.when(F.col("stddev") == 0, "stddev=0: a constant column"),
        F.when(conf & (F.col("max") > 1.0), "confidence above 1: wrong scale"),
        F.when(conf & (F.col("max") <= 1.0) & (F.col("mean") > 0.99), "confidence is almost always 1"),
        F.when(conf & (F.col("mean") < 0.01), "confidence is almost always 0"),
        F.when((F.col("p75") > 0) & (F.col("mean") > 3 * F.col("p75")), "mean is over 3 times the upper quartile: heavy outliers"),
    )
    return profiles.select("column", F.array_join(F.filter(flags, lambda x: x.isNotNull()), "; ").alias("flag")).where("flag <> ''")


def baselines_of(profiles: DataFrame, contract_id: str) -> DataFrame:
    """contract_id, column, mean, stddev, min, max, n, recorded_at of the numeric profiles."""
    return profiles.where(F.col("dtype").isin("integer", "float") & F.col("mean").isNotNull()).select(
        F.lit(contract_id).alias("contract_id"), "column", "mean", F.coalesce("stddev", F.lit(0.0)).alias("stddev"), "min", "max",
        F.col("non_null").alias("n"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"),
    )

