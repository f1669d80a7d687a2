"""Statistical drift of numeric columns against a table of baselines. Baselines go in and come out as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import col, fixed, numeric

BASELINES = "contract_id string, column string, mean double, stddev double, n bigint"
#: Standard deviations of the baseline from which a moved mean is a warning and a failure, and the least number of values.
WARN_FROM, FAIL_FROM, LEAST = 2.0, 3.0, 5


def moments_parts(schema: T.StructType, contract: dict) -> tuple[list[Column], list[Column]]:
    """Aggregates of the numeric clauses' columns and BASELINES structs over them."""
    fields = {f.name: f.dataType for f in schema.fields}
    names = [n for n, c in contract["schema"].items() if c.get("type") in ("number", "integer") and n in fields]
    aggs = [a for i, n in enumerate(names) for x in [numeric(col(n), fields[n])] for a in (F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count(x).alias(f"n{i}"))]
    rows = [F.struct(F.lit(contract["id"]).alias("contract_id"), F.lit(n).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)]
    return aggs, rows


def moments(df: DataFrame, contract: dict) -> DataFrame:
    """BASELINES rows of the numeric clauses with at least LEAST values, from one pass."""
    aggs, rows = moments_parts(df.schema, contract)
    if not aggs:
        return df.sparkSession.createDataFrame([], BASELINES)
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("n") >= LEAST)


def drift(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """RESULT rows of the columns whose mean has moved; those that haven't, or have no baseline or a constant one, have none."""
    b = baselines.select("contract_id", "column", F.col("mean").alias("b_mean"), F.col("stddev").alias("b_std"))
    met = current.join(b, ["contract_id", "column"]).where("b_std <> 0").withColumn("dev", F.abs(F.col("mean") - F.col("b_mean")) / F.col("b_std")).where(F.col("dev") > WARN_FROM)
    fail = F.col("dev") > FAIL_FROM
    limit = F.when(fail, FAIL_FROM).otherwise(WARN_FROM).cast("int").cast("string")
    return met.select(
        F.concat_ws(".", "contract_id", "column", F.lit("drift")).alias("check_id"), F.col("column").alias("column_name"), F.lit("statistical_drift").alias("check_type"),
        F.when(fail, "FAIL").otherwise("WARN").alias("status"),
        F.concat(F.lit("mean="), fixed(F.col("mean")), F.lit(" (baseline="), fixed(F.col("b_mean")), F.lit(", σ="), fixed(F.col("b_std")), F.lit(")")).alias("actual_value"),
        F.concat(F.lit("deviation < "), limit, F.lit("σ (current="), fixed(F.col("dev"), 2), F.lit("σ)")).alias("expected"),
        F.when(fail, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit(0).cast("bigint").alias("records_failing"), F.array().cast("array<string>").alias("sample_failing"),
        F.concat(F.col("column"), F.lit(": the mean moved "), fixed(F.col("dev"), 1), F.lit("σ from its baseline.")).alias("message"),
    )


def successive(runs: DataFrame, order: str = "run") -> DataFrame:
    """contract_id, column, order, deviation, status of the runs whose mean has moved from the baseline in force: the run before, of those with at least LEAST values, unless an earlier one was constant, which stays the baseline for good.

    runs: contract_id, column, order, mean, stddev, n."""
    by = Window.partitionBy("contract_id", "column").orderBy(order)
    fit = runs.where((F.col("n") >= LEAST) & F.col("mean").isNotNull())
    constant = F.max((F.coalesce("stddev", F.lit(0.0)) == 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    met = fit.select("*", F.lag("mean").over(by).alias("b_mean"), F.lag("stddev").over(by).alias("b_std"), constant.alias("stuck")).where("stuck = 0")
    dev = F.abs(F.col("mean") - F.col("b_mean")) / F.col("b_std")
    return met.withColumn("deviation", dev).where(F.col("deviation") > WARN_FROM).select("contract_id", "column", order, "deviation", F.when(F.col("deviation") > FAIL_FROM, "FAIL").otherwise("WARN").alias("status"))


def advance(current: DataFrame, baselines: DataFrame, freeze: bool = False) -> DataFrame:
    """The baselines after a run: current moments replace those there were, but for constant ones, which stay; new columns are added. freeze keeps all there were."""
    c, b = current.alias("c"), baselines.select("contract_id", "column", "mean", "stddev", "n").alias("b")
    keep = (F.col("b.column").isNotNull()) & (F.lit(freeze) | (F.col("b.stddev") == 0) | F.col("c.column").isNull())
    pick = lambda k: F.when(keep, F.col(f"b.{k}")).otherwise(F.col(f"c.{k}")).alias(k)
    met = c.join(b, (F.col("c.contract_id") == F.col("b.contract_id")) & (F.col("c.column") == F.col("b.column")), "full_outer")
    return met.select(F.coalesce("c.contract_id", "b.contract_id").alias("contract_id"), F.coalesce("c.column", "b.column").alias("column"), pick("mean"), pick("stddev"), pick("n"))


def drift_between(current: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """key, deviation, status: how far each group's mean is from the same group's before. A group that was constant, or had one value, has no row."""
    b = before.groupBy(key).agg(F.avg(value).alias("m0"), F.stddev_samp(value).alias("s0"))
    met = current.groupBy(key).agg(F.avg(value).alias("m")).join(b.where("s0 <> 0"), key)
    dev = F.abs(F.col("m") - F.col("m0")) / F.col("s0")
    return met.select(key, F.round(dev, 6).alias("deviation"), F.when(dev > FAIL_FROM, "FAIL").when(dev > WARN_FROM, "WARN").otherwise("PASS").alias("status"))
