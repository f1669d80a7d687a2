"""Profiles that merge: of each part of a table one row a column with counts, moments and sketches, kept in a folder.

A profile of the table comes from the kept rows alone, so only parts that are new have to be read. Counts, bounds and moments are
exact. Quantiles are off by at most 0.5 % of the rows in rank (KLL sketches of K_QUANTILES items), distinct counts by about 1.6 %
(HLL of 2^LG_DISTINCT registers, one standard deviation), and of the most frequent values the counts by at most the rows
over TRACKED. The sizes of the sketches don't depend on the table's, nor on the number of parts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import col, missing, numeric
from clausewright.operators.profile import POINTS, kind_of

K_QUANTILES, LG_DISTINCT, TRACKED = 1000, 12, 1000


def partial_profiles(df: DataFrame, part: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A row for each value of the part column (one part without) and each other column that isn't nested: part, column, dtype, total, non_null, min, max, mean, m2, quantiles, values, top. One aggregation, combined before the exchange."""
    fields = [f for f in df.schema.fields if f.name != part and (columns is None or f.name in columns) and kind_of(f.dataType)[0] in ("integer", "float", "string", "boolean")]
    null = lambda t: F.lit(None).cast(t)
    aggs, rows = [F.count(F.lit(1)).alias("total")], []
    for i, f in enumerate(fields):
        dtype, c = kind_of(f.dataType)[0], col(f.name)
        own = {"n": F.count_if(~missing(c, f.dataType)), "hll": F.hll_sketch_agg(c.cast("string"), LG_DISTINCT)}
        if dtype in ("integer", "float"):
            x = numeric(c, f.dataType)
            own |= {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "kll": F.kll_sketch_agg_double(x, K_QUANTILES)}
        else:
            own |= {"top": F.expr(f"approx_top_k_accumulate(CAST(`{f.name}` AS STRING), {TRACKED})")}
        aggs += [a.alias(f"c{i}_{k}") for k, a in own.items()]
        of = lambda k, t, own=own, i=i: (F.col(f"c{i}_{k}") if k in own else null(t)).alias(k)
        rows.append((F.lit(f.name), F.lit(dtype), *[of(k, t) for k, t in (("n", "bigint"), ("min", "double"), ("max", "double"), ("mean", "double"), ("m2", "double"), ("kll", "binary"), ("hll", "binary"))], f"c{i}_top" if "top" in own else None))
    key = F.col(f"`{part}`").cast("string").alias("part") if part else F.lit("all").alias("part")
    one = df.groupBy(key).agg(*aggs)
    names = ("column", "dtype", "non_null", "min", "max", "mean", "m2", "quantiles", "values")
    state = next((one.schema[t].dataType for *_, t in rows if t), None)
    top = lambda t: F.col(t) if t else null(state) if state else null("string")
    structs = [F.struct(*[c.alias(n) for c, n in zip(r, names)], top(r[-1]).alias("top")) for r in rows]
    return one.select("part", "total", F.inline(F.array(*structs)))


def merged(parts: DataFrame) -> DataFrame:
    """One row a column from the rows of all its parts, which can be merged further: column, dtype, total, non_null, min, max, mean, m2, quantiles, values, top."""
    n = F.sum("non_null")
    mean = F.sum(F.col("mean") * F.col("non_null")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("non_null"))), F.lit(0))
    square = F.sum(F.col("m2") + F.col("non_null") * F.col("mean") * F.col("mean"))
    kept = [F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("values").alias("values")]
    out = parts.groupBy("column", "dtype").agg(F.sum("total").alias("total"), n.alias("non_null"), F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), square.alias("sq"), *kept)
    if parts.schema["top"].dataType.simpleString() != "string":
        # Sketches of values can't be combined in a group that has none, as numbers have.
        top = parts.where("top is not null").groupBy("column").agg(F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"))
        out = out.join(top, "column", "left")
    return out.withColumn("m2", F.greatest(F.lit(0.0), F.col("sq") - F.col("non_null") * F.col("mean") * F.col("mean"))).drop("sq")


def finished(rows: DataFrame, top: int = 5) -> DataFrame:
    """column, dtype, total, non_null, null_fraction, min, max, mean, stddev, p25 to p99, cardinality, top (array of value and count) of rows of partial_profiles() or merged() with one row a column."""
    number = F.col("dtype").isin("integer", "float") & (F.col("non_null") > 0)
    quantile = lambda p: F.when(number, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    values = F.expr(f"transform(approx_top_k_estimate(top, {top}), x -> named_struct('value', x.item, 'count', x.count))") if "top" in rows.columns and rows.schema["top"].dataType.simpleString() != "string" else F.lit(None).cast("array<struct<value:string,count:bigint>>")
    return rows.select(
        "column", "dtype", "total", "non_null", F.when(F.col("total") > 0, (F.col("total") - F.col("non_null")) / F.col("total")).alias("null_fraction"), "min", "max", "mean",
        F.when(F.col("non_null") > 1, F.sqrt(F.col("m2") / (F.col("non_null") - 1))).alias("stddev"), *[quantile(p).alias(k) for k, p in POINTS.items()], F.hll_sketch_estimate("values").alias("cardinality"),
        F.when(F.col("dtype").isin("string", "boolean") & (F.col("non_null") > 0), values).alias("top"),
    )


def _kept(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        schema = spark.read.parquet(folder).schema
    except AnalysisException:
        return None
    # Names of folders are text, also where they look like numbers.
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name == "part" else f.dataType) for f in schema])).parquet(folder)


def profile_new(df: DataFrame, part: str, folder: str, again: list[str] = ()) -> DataFrame:
    """The profile of all parts kept in the folder, after those of df that it doesn't have, or that are named in `again`, were read and added.

    A part is written under its own name, so one that is run again replaces itself and a failed run adds nothing twice. Parts are told by
    the text of the part column; a null part is `__HIVE_DEFAULT_PARTITION__`."""
    spark = df.sparkSession
    old = _kept(spark, folder)
    known = {r[0] for r in old.select("part").distinct().collect()} - set(again) if old is not None else set()
    key = F.col(f"`{part}`").cast("string")
    # The list of parts is metadata, like the folders that it names. A filter on it prunes a table that is partitioned by it.
    new = df
    if known:
        named = [k for k in known if k is not None]
        new = df.where((key.isNotNull() & ~key.isin(named)) if None in known else (key.isNull() | ~key.isin(named)))
    rows = partial_profiles(new, part)
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    all_ = _kept(spark, folder)
    return finished(merged(all_ if all_ is not None else rows))
