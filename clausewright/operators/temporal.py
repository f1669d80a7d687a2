"""Joins in time: what was in force at a moment, and what happened shortly before.

Both cut time into bins and join or sort within a key and bin, so a key with a third of all rows is spread over as many tasks as it has
bins, and nothing is compared with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.storage import staged


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, name: str = "as_of", bins: int | None = None) -> DataFrame:
    """left with, as a struct called name, the latest row of right with the same keys whose time isn't after the left one's; null where there is none.

    Of right rows of one time the largest in the order of their columns is taken. Rows with a null key or time of either side meet
    nothing; left ones stay. One union, sorted once within each key and bin; the last right row of each key and bin, one row each, is
    carried over to the bins behind it."""
    keys = [F.col(f"`{k}`") for k in on]
    value = F.struct(F.col(f"`{right_time}`").alias("_t"), *[F.col(f"`{c}`") for c in right.columns if c not in on and c != right_time])
    valid = [k.isNotNull() for k in keys]
    none = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    r = right.where(F.col(f"`{right_time}`").isNotNull())
    for v in valid:
        r = r.where(v)
    key = F.struct(*keys).alias("_k")
    rows = left.select(key, _seconds(F.col(f"`{left_time}`")).alias("_s"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), none.alias("_r"))
    empty = F.lit(None).cast(rows.schema["_l"].dataType)
    rows = rows.unionByName(r.select(key, _seconds(F.col(f"`{right_time}`")).alias("_s"), F.lit(0).alias("_side"), empty.alias("_l"), value.alias("_r")))
    n = bins or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = rows.agg(F.min("_s"), F.max("_s")).first()
    width = ((high - low) / n if low is not None else 0.0) or 1.0
    rows = rows.withColumn("_bin", F.floor((F.col("_s") - F.lit(low or 0.0)) / width))
    last = staged(rows.where("_side = 0").groupBy("_k", "_bin").agg(F.max("_r").alias("_r")))
    # A bin with left rows gets the last right row of the bins before it; a window over a row or two for each key and bin.
    wanted = rows.where("_side = 1 and _bin is not null").groupBy("_k", "_bin").agg(F.lit(1).alias("_w"))
    marks = wanted.select("_k", "_bin", F.lit(1).alias("_side"), none.alias("_r")).unionByName(last.select("_k", "_bin", F.lit(0).alias("_side"), "_r"))
    before = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_bin", F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.withColumn("_c", before).where("_side = 1 and _c is not null").select("_k", (F.col("_bin") * width + (low or 0.0) - 1.0).alias("_s"), F.lit(0).alias("_side"), empty.alias("_l"), F.col("_c").alias("_r"), "_bin")
    order = Window.partitionBy("_k", "_bin").orderBy("_s", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = F.col("_bin").isNotNull()
    for f in on:
        fit = fit & F.col("_k")[f].isNotNull()
    met = rows.where(fit).unionByName(carried).withColumn("_got", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    met = met.select("_l", "_got").unionByName(rows.where(~fit & (F.col("_side") == 1)).select("_l", F.lit(None).cast(met.schema["_got"].dataType).alias("_got")))
    fields = [F.col("_got")["_t"].alias(right_time), *[F.col("_got")[c] for c in right.columns if c not in on and c != right_time]]
    return met.select("_l.*", F.when(F.col("_got").isNotNull(), F.struct(*fields)).alias(name))


def within(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, seconds: float, name: str = "found") -> DataFrame:
    """A row for each row of left and each of right with the same keys that isn't after it and at most so many seconds before, as a struct called name.

    Right rows are in one bin of that width each, left ones look into their own and the one before: an equi-join on keys and bin. Null
    keys and times meet nothing."""
    bin_of = lambda t: F.floor(_seconds(F.col(f"`{t}`")) / seconds)
    a = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), F.explode(F.array(bin_of(left_time), bin_of(left_time) - 1)).alias("_bin"))
    b = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_r"), bin_of(right_time).alias("_bin"))
    gap = _seconds(F.col("_l")[left_time]) - _seconds(F.col("_r")[right_time])
    met = a.withColumns({f"_k{i}": F.col("_l")[k] for i, k in enumerate(on)}).join(b.withColumns({f"_k{i}": F.col("_r")[k] for i, k in enumerate(on)}), ["_bin", *[f"_k{i}" for i in range(len(on))]])
    return met.where((gap >= 0) & (gap <= seconds)).select("_l.*", F.col("_r").alias(name))
