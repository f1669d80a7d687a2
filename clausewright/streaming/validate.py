"""Contracts over streams: each micro-batch goes through the same fused checks, and its results are appended to a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewright.operators.checks import check_table, enforce, violates
from clausewright.functions.expressions import col


def validate_stream(stream: DataFrame, contract: dict, sink: str, checkpoint: str, mode: str = "ENFORCE", each: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Appends the results of each micro-batch, with batch_id, to Parquet in sink. A batch that is run again overwrites its own folder, so results aren't doubled."""

    def run(batch: DataFrame, number: int) -> None:
        results = enforce(check_table(batch, contract), mode)
        results.write.mode("overwrite").parquet(f"{sink}/batch_id={number}")
        if each:
            each(results, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def violations_of(contract: dict, schema) -> Column:
    """The checks that a single row breaks, as an array of column.check names: for streams that keep or turn away rows one by one."""
    fields = {f.name: f.dataType for f in schema.fields}
    kinds = ("required", "format", "pattern", "enum", "range")
    found = [F.when(bad, F.lit(f"{n}.{k}")) for n, c in contract["schema"].items() if n in fields for k in kinds if (bad := violates(k, c, col(n), fields[n])) is not None]
    return F.filter(F.array(*found).cast("array<string>"), lambda x: x.isNotNull())


def windowed_violations(stream: DataFrame, contract: dict, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """start, check, n: rows that break each check in each window of event time; rows later than the watermark are left out."""
    marked = stream.withWatermark(time, late).withColumn("check", F.explode(violations_of(contract, stream.schema)))
    return marked.groupBy(F.window(time, width), "check").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "check", "n")
