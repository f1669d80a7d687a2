"""Keyed state over streams: checks that need what came before, kept from micro-batch to micro-batch.

Each is a small step from the state of a key and its next row to a new state and a result. A batch's rows of a key are put in order
and go through the step one by one, so however a stream is cut into micro-batches the results are those of the batch operator over all
of it, as long as later batches hold later rows, and a stream that is started again goes on from its checkpoint. The state of a key is
one small row. A batch's rows of one key are together in one task, so the size of batches bounds it (maxFilesPerTrigger and the like).

State is kept by the RocksDB store; with_store() sets it. Moments need no step: they are aggregates, which the engine keeps and
combines before the exchange itself, so a column's rows needn't meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from clausewright.operators.drift import FAIL_FROM, LEAST, WARN_FROM, moments_parts

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries started within."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


class InOrder(StatefulProcessor):
    """Takes a key's rows through step(state or None, row) -> (state or None, result or None), in the order of some columns, nulls first."""

    def __init__(self, order: list[str], state: str, names: list[str], step: Callable[[tuple | None, Row], tuple[tuple | None, tuple | None]], ttl_ms: int | None):
        self.order, self.state, self.row, self.step, self.ttl_ms = order, state, Row(*names), step, ttl_ms

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", self.state, self.ttl_ms) if self.ttl_ms else handle.getValueState("kept", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = tuple(self.kept.get()) if self.kept.exists() else None
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            now, found = self.step(now, row)
            if found is not None:
                yield self.row(*found)
        if now is not None:
            self.kept.update(now)

    def close(self) -> None:
        pass


def _stepped(stream: DataFrame, keys: list[str], order: list[str], state: str, out: str, step, ttl_ms: int | None) -> DataFrame:
    names = T.StructType.fromDDL(out).names
    return stream.groupBy(*keys).transformWithState(InOrder(order, state, names, step, ttl_ms), out, "append", "processingTime" if ttl_ms else "none")


def _kind(stream: DataFrame, column: str) -> str:
    return stream.schema[column].dataType.simpleString()


def sequences(stream: DataFrame, group: str, value: str, order: str, ttl_ms: int | None = None) -> DataFrame:
    """group, order, value, before: the rows whose value doesn't exceed the one before it in their group, as they come (checks.non_increasing over a stream).

    A null value fails nothing, and nothing fails after it. With ttl_ms a group that is silent for so long is forgotten; its next row
    starts anew. Such a query looks at the clock for ever, so it ends by stop(), not by running out of input."""

    def step(state, row):
        before, v = state[0] if state else None, row[value]
        bad = before is not None and v is not None and v <= before
        return (v,), (row[group], row[order], v, before) if bad else None

    rows = stream.select(group, value, order)
    return _stepped(rows, [group], [order], f"v {_kind(stream, value)}", f"{group} {_kind(stream, group)}, {order} {_kind(stream, order)}, {value} {_kind(stream, value)}, before {_kind(stream, value)}", step, ttl_ms)


def trends(stream: DataFrame, key: str, order: str, rate: str, ttl_ms: int | None = None) -> DataFrame:
    """key, order, rate, trend of each run, against the mean of the up to three before it (ai.trend over a stream)."""

    def step(state, row):
        last, v = list(state[0]) if state else [], row[rate]
        known = [x for x in last if x is not None]
        mean = sum(known) / len(known) if known else None
        moved = "stable"
        if len(last) >= 2 and mean is not None and v is not None:
            moved = "rising" if v > 1.5 * mean else "falling" if v < 0.7 * mean else "stable"
        return ([*last, v][-3:],), (row[key], row[order], v, moved)

    rows = stream.select(key, order, F.col(rate).cast("double").alias(rate))
    return _stepped(rows, [key], [order], "last array<double>", f"{key} {_kind(stream, key)}, {order} {_kind(stream, order)}, {rate} double, trend string", step, ttl_ms)


def drifts(stream: DataFrame, order: str = "run", ttl_ms: int | None = None) -> DataFrame:
    """contract_id, column, order, deviation, status of the runs whose mean has moved from the column's baseline by more than WARN_FROM deviations (drift.successive over a stream).

    stream: contract_id, column, order, mean, stddev, n. A run becomes the baseline of the next, even one that fails; runs of fewer
    than LEAST values are passed over, and a constant baseline stays for good."""

    def step(state, row):
        if row["n"] is None or row["n"] < LEAST or row["mean"] is None:
            return state, None
        here = (row["mean"], row["stddev"])
        if state is None:
            return here, None
        mean, deviation = state
        if not deviation:
            return state, None
        moved = abs(row["mean"] - mean) / deviation
        found = (row["contract_id"], row["column"], row[order], moved, "FAIL" if moved > FAIL_FROM else "WARN") if moved > WARN_FROM else None
        return here, found

    rows = stream.select("contract_id", "column", order, *[F.col(c).cast("double").alias(c) for c in ("mean", "stddev")], "n")
    return _stepped(rows, ["contract_id", "column"], [order], "mean double, stddev double", f"contract_id string, column string, {order} {_kind(stream, order)}, deviation double, status string", step, ttl_ms)


def running_baselines(stream: DataFrame, contract: dict) -> DataFrame:
    """contract_id, column, mean, stddev, n of each numeric clause over all rows so far: an aggregate, for the output modes complete and update."""
    aggs, rows = moments_parts(stream.schema, contract)
    return stream.agg(*aggs).select(F.inline(F.array(*rows)))
