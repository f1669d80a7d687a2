"""The phases from data to report, each from DataFrames to DataFrames or one small document."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.storage import cut
from clausewright.operators import checks, nested, texts
from clausewright.operators.drift import BASELINES, LEAST, advance, drift, moments_parts
from clausewright.sources.readers import with_row_order


def fused_parts(df: DataFrame, contract: dict) -> list[tuple[Column, Column]]:
    """The checks inside a record that a dataset's columns call for, as aggregates with their result structs."""
    names, contract_id, out = set(df.columns), contract["id"], []
    if {"extracted_facts", "entities"} <= names:
        out.append(checks.references_part(df.schema, contract_id))
    if {"aggregate_id", "sequence_number", "occurred_at", "recorded_at"} <= names:
        out.append(checks.temporal_part(contract_id, "occurred_at", "recorded_at"))
    if {"start_time", "end_time", "run_type"} <= names:
        out.append(checks.temporal_part(contract_id, "start_time", "end_time"))
    return out


def validate(df: DataFrame, contract: dict, mode: str = "ENFORCE", baselines: DataFrame | None = None, strict: bool = False, freeze: bool = False, quality: bool = False) -> tuple[DataFrame, DataFrame]:
    """RESULT rows of every check in the given mode, and the baselines after the run.

    Clauses, checks inside a record and moments are one aggregation over one scan, whose one row is checkpointed. Besides, there are
    plans for unique columns, for sequences, which need the order of the file, for what is inside nested columns if strict, and for
    the contract's check texts if quality."""
    before = baselines if baselines is not None else df.sparkSession.createDataFrame([], BASELINES)
    clause_aggs, clause_rows, apart = checks.table_parts(df.schema, contract)
    inside = fused_parts(df, contract)
    moment_aggs, moment_rows = moments_parts(df.schema, contract)
    one = cut(df.agg(*clause_aggs, *[a for a, _ in inside], *([F.struct(*moment_aggs).alias("moments")] if moment_aggs else [])))
    found = one.select(F.inline(F.filter(F.array(*clause_rows, *[r for _, r in inside]), lambda r: r.isNotNull())))
    now = one.select("moments.*").select(F.inline(F.array(*moment_rows))).where(F.col("n") >= LEAST) if moment_aggs else df.sparkSession.createDataFrame([], BASELINES)
    parts = [found, *checks.unique_apart(df, contract, apart), drift(now, before)]
    if {"aggregate_id", "sequence_number", "occurred_at", "recorded_at"} <= set(df.columns):
        parts.append(checks.monotonic(with_row_order(df), contract["id"], ["row_order"]))
    if strict:
        parts.append(nested.nested_checks(df, contract))
    if quality:
        parts.append(texts.check_texts(df, contract))
    return checks.enforce(reduce(DataFrame.unionByName, parts), mode), advance(now, before, freeze)


def report_of(results: DataFrame, contract_id: str, mode: str, digest: str = "") -> dict:
    """The validation report of a run; results are metadata."""
    rows = [r.asDict(recursive=True) for r in results.collect()]
    n = lambda *s: sum(r["status"] in s for r in rows)
    return {
        "report_id": str(uuid.uuid4()), "contract_id": contract_id, "snapshot_id": digest, "run_timestamp": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "enforcement_mode": mode,
        "total_checks": len(rows), "passed": n("PASS"), "failed": n("FAIL"), "warned": n("WARN", "INFO"), "errored": n("ERROR"), "results": rows,
    }
