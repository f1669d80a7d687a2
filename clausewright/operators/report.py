"""The health report: reports, violations, schema changes and model checks rolled up."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.expressions import half_even

RANKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
PENALTY = {"CRITICAL": 20, "HIGH": 5}


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 3 for LOW, 4 for anything else; none at all counts as LOW."""
    severity, out = F.coalesce(severity, F.lit("LOW")), F.lit(4)
    for i, s in reversed(list(enumerate(RANKS))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def score(passed: Column, total: Column, critical: Column, high: Column) -> Column:
    """Percent passed, half to even, less the penalties, from 0 to 100; 100 without checks."""
    raw = half_even(100.0 * passed / F.nullif(total, F.lit(0)) - PENALTY["CRITICAL"] * critical - PENALTY["HIGH"] * high)
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), raw))).otherwise(100).cast("bigint")


def health_score(reports: DataFrame, violations: DataFrame) -> DataFrame:
    """score, narrative from reports (total_checks, passed) and violations (severity)."""
    r = reports.agg(F.coalesce(F.sum("total_checks"), F.lit(0)).alias("total"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"))
    v = violations.agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    s = r.join(F.broadcast(v)).select(score(F.col("passed"), F.col("total"), F.col("critical"), F.col("high")).alias("score"))
    return s.select("score", F.when(F.col("score") >= 90, "Healthy: contracts hold.").when(F.col("score") < 60, "Poor: act on the violations now.").otherwise("Fair: some contracts need attention.").alias("narrative"))


def cube(results: DataFrame, by: list[str], status: str = "status", severity: str = "severity") -> DataFrame:
    """by, level, checks, passed, failed, score: check results summed up at every level of the columns `by` at once, with the score of each, penalties for its own failures.

    level has a bit for each column that is summed over, the first column's the highest (grouping_id); such a column is null. One
    aggregation, combined before the exchange."""
    bad = F.col(status) == "FAIL"
    counts = [F.count("*").alias("checks"), F.count_if(F.col(status) == "PASS").alias("passed"), F.count_if(bad).alias("failed"), *[F.count_if(bad & (F.col(severity) == s)).alias(f"_{s}") for s in PENALTY]]
    summed = results.cube(*by).agg(F.grouping_id().alias("level"), *counts)
    return summed.select(*by, "level", "checks", "passed", "failed", score(F.col("passed"), F.col("checks"), F.col("_CRITICAL"), F.col("_HIGH")).alias("score"))


def top_by_rank(df: DataFrame, rank: Column, order: list[str | Column], n: int = 3) -> DataFrame:
    return df.orderBy(rank, *order).limit(n)


def top_violations(violations: DataFrame, order: str = "log_pos", n: int = 3) -> DataFrame:
    """The gravest, earlier ones first."""
    return top_by_rank(violations, severity_rank(F.col("severity")), [order], n)


def impact(affected: Column) -> Column:
    """What a violation means downstream, from the nodes that it affects: their number and the first three."""
    n = F.coalesce(F.size(affected), F.lit(0))
    return F.when(n > 0, F.concat(F.lit("Affects "), n.cast("string"), F.lit(" downstream node(s): "), F.array_join(F.slice(affected, 1, 3), ", "))).otherwise("No downstream consumers known.")


def summary_of(violations: DataFrame) -> DataFrame:
    """violation_id, check_id, severity, system, field, message, downstream_impact of rows of the log."""
    nodes = F.col("blast_radius.affected_nodes") if "blast_radius" in violations.columns else F.array().cast("array<string>")
    return violations.select("violation_id", "check_id", "severity", F.coalesce("contract_id", F.lit("unknown")).alias("system"), F.coalesce("column_name", F.lit("unknown")).alias("field"), F.coalesce("message", F.lit("")).alias("message"), impact(nodes).alias("downstream_impact"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def schema_changes(changes: DataFrame, order: str = "report_order") -> DataFrame:
    """The last of each change by contract, type and column, in the order in which they first came."""
    rest = F.struct(*[c for c in changes.columns if c not in ("contract_id", "change_type", "column")])
    kept = changes.groupBy("contract_id", "change_type", "column").agg(F.max_by(rest, order).alias("last"), F.min(order).alias("first"))
    return kept.orderBy("first").select("contract_id", "change_type", "column", "last.*")


# The file behind a model check, where no commit says.
CHECK_FILES: dict[str, str] = {
    "ai_extensions.embedding_drift": "contracts/ai_extensions.py",
    "ai_extensions.llm_output_schema": "contracts/ai_extensions.py",
    "ai_extensions.prompt_input": "contracts/ai_extensions.py",
}
#: Pipelines behind drifting embeddings and failing model outputs.
DRIFT_PIPELINE, OUTPUT_PIPELINE = "week3-document-extraction-pipeline", "week2-evaluation-pipeline"


def recommended_actions(violations: DataFrame, metrics: dict | None = None, order: str = "log_pos", n: int = 3) -> list[dict]:
    """At most n, each with the file to look at and the pipelines it concerns: the gravest violation of each check, then model checks, or that all is well.

    The file is the first of the blame chain, or what is known of the check. A violation of embeddings' drift tells the score of
    metrics, not that of the log."""
    drift, output = ((metrics or {}).get(k) or {} for k in ("embedding_drift", "llm_output_schema"))
    rank = severity_rank(F.col("severity"))
    first = latest(violations, ["check_id"], [rank, F.col(order)])
    rich = {"blame_chain", "blast_radius"} <= set(violations.columns)
    file, pipelines = (F.get("blame_chain", F.lit(0))["file_path"], F.col("blast_radius.affected_pipelines")) if rich else (F.lit(None).cast("string"), F.lit(None).cast("array<string>"))
    rows = first.orderBy(rank, order).limit(n).select("severity", "check_id", "contract_id", "column_name", F.substring(F.coalesce("message", F.lit("")), 1, 200).alias("message"), file.alias("file"), pipelines.alias("pipelines")).collect()
    out = []
    for r in rows:
        message = r["message"]
        if r["check_id"] == "ai_extensions.embedding_drift" and drift.get("drift_score") is not None:
            message = f"drift is {drift['drift_score']:.4f}, {drift.get('threshold', 0.15)} is allowed"
        at = r["file"] or CHECK_FILES.get(r["check_id"]) or "unknown"
        out.append({"severity": r["severity"], "action": f"Fix '{r['column_name'] or 'unknown'}' of {r['contract_id'] or 'unknown'} ({r['check_id']}): {message} Look at {at}.", "file": at, "affected_pipelines": r["pipelines"] or []})
    if drift.get("status") == "FAIL":
        out.append({"severity": "HIGH", "action": "Look into the drift of embeddings; set a new baseline if it is meant.", "file": None, "affected_pipelines": [DRIFT_PIPELINE]})
    if output.get("trend") == "rising":
        out.append({"severity": "MEDIUM", "action": "More model outputs break their schema than before; look at recent prompt changes.", "file": None, "affected_pipelines": [OUTPUT_PIPELINE]})
    out = out or [{"severity": "LOW", "action": "All is well; generate contracts anew each week.", "file": None, "affected_pipelines": []}]
    return [{"priority": i + 1} | a for i, a in enumerate(out[:n])]


def ai_risk(metrics: dict) -> dict:
    part = lambda k: metrics.get(k) or {}
    ok = part("embedding_drift").get("status") in ("PASS", "BASELINE_SET", None) and all(part(k).get("status") in ("PASS", None) for k in ("prompt_input_validation", "llm_output_schema", "trace_schema"))
    return {
        "overall_ai_status": "GREEN" if ok else "AMBER", "embedding_drift_status": part("embedding_drift").get("status", "NOT_RUN"), "embedding_drift_score": part("embedding_drift").get("drift_score"),
        "prompt_input_violation_rate": part("prompt_input_validation").get("violation_rate"), "llm_output_violation_rate": part("llm_output_schema").get("violation_rate"),
        "llm_output_trend": part("llm_output_schema").get("trend", "stable"), "trace_schema_status": part("trace_schema").get("status", "NOT_RUN"),
    }


def severity_histogram(df: DataFrame, severity: Column) -> DataFrame:
    return df.groupBy(F.coalesce(severity, F.lit("UNKNOWN")).alias("severity")).agg(F.count("*").alias("n"))


def totals(reports: DataFrame) -> DataFrame:
    return reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_checks", "passed", "failed", "warned")], F.count("*").alias("reports"))


def pass_rates(reports: DataFrame) -> DataFrame:
    """contract_id, pass_rate of the newest report of each contract, rounded half up; 100 without checks."""
    newest = latest(reports, ["contract_id"], [F.desc("run_timestamp")])
    rate = F.when(F.col("total_checks") > 0, F.floor(100.0 * F.col("passed") / F.nullif(F.col("total_checks"), F.lit(0)) + 0.5)).otherwise(100)
    return newest.select("contract_id", rate.cast("bigint").alias("pass_rate"))


def of_contract(reports: DataFrame, contract_id: str) -> DataFrame:
    """The reports of one contract, oldest first."""
    return reports.where(F.col("contract_id") == contract_id).orderBy("run_timestamp")


def by_contract(reports: DataFrame) -> DataFrame:
    return reports.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("run_timestamp", "total_checks", "passed"))).alias("reports"))


def catalog_row(contract: dict) -> dict:
    return {"id": contract["id"], "title": contract["info"]["title"], "clauses": len(contract["schema"]), "downstream": len(contract["lineage"]["downstream"])}


def build(reports: DataFrame, violations: DataFrame, changes: DataFrame, metrics: dict) -> dict:
    """The whole report; rows without violation_id are left out."""
    known = violations.where("violation_id is not null")
    health = health_score(reports, known).first()
    return {
        "generated_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "data_health_score": health["score"], "health_narrative": health["narrative"],
        "validation_summary": totals(reports).first().asDict(),
        "violations": {"by_severity": {r["severity"]: r["n"] for r in severity_histogram(known, F.col("severity")).collect()}, "top": [r.asDict() for r in summary_of(top_violations(known)).collect()]},
        "schema_changes_detected": [r.asDict() for r in schema_changes(changes).collect()], "ai_risk_assessment": ai_risk(metrics),
        "recommended_actions": recommended_actions(known, metrics),
    }


def markdown(report: dict) -> str:
    lines = [f"# Data health {report['data_health_score']}", "", report["health_narrative"], "", "## Checks", ""]
    lines += [f"- {k}: {v}" for k, v in report["validation_summary"].items()] + ["", "## Violations", ""]
    lines += [f"- {k}: {v}" for k, v in report["violations"]["by_severity"].items()]
    lines += [f"- {v['system']}.{v['field']} ({v['severity']}): {v['message']} {v['downstream_impact']}" for v in report["violations"]["top"]] + ["", "## Schema changes", ""]
    lines += [f"- {c['contract_id']}.{c['column']}: {c['change_type']}" for c in report["schema_changes_detected"]] + ["", "## Actions", ""]
    lines += [f"{a['priority']}. ({a['severity']}) {a['action']}" for a in report["recommended_actions"]]
    return "\n".join([*lines, "", f"Model checks: {report['ai_risk_assessment']['overall_ai_status']}", ""])
