"""Sources: datasets of any size as DataFrames, and the small documents about them."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from pathlib import Path

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.sources import git, log
from clausewright.sources.git import COMMIT

# Schemas of the contract-domain datasets.
SCHEMAS: dict[str, str] = {
    "intent_records": "intent_id string, description string, code_refs array<struct<file:string,line_start:bigint,line_end:bigint,symbol:string,confidence:double>>, governance_tags array<string>, created_at string",
    "verdicts": "verdict_id string, target_ref string, rubric_id string, rubric_version string, scores map<string,struct<score:bigint,evidence:array<string>,notes:string>>, overall_verdict string, overall_score double, confidence double, evaluated_at string",
    "extractions": "doc_id string, source_path string, source_hash string, extracted_facts array<struct<fact_id:string,text:string,entity_refs:array<string>,confidence:double,page_ref:bigint,source_excerpt:string>>, entities array<struct<entity_id:string,name:string,type:string,canonical_value:string>>, extraction_model string, processing_time_ms bigint, token_count struct<input:bigint,output:bigint>, extracted_at string",
    "lineage_snapshots": "snapshot_id string, codebase_root string, git_commit string, nodes array<struct<node_id:string,type:string,label:string,metadata:struct<path:string,language:string,purpose:string,last_modified:string>>>, edges array<struct<source:string,target:string,relationship:string,confidence:double>>, captured_at string",
    "events": "event_id string, event_type string, aggregate_id string, aggregate_type string, sequence_number bigint, payload map<string,string>, metadata struct<causation_id:string,correlation_id:string,user_id:string,source_service:string>, schema_version string, occurred_at string, recorded_at string",
    "runs": "id string, name string, run_type string, inputs map<string,string>, outputs map<string,string>, error string, start_time string, end_time string, total_tokens bigint, prompt_tokens bigint, completion_tokens bigint, total_cost double, tags array<string>, parent_run_id string, session_id string",
}
# Contract ids and owners of these datasets.
CATALOG: dict[str, tuple[str, str]] = {
    "intent_records": ("week1-intent-code-correlator", "week1-team"),
    "verdicts": ("week2-digital-courtroom", "week2-team"),
    "extractions": ("week3-document-refinery-extractions", "week3-team"),
    "lineage_snapshots": ("week4-brownfield-cartographer", "week4-team"),
    "events": ("week5-event-sourcing-platform", "week5-team"),
    "runs": ("langsmith-traces", "platform-team"),
}
SUBSCRIPTION = "contract_id string, subscriber_id string, subscriber_team string, fields_consumed array<string>, breaking_fields array<struct<field:string,reason:string>>, validation_mode string, registered_at string, contact string"


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_CORRUPT, _LINE = "_corrupt_record", "_line"


def _lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """The fields of every line that isn't blank, the line, and what of it doesn't fit the schema, or null.

    The whole schema is parsed whatever columns are asked for later, so that all questions are answered over the same lines."""
    kind = T.StructType(list((T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields)).add(_CORRUPT, "string")
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).withColumnRenamed("value", _LINE)
    # A generator, so that a filter on what it makes doesn't parse the line once more.
    parsed = lines.select(_LINE, F.inline(F.array(F.from_json(_LINE, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))))
    # A line of another kind than an object parses to nulls.
    return parsed.withColumn(_CORRUPT, F.when(F.col(_LINE).rlike(r"^\s*\{"), F.col(_CORRUPT)).otherwise(F.col(_LINE)))


def jsonl(spark: SparkSession, path: str | list[str], schema: str | None = None, missing_ok: bool = False, require_rows: bool = False) -> DataFrame:
    """One JSON object a line; blank lines, and those that don't parse or don't fit the schema, are left out: malformed() has them.

    Without a schema that of all lines is inferred. missing_ok: no file is an empty table, which needs a schema. require_rows raises
    if no line is left."""
    try:
        known = schema or T.StructType([f for f in spark.read.json(path).schema.fields if f.name != _CORRUPT])
        df = _lines(spark, path, known).where(F.col(_CORRUPT).isNull()).drop(_CORRUPT, _LINE)
    except AnalysisException:
        if not (missing_ok and schema):
            raise
        return spark.createDataFrame([], schema)
    if require_rows and df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def malformed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line: the lines that jsonl() leaves out, but for blank ones."""
    return _lines(spark, path, schema).where(F.col(_CORRUPT).isNotNull()).select(F.col(_LINE).alias("line"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line, record, wrong, unknown, broken: every line that isn't blank, and what fits of it and what doesn't, apart.

    record has the fields of the schema, null where there is none or none that can be cast. wrong maps the fields whose value can't
    be cast, unknown those that the schema doesn't have, to their JSON. broken is true for lines that aren't an object at all, one
    with a key twice among them; record is null then. The lines are parsed once, as variants."""
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).withColumnRenamed("value", "line")
    parsed = lines.select("line", F.explode(F.array(F.expr("try_variant_get(try_parse_json(line), '$', 'map<string, variant>')"))).alias("m"))
    value = lambda f: F.try_element_at("m", F.lit(f.name))
    cast = lambda f: F.try_variant_get(value(f), "$", f.dataType.simpleString())
    there = F.col("m").isNotNull()
    text = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    names = F.array(*[F.lit(f.name) for f in kind])
    wrong = [F.when(value(f).isNotNull() & ~F.is_variant_null(value(f)) & cast(f).isNull(), F.struct(F.lit(f.name).alias("k"), text(value(f)).alias("v"))) for f in kind]
    unknown = F.map_filter("m", lambda k, v: ~F.array_contains(names, k))
    return parsed.select(
        "line", F.when(there, F.struct(*[cast(f).alias(f.name) for f in kind])).alias("record"), F.when(there, F.map_from_entries(F.filter(F.array(*wrong), lambda x: x.isNotNull()))).alias("wrong"),
        F.when(there, F.transform_values(unknown, lambda k, v: text(v))).alias("unknown"), F.col("m").isNull().alias("broken"),
    )


def with_row_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """df with the place of each row as a struct that sorts in file order: file name and row for Parquet, file name, block and row for an unshuffled scan of other files. Of a table that isn't a scan the rows stand as they come."""
    path, at = F.col("_metadata.file_path"), F.monotonically_increasing_id()
    for place in (F.struct(path, F.col("_metadata.row_index")), F.struct(path, F.col("_metadata.file_block_start"), at)):
        try:
            return df.select("*", place.alias(name))
        except AnalysisException:
            continue
    return df.withColumn(name, F.struct(at.alias("at")))


def contract(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Subscriptions of a YAML registry; no file is an empty one. A breaking field may be a bare path."""
    if not Path(path).exists():
        return spark.createDataFrame([], SUBSCRIPTION)
    listed = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("subscriptions", [])
    field = lambda b: (b.get("field"), b.get("reason", "")) if isinstance(b, dict) else (b, "")
    text = lambda s, k, d=None: str(s[k]) if s.get(k) is not None else d
    rows = [(text(s, "contract_id"), text(s, "subscriber_id"), text(s, "subscriber_team", ""), s.get("fields_consumed") or [], [field(b) for b in s.get("breaking_fields") or []], text(s, "validation_mode", "AUDIT"), text(s, "registered_at"), text(s, "contact", "")) for s in listed]
    return spark.createDataFrame(rows, SUBSCRIPTION)


def snapshots(folder: str, contract_id: str, since_days: int | None = None) -> list[Path]:
    """Snapshot files of a contract, oldest first; those whose name isn't a time are kept whatever the cutoff."""

    def recent(p: Path) -> bool:
        try:
            at = datetime.strptime(p.stem[:15], "%Y%m%d_%H%M%S").replace(tzinfo=UTC)
        except ValueError:
            return True
        return since_days is None or at >= datetime.now(UTC) - timedelta(days=since_days)

    return sorted(p for p in Path(folder, contract_id).glob("*.yaml") if recent(p))


def latest_snapshot_ref(folder: str, contract_id: str) -> str | None:
    found = snapshots(folder, contract_id)
    return found[-1].name if found else None


def snapshot_schema(path: str | Path) -> dict:
    return contract(str(path)).get("schema", {})


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """Baselines kept as {"contract.column": {mean, stddev, n}}; no file is an empty table."""
    kept = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}
    rows = [(*k.rsplit(".", 1), float(v["mean"]), float(v.get("stddev") or 0), int(v.get("n", 0))) for k, v in kept.items()]
    return spark.createDataFrame(rows, "contract_id string, column string, mean double, stddev double, n bigint")


def _documents(spark: SparkSession, paths: list[Path], schema: str) -> DataFrame:
    """report, d: documents of a few KB each, read where the driver reads, which may be a folder of its own; those that don't parse or fit are left out."""
    kind = T.StructType(list(T.StructType.fromDDL(schema).fields)).add(_CORRUPT, "string")
    rows = spark.createDataFrame([(p.name, p.read_text(encoding="utf-8", errors="replace")) for p in paths], "report string, text string")
    parsed = rows.select("report", F.explode(F.array(F.from_json("text", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))).alias("d"))
    return parsed.where(F.col(f"d.{_CORRUPT}").isNull() & F.col("d").isNotNull())


REPORT = "report_id string, contract_id string, run_timestamp string, total_checks bigint, passed bigint, failed bigint, warned bigint, errored bigint, results array<struct<check_id:string,column_name:string,check_type:string,status:string,severity:string,records_failing:bigint,message:string>>"


def reports(spark: SparkSession, folder: str, pattern: str = "*.json", leave_out: tuple[str, ...] = ("ai_metrics.json",)) -> DataFrame:
    """All JSON reports of a folder, one document a file; unreadable ones are left out."""
    paths = [p for p in sorted(Path(folder).glob(pattern)) if p.name not in leave_out]
    return _documents(spark, paths, REPORT).select(*[f"d.{f.name}" for f in T.StructType.fromDDL(REPORT)])


def evolution_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of all migration reports of a folder, in the order of files and of each file's list: contract_id, change_type, column, old_value, new_value, backward_compatible, required_action, risk_level, report, report_order."""
    change = "change_type string, column string, old_value string, new_value string, backward_compatible boolean, required_action string, risk_level string"
    schema = f"contract_id string, verdict string, changes array<struct<{', '.join(x.replace(' ', ':') for x in change.split(', '))}>>"
    rows = _documents(spark, sorted(Path(folder).glob("schema_evolution_*.json")), schema).select("d.contract_id", "report", F.posexplode("d.changes").alias("pos", "c"))
    return rows.select("contract_id", "c.*", "report", F.struct("report", "pos").alias("report_order"))


def latest_report(folder: str) -> str | None:
    """The newest report by time of change."""
    found = sorted(Path(folder).glob("*.json"), key=lambda p: p.stat().st_mtime)
    return str(found[-1]) if found else None


VIOLATION = (
    "violation_id string, check_id string, contract_id string, column_name string, check_type string, severity string, status string, message string, records_failing bigint, detected_at string, "
    "blame_chain array<struct<rank:int,file_path:string,commit_hash:string,author:string,commit_timestamp:string,commit_message:string,confidence_score:double>>, "
    "blast_radius struct<affected_nodes:array<string>,affected_pipelines:array<string>,estimated_records:bigint,blast_radius_source:string>"
)


def logged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an append-only log of JSON lines, in the order of log_pos; no log is an empty one."""
    return log.read(spark, path, schema, jsonl)


def violation_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of violations with the place of each as log_pos."""
    return logged(spark, path, VIOLATION)


def document(path: str) -> dict:
    """A small JSON document; {} if there is none."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}


def rate_history(spark: SparkSession, path: str, contract_id: str) -> list[float]:
    """Violation rates of former runs of one contract, oldest first."""
    rows = logged(spark, path, "run_date string, contract_id string, violation_rate double").where(F.col("contract_id") == contract_id)
    return [r[0] for r in rows.orderBy("run_date", "log_pos").select("violation_rate").collect()]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def commits(spark: SparkSession, repo: str, files: list[str], days: int = 14) -> DataFrame:
    """COMMIT rows of the files' recent history, following renames, each file read by a task of its own; none if git can't say."""
    git.register(spark)
    return spark.read.format("git_log").option("repo", repo).option("files", json.dumps(files)).option("days", days).load()


def blamed_lines(spark: SparkSession, repo: str, path: str, first: int = 1, last: int | None = None, lines: int = git.LINES) -> DataFrame:
    """line_number, commit_hash, author_email, line of a range of a file's lines, so many of them a task."""
    git.register(spark)
    reader = spark.read.format("git_blame").option("repo", repo).option("file", path).option("first", first).option("lines", lines)
    return (reader.option("last", last) if last else reader).load()
