"""Contracts: clauses from profiles, the document around them, and its dbt form. All of it is metadata of a few KB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators.profile import KNOWN_ENUMS, detect_formats, observed_enums, profile

# Items and properties of well-known nested columns, as field -> clause.
_ID = {"type": "string", "format": "uuid", "unique": True}
_STRING = {"type": "string"}
_UNIT = {"type": "number", "minimum": 0.0, "maximum": 1.0}
KNOWN_ITEMS: dict[str, dict] = {
    "extracted_facts": {
        "fact_id": _ID,
        "text": {"type": "string", "minLength": 1},
        "entity_refs": {"type": "array", "items": {"type": "string", "format": "uuid"}},
        "confidence": _UNIT | {"required": True},
        "page_ref": {"type": "integer", "nullable": True},
        "source_excerpt": _STRING,
    },
    "entities": {"entity_id": _ID, "name": _STRING, "type": {"type": "string", "enum": KNOWN_ENUMS["entity_type"]}, "canonical_value": _STRING},
    "code_refs": {"file": _STRING, "line_start": {"type": "integer", "minimum": 1}, "line_end": {"type": "integer", "minimum": 1}, "symbol": _STRING, "confidence": _UNIT},
    "nodes": {"node_id": {"type": "string", "pattern": "^[a-z]+::.+"}, "type": {"type": "string", "enum": KNOWN_ENUMS["type"]}, "label": _STRING, "metadata": {"type": "object"}},
    "edges": {"source": _STRING, "target": _STRING, "relationship": {"type": "string", "enum": KNOWN_ENUMS["relationship"]}, "confidence": _UNIT},
}
KNOWN_PROPERTIES: dict[str, dict] = {
    "token_count": {"input": {"type": "integer", "minimum": 0}, "output": {"type": "integer", "minimum": 0}},
    "metadata": {"causation_id": {"type": "string", "nullable": True}, "correlation_id": {"type": "string", "format": "uuid"}, "user_id": _STRING, "source_service": _STRING},
}
KNOWN_VALUES: dict[str, dict] = {
    "scores": {"type": "object", "properties": {"score": {"type": "integer", "minimum": 1, "maximum": 5}, "evidence": {"type": "array", "items": _STRING}, "notes": _STRING}},
}
# What a column of this name always has, whatever was seen.
OVERRIDES: dict[str, dict] = {
    "processing_time_ms": {"minimum": 1},
    "score": {"minimum": 1, "maximum": 5},
    "extraction_model": {"pattern": "^(claude|gpt)-"},
    "overall_verdict": {"enum": KNOWN_ENUMS["overall_verdict"]},
    "run_type": {"enum": KNOWN_ENUMS["run_type"]},
}
# The pattern that goes with a format.
PATTERNS = {
    "uuid": "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "sha256": "^[a-f0-9]{64}$",
    "sha256-40": "^[a-f0-9]{40}$",
}
#: Ids that repeat by design.
FOREIGN_KEYS = ("parent_run_id", "causation_id", "correlation_id", "aggregate_id", "rubric_id", "target_ref")
#: Share of nulls from which a column isn't required, and largest integer bound that is written down.
OPTIONAL_FROM, LARGEST_BOUND = 0.01, 1_000_000


def clause(row: dict) -> dict:
    """The clause of a profile row, which may also have `format` and `enum`."""
    name, dtype = row["column"], row["dtype"]
    nulls = row["null_fraction"] or 0.0
    if dtype == "boolean":
        return {"type": "boolean"}
    out: dict = {"type": {"array_of_objects": "array", "float": "number"}.get(dtype, dtype), "required": nulls < OPTIONAL_FROM}
    if dtype == "array_of_objects":
        out["items"] = KNOWN_ITEMS.get(name) or {k: {"type": "string"} for k in row["keys"]}
    elif dtype == "object":
        if name in KNOWN_PROPERTIES:
            out["properties"] = KNOWN_PROPERTIES[name]
        if name in KNOWN_VALUES:
            out["additionalProperties"] = KNOWN_VALUES[name]
    elif dtype in ("float", "integer"):
        whole = int if dtype == "integer" else float
        if row["min"] is not None:
            out["minimum"] = whole(row["min"])
        if row["max"] is not None and (dtype == "float" or row["max"] <= LARGEST_BOUND):
            out["maximum"] = whole(row["max"])
        if dtype == "float" and "confidence" in name.lower():
            out |= {"minimum": 0.0, "maximum": 1.0, "description": "A confidence from 0 to 1; another scale breaks consumers."}
        if dtype == "integer" and name in ("processing_time_ms", "score"):
            out |= OVERRIDES[name]
    elif dtype == "string":
        if row.get("format"):
            out["format"] = row["format"]
            out |= {"pattern": PATTERNS[row["format"]]} if row["format"] in PATTERNS else {}
        if row.get("enum") and len(row["enum"]) <= 10:
            out["enum"] = list(row["enum"])
        if row.get("cardinality") == 1:
            out["unique"] = False
        if name in ("extraction_model", "overall_verdict", "run_type"):
            out |= OVERRIDES[name]
        if nulls > 0:
            out["nullable"] = True
        if row.get("format") == "uuid" and name.endswith("_id") and name not in FOREIGN_KEYS:
            out["unique"] = True
    return out


def clauses(df: DataFrame, exact: bool = True) -> tuple[dict[str, dict], list[dict]]:
    """column -> clause, and the profile rows with format and enum of strings. The table is scanned once for the profile, once for the formats, and once for the values of the columns that have few."""
    rows = [r.asDict() for r in profile(df, exact=exact).collect()]
    strings = {r["column"]: r["cardinality"] for r in rows if r["dtype"] == "string"}
    formats, enums = detect_formats(df, list(strings)), observed_enums(df, list(strings), cardinality=strings)
    for r in rows:
        if r["dtype"] == "string":
            r["format"], r["enum"] = formats[r["column"]], enums[r["column"]]
    return {r["column"]: clause(r) for r in rows}, rows


def quality_checks(table: str, rows: list[dict]) -> dict:
    """Soda-style checks that the profiles call for."""
    checks = []
    for r in rows:
        c, dtype = r["column"], r["dtype"]
        if not r["null_fraction"] and dtype not in ("array", "array_of_objects", "object"):
            checks.append(f"missing_count({c}) = 0")
        if r.get("format") == "uuid":
            checks.append(f"duplicate_count({c}) = 0")
        bounds = {"overall_score": (1.0, 5.0)} if dtype == "float" else {"processing_time_ms": (1, None), "total_tokens": (0, None)} if dtype == "integer" else {}
        if dtype == "float" and "confidence" in c.lower():
            bounds[c] = (0.0, 1.0)
        lo, hi = bounds.get(c, (None, None))
        checks += [f"min({c}) >= {lo}"] * (lo is not None) + [f"max({c}) <= {hi}"] * (hi is not None)
    return {"type": "SodaChecks", "specification": {f"checks for {table}": [*checks, "row_count >= 1"]}}


def build_contract(
    df: DataFrame,
    contract_id: str,
    table: str,
    location: str = "",
    owner: str = "platform-team",
    downstream: list[dict] | None = None,
    annotate: Callable[[str, dict], dict | None] | None = None,
    exact: bool = True,
) -> dict:
    """The contract of a table as it is now. annotate(column, profile) may add notes to strings with neither format nor enum."""
    schema, rows = clauses(df, exact)
    if annotate:
        for r in rows:
            if r["dtype"] == "string" and not r.get("format") and not r.get("enum") and (note := annotate(r["column"], r)):
                schema[r["column"]]["llm_annotations"] = note
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "kind": "DataContract",
        "apiVersion": "v3.0.0",
        "id": contract_id,
        "info": {"title": table, "version": "1.0.0", "owner": owner, "description": f"What {table} held at {now}.", "generated_at": now},
        "servers": {"local": {"type": "local", "path": location, "format": location.rsplit(".", 1)[-1] if "." in location else "parquet"}},
        "terms": {"usage": "Between systems; not for publication.", "limitations": "Confidences stay on a scale of 0 to 1."},
        "schema": schema,
        "quality": quality_checks(table, rows),
        "lineage": {"upstream": [], "downstream": list({d["id"]: d for d in reversed(downstream or [])}.values())[::-1]},
    }


def dbt_schema(contract: dict, table: str) -> dict:
    """schema.yml with not_null, unique and accepted_values."""
    columns = []
    for name, c in contract["schema"].items():
        tests: list = ["not_null"] * bool(c.get("required") and not c.get("nullable")) + ["unique"] * bool(c.get("unique"))
        tests += [{"accepted_values": {"values": c["enum"]}}] if c.get("enum") else []
        columns.append({"name": name} | ({"tests": tests} if tests else {}) | ({"description": c["description"]} if c.get("description") else {}))
    return {"version": 2, "models": [{"name": table, "description": contract["info"]["description"], "columns": columns}]}


CLAUSES = "column string, type string, required boolean, nullable boolean, unique boolean, format string, pattern string, enum array<string>, minimum double, maximum double"


def clauses_of(profiles: DataFrame) -> DataFrame:
    """CLAUSES straight from PROFILE rows, without formats and enums: types, requirement and bounds."""
    number = F.col("dtype").isin("integer", "float")
    kind = F.when(F.col("dtype") == "float", "number").when(F.col("dtype") == "array_of_objects", "array").otherwise(F.col("dtype"))
    none = lambda t: F.lit(None).cast(t)
    return profiles.select(
        "column", kind.alias("type"), (F.col("null_fraction") < OPTIONAL_FROM).alias("required"), ((F.col("dtype") == "string") & (F.col("null_fraction") > 0)).alias("nullable"),
        F.lit(False).alias("unique"), none("string").alias("format"), none("string").alias("pattern"), none("array<string>").alias("enum"),
        F.when(number, F.col("min")).alias("minimum"), F.when(number & ((F.col("dtype") == "float") | (F.col("max") <= LARGEST_BOUND)), F.col("max")).alias("maximum"),
    )


def clause_rows(spark, schema: dict[str, dict], recursive: bool = False) -> DataFrame:
    """A contract's schema as a DataFrame of CLAUSES; recursive also has the clauses of items as column[].field."""
    flat = []

    def add(name: str, c: dict) -> None:
        number = lambda k: None if c.get(k) is None else float(c[k])
        flat.append((name, c.get("type"), bool(c.get("required")), bool(c.get("nullable")), bool(c.get("unique")), c.get("format"), c.get("pattern"), [str(x) for x in c["enum"]] if c.get("enum") else None, number("minimum"), number("maximum")))
        for inner, d in (c.get("items") or {}).items() if recursive else ():
            if isinstance(d, dict):
                add(f"{name}[].{inner}", d)

    for name, c in schema.items():
        add(name, c)
    return spark.createDataFrame(flat, CLAUSES)
