"""Contract checks: every clause of a table becomes named aggregates of one fused scan and a result row made from them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import FORMATS, col, digest, fixed, is_nested, missing, numeric, pattern_error

RESULT = (
    "check_id string, column_name string, check_type string, status string, actual_value string, expected string, "
    "severity string, records_failing bigint, sample_failing array<string>, message string"
)
#: Nested columns whose items have confidences.
CONFIDENCE_COLUMNS = ("extracted_facts", "entities", "nodes", "edges", "code_refs")


def outcome(check_id: str, column: str, kind: str, status: Column, actual: Column, expected: str | Column, severity: Column, failing: Column, message: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(check_id).alias("check_id"), F.lit(column).alias("column_name"), F.lit(kind).alias("check_type"), status.alias("status"),
        actual.cast("string").alias("actual_value"), as_column(expected).cast("string").alias("expected"), severity.alias("severity"),
        failing.cast("bigint").alias("records_failing"), F.array().cast("array<string>").alias("sample_failing"), message.cast("string").alias("message"),
    )


def _counted(check_id: str, column: str, kind: str, bad: Column, label: str, expected: str, severity: str) -> Column:
    """PASS at 0, else FAIL with the count."""
    ok = bad == 0
    return outcome(
        check_id, column, kind, F.when(ok, "PASS").otherwise("FAIL"), F.concat(F.lit(f"{label}="), bad.cast("string")), expected,
        F.when(ok, "LOW").otherwise(severity), bad, F.when(ok, "").otherwise(F.concat(F.lit(f"{column}: "), bad.cast("string"), F.lit(f" values fail {kind} ({expected})."))),
    )


def _constant(check_id: str, column: str, kind: str, status: str, message: str) -> Column:
    severity = "ERROR" if status == "ERROR" else "LOW"
    return outcome(check_id, column, kind, F.lit(status), F.lit("N/A"), "N/A", F.lit(severity), F.lit(0), F.lit(message))


def bound_error(clause: dict) -> str | None:
    """What is wrong with the bounds of a clause that aren't numbers, or None."""
    wrong = [f"{k}={clause[k]!r}" for k in ("minimum", "maximum") if clause.get(k) is not None and (isinstance(clause[k], bool) or not isinstance(clause[k], (int, float)))]
    return f"not a number: {', '.join(wrong)}" if wrong else None


def violates(kind: str, clause: dict, c: Column, field: T.DataType) -> Column | None:
    """Whether a value breaks this part of its clause; null for missing values; None if the clause has no such part."""
    text = c.cast("string")
    if kind == "required":
        return missing(c, field) if clause.get("required") and not clause.get("nullable") else None
    there = ~missing(c, field)
    if kind == "format" and clause.get("format") in FORMATS:
        return there & ~text.rlike(FORMATS[clause["format"]])
    if kind == "pattern" and clause.get("pattern"):
        return there & ~text.rlike(clause["pattern"])
    if kind == "enum" and clause.get("enum"):
        allowed = clause["enum"]
        if isinstance(field, (T.FloatType, T.DoubleType)) and all(re.fullmatch(r"[+-]?\d+(\.\d+)?", str(x)) for x in allowed):
            return there & ~c.cast("double").isin([float(x) for x in allowed])
        # The engine writes booleans in lower case.
        return there & ~text.isin([str(x).lower() if isinstance(field, T.BooleanType) else str(x) for x in allowed])
    if kind == "length" and (clause.get("minLength") is not None or clause.get("maxLength") is not None):
        n = F.length(text)
        return there & ((n < F.lit(clause.get("minLength") or 0)) | (n > F.lit(clause.get("maxLength", 2**31 - 1))))
    if kind == "range" and not bound_error(clause) and (clause.get("minimum") is not None or clause.get("maximum") is not None):
        x = numeric(c, field)
        low = x < clause["minimum"] if clause.get("minimum") is not None else F.lit(False)
        high = x > clause["maximum"] if clause.get("maximum") is not None else F.lit(False)
        return x.isNotNull() & (low | high)
    return None


def _column_checks(contract_id: str, name: str, clause: dict, field: T.DataType, tag: str) -> tuple[list[Column], list[Column]]:
    """Aggregates of a column, and its result structs over them."""
    c, aggs, out = col(name), [], []
    at = lambda kind: f"{contract_id}.{name}.{kind}"

    def counted(kind: str, label: str, expected: str, severity: str, otherwise: str) -> None:
        bad = violates(kind, clause, c, field)
        if bad is None:
            out.append(_constant(at(kind), name, kind, "PASS", otherwise))
        else:
            aggs.append(F.count_if(bad).alias(tag + kind))
            out.append(_counted(at(kind), name, kind, F.col(tag + kind), label, expected, severity))

    counted("required", "null_count", "null_count=0", "CRITICAL", "")
    if is_nested(field):
        return aggs, out
    if not clause.get("unique"):
        out.append(_constant(at("unique"), name, "unique", "PASS", "Uniqueness not required."))
    counted("format", "invalid_format", f"format={clause.get('format')}", "HIGH", "No format check required.")
    wrong = pattern_error(clause.get("pattern") or "")
    if wrong:
        out.append(_constant(at("pattern"), name, "pattern", "ERROR", f"The pattern can't be compiled: {wrong}"))
    else:
        counted("pattern", "pattern_fails", f"pattern={clause.get('pattern')}", "HIGH", "No pattern check required.")
    counted("enum", "invalid_values", f"allowed={clause.get('enum')}", "CRITICAL", "No enum check required.")
    bad = violates("range", clause, c, field)
    if bound_error(clause):
        out.append(_constant(at("range"), name, "range", "ERROR", f"A bound is {bound_error(clause)}"))
    elif bad is None:
        out.append(_constant(at("range"), name, "range", "PASS", "No range check required."))
    else:
        x = numeric(c, field)
        aggs += [F.count_if(bad).alias(tag + "range"), F.count(x).alias(tag + "x"), F.min(x).alias(tag + "lo"), F.max(x).alias(tag + "hi"), F.avg(x).alias(tag + "mean")]
        n, empty = F.col(tag + "range"), F.col(tag + "x") == 0
        lo, hi, mean = (fixed(F.col(tag + k)) for k in ("lo", "hi", "mean"))
        confident = "confidence" in name.lower()
        scale = F.when(F.col(tag + "hi") > 1.0, " Looks like a scale of 0 to 100.").otherwise("") if confident else F.lit("")
        out.append(
            outcome(
                at("range"), name, "range", F.when(empty, "ERROR").when(n > 0, "FAIL").otherwise("PASS"),
                F.when(empty, "N/A").when(n > 0, F.concat(F.lit("min="), lo, F.lit(", max="), hi, F.lit(", mean="), mean)).otherwise(F.concat(F.lit("min="), lo, F.lit(", max="), hi)),
                F.when(empty, "N/A").otherwise(f"min>={clause.get('minimum')}, max<={clause.get('maximum')}"),
                F.when(empty, "ERROR").when(n > 0, "CRITICAL" if confident else "HIGH").otherwise("LOW"), n,
                F.when(empty, f"No numeric values in {name}").when(n > 0, F.concat(F.lit(f"{name} is outside its range: ["), lo, F.lit(", "), hi, F.lit("]."), scale)).otherwise(""),
            )
        )
    return aggs, out


def _confidence_check(contract_id: str, name: str, field: T.DataType, tag: str) -> tuple[list[Column], list[Column]]:
    """Confidences inside an array of objects, without exploding it; no result if there are none."""
    if not (isinstance(field, T.ArrayType) and isinstance(field.elementType, T.StructType) and "confidence" in field.elementType.names):
        return [], []
    kind = field.elementType["confidence"].dataType
    values = F.filter(F.transform(col(name), lambda x: numeric(x["confidence"], kind)), lambda v: v.isNotNull())
    bad = F.filter(values, lambda v: (v < 0.0) | (v > 1.0))
    size = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("bigint")
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    aggs = [F.sum(size(values)).alias(tag + "cn"), F.sum(size(bad)).alias(tag + "cbad"), F.min(F.array_min(values)).alias(tag + "clo"), F.max(F.array_max(values)).alias(tag + "chi"), F.sum(total).alias(tag + "csum")]
    n, lo, hi, mean = F.col(tag + "cbad"), fixed(F.col(tag + "clo")), fixed(F.col(tag + "chi")), fixed(F.col(tag + "csum") / F.col(tag + "cn"))
    scale = F.when(F.col(tag + "chi") > 1.0, " Looks like a scale of 0 to 100.").otherwise(" Some are negative.")
    found = outcome(
        f"{contract_id}.{name}.confidence.range", f"{name}[*].confidence", "range", F.when(n > 0, "FAIL").otherwise("PASS"),
        F.when(n > 0, F.concat(F.lit("max="), hi, F.lit(", mean="), mean)).otherwise(F.concat(F.lit("min="), lo, F.lit(", max="), hi)), "max<=1.0, min>=0.0",
        F.when(n > 0, "CRITICAL").otherwise("LOW"), n, F.when(n > 0, F.concat(F.lit(f"{name}[*].confidence is outside 0 to 1: ["), lo, F.lit(", "), hi, F.lit("]."), scale)).otherwise(""),
    )
    return aggs, [F.when(F.col(tag + "cn") > 0, found)]


def table_parts(schema: T.StructType, contract: dict) -> tuple[list[Column], list[Column], list[str]]:
    """Aggregates of a contract's clauses, the result structs over them, and the unique columns, which are counted apart: with a distinct count among them, one aggregation would shuffle a row with all its counts for every value, and with two repeat every row."""
    contract_id, fields = contract["id"], {f.name: f.dataType for f in schema.fields}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    results: list[Column] = []
    apart = [n for n, c in contract["schema"].items() if c.get("unique") and n in fields and not is_nested(fields[n])]
    for i, (name, clause) in enumerate(contract["schema"].items()):
        if name not in fields:
            results.append(_constant(f"{contract_id}.{name}.exists", name, "exists", "ERROR", f"Column {name} isn't in the data."))
            continue
        own, out = _column_checks(contract_id, name, clause, fields[name], f"c{i}_")
        if name in CONFIDENCE_COLUMNS:
            more, nested = _confidence_check(contract_id, name, fields[name], f"c{i}_")
            own, out = own + more, out + nested
        aggs += own
        results += out
    return aggs, results, apart


def check_table(df: DataFrame, contract: dict, more: tuple[tuple[Column, Column], ...] = ()) -> DataFrame:
    """RESULT rows of a contract's clauses over df: one scan, one aggregation, one row for each check.

    Unique columns are counted each in its own plan, which reads that column alone. `more` are further aggregates of df, each with the result struct over it, for the same scan."""
    aggs, results, apart = table_parts(df.schema, contract)
    found = df.agg(*aggs, *[a for a, _ in more]).select(F.inline(F.filter(F.array(*results, *[r for _, r in more]), lambda r: r.isNotNull())))
    return reduce(DataFrame.unionByName, unique_apart(df, contract, apart), found)


def unique_apart(df: DataFrame, contract: dict, names: list[str]) -> list[DataFrame]:
    """RESULT rows of unique columns, each from a plan of its own, which reads that column alone."""
    out = []
    for name in names:
        field = df.schema[name].dataType
        x = F.when(~missing(col(name), field), digest(col(name), field))
        out.append(_one(df.agg((F.count(x) - F.count_distinct(x)).alias("n")), f"{contract['id']}.{name}.unique", name, "unique", "duplicates", "duplicates=0", "CRITICAL"))
    return out


def failing_rows(df: DataFrame, contract: dict, column: str, kind: str) -> DataFrame:
    """The rows that break one check of a column; for `unique`, those whose value occurs before them in their group."""
    field, clause = df.schema[column].dataType, contract["schema"][column]
    if kind == "unique":
        again = df.where(~missing(col(column), field)).groupBy(col(column).alias("v")).agg(F.count("*").alias("n")).where("n > 1")
        return df.join(again, col(column) == F.col("v"), "left_semi")
    bad = violates(kind, clause, col(column), field)
    return df.where(bad if bad is not None else F.lit(False))


def with_samples(results: DataFrame, df: DataFrame, contract: dict, order: list[str] | None = None, n: int = 3) -> DataFrame:
    """The results, with the first failing values of those that fail; only these cost another scan each."""
    failed = [(r["check_id"], r["column_name"], r["check_type"]) for r in results.where("status = 'FAIL'").select("check_id", "column_name", "check_type").collect()]
    sampled = []
    for check_id, column, kind in failed:
        if column in df.columns and kind in ("required", "unique", "format", "pattern", "enum", "range"):
            rows = failing_rows(df, contract, column, kind)
            rows = rows.orderBy(*order) if order else rows
            sampled.append((check_id, [str(r[0]) for r in rows.select(col(column).cast("string")).limit(5 if kind == "unique" else n).collect()]))
    if not sampled:
        return results
    extra = df.sparkSession.createDataFrame(sampled, "check_id string, samples array<string>")
    # One row a failed check, from a list on the driver.
    met = results.join(F.broadcast(extra), "check_id", "left").withColumn("sample_failing", F.coalesce("samples", "sample_failing"))
    return met.select(*results.columns)


def enforce(results: DataFrame, mode: str | Column) -> DataFrame:
    """ENFORCE leaves results as they are; WARN and AUDIT turn FAIL into WARN and INFO and say so in the message."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    soft = (F.col("status") == "FAIL") & mode.isin("WARN", "AUDIT")
    return results.withColumn("message", F.when(soft, F.concat(F.lit("["), mode, F.lit(" mode] "), F.col("message"))).otherwise(F.col("message"))).withColumn(
        "status", F.when(soft & (mode == "WARN"), "WARN").when(soft, "INFO").otherwise(F.col("status"))
    )


def rollup(results: DataFrame) -> DataFrame:
    """total_checks, passed, failed, warned (WARN and INFO), errored."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return results.agg(F.count("*").alias("total_checks"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("WARN", "INFO").alias("warned"), n("ERROR").alias("errored"))


def _one(df: DataFrame, check_id: str, column: str, kind: str, label: str, expected: str, severity: str) -> DataFrame:
    return df.select(F.inline(F.array(_counted(check_id, column, kind, F.col("n"), label, expected, severity))))


def references_part(schema: T.StructType, contract_id: str, facts: str = "extracted_facts", refs: str = "entity_refs", entities: str = "entities", key: str = "entity_id") -> tuple[Column, Column]:
    """The aggregate of references() and its result struct, for check_table's scan."""
    known = F.coalesce(F.transform(col(entities), lambda e: e[key]), F.array().cast("array<string>"))
    used = F.flatten(F.transform(F.coalesce(col(facts), F.array().cast(schema[facts].dataType)), lambda f: F.coalesce(f[refs], F.array().cast("array<string>"))))
    bad = F.size(F.filter(used, lambda r: ~F.coalesce(F.array_contains(known, r), F.lit(False))))
    found = _counted(f"{contract_id}.{facts}.{refs}.referential", f"{facts}[*].{refs}", "referential_integrity", F.col("dangling_refs"), "dangling", "dangling=0", "HIGH")
    return F.coalesce(F.sum(bad), F.lit(0)).alias("dangling_refs"), found


def references(df: DataFrame, contract_id: str, **names: str) -> DataFrame:
    """References inside a record to entities that it doesn't have; repeats count, a null list of entities is an empty one."""
    bad, found = references_part(df.schema, contract_id, **names)
    return df.agg(bad).select(F.inline(F.array(found)))


def dangling(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """n: rows whose key the other table doesn't have."""
    return df.join(other.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("dangling"))


def non_increasing(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """bad: groups in which a value doesn't exceed the one before it in the given order."""
    before = F.lag(col(value)).over(Window.partitionBy(col(group)).orderBy(*order))
    return df.select(col(group).alias("g"), col(value).alias("v"), before.alias("before")).where("v <= before").agg(F.count_distinct("g").alias("bad"))


def monotonic(df: DataFrame, contract_id: str, order: list[str], group: str = "aggregate_id", value: str = "sequence_number") -> DataFrame:
    """Groups in which a value doesn't exceed the one before it. The order is that of the file (readers.with_row_order) where rows are to be taken as they were written; sorting by the value itself would find only repeats."""
    if value in order:
        raise ValueError("an order by the value itself finds no value that is out of order")
    bad = non_increasing(df, group, value, order).withColumnRenamed("bad", "n")
    return _one(bad, f"{contract_id}.{value}.monotonic", value, "monotonic_sequence", "aggregates", "aggregates=0", "CRITICAL")


def temporal_part(contract_id: str, before: str, after: str) -> tuple[Column, Column]:
    """The aggregate of temporal_order() and its result struct, for check_table's scan."""
    a, b = col(before).cast("string"), col(after).cast("string")
    name = f"{after}_before_{before}"
    found = _counted(f"{contract_id}.{after}.temporal_order", after, "temporal_order", col(name), "out_of_order", f"{after} >= {before}", "HIGH")
    return F.count_if((a != "") & (b != "") & (b < a)).alias(name), found


def temporal_order(df: DataFrame, contract_id: str, before: str, after: str) -> DataFrame:
    """Rows whose `after` is less than their `before`, as strings; nulls and empty strings are left out."""
    bad, found = temporal_part(contract_id, before, after)
    return df.agg(bad).select(F.inline(F.array(found)))


def inject_scale_fault(df: DataFrame, column: str = "extracted_facts", field: str = "confidence") -> DataFrame:
    """Confidences of 0 to 1 on a scale of 0 to 100, to see the checks fail."""
    scaled = lambda x: x.withField(field, F.when(x[field] <= 1.0, F.bround(x[field] * 100, 1)).otherwise(x[field]))
    return df.withColumn(column, F.transform(col(column), scaled))
