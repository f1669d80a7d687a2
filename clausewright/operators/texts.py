"""The check texts of a contract, run: each is one metric compared with a number, over all rows or those of a condition.

    missing_count(order_id) = 0
    max(price) <= 400000 where status = 'F'
    row_count between 1 and 1000000

A text has one form, so one expression takes it apart; the condition behind `where` is a condition of the engine's own SQL. All
metrics are aggregates of one scan. Duplicates need the values of a column together, so each has a plan that reads that column alone."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import col, digest, missing, numeric
from clausewright.operators.checks import RESULT, _constant, outcome

_NUMBER = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_TEXT = re.compile(
    rf"\s*(?P<metric>[a-z_]+)\s*(?:\(\s*(?P<column>[^)]*?)\s*\))?\s*(?:(?P<op>=|==|!=|<>|<=|>=|<|>)\s*(?P<bound>{_NUMBER})|between\s+(?P<low>{_NUMBER})\s+and\s+(?P<high>{_NUMBER}))(?:\s+where\s+(?P<where>.+?))?\s*", re.S
)
#: Metrics of a column, and whether they are counts that grow with bad rows.
COUNTS = {"missing_count": "CRITICAL", "duplicate_count": "CRITICAL"}
MEASURES = ("missing_percent", "distinct_count", "min", "max", "avg", "sum", "stddev", "min_length", "max_length")


@dataclass
class Text:
    """A check text, taken apart. bounds: low, whether low itself is allowed, high, whether high is; for != the number that is not allowed."""

    metric: str
    column: str | None
    bounds: tuple[float | None, bool, float | None, bool]
    other_than: float | None
    where: str | None


def parse(text: str) -> Text:
    """Raises ValueError on what isn't a check text."""
    m = _TEXT.fullmatch(text)
    if not m:
        raise ValueError("not of the form: metric(column) comparison number [where condition]")
    metric, column = m["metric"], m["column"] or None
    if metric != "row_count" and metric not in COUNTS and metric not in MEASURES:
        raise ValueError(f"unknown metric {metric}")
    if (metric == "row_count") != (column is None):
        raise ValueError(f"{metric} {'takes no' if column else 'needs a'} column")
    if m["low"]:
        return Text(metric, column, (float(m["low"]), True, float(m["high"]), True), None, m["where"])
    x, op = float(m["bound"]), m["op"]
    bounds = {"=": (x, True, x, True), "==": (x, True, x, True), "<=": (None, True, x, True), "<": (None, True, x, False), ">=": (x, True, None, True), ">": (x, False, None, True)}
    return Text(metric, column, bounds.get(op, (None, True, None, True)), x if op in ("!=", "<>") else None, m["where"])


def _holds(value: Column, t: Text) -> Column:
    low, low_in, high, high_in = t.bounds
    tests = [value != t.other_than] if t.other_than is not None else []
    tests += [value >= low if low_in else value > low] if low is not None else []
    tests += [value <= high if high_in else value < high] if high is not None else []
    return reduce(lambda a, b: a & b, tests)


def _metric(t: Text, field: T.DataType | None, within: Column) -> tuple[Column, Column]:
    """The aggregate of a metric, and that of the rows that take it out of its bounds, where single rows do."""
    only = lambda x: F.when(within, x)
    none = F.lit(0).cast("bigint")
    if t.metric == "row_count":
        return F.count_if(within), none
    c = col(t.column)
    gone = F.count_if(within & missing(c, field))
    if t.metric == "missing_count":
        return gone, gone
    if t.metric == "missing_percent":
        return 100.0 * gone / F.nullif(F.count_if(within), F.lit(0)), gone
    if t.metric == "distinct_count":
        return F.count_distinct(only(F.when(~missing(c, field), digest(c, field)))), none
    if t.metric == "duplicate_count":
        x = only(F.when(~missing(c, field), digest(c, field)))
        return F.count(x) - F.count_distinct(x), F.count(x) - F.count_distinct(x)
    x = only(F.length(c.cast("string"))) if t.metric.endswith("_length") else only(numeric(c, field))
    value = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "stddev": F.stddev_samp}[t.metric.split("_")[0]](x)
    # A least or greatest value out of its bounds is one for each row beyond them.
    return value, F.count_if(x.isNotNull() & ~_holds(x, t)) if t.metric.split("_")[0] in ("min", "max") else none


def _result(check_id: str, text: str, t: Text, value: Column, failing: Column) -> Column:
    value = value.cast("double")
    empty, ok = value.isNull(), _holds(value, t)
    severity = COUNTS.get(t.metric, "HIGH")
    whole = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    return outcome(
        check_id, t.column or "*", t.metric, F.when(empty, "ERROR").when(ok, "PASS").otherwise("FAIL"), F.when(empty, "N/A").otherwise(F.concat(F.lit(f"{t.metric}="), whole)), text,
        F.when(empty, "ERROR").when(ok, "LOW").otherwise(severity), F.when(empty | ok, F.lit(0).cast("bigint")).otherwise(failing), F.when(empty, "No values to measure.").when(ok, "").otherwise(F.concat(F.lit(f"{text}: it is "), whole, F.lit("."))),
    )


def texts_of(contract: dict) -> list[str]:
    """The check texts of a contract, of all its tables."""
    return [t for listed in ((contract.get("quality") or {}).get("specification") or {}).values() for t in listed]


def check_texts(df: DataFrame, contract: dict, texts: list[str] | None = None) -> DataFrame:
    """RESULT rows of the contract's check texts, or of those given, over df.

    A text of another form, of a column that isn't there or with a condition that the engine refuses is an ERROR row, and so is a
    metric without values to measure; a condition that is null for a row leaves it out. Repeated texts give one row each."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs, results, apart = [], [], []
    for i, text in enumerate(texts_of(contract) if texts is None else texts):
        check_id = f"{contract['id']}.quality.{i}"
        try:
            t = parse(text)
            if t.column and t.column not in fields:
                raise ValueError(f"column {t.column} isn't in the data")
            within = F.coalesce(F.expr(t.where).cast("boolean"), F.lit(False)) if t.where else F.lit(True)
            if t.where:
                df.select(within)
        except (ValueError, PySparkException) as e:
            results.append(_constant(check_id, "*", "quality", "ERROR", f"{text}: {str(e).splitlines()[0]}"))
            continue
        value, failing = _metric(t, fields.get(t.column), within)
        if t.metric in ("duplicate_count", "distinct_count"):
            apart.append(df.agg(value.alias("v"), failing.alias("n")).select(F.inline(F.array(_result(check_id, text, t, F.col("v"), F.col("n"))))))
        else:
            aggs += [value.alias(f"v{i}"), failing.alias(f"n{i}")]
            results.append(_result(check_id, text, t, F.col(f"v{i}"), F.col(f"n{i}")))
    fused = [df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*results)))] if results else []
    return reduce(DataFrame.unionByName, fused + apart) if fused or apart else df.sparkSession.createDataFrame([], RESULT)
