"""Clauses inside nested columns: arrays, structs and maps to any depth, checked in the record without exploding it.

A clause's `items` are the clause of an array's values (one with a `type`) or the fields of its objects; `properties` are the fields
of an object, `additionalProperties` the clause of a map's values, or false where no other keys are allowed. Each check becomes a
function from a value to the number of bad values in it, put together on the way down: arrays and maps add up their items, structs
go on with a field. A record's count is summed in the one scan that all of them share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.expressions import col, digest, is_nested, missing, pattern_error
from clausewright.operators.checks import RESULT, _constant, _counted, bound_error, violates

#: Checks of a value inside a column, and how grave it is to fail them.
KINDS = {"required": "CRITICAL", "format": "HIGH", "pattern": "HIGH", "enum": "CRITICAL", "range": "HIGH", "length": "HIGH"}


@dataclass
class Check:
    """A check of everything at a path. bad: the number of bad values in a value at the path's start; values: their digests, for `unique`; error: why it can't be made."""

    path: str
    kind: str
    severity: str
    bad: Callable[[Column], Column] | None = None
    values: Callable[[Column], Column] | None = None
    error: str | None = None

    def within(self, step: str, bad: Callable, values: Callable) -> Check:
        """The same check seen from one level further out."""
        return Check(
            step + self.path, self.kind, self.severity, self.bad and (lambda x, f=self.bad: bad(x, f)), self.values and (lambda x, f=self.values: values(x, f)), self.error
        )


def _fields(clause: dict) -> dict[str, dict]:
    return {k: c for k, c in (clause.get("properties") or {}).items() if isinstance(c, dict)}


def _items(clause: dict) -> dict | None:
    """The clause of an array's values."""
    items = clause.get("items")
    if not isinstance(items, dict) or not items:
        return None
    return items if isinstance(items.get("type"), str) else {"type": "object", "properties": items}


def _none(kind: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(kind))


def _over(elements: Callable[[Column], Column]) -> tuple[Callable, Callable]:
    """Sums and digests over the elements of a value."""
    bad = lambda x, f: F.aggregate(elements(x), F.lit(0).cast("bigint"), lambda s, e: s + f(e))
    values = lambda x, f: F.flatten(F.transform(elements(x), lambda e: f(e)))
    return bad, values


def _leaf(clause: dict, kind: T.DataType) -> Iterator[Check]:
    for name, severity in KINDS.items():
        if name == "pattern" and clause.get("pattern") and (wrong := pattern_error(clause["pattern"])):
            yield Check("", name, severity, error=f"The pattern can't be compiled: {wrong}")
        elif name == "range" and (wrong := bound_error(clause)):
            yield Check("", name, severity, error=f"A bound is {wrong}")
        elif (name == "required" or not is_nested(kind)) and violates(name, clause, F.lit(None).cast(kind), kind) is not None:
            yield Check("", name, severity, bad=lambda x, name=name: F.when(F.coalesce(violates(name, clause, x, kind), F.lit(False)), 1).otherwise(0).cast("bigint"))
    if clause.get("unique") and not is_nested(kind):
        yield Check("", "unique", "CRITICAL", values=lambda x: F.array(F.when(~missing(x, kind), digest(x, kind))))


def checks_in(clause: dict, kind: T.DataType) -> Iterator[Check]:
    """The checks of a value with that clause and everything in it."""
    yield from _leaf(clause, kind)
    if isinstance(kind, T.ArrayType) and (inner := _items(clause)):
        bad, values = _over(lambda x: F.coalesce(x, _none(kind.elementType)))
        for c in checks_in(inner, kind.elementType):
            yield c.within("[]", bad, values)
    if isinstance(kind, T.StructType):
        known = _fields(clause)
        for name, inner in known.items():
            if name not in kind.names:
                if inner.get("required"):
                    yield Check(f".{name}", "exists", "ERROR", error="The field isn't in the data.")
                continue
            # A field of an object that isn't there isn't missing.
            for c in checks_in(inner, kind[name].dataType):
                yield c.within(f".{name}", lambda x, f, name=name: F.when(x.isNotNull(), f(x[name])).otherwise(0).cast("bigint"), lambda x, f, name=name: f(x[name]))
        if clause.get("additionalProperties") is False:
            for name in [n for n in kind.names if n not in known]:
                yield Check(f".{name}", "unexpected", "HIGH", bad=lambda x, name=name: F.when(x[name].isNotNull(), 1).otherwise(0).cast("bigint"))
    if isinstance(kind, T.MapType):
        more, known = clause.get("additionalProperties"), _fields(clause)
        for name, inner in known.items():
            value = lambda x, name=name: F.try_element_at(x, F.lit(name))
            for c in checks_in(inner, kind.valueType):
                yield c.within(f".{name}", lambda x, f, value=value: F.when(x.isNotNull(), f(value(x))).otherwise(0).cast("bigint"), lambda x, f, value=value: f(value(x)))
        other = lambda x: F.map_filter(x, lambda k, v: ~k.cast("string").isin(list(known))) if known else x
        if more is False:
            yield Check("{}", "unexpected", "HIGH", bad=lambda x: F.coalesce(F.cardinality(other(x)), F.lit(0)).cast("bigint"))
        elif isinstance(more, dict):
            bad, values = _over(lambda x: F.coalesce(F.map_values(other(x)), _none(kind.valueType)))
            for c in checks_in(more, kind.valueType):
                yield c.within("{}", bad, values)


def nested_checks(df: DataFrame, contract: dict) -> DataFrame:
    """RESULT rows of everything that the contract says of the inside of nested columns, which check_table leaves alone; one scan.

    Paths are written as `lines[].price`, `scores{}.value`, `size.width`. Counted are bad values, not records. `required` fails on
    a null in an array, map or object that is there. `unique` holds within a record: surplus values of all that the path reaches in
    it. Patterns and bounds that can't be used, and required fields that the type doesn't have, are ERROR rows. Columns that aren't in
    the data are left to check_table."""
    aggs: list[Column] = []
    results: list[Column] = []
    for name, clause in contract["schema"].items():
        if name not in df.columns or not is_nested(kind := df.schema[name].dataType):
            continue
        for c in checks_in({k: v for k, v in clause.items() if k not in ("required", "unique")}, kind):
            check_id, shown = f"{contract['id']}.{name}{c.path}.{c.kind}", f"{name}{c.path}".replace("[]", "[*]").replace("{}", "{*}")
            if c.error:
                results.append(_constant(check_id, shown, c.kind, "ERROR", c.error))
                continue
            if c.values:
                there = F.filter(c.values(col(name)), lambda v: v.isNotNull())
                n = F.coalesce(F.size(there) - F.size(F.array_distinct(there)), F.lit(0))
            else:
                n = c.bad(col(name))
            aggs.append(F.coalesce(F.sum(n), F.lit(0)).alias(f"n{len(aggs)}"))
            results.append(_counted(check_id, shown, c.kind, F.col(f"n{len(aggs) - 1}"), "bad_items", "bad_items=0", c.severity))
    if not results:
        return df.sparkSession.createDataFrame([], RESULT)
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*results)))
