"""Schema evolution: a full outer join of two contracts' clauses, classified, and what it means for subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.expressions import root

# Change type, whether consumers survive it, what is to be done, risk.
TAXONOMY: list[tuple[str, bool | None, str, str]] = [
    ("add_nullable_column", True, "None; consumers can leave the new column aside.", "LOW"),
    ("add_required_column", False, "Agree with all producers, give a default or a migration; hold deployment until all have it.", "CRITICAL"),
    ("rename_column", False, "Keep the old name as an alias for a deprecation period and tell all consumers.", "CRITICAL"),
    ("type_widening", True, "Check that no precision is lost and that the statistics still hold.", "MEDIUM"),
    ("type_narrowing", False, "Needs a migration plan with rollback, a blast radius report and new baselines.", "CRITICAL"),
    ("remove_column", False, "Deprecate first; each affected consumer has to agree to the removal.", "CRITICAL"),
    ("add_enum_value", True, "Tell all consumers.", "LOW"),
    ("remove_enum_value", False, "Breaking; needs a blast radius report.", "HIGH"),
    ("range_tightened", False, "Producers may fall outside; needs a migration plan.", "HIGH"),
    ("range_widened", True, "None; a wider range is compatible.", "LOW"),
    ("pattern_changed", False, "Data may not match any more; validate all producers.", "HIGH"),
    ("description_changed", True, "Documentation only.", "LOW"),
    ("unknown", None, "Look at it by hand.", "MEDIUM"),
]
WIDENING = [("integer", "number"), ("float", "number"), ("integer", "string"), ("number", "string")]
CHANGE = "change_type string, column string, old_value string, new_value string, backward_compatible boolean, required_action string, risk_level string"

# What a breaking change does to a consumer and what the consumer does, with its column, old and new values, subscriber, team, contact and mode.
FAILURE_TEXT: dict[str, str] = {
    "type_narrowing": "Reads '{column}' as {old}; values of type {new} no longer fit.",
    "remove_column": "Depends on '{column}', which is gone; reads and joins on it find nothing.",
    "rename_column": "Refers to '{column}' by its old name; queries on it fail at once.",
    "range_tightened": "May have values of '{column}' in the old range {old} that {new} rejects.",
    "add_required_column": "Doesn't fill '{column}' yet; records without it are rejected.",
    "remove_enum_value": "May have values of '{column}' that are no longer allowed.",
    "pattern_changed": "Has values of '{column}' after the old pattern; the new one may reject them.",
}
ACTION_TEXT: dict[str, str] = {
    "type_narrowing": "Make {subscriber} read the new type of '{column}', validate again in {mode} mode and tell {contact}.",
    "remove_column": "Take '{column}' out of {subscriber} before deployment; agree on a window with {team} ({contact}).",
    "rename_column": "Move {subscriber} to the new name behind an alias; drop the old one once {team} has migrated.",
    "range_tightened": "Look for values of '{column}' outside the new range in {subscriber}, and run in WARN mode before enforcing.",
    "add_required_column": "Fill '{column}' in all records of {subscriber}; backfill old ones or give a default.",
    "remove_enum_value": "Look for removed values of '{column}' in {subscriber} and remap them.",
    "pattern_changed": "Validate '{column}' of {subscriber} against the new pattern.",
}


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "change_type string, backward_compatible boolean, required_action string, risk_level string")


def type_change(old: Column, new: Column) -> Column:
    wide = F.concat_ws(">", old, new).isin([f"{a}>{b}" for a, b in WIDENING])
    return F.when(old != new, F.when(wide, "type_widening").otherwise("type_narrowing"))


def range_change(old_min: Column, old_max: Column, new_min: Column, new_max: Column) -> Column:
    """Tightened if any bound moved inwards or appeared, else widened if any moved at all."""
    tighter = F.coalesce(new_min > old_min, F.lit(False)) | F.coalesce(new_max < old_max, F.lit(False)) | (old_min.isNull() & new_min.isNotNull()) | (old_max.isNull() & new_max.isNotNull())
    same = old_min.eqNullSafe(new_min) & old_max.eqNullSafe(new_max)
    return F.when(~same, F.when(tighter, "range_tightened").otherwise("range_widened"))


def _values(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.sort_array(a), ", "), F.lit("]"))


#: Share of values in common from which columns may be one, and how far their shares of nulls, and the means of their values' hashes (0 to 1), may be apart.
COMMON, NULLS_APART, MEANS_APART = 0.5, 0.05, 0.02


def value_sketches(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """column, type, theta, nulls, mean, error of each of the columns (name -> contract type), from one aggregation.

    theta keeps the smallest hashes of the values, a few thousand at most, and mean is that of all values' hashes on a scale of 0 to 1:
    it tells apart columns with the same few values in other shares. error is its standard error."""
    aggs, rows = [], []
    for i, (c, kind) in enumerate(columns.items()):
        text = F.col(f"`{c}`").cast("string")
        u = F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(1 << 31)) / float(1 << 31))
        aggs += [F.theta_sketch_agg(text).alias(f"t{i}"), F.avg(text.isNull().cast("double")).alias(f"n{i}"), F.avg(u).alias(f"m{i}"), (F.stddev_pop(u) / F.sqrt(F.nullif(F.count(u), F.lit(0)))).alias(f"e{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(f"t{i}").alias("theta"), F.col(f"n{i}").alias("nulls"), F.col(f"m{i}").alias("mean"), F.col(f"e{i}").alias("error")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def renames(old: DataFrame, new: DataFrame, removed: dict[str, str], added: dict[str, str]) -> list[tuple[str, str]]:
    """The removed columns of old and added ones of new (name -> contract type) that are one under two names, best first.

    Columns are alike if they have one type, most of their values in common, in like shares, and about as many nulls. Each is matched once,
    the best pairs first, ties by name. What is compared are sketches, a row for each column."""
    if not removed or not added:
        return []
    side = lambda df, cs, x: value_sketches(df, cs).select("type", *[F.col(c).alias(f"{c}_{x}") for c in ("column", "theta", "nulls", "mean", "error")])
    size = F.theta_sketch_estimate
    common = size(F.theta_intersection("theta_a", "theta_b")) / F.nullif(size(F.theta_union("theta_a", "theta_b")), F.lit(0))
    apart = F.abs(F.col("mean_a") - F.col("mean_b"))
    noise = 4 * F.sqrt(F.col("error_a") * F.col("error_a") + F.col("error_b") * F.col("error_b"))
    met = side(old, removed, "a").join(side(new, added, "b"), "type").withColumn("common", common)
    met = met.where((F.col("common") >= COMMON) & (F.abs(F.col("nulls_a") - F.col("nulls_b")) <= NULLS_APART) & (apart <= MEANS_APART + noise))
    taken: dict[str, str] = {}
    for r in sorted(met.select("column_a", "column_b", (F.col("common") - apart).alias("score")).collect(), key=lambda r: (-r["score"], r["column_a"], r["column_b"])):
        if r["column_a"] not in taken and r["column_b"] not in taken.values():
            taken[r["column_a"]] = r["column_b"]
    return list(taken.items())


def diff_tables(old: DataFrame, new: DataFrame, old_clauses: DataFrame, new_clauses: DataFrame) -> DataFrame:
    """CHANGE rows between the CLAUSES of two tables, with columns that the data shows to be renamed as such."""
    a, b = ({r["column"]: r["type"] for r in c.select("column", "type").collect()} for c in (old_clauses, new_clauses))
    return diff(old_clauses, new_clauses, renames(old, new, {c: t for c, t in a.items() if c not in b}, {c: t for c, t in b.items() if c not in a}))


def diff(old: DataFrame, new: DataFrame, renamed: list[tuple[str, str]] = ()) -> DataFrame:
    """CHANGE rows between two CLAUSES tables, ordered by column. A renamed column (old name, new name) is a change of its own, and is compared under its new name; else it is one removed and one added."""
    if renamed:
        names = F.create_map(*[F.lit(x) for pair in renamed for x in pair])
        moved = old.sparkSession.createDataFrame([("rename_column", a, a, b) for a, b in renamed], "change_type string, column string, old_value string, new_value string")
        moved = moved.join(F.broadcast(taxonomy(old.sparkSession)), "change_type").select("change_type", "column", "old_value", "new_value", "backward_compatible", "required_action", "risk_level")
        same = old.withColumn("column", F.coalesce(F.try_element_at(names, F.col("column")), "column"))
        return moved.unionByName(diff(same, new)).orderBy("column", "change_type")
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col("o.column") == F.col("n.column"), "full_outer")
    both = F.col("o.column").isNotNull() & F.col("n.column").isNotNull()
    c = lambda k: (F.col(f"o.{k}"), F.col(f"n.{k}"))
    empty = F.array().cast("array<string>")
    enum_o, enum_n = (F.coalesce(x, empty) for x in c("enum"))
    gone, come = F.array_except(enum_o, enum_n), F.array_except(enum_n, enum_o)
    span = lambda x: F.concat(F.lit("["), F.coalesce(F.col(f"{x}.minimum").cast("string"), F.lit("None")), F.lit(", "), F.coalesce(F.col(f"{x}.maximum").cast("string"), F.lit("None")), F.lit("]"))
    change = lambda when, kind, a, b: F.when(when, F.struct(kind.alias("change_type"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value")))
    none = F.lit(None)
    required_new = F.col("n.required") & ~F.col("n.nullable")
    kinds = [
        change(F.col("o.column").isNull(), F.when(required_new, "add_required_column").otherwise("add_nullable_column"), none, F.col("n.type")),
        change(F.col("n.column").isNull(), F.lit("remove_column"), F.col("o.type"), none),
        change(both & (F.col("o.type") != F.col("n.type")), type_change(*c("type")), *c("type")),
        change(both & range_change(*(F.col(f"{x}.{k}") for x in "on" for k in ("minimum", "maximum"))).isNotNull(), range_change(*(F.col(f"{x}.{k}") for x in "on" for k in ("minimum", "maximum"))), span("o"), span("n")),
        change(both & (F.size(come) > 0), F.lit("add_enum_value"), _values(enum_o), _values(come)),
        change(both & (F.size(gone) > 0), F.lit("remove_enum_value"), _values(gone), _values(enum_n)),
        change(both & ~c("pattern")[0].eqNullSafe(c("pattern")[1]), F.lit("pattern_changed"), *c("pattern")),
        change(both & ~F.col("o.required") & F.col("n.required"), F.lit("add_required_column"), F.lit("required=false"), F.lit("required=true")),
    ]
    found = met.select(F.coalesce("o.column", "n.column").alias("column"), F.inline(F.filter(F.array(*kinds), lambda x: x.isNotNull())))
    # The taxonomy is a fixed table of a dozen rows.
    named = found.join(F.broadcast(taxonomy(old.sparkSession)), "change_type", "left")
    return named.select("change_type", "column", "old_value", "new_value", "backward_compatible", "required_action", "risk_level").orderBy("column", "change_type")


def verdict(changes: DataFrame) -> DataFrame:
    """verdict, n_changes, n_breaking."""
    breaking = F.count_if(~F.coalesce("backward_compatible", F.lit(False)))
    return changes.agg(F.count("*").alias("n_changes"), breaking.alias("n_breaking")).select(F.when(F.col("n_breaking") == 0, "FULL_COMPATIBLE").otherwise("BACKWARD_INCOMPATIBLE").alias("verdict"), "n_changes", "n_breaking")


def path_match(registered: Column, changed: Column) -> Column:
    """Equal roots, or the root of either in the other path."""
    return (root(registered) == root(changed)) | registered.contains(root(changed)) | changed.contains(root(registered))


def _say(texts: dict[str, str], otherwise: str, **values: Column) -> Column:
    def filled(text: str) -> Column:
        out = F.lit(text)
        for k, v in values.items():
            out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("?")))
        return out

    said = F.lit(None).cast("string")
    for kind, text in texts.items():
        said = F.when(F.col("change_type") == kind, filled(text)).otherwise(said)
    return F.coalesce(said, filled(otherwise))


def consumer_failures(changes: DataFrame, subscriptions: DataFrame, contract_id: str) -> DataFrame:
    """For each breaking change, the subscribers of the contract that it hits: through a field they call breaking, or else one they read.

    Changes and subscriptions are metadata; the join is on a path condition, so the few changes are the side that is sent round."""
    broken = changes.where(~F.coalesce("backward_compatible", F.lit(False)))
    subs = subscriptions.where(F.col("contract_id") == contract_id)
    hit = F.filter("breaking_fields", lambda b: path_match(b["field"], F.col("column")))
    read = F.exists("fields_consumed", lambda f: path_match(f, F.col("column")))
    reason = F.get(hit, F.lit(0))["reason"]
    met = subs.join(F.broadcast(broken)).withColumn("direct", F.coalesce(F.size(hit) > 0, F.lit(False))).where(F.col("direct") | F.coalesce(read, F.lit(False)))
    text = _say(FAILURE_TEXT, "Field '{column}' changed.", column=F.col("column"), old=F.col("old_value"), new=F.col("new_value"))
    return met.select(
        "change_type", "column", "risk_level", "subscriber_id", "subscriber_team", "contact", F.coalesce("validation_mode", F.lit("AUDIT")).alias("validation_mode"),
        F.when(F.col("direct"), "breaking_field").otherwise("consumed_field").alias("dependency_type"),
        F.concat(text, F.when(reason != "", F.concat(F.lit(" Registry: "), F.trim(reason))).otherwise("")).alias("failure_mode"),
        _say(ACTION_TEXT, "See what '{column}' means for {subscriber}; ask {contact}.", column=F.col("column"), subscriber=F.col("subscriber_id"), team=F.coalesce("subscriber_team", "subscriber_id"), contact=F.col("contact"), mode=F.coalesce("validation_mode", F.lit("AUDIT"))).alias("consumer_action"),
    )


def migration_report(contract_id: str, old_ref: str, new_ref: str, changes: DataFrame, subscriptions: DataFrame | None = None) -> dict:
    """The changes, what breaks and what to do, as one document."""
    rows = [r.asDict() for r in changes.collect()]
    breaking = [r for r in rows if not r["backward_compatible"]]
    hit = [r.asDict() for r in consumer_failures(changes, subscriptions, contract_id).collect()] if subscriptions is not None else []
    steps = [f"{r['column']} ({r['change_type']}): {r['required_action']}" for r in breaking]
    return {
        "contract_id": contract_id, "snapshot_a": old_ref, "snapshot_b": new_ref, "verdict": "BACKWARD_INCOMPATIBLE" if breaking else "FULL_COMPATIBLE",
        "total_changes": len(rows), "breaking_changes": len(breaking), "compatible_changes": len(rows) - len(breaking), "changes": rows,
        "migration_checklist": steps or ["Nothing to do."], "rollback_plan": f"Go back to {old_ref} and deploy the producers of that version again." if breaking else "Not needed.",
        "consumer_failure_modes": hit, "summary": f"{len(rows)} changes, {len(breaking)} of them breaking, {len({r['subscriber_id'] for r in hit})} consumers hit.",
    }


def latest_two(snapshots: DataFrame) -> DataFrame:
    """The two newest snapshots (ref) of each contract (contract_id), rank 1 being the newest."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("contract_id").orderBy(F.desc("ref")))
    return snapshots.withColumn("rank", rank).where("rank <= 2")
