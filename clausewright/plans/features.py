"""Registered queries of logs, lines that don't fit, check texts, nested clauses and what else goes beyond single checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import contract, drift, evolve, nested, profile, quantiles, report, sketches, temporal, texts
from clausewright.plans.catalogue import _CHANGES, _FIELD, _ROOTS, _contract, _diff, _subscriptions
from clausewright.plans.registry import query, scratch
from clausewright.sources import readers, sinks
from clausewright.sources.readers import parquet
from clausewright.streaming import stateful

# ---- logs and lines


@query("SELECT CAST(event_id % 6 + 1 AS BIGINT) AS commit, row_number() OVER (PARTITION BY event_id % 6 ORDER BY event_id DESC) AS place, event_id, CASE WHEN event_type <> 'view' THEN 'user' || user_id END AS check_id FROM events")
def log_order_events(spark, d):
    """Six appends to one log, each with its rows from the last event to the first, null keys among them, read again in order."""
    path = f"{scratch(spark)}/log"
    e = parquet(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.concat(F.lit("user"), "user_id")).alias("check_id"))
    for i in range(6):
        sinks.append_log(e.where(F.col("event_id") % 6 == i), path, order=[F.desc("event_id")])
    kept = readers.logged(spark, path, "event_id bigint, check_id string")
    return kept.select("log_pos.commit", F.expr("row_number() over (partition by log_pos.commit order by log_pos)").alias("place"), "event_id", "check_id")


@query("WITH l AS (SELECT *, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'CRITICAL' WHEN 'view' THEN NULL ELSE 'ODD' END AS severity, event_id % 2 AS c FROM events) SELECT event_id, severity, 'Affects ' || user_id % 5 || ' downstream node(s): ' || list_aggregate(list_slice(list_transform(range(user_id % 5), lambda i: 'n' || i), 1, 3), 'string_agg', ', ') AS impact FROM l WHERE user_id % 5 > 0 ORDER BY CASE WHEN severity = 'CRITICAL' THEN 0 WHEN severity = 'HIGH' THEN 1 WHEN severity IS NULL THEN 3 ELSE 4 END, c, event_id LIMIT 500")
def top_logged_events(spark, d):
    """The gravest violations of a log of two appends, earlier ones first, with what they affect; no severity counts as LOW, above an odd one."""
    path = f"{scratch(spark)}/log"
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "click", "CRITICAL").when(F.col("event_type") != "view", "ODD")
    nodes = F.transform(F.sequence(F.lit(0), (F.col("user_id") % 5).cast("int") - 1), lambda i: F.concat(F.lit("n"), i))
    e = parquet(spark, d, "events").where("user_id % 5 > 0").select(F.col("event_id").cast("string").alias("violation_id"), severity.alias("severity"), F.struct(nodes.alias("affected_nodes")).alias("blast_radius"), "event_id")
    for i in range(2):
        sinks.append_log(e.where(F.col("event_id") % 2 == i).drop("event_id"), path, order=[F.col("violation_id").cast("bigint")])
    top = report.summary_of(report.top_violations(readers.violation_log(spark, path), n=500))
    return top.select(F.col("violation_id").cast("bigint").alias("event_id"), "severity", F.col("downstream_impact").alias("impact"))


@query("SELECT coalesce(CAST(user_id AS VARCHAR), 'nobody') AS user, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type <> 'view' UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT) FROM events WHERE event_type = 'view') q GROUP BY user_id")
def log_once_users(spark, d):
    """Two appends without repeats, views without a user: each user once, and null once."""
    path = f"{scratch(spark)}/log"
    e = parquet(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"))
    sinks.append_once(e.where("user_id is null or user_id % 2 = 0"), path, "user_id")
    sinks.append_once(e, path, "user_id")
    return readers.logged(spark, path, "user_id bigint").groupBy(F.coalesce(F.col("user_id").cast("string"), F.lit("nobody")).alias("user")).agg(F.count("*").alias("n"))


def _odd_lines(spark, d) -> str:
    """Events as lines of JSON: errors are cut short, clicks have words for a value, views a key that no schema knows; blank lines and lists between them."""
    path = f"{scratch(spark)}/lines"
    e = parquet(spark, d, "events")
    extra = F.when(F.col("event_type") == "view", F.lit(', "user": 7}')).when(F.col("event_type") == "error", "").otherwise("}")
    value = F.when(F.col("event_type") == "click", F.lit('"many"')).otherwise(F.col("value").cast("string"))
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "value": '), value, extra)
    e.select(line.alias("value")).unionByName(e.where("event_id % 10 = 0").select(F.lit(" ").alias("value"))).unionByName(e.where("event_id % 10 = 1").select(F.lit("[1]").alias("value"))).write.text(path)
    return path


_ODD = "event_id bigint, value double"


@query("SELECT 'good' AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type NOT IN ('error', 'click') UNION ALL SELECT 'bad', (SELECT count(*) FROM events WHERE event_type IN ('error', 'click')) + (SELECT count(*) FROM events WHERE event_id % 10 = 1), 0")
def jsonl_type_errors_events(spark, d):
    """Lines that parse but don't fit are left out of the rows, of every count of them, and are among the rejects."""
    path = _odd_lines(spark, d)
    good = readers.jsonl(spark, path, _ODD, require_rows=True)
    return good.agg(F.lit("good").alias("part"), F.count("*").alias("n"), F.sum("event_id").alias("ids")).unionByName(readers.malformed(spark, path, _ODD).agg(F.lit("bad").alias("part"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("ids")))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type <> 'click' THEN value END AS value, CASE WHEN event_type = 'click' THEN 'value=\"many\"' ELSE '' END AS wrong, CASE WHEN event_type = 'view' THEN 'user=7' ELSE '' END AS unknown, false AS broken FROM events WHERE event_type <> 'error' UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM events WHERE event_type = 'error' UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 10 = 1")
def json_records_events(spark, d):
    """Every line apart: what fits, values of another type, unknown keys, broken lines."""
    said = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    r = readers.records(spark, _odd_lines(spark, d), _ODD)
    return r.select(F.col("record.event_id").cast("string").alias("event_id"), "record.value", said("wrong").alias("wrong"), said("unknown").alias("unknown"), "broken")


# ---- check texts and nested clauses

_TEXTS = {
    "missing_count(o_totalprice) = 0": "count(*) - count(o_totalprice)",
    "duplicate_count(o_custkey) = 0": "count(o_custkey) - count(DISTINCT o_custkey)",
    "max(o_totalprice) <= 300000": "count(*) FILTER (WHERE o_totalprice > 300000)",
    "min(o_totalprice) > 1000 where o_orderstatus = 'P'": "count(*) FILTER (WHERE o_totalprice <= 1000 AND o_orderstatus = 'P')",
    "row_count >= 1": "0",
    "avg(o_totalprice) between 1 and 2": "0",
    "max_length(o_orderpriority) <= 8": "count(*) FILTER (WHERE length(o_orderpriority) > 8)",
    "distinct_count(o_orderstatus) = 3": "0",
    "missing_percent(o_orderdate) < 1": "count(*) - count(o_orderdate)",
}
_MEASURED = {
    "missing_count(o_totalprice) = 0": "count(*) - count(o_totalprice) = 0",
    "duplicate_count(o_custkey) = 0": "count(o_custkey) = count(DISTINCT o_custkey)",
    "max(o_totalprice) <= 300000": "max(o_totalprice) <= 300000",
    "min(o_totalprice) > 1000 where o_orderstatus = 'P'": "min(o_totalprice) FILTER (WHERE o_orderstatus = 'P') > 1000",
    "row_count >= 1": "count(*) >= 1",
    "avg(o_totalprice) between 1 and 2": "avg(o_totalprice) BETWEEN 1 AND 2",
    "max_length(o_orderpriority) <= 8": "max(length(o_orderpriority)) <= 8",
    "distinct_count(o_orderstatus) = 3": "count(DISTINCT o_orderstatus) = 3",
    "missing_percent(o_orderdate) < 1": "100.0 * (count(*) - count(o_orderdate)) / count(*) < 1",
}


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


@query(" UNION ALL ".join(f"SELECT {_quoted(t)} AS check_text, CASE WHEN {_MEASURED[t]} THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN {_MEASURED[t]} THEN 0 ELSE {n} END AS records_failing FROM orders" for t, n in _TEXTS.items()) + " UNION ALL SELECT 'N/A', 'ERROR', 0")
def check_texts_orders(spark, d):
    """Check texts run as one scan, and as one more for each metric that needs distinct values; a text on a column that isn't there is an error."""
    c = {"id": "orders", "quality": {"type": "SodaChecks", "specification": {"checks for orders": [*_TEXTS, "missing_count(o_clerk) = 0"]}}}
    return texts.check_texts(parquet(spark, d, "orders"), c).select(F.col("expected").alias("check_text"), "status", "records_failing")


_INSIDE = {
    "orders[].status.enum": "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'",
    "orders[].lines[].price.range": "SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_extendedprice > 50000",
    "orders[].lines[].part.unique": "SELECT coalesce(sum(c - k), 0) FROM (SELECT o_custkey, count(*) AS c, count(DISTINCT l_partkey) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey) q",
    "orders[].lines[].taxes{}.rate.range": "SELECT count(*) FILTER (WHERE l_tax > 0.05) + count(*) FILTER (WHERE l_discount > 0.05) FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "orders[].lines[].ship.flag.pattern": "SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag NOT IN ('A', 'N')",
    "orders[].lines[].ship.status.required": "SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'",
    "orders[].clerk.exists": "SELECT 0",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS part, CAST(({q}) AS BIGINT) AS records_failing, CASE WHEN '{k}' LIKE '%exists' THEN 'ERROR' WHEN ({q}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status" for k, q in _INSIDE.items()))
def nested_customers(spark, d):
    """Customers with their orders with their lines, each with taxes by kind: clauses three levels down and in a map, without exploding anything."""
    line = F.struct(
        F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.struct(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("status")).alias("ship"),
        F.create_map(F.lit("tax"), F.struct(F.col("l_tax").alias("rate")), F.lit("discount"), F.struct(F.col("l_discount").alias("rate"))).alias("taxes"),
    )
    lines = parquet(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    o = parquet(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    customers = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("status"), "lines")).alias("orders"))
    number = lambda **k: {"type": "number"} | k
    inner = {
        "part": {"type": "integer", "unique": True}, "price": number(maximum=50000), "ship": {"type": "object", "properties": {"flag": {"type": "string", "pattern": "^[AN]$"}, "status": {"type": "string", "required": True}}},
        "taxes": {"type": "object", "additionalProperties": {"type": "object", "properties": {"rate": number(minimum=0, maximum=0.05)}}},
    }
    order = {"status": {"type": "string", "enum": ["F", "O"]}, "lines": {"type": "array", "items": inner}, "clerk": {"type": "string", "required": True}}
    found = nested.nested_checks(customers, _contract("customers", orders={"type": "array", "items": order}))
    return found.select(F.regexp_replace("check_id", "^customers\\.", "").alias("part"), "records_failing", "status")


# ---- streams


def _streamed(spark, rows, order: str, make, parts: int = 5):
    """make(stream) of a table that comes as files, one a micro-batch, in ranges of a column."""
    path = scratch(spark)
    cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]))).first()[0]
    part = sum(((F.col(order) > x).cast("int") for x in cuts), F.lit(0))
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with stateful.with_store(spark):
        q = make(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT user_id, event_id, value, before FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) q WHERE value <= before")
def stream_sequences_events(spark, d):
    """Values that don't exceed their user's last, over a stream in five micro-batches."""
    e = parquet(spark, d, "events").select("user_id", "event_id", "value")
    return _streamed(spark, e, "event_id", lambda s: stateful.sequences(s, "user_id", "value", "event_id"))


_RUNS = "SELECT event_type AS c, CAST(CAST(ts AS DATE) AS VARCHAR) AS run, avg(value * (1 + day(ts) % 3 * 2)) AS mean, stddev_samp(value * (1 + day(ts) % 3 * 2)) / 5 AS stddev, count(value) AS n FROM events GROUP BY 1, 2"


def _daily_runs(spark, d):
    """Moments of each type of event by day, on a scale that changes from day to day."""
    scaled = F.col("value") * (1 + F.day("ts") % 3 * 2)
    e = parquet(spark, d, "events").groupBy(F.lit("events").alias("contract_id"), F.col("event_type").alias("column"), F.to_date("ts").cast("string").alias("run"))
    return e.agg(F.avg(scaled).alias("mean"), (F.stddev_samp(scaled) / 5).alias("stddev"), F.count("value").alias("n"))


_DRIFTS = f"SELECT c AS column_name, run, round(dev, 6) AS deviation, CASE WHEN dev > 3 THEN 'FAIL' ELSE 'WARN' END AS status FROM (SELECT c, run, abs(mean - lag(mean) OVER w) / lag(stddev) OVER w AS dev FROM ({_RUNS}) r WHERE n >= 5 WINDOW w AS (PARTITION BY c ORDER BY run)) q WHERE dev > 2"


@query(_DRIFTS)
def stream_drifts_events(spark, d):
    """Days whose mean has moved from the day before, as a stream of runs."""
    runs = _daily_runs(spark, d).withColumn("at", F.unix_timestamp(F.to_date("run")))
    out = _streamed(spark, runs, "at", lambda s: stateful.drifts(s))
    return out.select(F.col("column").alias("column_name"), "run", F.round("deviation", 6).alias("deviation"), "status")


@query(_DRIFTS)
def drifts_in_runs_events(spark, d):
    found = drift.successive(_daily_runs(spark, d))
    return found.select(F.col("column").alias("column_name"), "run", F.round("deviation", 6).alias("deviation"), "status")


# ---- renames


def _pair_sql(old: str, new: str, a: str, b: str, type_: str) -> str:
    """A pair of columns that have at least half of their values in common, in shares that differ little."""
    return f"""SELECT '{old}' AS column_name, '{new}' AS new_value FROM (SELECT count(*) FILTER (WHERE p.v IS NOT NULL AND q.v IS NOT NULL) * 1.0 / count(*) AS common, sum(abs(coalesce(p.s, 0) - coalesce(q.s, 0))) / 2 AS apart
FROM (SELECT v, count(*) * 1.0 / sum(count(*)) OVER () AS s FROM (SELECT CAST({a} AS VARCHAR) AS v FROM orders) x GROUP BY v) p FULL OUTER JOIN (SELECT v, count(*) * 1.0 / sum(count(*)) OVER () AS s FROM (SELECT CAST({b} AS VARCHAR) AS v FROM orders WHERE o_orderkey % 5 <> 0) x GROUP BY v) q ON p.v = q.v) m WHERE common >= 0.5 AND apart < 0.3"""


_URGENCY = "CASE WHEN o_orderkey % 9 = 0 THEN '1-URGENT' WHEN o_orderkey % 9 = 1 THEN '2-HIGH' WHEN o_orderkey % 9 = 2 THEN '3-MEDIUM' WHEN o_orderkey % 9 = 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END"
_PAIRS = [("o_totalprice", "price", "o_totalprice", "o_totalprice", "number"), ("o_custkey", "agent", "o_custkey", "o_custkey + 1000000", "integer"), ("o_orderpriority", "urgency", "o_orderpriority", _URGENCY, "string"), ("o_orderpriority", "state", "o_orderpriority", "o_orderstatus", "string"), ("o_orderstatus", "urgency", "o_orderstatus", _URGENCY, "string"), ("o_orderstatus", "state", "o_orderstatus", "o_orderstatus", "string")]


@query(" UNION ALL ".join(_pair_sql(*p) for p in _PAIRS))
def schema_renames_orders(spark, d):
    """Four columns are gone and four came: two are old ones under new names, two look alike but have other values, or the same in other shares."""
    o = parquet(spark, d, "orders")
    old = o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 5 <> 0").select("o_orderkey", (F.col("o_custkey") + 1000000).alias("agent"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"), F.expr(_URGENCY).alias("urgency"))
    of = lambda t: contract.clauses_of(profile.profile(t, light=True))
    changes = evolve.diff_tables(old, new, of(old), of(new)).where("change_type = 'rename_column'")
    return changes.select(F.col("column").alias("column_name"), "new_value")


# ---- sketches and quantiles


@query("SELECT column_name, total, non_null, lo, hi, round(mean, 6) AS mean, round(sd, 6) AS stddev, true AS p50_near, true AS p95_near, true AS distinct_near FROM (SELECT 'l_quantity' AS column_name, count(*) AS total, count(l_quantity) AS non_null, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*), count(l_extendedprice), min(l_extendedprice), max(l_extendedprice), avg(l_extendedprice), stddev_samp(l_extendedprice) FROM lineitem) q")
def merged_profile_lines(spark, d):
    """A profile merged from parts by return flag, the second run reading only the parts that the first one didn't have; sketches against exact values within their errors."""
    path = f"{scratch(spark)}/parts"
    t = parquet(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    sketches.profile_new(t.where("l_returnflag <> 'R'"), "l_returnflag", path)
    p = sketches.profile_new(t, "l_returnflag", path)
    rank = (lambda c, v: F.avg((F.col(c) < v).cast("double")), lambda c, v: F.avg((F.col(c) <= v).cast("double")))
    out = None
    for r in p.collect():
        lt50, le50, lt95, le95, n = t.agg(*[f(r["column"], r[q]) for q in ("p50", "p95") for f in rank], F.count_distinct(r["column"])).first()
        one = spark.range(1).select(
            F.lit(r["column"]).alias("column_name"), F.lit(r["total"]).alias("total"), F.lit(r["non_null"]).alias("non_null"), F.lit(r["min"]).alias("lo"), F.lit(r["max"]).alias("hi"), F.round(F.lit(r["mean"]), 6).alias("mean"), F.round(F.lit(r["stddev"]), 6).alias("stddev"),
            F.lit(lt50 - 0.005 <= 0.5 <= le50 + 0.005).alias("p50_near"), F.lit(lt95 - 0.005 <= 0.95 <= le95 + 0.005).alias("p95_near"), F.lit(abs(r["cardinality"] - n) <= 0.08 * n).alias("distinct_near"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), {p}) AS q{i}' for i, p in enumerate((0.001, 0.5, 0.999)))} FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")))
def exact_quantiles_lines(spark, d):
    """Quantiles by counting: a column of few values, each of which repeats, and columns of many."""
    got = quantiles.exact_quantiles(parquet(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"], [0.001, 0.5, 0.999])
    return spark.createDataFrame([(c, *q) for c, q in got.items()], "column_name string, q0 double, q1 double, q2 double")


# ---- time


@query("SELECT e.event_id AS event_id, e.user_id AS user_id, coalesce(CAST(r.event_id AS VARCHAR), 'none') AS last_click FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) r ON e.user_id = r.user_id AND e.ts >= r.ts")
def as_of_events(spark, d):
    """Each event with the click in force at its time: the user's last one."""
    e = parquet(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    met = temporal.as_of(e.where("event_type <> 'click'"), e.where("event_type = 'click'").select("user_id", "ts", "event_id"), ["user_id"], "ts", "ts", "click")
    return met.select("event_id", "user_id", F.coalesce(F.col("click.event_id").cast("string"), F.lit("none")).alias("last_click"))


@query("SELECT a.event_id AS event_id, b.event_id AS commit_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 DAY WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
def commits_before_errors(spark, d):
    """Purchases as a user's commits, those in the two days before each error."""
    e = parquet(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    met = temporal.within(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", 2 * 86400)
    return met.select("event_id", F.col("found.event_id").alias("commit_id"))


_BASELINES = "SELECT event_type AS c, date_trunc('day', ts) + INTERVAL 1 DAY AS since, avg(value) AS mean FROM events GROUP BY 1, 2"


@query(f"SELECT e.event_id AS event_id, round(coalesce(b.mean, -1), 6) AS baseline FROM events e ASOF LEFT JOIN ({_BASELINES}) b ON e.event_type = b.c AND e.ts >= b.since")
def baseline_in_force_events(spark, d):
    """Each event with the baseline in force at its time: its type's mean of the last day that was over. Three types have all rows."""
    e = parquet(spark, d, "events").select("event_id", "event_type", "ts", "value")
    b = e.groupBy("event_type", (F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("since")).agg(F.avg("value").alias("mean"))
    met = temporal.as_of(e.select("event_id", "event_type", "ts"), b, ["event_type"], "ts", "since", "b")
    return met.select("event_id", F.round(F.coalesce("b.mean", F.lit(-1.0)), 6).alias("baseline"))


# ---- reports at every level

_LEVEL = ("contract_id", "kind", "severity", "day")
_RESULTS = "SELECT o_orderpriority AS contract_id, CASE WHEN o_custkey % 2 = 0 THEN 'range' ELSE 'enum' END AS kind, CASE WHEN o_orderstatus <> 'P' THEN 'LOW' WHEN o_custkey % 2 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, strftime(o_orderdate, '%Y') AS day, CASE WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'PASS' END AS status FROM orders"


@query(f"SELECT coalesce(contract_id, '*') AS contract_id, coalesce(kind, '*') AS kind, coalesce(severity, '*') AS severity, coalesce(day, '*') AS day, CAST(GROUPING(contract_id, kind, severity, day) AS BIGINT) AS level, count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(greatest(0, least(100, round_even(100.0 * count(*) FILTER (WHERE status = 'PASS') / count(*) - 20 * count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') - 5 * count(*) FILTER (WHERE status = 'FAIL' AND severity = 'HIGH'), 0))) AS BIGINT) AS score FROM ({_RESULTS}) r GROUP BY CUBE (contract_id, kind, severity, day)")
def report_cube_orders(spark, d):
    """Orders as check results, summed up at all sixteen levels of contract, kind, severity and year, with the score of each."""
    bad, even = F.col("o_orderstatus") == "P", F.col("o_custkey") % 2 == 0
    r = parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("contract_id"), F.when(even, "range").otherwise("enum").alias("kind"), F.when(~bad, "LOW").when(even, "HIGH").otherwise("CRITICAL").alias("severity"), F.date_format("o_orderdate", "yyyy").alias("day"), F.when(bad, "FAIL").otherwise("PASS").alias("status"))
    return report.cube(r, list(_LEVEL)).select(*[F.coalesce(c, F.lit("*")).alias(c) for c in _LEVEL], "level", "checks", "failed", "score")


# ---- contracts of well-known columns, texts for consumers


@query("SELECT part, n AS records_failing FROM (SELECT unnest(['scores{}.score.range', 'token_count.input.range', 'token_count.output.range', 'edges[].relationship.enum', 'edges[].confidence.range']) AS part, unnest([count(*) FILTER (WHERE o_orderstatus = 'P'), count(*) FILTER (WHERE o_custkey < 10), 0, count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), count(*) FILTER (WHERE o_totalprice / 300000 > 1)]) AS n FROM orders) q")
def known_sub_schemas_orders(spark, d):
    """Orders as records with well-known nested columns, whose contract, built from them, has the clauses known for those names; and what of them breaks it."""
    o = parquet(spark, d, "orders")
    score = lambda x: F.struct(x.cast("bigint").alias("score"), F.array(F.col("o_orderstatus")).alias("evidence"), F.lit("").alias("notes"))
    status = F.when(F.col("o_orderstatus") == "P", 9).when(F.col("o_orderstatus") == "F", 1).otherwise(5)
    edge = F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"), F.when(F.col("o_orderpriority") == "1-URGENT", "KNOWS").otherwise("CALLS").alias("relationship"), (F.col("o_totalprice") / 300000).alias("confidence"))
    r = o.select(F.create_map(F.lit("status"), score(status), F.lit("fixed"), score(F.lit(3))).alias("scores"), F.struct((F.col("o_custkey") - 10).alias("input"), F.lit(1).cast("bigint").alias("output")).alias("token_count"), F.array(edge).alias("edges"))
    found = nested.nested_checks(r, contract.build_contract(r, "k", "t"))
    return found.select(F.regexp_replace("check_id", "^k\\.", "").alias("part"), "records_failing")


@query(f"""WITH c AS (SELECT * FROM ({_CHANGES}) x WHERE change_type IN ('remove_column', 'add_required_column')), s AS (SELECT n_name, {_FIELD} AS field FROM nation)
SELECT n_name AS subscriber_id, column_name, CASE change_type WHEN 'remove_column' THEN 'Depends on ''' || column_name || ''', which is gone; reads and joins on it find nothing.' ELSE 'Doesn''t fill ''' || column_name || ''' yet; records without it are rejected.' END AS failure_mode,
CASE change_type WHEN 'remove_column' THEN 'Take ''' || column_name || ''' out of ' || n_name || ' before deployment; agree on a window with  ().' ELSE 'Fill ''' || column_name || ''' in all records of ' || n_name || '; backfill old ones or give a default.' END AS consumer_action
FROM s, c WHERE {_ROOTS.format(f='field')} = column_name OR contains(field, column_name) OR contains(column_name, {_ROOTS.format(f='field')}) OR column_name = 'o_orderpriority'""")
def consumer_texts_orders(spark, d):
    """What a removed and a new required column mean to each subscriber, and what it is to do."""
    found = evolve.consumer_failures(_diff(spark, d), _subscriptions(spark, d), "orders").where("change_type in ('remove_column', 'add_required_column')")
    return found.select("subscriber_id", F.col("column").alias("column_name"), "failure_mode", "consumer_action")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS run_timestamp, count(*) AS total_checks FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1")
def reports_of_one_contract(spark, d):
    monthly = parquet(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("contract_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run_timestamp")).agg(F.count("*").alias("total_checks"))
    return report.of_contract(monthly, "2-HIGH").select("run_timestamp", "total_checks")
