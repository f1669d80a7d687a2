"""The registered queries over the driver's tables, and the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.expressions import half_even
from clausewright.functions.storage import cut
from clausewright.operators import ai, attribute, checks, contract, drift, evolve, lineage, nested, profile, report
from clausewright.plans.registry import ORACLE_SQL, QUERIES, query, scratch
from clausewright.sources import readers, sinks
from clausewright.sources.readers import parquet

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def _contract(name: str, **clauses: dict) -> dict:
    return {"id": name, "schema": clauses}


ORDERS = _contract(
    "orders",
    o_orderkey={"type": "integer", "required": True, "unique": True, "minimum": 0},
    o_custkey={"type": "integer", "required": True, "unique": True},
    o_orderstatus={"type": "string", "required": True, "enum": ["F", "O"]},
    o_totalprice={"type": "number", "required": True, "minimum": 0.0, "maximum": 400000.0},
    o_orderpriority={"type": "string", "required": True, "pattern": "^[1-3]-"},
    o_comment={"type": "string"},
)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_table(parquet(spark, folder, "orders"), ORDERS)


# ---- profiles


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS non_null, CAST(min({c}) AS DOUBLE) AS min_v, CAST(max({c}) AS DOUBLE) AS max_v, round(avg({c}), 6) AS mean_v, round(stddev_samp({c}), 6) AS stddev_v, "
        + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 95, 99)) + " FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    )
)
def profile_numeric_lineitem(spark, d):
    p = profile.profile(parquet(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    r = lambda c: F.round(c, 6)
    return p.select(F.col("column").alias("column_name"), "total", "non_null", F.col("min").alias("min_v"), F.col("max").alias("max_v"), r("mean").alias("mean_v"), r("stddev").alias("stddev_v"), *[r(q).alias(q) for q in ("p25", "p50", "p75", "p95", "p99")])


@query("SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS cardinality FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders")
def profile_string_cardinality_orders(spark, d):
    return profile.profile(parquet(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select(F.col("column").alias("column_name"), "cardinality")


@query("SELECT value, cnt FROM (SELECT o_orderpriority AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY o_orderpriority) t WHERE rn <= 5")
def profile_top_values_orders(spark, d):
    return profile.top_values(parquet(spark, d, "orders"), "o_orderpriority")


_HALF_HASHED = "CASE WHEN c_custkey % 10 < {n} THEN c_name ELSE sha256(c_name) END"


@query(" UNION ALL ".join(f"SELECT {n} AS tenths, CASE WHEN avg(CASE WHEN regexp_matches({_HALF_HASHED.format(n=n)}, '^[a-f0-9]{{64}}$') THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'sha256' ELSE 'none' END AS format FROM customer" for n in (0, 1, 3)))
def detect_format_customer(spark, d):
    """Names of which some tenths aren't hashed: few enough, and too many."""
    c, out = parquet(spark, d, "customer"), None
    for n in (0, 1, 3):
        value = F.when(F.col("c_custkey") % 10 < n, F.col("c_name")).otherwise(F.sha2("c_name", 256)).alias("h")
        one = profile.detect_format(c.select(value), "h").select(F.lit(n).alias("tenths"), F.coalesce("format", F.lit("none")).alias("format"))
        out = one if out is None else out.unionByName(one)
    return out


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{t}' AS column_name, CASE WHEN avg(v) > 3 * quantile_cont(v, 0.75) AND quantile_cont(v, 0.75) > 0 THEN 'outliers' WHEN stddev_samp(v) = 0 THEN 'constant' END AS flag FROM (SELECT pow(value, {1 + 2 * i}) AS v FROM events WHERE event_type = '{t}') e) q WHERE flag IS NOT NULL" for i, t in enumerate(_TYPES)))
def profile_outliers_events(spark, d):
    """Values of each type of event, to a power that makes some heavy-tailed, as columns of one profile."""
    e = parquet(spark, d, "events")
    p = profile.profile(e.select(*[F.when(F.col("event_type") == t, F.pow("value", F.lit(1.0 + 2 * i))).alias(t) for i, t in enumerate(_TYPES)]))
    flag = F.when(F.col("flag").contains("outliers"), "outliers").when(F.col("flag").contains("constant"), "constant")
    return profile.suspicious(p).select(F.col("column").alias("column_name"), flag.alias("flag")).where("flag is not null")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, count({c}) AS n FROM part" for c in ("p_partkey", "p_size", "p_retailprice")
    )
)
def baselines_part(spark, d):
    b = profile.baselines_of(profile.profile(parquet(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"]), "part")
    return b.select(F.col("column").alias("column_name"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "n")


_CLAUSES = """SELECT '{c}' AS column_name, '{t}' AS type, count({c}) > 0.99 * count(*) AS required, {lo} AS minimum, {hi} AS maximum FROM {f}"""
_NUMBERS = {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "number"}


def _clauses_sql(strings: list[str], where: str) -> str:
    n = [_CLAUSES.format(c=c, t=t, lo=f"CAST(min({c}) AS DOUBLE)", hi=f"CAST(CASE WHEN max({c}) <= 1000000 OR '{t}' = 'number' THEN max({c}) END AS DOUBLE)", f=f"orders WHERE {where}") for c, t in _NUMBERS.items()]
    s = [_CLAUSES.format(c=c, t="string", lo="CAST(NULL AS DOUBLE)", hi="CAST(NULL AS DOUBLE)", f=f"orders WHERE {where}") for c in strings]
    return " UNION ALL ".join(n + s)


_OLD, _NEW = _clauses_sql(["o_orderstatus"], "o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"), _clauses_sql(["o_orderpriority"], "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")


@query(_OLD)
def contract_clauses_orders(spark, d):
    c = contract.clauses_of(profile.profile(_orders_before(spark, d), light=True))
    return c.select(F.col("column").alias("column_name"), "type", "required", "minimum", "maximum")


def _orders_before(spark, d):
    return parquet(spark, d, "orders").where("o_orderdate < '1998-01-01'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _orders_after(spark, d):
    return parquet(spark, d, "orders").where("o_orderdate >= '1998-01-01'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


# ---- checks


@query(
    """WITH a AS (SELECT count(*) - count(o_orderkey) AS k0, count(o_orderkey) - count(DISTINCT o_orderkey) AS k1, count(*) FILTER (WHERE o_orderkey < 0) AS k2,
count(*) - count(o_custkey) AS u0, count(o_custkey) - count(DISTINCT o_custkey) AS u1, count(*) - count(o_orderstatus) AS s0, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS s1,
count(*) - count(o_totalprice) AS p0, count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000) AS p1, count(*) - count(o_orderpriority) AS r0, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')) AS r1 FROM orders),
c AS (SELECT unnest([{'i': 'o_orderkey.required', 'n': k0, 's': 'CRITICAL'}, {'i': 'o_orderkey.unique', 'n': k1, 's': 'CRITICAL'}, {'i': 'o_orderkey.range', 'n': k2, 's': 'HIGH'}, {'i': 'o_custkey.required', 'n': u0, 's': 'CRITICAL'}, {'i': 'o_custkey.unique', 'n': u1, 's': 'CRITICAL'},
{'i': 'o_orderstatus.required', 'n': s0, 's': 'CRITICAL'}, {'i': 'o_orderstatus.enum', 'n': s1, 's': 'CRITICAL'}, {'i': 'o_totalprice.required', 'n': p0, 's': 'CRITICAL'}, {'i': 'o_totalprice.range', 'n': p1, 's': 'HIGH'}, {'i': 'o_orderpriority.required', 'n': r0, 's': 'CRITICAL'}, {'i': 'o_orderpriority.pattern', 'n': r1, 's': 'HIGH'}]) AS x FROM a)
SELECT 'orders.' || x.i AS check_id, CASE WHEN x.n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN x.n > 0 THEN x.s ELSE 'LOW' END AS severity, CAST(x.n AS BIGINT) AS records_failing FROM c
UNION ALL SELECT 'orders.o_comment.exists', 'ERROR', 'ERROR', 0"""
)
def check_table_orders(spark, d):
    """Every check of a contract in one scan; those that its clauses don't ask for pass and are left out here."""
    return flagship(spark, d).where("actual_value <> 'N/A' or status = 'ERROR'").select("check_id", "status", "severity", "records_failing")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l.quality IS NULL) AS records_failing, CASE WHEN count(*) FILTER (WHERE l.quality IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def check_required_doc_labels(spark, d):
    met = cut(parquet(spark, d, "documents").select("doc_id").join(parquet(spark, d, "labels"), "doc_id", "left").select("quality"))
    r = checks.check_table(met, _contract("documents", quality={"type": "integer", "required": True})).where("check_type = 'required'")
    return r.join(F.broadcast(met.agg(F.count("*").alias("total")))).select("total", "records_failing", "status")


@query("SELECT count(text) - count(DISTINCT text) AS records_failing FROM documents")
def check_unique_documents_text(spark, d):
    return checks.check_table(parquet(spark, d, "documents"), _contract("documents", text={"type": "string", "unique": True})).where("check_type = 'unique'").select("records_failing")


@query("SELECT count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS records_failing FROM customer")
def check_pattern_customer_name(spark, d):
    return checks.check_table(parquet(spark, d, "customer"), _contract("customer", c_name={"type": "string", "pattern": "^Customer#[0-9]{9}$"})).where("check_type = 'pattern'").select("records_failing")


@query(f"SELECT count(*) FILTER (WHERE NOT regexp_matches(h, '^[a-f0-9]{{64}}$')) AS records_failing, CASE WHEN count(*) FILTER (WHERE NOT regexp_matches(h, '^[a-f0-9]{{64}}$')) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT {_HALF_HASHED.format(n=2)} AS h FROM customer) c")
def check_format_customer_hash(spark, d):
    t = parquet(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 < 2, F.col("c_name")).otherwise(F.sha2("c_name", 256)).alias("h"))
    return checks.check_table(t, _contract("customer", h={"type": "string", "format": "sha256"})).where("check_type = 'format'").select("records_failing", "status")


@query("SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('F','O')) AS records_failing, CASE WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('F','O')) > 0 THEN 'CRITICAL' ELSE 'LOW' END AS severity FROM orders")
def check_enum_orders(spark, d):
    return checks.check_table(parquet(spark, d, "orders"), _contract("orders", o_orderstatus={"enum": ["F", "O"]})).where("check_type = 'enum'").select("records_failing", "severity")


@query("SELECT count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) AS records_failing, printf('min=%.4f, max=%.4f, mean=%.4f', min(l_discount), max(l_discount), avg(l_discount)) AS actual_value FROM lineitem")
def check_range_discount(spark, d):
    return checks.check_table(parquet(spark, d, "lineitem"), _contract("lineitem", l_discount={"minimum": 0.0, "maximum": 0.05})).where("check_type = 'range'").select("records_failing", "actual_value")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F','O')")
def failing_rows_orders(spark, d):
    return checks.failing_rows(parquet(spark, d, "orders"), ORDERS, "o_orderstatus", "enum").select("o_orderkey", "o_orderstatus")


@query("SELECT m.mode AS mode, CASE WHEN r.status = 'FAIL' AND m.mode = 'AUDIT' THEN 'INFO' WHEN r.status = 'FAIL' AND m.mode = 'WARN' THEN 'WARN' ELSE r.status END AS status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'PASS' END AS status FROM orders) r CROSS JOIN (VALUES ('AUDIT'),('WARN'),('ENFORCE')) AS m(mode) GROUP BY 1, 2")
def check_modes(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("PASS")
    r = parquet(spark, d, "orders").select(status.alias("status"), F.lit("").alias("message"), F.explode(F.array(*map(F.lit, ("AUDIT", "WARN", "ENFORCE")))).alias("mode"))
    return checks.enforce(r, F.col("mode")).groupBy("mode", "status").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total_checks, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS warned, CAST(0 AS BIGINT) AS errored FROM orders")
def check_rollup_orders(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "P", "FAIL").otherwise("INFO")
    return checks.rollup(parquet(spark, d, "orders").select(status.alias("status")))


@query("SELECT CASE WHEN count(*) FILTER (WHERE v < -0.25 OR v > 0.25) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (WHERE v < -0.25 OR v > 0.25) AS records_failing FROM (SELECT unnest(embedding) AS v FROM embeddings) t")
def nested_range_embeddings(spark, d):
    c = _contract("embeddings", embedding={"type": "array", "items": {"type": "number", "minimum": -0.25, "maximum": 0.25}})
    return nested.nested_checks(parquet(spark, d, "embeddings"), c).select("status", "records_failing")


@query("SELECT 'facts.entities.confidence.range' AS check_id, CASE WHEN count(*) FILTER (WHERE v < 0 OR v > 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (WHERE v < 0 OR v > 1) AS records_failing FROM (SELECT l_discount * 20 AS v FROM lineitem) t")
def nested_confidence_lineitem(spark, d):
    items = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_discount") * 20).alias("confidence"))).alias("entities"))
    r = checks.check_table(items, _contract("facts", entities={"type": "array"})).where("check_type = 'range'")
    return r.select("check_id", "status", "records_failing")


@query("SELECT count(*) AS dangling FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def referential_documents_labels(spark, d):
    return checks.dangling(parquet(spark, d, "documents"), parquet(spark, d, "labels"), "doc_id")


@query("SELECT count(DISTINCT user_id) AS bad FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) t WHERE value <= prev")
def monotonic_events(spark, d):
    return checks.non_increasing(parquet(spark, d, "events"), "user_id", "value", ["event_id"])


@query("SELECT count(*) FILTER (WHERE l.l_shipdate < o.o_orderdate) AS violations, count(*) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def temporal_order_lineitem(spark, d):
    met = parquet(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(parquet(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    bad, found = checks.temporal_part("lineitem", "o_orderdate", "l_shipdate")
    return met.agg(bad, F.count("*").alias("total")).select("total", F.inline(F.array(found))).select(F.col("records_failing").alias("violations"), "total")


# ---- drift

_SPLIT = "TIMESTAMP '2024-01-11 00:00:00'"


@query(f"SELECT c.event_type AS event_type, round(abs(c.m - b.m) / b.s, 6) AS deviation, CASE WHEN abs(c.m - b.m) / b.s > 3 THEN 'FAIL' WHEN abs(c.m - b.m) / b.s > 2 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT event_type, avg(value) AS m FROM events WHERE ts >= {_SPLIT} GROUP BY event_type) c JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE ts < {_SPLIT} GROUP BY event_type) b ON c.event_type = b.event_type")
def drift_by_event_type(spark, d):
    e = parquet(spark, d, "events")
    return drift.drift_between(e.where("ts >= '2024-01-11'"), e.where("ts < '2024-01-11'"), "event_type", "value")


@query(f"WITH c AS (SELECT event_type AS k, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events WHERE ts >= {_SPLIT} GROUP BY 1), b AS (SELECT event_type AS k, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events WHERE ts < {_SPLIT} AND event_type <> 'error' GROUP BY 1) SELECT coalesce(c.k, b.k) AS column_name, round(coalesce(c.m, b.m), 6) AS mean, round(coalesce(c.s, b.s), 6) AS stddev, coalesce(c.n, b.n) AS n FROM c FULL OUTER JOIN b ON c.k = b.k")
def drift_advance_baselines(spark, d):
    e = parquet(spark, d, "events")
    m = lambda t: t.groupBy(F.col("event_type").alias("column")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"), F.count("value").alias("n")).withColumn("contract_id", F.lit("events"))
    out = drift.advance(m(e.where("ts >= '2024-01-11'")), m(e.where("ts < '2024-01-11' and event_type <> 'error'")))
    return out.select(F.col("column").alias("column_name"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "n")


# ---- evolution

_CHANGES = f"""SELECT coalesce(a.column_name, b.column_name) AS column_name, CASE WHEN a.column_name IS NULL THEN CASE WHEN b.required THEN 'add_required_column' ELSE 'add_nullable_column' END
WHEN b.column_name IS NULL THEN 'remove_column' WHEN b.minimum > a.minimum OR b.maximum < a.maximum THEN 'range_tightened' ELSE 'range_widened' END AS change_type
FROM ({_OLD}) a FULL OUTER JOIN ({_NEW}) b ON a.column_name = b.column_name
WHERE a.column_name IS NULL OR b.column_name IS NULL OR a.minimum <> b.minimum OR a.maximum <> b.maximum"""


def _diff(spark, d):
    of = lambda t: contract.clauses_of(profile.profile(t, light=True))
    return evolve.diff(of(_orders_before(spark, d)), of(_orders_after(spark, d)))


@query(_CHANGES)
def schema_diff(spark, d):
    return _diff(spark, d).select(F.col("column").alias("column_name"), "change_type")


@query(f"SELECT CASE WHEN count(*) FILTER (WHERE change_type IN ('remove_column', 'add_required_column', 'range_tightened')) > 0 THEN 'BACKWARD_INCOMPATIBLE' ELSE 'FULL_COMPATIBLE' END AS verdict, count(*) AS n_changes, count(*) FILTER (WHERE change_type IN ('remove_column', 'add_required_column', 'range_tightened')) AS n_breaking FROM ({_CHANGES}) c")
def schema_verdict(spark, d):
    return evolve.verdict(_diff(spark, d))


_FIELD = "CASE n_nationkey % 4 WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'o_orderstatus.code' WHEN 2 THEN 'o_orderkey[].part' ELSE 'o_clerk' END"


def _subscriptions(spark, d):
    """Nations as subscribers, each with one field that it can't do without and one that it reads."""
    field = F.expr(_FIELD.replace("'o_", "'o_"))
    return parquet(spark, d, "nation").select(
        F.lit("orders").alias("contract_id"), F.col("n_name").alias("subscriber_id"), F.lit("").alias("subscriber_team"), F.array(F.lit("o_orderpriority"), field).alias("fields_consumed"),
        F.array(F.struct(field.alias("field"), F.lit("").alias("reason"))).alias("breaking_fields"), F.lit("WARN").alias("validation_mode"), F.lit("").alias("contact"),
    )


_ROOTS = "split_part(split_part({f}, '[', 1), '.', 1)"


@query(
    f"""WITH c AS (SELECT * FROM ({_CHANGES}) x WHERE change_type <> 'range_widened'), s AS (SELECT n_name, {_FIELD} AS field FROM nation),
m AS (SELECT n_name, column_name, change_type, {_ROOTS.format(f='field')} = column_name OR contains(field, column_name) OR contains(column_name, {_ROOTS.format(f='field')}) AS direct, column_name = 'o_orderpriority' AS reads FROM s CROSS JOIN c)
SELECT n_name AS subscriber_id, column_name, change_type, CASE WHEN direct THEN 'breaking_field' ELSE 'consumed_field' END AS dependency_type FROM m WHERE direct OR reads"""
)
def consumer_failure_modes(spark, d):
    return evolve.consumer_failures(_diff(spark, d), _subscriptions(spark, d), "orders").select("subscriber_id", F.col("column").alias("column_name"), "change_type", "dependency_type")


@query("SELECT contract_id, ref, rn AS rank FROM (SELECT o_orderpriority AS contract_id, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y%m%d') AS ref, row_number() OVER (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y%m%d') DESC) AS rn FROM (SELECT DISTINCT o_orderpriority, o_orderdate FROM orders) q) t WHERE rn <= 2")
def latest_two_snapshots(spark, d):
    refs = parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("contract_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("ref")).distinct()
    return evolve.latest_two(refs).select("contract_id", "ref", F.col("rank").cast("bigint").alias("rank"))


# ---- lineage and attribution


def _nation_edges(spark, d):
    n = parquet(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("target"))


_E = "e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation)"


@query(f"WITH RECURSIVE {_E}, r(n, d) AS (SELECT CAST(0 AS INTEGER), 0 UNION ALL SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.n WHERE r.d < 3) SELECT n AS node_id, min(d) AS hops FROM r GROUP BY n")
def lineage_bfs_nations(spark, d):
    start = parquet(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("node_id"))
    return lineage.walk(_nation_edges(spark, d), start, 3)


@query(f"WITH RECURSIVE {_E}, r(n, d) AS (SELECT CAST(3 AS INTEGER), 0 UNION ALL SELECT e.a, r.d + 1 FROM r JOIN e ON e.b = r.n WHERE r.d < 3) SELECT n AS node_id, min(d) AS hops FROM r GROUP BY n")
def lineage_upstream_nations(spark, d):
    start = parquet(spark, d, "nation").where("n_nationkey = 3").select(F.col("n_nationkey").alias("node_id"))
    return lineage.walk(_nation_edges(spark, d), start, 3, upstream=True)


@query(f"WITH RECURSIVE {_E}, r(n, d) AS (SELECT CAST(0 AS INTEGER), 0 UNION ALL SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.n WHERE r.d < 6) SELECT n AS node_id, min(d) AS hops FROM r GROUP BY n HAVING min(d) > 0")
def lineage_downstream_closure(spark, d):
    start = parquet(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("node_id"))
    return lineage.downstream(_nation_edges(spark, d), start, 6)


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(100 * greatest(0.05, least(1.0, 1.0 - 0.1 * (o_orderkey % 12) - 0.2 * (o_custkey % 4)))) AS BIGINT)) AS BIGINT) AS hundredths FROM orders GROUP BY o_orderpriority")
def blame_confidence_orders(spark, d):
    """Sums in whole hundredths, which are exact; a rounded mean can lie on a tie."""
    c = attribute.blame_confidence(F.col("o_orderkey") % 12, F.col("o_custkey") % 4)
    return parquet(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round(100 * c).cast("bigint")).alias("hundredths"))


@query(f"WITH f AS (SELECT DISTINCT 'orders.' || o_orderpriority AS check_id, CASE WHEN o_orderpriority < '3' THEN 'o_totalprice' ELSE 'O_ORDER' END AS column_name FROM orders), s AS (SELECT n_name, {_FIELD} AS field FROM nation) SELECT check_id, n_name AS subscriber_id, field AS breaking_field FROM f CROSS JOIN s WHERE contains(lower(column_name), lower({_ROOTS.format(f='field')})) OR contains(lower({_ROOTS.format(f='field')}), lower(column_name))")
def blast_radius_orders(spark, d):
    failed = parquet(spark, d, "orders").select(F.concat(F.lit("orders."), "o_orderpriority").alias("check_id"), F.lit("orders").alias("contract_id"), F.when(F.col("o_orderpriority") < "3", "o_totalprice").otherwise("O_ORDER").alias("column_name")).distinct()
    return attribute.blast_radius(failed, _subscriptions(spark, d)).select("check_id", "subscriber_id", "breaking_field")


@query(
    """WITH u AS (SELECT DISTINCT 'src/' || event_type AS file_path, CAST(length(event_type) % 3 AS INTEGER) AS hops FROM events),
c AS (SELECT file_path, commit_hash, row_number() OVER (PARTITION BY file_path ORDER BY stamp DESC, commit_hash) AS c FROM (SELECT 'src/' || event_type AS file_path, CAST(event_id AS VARCHAR) AS commit_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events WHERE event_type <> 'view') q),
m AS (SELECT u.file_path, u.hops, c.commit_hash, row_number() OVER (ORDER BY u.hops, u.file_path, c.c) AS rank FROM u LEFT JOIN (SELECT * FROM c WHERE c <= 2) c ON c.file_path = u.file_path)
SELECT CAST(rank AS INTEGER) AS rank, file_path, coalesce(commit_hash, 'unknown') AS commit_hash, hops FROM m WHERE rank <= 5"""
)
def blame_chain_events(spark, d):
    e = parquet(spark, d, "events")
    upstream = e.select(F.concat(F.lit("file::src/"), "event_type").alias("node_id"), (F.length("event_type") % 3).alias("hops")).distinct()
    commits = e.where("event_type <> 'view'").select(F.concat(F.lit("src/"), "event_type").alias("file_path"), F.col("event_id").cast("string").alias("commit_hash"), F.lit("").alias("author_email"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("commit_timestamp"), F.lit("").alias("commit_message"))
    return attribute.blame_chain(upstream, commits).select("rank", "file_path", "commit_hash", "hops")


@query("SELECT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P1' WHEN '2' THEN 'P2' ELSE 'P3' END AS priority, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 30 ELSE 120 END AS escalate_after_minutes, count(*) AS n FROM orders GROUP BY ALL")
def violation_routing_orders(spark, d):
    first = F.substring("o_orderpriority", 1, 1)
    severity = F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").otherwise("other")
    return parquet(spark, d, "orders").select("o_orderpriority", attribute.routing(severity).alias("r")).groupBy("o_orderpriority", "r.priority", "r.escalate_after_minutes").agg(F.count("*").alias("n"))


# ---- models


@query("SELECT round(1 - sum(m1*m2) / ((sqrt(sum(m1*m1)) + 1e-9) * (sqrt(sum(m2*m2)) + 1e-9)), 6) AS drift_score FROM (SELECT pos, avg(CAST(v AS DOUBLE)) FILTER (WHERE label < 5) AS m1, avg(CAST(v AS DOUBLE)) FILTER (WHERE label >= 5) AS m2 FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS pos FROM embeddings) t GROUP BY pos) u")
def embedding_drift(spark, d):
    e = parquet(spark, d, "embeddings")
    return ai.cosine_distance(ai.centroid(e.where("label < 5")), ai.centroid(e.where("label >= 5")))


@query("SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS pos FROM embeddings) t GROUP BY label, pos")
def embedding_centroids(spark, d):
    return ai.centroid(parquet(spark, d, "embeddings"), by=["label"]).select("label", "pos", F.round("value", 6).alias("value"))


_PROMPT = "length(text) > 8000 OR length(source) < 1"


def _prompts(spark, d):
    t = parquet(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_path"), F.col("text").alias("content_preview"))
    return ai.validate(t, ai.PROMPT_SCHEMA)


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE {_PROMPT}) AS invalid, CASE WHEN count(*) FILTER (WHERE {_PROMPT}) * 1.0 / count(*) > 0.05 THEN 'FAIL' WHEN count(*) FILTER (WHERE {_PROMPT}) * 1.0 / count(*) > 0.01 THEN 'WARN' ELSE 'PASS' END AS status FROM documents")
def prompt_input_validation(spark, d):
    return ai.prompt_verdict(_prompts(spark, d)).select("total", "invalid", "status")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'content_preview is longer than 8000' AS validation_errors FROM documents WHERE length(text) > 8000")
def prompt_quarantine(spark, d):
    return ai.quarantine(_prompts(spark, d)).select("record.doc_id", F.array_join("validation_errors", "; ").alias("validation_errors"))


@query("SELECT event_type, count(*) FILTER (WHERE CAST(json_extract_string(props,'$.k') AS INTEGER) > 90) AS violations, count(*) AS total FROM events GROUP BY event_type")
def llm_output_schema_events(spark, d):
    t = parquet(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p")).select("event_type", F.col("p.k").alias("k"))
    v = ai.validate(t, {"required": ["k"], "properties": {"k": {"type": "integer", "maximum": 90}}})
    return v.groupBy("event_type").agg(F.count_if(F.size("validation_errors") > 0).alias("violations"), F.count("*").alias("total"))


@query("SELECT CAST(d AS VARCHAR) AS d, CASE WHEN nh < 2 THEN 'stable' WHEN rate > 1.5 * h THEN 'rising' WHEN rate < 0.7 * h THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT d, rate, avg(rate) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h, count(*) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nh FROM (SELECT CAST(ts AS DATE) AS d, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1) q) w")
def trend_daily(spark, d):
    daily = parquet(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    return ai.trend(daily, "d", "rate").select(F.col("d").cast("string").alias("d"), "trend")


@query("SELECT count(*) FILTER (WHERE l_discount + l_tax > 0.15) AS token_mismatch, count(*) FILTER (WHERE l_returnflag NOT IN ('A','N')) AS run_type_violations FROM lineitem")
def trace_invariants(spark, d):
    t = parquet(spark, d, "lineitem")
    over = (F.col("l_discount") + F.col("l_tax") > 0.15).cast("bigint")
    known = F.when(F.col("l_returnflag").isin("A", "N"), "llm").otherwise(F.col("l_returnflag"))
    traces = t.select(over.alias("total_tokens"), F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), known.alias("run_type"), F.lit("").alias("start_time"), F.lit("").alias("end_time"))
    return ai.trace_verdict(traces).select("token_mismatch", "run_type_violations")


# ---- reports


@query("SELECT CAST(greatest(0, least(100, round_even(100.0 * count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*) - 5 * count(*) FILTER (WHERE o_orderpriority = 'none'), 0))) AS BIGINT) AS score FROM orders")
def health_score(spark, d):
    o = parquet(spark, d, "orders")
    reports = o.select(F.lit(1).cast("bigint").alias("total_checks"), (F.col("o_orderstatus") != "P").cast("bigint").alias("passed"))
    return report.health_score(reports, o.select(F.when(F.col("o_orderpriority") == "none", "HIGH").alias("severity"))).select("score")


@query("SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END, o_orderkey LIMIT 3")
def top_violations(spark, d):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("other")
    return report.top_violations(parquet(spark, d, "orders").select("o_orderkey", severity.alias("severity")), "o_orderkey").select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")
def dedup_latest_per_customer(spark, d):
    return report.latest(parquet(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT coalesce(nullif(event_type,'view'),'UNKNOWN') AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_histogram(spark, d):
    return report.severity_histogram(parquet(spark, d, "events"), F.when(F.col("event_type") != "view", F.col("event_type")))


@query("SELECT CAST(c_mktsegment AS VARCHAR) AS contract_id, c_nationkey % 3 AS change_type, max_by(c_acctbal, c_custkey) AS new_value FROM customer GROUP BY 1, 2")
def schema_change_summary(spark, d):
    c = parquet(spark, d, "customer").select(F.col("c_mktsegment").alias("contract_id"), (F.col("c_nationkey") % 3).alias("change_type"), F.lit("c").alias("column"), F.col("c_acctbal").alias("new_value"), F.col("c_custkey").alias("report_order"))
    return report.schema_changes(c).select("contract_id", "change_type", "new_value")


@query("SELECT o_orderpriority AS contract_id, CAST(floor(100.0 * passed / total_checks + 0.5) AS BIGINT) AS pass_rate FROM (SELECT o_orderpriority, day, count(*) AS total_checks, count(*) FILTER (WHERE o_orderstatus <> 'P') AS passed, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day DESC) AS rn FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS day FROM orders) o GROUP BY 1, 2) t WHERE rn = 1")
def pass_rates_orders(spark, d):
    monthly = parquet(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("contract_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run_timestamp")).agg(F.count("*").alias("total_checks"), F.count_if(F.col("o_orderstatus") != "P").alias("passed"))
    return report.pass_rates(monthly)


@query("SELECT count(*) AS total_checks, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS warned FROM orders")
def report_totals(spark, d):
    flag = lambda s: (F.col("o_orderstatus") == s).cast("bigint")
    return report.totals(parquet(spark, d, "orders").select(F.lit(1).cast("bigint").alias("total_checks"), flag("F").alias("passed"), flag("P").alias("failed"), flag("O").alias("warned"))).select("total_checks", "passed", "failed", "warned")


@query("SELECT DISTINCT user_id FROM events")
def log_append_once(spark, d):
    """Users of large errors are logged, then all users: what the second append leaves out is there once."""
    path = f"{scratch(spark)}/log"
    e = parquet(spark, d, "events")
    sinks.append_once(e.where("event_type = 'error' and value > 40").select("user_id"), path, "user_id")
    sinks.append_once(e.select("user_id"), path, "user_id")
    return readers.logged(spark, path, "user_id bigint").select("user_id")


@query("SELECT round_even(o_totalprice / 1000.0, 0) AS thousands, count(*) AS n FROM orders GROUP BY 1")
def half_even_prices(spark, d):
    return parquet(spark, d, "orders").groupBy(half_even(F.col("o_totalprice") / 1000.0).alias("thousands")).agg(F.count("*").alias("n"))


from clausewright.plans import documents, features  # noqa: E402, F401  register their queries
