"""Registered queries that go through files, documents and the graph: sources, sinks, contracts, reports, attribution."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clausewright.functions.expressions import numeric
from clausewright.operators import ai, attribute, checks, contract, drift, evolve, lineage, nested, profile, report
from clausewright.plans import phases
from clausewright.plans.catalogue import _CHANGES, _FIELD, _NEW, _PROMPT, ORDERS, _contract, _diff, _orders_after, _orders_before, _prompts, _subscriptions
from clausewright.plans.registry import documents, query, scratch
from clausewright.sources import readers, sinks
from clausewright.sources.readers import parquet


def _rows(spark, schema: str, rows: list):
    return spark.createDataFrame(rows, schema)


# ---- files


def _event_log(spark, d) -> str:
    """Events as lines of JSON, and for each error a line that is cut short."""
    path = f"{scratch(spark)}/events"
    e = parquet(spark, d, "events").select("event_id", "event_type", "value")
    e.write.json(path)
    e.where("event_type = 'error'").select(F.concat(F.lit('{"event_id": '), "event_id").alias("value")).write.mode("append").text(path)
    return path


@query("SELECT event_type, count(*) AS n, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def jsonl_events(spark, d):
    e = readers.jsonl(spark, _event_log(spark, d), "event_id bigint, event_type string, value double", require_rows=True)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT '{\"event_id\": ' || event_id AS line FROM events WHERE event_type = 'error'")
def jsonl_malformed_events(spark, d):
    return readers.malformed(spark, _event_log(spark, d), "event_id bigint, event_type string, value double")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS check_id FROM events")
def violation_log_users(spark, d):
    """Two appends to one log, the second of which leaves out what the first has logged."""
    path = f"{scratch(spark)}/log"
    rows = lambda e: e.select(F.col("user_id").cast("string").alias("check_id"), F.lit("HIGH").alias("severity"))
    e = parquet(spark, d, "events")
    sinks.append_once(rows(e.where("event_type = 'error'")), path)
    sinks.append_once(rows(e), path)
    return readers.violation_log(spark, path).select("check_id")


@query("SELECT coalesce(nullif(event_type, 'view'), 'UNKNOWN') AS severity, count(*) AS n FROM events GROUP BY 1")
def violation_log_severities(spark, d):
    path = f"{scratch(spark)}/log"
    e = parquet(spark, d, "events").select(F.col("event_id").cast("string").alias("violation_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("severity"))
    sinks.append_log(e, path)
    return report.severity_histogram(readers.violation_log(spark, path), F.col("severity"))


@query("SELECT c_mktsegment AS segment, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer GROUP BY c_mktsegment")
def file_digests_customers(spark, d):
    path = f"{scratch(spark)}/names"
    c = parquet(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("value"))
    c.repartition("segment").sortWithinPartitions("segment", "c_custkey").select("segment", "value").write.partitionBy("segment").text(path)
    return readers.digests(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "segment=([^/]+)", 1).alias("segment"), "sha256")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'content_preview is longer than 8000' AS error FROM documents WHERE length(text) > 8000")
def quarantine_log_documents(spark, d):
    path = f"{scratch(spark)}/quarantine"
    sinks.append_log(ai.quarantine(_prompts(spark, d)), path)
    return readers.logged(spark, path, "record struct<doc_id:string>, validation_errors array<string>").select("record.doc_id", F.explode("validation_errors").alias("error"))


@query("SELECT CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) t GROUP BY pos")
def centroid_file(spark, d):
    path = f"{scratch(spark)}/centroid"
    sinks.centroid(ai.centroid(parquet(spark, d, "embeddings")), path)
    return spark.read.parquet(path).select("pos", F.round("value", 6).alias("value"))


@query("SELECT 'part' AS contract_id, c AS column_name, round(m, 6) AS mean, n FROM (SELECT 'p_size' AS c, avg(p_size) AS m, count(*) AS n FROM part WHERE p_size > 10 UNION ALL SELECT 'p_retailprice', avg(p_retailprice), count(*) FROM part UNION ALL SELECT 'p_partkey', avg(p_partkey), count(*) FROM part WHERE p_size > 10) t")
def baselines_file_part(spark, d):
    """Baselines kept in a file: those of a later run replace the ones of the same columns."""
    p, path = parquet(spark, d, "part"), f"{documents(spark)}/baselines.json"
    of = lambda t, *c: profile.baselines_of(profile.profile(t, list(c)), "part").select("contract_id", "column", "mean", "stddev", "n")
    sinks.baselines(sinks.merged_baselines(of(p, "p_size", "p_retailprice"), of(p.where("p_size > 10"), "p_size", "p_partkey")), path)
    return readers.baselines(spark, path).select("contract_id", F.col("column").alias("column_name"), F.round("mean", 6).alias("mean"), "n")


_FAILED = """SELECT count(*) FILTER (WHERE n > 0) AS failed FROM (SELECT unnest([count(*) - count(o_orderkey), count(o_orderkey) - count(DISTINCT o_orderkey), count(*) FILTER (WHERE o_orderkey < 0), count(*) - count(o_custkey), count(o_custkey) - count(DISTINCT o_custkey),
count(*) - count(o_orderstatus), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) - count(o_totalprice), count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000), count(*) - count(o_orderpriority), count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))]) AS n FROM orders) t"""


@query(f"SELECT 'orders' AS contract_id, CAST(31 AS BIGINT) AS total_checks, 30 - failed AS passed, failed, CAST(1 AS BIGINT) AS errored FROM ({_FAILED}) f")
def report_file_orders(spark, d):
    """A validation's report as a document, read again as the newest of its folder."""
    folder = documents(spark)
    sinks.json_document(phases.report_of(checks.check_table(parquet(spark, d, "orders"), ORDERS), "orders", "ENFORCE"), f"{folder}/orders.json")
    assert readers.latest_report(folder) == f"{folder}/orders.json"
    return readers.reports(spark, folder).select("contract_id", "total_checks", "passed", "failed", "errored")


@query(f"SELECT status, n FROM (SELECT 'WARN' AS status, failed AS n FROM ({_FAILED}) f UNION ALL SELECT 'PASS', 30 - failed FROM ({_FAILED}) f UNION ALL SELECT 'ERROR', 1) t WHERE n > 0")
def validate_orders(spark, d):
    results, _ = phases.validate(parquet(spark, d, "orders"), ORDERS, "WARN")
    return results.groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT column_name, change_type, CASE WHEN change_type IN ('range_widened', 'add_nullable_column') THEN true ELSE false END AS backward_compatible FROM ({_CHANGES}) c")
def evolution_report_file(spark, d):
    """Changes between two contracts as a migration report on file, read again and summed up."""
    folder = documents(spark)
    sinks.json_document(evolve.migration_report("orders", "a", "b", _diff(spark, d), _subscriptions(spark, d)), f"{folder}/schema_evolution_orders.json")
    return report.schema_changes(readers.evolution_reports(spark, folder)).select(F.col("column").alias("column_name"), "change_type", "backward_compatible")


@query(_NEW)
def snapshots_orders(spark, d):
    """The clauses of the newest of two snapshots."""
    folder = documents(spark)
    for day, t in enumerate((_orders_before(spark, d), _orders_after(spark, d))):
        rows = contract.clauses_of(profile.profile(t, light=True)).collect()
        sinks.snapshot({"id": "orders", "schema": {r["column"]: {k: r[k] for k in ("type", "required", "minimum", "maximum") if r[k] is not None} for r in rows}}, folder, datetime(2025, 1, 1 + day))
    listed = readers.snapshots(folder, "orders")
    assert readers.latest_snapshot_ref(folder, "orders") == listed[-1].name
    return contract.clause_rows(spark, readers.snapshot_schema(listed[-1])).select(F.col("column").alias("column_name"), "type", "required", "minimum", "maximum")


@query("SELECT lower(c_mktsegment) AS contract_id, count(DISTINCT c_nationkey) AS subscribers, count(DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END) AS breaking FROM customer GROUP BY 1")
def registry_segments(spark, d):
    """A registry of subscribers, one for each segment and nation, as YAML and back."""
    path = f"{documents(spark)}/subscriptions.yaml"
    pairs = parquet(spark, d, "customer").select(F.lower("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n")).distinct().collect()
    sinks.yaml_document({"subscriptions": [{"contract_id": r["s"], "subscriber_id": f"{r['s']}-{r['n']}", "fields_consumed": ["c_name"], "breaking_fields": ["c_name"] * (r["n"] % 2 == 0)} for r in pairs]}, path)
    return readers.registry(spark, path).groupBy("contract_id").agg(F.count("*").alias("subscribers"), F.sum(F.size("breaking_fields")).alias("breaking"))


# ---- contracts

_KEYED = "SELECT *, regexp_replace(md5(CAST(o_orderkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS order_id, sha256(o_orderpriority) AS row_hash, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderstatus END AS state FROM orders"


def _keyed_orders(spark, d):
    o = parquet(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    uuid = F.regexp_replace(F.md5(F.col("o_orderkey").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return o.withColumns({"order_id": uuid, "row_hash": F.sha2("o_orderpriority", 256), "state": F.when(~(F.col("o_totalprice") > 300000), F.col("o_orderstatus"))})


def _clause_sql(c: str, kind: str, fmt: str = "NULL", unique: str = "false", enum: bool = True) -> str:
    number = kind != "string"
    bound = lambda f: f"CAST({f}({c}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    top = f"CASE WHEN '{kind}' = 'number' OR max({c}) <= 1000000 THEN {bound('max')} END" if number else bound("max")
    values = f"CASE WHEN count(DISTINCT {c}) <= 10 THEN (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM k WHERE {c} IS NOT NULL) q) END" if not number and enum else "NULL"
    return f"SELECT '{c}' AS column_name, '{kind}' AS type, (count(*) - count({c})) < 0.01 * count(*) AS required, {'false' if number else f'count({c}) < count(*)'} AS nullable, {unique} AS \"unique\", {fmt} AS format, {values} AS enum, {bound('min')} AS minimum, {top} AS maximum FROM k"


@query(f"WITH k AS ({_KEYED}) " + " UNION ALL ".join([_clause_sql("o_orderkey", "integer"), _clause_sql("o_custkey", "integer"), _clause_sql("o_totalprice", "number"), _clause_sql("o_orderstatus", "string"), _clause_sql("o_orderpriority", "string"), _clause_sql("order_id", "string", "'uuid'", "true"), _clause_sql("row_hash", "string", "'sha256'"), _clause_sql("state", "string")]))
def contract_file_orders(spark, d):
    """A table's contract, with formats, enums and unique ids, written as YAML and read again."""
    path = f"{documents(spark)}/orders.yaml"
    sinks.yaml_document(contract.build_contract(_keyed_orders(spark, d), "orders", "orders", "orders.parquet"), path)
    c = contract.clause_rows(spark, readers.contract(path)["schema"])
    return c.select(F.col("column").alias("column_name"), "type", "required", "nullable", "unique", "format", F.array_join(F.array_sort("enum"), ",").alias("enum"), "minimum", "maximum")


@query(f"WITH k AS ({_KEYED}) SELECT 'missing_count(' || c || ') = 0' AS check_text FROM (SELECT unnest([{{'c': 'o_orderkey', 'n': count(o_orderkey)}}, {{'c': 'o_custkey', 'n': count(o_custkey)}}, {{'c': 'o_totalprice', 'n': count(o_totalprice)}}, {{'c': 'o_orderstatus', 'n': count(o_orderstatus)}}, {{'c': 'o_orderpriority', 'n': count(o_orderpriority)}}, {{'c': 'order_id', 'n': count(order_id)}}, {{'c': 'row_hash', 'n': count(row_hash)}}, {{'c': 'state', 'n': count(state)}}], recursive := true), count(*) AS t FROM k) q WHERE n = t UNION ALL SELECT 'duplicate_count(order_id) = 0' UNION ALL SELECT 'row_count >= 1'")
def quality_checks_orders(spark, d):
    made = contract.build_contract(_keyed_orders(spark, d), "orders", "orders")["quality"]["specification"]
    return _rows(spark, "check_text string", [(c,) for c in made["checks for orders"]])


@query(f"WITH k AS ({_KEYED}) SELECT c AS column_name, 'not_null' AS test FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderstatus', 'o_orderpriority', 'order_id', 'row_hash']) AS c) q UNION ALL SELECT 'order_id', 'unique' FROM k GROUP BY 1, 2 HAVING count(DISTINCT order_id) = count(*) UNION ALL SELECT c, 'accepted_values:' || string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT 'o_orderstatus' AS c, o_orderstatus AS v FROM k UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM k UNION SELECT DISTINCT 'row_hash', row_hash FROM k UNION SELECT DISTINCT 'state', state FROM k WHERE state IS NOT NULL) e GROUP BY c")
def dbt_tests_orders(spark, d):
    made = contract.dbt_schema(contract.build_contract(_keyed_orders(spark, d), "orders", "orders"), "orders")["models"][0]["columns"]
    name = lambda t: t if isinstance(t, str) else "accepted_values:" + ",".join(sorted(t["accepted_values"]["values"]))
    return _rows(spark, "column_name string, test string", [(c["name"], name(t)) for c in made for t in c.get("tests", [])])


@query("SELECT 'c_name' AS column_name, count(DISTINCT c_name) || ' values' AS note FROM customer")
def contract_notes_customer(spark, d):
    """Notes for strings with neither format nor enum; the segments are an enum."""
    c = parquet(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal")
    made = contract.build_contract(c, "customer", "customer", annotate=lambda name, row: {"note": f"{row['cardinality']} values"})["schema"]
    return _rows(spark, "column_name string, note string", [(k, v["llm_annotations"]["note"]) for k, v in made.items() if "llm_annotations" in v])


_PART_NODES = "SELECT DISTINCT 'brand::' || p.p_brand AS id, p.p_brand || ' ' || l.l_returnflag AS description FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_linenumber = 3"


def _brand_graph(spark, d):
    p = parquet(spark, d, "part").select("p_partkey", "p_brand")
    nodes = p.select(F.concat(F.lit("brand::"), "p_brand").alias("node_id"), F.col("p_brand").alias("label")).distinct()
    lines = parquet(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag").join(p, F.col("l_partkey") == F.col("p_partkey"))
    edges = lines.select(F.concat(F.lit("table::line_item_"), "l_linenumber").alias("source"), F.concat(F.lit("brand::"), "p_brand").alias("target"), F.col("l_returnflag").alias("relationship")).distinct()
    return nodes, edges


@query(_PART_NODES)
def lineage_consumers_lines(spark, d):
    return lineage.consumers(*_brand_graph(spark, d), "LineItem_3").select("id", "description")


@query(f"SELECT DISTINCT id FROM ({_PART_NODES}) q UNION SELECT 'static'")
def contract_downstream_lines(spark, d):
    """Downstream of a contract: what is known beforehand, and what the graph knows, each id once."""
    known = [{"id": "static"}, *[r.asDict() for r in lineage.consumers(*_brand_graph(spark, d), "LineItem_3").collect()]]
    made = contract.build_contract(parquet(spark, d, "region"), "lines", "lines", downstream=known)
    return _rows(spark, "id string", [(x["id"],) for x in made["lineage"]["downstream"]])


@query(f"WITH k AS ({_KEYED}) SELECT 'orders' AS id, CAST(8 AS BIGINT) AS clauses, count(DISTINCT o_orderpriority) AS downstream FROM k")
def catalog_row_orders(spark, d):
    o = _keyed_orders(spark, d)
    row = report.catalog_row(contract.build_contract(o, "orders", "orders", downstream=[{"id": r[0]} for r in o.select("o_orderpriority").distinct().collect()]))
    return _rows(spark, "id string, clauses bigint, downstream bigint", [(row["id"], row["clauses"], row["downstream"])])


# ---- profiles


@query("SELECT 'overall_verdict' AS column_name, CASE WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) = 0 THEN 'FAIL,PASS,WARN' END AS enum FROM orders UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) <= 10 THEN 'few' END FROM customer")
def profile_enums(spark, d):
    o = parquet(spark, d, "orders")
    verdict = o.select(F.try_element_at(F.create_map(*map(F.lit, ("F", "PASS", "O", "FAIL", "P", "WARN"))), F.col("o_orderstatus")).alias("overall_verdict"))
    found = {"overall_verdict": profile.observed_enum(verdict, "overall_verdict"), "o_orderpriority": profile.observed_enum(o, "o_orderpriority"), "c_name": profile.observed_enum(parquet(spark, d, "customer"), "c_name")}
    return _rows(spark, "column_name string, enum string", [(k, ",".join(sorted(v)) if v else None) for k, v in found.items()])


@query("SELECT 'vec_id' AS column_name, 'integer' AS dtype, '' AS keys, count(vec_id) AS non_null FROM embeddings UNION ALL SELECT 'embedding', 'array', '', count(embedding) FROM embeddings UNION ALL SELECT 'rows', 'array_of_objects', 'label,vec_id', count(*) FROM embeddings UNION ALL SELECT 'row', 'object', 'label', count(*) FROM embeddings UNION ALL SELECT 'odd', 'boolean', '', count(label) FROM embeddings")
def profile_kinds_embeddings(spark, d):
    e = parquet(spark, d, "embeddings").select("vec_id", "embedding", F.array(F.struct("label", "vec_id")).alias("rows"), F.struct("label").alias("row"), (F.col("label") % 2 == 1).alias("odd"))
    return profile.profile(e, light=True).select(F.col("column").alias("column_name"), "dtype", F.array_join("keys", ",").alias("keys"), "non_null")


_CONFIDENT = {"discount_confidence": "l_discount * 8", "tax_confidence": "l_tax / 100", "full_confidence": "1.0 - l_tax / 1000", "fair_confidence": "l_discount * 5"}


def _confident_lines(spark, d):
    return parquet(spark, d, "lineitem").select(*[F.expr(x).alias(c) for c, x in _CONFIDENT.items()], F.lit(7).alias("seven"), F.pow(F.col("l_quantity"), F.lit(8)).alias("heavy"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN max({x}) > 1 THEN 'scale' WHEN avg({x}) > 0.99 THEN 'clamped' WHEN avg({x}) < 0.01 THEN 'broken' END AS warning FROM lineitem" for c, x in _CONFIDENT.items()))
def profile_warnings_lines(spark, d):
    p = profile.profile(_confident_lines(spark, d).select(*_CONFIDENT))
    said = F.when(F.col("warning").contains("0 to 100"), "scale").when(F.col("warning").contains("clamped"), "clamped").when(F.col("warning").contains("broken"), "broken")
    return p.select(F.col("column").alias("column_name"), said.alias("warning"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, CASE WHEN max({x}) > 1 THEN 'scale' WHEN avg({x}) > 0.99 THEN 'one' WHEN avg({x}) < 0.01 THEN 'zero' END AS flag FROM lineitem) q WHERE flag IS NOT NULL" for c, x in _CONFIDENT.items()) + " UNION ALL SELECT 'seven', 'constant' UNION ALL SELECT 'heavy', 'outliers' FROM (SELECT avg(pow(l_quantity, 8)) AS m, quantile_cont(pow(l_quantity, 8), 0.75) AS q FROM lineitem) t WHERE m > 3 * q AND q > 0")
def profile_suspicious_lines(spark, d):
    f = F.col("flag")
    said = F.when(f.contains("constant"), "constant").when(f.contains("wrong scale"), "scale").when(f.contains("always 1"), "one").when(f.contains("always 0"), "zero").when(f.contains("outliers"), "outliers")
    return profile.suspicious(profile.profile(_confident_lines(spark, d))).select(F.col("column").alias("column_name"), said.alias("flag"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') >= 0.8 * count(*) THEN 'sha256' WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') >= 0.8 * count(*) THEN 'semver' END AS format FROM orders UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') >= 0.8 * count(*) THEN 'sha256' END FROM orders")
def detect_format_mixed(spark, d):
    """A column of two formats has none, one in which another is rare has it."""
    o = parquet(spark, d, "orders")
    digest, version = F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit("1.2.3")
    mixed = o.select(F.when(F.col("o_orderstatus") == "F", digest).otherwise(version).alias("v"))
    rare = o.select(F.when(F.col("o_orderstatus") != "P", digest).otherwise(version).alias("v"))
    return profile.detect_format(mixed, "v").unionByName(profile.detect_format(rare, "v"))


@query("SELECT o_orderpriority AS text, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS first, TRY_CAST(substr(o_orderpriority, 3) AS DOUBLE) AS rest, count(*) AS n FROM orders GROUP BY o_orderpriority")
def numeric_strings(spark, d):
    o = parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("text"), F.substring("o_orderpriority", 1, 1).alias("a"), F.substring("o_orderpriority", 3, 99).alias("b"))
    kind = o.schema["a"].dataType
    return o.groupBy("text", numeric(F.col("a"), kind).alias("first"), numeric(F.col("b"), kind).alias("rest")).agg(F.count("*").alias("n"))


# ---- checks


@query("WITH e AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber <= 3), l AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS records_failing FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.o = l.o AND e.p = l.p)")
def references_in_orders(spark, d):
    """Each order as a record whose lines refer to parts, of which it lists those of its first three lines."""
    part = F.col("l_partkey").cast("string")
    fact, entity = F.struct(F.array(part).alias("entity_refs")), F.when(F.col("l_linenumber") <= 3, F.struct(part.alias("entity_id")))
    records = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(fact).alias("extracted_facts"), F.collect_list(entity).alias("entities"))
    return checks.references(records, "orders").select("status", "records_failing")


@query("SELECT CASE WHEN count(DISTINCT user_id) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(DISTINCT user_id) AS records_failing FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) t WHERE value <= prev")
def monotonic_in_file_order(spark, d):
    """Values in the order of the file, in which event ids rise."""
    e = readers.with_row_order(parquet(spark, d, "events").select("user_id", "value"))
    return checks.monotonic(e, "events", ["row_order"], "user_id", "value").select("status", "records_failing")


@query("SELECT count(*) FILTER (WHERE v > 1) AS records_failing, 'CRITICAL' AS severity FROM (SELECT CASE WHEN l_discount <= 1 THEN round_even(l_discount * 100, 1) ELSE l_discount END AS v FROM lineitem) t")
def injected_scale_fault(spark, d):
    items = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").alias("confidence"))).alias("extracted_facts"))
    return checks.check_table(checks.inject_scale_fault(items), _contract("lines", extracted_facts={"type": "array"})).where("check_type = 'range'").select("records_failing", "severity")


_STRICT = "SELECT count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS a, count(*) FILTER (WHERE l_quantity > 40) AS b FROM lineitem"


@query(f"SELECT 'flag.enum' AS part, a AS records_failing FROM ({_STRICT}) q UNION ALL SELECT 'quantity.range', b FROM ({_STRICT}) q")
def strict_nested_lines(spark, d):
    items = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    c = _contract("orders", lines={"type": "array", "items": {"flag": {"enum": ["A", "N"]}, "quantity": {"type": "number", "maximum": 40}}})
    return nested.nested_checks(items, c).select(F.regexp_replace("check_id", r"^orders\.lines\[\]\.", "").alias("part"), "records_failing")


_MOVED = """SELECT c.k AS column_name, abs(c.m - b.m) / b.s AS dev FROM (SELECT event_type AS k, avg(value + length(event_type) * 12) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1) c
JOIN (SELECT event_type AS k, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1) b ON b.k = c.k"""


@query(f"SELECT column_name, CASE WHEN dev > 3 THEN 'FAIL' ELSE 'WARN' END AS status, CASE WHEN dev > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM ({_MOVED}) q WHERE dev > 2")
def drift_rows_events(spark, d):
    """Values moved on by 12 for each letter of an event's type, against the days before."""
    e = parquet(spark, d, "events")
    of = lambda t, v: t.groupBy(F.col("event_type").alias("column")).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.count(v).alias("n")).withColumn("contract_id", F.lit("events"))
    now = of(e.where("ts >= '2024-01-11'"), F.col("value") + F.length("event_type") * 12)
    return drift.drift(now, of(e.where("ts < '2024-01-11'"), F.col("value"))).select("column_name", "status", "severity")


_OLD_KIND, _NEW_KIND = "o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_orderpriority < '4'", "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderpriority > '2'"
_SETS = f"WITH a AS (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE {_OLD_KIND}), b AS (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE {_NEW_KIND})"


@query(f"""{_SETS} SELECT * FROM (SELECT 'o_orderpriority' AS column_name, 'add_enum_value' AS change_type, '[' || string_agg(v, ', ' ORDER BY v) || ']' AS new_value FROM b WHERE v NOT IN (SELECT v FROM a)
UNION ALL SELECT 'o_orderpriority', 'remove_enum_value', (SELECT '[' || string_agg(v, ', ' ORDER BY v) || ']' FROM b) FROM a WHERE v NOT IN (SELECT v FROM b) GROUP BY 1, 2) q WHERE new_value IS NOT NULL
UNION ALL SELECT 'o_custkey', 'type_widening', 'string' UNION ALL SELECT 'price', 'type_narrowing', 'number' UNION ALL SELECT 'code', 'pattern_changed', '^[a-f0-9]{{64}}$'
UNION ALL SELECT 'status', 'add_required_column', 'required=true' FROM orders WHERE {_OLD_KIND} AND o_orderstatus = 'F' GROUP BY 1, 2 HAVING count(*) > 0""")
def schema_diff_kinds(spark, d):
    """Changes of type, enum, pattern and requirement between two contracts of the same orders, before and after."""
    o = parquet(spark, d, "orders")
    common = lambda t, *c: t.select("o_orderpriority", *c)
    old = common(o.where(_OLD_KIND.replace("TIMESTAMP ", "timestamp")), "o_custkey", F.concat(F.lit("p"), "o_totalprice").alias("price"), F.sha1(F.col("o_orderkey").cast("string")).alias("code"), F.when(F.col("o_orderstatus") != "F", "x").alias("status"))
    new = common(o.where(_NEW_KIND.replace("TIMESTAMP ", "timestamp")), F.concat(F.lit("c"), "o_custkey").alias("o_custkey"), F.col("o_totalprice").alias("price"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("code"), F.lit("x").alias("status"))
    of = lambda t: contract.clause_rows(spark, contract.clauses(t, exact=False)[0])
    kinds = ("type_widening", "type_narrowing", "add_enum_value", "remove_enum_value", "pattern_changed", "add_required_column")
    few = evolve.diff(of(old), of(new)).where(F.col("change_type").isin(*kinds))
    return few.where("column = 'o_orderpriority' or change_type not like '%enum%'").select(F.col("column").alias("column_name"), "change_type", "new_value")


# ---- attribution

_LINE_EDGES = "SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem"
_START = "SELECT 'c' || c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000"
_REACHED = f"WITH RECURSIVE e AS ({_LINE_EDGES}), r(n, d) AS (SELECT n, 0 FROM ({_START}) s UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.n WHERE r.d < 4)"


def _order_graph(spark, d):
    """Customers to their orders to the parts in them."""
    to = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    o = parquet(spark, d, "orders").select(to("c", "o_custkey").alias("source"), to("o", "o_orderkey").alias("target"))
    edges = o.unionByName(parquet(spark, d, "lineitem").select(to("o", "l_orderkey").alias("source"), to("p", "l_partkey").alias("target")))
    start = parquet(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(to("c", "c_custkey").alias("node_id"))
    return edges, start


@query(f"{_REACHED} SELECT n AS node_id, min(d) AS hops FROM r GROUP BY n")
def lineage_walk_orders(spark, d):
    """All orders and parts that some customers reach: a graph that grows with the tables, with parts that many orders share."""
    edges, start = _order_graph(spark, d)
    return lineage.walk(edges, start, 4)


@query(f"{_REACHED} SELECT n AS node_id, min(d) AS hops FROM r GROUP BY n HAVING min(d) > 0")
def contamination_depth_orders(spark, d):
    edges, start = _order_graph(spark, d)
    return attribute.contamination_depth(edges, start, 4)


@query("WITH p AS (SELECT min(p_partkey) AS k FROM part), near AS (SELECT count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey, p WHERE l.l_partkey = p.k AND c_mktsegment = 'BUILDING' AND c_acctbal > 9000) SELECT CASE WHEN n > 0 THEN 2 ELSE 1 END AS depth FROM near")
def subscriber_depth_orders(spark, d):
    """Hops from some customers to the first part, whose label names a subscriber; 1 if they never order it."""
    edges, start = _order_graph(spark, d)
    part = parquet(spark, d, "part")
    nodes = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.when(F.col("p_partkey") == part.agg(F.min("p_partkey")).first()[0], "Cartographer").otherwise("other").alias("label"))
    return _rows(spark, "depth int", [(attribute.downstream_depth("week4-cartographer", nodes, edges, start),)])


@query("SELECT CASE c_nationkey % 6 WHEN 0 THEN 'week4-lineage-generation' WHEN 1 THEN 'week7-violation-attributor' WHEN 2 THEN 'week7-schema-contract' WHEN 3 THEN 'week7-ai-contract-extension' WHEN 4 THEN 'week2-evaluation-pipeline' ELSE c_mktsegment || '-reader' END AS pipeline, count(*) AS n FROM customer GROUP BY 1")
def subscriber_pipelines(spark, d):
    part = F.try_element_at(F.create_map(*[F.lit(x) for kv in enumerate(("cartographer", "violation-attributor", "schema-contract", "ai-contract", "courtroom", "reader")) for x in kv]), F.col("c_nationkey") % 6)
    c = parquet(spark, d, "customer").select(attribute.subscriber_pipeline(F.concat_ws("-", "c_mktsegment", part)).alias("pipeline"))
    return c.groupBy("pipeline").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'week3-document-extraction-pipeline' WHEN event_type = 'error' THEN 'week2-evaluation-pipeline' END AS pipeline, count(*) AS n FROM events GROUP BY 1")
def file_pipelines(spark, d):
    path = F.when(F.col("event_type") == "click", "src/week3/extractor.py").when(F.col("event_type") == "error", "src/week2/scorer.py").otherwise("elsewhere.py")
    return parquet(spark, d, "events").groupBy(attribute.file_pipeline(path).alias("pipeline")).agg(F.count("*").alias("n"))


_KIND = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'range' WHEN '2' THEN 'unique' WHEN '3' THEN 'format' ELSE 'other' END"


@query(f"SELECT kind, CASE kind WHEN 'range' THEN 3 ELSE 2 END AS steps, CASE kind WHEN 'range' THEN 'bounds' WHEN 'unique' THEN 'key' WHEN 'format' THEN 'shape' ELSE 'disagree' END AS about, count(*) AS n FROM (SELECT {_KIND} AS kind FROM orders) q GROUP BY kind")
def mitigation_orders(spark, d):
    o = parquet(spark, d, "orders").select(F.expr(_KIND).alias("kind")).withColumn("m", attribute.mitigation(F.col("kind")))
    about = F.regexp_extract("m.guidance", "(bounds|key|shape|disagree)", 1)
    return o.groupBy("kind", F.size("m.steps").alias("steps"), about.alias("about")).agg(F.count("*").alias("n"))


@query("SELECT 1 AS rank, 'src/' || event_type AS file_path, CAST(event_id AS VARCHAR) AS commit_hash, CASE WHEN event_type = 'click' THEN 0.5 ELSE round(greatest(0.05, 1 - 0.1 * floor(date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') / 86400.0)), 2) END AS confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_type = 'click' THEN 'at ' ELSE '' END || strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, CAST(event_id AS VARCHAR)) AS r FROM events WHERE event_type = 'click' OR date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') <= 30 * 86400) q WHERE r = 1")
def ai_blame_events(spark, d):
    """Clicks as commits whose time can't be read."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    commits = parquet(spark, d, "events").select(F.concat(F.lit("src/"), "event_type").alias("file_path"), F.col("event_id").cast("string").alias("commit_hash"), F.lit("").alias("author_email"), F.when(F.col("event_type") == "click", F.concat(F.lit("at "), at)).otherwise(at).alias("commit_timestamp"), F.lit("").alias("commit_message"))
    found = attribute.ai_blame(commits, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return found.where("rank = 1").select("rank", "file_path", "commit_hash", F.round("confidence_score", 2).alias("confidence_score"))


@query(f"SELECT n_name AS subscriber_id FROM nation WHERE contains({_FIELD}, 'o_total')")
def ai_consumers(spark, d):
    return ai.registered_consumers(_subscriptions(spark, d), "orders", "o_total").select("subscriber_id")


_BAD = {"o_custkey.unique": ("count(o_custkey) - count(DISTINCT o_custkey)", "P1"), "o_orderstatus.enum": ("count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))", "P1"), "o_totalprice.range": ("count(*) FILTER (WHERE o_totalprice > 400000)", "P2"), "o_orderpriority.pattern": ("count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))", "P2")}
# Each failing column's table is fed by the tables of some days' orders, and feeds the views of some customers.
_FED = {"o_custkey": 0, "o_orderstatus": 1, "o_totalprice": 2, "o_orderpriority": 3}


@query(
    "WITH f AS (" + " UNION ALL ".join(f"SELECT 'orders.{k}' AS check_id, '{k.split('.')[0]}' AS col, {_FED[k.split('.')[0]]} AS i, {n} AS n, '{p}' AS priority FROM orders" for k, (n, p) in _BAD.items()) + f"), s AS (SELECT n_name, split_part(split_part({_FIELD}, '[', 1), '.', 1) AS field FROM nation)"
    ", u AS (SELECT f.check_id, 'raw' || strftime(o_orderdate, '%Y%m') AS file, max(o_orderkey) AS top, count(*) AS c FROM f JOIN orders ON o_orderkey % 4 = f.i AND o_orderdate >= TIMESTAMP '1998-06-01 00:00:00' GROUP BY ALL),"
    " b AS (SELECT check_id, least(5, 1 + sum(least(c, 2))) AS blamed FROM u GROUP BY check_id), m AS (SELECT check_id, 'o' || top AS newest FROM u QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY file) = 1)"
    " SELECT f.check_id, f.n AS records_failing, f.priority, (SELECT count(*) FROM s WHERE contains(s.field, f.col) OR contains(f.col, s.field)) AS affected, CAST(coalesce(b.blamed, 1) AS BIGINT) AS blamed, m.newest AS newest,"
    " (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 4 = f.i) + (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey % 4 = f.i) AS nodes FROM f LEFT JOIN b ON b.check_id = f.check_id LEFT JOIN m ON m.check_id = f.check_id WHERE f.n > 0"
)
def violations_orders(spark, d):
    """Failed checks of orders with whom they hurt, where they go, what the graph has downstream, and the commits (orders) to the tables upstream of each column."""
    o, c = parquet(spark, d, "orders"), parquet(spark, d, "customer")
    column = lambda k: F.element_at(F.array(*[F.lit(f"table::{n}") for n in _FED]), (F.col(k) % 4 + 1).cast("int"))
    recent = o.where("o_orderdate >= timestamp'1998-06-01 00:00:00'").select("o_orderkey", F.concat(F.lit("raw"), F.date_format("o_orderdate", "yyyyMM"), F.lit("_"), (F.col("o_orderkey") % 4).cast("string")).alias("raw"))
    edges = recent.select("raw", column("o_orderkey").alias("target")).withColumnRenamed("raw", "source")
    edges = edges.unionByName(c.select(column("c_nationkey").alias("source"), F.concat(F.lit("nation"), "c_nationkey").alias("target"))).unionByName(c.select(F.concat(F.lit("nation"), "c_nationkey").alias("source"), F.concat(F.lit("view"), "c_custkey").alias("target")))
    nodes = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    commits = recent.select(F.col("raw").alias("file_path"), F.concat(F.lit("o"), "o_orderkey").alias("commit_hash"), F.lit("a@b.c").alias("author_email"), F.format_string("2025-01-01 %012d", "o_orderkey").alias("commit_timestamp"), F.lit("m").alias("commit_message"))
    v = attribute.violations(checks.check_table(o, ORDERS), "orders", _subscriptions(spark, d), nodes, edges, commits)
    return v.select("check_id", "records_failing", "routing.priority", F.col("blast_radius.affected").cast("bigint").alias("affected"), F.size("blame_chain").cast("bigint").alias("blamed"), F.get("blame_chain", F.lit(1))["commit_hash"].alias("newest"), F.size("blast_radius.affected_nodes").cast("bigint").alias("nodes"))


def _day_snapshots(spark, d):
    o = parquet(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("captured_at"), F.concat(F.lit("o"), "o_orderkey").alias("o"), F.concat(F.lit("c"), "o_custkey").alias("c"))
    return o.groupBy("captured_at").agg(F.collect_list(F.struct(F.col("o").alias("node_id"))).alias("nodes"), F.collect_list(F.struct(F.col("c").alias("source"), F.col("o").alias("target"))).alias("edges"))


@query("SELECT 'o' || o_orderkey AS node_id FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)")
def latest_lineage_nodes(spark, d):
    return lineage.nodes_of(lineage.latest_snapshot(_day_snapshots(spark, d)))


@query("SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)")
def latest_lineage_edges(spark, d):
    return lineage.edges_of(lineage.latest_snapshot(_day_snapshots(spark, d)))


# ---- models


def _talks(spark, d):
    """Conversations as extractions whose facts are their turns."""
    c = parquet(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("extracted_facts"))
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("talks").alias("source_path"), "extracted_facts")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'talks' AS source_path, substr(string_agg(substr(text, 1, 200), ' ' ORDER BY turn, role, text) FILTER (WHERE r <= 5), 1, 8000) AS content_preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations) q GROUP BY conv_id")
def prompt_inputs_talks(spark, d):
    return ai.prompt_inputs(_talks(spark, d))


@query("SELECT count(*) AS n, count(DISTINCT text) AS kinds FROM conversations WHERE text <> ''")
def sampled_texts_talks(spark, d):
    """A sample as large as the table is the table."""
    talks = _talks(spark, d)
    texts = ai.sample_texts(talks, "extracted_facts", n=2**31 - 1)
    return texts.agg(F.count("*").alias("n"), F.count_distinct("text").alias("kinds"))


_SCORE = "SELECT round(1 - sum(m1*m2) / ((sqrt(sum(m1*m1)) + 1e-9) * (sqrt(sum(m2*m2)) + 1e-9)), 6) AS s FROM (SELECT pos, avg(CAST(v AS DOUBLE)) FILTER (WHERE label < 5) AS m1, avg(CAST(v AS DOUBLE)) FILTER (WHERE label >= 5) AS m2 FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding,1) AS pos FROM embeddings) t GROUP BY pos) u"


@query(f"SELECT 'moved' AS run, CASE WHEN s > 0.15 THEN 'FAIL' ELSE 'PASS' END AS status, least(1.0, greatest(0.0, s)) AS drift_score FROM ({_SCORE}) q UNION ALL SELECT 'same', 'PASS', 0.0 UNION ALL SELECT 'first', CASE WHEN count(*) > 0 THEN 'BASELINE_SET' ELSE 'ERROR' END, NULL FROM embeddings UNION ALL SELECT 'none', 'ERROR', NULL")
def embedding_drift_status(spark, d):
    e = parquet(spark, d, "embeddings")
    a, b, n = ai.centroid(e.where("label < 5")), ai.centroid(e.where("label >= 5")), e.count()
    runs = {"moved": (a, b, n), "same": (a, a, n), "first": (a, None, n), "none": (a, b, 0)}
    out = None
    for name, given in runs.items():
        one = ai.embedding_drift(*given).select(F.lit(name).alias("run"), "status", "drift_score")
        out = one if out is None else out.unionByName(one)
    return out


_DAYS = "SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1"


@query(f"WITH days AS ({_DAYS}), last AS (SELECT * FROM days WHERE d = (SELECT max(d) FROM days)), h AS (SELECT avg(r) AS m, max(k) AS k FROM (SELECT bad * 1.0 / n AS r, row_number() OVER (ORDER BY d DESC) AS i, count(*) OVER () AS k FROM days WHERE d < (SELECT max(d) FROM days)) q WHERE i <= 3), v AS (SELECT n, bad, bad * 1.0 / n AS r, CASE WHEN h.k < 2 THEN 'stable' WHEN bad * 1.0 / n > 1.5 * m THEN 'rising' WHEN bad * 1.0 / n < 0.7 * m THEN 'falling' ELSE 'stable' END AS trend FROM last, h) SELECT n AS total_outputs, bad AS schema_violations, trend, CASE WHEN r > 0.1 THEN 'FAIL' WHEN trend = 'rising' THEN 'WARN' ELSE 'PASS' END AS status FROM v")
def output_verdict_last_day(spark, d):
    """The last day's outputs against the rates of former days, kept in a log."""
    path = f"{scratch(spark)}/rates"
    e = parquet(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type")
    last = e.agg(F.max("day")).first()[0]
    rates = e.where(F.col("day") < F.lit(last)).groupBy(F.col("day").cast("string").alias("run_date")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("violation_rate"))
    sinks.append_log(rates.withColumn("contract_id", F.lit("events")), path)
    rule = {"required": ["event_type"], "properties": {"event_type": {"type": "string", "pattern": "^(?!error$)"}}}
    v = ai.output_verdict(ai.validate(e.where(F.col("day") == F.lit(last)).select("event_type"), rule), readers.rate_history(spark, path, "events"))
    return v.select("total_outputs", "schema_violations", "trend", "status")


_RATE = f"count(*) FILTER (WHERE {_PROMPT}) * 1.0 / count(*)"


@query(f"SELECT CASE WHEN {_RATE} > 0.05 THEN 'FAIL' WHEN {_RATE} > 0.01 THEN 'WARN' ELSE 'PASS' END AS prompts, CASE WHEN {_RATE} > 0.05 THEN 'FAIL' WHEN {_RATE} > 0.01 THEN 'WARN' ELSE 'WARN' END AS overall, CASE WHEN {_RATE} > 0.01 THEN 'AMBER' ELSE 'GREEN' END AS risk FROM documents")
def ai_metrics_file(spark, d):
    """The checks of models as a document on file, their overall status and the risk that a report makes of them."""
    path = f"{documents(spark)}/ai_metrics.json"
    prompts = ai.prompt_verdict(_prompts(spark, d)).first().asDict()
    parts = {"embedding_drift": {"status": "BASELINE_SET"}, "prompt_input_validation": prompts}
    sinks.json_document(parts | {"overall_status": ai.overall_status([p["status"] for p in parts.values()])}, path)
    kept = readers.document(path)
    return _rows(spark, "prompts string, overall string, risk string", [(kept["prompt_input_validation"]["status"], kept["overall_status"], report.ai_risk(kept)["overall_ai_status"])])


# ---- reports

_HEALTH = "SELECT CAST(greatest(0, least(100, round_even(100.0 * count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*) - 20 * count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END), 0))) AS BIGINT) AS score, count(*) AS total FROM orders"


def _order_reports(spark, d):
    o = parquet(spark, d, "orders")
    reports = o.select(F.lit("orders").alias("contract_id"), F.lit("2025").alias("run_timestamp"), F.lit(1).cast("bigint").alias("total_checks"), (F.col("o_orderstatus") != "P").cast("bigint").alias("passed"), F.lit(0).cast("bigint").alias("failed"), F.lit(0).cast("bigint").alias("warned"))
    v = o.where("o_orderpriority = '1-URGENT'").groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("log_pos"))
    return reports, v.select(F.col("o_orderstatus").alias("violation_id"), F.col("o_orderstatus").alias("check_id"), F.lit("orders").alias("contract_id"), F.lit("x").alias("column_name"), F.lit("CRITICAL").alias("severity"), F.lit("m").alias("message"), "log_pos")


@query(f"SELECT score, CASE WHEN score >= 90 THEN 'Healthy' WHEN score < 60 THEN 'Poor' ELSE 'Fair' END AS tier FROM ({_HEALTH}) q")
def health_narrative(spark, d):
    return report.health_score(*_order_reports(spark, d)).select("score", F.split_part("narrative", F.lit(":"), F.lit(1)).alias("tier"))


@query(f"SELECT score, total AS total_checks, (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderpriority = '1-URGENT') AS critical FROM ({_HEALTH}) q")
def health_report_file(spark, d):
    folder = documents(spark)
    reports, v = _order_reports(spark, d)
    changes = _diff(spark, d).withColumns({"contract_id": F.lit("orders"), "report_order": F.concat("column", "change_type")})
    path, _ = sinks.report(report.build(reports, v, changes, {}), folder)
    kept = readers.document(path)
    return _rows(spark, "score bigint, total_checks bigint, critical bigint", [(kept["data_health_score"], kept["validation_summary"]["total_checks"], kept["violations"]["by_severity"]["CRITICAL"])])


@query("SELECT CAST(row_number() OVER (ORDER BY rank, log_pos) AS BIGINT) AS priority, severity FROM (SELECT o_orderpriority AS check_id, min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 3 END) AS rank, arg_min(CASE o_orderstatus WHEN 'P' THEN 'CRITICAL' WHEN 'F' THEN 'HIGH' ELSE 'LOW' END, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 3 END * 1000000000000 + o_orderkey) AS severity, min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 3 END * 1000000000000 + o_orderkey) AS log_pos FROM orders GROUP BY 1) q QUALIFY priority <= 3")
def recommended_actions_orders(spark, d):
    severity = F.when(F.col("o_orderstatus") == "P", "CRITICAL").when(F.col("o_orderstatus") == "F", "HIGH").otherwise("LOW")
    v = parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("check_id"), F.lit("orders").alias("contract_id"), F.lit("x").alias("column_name"), severity.alias("severity"), F.lit("m").alias("message"), F.col("o_orderkey").alias("log_pos"))
    return _rows(spark, "priority bigint, severity string", [(a["priority"], a["severity"]) for a in report.recommended_actions(v)])


@query("SELECT o_orderpriority AS contract_id, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS reports, min(strftime(o_orderdate, '%Y-%m')) AS first_run, count(*) AS total_checks FROM orders GROUP BY 1")
def reports_by_contract(spark, d):
    monthly = parquet(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("contract_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run_timestamp")).agg(F.count("*").alias("total_checks"), F.count_if(F.col("o_orderstatus") != "P").alias("passed"))
    total = F.aggregate("reports", F.lit(0).cast("bigint"), lambda s, r: s + r["total_checks"])
    return report.by_contract(monthly).select("contract_id", F.size("reports").cast("bigint").alias("reports"), F.get("reports", F.lit(0))["run_timestamp"].alias("first_run"), total.alias("total_checks"))
