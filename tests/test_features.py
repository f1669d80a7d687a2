"""Logs, lines that don't fit, check texts, nested clauses."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from clausewright.operators import attribute, checks, contract, nested, profile, report, texts
from clausewright.sources import log, readers, sinks


def rows(spark, values, schema="check_id string, n int"):
    return spark.createDataFrame(values, schema)


def test_log_keeps_the_order_of_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(6):
        sinks.append_log(rows(spark, [(f"b{i}", j) for j in range(5)]).repartition(3), path, order=["n"])
    kept = readers.logged(spark, path, "check_id string, n int").orderBy("log_pos").collect()
    assert [(r.check_id, r.n) for r in kept] == [(f"b{i}", j) for i in range(6) for j in range(5)]
    severe = readers.logged(spark, path, "check_id string, n int").withColumn("severity", F.lit("HIGH"))
    assert [r.check_id for r in report.top_violations(severe).collect()] == ["b0"] * 3


def test_log_without_a_manifest_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert sinks.append_log(rows(spark, [("a", 1)]), path) == 1

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(log, "_publish", fail)
    with pytest.raises(OSError):
        sinks.append_log(rows(spark, [("b", 2)]), path)
    monkeypatch.undo()
    assert [r.check_id for r in readers.logged(spark, path, "check_id string").collect()] == ["a"]
    assert sinks.append_log(rows(spark, [("c", 3)]), path) == 2 and log.commits(spark, path) == [1, 2]


def test_two_writers_take_two_numbers(spark, tmp_path):
    path, done = str(tmp_path / "log"), []
    threads = [threading.Thread(target=lambda i=i: done.append(sinks.append_log(rows(spark, [(f"t{i}", i)]), path))) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == [1, 2, 3, 4] and readers.logged(spark, path, "check_id string").count() == 4
    with pytest.raises(log.Conflict):
        log.append(rows(spark, [("x", 1)]), path, after=2)
    assert readers.logged(spark, path, "check_id string").count() == 4


def test_append_once_with_null_keys_ties_and_a_faster_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    given = rows(spark, [("a", 3), ("a", 1), (None, 5), (None, 4), ("b", 2)])
    assert sinks.append_once(given, path, order=["n"]) == 3 and sinks.append_once(given, path) == 0
    assert [(r.check_id, r.n) for r in readers.logged(spark, path, "check_id string, n int").orderBy("log_pos").collect()] == [("a", 1), ("b", 2), (None, 4)]
    real, raced = log.append, []

    def append(new, to, order=None, after=None):
        if not raced:
            raced.append(real(rows(spark, [("c", 1)]), to))
        return real(new, to, order, after)

    monkeypatch.setattr(log, "append", append)
    # Another writer logs c while c and d are compared with the log.
    assert sinks.append_once(rows(spark, [("c", 9), ("d", 9)]), path) == 1
    assert sorted(str(r.check_id) for r in readers.logged(spark, path, "check_id string").collect()) == ["None", "a", "b", "c", "d"]


def test_a_log_from_elsewhere_comes_before_commits(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "violations.jsonl").write_text('# a comment\n{"check_id":"old2"}\n{"check_id":"old1"}\n')
    sinks.append_log(rows(spark, [("new", 1)]), str(tmp_path / "log"))
    assert [r.check_id for r in readers.violation_log(spark, str(tmp_path / "log")).orderBy("log_pos").collect()] == ["old2", "old1", "new"]
    one = readers.violation_log(spark, str(tmp_path / "log" / "violations.jsonl")).orderBy("log_pos")
    assert [r.check_id for r in one.collect()] == ["old2", "old1"]
    with pytest.raises(ValueError):
        sinks.append_log(rows(spark, [("x", 1)]), str(tmp_path / "log" / "violations.jsonl"))
    assert readers.violation_log(spark, str(tmp_path / "none")).count() == 0


def test_rows_and_rejects_add_up_to_the_lines(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    lines = ['{"a": 1, "b": "x"}', '{"a": "no", "b": "y"}', '{"a": 2.5, "b": "z"}', "{cut", "[1]", "7", "", "  ", '{"a": null}', '{"b": "only", "more": [1]}', '{"a": {"x": 1}}']
    open(path, "w").write("\n".join(lines))
    df = readers.jsonl(spark, path, "a bigint, b string")
    assert df.count() == len(df.collect()) == len(df.select("b").collect()) == 3
    bad = [r.line for r in readers.malformed(spark, path, "a bigint, b string").collect()]
    assert sorted(bad) == sorted(['{"a": "no", "b": "y"}', '{"a": 2.5, "b": "z"}', "{cut", "[1]", "7", '{"a": {"x": 1}}'])
    open(path, "w").write('{"a": "x"}\n')
    with pytest.raises(ValueError):
        readers.jsonl(spark, path, "a bigint", require_rows=True)
    assert readers.jsonl(spark, path).first().a == "x"


def test_records_keep_apart_what_does_not_fit(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    lines = ['{"a": 1, "s": {"x": 1}}', '{"a": "no", "b": [1, 2], "c": null}', "{cut", "[1]", '{"a": 1, "a": 2}', '{"a": null}', '{"a": "7"}']
    open(path, "w").write("\n".join(lines) + "\n\n")
    got = {r.line: r for r in readers.records(spark, path, "a bigint, s struct<x:int>").collect()}
    assert len(got) == 7 and {k for k, r in got.items() if r.broken} == {"{cut", "[1]", '{"a": 1, "a": 2}'}
    assert got[lines[0]].record.s.x == 1 and got[lines[0]].wrong == {} and got[lines[6]].record.a == 7
    assert got[lines[1]].wrong == {"a": '"no"'} and {k: json.loads(v) for k, v in got[lines[1]].unknown.items()} == {"b": [1, 2], "c": None}
    assert got[lines[5]].wrong == {} and got[lines[5]].record.a is None and got["{cut"].record is None


def test_enum_of_booleans_and_bounds_that_are_not_numbers(spark):
    df = spark.createDataFrame([(True, 5, "x"), (False, 7, "y")], "b boolean, i int, s string")
    c = {"id": "c", "schema": {"b": {"type": "boolean", "enum": [True]}, "i": {"type": "integer", "minimum": "low", "maximum": True}, "s": {"enum": ["x"]}}}
    got = {r.check_id: (r.status, r.records_failing) for r in checks.check_table(df, c).collect()}
    assert got["c.b.enum"] == ("FAIL", 1) and got["c.s.enum"] == ("FAIL", 1) and got["c.i.range"] == ("ERROR", 0) and got["c.i.required"] == ("PASS", 0)


def test_unique_columns_are_counted_without_repeating_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b")], "i int, s string")
    found = checks.check_table(df, {"id": "c", "schema": {"i": {"unique": True}, "s": {"unique": True}}})
    assert {r.check_id: r.records_failing for r in found.where("check_type = 'unique'").collect()} == {"c.i.unique": 1, "c.s.unique": 1}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text,status,failing",
    [
        ("row_count >= 1", "PASS", 0), ("row_count = 4", "PASS", 0), ("row_count between 5 and 9", "FAIL", 0), ("missing_count(a) = 0", "FAIL", 1), ("missing_count(a)=1", "PASS", 0), ("duplicate_count(b) = 0", "FAIL", 2),
        ("min(a) >= 2", "FAIL", 1), ("max(a) < 3", "FAIL", 1), ("max(a) <= 3 where b = 'x'", "PASS", 0), ("avg(a) != 2", "FAIL", 0), ("max_length(b) <= 0", "FAIL", 4), ("min(a) >= 0 where b = 'nothing'", "ERROR", 0),
        ("distinct_count(b) == 2", "PASS", 0), ("sum(a) > 5", "PASS", 0), ("stddev(a) <= 1e0", "PASS", 0), ("missing_percent(a) < 20", "FAIL", 1), ("nonsense", "ERROR", 0), ("median(a) = 1", "ERROR", 0), ("min(zz) = 1", "ERROR", 0),
        ("row_count(a) = 1", "ERROR", 0), ("min = 1", "ERROR", 0), ("min(a) = 1 where zz > 1", "ERROR", 0), ("min(a) = 1 where (((", "ERROR", 0),
    ],
)
def test_check_text(spark, text, status, failing):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (None, "y")], "a int, b string")
    (r,) = texts.check_texts(df, {"id": "c"}, [text]).collect()
    assert (r.status, r.records_failing) == (status, failing) and (r.expected == text or status == "ERROR" and text in r.message + r.expected)


def test_texts_of_a_built_contract_are_one_scan_and_equal_checks(spark):
    df = spark.createDataFrame([(0.5, 3), (0.75, 4)], "confidence double, processing_time_ms int")
    c = contract.build_contract(df, "c", "t")
    worse = spark.createDataFrame([(50.0, 3), (0.5, 0), (None, 1)], "confidence double, processing_time_ms int")
    found = texts.check_texts(worse, c)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    by_text = {r.expected: (r.status, r.records_failing) for r in found.collect()}
    own = {r.check_id: r.records_failing for r in checks.check_table(worse, c).collect()}
    assert by_text["missing_count(confidence) = 0"] == ("FAIL", own["c.confidence.required"]) == ("FAIL", 1)
    assert by_text["max(confidence) <= 1.0"] == ("FAIL", own["c.confidence.range"]) and by_text["min(processing_time_ms) >= 1"] == ("FAIL", 1)
    empty = texts.check_texts(worse.limit(0), c)
    assert {r.expected: r.status for r in empty.collect()}["row_count >= 1"] == "FAIL" and texts.check_texts(worse, {"id": "n"}).count() == 0


NESTED = "m map<string,struct<v:int,tags:array<string>>>, o struct<a:int,b:struct<c:string,d:int>>, l array<array<string>>"


def inside(df, **clauses):
    return {r.check_id.removeprefix("n."): (r.status, r.records_failing) for r in nested.nested_checks(df, {"id": "n", "schema": clauses}).collect()}


def test_nested_clauses_of_maps_structs_and_arrays(spark):
    df = spark.createDataFrame(
        [({"x": (1, ["a", "b"]), "y": (9, None)}, (1, ("ok", 5)), [["q", "q"], ["r", None]]), ({"z": None}, (None, None), None), (None, None, [None, []]), ({}, (3, (None, None)), [["long"]])], NESTED
    )
    tag = {"type": "array", "items": {"type": "string", "enum": ["a"], "unique": True}}
    got = inside(
        df,
        m={"type": "object", "properties": {"x": {"type": "object", "properties": {"v": {"minimum": 2}}}}, "additionalProperties": {"type": "object", "properties": {"v": {"maximum": 5, "required": True}, "tags": tag}}},
        o={"type": "object", "properties": {"a": {"required": True}, "b": {"properties": {"c": {"required": True, "pattern": "^ok$"}, "e": {"required": True}}}}, "additionalProperties": False},
        l={"type": "array", "items": {"type": "array", "items": {"type": "string", "maxLength": 1, "unique": True, "required": True}}},
    )
    assert got["m.x.v.range"] == ("FAIL", 1) and got["m{}.v.range"] == ("FAIL", 1) and got["m{}.v.required"] == ("PASS", 0) and got["m{}.tags[].enum"] == ("PASS", 0)
    assert got["o.a.required"] == ("FAIL", 1) and got["o.b.c.required"] == ("FAIL", 1) and got["o.b.c.pattern"] == ("PASS", 0) and got["o.b.e.exists"] == ("ERROR", 0)
    assert got["l[][].length"] == ("FAIL", 1) and got["l[][].unique"] == ("FAIL", 1) and got["l[][].required"] == ("FAIL", 1)
    closed = inside(df, m={"type": "object", "properties": {"x": {}}, "additionalProperties": False}, o={"properties": {"a": {}}, "additionalProperties": False})
    assert closed == {"m{}.unexpected": ("FAIL", 2), "o.b.unexpected": ("FAIL", 2)}


def test_nested_clauses_that_cannot_be_checked(spark):
    df = spark.createDataFrame([([{"a": 1}],)], "l array<map<string,int>>")
    got = inside(df, l={"type": "array", "items": {"type": "object", "additionalProperties": {"type": "integer", "pattern": "(", "minimum": "x", "required": True}}})
    assert got == {"l[]{}.required": ("PASS", 0), "l[]{}.pattern": ("ERROR", 0), "l[]{}.range": ("ERROR", 0)}
    assert inside(df.limit(0), l={"items": {"type": "object", "additionalProperties": {"maximum": 0}}}) == {"l[]{}.range": ("PASS", 0)}
    assert inside(df, l={"type": "array"}, gone={"type": "array", "items": {"a": {"required": True}}}) == {}


def test_known_sub_schemas_are_enforced(spark):
    """The clauses that well-known nested columns get, of a contract built from data, against data that breaks each of them."""
    score = "scores map<string,struct<score:bigint,evidence:array<string>,notes:string>>, nodes array<struct<node_id:string,type:string,label:string>>, token_count struct<input:bigint,output:bigint>, edges array<struct<source:string,target:string,relationship:string,confidence:double>>"
    good = spark.createDataFrame([({"a": (3, ["e"], "n")}, [("file::x", "FILE", "l")], (1, 2), [("a", "b", "CALLS", 0.5)])], score)
    bad = spark.createDataFrame([({"a": (9, ["e"], "n"), "b": (0, [], "")}, [("x", "ODD", "l")], (-1, 2), [("a", "b", "KNOWS", 1.5)])], score)
    c = contract.build_contract(good, "k", "t")
    ok = {r.check_id: r.records_failing for r in nested.nested_checks(good, c).collect()}
    got = {r.check_id: r.records_failing for r in nested.nested_checks(bad, c).collect()}
    assert set(ok.values()) == {0} and {k for k, n in got.items() if n} == {"k.scores{}.score.range", "k.nodes[].node_id.pattern", "k.nodes[].type.enum", "k.token_count.input.range", "k.edges[].relationship.enum", "k.edges[].confidence.range"}
    assert got["k.scores{}.score.range"] == 2


def test_walks_of_several_starts_are_made_together(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "a"), (None, "c"), ("a", "b")], "source string, target string")
    start = spark.createDataFrame([("k1", "a"), ("k2", "x"), ("k2", None)], "column_name string, node_id string")
    from clausewright.operators import lineage

    got = {(r.column_name, r.node_id): r.hops for r in lineage.walk(e, start, 9).collect()}
    assert got == {("k1", "a"): 0, ("k1", "b"): 1, ("k1", "c"): 2, ("k2", "x"): 0, ("k2", "c"): 1, ("k2", "a"): 2, ("k2", "b"): 3}


def test_few_values_are_grouped_once_and_only_where_there_can_be_few(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), F.col("id") % 3).alias("few"), F.col("id").cast("string").alias("many"), F.lit("PASS").alias("overall_verdict"), F.lit(None).cast("string").alias("none"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("enums", "")
    got = profile.observed_enums(df, df.columns)
    jobs = len(tracker.getJobIdsForGroup("enums"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"few": ["v0", "v1", "v2"], "many": None, "overall_verdict": ["PASS", "FAIL", "WARN"], "none": None} and jobs <= 4


def test_actions_name_files_and_pipelines(spark):
    chain = [(1, "src/a.py", "h", "a", "t", "m", 0.9)]
    v = spark.createDataFrame(
        [("1", "k", "c", "x", "HIGH", "bad", chain, (["n1", "n2", "n3", "n4"], ["p1"], 3, "registry+lineage"), 1), ("2", "ai_extensions.embedding_drift", "c", None, "CRITICAL", "old", None, None, 2), ("3", "j", "c", "y", None, "m", [], ([], [], 0, ""), 3), ("4", "i", "c", "z", "ODD", "m", None, None, 0)],
        "violation_id string, check_id string, contract_id string, column_name string, severity string, message string, blame_chain array<struct<rank:int,file_path:string,commit_hash:string,author:string,commit_timestamp:string,commit_message:string,confidence_score:double>>, blast_radius struct<affected_nodes:array<string>,affected_pipelines:array<string>,estimated_records:bigint,blast_radius_source:string>, log_pos int",
    )
    got = report.recommended_actions(v, {"embedding_drift": {"status": "PASS", "drift_score": 0.25}})
    assert [(a["severity"], a["file"], a["affected_pipelines"]) for a in got] == [("CRITICAL", "contracts/ai_extensions.py", []), ("HIGH", "src/a.py", ["p1"]), (None, "unknown", [])]
    assert "0.2500" in got[0]["action"] and "old" not in got[0]["action"]
    top = {r.violation_id: r.downstream_impact for r in report.summary_of(report.top_violations(v)).collect()}
    assert top == {"2": "No downstream consumers known.", "1": "Affects 4 downstream node(s): n1, n2, n3", "3": "No downstream consumers known."}


def test_violations_go_through_the_log_into_the_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (None, 500.0)], "id int, price double")
    results = checks.check_table(df, {"id": "c", "schema": {"id": {"type": "integer", "required": True}, "price": {"type": "number", "maximum": 10}}})
    registry = spark.createDataFrame([("c", "w4-cartographer", "team", ["id"], [("id", "r")], "ENFORCE", None, "me@x")], readers.SUBSCRIPTION)
    edges = spark.createDataFrame([("src", "table::id"), ("table::id", "view1"), ("view1", "view2"), ("view2", "view1")], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in ("src", "table::id", "view1", "view2")], "node_id string")
    commits = spark.createDataFrame([("src", "h1", "a@b", "2025-01-01 00:00:00", "m")], readers.COMMIT)
    v = attribute.violations(results, "c", registry, nodes, edges, commits, snapshot="s1")
    sinks.append_log(v, str(tmp_path / "log"), order=["check_id"])
    kept = readers.violation_log(spark, str(tmp_path / "log"))
    by = {r.column_name: r for r in kept.collect()}
    assert by["id"].blast_radius.affected_nodes == ["view1", "view2"] and by["id"].blast_radius.affected_pipelines == ["week4-lineage-generation"]
    assert [b.commit_hash for b in by["id"].blame_chain] == ["unknown", "h1"] and by["price"].blame_chain is None and by["price"].blast_radius.affected_nodes == []
    assert by["id"].blast_radius.estimated_records == 1 and report.recommended_actions(kept)[0]["affected_pipelines"] == ["week4-lineage-generation"]
