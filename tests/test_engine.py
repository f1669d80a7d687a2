"""Operators on small hand-made tables: traps, parity of counts, fault scenarios, properties."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clausewright.operators import ai, attribute, checks, contract, drift, evolve, lineage, nested, profile, report
from clausewright.plans import phases
from clausewright.sources import readers, sinks

UUID = "aaaaaaaa-bbbb-cccc-dddd-%012d"


def extraction_rows(n=60, scale=1.0, bad_ref=None):
    rows = []
    for i in range(n):
        ents = [{"entity_id": UUID % (1000 * i + j), "name": f"e{j}", "type": "ORG", "canonical_value": "x"} for j in range(2)]
        facts = [{"fact_id": UUID % (5000 + 10 * i + j), "text": f"fact {i} {j} of the text", "entity_refs": [ents[j]["entity_id"]], "confidence": round((0.5 + (i * 5 + j) % 40 / 100) * scale, 4), "page_ref": None, "source_excerpt": "s"} for j in range(2)]
        if bad_ref == i:
            facts[0]["entity_refs"] += ["nowhere", "nowhere"]
        rows.append({"doc_id": UUID % i, "source_path": f"p/{i}", "source_hash": f"{i:064x}", "extracted_facts": facts, "entities": ents, "extraction_model": "claude-x", "processing_time_ms": 100 + i, "token_count": {"input": 5, "output": 6}, "extracted_at": f"2025-01-01T00:{i:02d}:00Z"})
    return rows


@pytest.fixture(scope="module")
def extractions(spark, tmp_path_factory):
    def make(**k):
        path = tmp_path_factory.mktemp("x") / "extractions.jsonl"
        path.write_text("\n".join(map(json.dumps, extraction_rows(**k))) + "\n\n{broken\n")
        return readers.jsonl(spark, str(path), readers.SCHEMAS["extractions"])

    return make


def statuses(results):
    return {r.check_id: r.status for r in results.collect()}


def test_malformed_lines_are_left_out(extractions):
    assert extractions().count() == 60


def test_contract_of_extractions_and_its_41_results(spark, extractions):
    df = extractions()
    c = contract.build_contract(df, "week3-document-refinery-extractions", "extractions")
    s = c["schema"]
    assert s["doc_id"]["format"] == "uuid" and s["doc_id"]["unique"] and s["source_hash"]["format"] == "sha256"
    assert s["extracted_facts"]["items"]["confidence"]["maximum"] == 1.0 and s["processing_time_ms"]["minimum"] == 1
    results, base = phases.validate(df, c)
    # 6 for each scalar, 1 for each nested column, confidences of facts, references
    assert results.count() == 6 * 6 + 3 + 1 + 1 == 41
    assert set(statuses(results).values()) == {"PASS"}
    assert {r.column for r in base.collect()} == {"processing_time_ms"}


@pytest.mark.parametrize("mode,status", [("ENFORCE", "FAIL"), ("WARN", "WARN"), ("AUDIT", "INFO")])
def test_scale_fault_fails_one_check(spark, extractions, mode, status):
    c = contract.build_contract(extractions(), "week3", "extractions")
    results, _ = phases.validate(checks.inject_scale_fault(extractions()), c, mode)
    odd = [r for r in results.collect() if r.status != "PASS"]
    assert [(r.check_id, r.status, r.severity, r.records_failing) for r in odd] == [("week3.extracted_facts.confidence.range", status, "CRITICAL", 120)]
    doc = phases.report_of(results, "week3", mode)
    assert doc["failed"] == (1 if mode == "ENFORCE" else 0) and doc["passed"] == 40


def test_dangling_references_count_refs(extractions):
    r = checks.references(extractions(bad_ref=3), "w").first()
    assert (r.status, r.severity, r.records_failing) == ("FAIL", "HIGH", 2)


def test_null_entities_are_empty(spark):
    df = spark.createDataFrame([("d", "p", "h", [("f", "t", ["e1"], 0.5, 1, "s")], None, "m", 1, None, "t")], readers.SCHEMAS["extractions"])
    assert checks.references(df, "w").first().records_failing == 1


def test_nan_counts_as_null_and_strings_as_numbers_only_if_plain(spark):
    df = spark.createDataFrame([(1.0, "5"), (float("nan"), "1d"), (None, "abc")], "x double, s string")
    c = {"id": "t", "schema": {"x": {"type": "number", "required": True}, "s": {"type": "string", "minimum": 0, "maximum": 4}, "gone": {"type": "string"}}}
    got = {r.check_id: r for r in checks.check_table(df, c).collect()}
    assert got["t.x.required"].records_failing == 2
    assert got["t.s.range"].records_failing == 1 and got["t.s.range"].status == "FAIL"
    assert got["t.gone.exists"].status == "ERROR"
    only_text = checks.check_table(df.select("s").where("s = 'abc'"), {"id": "t", "schema": {"s": {"minimum": 0}}}).where("check_type = 'range'").first()
    assert only_text.status == "ERROR"


def test_format_is_of_all_values(spark):
    digests = spark.range(0, 60, 1, 1).selectExpr("sha2(string(id), 256) as h", "cast(null as string) as n")
    mixed = digests.unionByName(spark.range(0, 60, 1, 1).selectExpr("'plain' as h", "cast(null as string) as n"))
    assert profile.detect_format(mixed, "h").first()["format"] is None
    assert profile.detect_format(mixed, "h", sample=50).first()["format"] == "sha256"
    assert profile.detect_format(digests, "h").first()["format"] == "sha256" and profile.detect_format(digests, "n").first()["format"] is None
    rows = {r["column"]: r for r in contract.clauses(mixed.withColumnRenamed("h", "a.b"))[1]}
    assert rows["a.b"]["format"] is None and rows["n"]["format"] is None


def test_formats_patterns_and_samples(spark):
    df = spark.createDataFrame([(UUID % 1,), ((UUID % 2).upper(),), ("nope",), (None,)], "u string")
    c = {"id": "t", "schema": {"u": {"format": "uuid", "pattern": contract.PATTERNS["uuid"], "unique": True}, "bad": {}}}
    got = {r.check_id: r for r in checks.with_samples(checks.check_table(df, c), df, c, order=["u"]).collect()}
    assert got["t.u.format"].records_failing == 1 and got["t.u.format"].sample_failing == ["nope"]
    assert got["t.u.pattern"].records_failing == 2
    assert checks.check_table(df, {"id": "t", "schema": {"u": {"pattern": "("}}}).where("check_type = 'pattern'").first().status == "ERROR"


def test_unique_counts_surplus_rows_also_beyond_three_columns(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 2), (1, 3, 3, None), (2, 3, 4, None)], "a int, b int, c int, d int")
    c = {"id": "t", "schema": {k: {"unique": True} for k in "abcd"}}
    got = {r.column_name: r.records_failing for r in checks.check_table(df, c).where("check_type = 'unique'").collect()}
    assert got == {"a": 2, "b": 1, "c": 0, "d": 0}
    assert checks.failing_rows(df, c, "a", "unique").count() == 3


def test_monotonic_and_temporal_order(spark):
    df = spark.createDataFrame([("a", 1, "2025-01-01", "2025-01-02"), ("a", 1, "2025-01-03", "2025-01-02"), ("b", 1, "", "2025"), ("b", 2, None, "2")], "aggregate_id string, sequence_number int, occurred_at string, recorded_at string")
    assert checks.monotonic(df.withColumn("o", F.monotonically_increasing_id()), "w", order=["o"]).first().records_failing == 1
    assert checks.temporal_order(df, "w", "occurred_at", "recorded_at").first().records_failing == 1


def test_monotonic_is_in_file_order(spark, tmp_path):
    rows = "aggregate_id string, sequence_number int, occurred_at string, recorded_at string"
    df = spark.createDataFrame([("a", n, "2025", "2025") for n in (5, 3, 1)] + [("b", n, "2025", "2025") for n in (1, 2, 4)], rows).coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j"))
    for t in (spark.read.parquet(str(tmp_path / "p")), spark.read.schema(rows).json(str(tmp_path / "j")), df):
        assert checks.monotonic(readers.with_row_order(t), "w", ["row_order"]).first().records_failing == 1
        found = statuses(phases.validate(t, {"id": "w", "schema": {}})[0])
        assert found["w.sequence_number.monotonic"] == "FAIL" and found["w.recorded_at.temporal_order"] == "PASS"
    with pytest.raises(ValueError):
        checks.monotonic(df, "w", ["sequence_number"])


def test_patterns_are_those_of_the_engine(spark):
    df = spark.createDataFrame([("ab",), ("x",)], "s string")
    of = lambda p: checks.check_table(df, {"id": "t", "schema": {"s": {"pattern": p, "required": True}}}).where("check_type = 'pattern'").first()
    assert of("(?P<x>ab)").status == "ERROR" and of("(?<x>ab)").records_failing == 1 and of("(").status == "ERROR"


def test_nothing_is_divided_by_zero(spark):
    e = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 5.0)], "k string, v double")
    assert [r.k for r in drift.drift_between(e, e, "k", "v").collect()] == ["b"]
    r = spark.createDataFrame([("c", "2025", 0, 0)], "contract_id string, run_timestamp string, total_checks long, passed long")
    assert report.pass_rates(r).first().pass_rate == 100
    assert report.health_score(r, spark.createDataFrame([], "severity string")).first().score == 100


def test_changes_are_read_from_files(spark, tmp_path):
    changes = evolve.diff(contract.clause_rows(spark, schema(x={"maximum": 9}, z={})), contract.clause_rows(spark, schema(x={"maximum": 1})))
    assert readers.evolution_reports(spark, str(tmp_path)).count() == 0
    for n in "ab":
        sinks.json_document(evolve.migration_report("c", n, "z", changes), str(tmp_path / f"schema_evolution_{n}.json"))
    (tmp_path / "schema_evolution_c.json").write_text("{broken")
    read = readers.evolution_reports(spark, str(tmp_path))
    assert read.count() == 4
    assert [(r.column, r.change_type, r.new_value) for r in report.schema_changes(read).collect()] == [("x", "range_tightened", "[None, 1.0]"), ("z", "remove_column", None)]


def test_depth_pipelines_and_blame_of_model_checks(spark):
    edges = spark.createDataFrame([("p", "a"), ("a", "b"), ("b", "a"), ("p", "c")], "source string, target string")
    nodes = spark.createDataFrame([("p", None), ("a", None), ("b", "The Cartographer"), ("c", "c")], "node_id string, label string")
    start = spark.createDataFrame([("p",)], "node_id string")
    assert attribute.downstream_depth("week4-cartographer", nodes, edges, start) == 2 and attribute.downstream_depth("week4-cartographer", nodes) == 0
    assert attribute.downstream_depth("week4-nobody", nodes, edges, start) == 1
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(attribute.subscriber_pipeline(F.lit("week9-ai-contract-x"))) == "week7-ai-contract-extension" and one(attribute.subscriber_pipeline(F.lit("me"), {})) == "me"
    assert one(attribute.file_pipeline(F.lit("f.py"), {"f.py": "own"})) == "own" and one(attribute.file_pipeline(F.lit("f.py"))) is None
    commits = spark.createDataFrame([("f", "h1", "a", "2025-01-30 00:00:00 +0000", "m"), ("f", "h2", "a", "2024-11-01 00:00:00 +0000", "m"), ("f", "h3", "a", "soon", "m"), ("f", "h4", "a", "2025-01-20 00:00:00 +0000", "m")], readers.COMMIT)
    got = attribute.ai_blame(commits, F.lit("2025-01-31 00:00:00").cast("timestamp")).orderBy("rank").collect()
    assert [(r.commit_hash, r.confidence_score) for r in got] == [("h3", 0.5), ("h1", 0.9)]
    m = one(attribute.mitigation(F.lit("range")))
    assert len(m.steps) == 3 and one(attribute.mitigation(F.lit("odd"))).guidance == attribute.MITIGATION["default"][0]


def test_profile_of_many_strings_and_light(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), (None, "x", 3)], "s string, t string, i int")
    assert {r.column: r.cardinality for r in profile.profile(df).collect()} == {"s": 2, "t": 1, "i": None}
    light = {r.column: r for r in profile.profile(df, light=True).collect()}
    assert light["i"].max == 3.0 and light["i"].p50 is None and light["s"].cardinality is None and light["s"].null_fraction == pytest.approx(1 / 3)


def test_drift_moves_its_baseline(spark):
    c = {"id": "t", "schema": {"x": {"type": "number"}, "k": {"type": "number"}}}
    of = lambda d: drift.moments(spark.createDataFrame([(d + i % 3 - 1.0, 1.0) for i in range(30)], "x double, k double"), c)
    base = spark.createDataFrame([], drift.BASELINES)
    assert drift.drift(of(0), base).count() == 0
    base = drift.advance(of(0), base)
    sd = {r.column: r.stddev for r in base.collect()}["x"]
    assert [r.status for r in drift.drift(of(2.5 * sd), base).collect()] == ["WARN"]
    far = of(4 * sd)
    assert [r.status for r in drift.drift(far, base).collect()] == ["FAIL"]
    after = {r.column: r.mean for r in drift.advance(far, base).collect()}
    assert abs(after["x"] - 4 * sd) < 1e-9
    frozen = {r.column: r.mean for r in drift.advance(far, base, freeze=True).collect()}
    assert abs(frozen["x"]) < 1e-9
    assert drift.moments(spark.createDataFrame([(1.0, 2.0)] * 4, "x double, k double"), c).count() == 0


def schema(**k):
    return {n: {"type": "number"} | v for n, v in k.items()}


def diff(spark, a, b, recursive=False):
    return {(r.column, r.change_type): r for r in evolve.diff(contract.clause_rows(spark, a, recursive), contract.clause_rows(spark, b, recursive)).collect()}


def test_every_kind_of_change(spark):
    a = schema(w={"type": "integer"}, n={"type": "string"}, gone={}, lo={"minimum": 1}, hi={"minimum": 5.0, "maximum": 9.0}, mix={"minimum": 0.0, "maximum": 9.0}, e={"enum": ["a", "b"]}, p={"pattern": "x"}, r={"required": False}, bound={}, drop={"maximum": 3.0})
    b = schema(w={"type": "number"}, n={"type": "integer"}, new={"required": True}, free={}, lo={"minimum": 1000}, hi={"minimum": 4.0, "maximum": 9.0}, mix={"minimum": 1.0, "maximum": 99.0}, e={"enum": ["b", "c"]}, p={}, r={"required": True}, bound={"minimum": 0}, drop={})
    got = set(diff(spark, a, b))
    assert got == {("w", "type_widening"), ("n", "type_narrowing"), ("gone", "remove_column"), ("new", "add_required_column"), ("free", "add_nullable_column"), ("lo", "range_tightened"), ("hi", "range_widened"), ("mix", "range_tightened"), ("e", "add_enum_value"), ("e", "remove_enum_value"), ("p", "pattern_changed"), ("r", "add_required_column"), ("bound", "range_tightened"), ("drop", "range_widened")}
    assert diff(spark, a, a) == {}
    assert evolve.verdict(evolve.diff(contract.clause_rows(spark, schema(x={"minimum": 2})), contract.clause_rows(spark, schema(x={"minimum": 1})))).first().verdict == "FULL_COMPATIBLE"


def test_changes_inside_items_only_if_asked(spark):
    a, b = ({"f": {"type": "array", "items": {"confidence": {"type": "number", "maximum": m}}}} for m in (1.0, 100.0))
    assert diff(spark, a, b) == {} and set(diff(spark, a, b, True)) == {("f[].confidence", "range_widened")}


REGISTRY = """subscriptions:
  - contract_id: c
    subscriber_id: week4-cartographer
    subscriber_team: four
    fields_consumed: [doc_id, extracted_facts]
    breaking_fields: [{field: "extracted_facts[].confidence", reason: scale}, doc_id]
    contact: a@b.c
  - contract_id: c
    subscriber_id: reader
    fields_consumed: [extracted_facts]
    breaking_fields: []
  - contract_id: other
    subscriber_id: none
    fields_consumed: [doc_id]
    breaking_fields: [doc_id]
"""


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("r") / "subscriptions.yaml"
    path.write_text(REGISTRY)
    return readers.registry(spark, str(path))


def test_consumer_failures_and_blast_radius(spark, registry, tmp_path):
    changes = evolve.diff(contract.clause_rows(spark, schema(extracted_facts={"maximum": 9}, z={})), contract.clause_rows(spark, schema(extracted_facts={"maximum": 1})))
    got = {r.subscriber_id: r for r in evolve.consumer_failures(changes, registry, "c").collect()}
    assert got["week4-cartographer"].dependency_type == "breaking_field" and got["week4-cartographer"].failure_mode.endswith("Registry: scale")
    assert got["reader"].dependency_type == "consumed_field" and set(got) == {"week4-cartographer", "reader"}
    failed = spark.createDataFrame([("k", "c", "Extracted_Facts[*].confidence")], "check_id string, contract_id string, column_name string")
    assert [(r.subscriber_id, r.breaking_field) for r in attribute.blast_radius(failed, registry).collect()] == [("week4-cartographer", "extracted_facts[].confidence")]
    doc = evolve.migration_report("c", "a", "b", changes, registry)
    assert doc["verdict"] == "BACKWARD_INCOMPATIBLE" and doc["breaking_changes"] == 2
    assert readers.registry(spark, str(tmp_path / "none.yaml")).count() == 0


def test_walks_end_on_cycles_and_keep_fewest_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node_id string")
    assert {r.node_id: r.hops for r in lineage.walk(e, start, 9).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node_id: r.hops for r in lineage.walk(e, spark.createDataFrame([("d",)], "node_id string"), 2, True).collect()} == {"d": 0, "c": 1, "a": 2, "b": 2}


def test_attribution(spark, registry, extractions):
    nodes = spark.createDataFrame([("file::src/week3/extractor.py", "x"), ("table::raw", "raw"), ("pipeline::week4-cartographer", "c")], "node_id string, label string")
    edges = spark.createDataFrame([("table::raw", "file::src/week3/extractor.py", "READS"), ("file::src/week3/extractor.py", "pipeline::week4-cartographer", "PRODUCES")], "source string, target string, relationship string")
    commits = spark.createDataFrame([("src/week3/extractor.py", f"h{i}", "a@b.c", f"2025-01-0{i} 00:00:00 +0000", "m") for i in (1, 2, 3)], readers.COMMIT)
    chain = attribute.blame_chain(attribute.upstream_files("extracted_facts", nodes, edges), commits, F.lit("2025-01-04 00:00:00").cast("timestamp")).collect()
    assert [(r.commit_hash, r.hops, r.confidence_score) for r in chain] == [("h3", 0, 0.9), ("h2", 0, 0.8), ("unknown", 1, 0.8)]
    c = contract.build_contract(extractions(), "c", "extractions")
    results, _ = phases.validate(checks.inject_scale_fault(extractions()), c)
    v = attribute.violations(results, "c", registry, nodes, edges, commits).collect()
    assert len(v) == 1 and v[0].routing.priority == "P1" and v[0].blast_radius.affected == 1 and len(v[0].blame_chain) == 3
    assert attribute.downstream_depth("x-cartographer", nodes) == 0 and attribute.downstream_depth("x-zz", nodes) == 1
    assert [r.id for r in lineage.consumers(nodes, edges, "week3_extractor").collect()] == [] and lineage.consumers(nodes, edges, "ra_w").count() == 1


def test_model_checks(spark, extractions):
    df = extractions()
    verdicts = spark.createDataFrame([("v", "PASS", 3.0, 0.5, {"a": 1}), ("w", "MAYBE", 9.0, None, None)], "verdict_id string, overall_verdict string, overall_score double, confidence double, scores map<string,int>")
    runs = spark.createDataFrame([("llm", "2", "1", 3, 1, 2), ("odd", "1", "2", 4, 1, 2), ("tool", "", "1", None, None, None)], "run_type string, start_time string, end_time string, total_tokens int, prompt_tokens int, completion_tokens int")
    errors = {r.verdict_id: r.validation_errors for r in ai.validate(verdicts, ai.VERDICT_SCHEMA).collect()}
    assert errors["v"] == [] and len(errors["w"]) == 4
    assert ai.quarantine(ai.validate(verdicts, ai.VERDICT_SCHEMA)).count() == 1
    trace = ai.trace_verdict(runs).first()
    assert (trace.status, trace.total, trace.run_type_violations, trace.token_mismatch) == ("FAIL", 3, 2, 1)
    doc = ai.run_all(df, verdicts, runs)
    assert doc["embedding_drift"]["status"] == "BASELINE_SET" and doc["prompt_input_validation"]["status"] == "PASS" and doc["overall_status"] == "FAIL"
    texts = ai.sample_texts(df, "extracted_facts").withColumn("embedding", ai.hash_embedding(F.col("text")))
    assert texts.count() == 120
    base = ai.centroid(texts)
    assert ai.embedding_drift(base, base, 5).first().status == "PASS"
    assert ai.embedding_drift(base, None, 0).first().status == "ERROR"
    assert ai.prompt_verdict(ai.validate(ai.prompt_inputs(df).withColumn("more", F.lit(1)), ai.PROMPT_SCHEMA)).first().status == "FAIL"


@pytest.mark.parametrize("now,want", [(0.04, "rising"), (0.01, "falling"), (0.02, "stable")])
def test_trend(spark, now, want):
    v = spark.createDataFrame([(["e"] if i < now * 100 else [],) for i in range(100)], "validation_errors array<string>")
    assert ai.output_verdict(v, [0.02] * 3).first().trend == want
    assert ai.output_verdict(v, [0.02]).first().trend == "stable"


@pytest.mark.parametrize("passed,total,want", [(1102, 1107, 75), (131, 134, 73), (0, 10, 0), (0, 0, 100)])
def test_health_score(spark, passed, total, want):
    r = spark.createDataFrame([(total, passed)], "total_checks long, passed long")
    v = spark.createDataFrame([("CRITICAL",), ("HIGH",)], "severity string")
    assert report.health_score(r, v).first().score == want


def test_report(spark, tmp_path):
    r = spark.createDataFrame([("c", "2025-01-01", 10, 9, 1, 0), ("c", "2025-01-02", 8, 7, 1, 0)], "contract_id string, run_timestamp string, total_checks long, passed long, failed long, warned long")
    v = spark.createDataFrame([("1", "k", "c", "x", "HIGH", "m", 0), ("2", "k", "c", "x", "CRITICAL", "m", 1), ("3", "j", "c", "y", "LOW", None, 2), (None, None, None, None, None, None, 3)], "violation_id string, check_id string, contract_id string, column_name string, severity string, message string, log_pos int")
    ch = spark.createDataFrame([("c", "remove_column", "x", "old", 1), ("c", "add_enum_value", "y", "", 2), ("c", "remove_column", "x", "new", 3)], "contract_id string, change_type string, column string, old_value string, report_order int")
    doc = report.build(r, v, ch, {"embedding_drift": {"status": "FAIL"}})
    assert doc["validation_summary"]["total_checks"] == 18 and doc["violations"]["by_severity"] == {"HIGH": 1, "CRITICAL": 1, "LOW": 1}
    assert [x["violation_id"] for x in doc["violations"]["top"]] == ["2", "1", "3"]
    assert [(c["column"], c["old_value"]) for c in doc["schema_changes_detected"]] == [("x", "new"), ("y", "")]
    assert [a["severity"] for a in doc["recommended_actions"]] == ["CRITICAL", "LOW", "HIGH"] and doc["ai_risk_assessment"]["overall_ai_status"] == "AMBER"
    assert report.pass_rates(r).first().pass_rate == 88
    a, b = sinks.report(doc, str(tmp_path))
    assert json.loads(open(a).read())["data_health_score"] == doc["data_health_score"] and "# Data health" in open(b).read()


def test_profile(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True, [1]), (2, None, "b", None, [2]), (3, 2.5, "b", False, None)], "i int, x double, s string, b boolean, l array<int>")
    p = {r.column: r for r in profile.profile(df).collect()}
    assert (p["i"].dtype, p["i"].p50, p["i"].max) == ("integer", 2.0, 3.0) and p["x"].null_fraction == pytest.approx(1 / 3)
    assert p["s"].cardinality == 2 and p["b"].dtype == "boolean" and p["l"].dtype == "array"
    assert profile.observed_enum(df, "s") == ["b", "a"] and profile.observed_enum(df.select(F.lit("PASS").alias("overall_verdict")), "overall_verdict") == ["PASS", "FAIL", "WARN"]
    conf = profile.profile(spark.createDataFrame([(50.0,), (50.0,)], "confidence double"))
    assert "0 to 100" in conf.first().warning and "constant" in profile.suspicious(conf).first().flag
    assert contract.clause(p["b"].asDict()) == {"type": "boolean"}


def test_sources_and_sinks(spark, tmp_path):
    c = {"id": "c", "info": {"title": "t", "description": "d"}, "schema": {"a": {"type": "string", "required": True, "unique": True, "enum": ["x"]}}, "lineage": {"downstream": []}}
    first = sinks.snapshot(c, str(tmp_path), datetime(2025, 1, 1, 10, 0, 0))
    sinks.snapshot(c, str(tmp_path), datetime(2025, 1, 2, 10, 0, 0))
    (tmp_path / "c" / "odd.yaml").write_text("schema: {}\n")
    assert [p.name for p in readers.snapshots(str(tmp_path), "c", 7)] == ["odd.yaml"] and len(readers.snapshots(str(tmp_path), "c")) == 3
    assert readers.contract(first) == c and readers.snapshot_schema(first) == c["schema"]
    assert contract.dbt_schema(c, "t")["models"][0]["columns"] == [{"name": "a", "tests": ["not_null", "unique", {"accepted_values": {"values": ["x"]}}]}]
    base = spark.createDataFrame([("c", "a", 1.0, 2.0, 3)], drift.BASELINES)
    sinks.baselines(base, str(tmp_path / "b.json"))
    assert [r.asDict() for r in readers.baselines(spark, str(tmp_path / "b.json")).collect()] == [r.asDict() for r in base.collect()]
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "check_id string, n int")
    assert sinks.append_once(rows, log) == 2 and sinks.append_once(rows, log) == 0
    sinks.append_log(rows, log)
    assert readers.logged(spark, log, "check_id string, n int").count() == 5
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert readers.digests(spark, str(tmp_path / "x.bin")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert readers.jsonl(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0
    assert readers.commits(spark, str(tmp_path), ["nofile"]).count() == 0
    (tmp_path / "h.jsonl").write_text('{"run_date":"2","contract_id":"c","violation_rate":0.2}\n{"run_date":"1","contract_id":"c","violation_rate":0.1}\n{"run_date":"1","contract_id":"d","violation_rate":0.9}\n')
    assert readers.rate_history(spark, str(tmp_path / "h.jsonl"), "c") == [0.1, 0.2]
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n{oops\n')
    assert [r.line for r in readers.malformed(spark, str(tmp_path / "bad.jsonl"), "a int").collect()] == ["{oops"]


def test_stream(spark, tmp_path):
    from clausewright.streaming.validate import validate_stream, windowed_violations

    c = {"id": "s", "schema": {"v": {"type": "integer", "required": True, "maximum": 5}}}
    (tmp_path / "in").mkdir()
    spark.sql("select timestamp'2025-01-01 00:00:00' ts, explode(array(1, 9, 7, null)) v").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v int").parquet(str(tmp_path / "in"))
    validate_stream(stream, c, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination(60)
    got = {r.check_id: r.records_failing for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["s.v.range"] == 2 and got["s.v.required"] == 1
    q = windowed_violations(stream, c, "ts").writeStream.format("memory").queryName("wv").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.check: r.n for r in spark.table("wv").collect()} == {"v.range": 2, "v.required": 1}


def test_strict_nested(extractions):
    c = contract.build_contract(extractions(), "w", "extractions")
    bad = statuses(nested.nested_checks(checks.inject_scale_fault(extractions()), c))
    assert bad["w.extracted_facts[].confidence.range"] == "FAIL" and bad["w.entities[].type.enum"] == "PASS"
