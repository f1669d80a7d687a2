"""Quantiles by counting, profiles that merge, joins in time, renames, report cubes, git as a source."""

import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import contract, evolve, profile, quantiles, report, sketches, temporal
from clausewright.sources import readers

POINTS = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("few", [4, 50, 10_000])
@pytest.mark.parametrize("kind", ["ties", "spread", "two", "one", "small", "tail"])
def test_exact_quantiles(spark, monkeypatch, few, kind):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    r = random.Random(f"{few}{kind}")
    values = {
        "ties": [float(r.randrange(9)) for _ in range(3000)], "spread": [r.gauss(0, 1e6) for _ in range(3000)], "two": [1.0] * 1500 + [2.0] * 1500, "one": [7.0] * 100, "small": [3.0, 1.0, 2.0],
        "tail": [2.0**k * s for k in range(-300, 300) for s in (-1, 1)] + [5.0] * 500,
    }[kind]
    df = spark.createDataFrame([(v, "x") for v in values] + [(None, "x"), (float("nan"), "x")], "v double, s string").repartition(3)
    got = quantiles.exact_quantiles(df, ["v"], POINTS)["v"]
    want = df.where("not isnan(v)").agg(F.percentile("v", F.array(*map(F.lit, POINTS)))).first()[0]
    assert got == want


def test_exact_quantiles_of_nothing_and_of_strings(spark):
    df = spark.createDataFrame([(None, "5", 1), (None, "x", 2), (None, "7", 2)], "v double, s string, i int")
    got = quantiles.exact_quantiles(df, ["v", "s", "i"], [0.5])
    assert got == {"v": [None], "s": [6.0], "i": [2.0]} and quantiles.exact_quantiles(df, [], [0.5]) == {}
    assert quantiles.exact_quantiles(df.limit(0), ["i"], [0.5]) == {"i": [None]}


def test_profile_has_no_buffer_of_values(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) / 3 as x")
    p = profile.profile(df)
    assert "percentile(" not in p._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.column: (r.p25, r.p50) for r in p.collect()}["id"] == (24.75, 49.5)


def lines(spark, n=4000):
    r = random.Random(1)
    rows = [(i % 4, r.gauss(10, 3) if i % 50 else None, r.choice("aabbbcdddd") if i % 9 else None, i, i % 3 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "part int, x double, s string, id int, b boolean")


def test_merged_profiles_are_near_those_of_the_whole(spark, tmp_path):
    df = lines(spark)
    sketches.profile_new(df.where("part < 2"), "part", str(tmp_path / "p"))
    got = {r.column: r for r in sketches.profile_new(df, "part", str(tmp_path / "p")).collect()}
    want = {r.column: r for r in profile.profile(df.drop("part")).collect()}
    assert set(got) == set(want) == {"x", "s", "id", "b"}
    xs = np.sort([r.x for r in df.where("x is not null").collect()])
    for c in ("x", "id"):
        assert got[c].total == 4000 and got[c].non_null == want[c].non_null and (got[c].min, got[c].max) == (want[c].min, want[c].max)
        assert got[c].mean == pytest.approx(want[c].mean) and got[c].stddev == pytest.approx(want[c].stddev)
    for p, q in profile.POINTS.items():
        assert abs(np.searchsorted(xs, got["x"][p]) / len(xs) - q) <= 0.006
    assert abs(got["id"].cardinality - 4000) <= 0.07 * 4000 and got["s"].cardinality == 4
    assert [t.value for t in got["s"].top][:2] == ["d", "b"] and got["s"].top[0]["count"] == df.where("s = 'd'").count() and {t.value for t in got["b"].top} == {"true", "false"}


def test_only_new_parts_are_read(spark, tmp_path):
    df, folder = lines(spark, 400), str(tmp_path / "p")
    sketches.profile_new(df.where("part < 3"), "part", folder)
    # Parts that are kept aren't read: other values for them change nothing.
    other = df.withColumn("x", F.when(F.col("part") < 3, F.lit(1e9)).otherwise(F.col("x")))
    p = {r.column: r for r in sketches.profile_new(other, "part", folder).collect()}
    assert p["x"].max < 1e6 and p["x"].total == 400
    # A part that is run again replaces itself, twice if need be.
    for _ in range(2):
        p = {r.column: r for r in sketches.profile_new(other.where("part = 0"), "part", folder, again=["0"]).collect()}
        assert p["x"].total == 400 and p["x"].max == 1e9
    nulls = df.withColumn("part", F.lit(None).cast("int")).limit(10)
    assert {r.total for r in sketches.profile_new(nulls, "part", folder).collect()} == {410} == {r.total for r in sketches.profile_new(nulls, "part", folder).collect()}


def test_profile_of_an_empty_table(spark, tmp_path):
    rows = sketches.finished(sketches.merged(sketches.partial_profiles(lines(spark, 8).limit(0)))).collect()
    assert all(r.total == 0 and r.cardinality in (0, None) for r in rows)
    only = sketches.finished(sketches.merged(sketches.partial_profiles(spark.range(5)))).first()
    assert (only.column, only.min, only.max, only.p50, only.top) == ("id", 0.0, 4.0, 2.0, None)


@pytest.mark.parametrize("bins", [1, 7, 100])
def test_as_of_join(spark, bins):
    r = random.Random(bins)
    left = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, *range(0, 5000, 7)])) for i in range(300)]
    right = [(r.choice(["hot", "hot", "b", "c", None]), r.choice([None, *range(0, 5000, 9)]), i % 7, None) for i in range(120)]
    a = spark.createDataFrame(left, "id int, k string, t int").withColumn("t", F.col("t").cast("timestamp"))
    b = spark.createDataFrame(right, "k string, t int, v int, n string").withColumn("t", F.col("t").cast("timestamp"))
    got = {x.id: x.f and (int(x.f.t.timestamp()), x.f.v) for x in temporal.as_of(a, b, ["k"], "t", "t", "f", bins).collect()}
    want = {i: max(((u, v) for g, u, v, _ in right if g == k and k is not None and u is not None and t is not None and u <= t), default=None) for i, k, t in left}
    assert got == want and len(got) == 300


def test_as_of_join_of_empty_sides(spark):
    a = spark.createDataFrame([(1, "k", 5)], "id int, k string, t timestamp_ntz".replace("timestamp_ntz", "int")).withColumn("t", F.col("t").cast("timestamp"))
    b = a.select("k", "t", F.lit(1).alias("v"))
    assert temporal.as_of(a, b.limit(0), ["k"], "t", "t").first().as_of is None and temporal.as_of(a.limit(0), b, ["k"], "t", "t").count() == 0
    assert temporal.as_of(a, b, ["k"], "t", "t").first().as_of.v == 1


@pytest.mark.parametrize("seconds", [1, 60, 100_000])
def test_interval_join(spark, seconds):
    r = random.Random(seconds)
    left = [(i, r.choice("ab"), r.choice([None, *range(-300, 300)])) for i in range(80)]
    right = [(i, r.choice("ab"), r.choice([None, *range(-300, 300)])) for i in range(80)]
    of = lambda rows: spark.createDataFrame(rows, "id int, k string, t int").withColumn("t", F.col("t").cast("timestamp"))
    met = temporal.within(of(left), of(right), ["k"], "t", "t", seconds)
    got = sorted((x.id, x.found.id) for x in met.collect())
    assert got == sorted((i, j) for i, k, t in left for j, g, u in right if k == g and None not in (t, u) and 0 <= t - u <= seconds)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((" in plan and "Cartesian" not in plan


def test_renames(spark):
    r = random.Random(2)
    rows = [(i, f"name{i}", r.choice("AAAAB"), r.choice("AB"), i * 2.5, None if i % 3 else "x") for i in range(2000)]
    old = spark.createDataFrame(rows, "id int, who string, flag string, coin string, price double, note string")
    new = old.where("id >= 300").select("id", F.col("who").alias("full_name"), F.col("flag").alias("grade"), F.expr("case when id % 10 = 0 then 'A' else 'B' end").alias("side"), (F.col("price") + 0.25).alias("cost"), F.coalesce("note", F.lit("x")).alias("remark"))
    kinds = dict.fromkeys(("who", "flag", "coin", "note"), "string") | {"price": "number"}
    added = dict.fromkeys(("full_name", "grade", "side", "remark"), "string") | {"cost": "number"}
    assert sorted(evolve.renames(old, new, kinds, added)) == [("flag", "grade"), ("who", "full_name")]
    assert evolve.renames(old, new, {}, added) == [] and evolve.renames(old.limit(0), new.limit(0), kinds, added) == []
    of = lambda t: contract.clauses_of(profile.profile(t, light=True))
    changes = {(c.change_type, c.column, c.new_value) for c in evolve.diff_tables(old, new, of(old), of(new)).collect()}
    assert ("rename_column", "who", "full_name") in changes and ("rename_column", "flag", "grade") in changes
    assert not any(c in ("who", "full_name", "grade") and k != "rename_column" for k, c, _ in changes)
    assert ("remove_column", "price", None) in changes and any(k.startswith("add_") and c == "cost" for k, c, _ in changes)
    assert {c.column: c.backward_compatible for c in evolve.diff_tables(old, new, of(old), of(new)).where("change_type = 'rename_column'").collect()} == {"who": False, "flag": False}


def test_a_renamed_column_is_compared_under_its_new_name(spark):
    clause = lambda c, hi: {c: {"type": "number", "required": True, "minimum": 0.0, "maximum": hi}}
    of = lambda s: contract.clause_rows(spark, s)
    got = [(c.change_type, c.column) for c in evolve.diff(of(clause("a", 9.0)), of(clause("b", 5.0)), [("a", "b")]).collect()]
    assert got == [("rename_column", "a"), ("range_tightened", "b")]


def test_report_cube(spark):
    rows = [("c", "range", "HIGH", "FAIL")] * 2 + [("c", "enum", "LOW", "PASS")] * 8 + [("d", "enum", "CRITICAL", "FAIL")]
    got = {(r.contract_id, r.kind, r.level): (r.checks, r.failed, r.score) for r in report.cube(spark.createDataFrame(rows, "contract_id string, kind string, severity string, status string"), ["contract_id", "kind"]).collect()}
    assert got[None, None, 3] == (11, 3, 43) and got["c", None, 1] == (10, 2, 70) and got["d", "enum", 0] == (1, 1, 0) and got[None, "enum", 2] == (9, 1, 69) and len(got) == 8


def git(folder, *args, **env):
    subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(folder), "GIT_CONFIG_NOSYSTEM": "1"} | env)


@pytest.fixture
def repository(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q")
    git(repo, "config", "user.name", "Ann")
    git(repo, "config", "user.email", "ann@x.y")
    old = "2001-01-01T00:00:00"
    (repo / "d.py").write_text("old\n")
    git(repo, "add", ".")
    git(repo, "commit", "-q", "-m", "old", GIT_AUTHOR_DATE=old, GIT_COMMITTER_DATE=old)
    (repo / "a.py").write_text("".join(f"line {i}\n" for i in range(10)))
    (repo / "b b.py").write_text("one\n")
    git(repo, "add", ".")
    git(repo, "commit", "-q", "-m", "first: ünï")
    (repo / "a.py").write_text("".join(f"line {i}\n" if i != 4 else "changed\n" for i in range(10)))
    git(repo, "commit", "-q", "-a", "-m", "second")
    git(repo, "mv", "b b.py", "c.py")
    git(repo, "commit", "-q", "-m", "moved")
    return str(repo)


def test_git_history_is_read_by_tasks(spark, repository):
    df = readers.commits(spark, repository, ["a.py", "c.py", "none.py", "d.py"])
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert [r.commit_message for r in rows if r.file_path == "a.py"] == ["second", "first: ünï"]
    assert [r.commit_message for r in rows if r.file_path == "c.py"] == ["moved", "first: ünï"] and {r.author_email for r in rows} == {"ann@x.y"}
    assert not [r for r in rows if r.file_path in ("none.py", "d.py")] and readers.commits(spark, repository, []).count() == 0
    assert all(len(r.commit_hash) == 40 for r in rows) and readers.commits(spark, "/nowhere", ["a.py"]).count() == 0


@pytest.mark.parametrize("lines", [3, 2000])
def test_blamed_lines_by_ranges(spark, repository, lines):
    rows = readers.blamed_lines(spark, repository, "a.py", lines=lines).orderBy("line_number").collect()
    assert [r.line for r in rows] == [f"line {i}" if i != 4 else "changed" for i in range(10)] and [r.line_number for r in rows] == list(range(1, 11))
    assert len({r.commit_hash for r in rows}) == 2 and rows[4].commit_hash not in {r.commit_hash for r in rows[:4]}
    part = readers.blamed_lines(spark, repository, "a.py", 4, 6, lines).collect()
    assert sorted(r.line for r in part) == ["changed", "line 3", "line 5"] and readers.blamed_lines(spark, repository, "none.py").count() == 0
