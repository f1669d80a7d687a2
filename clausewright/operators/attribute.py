"""Attribution: who a failed check hurts and who may have caused it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.expressions import half_even, root
from clausewright.functions.storage import cut
from clausewright.operators.lineage import downstream, walk

# The file that makes a column.
COLUMN_FILES: dict[str, str] = {
    "confidence": "src/week3/extractor.py",
    "extracted_facts": "src/week3/extractor.py",
    "entities": "src/week3/entity_linker.py",
    "extraction_model": "src/week3/extractor.py",
    "processing_time_ms": "src/week3/extractor.py",
    "overall_verdict": "src/week2/courtroom.py",
    "scores": "src/week2/scorer.py",
    "sequence_number": "src/week5/aggregate.py",
    "event_type": "src/week5/event_store.py",
    "payload": "src/week5/event_store.py",
    "nodes": "src/week4/cartographer.py",
    "edges": "src/week4/graph_builder.py",
    "total_tokens": "src/week7/contracts/ai_extensions.py",
    "run_type": "src/week7/contracts/ai_extensions.py",
}
# The pipeline that a file belongs to, and the one that a subscriber stands for, by a part of its id, the first that fits.
FILE_PIPELINES: dict[str, str] = {
    "src/week3/extractor.py": "week3-document-extraction-pipeline",
    "src/week3/entity_linker.py": "week3-entity-linking-pipeline",
    "src/week4/cartographer.py": "week4-lineage-generation",
    "src/week4/graph_builder.py": "week4-lineage-generation",
    "src/week5/event_store.py": "week5-event-ingestion-pipeline",
    "src/week5/aggregate.py": "week5-aggregate-reconstruction",
    "src/week2/courtroom.py": "week2-evaluation-pipeline",
    "src/week2/scorer.py": "week2-evaluation-pipeline",
}
SUBSCRIBER_PIPELINES: dict[str, str] = {
    "cartographer": "week4-lineage-generation",
    "violation-attributor": "week7-violation-attributor",
    "schema-contract": "week7-schema-contract",
    "ai-contract": "week7-ai-contract-extension",
    "courtroom": "week2-evaluation-pipeline",
}
PRIORITY = {"CRITICAL": "P1", "HIGH": "P2", "MEDIUM": "P3", "LOW": "P4"}
#: Minutes until a violation goes to the next level: for CRITICAL and HIGH, and for the rest.
ESCALATE = (30, 120)
#: What to do about each kind of violation, and how, from what the check has found.
MITIGATION: dict[str, tuple[str, tuple[str, ...]]] = {
    "range": ("Values lie outside the agreed bounds.", ("Compare the minimum and maximum of the message with the bounds: a factor of 100 is a change of scale.", "Quarantine what was written since the blamed commit.", "Agree on new bounds, or have the producer keep to the old ones.")),
    "required": ("A field that consumers rely on is empty.", ("Group the empty records by their source and day to see when it began.", "Backfill them from that source, or declare the field nullable.")),
    "unique": ("One key stands for several records.", ("Look at the repeated keys with failing_rows().", "Tell exact repeats, which can be dropped, from different records under one key, which need new ones.")),
    "type": ("A field has changed its type.", ("Read the field as the old type and count what is lost.", "Keep the old field next to the new one until all consumers have moved.")),
    "format": ("Values have another shape than agreed.", ("Compare failing samples with the named format.", "Normalise them where they are written.")),
    "default": ("Data and contract disagree.", ("Look at the samples of the failing check.", "Change whichever is wrong, data or contract, and validate again.")),
}
#: Days of history, commits, and the confidence where a commit's time can't be read, of the blame for a model check.
AI_DAYS, AI_COMMITS, AI_UNREADABLE = 30, 2, 0.5
HOPS, COMMITS_EACH, CHAIN = 3, 2, 5
#: Who is told where no subscriber is known.
CONTACT = "data-quality@org.com"


def field_match(failing: Column, registered: Column) -> Column:
    """Either root in the other, whatever the case."""
    a, b = F.lower(root(failing)), F.lower(root(registered))
    return a.contains(b) | b.contains(a)


def blast_radius(failures: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """check_id and the subscribers of its contract, each once, through the first of their breaking fields that matches.

    failures: check_id, contract_id, column_name."""
    fields = subscriptions.select("contract_id", "subscriber_id", "subscriber_team", "validation_mode", "contact", "fields_consumed", F.posexplode("breaking_fields").alias("pos", "b"))
    met = failures.select("check_id", "contract_id", "column_name").join(fields, "contract_id").where(field_match(F.col("column_name"), F.col("b.field")))
    first = F.row_number().over(Window.partitionBy("check_id", "subscriber_id").orderBy("pos"))
    return met.withColumn("r", first).where("r = 1").select(
        "check_id", "subscriber_id", "subscriber_team", F.coalesce("validation_mode", F.lit("AUDIT")).alias("validation_mode"), "contact", "fields_consumed",
        F.col("b.field").alias("breaking_field"), F.col("b.reason").alias("breaking_reason"),
    )


def blame_confidence(days: Column, hops: Column) -> Column:
    """1, less a tenth a day and a fifth a hop, from 0.05 to 1."""
    return half_even(F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.0 - 0.1 * days - 0.2 * hops)), 2)


def commit_time(stamp: Column) -> Column:
    """The time of a commit, null if it can't be read."""
    return F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(stamp))


def days_since(stamp: Column, now: Column) -> Column:
    """Whole days since a commit's time; 0 if the time can't be read."""
    return F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(commit_time(stamp))) / 86400), F.lit(0))


def ai_blame(commits: DataFrame, now: Column | None = None) -> DataFrame:
    """rank, file_path, commit_hash, author, commit_timestamp, commit_message, hops, confidence_score: of each file the AI_COMMITS newest commits of the last AI_DAYS days, for a failed model check. A commit whose time can't be read counts as recent, with a confidence of AI_UNREADABLE."""
    now = F.current_timestamp() if now is None else now
    at = commit_time(F.col("commit_timestamp"))
    newest = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("commit_timestamp"), "commit_hash"))
    recent = commits.where(at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) <= AI_DAYS * 86400)).withColumn("rank", newest).where(F.col("rank") <= AI_COMMITS)
    score = F.when(at.isNull(), F.lit(AI_UNREADABLE)).otherwise(blame_confidence(days_since(F.col("commit_timestamp"), now), F.lit(0)))
    return recent.select("rank", "file_path", "commit_hash", F.col("author_email").alias("author"), "commit_timestamp", "commit_message", F.lit(0).alias("hops"), score.alias("confidence_score"))


def _first_part(c: Column, parts: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for part, value in reversed(parts.items()):
        out = F.when(c.contains(part), value).otherwise(out)
    return out


def subscriber_pipeline(subscriber: Column, parts: dict[str, str] | None = None) -> Column:
    """The pipeline that a subscriber stands for, its own id where none is known."""
    return _first_part(subscriber, SUBSCRIBER_PIPELINES if parts is None else parts, subscriber)


def file_pipeline(path: Column, files: dict[str, str] | None = None) -> Column:
    """The pipeline that a file belongs to, or null."""
    known = FILE_PIPELINES if files is None else files
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), path) if known else F.lit(None).cast("string")


def upstream_files(column: str, nodes: DataFrame, edges: DataFrame, hops: int = HOPS, files: dict[str, str] | None = None) -> DataFrame:
    """node_id, hops from the file that makes the column (by `files`, column -> file), or else the first node with the column's name in its id."""
    spark = nodes.sparkSession
    known = (COLUMN_FILES if files is None else files).get(column.split(".")[0].split("[")[0])
    if known:
        start = spark.createDataFrame([(f"file::{known}",)], "node_id string")
    else:
        start = nodes.where(F.lower("node_id").contains(column.lower())).select("node_id").orderBy("node_id").limit(1)
    return walk(edges, start, hops, upstream=True)


def blame_chain(upstream: DataFrame, commits: DataFrame, now: Column | None = None) -> DataFrame:
    """rank, file_path, commit_hash, author, commit_timestamp, commit_message, hops, confidence_score: the newest commits of each file, in order of hops.

    A file without commits has one row that says so."""
    now = F.current_timestamp() if now is None else now
    files = upstream.select(F.regexp_replace("node_id", "^file::", "").alias("file_path"), "hops")
    newest = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("commit_timestamp"), "commit_hash"))
    each = commits.withColumn("c", newest).where(F.col("c") <= COMMITS_EACH)
    met = files.join(each, "file_path", "left").withColumn("rank", F.row_number().over(Window.orderBy("hops", "file_path", "c")))
    chain = met.where(F.col("rank") <= CHAIN)
    return chain.select(*_blamed(now))


def _hits(subscriber: str, nodes: DataFrame) -> DataFrame:
    """node_id of the nodes with the last part of the subscriber's id in their id or label."""
    token = subscriber.rsplit("-", 1)[-1].lower()
    found = F.lower("node_id").contains(token)
    return nodes.where(found | F.coalesce(F.lower("label").contains(token), F.lit(False)) if "label" in nodes.columns else found).select("node_id")


def downstream_depth(subscriber: str, nodes: DataFrame, edges: DataFrame | None = None, producer: DataFrame | None = None, hops: int = 16) -> int:
    """How far a subscriber is from the data. With a producer (node_id), the fewest hops from it to a node of the subscriber's, by a walk of the graph, 1 if there is none. Without one every node is a start, so the depth is 0 where there is such a node, else 1."""
    hit = _hits(subscriber, nodes)
    if producer is None or edges is None:
        return 0 if hit.limit(1).count() else 1
    least = walk(edges, producer, hops).join(hit, "node_id", "left_semi").agg(F.min("hops")).first()[0]
    return 1 if least is None else int(least)


def contamination_depth(edges: DataFrame, producer: DataFrame, hops: int = 16) -> DataFrame:
    """node_id, hops: the true least distance of each consumer from the producing node."""
    return downstream(edges, producer, hops)


def routing(severity: Column) -> Column:
    cases = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    urgent = severity.isin("CRITICAL", "HIGH")
    return F.struct(F.coalesce(F.try_element_at(cases, severity), F.lit("P3")).alias("priority"), F.when(urgent, ESCALATE[0]).otherwise(ESCALATE[1]).alias("escalate_after_minutes"))


def mitigation(kind: Column) -> Column:
    """guidance and steps for a kind of violation, as a struct."""
    said = {k: F.struct(F.lit(text).alias("guidance"), F.array(*map(F.lit, steps)).alias("steps")) for k, (text, steps) in MITIGATION.items()}
    out = said["default"]
    for k, v in said.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def starts(columns: list[str], nodes: DataFrame, files: dict[str, str] | None = None) -> DataFrame:
    """column_name, node_id: where the walk of each failing column starts: the node of the file that makes it (by `files`, column -> file), or else the first node with its name in its id."""
    spark, known = nodes.sparkSession, COLUMN_FILES if files is None else files
    made = {c: known.get(c.split(".")[-1]) or known.get(c.split(".")[0].split("[")[0]) for c in columns}
    of_file = spark.createDataFrame([(c, f"file::{f}") for c, f in made.items() if f], "column_name string, node_id string")
    rest = [c for c, f in made.items() if not f]
    if not rest:
        return of_file
    named = F.filter(F.array(*map(F.lit, rest)), lambda c: F.contains(F.lower("node_id"), F.lower(c)))
    return of_file.unionByName(nodes.select("node_id", F.explode(named).alias("column_name")).groupBy("column_name").agg(F.min("node_id").alias("node_id")).select("column_name", "node_id"))


def blame_chains(upstream: DataFrame, commits: DataFrame, now: Column | None = None) -> DataFrame:
    """column_name, blame_chain (an array of what blame_chain() gives) of each column_name of upstream (column_name, node_id, hops).

    Of each file only the newest commits are met, and no chain is longer than CHAIN, so nothing grows with the history."""
    now = F.current_timestamp() if now is None else now
    files = upstream.select("column_name", F.regexp_replace("node_id", "^file::", "").alias("file_path"), "hops")
    newest = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("commit_timestamp"), "commit_hash"))
    each = commits.withColumn("c", newest).where(F.col("c") <= COMMITS_EACH)
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("hops", "file_path", "c"))
    chain = files.join(each, "file_path", "left").withColumn("rank", rank).where(F.col("rank") <= CHAIN)
    return chain.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct(*_blamed(now)))).alias("blame_chain"))


def _blamed(now: Column) -> list[Column]:
    found = F.col("commit_hash").isNotNull()
    return [
        F.col("rank"), F.col("file_path"), F.when(found, F.col("commit_hash")).otherwise("unknown").alias("commit_hash"), F.when(found, F.col("author_email")).otherwise("unknown").alias("author"),
        F.col("commit_timestamp"), F.when(found, F.col("commit_message")).otherwise("No recent commit.").alias("commit_message"), F.col("hops"),
        blame_confidence(F.when(found, days_since(F.col("commit_timestamp"), now)).otherwise(0), F.col("hops")).alias("confidence_score"),
    ]


def violations(results: DataFrame, contract_id: str, subscriptions: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame, snapshot: str | None = None, hops: int = 16) -> DataFrame:
    """One row for each failed result: the check, whom it hurts, who may have caused it, where it goes.

    Failed results are metadata and written once. All failing columns are walked together, once upstream for the blame and once
    downstream for what is affected; where the graph has nothing downstream the subscribers are named."""
    failed = cut(results.where("status = 'FAIL'").withColumn("contract_id", F.lit(contract_id)))
    columns = [r[0] for r in failed.select("column_name").distinct().collect()]
    start = starts(columns, nodes)
    chains = blame_chains(walk(edges, start, HOPS, upstream=True), commits)
    below = downstream(edges, start, hops).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("hops", "node_id"))).alias("n")).select("column_name", F.transform("n", lambda x: x["node_id"]).alias("below"))
    hit = blast_radius(failed, subscriptions).groupBy("check_id").agg(F.sort_array(F.collect_list(F.struct("subscriber_id", "subscriber_team", "contact", "breaking_field"))).alias("subscribers"))
    out = failed.join(hit, "check_id", "left").join(chains, "column_name", "left").join(below, "column_name", "left")
    none = F.array().cast("array<string>")
    subscribers = F.coalesce(F.transform("subscribers", lambda x: x["subscriber_id"]), none)
    first = F.get("subscribers", F.lit(0))
    return out.select(
        F.uuid().alias("violation_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detected_at"), "contract_id", "check_id", "column_name", "check_type",
        "severity", "status", "message", "actual_value", "expected", "records_failing", "sample_failing", F.lit(snapshot).cast("string").alias("snapshot_ref"), "blame_chain",
        F.struct(
            F.size(subscribers).alias("affected"), F.col("subscribers"), F.coalesce("below", F.transform(subscribers, lambda s: F.concat(F.lit("subscriber::"), s))).alias("affected_nodes"),
            F.array_distinct(F.transform(subscribers, lambda s: subscriber_pipeline(s))).alias("affected_pipelines"), F.col("records_failing").alias("estimated_records"),
            F.when(F.size(subscribers) > 0, "registry+lineage").otherwise("lineage-only").alias("blast_radius_source"),
        ).alias("blast_radius"),
        routing(F.col("severity")).alias("routing"), mitigation(F.col("check_type")).alias("mitigation"), F.coalesce(first["contact"], F.lit(CONTACT)).alias("escalation_contact"),
    )
