"""Sinks: logs and results through Spark's writers, small documents as files."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.storage import cut
from clausewright.operators.report import markdown
from clausewright.sources import log
from clausewright.sources.readers import jsonl


def _put(path: str | Path, text: str) -> str:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def yaml_document(value: dict, path: str) -> str:
    """A contract or a dbt schema."""
    return _put(path, yaml.safe_dump(value, sort_keys=False, allow_unicode=True))


def snapshot(contract: dict, folder: str, now: datetime | None = None) -> str:
    """The contract under folder/id/time.yaml."""
    return yaml_document(contract, str(Path(folder, contract["id"], f"{now or datetime.now(UTC):%Y%m%d_%H%M%S}.yaml")))


def json_document(value: dict, path: str) -> str:
    return _put(path, json.dumps(value, indent=2, default=str, ensure_ascii=False))


def baselines(rows: DataFrame, path: str) -> str:
    """BASELINES rows as {"contract.column": {mean, stddev, n}}, over what there was."""
    kept = {f"{r['contract_id']}.{r['column']}": {"mean": r["mean"], "stddev": r["stddev"], "n": r["n"]} for r in rows.collect()}
    return json_document(kept, path)


def merged_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new where it has the key, else those of old."""
    return old.join(new, ["contract_id", "column"], "left_anti").unionByName(new.select(*old.columns))


def append_log(rows: DataFrame, path: str, order: list[Column | str] | None = None) -> int:
    """Appends to a log, as one commit: all rows or none."""
    return log.append(rows, path, order)


def append_once(rows: DataFrame, path: str, key: str = "check_id", order: list[Column | str] | None = None) -> int:
    """Appends the rows whose key the log doesn't have, and returns their number.

    A null key is a key like any other. Of rows with one key the first in that order goes, or else the one whose JSON is the least. If
    another writer commits meanwhile, the rows are compared with the log anew."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    by = F.struct(*order) if order else F.to_json(F.struct(*rows.columns))
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), by).alias("_r")).select("_r.*")
    while True:
        last = max(log.commits(spark, path), default=0)
        known = log.read(spark, path, f"{key} {kind}", jsonl, upto=last).select(F.col(key).alias("_k")).distinct()
        # Written with the lineage cut, so that what is counted is what is appended.
        fresh = cut(first.join(known, F.col(key).eqNullSafe(F.col("_k")), "left_anti"))
        n = fresh.count()
        try:
            if n:
                log.append(fresh, path, order, after=last)
            return n
        except log.Conflict:
            continue


def centroid(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def report(document: dict, folder: str) -> tuple[str, str]:
    """The health report as JSON and as Markdown."""
    day = document["generated_at"][:10]
    return json_document(document, f"{folder}/report_data.json"), _put(f"{folder}/report_{day}.md", markdown(document))
