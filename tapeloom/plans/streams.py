"""Queries that run as streams over the files of a table."""

from __future__ import annotations

from tapeloom.plans.registry import query
from tapeloom.plans.scans import LINES_SQL
from tapeloom.streaming import manifests

_REASON = "CASE WHEN NOT said THEN 'blank' WHEN good THEN NULL WHEN json_valid(raw) THEN 'not_an_object' ELSE 'malformed_json' END"


def _files(folder: str) -> str:
    return f"{folder}/shard_lines.parquet*"


@query(f"SELECT line_id, CASE WHEN good THEN raw ->> '$.utt_id' END AS utt_id, {_REASON} AS reason FROM ({LINES_SQL})")
def stream_ingest(spark, folder):
    return manifests.ingested(spark, _files(folder))


@query(f"SELECT CAST(line_id // 256 AS BIGINT) AS interval_no, count(*) AS lines, count({_REASON}) AS rejected FROM ({LINES_SQL}) GROUP BY 1")
def stream_intervals(spark, folder):
    return manifests.interval_counts(spark, _files(folder), 256)


@query("SELECT strftime(date_trunc('hour', ingested_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS lines FROM shard_lines GROUP BY 1")
def stream_arrivals(spark, folder):
    return manifests.hourly_arrivals(spark, _files(folder))
