"""Queries on raw lines, positions and side indexes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import fields
from tapeloom.plans.mixing import keyed_rows
from tapeloom.plans.planning import USED
from tapeloom.plans.records import KEY_SQL
from tapeloom.plans.registry import query
from tapeloom.sources import files, jsonl
from tapeloom.sources.tables import table

GOOD_SQL = "CASE WHEN regexp_matches(raw, '^\\s*\\{') AND json_valid(raw) THEN true ELSE false END"
LINES_SQL = f"SELECT line_id, source_path, line_no, raw, {GOOD_SQL} AS good, coalesce(regexp_matches(raw, '\\S'), false) AS said FROM shard_lines"
ORDINALS_SQL = f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY line_no) - 1 AS ordinal FROM ({LINES_SQL}) WHERE said)"
RECORD = "utt_id string, text string, lang string, dataset_key string, duration_sec string, duration string, audio_duration_sec string, wav_duration string, token_len string, token_ids array<string>"


def _lines(spark, folder):
    return table(spark, folder, "shard_lines", "line_id", "source_path", "line_no", "raw")


def _said(spark, folder):
    return _lines(spark, folder).filter(F.col("raw").rlike(r"\S"))


@query(f"SELECT line_id, source_path || ':' || line_no AS origin, raw ->> '$.utt_id' AS utt_id, raw ->> '$.text' AS text, raw ->> '$.lang' AS lang FROM ({LINES_SQL}) WHERE good")
def scan_records(spark, folder):
    rows = _said(spark, folder).withColumn("record", jsonl.json_object(F.col("raw"), RECORD)).filter("record is not null")
    return rows.select("line_id", fields.origin(F.col("source_path"), F.col("line_no")).alias("origin"), "record.utt_id", "record.text", "record.lang")


@query(f"SELECT line_id, CASE WHEN NOT said THEN 'blank' WHEN good THEN NULL WHEN json_valid(raw) THEN 'not_an_object' ELSE 'malformed_json' END AS reason FROM ({LINES_SQL})")
def reject_split(spark, folder):
    return _lines(spark, folder).select("line_id", jsonl.reject_reason(F.col("raw")).alias("reason"))


@query(f"{ORDINALS_SQL} SELECT source_path, CAST(ordinal // 32 AS BIGINT) AS group_no, count(*) AS n, min(line_no) AS first_line FROM l GROUP BY ALL")
def record_groups(spark, folder):
    rows = jsonl.with_ordinals(_said(spark, folder))
    return rows.groupBy("source_path", F.expr("ordinal div 32").alias("group_no")).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


OFFSETS_SQL = "SELECT line_id, source_path, line_no, raw, CAST(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY source_path ORDER BY line_no) - octet_length(encode(raw)) - 1 AS BIGINT) AS byte_offset FROM shard_lines"


def _with_offsets(spark, folder):
    """Lines with the byte at which each begins in its file of line-feed ended lines."""
    size = F.octet_length("raw") + 1
    through = F.sum(size).over(Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return _lines(spark, folder).withColumn("byte_offset", through - size)


@query(f"SELECT line_id, byte_offset FROM ({OFFSETS_SQL}) WHERE regexp_matches(raw, '\\S')")
def line_offsets(spark, folder):
    return _with_offsets(spark, folder).filter(F.col("raw").rlike(r"\S")).select("line_id", "byte_offset")


@query(f"WITH o AS ({OFFSETS_SQL}) SELECT o.line_id, o.raw FROM o JOIN (SELECT source_path, max(byte_offset) AS byte_offset FROM o WHERE line_no % 50 = 0 GROUP BY 1) w USING (source_path, byte_offset)")
def read_at_offset(spark, folder):
    offsets = _with_offsets(spark, folder)
    wanted = offsets.filter("line_no % 50 = 0").groupBy("source_path").agg(F.max("byte_offset").alias("byte_offset"))
    return offsets.join(wanted, ["source_path", "byte_offset"]).select("line_id", "raw")


_TRIED_SQL = ", ".join(
    f"CASE WHEN regexp_full_match(trim(raw ->> '$.{name}'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AND TRY_CAST(trim(raw ->> '$.{name}') AS DOUBLE) > 0 AND isfinite(TRY_CAST(trim(raw ->> '$.{name}') AS DOUBLE)) THEN TRY_CAST(trim(raw ->> '$.{name}') AS DOUBLE) END"
    for name in ("duration_sec", "duration", "audio_duration_sec", "wav_duration")
)


@query(
    f"""SELECT line_id, CASE WHEN good THEN CAST(trunc(coalesce({_TRIED_SQL}, CASE WHEN TRY_CAST(raw ->> '$.token_len' AS BIGINT) > 0 THEN TRY_CAST(raw ->> '$.token_len' AS BIGINT) END,
      CASE WHEN json_type(raw, '$.token_ids') = 'ARRAY' THEN json_array_length(raw, '$.token_ids') END, 0)) AS BIGINT) ELSE 0 END AS length FROM ({LINES_SQL}) WHERE said"""
)
def line_lengths(spark, folder):
    """A line's duration under any of its names, else its number of tokens; 0 where nothing says a length."""
    rows = _said(spark, folder).select("line_id", jsonl.json_object(F.col("raw"), RECORD).alias("r"))
    seconds = fields.first_duration([F.col(f"r.{name}") for name in fields.DURATION_FIELDS])
    return rows.select("line_id", fields.length_proxy(seconds, F.col("r.token_len"), F.col("r.token_ids")).cast("long").alias("length"))


@query(f"SELECT s.dataset_key, count(*) AS n, count(DISTINCT m.source_path) AS files FROM manifest m JOIN dataset_specs s ON m.source_path = s.train_path WHERE s.{USED.replace('isnan(weight)', 'isnan(s.weight)').replace('AND count', 'AND s.count')} GROUP BY 1")
def dataset_specs_scan(spark, folder):
    used = table(spark, folder, "dataset_specs").filter(USED.lower()).select(F.col("train_path").alias("source_path"), "dataset_key")
    per_file = table(spark, folder, "manifest", "source_path").groupBy("source_path").agg(F.count("*").alias("n"))
    return per_file.join(used, "source_path").groupBy("dataset_key").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query(f"{ORDINALS_SQL}, v AS (SELECT path AS source_path, CAST(p AS BIGINT) AS sel_pos, CAST(p * 7 % 50 AS BIGINT) AS line_index FROM train_shards, range(60) r(p)) SELECT v.source_path, v.sel_pos, l.line_id FROM v JOIN l ON l.source_path = v.source_path AND l.ordinal = v.line_index")
def selection_vector(spark, folder):
    vector = table(spark, folder, "train_shards", F.col("path").alias("source_path")).withColumn("sel_pos", F.explode(F.expr("sequence(0L, 59L)"))).withColumn("line_index", F.col("sel_pos") * 7 % 50)
    return jsonl.select_lines(_said(spark, folder), vector).select("source_path", "sel_pos", "line_id")


@query(f"{ORDINALS_SQL}, v AS (SELECT path AS source_path, CAST(p * 29 AS BIGINT) AS line_index FROM train_shards, range(20) r(p)) SELECT v.source_path, v.line_index FROM v ANTI JOIN l ON l.source_path = v.source_path AND l.ordinal = v.line_index")
def selection_misses(spark, folder):
    vector = table(spark, folder, "train_shards", F.col("path").alias("source_path")).select("source_path", F.explode(F.expr("transform(sequence(0L, 19L), p -> p * 29)")).alias("line_index"))
    return jsonl.missing_lines(_said(spark, folder), vector).select("source_path", "line_index")


@query("SELECT item_id, suite, row_number() OVER (PARTITION BY suite ORDER BY item_id) - 1 AS ordinal FROM eval_items")
def validation_items(spark, folder):
    order = F.row_number().over(Window.partitionBy("suite").orderBy("item_id")) - 1
    return table(spark, folder, "eval_items", "item_id", "suite").withColumn("ordinal", order.cast("long"))


@query(
    """WITH now AS (SELECT source_path AS path, CAST(sum(octet_length(encode(raw)) + 1) AS BIGINT) AS size, CAST(epoch_us(max(ingested_at)) AS BIGINT) AS modified FROM shard_lines GROUP BY 1)
      SELECT path, coalesce(size = size + CASE WHEN modified % 3 = 0 THEN 1 ELSE 0 END AND modified % 5 <> 0, false) AS is_current FROM now"""
)
def side_index_current(spark, folder):
    now = table(spark, folder, "shard_lines", F.col("source_path").alias("path"), "raw", "ingested_at").groupBy("path").agg(F.sum(F.octet_length("raw") + 1).alias("size"), F.unix_micros(F.max("ingested_at").cast("timestamp")).alias("modified"))
    kept = now.select("path", (F.col("size") + (F.col("modified") % 3 == 0).cast("long")).alias("kept_size"), F.when(F.col("modified") % 5 != 0, F.col("modified")).alias("kept_modified"))
    joined = now.join(kept, "path")
    same = files.is_current(F.col("path"), F.col("size"), F.col("modified"), F.col("path"), F.col("kept_size"), F.col("kept_modified"))
    return joined.select("path", same.alias("is_current"))


@query(f"SELECT m.row_id, s.weight FROM manifest m JOIN (SELECT dataset_key, min(weight) AS weight FROM dataset_specs WHERE weight > 0 AND NOT isnan(weight) GROUP BY 1) s ON s.dataset_key = coalesce({KEY_SQL}, (SELECT any_value(d.dataset_key) FROM dataset_specs d WHERE d.train_path = m.source_path))")
def sample_spec_join(spark, folder):
    weights = table(spark, folder, "dataset_specs").filter("weight > 0 and not isnan(weight)").groupBy("dataset_key").agg(F.min("weight").alias("weight"))
    return keyed_rows(spark, folder).join(F.broadcast(weights), "dataset_key").select("row_id", "weight")
