"""Queries on single records: fields, guards and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import fields, selectors
from tapeloom.plans.registry import query
from tapeloom.sources.tables import table

CAP = 15.0
EDGES = (3, 7, 10, 13)
AUDIO_ID, EOS_ID = 7, 2

_NUMBER = r"regexp_full_match(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"
_POSITIVE = "CASE WHEN " + _NUMBER + r" AND TRY_CAST(regexp_replace({0}, '^\s+|\s+$', '', 'g') AS DOUBLE) > 0 AND isfinite(TRY_CAST(regexp_replace({0}, '^\s+|\s+$', '', 'g') AS DOUBLE)) THEN TRY_CAST(regexp_replace({0}, '^\s+|\s+$', '', 'g') AS DOUBLE) END"
SECONDS_SQL = f"coalesce({_POSITIVE.format('duration_sec')}, {_POSITIVE.format('duration')})"
# White space in the Unicode sense, as RE2 classes
SPACE_SQL = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NAMES_SQL = "CASE {0} WHEN 'zh' THEN 'Chinese' WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END"


def stripped_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


#: A manifest row's own dataset key, null if blank.
KEY_SQL = f"nullif(lower({stripped_sql('m.dataset_key')}), '')"
CODE_SQL = f"lower({stripped_sql('lang')})"
SOURCE_TEXT_SQL = stripped_sql("coalesce(nullif(text_norm, ''), nullif(text, ''), nullif(gold_text, ''))")


def seconds():
    """Duration of a manifest row in seconds."""
    return fields.first_duration([F.col("duration_sec"), F.col("duration")])


def _texts():
    return [F.col(c) for c in fields.TEXT_FIELDS]


@query(f"SELECT row_id, {SECONDS_SQL} AS seconds FROM manifest")
def duration_resolve(spark, folder):
    return table(spark, folder, "manifest").select("row_id", seconds().alias("seconds"))


@query(
    f"""SELECT row_id, coalesce({SECONDS_SQL},
      CASE WHEN regexp_full_match(trim(token_len), '[+-]?\\d+') AND TRY_CAST(trim(token_len) AS BIGINT) > 0 THEN CAST(TRY_CAST(trim(token_len) AS BIGINT) AS DOUBLE) END,
      CAST(len(token_ids) AS DOUBLE), 0.0) AS proxy FROM manifest"""
)
def length_proxy(spark, folder):
    return table(spark, folder, "manifest").select("row_id", fields.length_proxy(seconds(), F.col("token_len"), F.col("token_ids")).alias("proxy"))


@query(
    f"""SELECT row_id, coalesce(nullif({stripped_sql('target_text')}, ''),
      'language ' || {NAMES_SQL.format(CODE_SQL)} || '<asr_text>' || coalesce({SOURCE_TEXT_SQL}, '')) AS target,
      coalesce(nullif({stripped_sql('target_text')}, ''), coalesce({SOURCE_TEXT_SQL}, '')) AS plain FROM manifest"""
)
def target_text(spark, folder):
    rows = table(spark, folder, "manifest")
    return rows.select("row_id", fields.target_text(F.col("target_text"), _texts(), F.col("lang")).alias("target"), fields.target_text(F.col("target_text"), _texts(), F.col("lang"), "plain_text").alias("plain"))


@query(
    f"""SELECT row_id, coalesce(nullif({stripped_sql('target_text')}, ''), nullif({stripped_sql('gold_text')}, '')) AS target_filled,
      coalesce(nullif({stripped_sql('text')}, ''), nullif({stripped_sql('gold_text')}, '')) AS text_filled FROM manifest"""
)
def gold_backfill(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "target_text", "text", "gold_text")
    gold = fields.nonblank(F.col("gold_text"))
    return rows.select("row_id", F.coalesce(fields.nonblank(F.col("target_text")), gold).alias("target_filled"), F.coalesce(fields.nonblank(F.col("text")), gold).alias("text_filled"))


@query(
    """SELECT row_id, CASE WHEN nullif(source_path, '') IS NOT NULL AND line_no IS NOT NULL THEN source_path || ':' || line_no
      WHEN nullif(source_path, '') IS NOT NULL THEN source_path WHEN line_no IS NOT NULL THEN 'line=' || line_no ELSE '' END AS origin FROM manifest"""
)
def provenance_string(spark, folder):
    return table(spark, folder, "manifest", "row_id", "source_path", "line_no").select("row_id", fields.origin(F.col("source_path"), F.col("line_no")).alias("origin"))


@query("SELECT m.row_id, coalesce(m.dataset_key, s.dataset_key) AS dataset_key FROM manifest m LEFT JOIN dataset_specs s ON m.source_path = s.train_path")
def dataset_key_default(spark, folder):
    specs = table(spark, folder, "dataset_specs").select("train_path", F.col("dataset_key").alias("file_key"))
    rows = table(spark, folder, "manifest", "row_id", "source_path", "dataset_key")
    return rows.join(specs, rows.source_path == specs.train_path, "left").select("row_id", F.coalesce("dataset_key", "file_key").alias("dataset_key"))


@query(
    f"""SELECT row_id, seconds, CASE WHEN seconds > {CAP} THEN 'duration_over_cap' END AS reject_reason
      FROM (SELECT row_id, {SECONDS_SQL} AS seconds FROM manifest)"""
)
def duration_guard_split(spark, folder):
    rows = table(spark, folder, "manifest").select("row_id", seconds().alias("seconds"))
    return rows.withColumn("reject_reason", F.when(fields.over_cap(F.col("seconds"), CAP), "duration_over_cap"))


@query(
    f"""WITH g AS (SELECT {CODE_SQL} AS code, {SECONDS_SQL} AS seconds FROM manifest),
      b AS (SELECT code, CAST(trunc(coalesce(seconds, 0)) AS BIGINT) AS length FROM g WHERE (seconds IS NULL OR seconds <= {CAP}) AND code IN ('zh', 'en', 'de', 'fr'))
      SELECT code, CAST(len(list_filter([3, 7, 10, 13], lambda e: e < length)) AS BIGINT) AS length_bin, count(*) AS n, CAST(sum(length) AS BIGINT) AS total_length, CAST(max(length) * count(*) AS BIGINT) AS padded_cost
      FROM b GROUP BY ALL"""
)
def length_bin_hist(spark, folder):
    rows = table(spark, folder, "manifest").select(fields.language_code(F.col("lang")).alias("code"), seconds().alias("seconds"))
    kept = rows.filter(~fields.over_cap(F.col("seconds"), CAP) & F.col("code").isin(*fields.LANGUAGE_NAMES)).withColumn("length", F.coalesce("seconds", F.lit(0.0)).cast("long"))
    return kept.groupBy("code", fields.length_bin(F.col("length"), EDGES).alias("length_bin")).agg(F.count("*").alias("n"), F.sum("length").alias("total_length"), (F.max("length") * F.count("*")).alias("padded_cost"))


@query(
    """WITH p AS (SELECT DISTINCT class_selector, unnest(string_split(replace(class_selector, '_', ','), ',')) AS piece FROM dataset_specs WHERE trim(class_selector) <> ''),
      c AS (SELECT DISTINCT class_selector, unnest(range(CAST(string_split(piece, '-')[1] AS BIGINT), CAST(string_split(piece, '-')[-1] AS BIGINT) + 1)) AS class FROM p),
      g AS (SELECT class_selector, string_agg(class, '_' ORDER BY class) AS selected FROM c GROUP BY 1)
      SELECT s.train_path, g.selected, coalesce('train_class_' || g.selected || '.jsonl', 'train_with_class.jsonl') AS manifest_name
      FROM dataset_specs s LEFT JOIN g ON s.class_selector = g.class_selector"""
)
def class_selectors(spark, folder):
    specs = table(spark, folder, "dataset_specs", "train_path", "class_selector")
    # selectors are a small vocabulary; each distinct one is parsed once
    parsed = [(r[0], selectors.canonical_selector(r[0]), selectors.manifest_name(r[0])) for r in specs.select("class_selector").distinct().collect()]
    names = spark.createDataFrame(parsed, "class_selector string, selected string, manifest_name string")
    same = specs.class_selector.eqNullSafe(names.class_selector)
    return specs.join(F.broadcast(names), same).select("train_path", "selected", "manifest_name")


@query(
    """WITH p AS (SELECT DISTINCT class_selector, trim(unnest(string_split(replace(class_selector, '_', ','), ','))) AS piece FROM dataset_specs WHERE trim(class_selector) <> ''),
      c AS (SELECT DISTINCT class_selector, unnest(range(CAST(string_split(piece, '-')[1] AS BIGINT), CAST(string_split(piece, '-')[-1] AS BIGINT) + 1)) AS class FROM p WHERE piece <> '')
      SELECT m.row_id, CAST(m.row_id % 9 + 1 AS BIGINT) AS class FROM manifest m JOIN dataset_specs s ON m.source_path = s.train_path
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.class_selector = s.class_selector) OR EXISTS (SELECT 1 FROM c WHERE c.class_selector = s.class_selector AND c.class = m.row_id % 9 + 1)"""
)
def class_filter_by_file(spark, folder):
    """Rows of the classes that their own file selects; a file without a selector keeps all."""
    specs = table(spark, folder, "dataset_specs", F.col("train_path").alias("source_path"), "class_selector")
    # selectors are a small vocabulary; each distinct one is parsed once
    parsed = [(r[0], list(selectors.parse_selector(r[0])) or None) for r in specs.select("class_selector").distinct().collect()]
    chosen = F.broadcast(spark.createDataFrame(parsed, "class_selector string, classes array<long>"))
    files = specs.join(chosen, specs.class_selector.eqNullSafe(chosen.class_selector)).select("source_path", "classes")
    rows = table(spark, folder, "manifest", "row_id", "source_path").withColumn("class", F.col("row_id") % 9 + 1)
    return rows.join(files, "source_path").filter("classes is null or array_contains(classes, class)").select("row_id", "class")


@query("SELECT train_path, dataset_key, weight FROM dataset_specs WHERE weight > 0 AND NOT isnan(weight) AND count > 0")
def weight_filter(spark, folder):
    return table(spark, folder, "dataset_specs").filter("weight > 0 and not isnan(weight) and count > 0").select("train_path", "dataset_key", "weight")


@query(
    f"""SELECT row_id, list_transform(list_append(token_ids, CAST({EOS_ID} AS BIGINT)), lambda x: CASE WHEN x = {AUDIO_ID} THEN CAST(-100 AS BIGINT) ELSE x END) AS labels,
      CAST(len(token_ids) + 1 AS BIGINT) AS n FROM manifest WHERE token_ids IS NOT NULL"""
)
def label_mask(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "token_ids").filter("token_ids is not null")
    labels = fields.masked_labels(F.col("token_ids"), AUDIO_ID, EOS_ID)
    return rows.select("row_id", labels.alias("labels"), F.size(labels).cast("long").alias("n"))


@query(f"SELECT row_id, {CODE_SQL} AS code, CASE WHEN {CODE_SQL} IN ('zh', 'en', 'de', 'fr') THEN NULL ELSE 'unsupported_language' END AS reject_reason FROM manifest")
def language_split(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "lang").select("row_id", fields.language_code(F.col("lang")).alias("code"))
    return rows.withColumn("reject_reason", F.when(fields.language_name(F.col("code")).isNull(), "unsupported_language"))


@query("SELECT label, count(*) AS n, count(*) = count(embedding) AS rows_ok, coalesce(bool_and(len(embedding) = 64), true) AS width_ok FROM embeddings GROUP BY label")
def feature_shape_check(spark, folder):
    rows = table(spark, folder, "embeddings", "label", "embedding")
    width = F.coalesce(F.bool_and(F.size("embedding") == 64), F.lit(True))
    return rows.groupBy("label").agg(F.count("*").alias("n"), (F.count("*") == F.count("embedding")).alias("rows_ok"), width.alias("width_ok"))


@query(f"SELECT coalesce(avg(CAST(bad AS DOUBLE)), 0) AS failed_fraction, coalesce(avg(CAST(bad AS DOUBLE)), 0) <= 0.9 AS within_limit FROM (SELECT CASE WHEN {CODE_SQL} IN ('zh', 'en', 'de', 'fr') THEN 0 ELSE 1 END AS bad FROM manifest)")
def failed_fraction(spark, folder):
    bad = fields.language_name(fields.language_code(F.col("lang"))).isNull().cast("double")
    share = F.coalesce(F.avg(bad), F.lit(0.0))
    return table(spark, folder, "manifest", "lang").agg(share.alias("failed_fraction"), (share <= 0.9).alias("within_limit"))
