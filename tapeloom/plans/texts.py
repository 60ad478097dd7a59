"""Queries on text, references, errors and small formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import fields, text
from tapeloom.plans.records import CODE_SQL, NAMES_SQL, SECONDS_SQL, SPACE_SQL, seconds, stripped_sql
from tapeloom.plans.registry import query
from tapeloom.sources import files
from tapeloom.sources.tables import table

def _raw():
    t = F.col("text")
    return F.when(F.col("row_id") % 4 == 0, F.concat(F.lit(" language English_US<asr_text>"), t)).when(F.col("row_id") % 4 == 1, F.concat(F.lit("<|x|> language ChinEse <asr_text> "), t)).when(F.col("row_id") % 4 == 2, F.concat(F.lit("language Englishx"), t)).otherwise(t)


@query()
def control_prefix_strip_all(spark, folder):
    """All rows, also texts that begin with a control mark of their own; a null text stays null."""
    return table(spark, folder, "manifest", "row_id", "text").select("row_id", text.without_control_prefix(_raw()).alias("said"))


@query(f"SELECT row_id, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')) AS squeezed FROM manifest WHERE text IS NOT NULL")
def text_whitespace_norm(spark, folder):
    return table(spark, folder, "manifest", "row_id", "text").filter("text is not null").select("row_id", text.squeezed(F.col("text")).alias("squeezed"))


@query(
    f"""SELECT row_id, nullif(trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')), '') AS normalized FROM manifest
      WHERE {CODE_SQL} IN ('en', 'de', 'fr') AND text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')"""
)
def ascii_normalize(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "text", "lang").withColumn("code", fields.language_code(F.col("lang")))
    kept = rows.filter(F.col("code").isin("en", "de", "fr") & F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return kept.select("row_id", text.normalized(F.col("text"), F.col("code")).alias("normalized"))


@query()
def nfkc_normalize(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "text", "lang")
    return rows.select("row_id", text.normalized(F.col("text"), fields.language_code(F.col("lang"))).alias("normalized"))


@query()
def zh_compact(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "text", "lang").withColumn("code", fields.language_code(F.col("lang"))).filter("code = 'zh' and text is not null")
    done = rows.select("row_id", F.length("text").cast("long").alias("before"), F.length(text.normalized(F.col("text"), F.col("code"))).cast("long").alias("after"))
    return done.filter("before != after")


@query(f"SELECT row_id, {NAMES_SQL.format(CODE_SQL)} AS language FROM manifest")
def lang_name_lookup(spark, folder):
    return table(spark, folder, "manifest", "row_id", "lang").select("row_id", fields.language_name(fields.language_code(F.col("lang"))).alias("language"))


# keys beside those of the table, so that each kind of key is there
_MORE_KEYS = ("kespeech", "AISHELL-1_Chinese", "CommonVoice_English", "gigaspeech_en", "Emilia-YODAS_Chinese", "other_zh", "ACGN_ZH", "acgn_en ", "")


@query(
    """SELECT dataset_key, CASE WHEN dataset_key IN ('AISHELL-1_Chinese', 'CommonVoice_Chinese', 'kespeech', 'acgn_zh', 'ZHvoice_Chinese', 'Emilia-YODAS_Chinese') THEN 'zh'
      WHEN dataset_key IN ('CommonVoice_English', 'Emilia-YODAS_English', 'acgn_en', 'gigaspeech_en') THEN 'en' END AS inferred
      FROM (SELECT dataset_key FROM dataset_specs UNION SELECT unnest(['kespeech', 'AISHELL-1_Chinese', 'CommonVoice_English', 'gigaspeech_en', 'Emilia-YODAS_Chinese', 'other_zh', 'ACGN_ZH', 'acgn_en ', '']))"""
)
def infer_lang(spark, folder):
    more = spark.createDataFrame([(k,) for k in _MORE_KEYS], "dataset_key string")
    keys = table(spark, folder, "dataset_specs", "dataset_key").unionByName(more).distinct()
    return keys.select("dataset_key", fields.inferred_language(F.col("dataset_key")).alias("inferred"))


@query(
    f"""SELECT row_id, '<|im_start|>system' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<|audio|><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ||
      'language ' || CASE WHEN {CODE_SQL} = 'zh' THEN 'Chinese' ELSE 'English' END || '<asr_text>' AS prompt FROM manifest"""
)
def prompt_build(spark, folder):
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("said")) for i, role, said in ((0, "system", ""), (1, "user", "<|audio|>"))))
    shown = F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["said"], F.lit("<|im_end|>\n"))), "")
    name = F.when(fields.language_code(F.col("lang")) == "zh", "Chinese").otherwise("English")
    return table(spark, folder, "manifest", "row_id", "lang").select("row_id", F.concat(shown, F.lit("<|im_start|>assistant\nlanguage "), name, F.lit("<asr_text>")).alias("prompt"))


@query(
    """SELECT row_id, nullif(regexp_extract(audio_ref, '^oss://([^/]+)/(.+)$', 1), '') AS bucket, nullif(regexp_extract(audio_ref, '^oss://([^/]+)/(.+)$', 2), '') AS object_key,
      CASE WHEN regexp_matches(audio_ref, '^oss://[^/]+/.+$') THEN '/cache/' || regexp_extract(audio_ref, '^oss://(.+)$', 1) END AS cached_at FROM manifest"""
)
def uri_parse(spark, folder):
    ref = F.col("audio_ref")
    return table(spark, folder, "manifest", "row_id", "audio_ref").select("row_id", text.uri_part(ref, 1).alias("bucket"), text.uri_part(ref, 2).alias("object_key"), text.cache_path(ref, "/cache").alias("cached_at"))


@query("SELECT path, CASE WHEN ends_with(path, '.jsonl') THEN left(path, length(path) - 6) || '.offsets.npy' ELSE path || '.offsets.npy' END AS side_path FROM (SELECT path FROM train_shards UNION ALL SELECT 'plain.txt')")
def side_index_paths(spark, folder):
    paths = table(spark, folder, "train_shards", "path").unionByName(spark.createDataFrame([("plain.txt",)], "path string"))
    return paths.select("path", text.side_index_path(F.col("path"), "offsets").alias("side_path"))


def _values(rows, columns: str) -> str:
    """A SQL table of literal rows."""
    literal = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows) + f") v({columns})"


# failures with each status, type, code and message of interest, and whether to try again by the rule read line by line
_FAILURES = (
    (429, None, None, "no", True), (500, None, None, None, True), (502, None, None, None, True), (503, "OssError", "SlowDown", "", True), (504, None, None, None, True), (404, "OssError", "NoSuchKey", "no such key", False), (403, "OssError", "AccessDenied", "denied", False),
    (None, "ConnectionError", None, "no", True), (None, "ConnectionResetError", None, "no", True), (None, "ConnectionRefusedError", None, "no", True), (None, "BrokenPipeError", None, "no", True), (None, "KeyError", None, "'key'", False),
    (None, None, "PartitionQpsLimitted", "no", True), (None, None, None, "Partition QPS limitted", True), (None, None, None, "Please retry later", True), (None, None, None, "Too Many Requests", True), (None, None, None, "temporarily unavailable", True),
    (None, None, None, "Read timeout", True), (None, None, None, "connection refused", True), (None, None, "ConnectionTimeout", None, True), (None, None, None, "stream was RESET", True), (None, None, None, "broken pipe", True), (None, None, None, "network is unreachable", True),
    (None, None, None, "[Errno 104]", True), (None, None, None, "timed out", False), (None, None, None, "slow down", False), (200, None, None, None, False), (None, None, None, None, False),
)


@query(_values(_FAILURES, "status, error_type, code, message, retry"))
def retry_classify(spark, folder):
    failures = spark.createDataFrame([row[:4] for row in _FAILURES], "status int, error_type string, code string, message string")
    return failures.withColumn("retry", text.retryable(F.col("status"), F.col("error_type"), F.col("message"), F.col("code")))


@query("SELECT CAST(n AS BIGINT) AS attempts, round(coalesce(list_sum(list_transform(range(n - 1), lambda i: least(0.5 * 2 ** i, 8.0) * 1.2)), 0.0), 6) AS wait_seconds, round(coalesce(list_sum(list_transform(range(n - 1), lambda i: least(0.5 * 2 ** i, 8.0) * 1.2)), 0.0) + 60, 6) AS lock_seconds FROM range(1, 13) r(n)")
def backoff_budget(spark, folder):
    waits = F.when(F.col("attempts") > 1, F.sequence(F.lit(0).cast("long"), F.col("attempts") - 2)).otherwise(F.expr("cast(array() as array<bigint>)"))
    total = F.round(F.aggregate(waits, F.lit(0.0), lambda a, i: a + F.least(0.5 * F.pow(F.lit(2.0), i), F.lit(8.0)) * 1.2), 6)
    return spark.range(1, 13).select(F.col("id").alias("attempts")).select("attempts", total.alias("wait_seconds"), (total + 60).alias("lock_seconds"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.2fB', n / 1e9) WHEN n >= 1000000 THEN printf('%.2fM', n / 1e6) WHEN n >= 1000 THEN printf('%.2fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 16 AS n FROM orders)")
def parameter_format(spark, folder):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 16
    return table(spark, folder, "orders", "o_orderkey").select("o_orderkey", text.parameter_count(n).alias("shown"))


@query("SELECT left_ctx, block, 'block_B' || block || '_left' || coalesce(CAST(left_ctx AS VARCHAR), 'inf') || '_native' AS label, block > 0 AND (left_ctx IS NULL OR left_ctx > 0) AS valid FROM (VALUES (2, 5), (8, NULL), (4, 0)) v(block, left_ctx)")
def mask_labels(spark, folder):
    specs = spark.createDataFrame([(2, 5), (8, None), (4, 0)], "block int, left_ctx int")
    label = F.concat(F.lit("block_B"), F.col("block").cast("string"), F.lit("_left"), F.coalesce(F.col("left_ctx").cast("string"), F.lit("inf")), F.lit("_native"))
    return specs.select("left_ctx", "block", label.alias("label"), ((F.col("block") > 0) & (F.col("left_ctx").isNull() | (F.col("left_ctx") > 0))).alias("valid"))


@query(f"SELECT row_id, CAST(floor(seconds * 16000) AS BIGINT) AS samples, floor(seconds * 16000) / 16000 AS duration FROM (SELECT row_id, {SECONDS_SQL} AS seconds FROM manifest) WHERE seconds IS NOT NULL")
def sample_durations(spark, folder):
    rows = table(spark, folder, "manifest").select("row_id", seconds().alias("s")).filter("s is not null")
    samples = F.floor(F.col("s") * fields.SAMPLE_RATE)
    return rows.select("row_id", samples.alias("samples"), (samples / fields.SAMPLE_RATE).alias("duration"))


@query(f"SELECT row_id, {CODE_SQL} AS lang_code, round_even({SECONDS_SQL} * 8, 0) / 8 AS seconds, CAST(json_object('audio', audio_path, 'lang_code', {CODE_SQL}, 'pred_text', 'x') AS VARCHAR) AS line FROM manifest")
def result_json_all(spark, folder):
    """A JSON line for every row, whatever its characters; missing fields are JSON nulls."""
    code = fields.language_code(F.col("lang"))
    line = F.to_json(F.struct(F.col("audio_path").alias("audio"), code.alias("lang_code"), F.lit("x").alias("pred_text")), {"ignoreNullFields": "false"})
    return table(spark, folder, "manifest").select("row_id", code.alias("lang_code"), (F.bround(seconds() * 8) / 8).alias("seconds"), line.alias("line"))


@query(f"SELECT row_id, CAST(json_object('audio', coalesce(audio_path, audio_ref), 'lang_code', {CODE_SQL}, 'duration_sec', floor(coalesce({SECONDS_SQL}, 0)) + 0.5, 'raw_pred_text', text, 'pred_text', nullif({stripped_sql('text')}, '')) AS VARCHAR) AS line FROM manifest")
def result_lines(spark, folder):
    """The lines of a transcription result: reference, language, duration, raw and cleaned prediction, for every row."""
    rows = table(spark, folder, "manifest")
    line = F.struct(
        F.coalesce("audio_path", "audio_ref").alias("audio"), fields.language_code(F.col("lang")).alias("lang_code"), (F.floor(F.coalesce(seconds(), F.lit(0.0))) + 0.5).cast("double").alias("duration_sec"),
        F.col("text").alias("raw_pred_text"), fields.nonblank(F.col("text")).alias("pred_text"),
    )
    return rows.select("row_id", F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


@query("SELECT row_id, coalesce(nullif(trim(target_text), ''), nullif(trim(text_norm), ''), 'default') AS source FROM manifest")
def source_resolution(spark, folder):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, folder, "manifest", "row_id", "target_text", "text_norm").select("row_id", F.coalesce(blank("target_text"), blank("text_norm"), F.lit("default")).alias("source"))


# (name, GPU, bfloat16 there, type of the model, type of mixed precision): expected values by the rules, stated one by one
_DTYPES = (
    ("bf16", True, True, "bfloat16", "bfloat16"), ("BF16", True, False, "bfloat16", "float16"), ("bfloat16", False, False, "float32", None), ("fp16", True, True, "float16", "float16"), ("half", True, False, "float16", "float16"), (" Float16 ", False, True, "float32", None),
    ("fp32", True, True, "float32", None), ("float32", False, False, "float32", None), ("auto", True, True, "bfloat16", "bfloat16"), ("auto", True, False, "float16", "float16"), ("auto", False, True, "float32", None), ("", True, True, "bfloat16", None), (None, True, False, "float16", None), ("", False, False, "float32", None),
)


@query(_values(_DTYPES, "name, on_gpu, has_bfloat16, dtype, amp_dtype"))
def dtype_resolution(spark, folder):
    rows = spark.createDataFrame([r[:3] for r in _DTYPES], "name string, on_gpu boolean, has_bfloat16 boolean")
    args = (F.col("name"), F.col("on_gpu"), F.col("has_bfloat16"))
    return rows.select(*args, fields.resolved_dtype(*args).alias("dtype"), fields.mixed_precision_dtype(*args).alias("amp_dtype"))


_TEMPERATURES = ((True, 0.5, 0.5), (False, 0.5, None), (False, 1.0, 1.0), (True, 1.0, 1.0), (True, None, None), (False, None, None), (None, 0.7, None), (None, 1.0, 1.0))


@query(_values(_TEMPERATURES, "do_sample, temperature, used").replace("SELECT *", "SELECT do_sample, CAST(temperature AS DOUBLE) AS temperature, CAST(used AS DOUBLE) AS used"))
def generation_settings(spark, folder):
    rows = spark.createDataFrame([r[:2] for r in _TEMPERATURES], "do_sample boolean, temperature double")
    return rows.withColumn("used", fields.used_temperature(F.col("do_sample"), F.col("temperature")))


REFS_SQL = """WITH listing AS (SELECT DISTINCT audio_path AS path FROM manifest WHERE row_id % 3 <> 0 AND audio_path IS NOT NULL),
  c AS (SELECT row_id, 1 AS priority, nullif(trim(audio_path), '') AS path FROM manifest UNION ALL SELECT row_id, 6, CASE WHEN starts_with(audio_ref, 'oss://') THEN '/cache/' || substr(audio_ref, 7) END FROM manifest
    UNION ALL SELECT row_id, 7, CASE WHEN NOT starts_with(audio_ref, 'oss://') THEN audio_ref END FROM manifest)
  SELECT m.row_id, arg_min(c.path, c.priority) AS resolved, min(c.priority) AS priority FROM manifest m LEFT JOIN
    (SELECT c.* FROM c WHERE c.path IS NOT NULL AND (c.priority > 1 OR c.path IN (SELECT path FROM listing))) c ON c.row_id = m.row_id GROUP BY m.row_id"""


@query(REFS_SQL)
def path_priority(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "audio_path", "audio_ref")
    listing = rows.filter("row_id % 3 != 0 and audio_path is not null").select(F.col("audio_path").alias("path")).distinct()
    own = rows.select("row_id", F.nullif(F.trim("audio_path"), F.lit("")).alias("path")).filter("path is not null").join(listing, "path", "left_semi").select("row_id", F.col("path").alias("listed"))
    local = F.when(~F.col("audio_ref").startswith("oss://"), F.col("audio_ref"))
    cached = F.when(F.col("audio_ref").startswith("oss://"), F.concat(F.lit("/cache/"), F.expr("substring(audio_ref, 7)")))
    joined = rows.join(own, "row_id", "left")
    best = F.when(F.col("listed").isNotNull(), 1).when(cached.isNotNull(), 6).when(local.isNotNull(), 7)
    return joined.select("row_id", F.coalesce("listed", cached, local).alias("resolved"), best.alias("priority"))


# The folder that file names are looked up in, and the suffixes tried for a stem, in order.
ROOT, STEM_SUFFIXES = "audio", (".wav", ".mp3", ".flac", ".m4a", ".ogg", ".aac")
_ASKED_SQL = "nullif(trim(m.filename), '')"
_LAST_SQL = f"regexp_extract({_ASKED_SQL}, '[^/]*$')"
_STEM_SQL = f"regexp_replace({_LAST_SQL}, '(.)\\.[^.]*$', '\\1')"


def _paths_sql(refs: str) -> str:
    """The SQL of a result of (row_id, resolved, priority), with look-ups by file name where nothing is resolved."""
    return f"""WITH base AS ({refs}), listing AS (SELECT DISTINCT audio_path AS path, regexp_extract(audio_path, '[^/]*$') AS name FROM manifest WHERE row_id % 3 <> 0 AND audio_path IS NOT NULL AND starts_with(audio_path, '{ROOT}/')),
  named AS (SELECT name, min(path) AS path FROM listing GROUP BY name),
  suffixes AS (SELECT unnest({list(STEM_SUFFIXES)}) AS suffix, unnest(range({len(STEM_SUFFIXES)})) AS place),
  asked AS (SELECT m.row_id, {_ASKED_SQL} AS asked, {_LAST_SQL} AS last, {_STEM_SQL} AS stem FROM manifest m JOIN base b ON b.row_id = m.row_id WHERE nullif(trim(b.resolved), '') IS NULL AND {_ASKED_SQL} IS NOT NULL),
  f AS (SELECT a.row_id, 8 AS priority, 0 AS place, l.path FROM asked a JOIN listing l ON l.path = '{ROOT}/' || a.asked
    UNION ALL SELECT a.row_id, 9, s.place, n.path FROM asked a CROSS JOIN suffixes s JOIN named n ON n.name = a.stem || s.suffix
    UNION ALL SELECT a.row_id, 10, 0, min(l.path) FROM asked a JOIN listing l ON l.name = a.last AND ends_with(l.path, '/' || a.asked) GROUP BY a.row_id),
  best AS (SELECT row_id, arg_min(path, priority * 100 + place) AS path, min(priority) AS priority FROM f GROUP BY row_id)
  SELECT b.row_id, CASE WHEN nullif(trim(b.resolved), '') IS NOT NULL THEN b.resolved ELSE best.path END AS resolved, CASE WHEN nullif(trim(b.resolved), '') IS NOT NULL THEN b.priority ELSE best.priority END AS priority FROM base b LEFT JOIN best ON best.row_id = b.row_id"""


def found_by_filename(asked, listing, root):
    """(asked, path, priority): file names looked up under a folder; the smallest of several paths.

    First folder/name (8), then the stem with each suffix (9), then the name anywhere (10). `asked` has distinct names.
    """
    under = listing.filter(F.col("path").startswith(f"{root}/")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    last = F.element_at(F.split("asked", "/"), -1)
    names = asked.select("asked", last.alias("last"), F.regexp_replace(last, r"(?<=.)\.[^.]*$", "").alias("stem"))
    direct = names.select("asked", F.concat(F.lit(f"{root}/"), "asked").alias("path")).join(under, "path", "left_semi").select("asked", "path", F.lit(8).alias("priority"), F.lit(0).alias("place"))
    tries = names.select("asked", F.posexplode(F.array(*(F.concat("stem", F.lit(x)) for x in STEM_SUFFIXES))).alias("place", "name"))
    by_stem = tries.join(files.first_by(under, "name"), "name").select("asked", "path", F.lit(9).alias("priority"), "place")
    anywhere = names.join(under, names["last"] == under["name"]).filter(F.col("path").endswith(F.concat(F.lit("/"), "asked"))).select("asked", "path", F.lit(10).alias("priority"), F.lit(0).alias("place"))
    best = F.min(F.struct("priority", "place", "path")).alias("b")
    return direct.unionByName(by_stem).unionByName(anywhere).groupBy("asked").agg(best).select("asked", "b.path", "b.priority")


@query(_paths_sql(REFS_SQL))
def path_priority_by_name(spark, folder):
    """`path_priority`, then by file name for the rows that it leaves open."""
    rows = table(spark, folder, "manifest", "row_id", "audio_path", F.nullif(F.trim("filename"), F.lit("")).alias("asked"))
    listing = rows.filter("row_id % 3 != 0 and audio_path is not null").select(F.col("audio_path").alias("path")).distinct()
    return _named_last(path_priority(spark, folder), rows, listing)


def _named_last(base, rows, listing):
    """(row_id, resolved, priority) of `base`; rows without a path are looked up by the file name in `asked`."""
    base = base.withColumn("resolved", F.when(F.trim("resolved") != "", F.col("resolved")))
    open_rows = base.join(rows.select("row_id", "asked"), "row_id").withColumn("asked", F.when(F.col("resolved").isNull(), F.col("asked")))
    found = found_by_filename(rows.filter("asked is not null").select("asked").distinct(), listing, ROOT).withColumnRenamed("priority", "by_name")
    # rows that ask nothing get a key of their own, so that they don't meet in one task
    keyed = open_rows.withColumn("_k", F.coalesce("asked", F.concat(F.lit("\0"), F.col("row_id").cast("string"))))
    joined = keyed.join(found.withColumnRenamed("asked", "_k"), "_k", "left")
    return joined.select("row_id", F.coalesce("resolved", "path").alias("resolved"), F.when(F.col("resolved").isNotNull(), F.col("priority")).otherwise(F.col("by_name")).alias("priority"))


def resolved_references(rows, listing):
    """(row_id, resolved, priority): the first of a record's references that leads to a file.

    The path fields that `rows` has are tried in their order (1 to 5) against the listing, then an object reference gives
    its place in the cache (6), then a local reference is tried against the listing (7). Blank values count as missing;
    a row with none comes out with nulls.
    """
    ref = fields.nonblank(F.col("audio_ref"))
    stored = ref.startswith("oss://")
    paths = [(i, fields.nonblank(F.col(c))) for i, c in enumerate(fields.AUDIO_FIELDS, 1) if c in rows.columns] + [(7, F.when(~stored, ref))]
    tries = F.array(*(F.struct(F.lit(i).alias("priority"), path.alias("path")) for i, path in paths))
    there = rows.select("row_id", F.inline(tries)).filter("path is not null").join(listing, "path", "left_semi")
    best = there.groupBy("row_id").agg(F.min(F.struct("priority", "path")).alias("_there"))
    joined = rows.join(best, "row_id", "left")
    cached = F.struct(F.lit(6).alias("priority"), F.concat(F.lit("/cache/"), F.substring(ref, F.lit(7), F.length(ref))).alias("path"))
    use = F.when(F.col("_there.priority") < 6, F.col("_there")).when(stored, cached).otherwise(F.col("_there"))
    return joined.select("row_id", use["path"].alias("resolved"), use["priority"].alias("priority"))


_LISTED_SQL = "SELECT DISTINCT audio_path AS path FROM manifest WHERE row_id % 3 <> 0 AND audio_path IS NOT NULL UNION SELECT audio_ref FROM manifest WHERE row_id % 5 <> 0 AND audio_ref IS NOT NULL AND NOT starts_with(audio_ref, 'oss://')"
_RESOLVED_SQL = f"""WITH listed AS ({_LISTED_SQL}), c AS (SELECT row_id, 1 AS priority, nullif({stripped_sql('audio_path')}, '') AS path FROM manifest
    UNION ALL SELECT row_id, CASE WHEN starts_with(ref, 'oss://') THEN 6 ELSE 7 END, CASE WHEN starts_with(ref, 'oss://') THEN '/cache/' || substr(ref, 7) ELSE ref END FROM (SELECT row_id, nullif({stripped_sql('audio_ref')}, '') AS ref FROM manifest)),
    g AS (SELECT * FROM c WHERE path IS NOT NULL AND (priority = 6 OR path IN (SELECT path FROM listed)))
  SELECT m.row_id, arg_min(g.path, g.priority) AS resolved, min(g.priority) AS priority FROM manifest m LEFT JOIN g ON g.row_id = m.row_id GROUP BY m.row_id"""


@query(_paths_sql(_RESOLVED_SQL))
def audio_resolution(spark, folder):
    """The whole rule: path fields and local references only where they are listed, object references, file names."""
    rows = table(spark, folder, "manifest", "row_id", "audio_path", "audio_ref", F.nullif(F.trim("filename"), F.lit("")).alias("asked"))
    paths = rows.filter("row_id % 3 != 0 and audio_path is not null").select(F.col("audio_path").alias("path"))
    local = rows.filter("row_id % 5 != 0 and audio_ref is not null and not startswith(audio_ref, 'oss://')").select(F.col("audio_ref").alias("path"))
    return _named_last(resolved_references(rows, paths.unionByName(local).distinct()), rows, paths.distinct())


@query("SELECT audio_ref, min(row_id) AS first_row FROM manifest WHERE starts_with(audio_ref, 'oss://') GROUP BY audio_ref")
def staged_dedupe(spark, folder):
    refs = table(spark, folder, "manifest", "row_id", "audio_ref").filter(F.col("audio_ref").startswith("oss://"))
    return refs.groupBy("audio_ref").agg(F.min("row_id").alias("first_row"))


@query("SELECT event_id, CASE WHEN pid IS NOT NULL AND alive THEN 'kept' WHEN pid IS NOT NULL THEN 'stale' WHEN age >= 600 THEN 'stale' ELSE 'kept' END AS lock_state FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS pid, event_id % 2 = 0 AS alive, event_id % 1200 AS age FROM events)")
def stale_locks(spark, folder):
    n = F.col("event_id")
    locks = table(spark, folder, "events", "event_id").select(n, F.when(n % 3 != 0, n).alias("pid"), (n % 2 == 0).alias("alive"), (n % 1200).alias("age"))
    return locks.select("event_id", F.when(F.col("pid").isNotNull() & F.col("alive"), "kept").when(F.col("pid").isNotNull() | (F.col("age") >= 600), "stale").otherwise("kept").alias("lock_state"))


@query(
    """SELECT suite, substr(sha1('base-tokenizer' || coalesce(string_agg(item_id || text, '' ORDER BY item_id), '')), 1, 16) AS fingerprint
      FROM (SELECT suite, CAST(item_id AS VARCHAR) AS item_id, text FROM eval_items UNION ALL SELECT 'no files', NULL, NULL) GROUP BY suite"""
)
def ordered_fingerprint(spark, folder):
    """A fingerprint over a fallback name and the names and contents of files in order of name; without files of the fallback."""
    none = spark.createDataFrame([("no files", None, None)], "suite string, item_id string, text string")
    items = table(spark, folder, "eval_items", "suite", F.col("item_id").cast("string").alias("item_id"), "text").unionByName(none)
    parts = F.array_sort(F.collect_list(F.when(F.col("item_id").isNotNull(), F.struct("item_id", "text"))))  # the held-out items: a fixed, small table
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["item_id"], F.coalesce(p["text"], F.lit("")))), "")
    return items.groupBy("suite").agg(F.substring(F.sha1(F.concat(F.lit("base-tokenizer"), joined)), 1, 16).alias("fingerprint"))
