"""Queries on batches: metrics, padding and array rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import tokens
from tapeloom.operators import collate, metrics
from tapeloom.plans.mixing import CHUNKS_SQL, micro_batches
from tapeloom.plans.registry import query
from tapeloom.sources.tables import table

PAD, EOS, AUDIO = 0, 2, 7
MICRO_SQL = f"""{CHUNKS_SQL}, d AS (SELECT rank, group_no, micro_batch, dataset_key, count(*) AS n, sum(length) AS real, max(length) AS longest, max(seconds) AS max_seconds FROM m GROUP BY ALL),
  mb AS (SELECT rank, group_no, micro_batch, count(*) AS datasets, max(n) / sum(n) AS dominant_ratio, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(real) AS BIGINT) AS real_frames, CAST(max(longest) * sum(n) AS BIGINT) AS padded_frames, max(max_seconds) AS max_seconds FROM d GROUP BY ALL)"""
STEP_SQL = f"""{MICRO_SQL}, sx AS (SELECT rank, group_no, micro_batch // 2 AS step, dataset_key, count(*) AS n FROM m GROUP BY ALL),
  sd AS (SELECT rank, group_no, step, count(*) AS datasets, max(n) AS most FROM sx GROUP BY ALL),
  sm AS (SELECT rank, group_no, micro_batch // 2 AS step, count(*) AS micro_batches, sum(samples) AS samples, sum(real_frames) AS real_frames, sum(padded_frames) AS padded_frames, max(max_seconds) AS max_seconds FROM mb GROUP BY ALL),
  st AS (SELECT rank, group_no * 8 + step AS step, datasets, most / samples AS dominant_ratio, micro_batches, CAST(samples AS BIGINT) AS samples, CAST(padded_frames AS BIGINT) AS cost,
    coalesce(1 - real_frames / CAST(nullif(padded_frames, 0) AS DOUBLE), 0.0) AS padding_ratio, max_seconds FROM sm JOIN sd USING (rank, group_no, step))"""


def _rows(spark, folder):
    return micro_batches(spark, folder).withColumn("is_replacement", F.lit(False)).withColumn("step", F.expr("group_no * 8 + micro_batch div 2"))


@query(f"{MICRO_SQL} SELECT rank, group_no, micro_batch, datasets, dominant_ratio, samples, padded_frames AS cost, coalesce(1 - real_frames / CAST(nullif(padded_frames, 0) AS DOUBLE), 0.0) AS padding_ratio, max_seconds, CAST(0 AS BIGINT) AS replacements FROM mb")
def microbatch_metrics(spark, folder):
    out = metrics.micro_batch_metrics(_rows(spark, folder), ["rank", "group_no", "micro_batch"])
    return out.drop("real_frames", "padded_frames")


@query(f"{STEP_SQL} SELECT rank, CAST(step AS BIGINT) AS step, datasets, dominant_ratio, micro_batches, samples, cost, padding_ratio, max_seconds FROM st")
def step_metrics(spark, folder):
    out = metrics.step_metrics(_rows(spark, folder), ["rank", "group_no", "micro_batch"], ["rank", "step"])
    return out.select("rank", "step", "datasets", "dominant_ratio", "micro_batches", "samples", "cost", "padding_ratio", "max_seconds")


@query(
    f"""{STEP_SQL}, mi AS (SELECT (group_no * 8 + micro_batch // 2) // 20 AS interval_no, count(*) AS n, sum(datasets) AS datasets, sum(dominant_ratio) AS dominant,
        sum(CASE WHEN padded_frames > 0 THEN 1 - real_frames / CAST(padded_frames AS DOUBLE) ELSE 0 END) AS padding, sum(max_seconds) AS seconds FROM mb GROUP BY 1),
      r AS (SELECT step // 20 AS interval_no, rank, count(*) AS n, sum(datasets) AS datasets, sum(dominant_ratio) AS dominant, sum(padding_ratio) AS padding, sum(cost) AS cost, max(cost) AS top, sum(max_seconds) AS seconds FROM st GROUP BY ALL)
      SELECT CAST(interval_no AS BIGINT) AS interval_no, round(any_value(mi.datasets) / any_value(mi.n), 9) AS microbatch_unique_dataset_mean, round(any_value(mi.dominant) / any_value(mi.n), 9) AS microbatch_dominant_ratio_mean,
        round(any_value(mi.padding) / any_value(mi.n), 9) AS microbatch_padding_ratio_mean, round(any_value(mi.seconds) / any_value(mi.n), 9) AS microbatch_max_duration_mean, round(sum(r.datasets) / sum(r.n), 9) AS global_step_unique_dataset_mean,
        round(sum(r.dominant) / sum(r.n), 9) AS global_step_dominant_ratio_mean, round(sum(r.padding) / sum(r.n), 9) AS global_step_padding_ratio_mean, round(sum(r.cost) / sum(r.n), 9) AS global_step_cost_mean, CAST(max(r.top) AS DOUBLE) AS global_step_cost_max,
        round(sum(r.seconds) / sum(r.n), 9) AS global_step_max_duration_mean, CAST(0 AS DOUBLE) AS replacement_rate, round(avg(r.cost / r.n), 6) AS rank_cost_mean, round(stddev_pop(r.cost / r.n), 6) AS rank_cost_std, CAST(max(r.top) AS DOUBLE) AS rank_cost_max,
        CAST(sum(r.n) AS BIGINT) AS interval_steps FROM r JOIN mi USING (interval_no) GROUP BY 1"""
)
def interval_metrics(spark, folder):
    steps = metrics.step_metrics(_rows(spark, folder), ["rank", "group_no", "micro_batch"], ["rank", "step"])
    return metrics.interval_metrics(steps, "rank", "step", 20)


@query("SELECT step, n FROM (SELECT CAST(row_id // 16 AS BIGINT) AS step, count(*) AS n FROM manifest GROUP BY 1) WHERE step % 25 = 0")
def log_every_n(spark, folder):
    return table(spark, folder, "manifest", "row_id").groupBy(F.expr("row_id div 16").alias("step")).agg(F.count("*").alias("n")).filter("step % 25 = 0")


# Published error rates by benchmark for three models.
BENCHMARKS = """
AISHELL-1 3.33 3.52 3.39
Fleurs-zh 2.80 3.49 3.32
Fleurs-en 4.17 5.24 5.10
LibriSpeech-clean 2.48 3.09 2.45
THCHS-30 3.87 4.23 4.17
Tedlium 3.35 4.07 3.95
LibriSpeech-other 5.39 7.00 5.52
CommonVoice-zh 9.95 9.54 8.36
CommonVoice-en 12.35 13.94 12.49
WenetSpeech-meeting 8.36 10.71 8.78
"""
_RATES = [(n, float(a), float(b), float(c)) for n, a, b, c in (line.split() for line in BENCHMARKS.strip().splitlines())]
_RATES_SQL = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in _RATES)


@query(f"SELECT round(avg(a), 4) AS baseline, round(avg(b), 4) AS stage1, round(avg(c), 4) AS stage2, round(100 * (avg(b) / avg(a) - 1), 4) AS stage1_change, round(100 * (avg(c) / avg(a) - 1), 4) AS stage2_change FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM (VALUES {_RATES_SQL}) v(n, a, b, c))")
def macro_mean(spark, folder):
    rates = spark.createDataFrame(_RATES, "n string, a double, b double, c double")
    a, b, c = F.avg("a"), F.avg("b"), F.avg("c")
    return rates.agg(F.round(a, 4).alias("baseline"), F.round(b, 4).alias("stage1"), F.round(c, 4).alias("stage2"), F.round(100 * (b / a - 1), 4).alias("stage1_change"), F.round(100 * (c / a - 1), 4).alias("stage2_change"))


ARRAYS_SQL = """WITH a AS (SELECT row_id, row_id // 64 AS batch, token_ids, list_append(token_ids, CAST(2 AS BIGINT)) AS labels FROM manifest WHERE token_ids IS NOT NULL),
  w AS (SELECT *, max(len(labels)) OVER (PARTITION BY batch) AS width FROM a)"""


def _arrays(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "token_ids").filter("token_ids is not null")
    return rows.withColumn("batch", F.expr("row_id div 64")).withColumn("labels", F.concat("token_ids", F.array(F.lit(EOS).cast("long"))))


@query(
    f"""{ARRAYS_SQL} SELECT row_id, token_ids || list_transform(range(width - len(token_ids)), lambda i: CAST(0 AS BIGINT)) AS input_ids,
      list_transform(range(width), lambda i: CAST(CASE WHEN i < len(token_ids) THEN 1 ELSE 0 END AS BIGINT)) AS attention_mask,
      labels || list_transform(range(width - len(labels)), lambda i: CAST(-100 AS BIGINT)) AS label_ids FROM w"""
)
def collate_pad(spark, folder):
    return collate.collated(_arrays(spark, folder), "batch", "token_ids", "labels", PAD).select("row_id", "input_ids", "attention_mask", "label_ids")


@query(
    f"""{ARRAYS_SQL}, f AS (SELECT row_id, list_transform(token_ids, lambda x: x / 2) AS low, list_transform(list_reverse(token_ids), lambda x: CAST(x AS DOUBLE)) AS high, len(token_ids) AS n, max(len(token_ids)) OVER (PARTITION BY batch) AS most FROM w)
      SELECT row_id, CAST(n AS BIGINT) AS feature_length, [low || list_transform(range(most - n), lambda i: 0.0::DOUBLE), high || list_transform(range(most - n), lambda i: 0.0::DOUBLE)] AS input_features,
      list_transform(range(most), lambda i: CAST(CASE WHEN i < n THEN 1 ELSE 0 END AS BIGINT)) AS feature_attention_mask FROM f"""
)
def feature_pad(spark, folder):
    """Feature matrices of two rows, padded to the most frames of their batch."""
    halves, mirrored = F.transform("token_ids", lambda x: x / F.lit(2.0)), F.transform(F.reverse("token_ids"), lambda x: x.cast("double"))
    rows = _arrays(spark, folder).withColumn("features", F.array(halves, mirrored))
    return collate.collated_features(rows, "batch", "features").select("row_id", "feature_length", "input_features", "feature_attention_mask")


@query(f"{ARRAYS_SQL} SELECT batch, CAST(max(len(token_ids)) AS BIGINT) AS longest_ids, CAST(max(width) AS BIGINT) AS longest_labels FROM w GROUP BY batch")
def collate_maxima(spark, folder):
    return _arrays(spark, folder).groupBy("batch").agg(F.max(F.size("token_ids")).cast("long").alias("longest_ids"), F.max(F.size("labels")).cast("long").alias("longest_labels"))


@query(
    f"""{ARRAYS_SQL} SELECT row_id, list_transform(range(width - len(labels)), lambda i: CAST(0 AS BIGINT)) || labels AS left_padded,
      list_transform(range(width), lambda i: CAST(CASE WHEN i >= width - len(labels) THEN 1 ELSE 0 END AS BIGINT)) AS left_mask FROM w"""
)
def left_pad(spark, folder):
    rows = _arrays(spark, folder).withColumn("width", F.max(F.size("labels")).over(Window.partitionBy("batch")))
    return rows.select("row_id", collate.padded(F.col("labels"), F.col("width"), PAD, left=True).alias("left_padded"), collate.padded(collate.ones(F.size("labels")), F.col("width"), 0, left=True).alias("left_mask"))


@query(
    """WITH a AS (SELECT row_id, row_id // 64 AS batch, list_filter(token_ids, lambda x: x % 3 <> 0) AS kept FROM manifest WHERE token_ids IS NOT NULL AND len(list_filter(token_ids, lambda x: x % 3 <> 0)) > 0),
      w AS (SELECT *, max(len(kept)) OVER (PARTITION BY batch) AS width FROM a)
      SELECT row_id, list_transform(range(width - len(kept)), lambda i: CAST(0 AS BIGINT)) || kept AS repacked FROM w"""
)
def left_repack(spark, folder):
    mask = F.transform("token_ids", lambda x: (x % 3 != 0).cast("long"))
    rows = _arrays(spark, folder).withColumn("kept", collate.kept(F.col("token_ids"), mask)).filter(F.size("kept") > 0)
    rows = rows.withColumn("width", F.max(F.size("kept")).over(Window.partitionBy("batch")))
    return rows.select("row_id", collate.padded(F.col("kept"), F.col("width"), PAD, left=True).alias("repacked"))


def packed(rows, group, order, values, length):
    """(group, packed): each row's first `length` values, joined in order; an unknown length takes them all. A group is bounded."""
    each = F.struct(order, F.slice(values, F.lit(1), F.coalesce(F.col(length), F.size(values)).cast("int")).alias("part"))
    packs = rows.filter(F.col(values).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(each)).alias("parts"))
    return packs.select(group, F.flatten(F.transform("parts", lambda p: p["part"])).alias("packed"))


@query("SELECT row_id // 64 AS batch, flatten(list(token_ids ORDER BY row_id)) AS packed FROM manifest WHERE token_ids IS NOT NULL GROUP BY 1")
def ragged_pack_whole(spark, folder):
    """Padded arrays of a batch, each cut to its own valid length and joined."""
    padded = collate.collated(_arrays(spark, folder), "batch", "token_ids", "labels", PAD)
    lengths = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return packed(padded.withColumn("valid", lengths), "batch", "row_id", "input_ids", "valid")


@query("SELECT row_id, CAST(nullif(octet_length(encode(text)), 0) AS BIGINT) AS n_tokens, nullif(text, '') AS decoded FROM manifest")
def token_roundtrip(spark, folder):
    """Texts as tokens of the default tokenizer, and back."""
    default = tokens.ByteTokenizer()
    rows = table(spark, folder, "manifest", "row_id", "text").withColumn("ids", tokens.encoded(F.col("text"), default))
    return rows.select("row_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), tokens.decoded(F.col("ids"), default).alias("decoded"))


@query("SELECT row_id, CAST(len(list_filter(token_ids, lambda x: x % 3 <> 0)) AS BIGINT) AS valid_length, list_transform(range(len(token_ids)), lambda i: CAST(1 AS BIGINT)) AS all_ones FROM manifest WHERE token_ids IS NOT NULL")
def mask_lengths(spark, folder):
    mask = F.transform("token_ids", lambda x: (x % 3 != 0).cast("long"))
    total = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    return _arrays(spark, folder).select("row_id", total.alias("valid_length"), collate.ones(F.size("token_ids")).alias("all_ones"))


@query(
    """SELECT row_id, list_transform(list_filter(list_zip(u, range(1, len(u) + 1)), lambda p: list_position(u, p[1]) = p[2]), lambda p: p[1]) AS unique_ids
      FROM (SELECT row_id, list_filter(list_transform(token_ids, lambda x: x % 20 - 2), lambda x: x >= 0) AS u FROM manifest WHERE token_ids IS NOT NULL)"""
)
def unique_token_ids(spark, folder):
    shifted = F.transform("token_ids", lambda x: x % 20 - 2)
    return _arrays(spark, folder).select("row_id", collate.unique_ids(shifted).alias("unique_ids"))


@query(
    """WITH b AS (SELECT row_id, coalesce(len(list_filter(list_transform(token_ids, lambda x: x % 20 - 2), lambda x: x >= 0)), 0) AS n, list_filter(list_transform(token_ids, lambda x: x % 20 - 2), lambda x: x >= 0) AS u FROM manifest)
      SELECT row_id, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN CAST(u[1] AS VARCHAR) ELSE '[' || array_to_string(u, ', ') || ']' END AS eos FROM b"""
)
def eos_form(spark, folder):
    ids = F.filter(F.transform("token_ids", lambda x: x % 20 - 2), lambda x: x >= 0)
    text = F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ", "), F.lit("]"))
    return table(spark, folder, "manifest", "row_id", "token_ids").select("row_id", F.when(F.size(ids) == 1, ids[0].cast("string")).when(F.size(ids) > 1, text).alias("eos"))


@query("SELECT row_id, coalesce(bool_and(x >= 0 AND x < 40000), true) AS in_range FROM (SELECT row_id, unnest(token_ids) AS x FROM manifest WHERE token_ids IS NOT NULL) GROUP BY row_id")
def token_range_check(spark, folder):
    return _arrays(spark, folder).filter(F.size("token_ids") > 0).select("row_id", F.forall("token_ids", lambda x: (x >= 0) & (x < 40000)).alias("in_range"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64, 5) AS mean, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings")
def feature_stats(spark, folder):
    values = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.round(total(values) / 64, 5).alias("mean"), F.round(F.sqrt(total(F.transform(values, lambda x: x * x))), 5).alias("norm"))


@query("SELECT label, CAST(i AS BIGINT) AS position, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS channel_mean FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def channel_mean(spark, folder):
    rows = table(spark, folder, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.groupBy("label", (F.col("p") + 1).cast("long").alias("position")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("channel_mean"))


_WEIGHT = [[(i * 7 + j * 3) % 5 - 2 for j in range(64)] for i in range(4)]
_DOWN = [[(j * 5 + r) % 3 - 1 for r in range(2)] for j in range(64)]
_UP = [[(r * 2 + i) % 4 - 1 for i in range(4)] for r in range(2)]


@query(
    """SELECT vec_id, CAST(i AS BIGINT) AS output, round(list_sum(list_transform(range(64), lambda j: CAST(embedding[j + 1] AS DOUBLE) *
      ((i * 7 + j * 3) % 5 - 2 + 0.5 * (((j * 5) % 3 - 1) * (i % 4 - 1) + ((j * 5 + 1) % 3 - 1) * ((2 + i) % 4 - 1))))), 4) AS projected FROM embeddings, range(4) r(i)"""
)
def low_rank_projection(spark, folder):
    out = collate.low_rank_projection(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _WEIGHT, _DOWN, _UP, 0.5)
    return out.select("vec_id", F.posexplode("projected").alias("p", "x")).select("vec_id", F.col("p").cast("long").alias("output"), F.round("x", 4).alias("projected"))
