"""Queries on regions, chunks and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators import masks
from tapeloom.plans.registry import query
from tapeloom.sources.tables import table

WINDOW, BLOCK, LEFT, AHEAD = 40, 4, 6, 3
#: Frames of a sample, from its duration in eighths of a second, and the batch it stands in.
SAMPLES_SQL = "SELECT row_id, row_id // 100 AS batch, len(text) AS frames FROM manifest WHERE text IS NOT NULL AND len(text) > 0"
REGIONS_SQL = f"""WITH s AS ({SAMPLES_SQL}), r AS (SELECT row_id, batch, CAST(k AS BIGINT) AS region_no, CAST(least({WINDOW}, frames - k * {WINDOW}) AS BIGINT) AS size FROM s, LATERAL (SELECT unnest(range((frames - 1) // {WINDOW} + 1)) AS k) x)"""


def _samples(spark, folder):
    return table(spark, folder, "manifest", "row_id", F.expr("row_id div 100").alias("batch"), F.length("text").cast("long").alias("frames")).filter("frames > 0")


def _regions(spark, folder):
    samples = _samples(spark, folder)
    return masks.regions(samples, "row_id", "frames", WINDOW).withColumn("batch", F.expr("row_id div 100"))


@query(f"{REGIONS_SQL} SELECT row_id, region_no, size, CAST(sum(size) OVER (PARTITION BY batch ORDER BY row_id, region_no) - size AS BIGINT) AS from_frame, CAST(sum(size) OVER (PARTITION BY batch ORDER BY row_id, region_no) AS BIGINT) AS to_frame FROM r")
def region_bounds(spark, folder):
    return masks.bounds(_regions(spark, folder), "batch", ["row_id", "region_no"], "size").select("row_id", "region_no", "size", "from_frame", "to_frame")


@query(
    f"""WITH s AS (SELECT batch, sum(frames // 8) AS total FROM ({SAMPLES_SQL}) GROUP BY batch)
      SELECT batch, CAST(k AS BIGINT) AS region_no, CAST(k * 13 AS BIGINT) AS from_frame, CAST(least((k + 1) * 13, total) AS BIGINT) AS to_frame FROM s, LATERAL (SELECT unnest(range(CAST((total + 12) // 13 AS BIGINT))) AS k) x"""
)
def aligned_bounds(spark, folder):
    total = _samples(spark, folder).groupBy("batch").agg(F.sum(F.expr("frames div 8")).alias("total"))
    out = masks.regions(total, "batch", "total", 13)
    return out.select("batch", "region_no", (F.col("region_no") * 13).alias("from_frame"), (F.col("region_no") * 13 + F.col("size")).alias("to_frame"))


@query(f"{REGIONS_SQL} SELECT row_id, count(*) AS chunks, CAST(max(CASE WHEN last THEN size END) AS BIGINT) AS tail FROM (SELECT *, region_no = max(region_no) OVER (PARTITION BY row_id) AS last FROM r) GROUP BY row_id")
def feature_chunks(spark, folder):
    return _regions(spark, folder).groupBy("row_id").agg(F.count("*").alias("chunks"), F.max_by("size", "region_no").alias("tail"))


def _frames(spark, folder):
    """One row per frame: texts stand in for frame sequences, so every sample is used with all its frames."""
    each = _samples(spark, folder).select("row_id", F.explode(F.expr("sequence(0L, frames - 1)")).alias("f"))
    return each.select("row_id", F.expr(f"f div {WINDOW}").alias("region_no"), (F.col("f") % WINDOW).alias("i"))


FRAMES_SQL = f"""WITH s AS ({SAMPLES_SQL}), f AS (SELECT row_id, CAST(i // {WINDOW} AS BIGINT) AS region_no, CAST(i % {WINDOW} AS BIGINT) AS i FROM s, LATERAL (SELECT unnest(range(frames)) AS i) x)"""


@query(f"{FRAMES_SQL}, v AS (SELECT row_id, region_no, i, count(*) OVER (PARTITION BY row_id, region_no) AS n FROM f) SELECT row_id, region_no, CAST(sum(least((i // {BLOCK}) * {BLOCK} + {BLOCK}, n) - greatest(0, i - {LEFT} + 1)) AS BIGINT) AS pairs FROM v GROUP BY ALL")
def block_visibility(spark, folder):
    """Visible pairs by region with a left limit, from the interval each frame sees; no pair is built."""
    sized = _frames(spark, folder).withColumn("n", F.count("*").over(Window.partitionBy("row_id", "region_no")))
    low, high = masks.block_interval(F.col("i"), F.col("n"), BLOCK, LEFT)
    return sized.groupBy("row_id", "region_no").agg(F.sum(high - low + 1).alias("pairs"))


@query(f"{FRAMES_SQL} SELECT row_id, region_no, CAST(sum(seen) AS BIGINT) AS pairs, CAST(max(seen) AS BIGINT) AS most FROM (SELECT row_id, region_no, count(*) OVER (PARTITION BY row_id, region_no ORDER BY i // {BLOCK} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM f) GROUP BY ALL")
def block_frame(spark, folder):
    seen = F.count("*").over(masks.block_frame(["row_id", "region_no"], "i", BLOCK))
    return _frames(spark, folder).withColumn("seen", seen).groupBy("row_id", "region_no").agg(F.sum("seen").alias("pairs"), F.max("seen").alias("most"))


@query(f"{FRAMES_SQL} SELECT row_id, region_no, CAST(sum(seen) AS BIGINT) AS pairs, CAST(sum(whole) AS BIGINT) AS full_pairs FROM (SELECT row_id, region_no, count(*) OVER (PARTITION BY row_id, region_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {AHEAD} FOLLOWING) AS seen, count(*) OVER (PARTITION BY row_id, region_no) AS whole FROM f) GROUP BY ALL")
def limited_causal_frame(spark, folder):
    near = F.count("*").over(masks.lookahead_frame(["row_id", "region_no"], "i", AHEAD))
    whole = F.count("*").over(masks.lookahead_frame(["row_id", "region_no"], "i", None))
    return _frames(spark, folder).select("row_id", "region_no", near.alias("seen"), whole.alias("whole")).groupBy("row_id", "region_no").agg(F.sum("seen").alias("pairs"), F.sum("whole").alias("full_pairs"))


@query(f"{FRAMES_SQL} SELECT row_id, CAST(max(native) AS BIGINT) AS native_span, CAST(max(whole) AS BIGINT) AS global_span FROM (SELECT row_id, count(*) OVER (PARTITION BY row_id, region_no) AS native, count(*) OVER (PARTITION BY row_id) AS whole FROM f) GROUP BY row_id")
def region_modes(spark, folder):
    by_region = _frames(spark, folder).groupBy("row_id", "region_no").count()
    return by_region.groupBy("row_id").agg(F.max("count").alias("native_span"), F.sum("count").alias("global_span"))


@query(
    """WITH t AS (SELECT row_id, unnest(token_ids) AS token, generate_subscripts(token_ids, 1) AS spot FROM manifest WHERE token_ids IS NOT NULL),
      k AS (SELECT row_id, spot, row_number() OVER (PARTITION BY row_id ORDER BY spot) AS k FROM t WHERE token % 3 = 0)
      SELECT k.row_id, CAST(k.spot - 1 AS BIGINT) AS position, CAST(f.x AS BIGINT) AS feature FROM k JOIN (SELECT row_id, unnest(list_reverse(token_ids)) AS x, generate_subscripts(token_ids, 1) AS k FROM manifest WHERE token_ids IS NOT NULL) f ON f.row_id = k.row_id AND f.k = k.k"""
)
def placeholder_scatter(spark, folder):
    rows = table(spark, folder, "manifest", "row_id", "token_ids").filter("token_ids is not null")
    places = F.filter(F.transform("token_ids", lambda token, i: F.when(token % 3 == 0, i.cast("long"))), lambda i: i.isNotNull())
    pairs = F.arrays_zip(F.col("places").alias("position"), F.slice(F.reverse("token_ids"), F.lit(1), F.size("places")).alias("feature"))
    return rows.withColumn("places", places).select("row_id", F.inline(pairs).alias("position", "feature"))
