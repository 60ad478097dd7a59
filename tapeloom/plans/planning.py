"""Queries that plan: targets, apportionment, budgets, slices and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import fields
from tapeloom.operators import budget, sampling
from tapeloom.plans.records import KEY_SQL
from tapeloom.plans.registry import query
from tapeloom.sources.tables import table

BATCH, WORLD, ACCUMULATION = 4, 2, 2
USED = "weight > 0 AND NOT isnan(weight) AND count > 0"
TARGETS_SQL = f"""SELECT dataset_key, min(weight) AS weight, CAST(sum(count) AS BIGINT) AS n,
  CAST(greatest(round_even(min(weight) * sum(count), 0), 1) AS BIGINT) AS target FROM dataset_specs WHERE {USED} GROUP BY dataset_key"""


def dataset_targets(spark, folder):
    """(dataset_key, weight, n, target): a row per used dataset, so small enough to broadcast."""
    specs = table(spark, folder, "dataset_specs").filter(USED.lower())
    return specs.groupBy("dataset_key").agg(F.min("weight").alias("weight"), F.sum("count").alias("n")).withColumn("target", F.greatest(F.bround(F.col("weight") * F.col("n")), F.lit(1.0)).cast("long"))


@query(f"SELECT coalesce({KEY_SQL}, s.dataset_key) AS dataset_key, count(*) AS n FROM manifest m LEFT JOIN dataset_specs s ON m.source_path = s.train_path GROUP BY 1")
def dataset_counts(spark, folder):
    specs = table(spark, folder, "dataset_specs").select(F.col("train_path").alias("source_path"), F.col("dataset_key").alias("file_key"))
    # pre-aggregated by file and key, so the join sees a few rows per file however large a dataset is
    per_file = table(spark, folder, "manifest", "source_path", fields.dataset_key(F.col("dataset_key")).alias("dataset_key")).groupBy("source_path", "dataset_key").count()
    return per_file.join(specs, "source_path", "left").groupBy(F.coalesce("dataset_key", "file_key").alias("dataset_key")).agg(F.sum("count").alias("n"))


@query(TARGETS_SQL)
def weighted_targets(spark, folder):
    return dataset_targets(spark, folder)


@query("SELECT CAST(least(sum(count), 25000) AS BIGINT) AS limited, CAST(sum(count) AS BIGINT) AS whole FROM train_shards WHERE count > 0")
def limited_total(spark, folder):
    return table(spark, folder, "train_shards").filter("count > 0").agg(F.least(F.sum("count"), F.lit(25000)).alias("limited"), F.sum("count").alias("whole"))


APPORTION_SQL = """{head}, s AS (SELECT sum(target) AS whole, CAST(floor(sum(target) * 0.5) AS BIGINT) AS total FROM t),
  f AS (SELECT t.dataset_key, t.target, CAST((CAST(t.target AS HUGEINT) * s.total) // s.whole AS BIGINT) AS base, CAST((CAST(t.target AS HUGEINT) * s.total) % s.whole AS BIGINT) AS rest, s.total FROM t, s),
  r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, target DESC, dataset_key) AS place, sum(base) OVER () AS given FROM f)
  SELECT dataset_key, target, CAST(base + CASE WHEN place <= total - given THEN 1 ELSE 0 END AS BIGINT) AS trimmed FROM r"""


def apportioned(targets, total, key="dataset_key"):
    """`targets` (key, target) trimmed to `total` by largest remainder; control-plane size, one window."""
    all_rows = Window.partitionBy(F.lit(0))
    shares = targets.withColumn("_whole", F.sum("target").over(all_rows)).withColumn("_total", total(F.col("_whole")))
    product = F.col("target").cast("decimal(38,0)") * F.col("_total").cast("decimal(20,0)")
    shares = shares.withColumn("_base", F.floor(product / F.col("_whole")).cast("long")).withColumn("_rest", (product - F.col("_base").cast("decimal(20,0)") * F.col("_whole").cast("decimal(20,0)")).cast("decimal(38,0)"))
    place = F.row_number().over(all_rows.orderBy(F.desc("_rest"), F.desc("target"), key))
    more = (F.col("_place") <= F.col("_total") - F.sum("_base").over(all_rows)).cast("long")
    return shares.withColumn("_place", place).withColumn("trimmed", F.col("_base") + more).drop("_whole", "_total", "_base", "_rest", "_place")


@query(APPORTION_SQL.format(head=f"WITH t AS ({TARGETS_SQL})"))
def apportion_largest_remainder(spark, folder):
    return apportioned(dataset_targets(spark, folder), lambda whole: F.floor(whole * 0.5).cast("long")).select("dataset_key", "target", "trimmed")


@query(
    f"""WITH q AS ({TARGETS_SQL}), p AS (SELECT dataset_key, target // {WORLD} AS target FROM q),
      s AS (SELECT sum(target) AS whole, CAST(sum(target) // {BATCH * ACCUMULATION} AS BIGINT) AS steps FROM p),
      f AS (SELECT p.*, s.steps, s.steps * {BATCH * ACCUMULATION} AS total, CAST((CAST(target AS HUGEINT) * steps * {BATCH * ACCUMULATION}) // whole AS BIGINT) AS base, (CAST(target AS HUGEINT) * steps * {BATCH * ACCUMULATION}) % whole AS rest FROM p, s),
      r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, target DESC, dataset_key) AS place, sum(base) OVER () AS given FROM f)
      SELECT dataset_key, steps, CAST(total AS BIGINT) AS per_rank_total, CAST(base + CASE WHEN place <= total - given THEN 1 ELSE 0 END AS BIGINT) AS per_rank FROM r"""
)
def mix_budget(spark, folder):
    rows = dataset_targets(spark, folder).orderBy("dataset_key").select("dataset_key", "target").collect()  # a row per dataset
    steps, per_rank, total = budget.mix_budget([r["target"] for r in rows], BATCH, WORLD, ACCUMULATION)
    return spark.createDataFrame([(r["dataset_key"], steps, total, n) for r, n in zip(rows, per_rank)], "dataset_key string, steps long, per_rank_total long, per_rank long")


@query(f"SELECT CAST(sum(count) // {BATCH * WORLD * ACCUMULATION} AS BIGINT) AS steps, CAST(sum(count) // {BATCH * WORLD * ACCUMULATION} * {BATCH * WORLD * ACCUMULATION} AS BIGINT) AS used FROM train_shards WHERE count > 0")
def sync_step_budget(spark, folder):
    step = BATCH * WORLD * ACCUMULATION
    steps = F.expr(f"sum(count) div {step}")
    return table(spark, folder, "train_shards").filter("count > 0").agg(steps.alias("steps"), (steps * step).alias("used"))


@query(
    """WITH t AS (SELECT CAST(sum(count) // 4 AS BIGINT) AS batches FROM train_shards WHERE count > 0)
      SELECT CAST(w AS BIGINT) AS worker, CAST((batches // 5 + CASE WHEN w < batches % 5 THEN 1 ELSE 0 END) * 4 AS BIGINT) AS target FROM t, range(5) r(w)"""
)
def worker_batch_targets(spark, folder):
    total = table(spark, folder, "train_shards").filter("count > 0").agg(F.expr("sum(count) div 4").alias("batches"))
    workers = total.withColumn("worker", F.explode(F.expr("sequence(0L, 4L)")))
    return workers.select("worker", ((F.expr("batches div 5") + (F.col("worker") < F.col("batches") % 5).cast("long")) * 4).alias("target"))


@query()
def dataset_worker_targets(spark, folder):
    rows = dataset_targets(spark, folder).orderBy("dataset_key").select("dataset_key", "target").collect()
    _, per_rank, total = budget.mix_budget([r["target"] for r in rows], BATCH, WORLD, ACCUMULATION)
    split = budget.datasets_to_workers(per_rank, budget.worker_targets(total, BATCH, 3))
    return spark.createDataFrame([(r["dataset_key"], w, n) for r, own in zip(rows, split) for w, n in enumerate(own)], "dataset_key string, worker long, target long")


SLICES_SQL = """WITH s AS (SELECT path, count, coalesce(sum(count) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM train_shards WHERE count > 0),
  t AS (SELECT CAST(sum(count) // 16 * 16 AS BIGINT) AS used FROM s),
  r AS (SELECT CAST(k AS BIGINT) AS rank, CAST(k * used // 2 AS BIGINT) AS lo, CAST((k + 1) * used // 2 AS BIGINT) AS hi FROM t, range(2) x(k))
  SELECT r.rank, s.path, CAST(greatest(s.lo, r.lo) - s.lo AS BIGINT) AS start_record, CAST(least(s.lo + s.count, r.hi) - greatest(s.lo, r.lo) AS BIGINT) AS count
  FROM s JOIN r ON greatest(s.lo, r.lo) < least(s.lo + s.count, r.hi)"""


@query(SLICES_SQL)
def rank_slices_range_join(spark, folder):
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # over the shard index: one row a file
    shards = table(spark, folder, "train_shards", "path", "count").filter("count > 0").withColumn("lo", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranks = shards.agg(F.expr("sum(count) div 16 * 16").alias("used")).withColumn("rank", F.explode(F.expr("sequence(0L, 1L)")))
    ranks = ranks.select("rank", F.expr("rank * used div 2").alias("from_row"), F.expr("(rank + 1) * used div 2").alias("to_row"))
    low, high = F.greatest("lo", "from_row"), F.least(F.col("lo") + F.col("count"), F.col("to_row"))
    return shards.join(F.broadcast(ranks), low < high).select("rank", "path", (low - F.col("lo")).alias("start_record"), (high - low).alias("count"))


@query(
    """WITH t AS (SELECT CAST(sum(count) AS BIGINT) AS n FROM train_shards WHERE count > 0)
      SELECT CAST(w AS BIGINT) AS worker, CAST(n * w // 3 AS BIGINT) AS from_row, CAST(n * (w + 1) // 3 AS BIGINT) AS to_row FROM t, range(3) r(w)"""
)
def worker_row_ranges(spark, folder):
    total = table(spark, folder, "train_shards").filter("count > 0").agg(F.sum("count").alias("n"))
    workers = total.withColumn("worker", F.explode(F.expr("sequence(0L, 2L)")))
    return workers.select("worker", F.expr("n * worker div 3").alias("from_row"), F.expr("n * (worker + 1) div 3").alias("to_row"))


@query(f"SELECT dataset_key, CAST(coalesce(sum(target) OVER (ORDER BY dataset_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS from_row, CAST(sum(target) OVER (ORDER BY dataset_key) AS BIGINT) AS to_row FROM ({TARGETS_SQL})")
def cumulative_ranges(spark, folder):
    through = F.sum("target").over(Window.orderBy("dataset_key").rowsBetween(Window.unboundedPreceding, 0))
    return dataset_targets(spark, folder).select("dataset_key", (through - F.col("target")).alias("from_row"), through.alias("to_row"))


def _lookahead_sql(extra: int, whole: int) -> str:
    """What each of 14 layers gets of 14 * whole + extra."""
    return f"""{whole} + CAST(CASE mode WHEN 'front' THEN layer < {extra} WHEN 'back' THEN layer >= {14 - extra} ELSE layer IN (SELECT round_even(k * 13 / {extra - 1}.0, 0) FROM range({extra}) r(k)) END AS BIGINT)"""


@query(
    f"""WITH l AS (SELECT CAST(i AS BIGINT) AS layer, mode FROM range(14) r(i), (VALUES ('front'), ('even'), ('back')) v(mode))
      SELECT mode, layer, {_lookahead_sql(5, 0)} AS of_5, {_lookahead_sql(4, 1)} AS of_18 FROM l"""
)
def lookahead_schedule(spark, folder):
    """A look-ahead of 5 and one of 18 over 14 layers."""
    rows = [(mode, layer, few, many) for mode in ("front", "even", "back") for layer, (few, many) in enumerate(zip(budget.lookahead(14, 5, mode), budget.lookahead(14, 18, mode)))]
    return spark.createDataFrame(rows, "mode string, layer long, of_5 long, of_18 long")


@query(
    """SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 20 THEN (s + 1) / 20.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (s - 20) / 180.0))) END, 9) AS factor FROM range(220) r(s)"""
)
def lr_schedule(spark, folder):
    s = F.col("step")
    cosine = 0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), (s - 20) / F.lit(180.0))))
    return spark.range(220).select(F.col("id").alias("step")).withColumn("factor", F.round(F.when(s < 20, (s + 1) / F.lit(20.0)).otherwise(cosine), 9))


@query("SELECT plan_name, CAST(greatest(floor(size_factor * 1001 + 0.5), 1) AS BIGINT) AS steps, CAST(ceil(size_factor) AS BIGINT) AS epochs FROM mix_plans")
def step_totals(spark, folder):
    return table(spark, folder, "mix_plans").select("plan_name", F.greatest(F.floor(F.col("size_factor") * 1001 + 0.5), F.lit(1)).alias("steps"), F.ceil("size_factor").alias("epochs"))


@query("SELECT path, CAST(count AS BIGINT) AS count FROM train_shards WHERE count > 0 AND path IS NOT NULL")
def shard_list(spark, folder):
    return table(spark, folder, "train_shards", "path", "count").filter("count > 0 and path is not null")


@query("SELECT path, row_number() OVER (ORDER BY substr(sha1('42|' || '3|' || path), 1, 16), path) AS place FROM train_shards")
def shard_shuffle(spark, folder):
    """Shards in a seeded order that changes with the epoch; a row per file."""
    key = sampling.order_key(42, F.lit(3), F.col("path"))
    return table(spark, folder, "train_shards", "path").withColumn("place", F.row_number().over(Window.orderBy(key, "path")).cast("long"))


@query(
    f"""WITH q AS ({TARGETS_SQL}), s AS (SELECT count(*) AS files FROM train_shards)
      SELECT 'mix' AS index_format, CAST(sum(target // {WORLD}) // {BATCH * ACCUMULATION} AS BIGINT) AS steps FROM q
      UNION ALL SELECT 'shards', CAST(sum(count) // {BATCH * WORLD * ACCUMULATION} AS BIGINT) FROM train_shards WHERE count > 0"""
)
def step_estimate(spark, folder):
    mix = dataset_targets(spark, folder).agg(F.expr(f"sum(target div {WORLD}) div {BATCH * ACCUMULATION}").alias("steps")).select(F.lit("mix").alias("index_format"), "steps")
    return mix.unionByName(sync_step_budget(spark, folder).select(F.lit("shards").alias("index_format"), "steps"))
