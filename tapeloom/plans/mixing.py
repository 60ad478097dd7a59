"""Queries that sample, order, group and batch planned rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import fields
from tapeloom.operators import batching, budget, sampling
from tapeloom.operators.skew import ranked_within
from tapeloom.plans.planning import TARGETS_SQL, dataset_targets
from tapeloom.plans.records import KEY_SQL, SECONDS_SQL, seconds
from tapeloom.plans.registry import query
from tapeloom.sources.tables import table

SEED, WORLD, BATCH, ACCUMULATION, BUCKETS = 42, 2, 4, 2, 16
EDGES = (3, 7, 10, 13, 17, 20, 23, 27)
ROWS_SQL = f"""SELECT m.row_id, coalesce({KEY_SQL}, s.dataset_key) AS dataset_key, {SECONDS_SQL} AS seconds,
  CAST(trunc(coalesce({SECONDS_SQL}, 0)) AS BIGINT) AS length FROM manifest m LEFT JOIN dataset_specs s ON m.source_path = s.train_path"""
HASH_SQL = "substr(sha1('42|' || {0}), 1, 16)"
PERM_SQL = f"""WITH k AS ({ROWS_SQL}), q AS ({TARGETS_SQL}), c AS (SELECT dataset_key, count(*) AS n FROM k GROUP BY 1),
  t AS (SELECT q.dataset_key, c.n, q.target FROM q JOIN c USING (dataset_key)),
  e AS (SELECT k.*, t.n, t.target, p.pass_no FROM k JOIN t USING (dataset_key), LATERAL (SELECT unnest(range((t.target + t.n - 1) // t.n)) AS pass_no) p),
  o AS (SELECT *, pass_no * n + row_number() OVER (PARTITION BY dataset_key, pass_no ORDER BY {HASH_SQL.format("pass_no || '|' || dataset_key || '|' || row_id")}, row_id) - 1 AS position FROM e),
  p AS (SELECT dataset_key, row_id, length, seconds, pass_no, position, target, position // (target // {WORLD}) AS rank FROM o WHERE position < target)"""
STREAM_SQL = f"""{PERM_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY {HASH_SQL.format("rank || '|' || dataset_key || '|' || position")}, dataset_key || '#' || position) - 1 AS place FROM p WHERE rank < {WORLD} AND target >= {WORLD}),
  g AS (SELECT *, place // {BATCH * BUCKETS} AS group_no, CAST(len(list_filter({list(EDGES)}, lambda e: e < length)) AS BIGINT) AS length_bin FROM s)"""


def keyed_rows(spark, folder):
    """(row_id, dataset_key, seconds, length): manifest rows with their dataset."""
    specs = table(spark, folder, "dataset_specs").select(F.col("train_path").alias("source_path"), F.col("dataset_key").alias("file_key"))
    rows = table(spark, folder, "manifest", "row_id", "source_path", fields.dataset_key(F.col("dataset_key")).alias("own_key"), seconds().alias("seconds"))
    keyed = rows.join(specs, "source_path", "left").select("row_id", F.coalesce("own_key", "file_key").alias("dataset_key"), "seconds")
    return keyed.withColumn("length", F.coalesce("seconds", F.lit(0.0)).cast("long"))


def _targets(spark, folder, rows):
    """(dataset_key, n, target) as local rows, one per dataset, so that no branch of a plan counts again."""
    there = rows.groupBy("dataset_key").agg(F.count("*").alias("n"))
    found = dataset_targets(spark, folder).select("dataset_key", "target").join(there, "dataset_key").select("dataset_key", "n", "target").collect()
    return [tuple(r) for r in found]


def _whole_steps(local):
    """The targets trimmed so that every rank makes whole steps; at most BATCH * ACCUMULATION - 1 rows a rank go."""
    local = sorted(local)
    _, per_rank, _ = budget.mix_budget([t for _, _, t in local], BATCH, WORLD, ACCUMULATION)
    return [(k, n, each * WORLD) for (k, n, _), each in zip(local, per_rank)]


def _permuted(spark, folder, whole_steps=False):
    rows = keyed_rows(spark, folder)
    local = _targets(spark, folder, rows)
    if whole_steps:
        local = _whole_steps(local)
    targets = spark.createDataFrame(local, "dataset_key string, n long, target long")
    perm = sampling.oversampled(rows, "dataset_key", "row_id", targets, SEED, ("length", "seconds"), max((n for _, n, _ in local), default=0))
    return perm.join(F.broadcast(targets.select("dataset_key", "target")), "dataset_key"), local


def _ranked(spark, folder, whole_steps=False):
    perm, local = _permuted(spark, folder, whole_steps)
    return perm.filter(f"target >= {WORLD}").withColumn("rank", F.expr(f"position div (target div {WORLD})")).filter(f"rank < {WORLD}"), local


def _stream(spark, folder, whole_steps=False):
    ranked, local = _ranked(spark, folder, whole_steps)
    rows = ranked.withColumn("_tie", F.concat("dataset_key", F.lit("#"), F.col("position").cast("string")))
    order = sampling.signed(sampling.order_key(SEED, F.col("rank"), F.col("dataset_key"), F.col("position")))
    placed = ranked_within(rows, ["rank"], order, "_tie", "place", most=sum(t // WORLD for _, _, t in local), costly=True).drop("_tie")
    return placed.withColumn("group_no", F.expr(f"cast(place as bigint) div {BATCH * BUCKETS}")).withColumn("length_bin", fields.length_bin(F.col("length"), EDGES))


@query("""SELECT dataset_key, CAST(CAST(CAST('0x' || substr(sha1('''dataset-mix''' || chr(0) || '42' || chr(0) || '0' || chr(0) || '''' || dataset_key || '''' || chr(0)), 1, 16) AS UBIGINT) AS HUGEINT) % 9223372036854775807 AS BIGINT) AS seed FROM (SELECT DISTINCT dataset_key FROM dataset_specs)""")
def stable_seed(spark, folder):
    keys = table(spark, folder, "dataset_specs", "dataset_key").distinct()
    return keys.select("dataset_key", sampling.seed_column(F.lit("'dataset-mix'"), F.lit(42), F.lit(0), sampling.quoted(F.col("dataset_key"))).alias("seed"))


@query(f"{PERM_SQL} SELECT dataset_key, row_id, CAST(pass_no AS BIGINT) AS pass_no, CAST(position AS BIGINT) AS position FROM p")
def oversample_hash(spark, folder):
    return _permuted(spark, folder)[0].select("dataset_key", "row_id", F.col("pass_no").cast("long").alias("pass_no"), "position")


@query(f"{PERM_SQL} SELECT CAST(rank AS BIGINT) AS rank, dataset_key, count(*) AS n, CAST(min(position) AS BIGINT) AS first_position FROM p WHERE rank < {WORLD} AND target >= {WORLD} GROUP BY ALL")
def rank_assign(spark, folder):
    return _ranked(spark, folder)[0].groupBy("rank", "dataset_key").agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


@query(f"{STREAM_SQL} SELECT CAST(rank AS BIGINT) AS rank, dataset_key, CAST(position AS BIGINT) AS position, CAST(place AS BIGINT) AS place FROM g")
def interleave_hash(spark, folder):
    return _stream(spark, folder).select("rank", "dataset_key", "position", F.col("place").cast("long").alias("place"))


@query(f"{STREAM_SQL} SELECT CAST(rank AS BIGINT) AS rank, CAST(group_no AS BIGINT) AS group_no, count(*) AS n, count(DISTINCT dataset_key) AS n_datasets, printf('rank%04d_worker%04d_shard%06d_group%06d', rank, 0, 0, group_no) AS group_id FROM g GROUP BY rank, group_no")
def group_assign(spark, folder):
    groups = _stream(spark, folder).groupBy("rank", "group_no").agg(F.count("*").alias("n"), F.countDistinct("dataset_key").alias("n_datasets"))
    return groups.withColumn("group_id", F.format_string("rank%04d_worker%04d_shard%06d_group%06d", "rank", F.lit(0), F.lit(0), "group_no"))


@query(f"{STREAM_SQL} SELECT CAST(rank AS BIGINT) AS rank, CAST(group_no AS BIGINT) AS group_no, CAST(place AS BIGINT) AS place, row_number() OVER (PARTITION BY rank, group_no ORDER BY coalesce(seconds, 0), place) AS in_group FROM g")
def sorted_group_order(spark, folder):
    order = Window.partitionBy("rank", "group_no").orderBy(F.coalesce("seconds", F.lit(0.0)), "place")
    return _stream(spark, folder).select("rank", "group_no", F.col("place").cast("long").alias("place"), F.row_number().over(order).cast("long").alias("in_group"))


CHUNKS_SQL = f"""{STREAM_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY rank, group_no ORDER BY length_bin, length, dataset_key, row_id, position) - 1 AS spot FROM g),
  m AS (SELECT CAST(rank AS BIGINT) AS rank, CAST(group_no AS BIGINT) AS group_no, CAST(spot // {BATCH} AS BIGINT) AS micro_batch, dataset_key, length, coalesce(seconds, 0) AS seconds FROM b)"""


def micro_batches(spark, folder):
    """(rank, group_no, micro_batch, slot, dataset_key, row_id, length, seconds) by the chunked plan."""
    return batching.chunked(_stream(spark, folder), ["rank", "group_no"], BATCH)


@query(f"{CHUNKS_SQL} SELECT rank, group_no, micro_batch, count(*) AS n, max(length) AS longest, CAST(sum(length) AS BIGINT) AS total_length FROM m GROUP BY ALL")
def chunked_batches_simple(spark, folder):
    return micro_batches(spark, folder).groupBy("rank", "group_no", "micro_batch").agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.sum("length").alias("total_length"))


def composed_batches(spark, folder):
    # a stated number keeps costly groups on all cores; ranks of whole steps give groups of whole batches
    spread = _stream(spark, folder, whole_steps=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rank", "group_no").withColumn("worker", F.lit(0).cast("long"))
    return batching.composed(spread, ["rank", "worker", "group_no"], BATCH, ACCUMULATION, len(EDGES) + 1, SEED)


@query()
def compose_microbatches(spark, folder):
    return composed_batches(spark, folder)


@query(
    f"""WITH k AS ({ROWS_SQL}), q AS ({TARGETS_SQL}), d AS (SELECT q.dataset_key, q.target // {WORLD} AS target FROM q WHERE q.dataset_key IN (SELECT dataset_key FROM k)),
      s AS (SELECT sum(target) AS whole, CAST(sum(target) // {BATCH * ACCUMULATION} AS BIGINT) * {BATCH * ACCUMULATION} AS total FROM d),
      f AS (SELECT d.*, s.total, CAST((CAST(target AS HUGEINT) * total) // whole AS BIGINT) AS base, (CAST(target AS HUGEINT) * total) % whole AS rest FROM d, s),
      r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, target DESC, dataset_key) AS place, sum(base) OVER () AS given FROM f),
      g AS (SELECT dataset_key, CAST(base + CASE WHEN place <= total - given THEN 1 ELSE 0 END AS BIGINT) AS n FROM r)
      SELECT CAST(w AS BIGINT) AS rank, dataset_key, n FROM g, range({WORLD}) x(w) WHERE n > 0"""
)
def composed_totals(spark, folder):
    """Rows of each rank and dataset that come out of the composer: all that the budget of whole steps plans."""
    return composed_batches(spark, folder).groupBy(F.col("rank").cast("long").alias("rank"), "dataset_key").agg(F.count("*").alias("n"))


@query()
def lpt_rebalance(spark, folder):
    per = composed_batches(spark, folder).groupBy("rank", "group_no", "step_no", "micro_batch").agg((F.max("length") * F.count("*")).alias("cost"))
    return per.groupBy("rank", "group_no", "step_no").agg(F.count("*").alias("micro_batches"), F.sum("cost").alias("step_cost"))


POOL = 8
PAD_SQL = """WITH r AS (SELECT line_no, path, good FROM (SELECT l.line_no, l.source_path AS path, CASE WHEN json_valid(l.raw) AND json_type(l.raw) = 'OBJECT' THEN 1 ELSE 0 END AS good, regexp_matches(l.raw, '\\S') AS said FROM shard_lines l) WHERE said),
  p AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no DESC) AS back FROM r WHERE good = 1),
  k AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS pool_no, count(*) OVER (PARTITION BY path) AS pool FROM p WHERE back <= 8),
  m AS (SELECT path, count(*) - sum(good) AS missing FROM r GROUP BY path)
  SELECT m.path, CAST(x.i AS BIGINT) AS pad_no, k.line_no, true AS is_replacement FROM m, LATERAL (SELECT unnest(range(CAST(m.missing AS BIGINT))) AS i) x JOIN k ON k.path = m.path AND k.pool_no = x.i % k.pool"""


def parsed_lines(spark, folder):
    """(path, line_no, raw, good): the non-blank lines of the shards and whether each is one JSON object."""
    lines = table(spark, folder, "shard_lines", F.col("source_path").alias("path"), "line_no", "raw").filter(F.col("raw").rlike(r"\S"))
    whole = F.from_json(F.when(F.col("raw").rlike(r"^\s*\{"), F.col("raw")), "map<string,variant>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    return lines.withColumn("good", whole.isNotNull())


@query(PAD_SQL)
def replacement_pad(spark, folder):
    lines = parsed_lines(spark, folder)
    pool = sampling.last_good(lines, "path", "line_no", F.col("good"), POOL).select("path", "line_no", "pool_no")
    counts = lines.groupBy("path").agg(F.count("*").alias("n"), F.count_if("good").alias("good")).withColumn("missing", F.col("n") - F.col("good")).filter("missing > 0 and good > 0")
    pads = counts.select("path", F.least("good", F.lit(POOL)).alias("pool"), F.explode(F.expr("sequence(0L, missing - 1)")).alias("pad_no"))
    return pads.join(pool, (pads.path == pool.path) & (pool.pool_no == pads.pad_no % pads.pool)).select(pads.path, "pad_no", "line_no", F.lit(True).alias("is_replacement"))


@query("""SELECT path, line_no, ordinal FROM (SELECT source_path AS path, line_no, row_number() OVER (PARTITION BY source_path ORDER BY line_no) - 1 AS ordinal FROM shard_lines WHERE regexp_matches(raw, '\\S')) WHERE ordinal >= 10 AND ordinal < 40""")
def skip_limit(spark, folder):
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return parsed_lines(spark, folder).select("path", "line_no", ordinal.cast("long").alias("ordinal")).filter("ordinal >= 10 and ordinal < 40")
