"""Joins and ranks that hold when one key carries a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.session import cut_lineage

#: Keys with more rows than this go through a broadcast side; at most (rows / HOT_ROWS) keys can be hot.
HOT_ROWS = 100_000
#: Rows that one sort group of `ranked_within` should hold.
RANK_ROWS = 50_000


def attach_group_values(rows: DataFrame, groups: DataFrame, key: str, rows_in_group: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `rows` with `groups` (one row per `key`) without gathering a hot key in one task.

    `rows_in_group` names the column of `groups` with the key's number of rows. Groups above
    `hot_rows` are broadcast: there are at most count(rows) / hot_rows of them, and `hot_rows` is
    raised so that this stays below 50,000. Their rows are spread over all tasks by a hash of the row
    instead of by key, so the shuffle of the other groups meets no hot key. Null keys match nothing.
    """
    total = groups.agg(F.sum(rows_in_group)).first()[0] or 0
    hot_rows = max(hot_rows, math.ceil(total / 50_000))
    values = [c for c in groups.columns if c != key]
    rows = rows.filter(F.col(key).isNotNull())
    if total <= hot_rows:  # no group can be hot
        return rows.join(groups, key)
    hot = groups.filter(F.col(rows_in_group) > hot_rows).select(F.col(key), F.struct(*values).alias("_hot"))
    # the shuffle is by (_at, key): rows of hot keys get any `_at` and meet no cold group, others that of their group
    at = F.col(key) if dict(groups.dtypes)[key] == "bigint" else F.xxhash64(key)
    cold = groups.filter(F.col(rows_in_group) <= hot_rows).select(at.alias("_at"), F.col(key), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_at", F.when(F.col("_hot").isNull(), at).otherwise(F.xxhash64(*rows.columns)))
    joined = marked.join(cold, ["_at", key], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.filter(found.isNotNull()).select(*rows.columns, *(found[c].alias(c) for c in values))


def ranked_within(rows: DataFrame, keys: list[str], order: Column, tie: str, name: str = "rank", group_rows: int = RANK_ROWS, most: int | None = None, costly: bool = False) -> DataFrame:
    """`rows` with a 0-based rank within `keys` by (`order`, `tie`), where `order` is a uniform 64-bit hash.

    A key's rows are cut by the leading bits of the hash into slices of about `group_rows`, the slices
    are counted, and a row's rank is its slice's offset plus its rank inside the slice; so no task sorts
    a whole hot key. `tie` must be unique within a key. An empty table gives an empty result. `most` is the largest
    number of rows of a key where the caller knows it (an upper bound will do); else the keys are counted first. Where
    slices are counted, `rows` is read twice; with `costly` it is written to the shared folder and read from there.
    """
    if most is None:
        most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, most) / group_rows)))
    hashed = rows.withColumn("_h", order)
    if not bits:
        return hashed.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("_h", tie)) - 1).drop("_h")
    hashed = hashed.withColumn("_slice", F.shiftright("_h", 64 - bits))
    hashed = cut_lineage(hashed) if costly else hashed
    slices = hashed.groupBy(*keys, "_slice").count()
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*keys, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_h", tie)) - 1
    placed = hashed.withColumn("_inner", inner).join(offsets, [*keys, "_slice"])
    return placed.withColumn(name, F.col("_offset") + F.col("_inner")).drop("_h", "_slice", "_offset", "_inner")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` over at least as many partitions as there are cores, for costly per-row work on few small files.

    Input that already has that many splits is returned as it is, so large tables are never shuffled for this.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(4 * cores, key)
