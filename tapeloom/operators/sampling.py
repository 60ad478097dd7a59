"""Seeded order, over-sampling, ranks, workers and groups, replacement rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.skew import ranked_within


def seed_column(*parts: Column) -> Column:
    """`budget.stable_seed` of already represented parts (strings with quotes, numbers plain)."""
    text = F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("\0"))))
    return (F.conv(F.substring(F.sha1(text), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def order_key(seed: int, *parts: Column) -> Column:
    """A hash by which rows are ordered at random but repeatably, as 16 hex digits."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 16)


def signed(digits: Column) -> Column:
    """16 hex digits as a signed number with the same order."""
    return (F.conv(digits, 16, 10).cast("decimal(20,0)") - F.lit(Decimal(2**63))).cast("long")


def oversampled(rows: DataFrame, key: str, id_col: str, targets: DataFrame, seed: int, keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(key, id, *keep, pass_no, position) so that each key gives its `target` rows: whole passes, then part of one.

    `targets` has (key, n, target) and is small (a row per dataset). A row comes out target div n or one more times. In
    each pass the order is by hash; the partial pass keeps the first ones. Keys without a target give nothing. `most` is
    the largest n, if known.
    """
    joined = rows.select(key, id_col, *keep).join(F.broadcast(targets.filter("target > 0 and n > 0")), key)
    passes = F.expr("cast((target + n - 1) div n as int)")
    each = joined.withColumn("pass_no", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("_o", order_key(seed, F.col("pass_no"), F.col(key), F.col(id_col)))
    ranked = ranked_within(each, [key, "pass_no"], signed(F.col("_o")), id_col, "_rank", most=most).drop("_o")
    position = F.col("pass_no") * F.col("n") + F.col("_rank")
    return ranked.withColumn("position", position.cast("long")).filter("position < target").select(key, id_col, *keep, "pass_no", "position")


def last_good(rows: DataFrame, group: str, order: str, good: Column, k: int) -> DataFrame:
    """The last `k` good rows of each group by `order`, numbered from 0 in that order as `pool_no`."""
    back = Window.partitionBy(group).orderBy(F.col(order).desc())
    kept = rows.filter(good).withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= k)
    return kept.withColumn("pool_no", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).drop("_back")
