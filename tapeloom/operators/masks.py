"""Regions of a frame axis and which positions see which: visibility as relations and window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def regions(samples: DataFrame, key: str, length: str, window: int) -> DataFrame:
    """(key, region_no, size): full windows of each sample, then its remainder. Empty and null samples have none."""
    some = samples.filter(F.col(length) > 0)
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({length} - 1) div {window}")))
    return some.select(key, F.col(length).alias("_n"), number.alias("region_no")).select(key, "region_no", F.least(F.lit(window).cast("long"), F.col("_n") - F.col("region_no") * window).alias("size"))


def bounds(sized: DataFrame, partition: str, order: list[str], size: str) -> DataFrame:
    """`sized` with from_frame and to_frame by the running sum of sizes within a partition."""
    through = F.sum(size).over(Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("to_frame", through).withColumn("from_frame", F.col("to_frame") - F.col(size))


def block_visible(i: Column, j: Column, block: int, left: int | None) -> Column:
    """Whether frame i sees frame j: up to the end of i's block, and at most `left` frames back if given."""
    ahead = j <= F.floor((i / block).cast("double")) * block + block - 1
    return ahead if left is None else ahead & (j >= i - left + 1)


def block_interval(i: Column, n: Column, block: int, left: int | None) -> tuple[Column, Column]:
    """First and last frame of a region of `n` frames that frame i sees under `block_visible`."""
    low = F.lit(0).cast("long") if left is None else F.greatest(F.lit(0).cast("long"), i - left + 1)
    return low, F.least(F.floor((i / block).cast("double")) * block + block, n) - 1


def block_frame(region: list[str], position: str, block: int) -> WindowSpec:
    """The window frame of `block_visible` without a left limit: peers of the block are seen whole."""
    return Window.partitionBy(*region).orderBy(F.expr(f"{position} div {block}")).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def lookahead_frame(region: list[str], position: str, lookahead: int | None) -> WindowSpec:
    """The window frame of a limited look-ahead; the whole region without one."""
    last = Window.unboundedFollowing if lookahead is None else lookahead
    return Window.partitionBy(*region).orderBy(position).rowsBetween(Window.unboundedPreceding, last)
