"""Metrics of micro-batches, steps and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padding_ratio(real: Column, padded: Column) -> Column:
    """Share of padding in a padded size; 0 where the size is 0."""
    return F.coalesce(1.0 - F.try_divide(real.cast("double"), padded.cast("double")), F.lit(0.0))


def _by_dataset(rows: DataFrame, batch: list[str]) -> DataFrame:
    """Sizes of each dataset's part of each micro-batch; negative and null lengths and durations count as 0."""
    length, seconds = F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)), F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*batch, "dataset_key").agg(
        F.count("*").alias("n"), F.sum(length).alias("real"), F.max(length).alias("longest"), F.max(seconds).alias("max_seconds"), F.sum(F.coalesce(F.col("is_replacement").cast("long"), F.lit(0))).alias("replaced")
    )


def micro_batch_metrics(rows: DataFrame, batch: list[str]) -> DataFrame:
    """Per micro-batch of (dataset_key, length, seconds, is_replacement) rows: dataset mix, padding, cost, replacements.

    Negative and null lengths and durations count as 0. Aggregated by dataset first, so the wide step is partial.
    """
    return _totals(_by_dataset(rows, batch), batch)


def _totals(by_dataset: DataFrame, batch: list[str]) -> DataFrame:
    total = by_dataset.groupBy(*batch).agg(
        F.count("*").alias("datasets"), F.max("n").alias("_most"), F.sum("n").alias("samples"), F.sum("real").alias("real_frames"), F.max("longest").alias("_longest"), F.max("max_seconds").alias("max_seconds"), F.sum("replaced").alias("replacements")
    )
    padded = F.col("_longest") * F.col("samples")
    return total.select(
        *batch, "datasets", (F.col("_most") / F.col("samples")).alias("dominant_ratio"), "samples", "real_frames", padded.alias("padded_frames"), padding_ratio(F.col("real_frames"), padded).alias("padding_ratio"), padded.alias("cost"), "max_seconds", "replacements"
    )


def step_metrics(rows: DataFrame, batch: list[str], step: list[str]) -> DataFrame:
    """Per step: distinct datasets and their dominance from the rows, sizes and costs summed over its micro-batches.

    The micro_ columns are sums of the micro-batches' own figures.
    """
    own = [*step, *(c for c in batch if c not in step)]
    by_dataset = _by_dataset(rows, own)  # both branches below begin with it, so its shuffle is used twice
    sizes = _totals(by_dataset, own)
    summed = sizes.groupBy(*step).agg(
        F.count("*").alias("micro_batches"), F.sum("datasets").alias("micro_datasets"), F.sum("dominant_ratio").alias("micro_dominant"), F.sum("padding_ratio").alias("micro_padding"), F.sum("max_seconds").alias("micro_seconds"), F.sum("samples").alias("samples"), F.sum("real_frames").alias("real_frames"), F.sum("padded_frames").alias("padded_frames"), F.sum("cost").alias("cost"), F.max("max_seconds").alias("max_seconds"), F.sum("replacements").alias("replacements")
    )
    mix = by_dataset.groupBy(*step, "dataset_key").agg(F.sum("n").alias("n")).groupBy(*step).agg(F.count("*").alias("datasets"), F.max("n").alias("_most"))
    joined = summed.join(mix, step)
    return joined.withColumn("dominant_ratio", F.col("_most") / F.col("samples")).withColumn("padding_ratio", padding_ratio(F.col("real_frames"), F.col("padded_frames"))).drop("_most")


def interval_metrics(steps: DataFrame, rank: str, step: str, interval: int) -> DataFrame:
    """The fifteen figures of each interval of `interval` steps over all ranks; an interval without steps gives no row.

    Means are over micro-batches, over the steps of all ranks, or over samples. A rank's cost is the mean of its steps';
    `rank_cost_max` is the largest single step.
    """
    by_rank = steps.withColumn("interval_no", F.expr(f"{step} div {interval}")).groupBy("interval_no", rank).agg(
        F.count("*").alias("steps"), F.avg("cost").alias("rank_cost"), F.max("cost").alias("cost_max"),
        *(F.sum(c).alias(c) for c in ("micro_batches", "micro_datasets", "micro_dominant", "micro_padding", "micro_seconds", "datasets", "dominant_ratio", "padding_ratio", "cost", "max_seconds", "replacements", "samples")),
    )
    mean = lambda c, over, name: F.round(F.sum(c) / F.greatest(F.sum(over), F.lit(1)), 9).alias(name)
    return by_rank.groupBy("interval_no").agg(
        mean("micro_datasets", "micro_batches", "microbatch_unique_dataset_mean"),
        mean("micro_dominant", "micro_batches", "microbatch_dominant_ratio_mean"),
        mean("micro_padding", "micro_batches", "microbatch_padding_ratio_mean"),
        mean("micro_seconds", "micro_batches", "microbatch_max_duration_mean"),
        mean("datasets", "steps", "global_step_unique_dataset_mean"),
        mean("dominant_ratio", "steps", "global_step_dominant_ratio_mean"),
        mean("padding_ratio", "steps", "global_step_padding_ratio_mean"),
        mean("cost", "steps", "global_step_cost_mean"),
        F.max("cost_max").cast("double").alias("global_step_cost_max"),
        mean("max_seconds", "steps", "global_step_max_duration_mean"),
        mean("replacements", "samples", "replacement_rate"),
        F.round(F.avg("rank_cost"), 6).alias("rank_cost_mean"),
        F.round(F.stddev_pop("rank_cost"), 6).alias("rank_cost_std"),
        F.max("cost_max").cast("double").alias("rank_cost_max"),
        F.sum("steps").alias("interval_steps"),
    )
