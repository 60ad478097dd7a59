"""Padding, masking and packing of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def padded(values: Column, width: Column, fill: int, left: bool = False) -> Column:
    """`values` filled to `width` on the right, or on the left."""
    rest = F.array_repeat(F.lit(fill).cast("long"), F.greatest(width - F.size(values), F.lit(0)))
    return F.concat(rest, values) if left else F.concat(values, rest)


def ones(length: Column) -> Column:
    return F.array_repeat(F.lit(1).cast("long"), length)


def collated(rows: DataFrame, batch: str, ids: str, labels: str, pad_id: int, label_pad: int = -100) -> DataFrame:
    """`rows` with input_ids, attention_mask and labels of equal width in a batch. Null arrays count as empty."""
    empty = F.array().cast("array<bigint>")
    own, marks = F.coalesce(ids, empty), F.coalesce(labels, empty)
    width = F.max(F.greatest(F.size(own), F.size(marks))).over(Window.partitionBy(batch))
    sized = rows.withColumn("width", width)
    w = F.col("width")
    return sized.withColumn("input_ids", padded(own, w, pad_id)).withColumn("attention_mask", padded(ones(F.size(own)), w, 0)).withColumn("label_ids", padded(marks, w, label_pad))


def padded_features(matrix: Column, width: Column) -> Column:
    """A matrix of feature rows, each filled with zeros to `width` frames; null stays null."""
    return F.transform(matrix, lambda row: F.concat(row, F.array_repeat(F.lit(0.0), F.greatest(width - F.size(row), F.lit(0)))))


def collated_features(rows: DataFrame, batch: str, features: str) -> DataFrame:
    """`rows` with input_features padded to the most frames of the batch, feature_length and feature_attention_mask.

    All rows of a matrix have the same number of frames; a null or empty matrix has none and comes out as it is.
    """
    frames = F.coalesce(F.size(F.try_element_at(features, F.lit(1))), F.lit(0))
    own = rows.withColumn("feature_length", F.greatest(frames, F.lit(0)).cast("long"))
    own = own.withColumn("_width", F.max("feature_length").over(Window.partitionBy(batch)).cast("int"))
    mask = padded(ones(F.col("feature_length").cast("int")), F.col("_width"), 0)
    return own.withColumn("input_features", padded_features(F.col(features), F.col("_width"))).withColumn("feature_attention_mask", mask).drop("_width")


def kept(ids: Column, mask: Column) -> Column:
    """The ids at which the mask is set, wherever they are."""
    pairs = F.arrays_zip(ids.alias("i"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"] != 0), lambda p: p["i"])


def unique_ids(ids: Column) -> Column:
    """Distinct non-negative ids in the order of their first place."""
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x >= 0)))


def low_rank_projection(rows: DataFrame, key: str, features: str, weight, down, up, scale: float) -> DataFrame:
    """(key, projected): W x + scale * (x A) B of each feature array, by matrix products over Arrow batches.

    A null array, or one of another width, gives a null.
    """
    import numpy as np
    import pandas as pd

    whole = np.asarray(weight, dtype="float64").T + scale * (np.asarray(down, dtype="float64") @ np.asarray(up, dtype="float64"))
    kind = dict(rows.dtypes)[key]

    def project(frames):
        for frame in frames:
            fits = [x is not None and len(x) == whole.shape[0] for x in frame[features]]
            out = iter(np.stack([np.asarray(x, dtype="float64") for x, f in zip(frame[features], fits) if f]) @ whole if any(fits) else [])
            yield pd.DataFrame({key: frame[key], "projected": [next(out).tolist() if f else None for f in fits]})

    return rows.select(key, features).mapInPandas(project, f"`{key}` {kind}, projected array<double>")
