"""Listings of audio files, decoding of WAV files, and signatures of side indexes."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of audio files.
SUFFIXES = "wav flac mp3 m4a ogg opus"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, stem) of the audio files under a folder that are not empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", "")).filter(F.lower("name").rlike(rf"\.({SUFFIXES.replace(' ', '|')})$"))


def first_by(files: DataFrame, key: str) -> DataFrame:
    """One path per name or stem: the smallest."""
    return files.groupBy(key).agg(F.min("path").alias("path"))


def decoded(spark: SparkSession, root: str, rate: int = 16000) -> DataFrame:
    """(path, seconds, samples): mono samples of 16-bit WAV files at `rate`, channels averaged, resampled linearly.

    A file that can't be decoded comes out with nulls.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        own, channels = w.getframerate(), w.getnchannels()
                        x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, channels).mean(axis=1) / 32768.0
                    n = round(len(x) * rate / own)
                    y = x if own == rate or not len(x) else np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)
                    out.append((path, len(y) / rate, y.astype("float32").tolist()))
                except (wave.Error, EOFError, ValueError):
                    out.append((path, None, None))
            yield pd.DataFrame(out, columns=["path", "seconds", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return files.select("path", "content").mapInPandas(decode, "path string, seconds double, samples array<float>")


def is_current(path: Column, size: Column, modified: Column, kept_path: Column, kept_size: Column, kept_modified: Column) -> Column:
    """Whether a side index still fits its source: same path, size and modification time; false when unknown."""
    return F.coalesce((path == kept_path) & (size == kept_size) & (modified == kept_modified), F.lit(False))
