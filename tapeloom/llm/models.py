"""Fitted models kept in the shared folder, so that queries of one application on the same tables share a fit."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tapeloom.session import shared_folder


def save(spark: SparkSession, model: Any, path: str) -> None:
    """Writes a model as one row; whatever stood at `path` is replaced."""
    spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Any:
    """The model that `save` wrote; only read folders that no one else can write, as it is unpickled."""
    return pickle.loads(spark.read.parquet(path).first()["model"])


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def state(tables: list[DataFrame]) -> str:
    """A digest of the files behind some tables: their paths, sizes and times of change."""
    lines = []
    for table in tables:
        for file in sorted(table.inputFiles()):
            system, at = _file_system(table.sparkSession, file)
            status = system.getFileStatus(at)
            lines.append(f"{file} {status.getLen()} {status.getModificationTime()}")
        lines.append("")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def shared(spark: SparkSession, name: str, tables: list[DataFrame], fit: Callable[[], Any]) -> Any:
    """The model `name` of these tables as they are now: loaded if this application has fitted it, else fitted and saved."""
    path = f"{shared_folder(spark)}/models-{spark.sparkContext.applicationId}/{name}-{state(tables)}"
    system, done = _file_system(spark, f"{path}/_SUCCESS")
    if system.exists(done):
        return load(spark, path)
    model = fit()
    save(spark, model, path)
    return model
