"""JSON-lines manifests: a source with line numbers and byte offsets, parsing with rejects, and an appending sink."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.fields import strip

#: Bytes read at a time when a line is looked up.
CHUNK = 1 << 16
OFFSETS_SCHEMA = "source_path string, line_no long, byte_offset long, raw string"
# Reasons in the reject column.
BLANK, MALFORMED, NOT_OBJECT = "blank", "malformed_json", "not_an_object"
_PARSE = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def _files_at(spark: SparkSession, path: str) -> str | None:
    """'folder' or 'files' for what stands at a path or glob of any Hadoop file system; None where nothing does."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return None
    return "folder" if any(f.isDirectory() for f in found) else "files"


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, line_no, byte_offset, raw) of the non-blank lines of a file, a glob or all *.jsonl below a folder.

    Lines end at line feeds; line numbers count from 1, blank lines too; offsets are bytes. Large files are read in
    splits by many tasks: a line's offset is that of its split's first line, which follows from the sizes of the splits
    before it, plus what stands before it in the split. A place without files gives no rows.
    """
    kind = _files_at(spark, path)
    if kind is None:
        return spark.createDataFrame([], OFFSETS_SCHEMA)
    reader = spark.read.option("lineSep", "\n")
    if kind == "folder":
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), (F.octet_length("value") + 1).cast("long").alias("_size"), F.col("value").alias("raw")
    )
    splits = lines.groupBy("_file", "_split").agg(F.count("*").alias("_lines"), F.sum("_size").alias("_bytes"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_split", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_line"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte"))
    inside = Window.partitionBy("_file", "_split").orderBy("_at")
    placed = lines.withColumn("_no", F.row_number().over(inside)).withColumn("_through", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = F.url_decode(F.replace(F.regexp_replace("_file", "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
    out = placed.join(starts, ["_file", "_split"]).select(
        local.alias("source_path"), (F.col("_line") + F.col("_no")).cast("long").alias("line_no"), (F.col("_byte") + F.col("_through") - F.col("_size")).alias("byte_offset"), strip(F.col("raw")).alias("raw")
    )
    return out.filter(F.col("raw") != "")


def read_at(requests: DataFrame, path: str = "source_path", offset: str = "byte_offset") -> DataFrame:
    """(path, offset, raw): the line that begins at each offset, read by a seek in its file; null past the end.

    Files are opened through Arrow's file systems, once per batch of requests; the text of a line is not stripped.
    """

    def seek(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            frame = frame.assign(raw=None)
            for name, rows in frame.groupby(path):
                system, inner = fs.FileSystem.from_uri(name if ":" in name.split("/")[0] else f"file://{quote(os.path.abspath(name))}")
                with system.open_input_file(inner) as lines:
                    for i, at in rows[offset].sort_values().items():
                        lines.seek(int(at))
                        parts = []
                        while chunk := lines.read(CHUNK):
                            parts.append(chunk.partition(b"\n")[0])
                            if len(parts[-1]) < len(chunk):
                                break
                        frame.at[i, "raw"] = b"".join(parts).decode("utf-8", "replace") if parts else None
            yield frame

    wanted = requests.select(path, F.col(offset).cast("long").alias(offset)).filter(F.col(path).isNotNull() & (F.col(offset) >= 0))
    return wanted.mapInPandas(seek, f"`{path}` string, `{offset}` long, raw string")


def json_object(raw: Column, fields: str) -> Column:
    """The named fields (DDL) of a line that is one JSON object; null for every other line."""
    return F.from_json(F.when(is_object(raw), raw), fields, _PARSE)


def is_object(raw: Column) -> Column:
    """Whether a line is one whole JSON object."""
    return F.from_json(F.when(raw.rlike(r"^\s*\{"), raw), "map<string,variant>", _PARSE).isNotNull()


def reject_reason(raw: Column) -> Column:
    """Why a line gives no record; null for a good one. Null lines count as blank."""
    array = F.from_json(F.when(raw.rlike(r"^\s*\["), raw), "array<variant>", _PARSE).isNotNull()
    return F.when(raw.isNull() | ~raw.rlike(r"\S"), BLANK).when(is_object(raw), None).when(array, NOT_OBJECT).otherwise(MALFORMED)


def with_ordinals(lines: DataFrame, path: str = "source_path", line: str = "line_no") -> DataFrame:
    """`lines` with the 0-based ordinal of each in its file; files are bounded shards, so each is one window."""
    return lines.withColumn("ordinal", (F.row_number().over(Window.partitionBy(path).orderBy(line)) - 1).cast("long"))


def select_lines(lines: DataFrame, selection: DataFrame, path: str = "source_path") -> DataFrame:
    """Lines by position: inner join of (path, sel_pos, line_index) with ordinals; repeats and order (sel_pos) are kept."""
    rows = with_ordinals(lines)
    return selection.join(rows, (selection[path] == rows[path]) & (selection.line_index == rows.ordinal)).drop(rows[path])


def missing_lines(lines: DataFrame, selection: DataFrame, path: str = "source_path") -> DataFrame:
    """Selected positions that no line has; an empty result means a valid selection."""
    rows = with_ordinals(lines).select(path, F.col("ordinal").alias("line_index"))
    return selection.join(rows, [path, "line_index"], "left_anti")


def append_jsonl(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines, characters outside ASCII as they are."""
    rows.write.mode("append").json(folder)
