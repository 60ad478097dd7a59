"""Copies hidden by formatting: progressive partition refinement.

One pass over the texts folds each record and keeps two numbers of it: a hash of order-free invariants of (text,
audio_ref), namely stripped lengths and a letter histogram over a fixed alphabet, and 64 bits of the SHA-256 of the folded
pair. No text is ever shuffled. Level 1 counts the records of each class of the invariants, pre-aggregated. Only records in
classes with several members are grouped by class and digest, which decide together: two different records are taken for
copies if both numbers clash, which among 10^12 records has a probability of about 10^-15 (n^2 / 2^129).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.skew import attach_group_values
from tapeloom.session import cut_lineage

#: White space (Unicode property, and the four separators U+001C to U+001F) and category P.
IGNORED = r"(?U)[\s\x1C-\x1F\p{P}]+"
#: Characters counted by the level-1 histogram: frequent letters of Latin and Chinese text, and digits in references.
TEXT_LETTERS = "eanirtosl的了一"
DIGITS = "0123456789"


def folded(value: Column) -> Column:
    """`value` without white space and punctuation, letter case removed (ß equals SS). Null stays null."""
    return F.lower(F.regexp_replace(F.upper(value), IGNORED, ""))  # upper first, as it spells out ß


def letter_count(value: Column, letter: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(letter), F.lit("")))


def invariant(text: Column, ref: Column) -> Column:
    """64-bit hash of the stripped lengths and of the letter histogram of two folded values."""
    return F.xxhash64(F.length(text), F.length(ref), *(letter_count(text, c) for c in TEXT_LETTERS), *(letter_count(ref, c) for c in DIGITS))


def json_records(lines: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(id, text, audio_ref) of the lines that hold one JSON object; others get nulls."""
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json(F.when(F.col(raw).rlike(r"^\s*\{"), F.col(raw)), "text string, audio_ref string, _bad string", options)
    good = lines.select(F.col(id_col), parsed.alias("_json"))
    keep = F.col("_json._bad").isNull()
    return good.select(F.col(id_col), F.when(keep, F.col("_json.text")).alias("text"), F.when(keep, F.col("_json.audio_ref")).alias("audio_ref"))


def records(manifest: DataFrame, lines: DataFrame) -> DataFrame:
    """Both tables as (table_name, id, text, audio_ref)."""
    first = manifest.select(F.lit("manifest").alias("table_name"), F.col("row_id").alias("id"), "text", "audio_ref")
    second = json_records(lines, "line_id", "raw").select(F.lit("shard_lines").alias("table_name"), F.col("line_id").alias("id"), "text", "audio_ref")
    return first.unionByName(second)


def copy_members(rows: DataFrame) -> DataFrame:
    """(table_name, id, first_id, n_copies) of each record in a group of two or more copies.

    `rows` has table_name, id, text, audio_ref; further columns are ignored. Records whose text or audio_ref is
    null or folds to nothing are in no group. Every member of a group is returned, the first included; ties do not
    arise as ids are unique within a table (an id given twice counts twice). Hot groups are spread, never gathered.
    """
    pair = rows.select("table_name", "id", folded(F.col("text")).alias("_t"), folded(F.col("audio_ref")).alias("_a"))
    pair = pair.filter((F.col("_t") != "") & (F.col("_a") != ""))
    digest = F.sha2(F.concat("_t", F.lit("\u0000"), "_a", F.lit("\u0000"), "table_name"), 256)
    keys = cut_lineage(pair.select("table_name", "id", F.xxhash64("table_name", invariant(F.col("_t"), F.col("_a"))).alias("c1"), F.xxhash64(digest).alias("_d")))
    several = cut_lineage(keys.groupBy("c1").count().filter("count > 1").withColumnRenamed("count", "_n1"))
    both = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("c1", "_d"))))
    inside = cut_lineage(attach_group_values(keys, several, "c1", "_n1").select("table_name", "id", both.alias("k2")))
    groups = cut_lineage(inside.groupBy("k2").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies")).filter("n_copies > 1"))
    return attach_group_values(inside, groups, "k2", "n_copies").drop("k2")


def found(rows: DataFrame) -> DataFrame:
    """One row (table_name, first_id, copy_id) for each member of a group but the first."""
    return copy_members(rows).filter("id != first_id").select("table_name", "first_id", F.col("id").alias("copy_id"))


def collapsed(rows: DataFrame) -> DataFrame:
    """One row (table_name, id, n_copies) per distinct record: a group's first member, and each record in no group with 1."""
    members = copy_members(rows).select("table_name", "id", "first_id", "n_copies")
    out = rows.select("table_name", "id").join(members, ["table_name", "id"], "left")
    return out.filter(F.col("first_id").isNull() | (F.col("id") == F.col("first_id"))).select("table_name", "id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
