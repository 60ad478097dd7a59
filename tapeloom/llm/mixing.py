"""Mixing sources to target weights by hierarchical budgets.

Weights are propagated through a domain - language - source tree; a source that can't fill its share passes the shortage
to its siblings, and only a whole group that is full passes it on to the groups beside it. Each source's records are
then taken as a prefix of seeded epochs: full epochs give each record once, the last one a prefix of a seeded order, up to
the source's share by cumulative size. Sizes are those of a column, such as a number of tokens; without one each record
counts as 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Language suffixes of dataset keys.
SUFFIXES = "zh en de fr es it"
MIXED = "mixed"


@dataclass
class Node:
    """A group or source: its weight, how much it can give, and its children by name."""

    weight: float = 0.0
    room: int = 0
    children: dict[str, "Node"] = field(default_factory=dict)


def proportional(total: int, weights: list[float], rooms: list[int]) -> list[int]:
    """`total` split in proportion to `weights`, none above its room; shortages go to the others, again in proportion.

    Whole numbers by largest remainder, ties to the earlier one. The sum is `total`, or less if all rooms are full.
    """
    exact, open_, left = [0.0] * len(weights), [i for i, (w, r) in enumerate(zip(weights, rooms)) if w > 0 and r > 0], float(total)
    while open_ and left > 1e-9:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if exact[i] + unit * weights[i] >= rooms[i]]
        if not full:
            for i in open_:
                exact[i] += unit * weights[i]
            break
        for i in full:
            left -= rooms[i] - exact[i]
            exact[i] = float(rooms[i])
            open_.remove(i)
    out = [min(r, math.floor(x + 1e-9)) for x, r in zip(exact, rooms)]
    goal = min(total, sum(r for w, r in zip(weights, rooms) if w > 0))
    by_rest = sorted((i for i in range(len(out)) if weights[i] > 0), key=lambda i: (out[i] - exact[i], i))
    while (missing := goal - sum(out)) > 0:
        for i in [i for i in by_rest if out[i] < rooms[i]][:missing]:
            out[i] += 1
    return out


def allocate(node: Node, total: int, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], int]:
    """Sizes of all leaves of the tree under `node` for a total size."""
    if not node.children:
        return {path: total}
    names = list(node.children)
    shares = proportional(total, [node.children[n].weight for n in names], [node.children[n].room for n in names])
    return {leaf: size for n, share in zip(names, shares) for leaf, size in allocate(node.children[n], share, (*path, n)).items()}


def tree(leaves: Iterable[tuple[tuple[str, ...], float, int]]) -> Node:
    """The tree of (path, weight, room) leaves, weights and rooms summed upwards; children in name order."""
    root = Node()
    for path, weight, room in sorted(leaves):
        at = root
        for name in (None, *path):
            at = at if name is None else at.children.setdefault(name, Node())
            at.weight, at.room = at.weight + weight, at.room + room
    return root


def source_key(key: Column) -> Column:
    """A dataset key without padding and letter case; null for a blank one."""
    plain = F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""))
    return F.when(plain != "", plain)


def sources(specs: DataFrame) -> DataFrame:
    """(source, domain, language, weight, declared): one row per source over its files.

    Weights stand on every file (the largest counts); null and non-positive weights and counts leave a source unused.
    """
    key = source_key(F.col("dataset_key"))
    rows = specs.select(key.alias("source"), F.coalesce("data_root", F.lit("")).alias("domain"), "weight", "count").filter(key.isNotNull())
    merged = rows.groupBy("source").agg(F.min("domain").alias("domain"), F.max(F.nanvl("weight", F.lit(0.0))).alias("weight"), F.sum(F.greatest("count", F.lit(0))).alias("declared"))
    suffix = F.regexp_extract("source", f"_({SUFFIXES.replace(' ', '|')})$", 1)
    return merged.withColumn("language", F.when(suffix != "", suffix).otherwise(MIXED))


def keyed(records: DataFrame, specs: DataFrame, size: str | None = None) -> DataFrame:
    """(row_id, source, amount): each record's own dataset key or, if that is null or blank, its file's, and its size.

    Null and negative sizes count as 0; without a `size` column each record has size 1.
    """
    files = specs.select(F.col("train_path").alias("source_path"), source_key(F.col("dataset_key")).alias("_file_key")).dropDuplicates(["source_path"])
    amount = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)) if size else F.lit(1)
    own = records.select("row_id", "source_path", source_key(F.col("dataset_key")).alias("_own"), amount.cast("long").alias("amount"))
    return own.join(files, "source_path", "left").select("row_id", F.coalesce("_own", "_file_key").alias("source"), "amount").filter("source is not null")


def budgets(records: DataFrame, specs: DataFrame, plans: DataFrame, size: str | None = None) -> DataFrame:
    """One row per plan and usable source: target and actual size and share, and repeats.

    Works on the driver with one row per source and plan. A source's declared size is its declared count times the mean
    size of its records (of all records where it has none); the total size of a plan is size_factor times the declared
    sizes of all usable sources; a source's room is max_repeats times the size that is really there (`available`).
    `repeats` is the most times one of its records occurs. Shares are of the plan's total; with nothing to mix they are 0.
    """
    spark = records.sparkSession
    there = keyed(records, specs, size).groupBy("source").agg(F.count("*").alias("records"), F.sum("amount").alias("available"))
    rows = sources(specs).filter("weight > 0 and declared > 0").join(there, "source", "left").fillna(0, ["records", "available"]).orderBy("source").collect()
    mean = sum(r["available"] for r in rows) / max(1, sum(r["records"] for r in rows))
    declared = [round(r["declared"] * (r["available"] / r["records"] if r["records"] else mean)) if size else r["declared"] for r in rows]
    wanted = [r["weight"] * d for r, d in zip(rows, declared)]
    total_weight = sum(wanted) or 1.0
    out = []
    for plan in plans.orderBy("plan_name").collect():
        whole = round((plan["size_factor"] or 0.0) * sum(declared))
        most = max(0, plan["max_repeats"] or 0)
        leaves = [((r["domain"], r["language"], r["source"]), w, most * r["available"]) for r, w in zip(rows, wanted)]
        sizes = allocate(tree(leaves), min(whole, sum(room for *_, room in leaves))) if rows else {}
        given = sum(sizes.values())
        for r, w in zip(rows, wanted):
            own = sizes[r["domain"], r["language"], r["source"]]
            share = w / total_weight
            repeats = math.ceil(own / r["available"]) if r["available"] else 0
            out.append((plan["plan_name"], r["source"], r["domain"], r["language"], float(r["weight"]), int(r["declared"]), int(r["records"]), int(r["available"]), share, round(share * whole), own, repeats, own / given if given else 0.0))
    schema = "plan_name string, source string, domain string, language string, weight double, declared long, records long, available long, target_share double, target_size long, size long, repeats long, actual_share double"
    return spark.createDataFrame(out, schema)


def selection(records: DataFrame, specs: DataFrame, plans: DataFrame, seed: int = 1, size: str | None = None) -> DataFrame:
    """(plan_name, row_id, source, times) of each record that is taken, with how often.

    The order of a partial epoch is a hash of seed, epoch and row_id, cut into about sqrt(n) slices per source: slices
    before the boundary are taken whole by their sizes, and only the boundary slice is ordered, so no task ever sees
    a whole source. The records before the first that would exceed the source's size are taken. Row ids must be unique;
    duplicates would each count.
    """
    plan = budgets(records, specs, plans, size).filter("size > 0")
    params = plan.select("plan_name", "source", F.expr("size div available").alias("_full"), F.expr("size % available").alias("_rest"), F.ceil(F.sqrt("records")).cast("long").alias("_slices"))
    base = keyed(records, specs, size).join(F.broadcast(params), "source")
    base = base.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_full"), F.col("row_id"))).withColumn("_slice", F.pmod("_h", "_slices"))
    counts = base.filter("_rest > 0").groupBy("plan_name", "source", "_slice").agg(F.sum("amount").alias("_n"), F.first("_rest").alias("_rest"))
    through = F.sum("_n").over(Window.partitionBy("plan_name", "source").orderBy("_slice"))
    edge = counts.withColumn("_through", through).filter("_through >= _rest and _through - _n < _rest")
    edge = edge.select("plan_name", "source", F.col("_slice").alias("_edge"), (F.col("_rest") - F.col("_through") + F.col("_n")).alias("_of_edge"))
    placed = base.join(F.broadcast(edge), ["plan_name", "source"], "left")
    away = placed.filter("_edge is null or _slice != _edge").withColumn("times", F.col("_full") + F.coalesce((F.col("_slice") < F.col("_edge")).cast("long"), F.lit(0)))
    reached = F.sum("amount").over(Window.partitionBy("plan_name", "source").orderBy("_h", "row_id").rowsBetween(Window.unboundedPreceding, 0))
    at = placed.filter("_slice = _edge").withColumn("times", F.col("_full") + (reached <= F.col("_of_edge")).cast("long"))
    columns = ["plan_name", "row_id", "source", "times"]
    return away.select(columns).unionByName(at.select(columns)).filter("times > 0")
