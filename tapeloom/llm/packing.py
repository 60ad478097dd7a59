"""Filling containers of fixed capacity by pattern packing with non-negative least squares.

Texts are measured in tokens of a public tokenizer; one longer than a container fills whole containers with all but its
rest. The histogram of the lengths (at most one number per length up to the capacity, whatever the number of texts) goes
to the driver. There, patterns of a few lengths that fill a container are enumerated over the cells of a length grid, with
the mean length of each cell's texts; their repeat counts are fitted to the histogram by non-negative least squares and
rounded, and fitted again to what is left. A container of a pattern takes real lengths from its cells, the last two as
the pair that fits best, and stays. Texts that no pattern took are packed best fit decreasing into the gaps and into new
containers. All work is on runs of equal containers, so it depends on the number of lengths and patterns, not of texts.
Texts find their container by their rank among the texts of their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import vocabularies
from tapeloom.operators.skew import ranked_within, spread
from tapeloom.session import cut_lineage

#: Cells of the length grid, and the most different cells in a pattern.
GRID, MOST_CELLS = 48, 3
#: A pattern's mean lengths differ from the capacity by at most this part of it; its containers must be filled to the second.
SLACK, LEAST_FILL = 1 / 128, 127 / 128
#: Most fits: each one but the first is for the texts that the one before left.
ROUNDS = 6


def token_counts(documents: DataFrame, key: str, text: str, folder: str = vocabularies.FOLDER, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, n_tokens) of each text that isn't null or blank."""
    kind = dict(documents.dtypes)[key]
    files = (folder, name)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = vocabularies.byte_bpe(*files)
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "n_tokens": [len(encoder.encode_ordinary(t)) for t in frame[text]]})

    some = documents.select(key, text).filter(F.col(text).rlike(r"(?U)\S"))
    return spread(some, key).mapInPandas(count, f"`{key}` {kind}, n_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by an active-set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(steps):
        gain = np.where(active, -np.inf, a.T @ (b - a @ x))
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        active[best] = True
        while active.any():
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (trial[active] > 0).all():
                x = trial
                break
            low = active & (trial <= 0)
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-12)).min()
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0.0
    return x


def patterns(means: dict[int, float], limits: dict[int, int], capacity: int, most: int = MOST_CELLS) -> list[dict[int, int]]:
    """How many texts of which cells fill a container, for up to `most` different cells.

    `means` has the mean length and `limits` the number of texts of each cell that isn't empty. A pattern's mean lengths
    differ from the capacity by at most `SLACK` of it; of the last of `most` cells it takes as many as fit.
    """
    out: list[dict[int, int]] = []
    cells, slack = sorted(means, reverse=True), capacity * SLACK

    def extend(own: dict[int, int], space: float, first: int) -> None:
        if own and space <= slack:
            out.append(own)
        if len(own) == most:
            return
        for i in range(first, len(cells)):
            c = cells[i]
            times = min(limits[c], int((space + slack) / means[c]))
            if len(own) + 1 == most:
                if times and space - times * means[c] <= slack:
                    out.append(own | {c: times})
            else:
                for n in range(1, times + 1):
                    extend(own | {c: n}, space - n * means[c], i + 1)

    extend({}, float(capacity), 0)
    return out


class _Shelf:
    """The texts of one cell that are left: their lengths in order, and how many there are of each."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.lengths = counts, sorted(counts)

    def taken(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.lengths.pop(bisect_left(self.lengths, length))

    def pick(self, space: int, used: dict[int, int], longest: bool) -> int | None:
        """A length, with a text left besides those in `used`, that fits in `space`: the longest, or the shortest."""
        top = bisect_right(self.lengths, space)
        for i in range(top - 1, -1, -1) if longest else range(top):
            if self.counts[self.lengths[i]] > used.get(self.lengths[i], 0):
                return self.lengths[i]
        return None


class _Gaps:
    """Runs of equal containers by free space: for each space, [contents, number of containers]."""

    def __init__(self):
        self.by_space: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
        self.spaces: list[int] = []

    def add(self, space: int, contents, number: int) -> None:
        if number > 0:
            if space not in self.by_space or not self.by_space[space]:
                insort(self.spaces, space)
            self.by_space[space].append((contents, number))

    def tightest(self, length: int):
        """(space, contents, number) of a run with the least space that takes `length`, taken out; or None."""
        i = bisect_left(self.spaces, length)
        if i == len(self.spaces):
            return None
        space = self.spaces[i]
        contents, number = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces.pop(i)
        return space, contents, number


def _fitted(shelves: dict[int, _Shelf], shapes: list[dict[int, int]], grid: int) -> list[int]:
    """How often each pattern occurs: the least-squares counts, rounded down, then up as long as there are texts."""
    left = np.zeros(grid)
    for c, shelf in shelves.items():
        left[c - 1] = sum(shelf.counts.values())
    matrix = np.zeros((grid, len(shapes)))
    for j, shape in enumerate(shapes):
        for c, n in shape.items():
            matrix[c - 1, j] = n
    wanted = nnls(matrix, left)
    times = np.zeros(len(shapes), dtype=int)
    some = np.flatnonzero(wanted > 1e-9)
    for down in (True, False):
        for j in some[np.argsort(-wanted[some] if down else times[some] - wanted[some], kind="stable")].tolist():
            n = int(wanted[j] + 1e-6) if down else int(wanted[j] - times[j] > 0.01)
            uses = matrix[:, j] > 0
            n = max(0, min(n, int((left[uses] // matrix[uses, j]).min())))
            times[j] += n
            left -= n * matrix[:, j]
    return times.tolist()


def _best_pair(shelves: list[_Shelf], space: int, used: dict[int, int]) -> tuple[int, ...]:
    """Lengths, at most one from each of one or two shelves, whose sum fits in `space` best."""
    last = shelves[-1]
    alone = last.pick(space, used, True)
    best = () if alone is None else (alone,)
    if len(shelves) == 2:
        first = shelves[0]
        for i in range(bisect_right(first.lengths, space)):
            a = first.lengths[i]
            if first.counts[a] > used.get(a, 0):
                b = last.pick(space - a, used | {a: used.get(a, 0) + 1}, True)
                if a + (b or 0) > sum(best):
                    best = (a,) if b is None else (a, b)
                    if sum(best) == space:
                        break
    return best


def _containers(shape: dict[int, int], times: int, shelves: dict[int, _Shelf], means: dict[int, float], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(contents, number) of runs of equal containers of a pattern, `times` in all or fewer; their texts are taken.

    Lengths are chosen so that the sum stays close to the sum of the means; the last two texts are the pair that fits best.
    """
    slots = [c for c in sorted(shape, reverse=True) for _ in range(shape[c])]
    while times > 0:
        contents: dict[int, int] = {}
        space, ahead = capacity, 0.0
        for c in slots[:-2]:
            if (length := shelves[c].pick(space, contents, ahead <= 0)) is not None:
                contents[length] = contents.get(length, 0) + 1
                space -= length
                ahead += length - means[c]
        for length in _best_pair([shelves[c] for c in slots[-2:]], space, contents):
            contents[length] = contents.get(length, 0) + 1
            space -= length
        if capacity - space < LEAST_FILL * capacity:
            return
        cell = {length: c for c in shape for length in contents if length in shelves[c].counts}
        number = min(times, *(shelves[cell[k]].counts[k] // n for k, n in contents.items()))
        for k, n in contents.items():
            shelves[cell[k]].taken(k, n * number)
        times -= number
        yield contents, number


def plan_parts(histogram: dict[int, int], capacity: int, grid: int = GRID) -> list[tuple[str, tuple[tuple[int, int], ...], int]]:
    """Runs of equal containers for a histogram of lengths from 1 to `capacity`.

    Each run is (origin, ((length, how many in one container), ...), number of containers); origin is "pattern" for
    containers that a pattern began, "rest" for others. All texts are placed.
    """
    by_cell: dict[int, dict[int, int]] = defaultdict(dict)
    for length, n in histogram.items():
        if n > 0:
            by_cell[-(-length * grid // capacity)][length] = n
    shelves = {c: _Shelf(own) for c, own in by_cell.items()}
    gaps = _Gaps()
    for _ in range(ROUNDS):
        limits = {c: n for c, shelf in shelves.items() if (n := sum(shelf.counts.values()))}
        means = {c: sum(k * n for k, n in shelves[c].counts.items()) / limits[c] for c in limits}
        shapes = patterns(means, limits, capacity)
        times = _fitted(shelves, shapes, grid) if shapes else []
        runs = [x for j in sorted(np.flatnonzero(times).tolist(), key=lambda j: (-max(shapes[j]), -times[j])) for x in _containers(shapes[j], times[j], shelves, means, capacity)]
        for contents, number in runs:
            gaps.add(capacity - sum(k * n for k, n in contents.items()), ("pattern", tuple(sorted(contents.items()))), number)
        if not runs:
            break
    left = {length: n for shelf in shelves.values() for length, n in shelf.counts.items() if n}
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            space, (origin, contents), number = gaps.tightest(length) or (capacity, ("rest", ()), -(-count // (capacity // length)))
            each = space // length
            whole = min(number, count // each)
            merged = lambda k: (origin, tuple(sorted((dict(contents) | {length: dict(contents).get(length, 0) + k}).items())))  # noqa: E731, B023
            gaps.add(space - each * length, merged(each), whole)
            count -= whole * each
            if whole < number and count and count < each:
                gaps.add(space - count * length, merged(count), 1)
                count, whole = 0, whole + 1
            if contents:
                gaps.add(space, (origin, contents), number - whole)
    return [(origin, contents, number) for space in sorted(gaps.by_space) for (origin, contents), number in gaps.by_space[space] if contents]


def plan(histogram: dict[int, int], capacity: int, grid: int = GRID) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """`plan_parts` without the origins."""
    return [(contents, number) for _, contents, number in plan_parts(histogram, capacity, grid)]


def placements(runs: list[tuple[str, tuple[tuple[int, int], ...], int]]) -> dict[int, list[tuple[int, int, int, int, str]]]:
    """By length, in order of rank: (first rank, end rank, first container, texts of that length in one container, origin)."""
    out: dict[int, list[tuple[int, int, int, int, str]]] = defaultdict(list)
    base = 0
    for origin, contents, number in runs:
        for length, each in contents:
            first = out[length][-1][1] if out[length] else 0
            out[length].append((first, first + each * number, base, each, origin))
        base += number
    return out


def packed(documents: DataFrame, key: str, text: str, packs: DataFrame, folder: str = vocabularies.FOLDER) -> DataFrame:
    """(pack_name, key, piece_no, first_token, n_tokens, container_id) of every piece of every non-blank text.

    Only texts longer than the capacity are cut: into pieces of the capacity, each alone in its container, and a rest
    that is packed like a text. Container ids begin with p where a pattern began the container, r where the rest of the
    texts did, and d for the pieces of long texts. Null and blank texts come out nowhere; packs with a null or non-positive capacity are left
    out. Equal texts are packed each. The driver holds at most one number per length up to the capacity.
    """
    spark = documents.sparkSession
    sizes = cut_lineage(token_counts(documents, key, text, folder))
    wanted = [(r["pack_name"], r["capacity"]) for r in packs.filter("capacity > 0").collect()]
    targets = F.array(*(F.struct(F.lit(name).alias("pack_name"), F.lit(capacity).cast("long").alias("capacity")) for name, capacity in wanted)) if wanted else F.expr("cast(array() as array<struct<pack_name: string, capacity: bigint>>)")
    each = sizes.select(key, "n_tokens", F.inline(targets))
    each = each.withColumn("_whole", F.expr("n_tokens div capacity")).withColumn("_rest", F.col("n_tokens") % F.col("capacity"))
    histograms: dict[str, dict[int, int]] = defaultdict(dict)
    for r in each.filter("_rest > 0").groupBy("pack_name", "_rest").count().collect():
        histograms[r["pack_name"]][r["_rest"]] = r["count"]
    rows = [(name, length, runs) for name, capacity in wanted for length, runs in placements(plan_parts(histograms[name], capacity)).items()]
    run = "struct<first: bigint, end: bigint, base: bigint, each: bigint, origin: string>"
    places = spark.createDataFrame(rows, f"pack_name string, _rest long, _runs array<{run}>")
    rests = ranked_within(each.filter("_rest > 0").select("pack_name", key, "capacity", "_whole", "_rest"), ["pack_name", "_rest"], F.xxhash64(key), key, "_rank")
    at = rests.join(F.broadcast(places), ["pack_name", "_rest"]).withColumn("_run", F.expr("filter(_runs, r -> _rank < r.end)[0]"))
    container = F.concat(F.substring("_run.origin", 1, 1), F.expr("_run.base + (_rank - _run.first) div _run.each").cast("string"))
    mixed = at.select("pack_name", key, F.col("_whole").alias("piece_no"), (F.col("_whole") * F.col("capacity")).alias("first_token"), F.col("_rest").alias("n_tokens"), container.alias("container_id"))
    whole = each.filter("_whole > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)))
    alone = whole.select("pack_name", key, "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.concat(F.lit("d"), F.col(key).cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"))
    return mixed.unionByName(alone)


def fills(pieces: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, container_id, capacity, n_pieces, fill): how full each container is."""
    each = pieces.groupBy("pack_name", "container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("fill"))
    return each.join(F.broadcast(packs.select("pack_name", "capacity")), "pack_name").select("pack_name", "container_id", "capacity", "n_pieces", "fill")


def shares(containers: DataFrame) -> DataFrame:
    """(pack_name, origin, containers, pieces, fill) of the result of `fills`: what patterns, rests and long texts filled."""
    origin = F.when(F.col("container_id").startswith("p"), "pattern").when(F.col("container_id").startswith("r"), "rest").otherwise("long text")
    return containers.groupBy("pack_name", origin.alias("origin")).agg(
        F.count("*").alias("containers"), F.sum("n_pieces").alias("pieces"), (F.sum("fill") / F.sum("capacity")).alias("fill")
    )
