"""Length-bucketed micro-batches that mix datasets, balanced over steps.

A group is a bounded number of planned rows, so each is composed by one grouped-map call; groups run in parallel.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.budget import stable_seed


class Sample(NamedTuple):
    length: int
    dataset: str
    index: int
    bin: int


def cost(batch: Sequence[Sample]) -> int:
    """Padded size: the longest sample times their number."""
    return max((s.length for s in batch), default=0) * len(batch)


class _Stock:
    """Samples of a group by length bin and dataset, shortest first."""

    def __init__(self, samples: Sequence[Sample], seed: int):
        self.seed, self.ties = seed, {}
        self.bins: dict[int, dict[str, deque[Sample]]] = defaultdict(dict)
        self.sizes: dict[int, int] = defaultdict(int)
        for s in sorted(samples):
            self.bins[s.bin].setdefault(s.dataset, deque()).append(s)
            self.sizes[s.bin] += 1

    def size(self, bin_no: int) -> int:
        return self.sizes[bin_no]

    def filled(self) -> list[int]:
        return [b for b, n in self.sizes.items() if n]

    def _rank(self, bin_no: int, dataset: str) -> tuple[int, int]:
        if (tie := self.ties.get((bin_no, dataset))) is None:
            tie = self.ties[bin_no, dataset] = stable_seed(self.seed, "dataset-order", bin_no, dataset)
        return -len(self.bins[bin_no][dataset]), tie

    def from_bin(self, bin_no: int, batch: list[Sample]) -> Iterator[Sample]:
        """One sample per dataset and round, the fullest dataset first; datasets in the batch sit out the first round."""
        queues = self.bins[bin_no]
        resting = {s.dataset for s in batch}
        while True:
            turn = sorted((d for d, q in queues.items() if q and d not in resting), key=lambda d: self._rank(bin_no, d))
            if not turn and not resting:
                return
            for dataset in turn:
                self.sizes[bin_no] -= 1
                yield queues[dataset].popleft()
            resting = set()

    def around(self, start: int, batch: list[Sample]) -> Iterator[Sample]:
        """All samples for a batch that starts in bin `start`: that bin, then the nearest ones."""
        yield from self.from_bin(start, batch)
        for other in sorted((b for b in self.filled() if b != start), key=lambda b: (abs(b - start), -self.size(b), b)):
            yield from self.from_bin(other, batch)


def compose(samples: Sequence[Sample], batch_size: int, bins: int, seed: int) -> list[list[Sample]]:
    """Full micro-batches of a group: each starts in the fullest bin, ties nearest to a rotating preferred bin, then lower."""
    stock, batches = _Stock(samples, seed), []
    while filled := stock.filled():
        preferred = (seed % bins + len(batches)) % bins
        start = min(filled, key=lambda b: (-stock.size(b), abs(b - preferred), b))
        batch: list[Sample] = []
        for sample in stock.around(start, batch):
            batch.append(sample)
            if len(batch) == batch_size:
                break
        if len(batch) != batch_size:
            raise ValueError(f"{len(samples)} samples don't fill micro-batches of {batch_size}")
        batches.append(batch)
    return batches


def balance(batches: Sequence[list[Sample]], per_step: int) -> list[list[list[Sample]]]:
    """Batches by step: the costliest first, each to the open step with the least cost; steps by rising cost inside."""
    steps: list[list[list[Sample]]] = [[] for _ in range(-(-len(batches) // per_step))]
    open_steps = [(0, 0, i) for i in range(len(steps))]
    for batch in sorted(batches, key=cost, reverse=True):
        total, n, i = heapq.heappop(open_steps)
        steps[i].append(batch)
        if n + 1 < per_step:
            heapq.heappush(open_steps, (total + cost(batch), n + 1, i))
    return [sorted(step, key=cost) for step in steps]


def composed(rows: DataFrame, group: list[str], batch_size: int, per_step: int, bins: int, seed: int, epoch: int = 0) -> DataFrame:
    """(*group, step_no, micro_batch, slot, dataset_key, row_id, length, length_bin) of all rows of full groups.

    `rows` has `group` (rank, worker and group number), dataset_key, row_id, length and length_bin; a group must hold a
    multiple of the batch size. Extra columns are dropped, repeated rows stay. A group is bounded by its planner.
    """
    kinds = dict(rows.dtypes)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        samples = [Sample(int(n), d, int(i), int(b)) for n, d, i, b in zip(frame["length"], frame["dataset_key"], frame["row_id"], frame["length_bin"])]
        group_seed = stable_seed("dataset-group", seed, epoch, *map(int, key))
        out = []
        for step_no, step in enumerate(balance(compose(samples, batch_size, bins, group_seed), per_step)):
            out += [(*key, step_no, m, slot, s.dataset, s.index, s.length, s.bin) for m, batch in enumerate(step) for slot, s in enumerate(batch)]
        return pd.DataFrame(out, columns=[*group, "step_no", "micro_batch", "slot", "dataset_key", "row_id", "length", "length_bin"])

    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", step_no long, micro_batch long, slot long, dataset_key string, row_id long, length long, length_bin long"
    return rows.select(*group, "dataset_key", "row_id", "length", "length_bin").groupBy(*group).applyInPandas(one, schema)


def chunked(rows: DataFrame, group: list[str], batch_size: int) -> DataFrame:
    """A simpler plan that SQL can state: rows of a group in (bin, length, dataset, id) order, cut every `batch_size`."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("length_bin", "length", "dataset_key", "row_id")) - 1
    return rows.withColumn("_place", place).withColumn("micro_batch", F.expr(f"_place div {batch_size}")).withColumn("slot", (F.col("_place") % batch_size).cast("long")).drop("_place")
