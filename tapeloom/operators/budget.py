"""Planning arithmetic: targets, apportionment, step budgets and schedules.

These rules work on a few numbers per dataset, rank or layer, so they run on the driver; the queries in
`tapeloom.plans.planning` state the same rules over DataFrames.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

#: Cap used for bin edges when none is given.
DEFAULT_CAP = 30.0


def bin_edges(cap: float, bins: int) -> list[int]:
    """Strictly rising whole edges of `bins` equal bins below `cap`; none for one bin."""
    cap = cap if math.isfinite(cap) and cap > 0 else DEFAULT_CAP
    edges: list[int] = []
    for i in range(1, bins):
        edges.append(max(round(cap * i / bins), edges[-1] + 1 if edges else 1))
    return edges


def dataset_target(weight: float, count: int) -> int:
    """Rows a dataset should give: weight times count, half to even, at least one."""
    return max(round(weight * count), 1)


def apportion(targets: Sequence[int], total: int) -> list[int]:
    """`targets` scaled down to `total` by largest remainder; ties: larger target, then earlier."""
    whole = sum(targets)
    if total > whole or total < 0:
        raise ValueError(f"can't apportion {total} of {whole}")
    if not whole:
        return [0] * len(targets)
    shares = [divmod(t * total, whole) for t in targets]
    out = [q for q, _ in shares]
    by_rest = sorted(range(len(targets)), key=lambda i: (-shares[i][1], -targets[i], i))
    for i in by_rest[: total - sum(out)]:
        out[i] += 1
    return out


def mix_budget(targets: Sequence[int], batch: int, world: int, accumulation: int, most: int | None = None) -> tuple[int, list[int], int]:
    """(steps, rows per dataset and rank, rows per rank) that fill whole steps on every rank.

    `most` bounds the rows of all ranks; each rank's targets are scaled down to its part of that.
    """
    per_rank = [t // world for t in targets]
    if most is not None and (whole := sum(per_rank)) > (cap := max(most, 0) // world):
        per_rank = [int(n * (cap / whole)) for n in per_rank]
    step = batch * accumulation
    steps = sum(per_rank) // step
    if not steps:
        raise ValueError("not enough rows for one step")
    return steps, apportion(per_rank, steps * step), steps * step


def step_budget(total: int, batch: int, world: int, accumulation: int) -> tuple[int, int]:
    """(steps, rows used) when every rank makes the same number of whole steps."""
    steps = total // (batch * world * accumulation)
    if not steps:
        raise ValueError("not enough rows for one step")
    return steps, steps * batch * world * accumulation


def limited_total(counts: Sequence[int], limit: int | None) -> int:
    return sum(counts) if limit is None else min(sum(counts), max(limit, 0))


def worker_targets(total: int, batch: int, workers: int) -> list[int]:
    """Rows per worker in whole batches; the first workers get one more."""
    each, more = divmod(total // batch, workers)
    return [(each + (w < more)) * batch for w in range(workers)]


def datasets_to_workers(targets: Sequence[int], capacities: Sequence[int]) -> list[list[int]]:
    """Rows of each dataset (outer) for each worker (inner).

    Datasets in falling order are split in proportion to what each worker can still take, by largest remainder and
    never above it; all capacities are used up exactly.
    """
    if sum(targets) != sum(capacities):
        raise ValueError("targets and capacities differ in total")
    left = list(capacities)
    out = [[0] * len(capacities) for _ in targets]
    for i in sorted(range(len(targets)), key=lambda i: (-targets[i], i)):
        room = sum(left)
        shares = [divmod(targets[i] * c, room) if room else (0, 0) for c in left]
        given = [min(q, c) for (q, _), c in zip(shares, left)]
        order = sorted(range(len(left)), key=lambda w: (-shares[w][1], -left[w], w))
        while (missing := targets[i] - sum(given)) > 0:
            for w in [w for w in order if given[w] < left[w]][:missing]:
                given[w] += 1
        out[i] = given
        left = [c - g for c, g in zip(left, given)]
    return out


def lookahead(layers: int, total: int, mode: str) -> list[int]:
    """A total look-ahead spread over layers; the remainder goes to the front, the back or evenly."""
    each, extra = divmod(total, layers)
    if mode == "front":
        more = set(range(extra))
    elif mode == "back":
        more = set(range(layers - extra, layers))
    elif mode == "even":
        more = {layers // 2} if extra == 1 else {round(i * (layers - 1) / (extra - 1)) for i in range(extra)}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return [each + (i in more) for i in range(layers)]


def learning_rate_factor(step: int, warmup: int, total: int, least: float) -> float:
    """Linear warm-up, then a half cosine down to `least`."""
    if step < warmup:
        return (step + 1) / warmup
    done = min(1.0, (step - warmup) / max(1, total - warmup))
    return least + (1 - least) * 0.5 * (1 + math.cos(math.pi * done))


def total_steps(epochs: float, steps_per_epoch: int) -> tuple[int, int]:
    """(steps, epochs started) of a possibly fractional number of epochs; half up, at least one step."""
    return max(1, math.floor(epochs * steps_per_epoch + 0.5)), math.ceil(epochs)


def stable_seed(*parts: object) -> int:
    """A seed from the representations of its parts, the same on every machine."""
    digest = hashlib.sha1()
    for part in parts:
        digest.update(repr(part).encode() + b"\0")
    return int(digest.hexdigest()[:16], 16) % (2**63 - 1)


def retry_seconds(attempts: int, base: float, most: float) -> float:
    """Longest time spent waiting between attempts, with 20 % jitter."""
    return sum(min(base * 2**i, most) * 1.2 for i in range(max(0, attempts - 1)))
