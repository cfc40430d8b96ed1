"""How good a schedule could be: bounds of one window as prefix sums, exact optima of small ones, bounds of a day."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.domain import best_rate
from orbweave.operators.prefix import prefix_sum
from orbweave.operators.replay import LEAST_SHARE, Queue, per_scenario, replay, window_rows


def fractional_bound(items: DataFrame, group: str, capacity: str, floor: float = LEAST_SHARE) -> DataFrame:
    """Upper bound of each window: items by value per byte, the last one cut; a running sum of saturation bytes."""
    rate, used = best_rate(F.col("value"), F.col("size"), F.col("progressive"), floor)
    rated = items.withColumns({"rate": rate, "sat": used}).withColumn("step", -F.floor(F.log2(F.greatest("rate", F.lit(1e-300))) * 8))
    summed = prefix_sum(rated, [group], "step", [F.desc("rate"), F.col("id")], "sat", "upto")
    take = F.least(F.col("sat"), F.greatest(F.lit(0.0), F.col(capacity) - (F.col("upto") - F.col("sat"))))
    return summed.groupBy(group).agg(F.sum(take * F.col("rate")).alias("bound"))


def shares(progressive: bool, steps: int, floor: float) -> list[float]:
    """Shares of an item that the optimum may choose from: the whole, or equal steps above the floor up to the whole."""
    return [floor + (1 - floor) * k / steps for k in range(1, steps + 1)] if progressive and steps else [1.0]


def best_value(size: np.ndarray, value: np.ndarray, progressive: np.ndarray, capacity: float, buckets: int = 4000, steps: int = 4, floor: float = LEAST_SHARE, bucket: float | None = None) -> float:
    """Optimum of a window whose bytes are counted in buckets, sizes rounded up: dynamic programme over the buckets."""
    if capacity <= 0 or not len(size):
        return 0.0
    unit = bucket or max(1.0, capacity / buckets)
    best = np.zeros(int(capacity // unit) + 1)
    for s, v, may_cut in zip(size.tolist(), value.tolist(), progressive.tolist(), strict=True):
        before = best.copy()
        for f in shares(may_cut, steps, floor):
            need = math.ceil(s * f / unit)
            if need < len(best):
                np.maximum(best[need:], before[: len(best) - need] + v * (math.sqrt(f) if may_cut else 1.0), out=best[need:])
    return float(best[-1])


def _rates(q: Queue, floor: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Best value per byte of each item, and the bytes at which it is used up."""
    rate = q.density(np.arange(len(q.size))) / np.where(q.progressive, math.sqrt(floor), 1.0)
    return rate, np.divide(q.value, rate, out=np.zeros(len(rate)), where=rate > 0)


def window_bound(q: Queue, capacity: float) -> float:
    """The fractional bound of one window."""
    rate, need = _rates(q)
    order = np.argsort(-rate, kind="stable")
    before = np.cumsum(need[order]) - need[order]
    return float((np.minimum(need[order], np.maximum(0.0, capacity - before)) * rate[order]).sum())


class OpenWindows:
    """Windows with room left, in order of rise; the first open one from a place on is found by path halving."""

    def __init__(self, windows: list[tuple[float, float, float]]):
        self.rises, self.room = np.array([w[0] for w in windows]), [w[2] for w in windows]
        self.onward = list(range(len(windows) + 1))

    def first(self, at: float) -> int:
        return self.open_from(int(np.searchsorted(self.rises, at)))

    def open_from(self, j: int) -> int:
        to = self.onward
        while to[j] != j:
            to[j] = to[to[j]]
            j = to[j]
        return j

    def take(self, j: int, size: float) -> float:
        """Bytes taken of a window, at most what is left of it."""
        got = min(self.room[j], size)
        self.room[j] -= got
        if self.room[j] <= 1e-12:
            self.onward[j] = j + 1
        return got


def day_bound(q: Queue, windows: list[tuple[float, float, float]]) -> float:
    """Bound of a day with release times: by falling rate, each item fills the earliest windows that it may use.

    Late windows serve every item, early ones only what is there by then, so the earliest are used up first.
    """
    rate, need = _rates(q)
    plan, total = OpenWindows(windows), 0.0
    for k in np.argsort(-rate, kind="stable"):
        left, j = float(need[k]), plan.first(q.created[k])
        while left > 1e-12 and j < len(plan.room):
            got = plan.take(j, left)
            left -= got
            total += got * rate[k]
            j = plan.open_from(j)
    return total


def clairvoyant(q: Queue, windows: list[tuple[float, float, float]], floor: float = LEAST_SHARE) -> float:
    """Value of a schedule made with the whole day known: by density, each item whole in the first window that takes it, or cut there."""
    plan, total = OpenWindows(windows), 0.0
    for k in np.argsort(-q.density(np.arange(len(q.size))), kind="stable"):
        size, j = q.size[k], plan.first(q.created[k])
        while j < len(plan.room):
            share = 1.0 if size <= plan.room[j] else plan.room[j] / size if q.progressive[k] and plan.room[j] >= floor * size else 0.0
            if share:
                plan.take(j, size * share)
                total += q.value[k] * (np.sqrt(share) if q.progressive[k] else 1.0)
                break
            j = plan.open_from(j + 1)
    return float(total)


def small_instance(q: Queue, capacity: float, n: int, min_bucket: int = 2, max_buckets: int = 4000, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """``n`` of the items, drawn by hash, a capacity scaled by their share of the bytes, and a bucket that the smallest of them fills
    ``min_bucket`` times; the number of items is halved until the buckets are few enough."""
    mixed = (q.ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    order, whole = np.argsort(mixed, kind="stable"), q.size.sum()
    while True:
        own = np.sort(order[:n])
        part = capacity * q.size[own].sum() / whole if whole else 0.0
        bucket = max(1.0, q.size[own].min() / min_bucket) if len(own) else 1.0
        if part / bucket <= max_buckets or n <= 1:
            return own, part, bucket
        n //= 2


GAPS = "scenario string, window int, n long, greedy double, optimal double, bound double, gap double, valid boolean"


def measure_gap(items: DataFrame, windows: DataFrame, policy: str = "value", n: int = 40, steps: int = 4) -> DataFrame:
    """Walk through the day: at each window a small instance of the queue is solved by the policy and exactly.

    ``gap`` is the share of the optimum that the policy misses; ``valid`` says that policy, optimum and bound are in order.
    """

    def run(scenario: str, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, rows = Queue.of(left), []
        for w, (rise, end, capacity) in enumerate(window_rows(right)):
            q.arrive(rise)
            if len(q.waiting):
                part = _only(q, q.waiting)
                own, room, bucket = small_instance(part, capacity, n)
                rows.append((scenario, w, *gap_of(_only(part, own), room, rise, policy, bucket, steps)))
            q.remove(np.array([k for k, _ in q.plan(policy, capacity, rise)], dtype=np.int64))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in GAPS.split(", ")])

    return per_scenario(items, windows, run, GAPS)


def _only(q: Queue, own: np.ndarray) -> Queue:
    """Some items as a queue of their own, all waiting."""
    return Queue(q.ids[own], q.kind[own], q.created[own], q.size[own], q.value[own], q.progressive[own], q.least[own], np.arange(len(own)), len(own))


def gap_of(q: Queue, capacity: float, now: float, policy: str, bucket: float | None = None, steps: int = 4) -> tuple[int, float, float, float, float, bool]:
    """Number of items, value of the policy, of the optimum, the bound, the gap, and whether they are in order."""
    got = sum(q.value[k] * (math.sqrt(f) if q.progressive[k] else 1.0) for k, f in q.plan(policy, capacity, now))
    best = max(got, best_value(q.size, q.value, q.progressive, capacity, steps=steps, bucket=bucket))
    top = window_bound(q, capacity)
    slack = 1e-6 * max(1.0, top)
    return len(q.size), got, best, top, (best - got) / best if best > 0 else 0.0, bool(got <= best + slack and best <= top + slack)


BOUNDS = "scenario string, delivered double, foresight double, bound double, gap double"


def measure_day(items: DataFrame, windows: DataFrame, policy: str = "value") -> DataFrame:
    """Per scenario: what a policy delivers over the day, what a schedule with foresight does, and the bound over all windows."""

    def run(scenario: str, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, plan = Queue.of(left), window_rows(right)
        top, known = day_bound(q, plan), clairvoyant(q, plan)
        got = sum(q.value[k] * (math.sqrt(f) if q.progressive[k] else 1.0) for k, f, _ in replay(q, plan, policy).sent)
        return pd.DataFrame([(scenario, got, known, top, (top - got) / top if top else 0.0)], columns=[c.split()[0] for c in BOUNDS.split(", ")])

    return per_scenario(items, windows, run, BOUNDS)
