"""Operator 2, toxicity: a factorization machine over hashed terms.

The score of a document is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)`` over the hashed
terms that it contains (``x_i`` is 1), so a pair such as an insult and a group mention can count for more
than its parts. Terms that say nothing about the label on the training rows (likelihood ratio below
``MIN_GAIN``) have no weight. The machine is fitted on the driver by Adagrad on a bounded sample of
labelled rows (``SAMPLE_POSITIVE`` and ``SAMPLE_NEGATIVE`` rows, lowest hash of the id first); only ids,
labels and term slots reach the driver. Where the bounds cut the two labels in different shares, the bias is set back by the
logarithm of their ratio, counted over all usable labels, so that a score means the same at every size. Every document is
scored on the workers, over its whole text.

Labels of rows with ``crc32(doc_id) mod 5 = 0`` are never read into training. Defined cases: null and
empty texts have no terms and get the bias alone; rows with null labels or ids do not train; a repeated
label row counts once per copy; of several texts under one id the least trains; labels of equal hash of the id come by id; without
any usable label every score is 0.5 or the base rate; null ids are scored and not held out (held_out false); very long texts are
scored whole; a score of exactly 0.5 predicts 1; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_POSITIVE = 6_000
SAMPLE_NEGATIVE = 10_000
SLOTS = 1 << 18
FACTORS = 4
MIN_GAIN = 12.0
EPOCHS = 12
HOLD_OUT = 5
_WORD = re.compile(r"[^\W\d_]+")
CACHE_TERMS = 400_000


def held_out(doc_id):
    """The fold that never trains."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % HOLD_OUT == 0, F.lit(False))


def term_slots(text: str | None, cache: dict[str, int], slots: int = SLOTS) -> np.ndarray:
    """Distinct slots of the terms of a whole text."""
    out = set()
    for term in set(_WORD.findall((text or "").lower())):
        slot = cache.get(term)
        if slot is None:
            if len(cache) > CACHE_TERMS:
                cache.clear()
            slot = cache[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) % slots
        out.add(slot)
    return np.fromiter(out, dtype=np.int64, count=len(out))


@dataclass(frozen=True)
class Machine:
    """Weights of the slots that count: ``slots`` is sorted, ``w`` and ``v`` follow it."""

    bias: float
    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def margin(self, terms: np.ndarray) -> float:
        """Score before the sigmoid of a set of slots."""
        if not len(self.slots) or not len(terms):
            return self.bias
        at = np.searchsorted(self.slots, terms)
        at[at == len(self.slots)] = 0
        at = at[self.slots[at] == terms]
        v = self.v[at]
        return float(self.bias + self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, terms: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(terms), -30, 30))))


def _telling_slots(rows: list[np.ndarray], labels: np.ndarray, slots: int, min_gain: float) -> np.ndarray:
    """Slots whose presence tells the label: likelihood-ratio statistic of the two-by-two table."""
    n, pos = len(rows), labels.sum()
    seen, hit = np.zeros(slots), np.zeros(slots)
    for terms, y in zip(rows, labels, strict=True):
        seen[terms] += 1
        hit[terms] += y
    cells = ((hit, seen, pos), (seen - hit, seen, n - pos), (pos - hit, n - seen, pos), (n - pos - seen + hit, n - seen, n - pos))
    gain = np.zeros(slots)
    for got, row, col in cells:
        expected = row * col / max(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(got > 0, 2 * got * np.log(got / expected), 0)
    return np.flatnonzero((gain >= min_gain) & (seen >= 3))


def fit(rows: list[np.ndarray], labels: np.ndarray, slots: int = SLOTS, factors: int = FACTORS, min_gain: float = MIN_GAIN, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Machine:
    """Fit by Adagrad, one row at a time, in an order fixed by the seed."""
    labels = np.asarray(labels, dtype=float)
    n, pos = len(rows), labels.sum()
    base = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else 0.0
    if not n or pos in (0, n):
        return Machine(base, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, factors)))
    known = _telling_slots(rows, labels, slots, min_gain)
    place = np.full(slots, -1)
    place[known] = np.arange(len(known))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)), base
    gw, gv, gb = np.full(len(known), 1e-6), np.full((len(known), factors), 1e-6), 1e-6
    own = [p[p >= 0] for p in (place[r] for r in rows)]
    for _ in range(epochs):
        for k in rng.permutation(n):
            at = own[k]
            part = v[at]
            whole = part.sum(0)
            m = bias + w[at].sum() + 0.5 * ((whole**2).sum() - (part**2).sum())
            error = 1 / (1 + np.exp(-min(max(m, -30), 30))) - labels[k]
            gb += error * error
            bias -= rate * error / np.sqrt(gb)
            if len(at):
                dw, dv = error + l2 * w[at], error * (whole - part) + l2 * part
                gw[at] += dw * dw
                gv[at] += dv * dv
                w[at] -= rate * dw / np.sqrt(gw[at])
                v[at] -= rate * dv / np.sqrt(gv[at])
    return Machine(float(bias), known, w, v)


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = SAMPLE_POSITIVE, negatives: int = SAMPLE_NEGATIVE) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Term slots and labels of the bounded sample, and what its shares of the two labels add to the bias.

    The chosen ids, at most the two bounds, are broadcast to the scan.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = usable.where("toxic = 1").orderBy(*order).limit(positives).unionAll(usable.where("toxic = 0").orderBy(*order).limit(negatives))
    counted = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    shift = sampling_shift(counted.get(1, 0), counted.get(0, 0), positives, negatives)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "slots": [term_slots(t, cache).astype("<i4").tobytes() for t in b["text"]]})

    once = chosen.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
        .join(F.broadcast(once.select("doc_id").distinct()), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"))
    )  # one text an id: what reaches the driver is bounded by the sample
    found = (
        texts.join(F.broadcast(once), "doc_id")
        .select("doc_id", "text", F.explode(F.array_repeat("toxic", F.col("copies").cast("int"))).alias("toxic"))
        .mapInPandas(slots, "doc_id long, toxic int, slots binary")
        .toPandas()
        .sort_values(["doc_id", "toxic", "slots"])
    )
    return [np.sort(np.frombuffer(x, dtype="<i4").astype(np.int64)) for x in found["slots"]], found["toxic"].to_numpy(dtype=float), shift


def sampling_shift(pos: int, neg: int, positives: int = SAMPLE_POSITIVE, negatives: int = SAMPLE_NEGATIVE) -> float:
    """Logarithm of the ratio of the shares that the sample takes of the two labels."""
    if not pos or not neg:
        return 0.0
    return float(np.log(min(pos, positives) / pos) - np.log(min(neg, negatives) / neg))


def fitted(docs: DataFrame, labels: DataFrame, positives: int = SAMPLE_POSITIVE, negatives: int = SAMPLE_NEGATIVE) -> Machine:
    """The machine of the bounded sample, its bias set back to the shares of all labels."""
    rows, y, shift = training_rows(docs, labels, positives, negatives)
    made = fit(rows, y)
    return replace(made, bias=made.bias - shift)


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [sent.value.score(term_slots(t, cache)) for t in b["text"]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    out = rows.mapInPandas(scored, "doc_id string, held_out boolean, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: the toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
