"""Operator 6, best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Workers turn each document into token ids and cut only documents longer than ``capacity`` (the first
piece takes the remainder). What a piece needs to be placed is its length alone, so the packing runs
on the histogram of lengths, of at most ``capacity`` rows whatever the corpus holds: lengths fall, and
the tree finds the least remaining capacity that still takes the length, in logarithmic time. Equal
bins are kept as runs, so the state is bounded too. Pieces are then numbered within their length and take the slot
of their number: a piece's place in its written part deals the pieces of one length, however alike, evenly to salts
of about ``SALT_ROWS``, and the numbers go on from one salt to the next.

Defined cases: null or empty text is one piece holding the end token alone; repeated rows each get a
place of their own; null ids are kept; which of several pieces of one length takes which slot is free; very long
texts are cut to pieces whole, none is dropped; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm import textio
from orbweave.storage import materialize

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are numbered by one task, at the least; beyond ``1 << 16`` salts in all, more.
SALT_ROWS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Counts of open bins by remaining capacity; ``tightest(n)`` is the least capacity of n or more with a bin."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.sums = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.leaves
        while at:
            self.sums[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length: runs ``(first number, count, first bin, offset)``; number r of the run lies in bin first + r."""
    tree, groups, bins = CapacityTree(capacity), {}, 0
    slots: dict[int, list[tuple[int, int, int, int]]] = {}

    def leave(first: int, count: int, remaining: int) -> None:
        if remaining and count:
            groups.setdefault(remaining, []).append((first, count))
            tree.add(remaining, count)

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, number, runs = histogram[length], 0, slots.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, count = bins, max(1, left // per)
                bins += count
            else:
                first, count = groups[room].pop()
                tree.add(room, -count)
                per = room // length
            full = min(count, left // per)
            used, each = (full, per) if full else (1, left)
            for k in range(each):
                runs.append((number, used, first, capacity - room + k * length))
                number += used
            left -= used * each
            leave(first, used, room - each * length)
            leave(first + used, count - used, room)
    return slots


def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: str, capacity: int, end_id: int, rows: int = 500) -> Iterator[pa.RecordBatch]:
    made, fast, end = textio.load(path), textio.load_ranks(ranks), np.uint32(end_id).tobytes()
    special = textio.special_tokens(made)

    def encode(text: str) -> bytes:
        if textio.SAFE.fullmatch(text) and not any(x in text for x in special):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(made.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    for batch in (whole.slice(at, rows) for whole in batches for at in range(0, len(whole), rows)):
        out: list[tuple[int, int, int, int, int]] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = encode(text or "") + end
            n, at, piece = len(ids) // 4, 0, 0
            size = n % capacity or capacity
            while at < n:
                out.append((row, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                at, piece, size = at + size, piece + 1, capacity
        made_of = np.array(out, dtype=np.int64).reshape(-1, 5).T
        columns = [batch.column("doc_id").take(pa.array(made_of[0])), pa.array(made_of[1].astype(np.int32)), *map(pa.array, made_of[2:])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])


def pack(docs: DataFrame, path: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(lambda b: _pieces(b, path, ranks, capacity, end_id), PIECES)
    pieces = materialize(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = best_fit_decreasing(histogram, capacity)
    spark = docs.sparkSession
    runs = [(n, [(first, bins, at) for first, _, bins, at in own]) for n, own in slots.items()]
    table = spark.createDataFrame(runs, "length long, runs array<struct<first:long,bins:long,at:long>>")  # a row a length: at most ``capacity`` of them
    spread = max(SALT_ROWS, sum(histogram.values()) >> 16)
    salts = F.array(*[F.lit(max(1, -(-histogram.get(n, 0) // spread))) for n in range(capacity + 1)])
    salted = pieces.withColumn("salt", F.pmod(F.col("place"), F.get(salts, F.col("length").cast("int")).cast("long")))
    before = (
        salted.groupBy("length", "salt").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("place")
    numbered = salted.withColumn("number", F.row_number().over(within)).join(before, ["length", "salt"]).select(
        *[c.split()[0] for c in PIECES.split(", ")], (F.col("number") + F.col("before") - 1).alias("number")
    )

    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)
    placed = numbered.join(F.broadcast(table), "length").withColumn("run", run)
    names = [c.split()[0] for c in PIECES.split(", ")]
    return placed.select(*names, (F.col("run.bins") + F.col("number") - F.col("run.first")).alias("sequence_id"), F.col("run.at").alias("offset"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Query: every document's pieces and their places in sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *textio.byte_vocabulary())
