"""Operator 9, SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint has bit b set if over half of the hashes of its three-word shingles have it.
Fingerprints within ``RADIUS`` bits link. Each bit position has a vector over GF(2) of ``RADIUS + 1``
entries; every non-zero vector of that space gives a mask of the positions with inner product one. Any
``RADIUS`` differing positions leave some non-zero vector orthogonal to all of them, so the pair agrees
under that mask: every pair within the radius meets in one of ``2 ** (RADIUS + 1) - 1`` tables. The positions that have the
zero vector (0, 16, 32 and 48) are in no mask, so no table needs them to agree, and the proof holds for them too.

Equal fingerprints are one node, so copies cost nothing. A bucket of up to ``BUCKET`` fingerprints is
compared in one task, which emits a forest and not pairs; a larger one is dealt anew, by each of
``RADIUS + 1`` blocks of the positions its mask leaves free (two fingerprints within the radius agree on
one of them), until it fits. Components come from star contraction over the links.

Defined cases: null and empty texts have fingerprint zero and link like any other; null ids take part but
never name a component unless all are null; repeated rows share their component; very long texts are hashed whole; an
empty table gives an empty result; extra columns, whatever their names, are ignored by ``simhash_components`` and pass through
``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.skew import salted_join, spare
from orbweave.operators.components import connected_components
from orbweave.storage import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 2048
_STEP = 1 << 14
KEYED = "mask long, key long, fp long"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks under which every pair within the radius agrees at least once."""
    space = 1 << (radius + 1)
    return [signed(sum(1 << i for i in range(bits) if bin((i % space) & v).count("1") % 2)) for v in range(1, space)]


def shingles(text: str | None, width: int = SHINGLE) -> list[bytes]:
    """Word shingles with repeats; bytes are lower-cased in A-Z alone, and split at ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= width:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(width)), strict=False)]


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    own = shingles(text)
    if not own:
        return 0
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), _STEP):
        h = np.array([digest(s, SEED) for s in own[at : at + _STEP]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return signed(int.from_bytes(np.packbits(2 * ones > len(own), bitorder="little").tobytes(), "little"))


def _roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """Least fingerprint of each one's component within a bucket."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    at = np.arange(len(fps))
    while True:
        low = np.where(near, at[None, :], len(fps)).min(1)
        low = low[low]
        if (low == at).all():
            return fps[at]
        at = low


def _link(batches: Iterator[pd.DataFrame], radius: int, bucket: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by mask, key and fingerprint; out come links (mask 0) and the rows of buckets that are too large."""
    held, large = np.zeros((0, 3), dtype=np.int64), None

    def buckets(rows: np.ndarray, links: list) -> None:
        ends = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1
        bounds = np.concatenate([[0], ends, [len(rows)]])
        for k in np.flatnonzero(np.diff(bounds) > 1):
            own = rows[bounds[k] : bounds[k + 1]]
            if len(own) > bucket:
                links.append(own)
                continue
            root = _roots(own[:, 2], radius)
            far = root != own[:, 2]
            if far.any():
                links.append(np.stack([np.zeros(far.sum(), dtype=np.int64), root[far], own[far, 2]], axis=1))

    for b in batches:
        rows, out = b[["mask", "key", "fp"]].to_numpy(dtype=np.int64), []
        if large is not None:
            same = (rows[:, :2] == large).all(1)
            n = len(rows) if same.all() else int(np.argmin(same))
            out.append(rows[:n])
            rows, large = rows[n:], None if n < len(rows) else large
        if len(rows):
            held = np.concatenate([held, rows])
            last = (held[:, :2] != held[-1, :2]).any(1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                buckets(held[:cut], out)
                held = held[cut:]
            if len(held) > bucket:
                large = held[-1, :2].copy()
                out.append(held)
                held = held[:0]
        if out:
            yield pd.DataFrame(np.concatenate(out), columns=["mask", "key", "fp"])
    out = []
    if len(held):
        buckets(held, out)
    if out:
        yield pd.DataFrame(np.concatenate(out), columns=["mask", "key", "fp"])


def _finer(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Deal rows of large buckets by each block of the positions that their mask leaves free."""
    for b in batches:
        out = []
        for mask, own in b.groupby("mask"):
            free = [i for i in range(64) if not (int(mask) >> i) & 1]
            for part in np.array_split(np.array(free), radius + 1):
                finer = np.int64(signed((int(mask) | sum(1 << int(i) for i in part)) & ((1 << 64) - 1)))
                out.append(pd.DataFrame({"mask": finer, "key": own["fp"].to_numpy() & finer, "fp": own["fp"].to_numpy()}))
        yield pd.concat(out)


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(src, dst)`` that join the distinct fingerprints of ``fps`` (column fp) into their components."""
    tables = F.array(*[F.lit(m) for m in covering_masks(radius)])
    rows = fps.select("fp", F.explode(tables).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    links = None
    while True:
        dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        met = materialize(dealt.mapInPandas(lambda b: _link(b, radius, bucket), KEYED), "links")
        own = met.where("mask = 0").select(F.col("key").alias("src"), F.col("fp").alias("dst"))
        links = own if links is None else links.unionAll(own)
        rest = met.where("mask <> 0")
        if rest.isEmpty():
            return links
        rows = rest.mapInPandas(lambda b: _finer(b, radius), KEYED).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``."""

    @F.pandas_udf("long")
    def mark(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in text], dtype="int64")

    marked = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), mark(F.col(text_col)).alias("fp")), "fingerprints")
    reps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    groups = connected_components(linked_fingerprints(reps, radius, bucket))
    named = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return salted_join(marked, labels, ["fp"]).select("doc_id", hexed, "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row of each group with the least id (of rows repeated with that id, each stays); columns unchanged."""
    own = spare(docs, "id")
    keep = simhash_components(docs, id_col, text_col, radius).where("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_semi")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
