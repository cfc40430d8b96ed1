"""Connected components by alternating star contraction, entirely as joins and aggregates.

Each round hooks every node onto its smallest neighbour (large star, then small star); the number of
rounds is logarithmic in practice, no group of edges is ever gathered into one task, and each round's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.storage import materialize


def _fingerprint(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Self loops count as single nodes, null end points are ignored, repeated edges are harmless, and
    an empty table of edges gives an empty result.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = ends.where("u = v").select(F.col("u").alias("node")).distinct()
    stars = materialize(
        ends.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges"
    )
    state = _fingerprint(stars)
    for _ in range(max_rounds if state[0] else 0):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionAll(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        stars = materialize(small, "edges")
        now = _fingerprint(stars)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = labels.unionAll(roots)
    alone = loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionAll(alone)
