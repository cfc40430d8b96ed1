"""Energy and volume of a day as columns: stages, paths, savings, budgets. Rates and powers are positive or it is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.domain import tx_joules

# Stages of a tile by build (milliseconds, watts), measured or assumed by the reference scenario.
STAGES = {
    "cpu": {"gate": (0.94, 28.0), "detect": (38.6, 28.0)}, "gpu": {"gate": (0.052, 90.0), "detect": (10.71, 90.0)},
}
BASELINE_GATE = (56.36, 28.0)


def guarded(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def raw_bytes(height: Column, width: Column) -> Column:
    """Uncompressed colour pixels."""
    return (height.cast("long") * width.cast("long") * 3).cast("long")


def reduction(sent: Column, raw: Column) -> Column:
    return guarded(100 * (1 - sent / raw), (raw > 0) & (sent >= 0), "bytes must be positive")


def factor(sent: Column, raw: Column) -> Column:
    return guarded(raw / sent, sent > 0, "nothing was sent")


def stage_joules(watts: Column, milliseconds: Column) -> Column:
    return watts * milliseconds / 1000


def saving(baseline: Column, proposed: Column) -> Column:
    return F.when(baseline != 0, 1 - proposed / baseline).otherwise(F.lit(0.0))


def path_joules(n_bytes: Column, p_tx: float = 15.0, r_gs: float = 2.53e6, p_isl: float = 12.0, r_isl: float = 2.53e6) -> dict[str, Column]:
    """Energy of the direct path, of the hop, of the ground leg of the relay, and of the relayed path."""
    direct, hop = tx_joules(p_tx, n_bytes, r_gs), tx_joules(p_isl, n_bytes, r_isl)
    return {"direct_J": direct, "isl_J": hop, "ground_J": direct, "relay_J": hop + direct}


def processing(tiles: DataFrame, build: str = "cpu", calls_per_tile: float = 1.0) -> DataFrame:
    """Joules of a table of tiles, as proposed (gate and detector) and as the baseline (pre-filter and detector), and the saving."""
    own = STAGES[build]
    joules = lambda stage, calls=1.0: stage[0] * stage[1] / 1000 * calls
    detect = joules(own["detect"], calls_per_tile)
    out = tiles.agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") * (joules(own["gate"]) + detect)).alias("proposed_J"), (F.col("n") * (joules(BASELINE_GATE) + detect)).alias("baseline_J"))
    return out.withColumn("saving", saving(F.col("baseline_J"), F.col("proposed_J")))


def latency_budget(rows: DataFrame, processing_s: Column, encoding_s: Column, communication_s: Column, decoding_s: Column) -> DataFrame:
    """Total seconds, and the share that is not communication."""
    own = processing_s + encoding_s + decoding_s
    total = own + communication_s
    return rows.withColumns({"total_s": total, "own_share": F.when(total > 0, own / total).otherwise(F.lit(0.0))})
