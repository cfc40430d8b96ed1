"""Calibration, fits, sweeps and comparison tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.prefix import rank_within


def ece_table(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Reliability by bins of equal count: bin ``ceil((rank + 1) * bins / n) - 1``; rows of one score are ranked by id."""
    n = scored.agg(F.count(F.lit(1)).alias("n"))
    blocks = scored.withColumns({"all": F.lit(0), "block": F.struct("score", F.floor(F.col("doc_id") / 4096).alias("b"))})
    ranked = rank_within(blocks, ["all"], "block", [F.col("score"), F.col("doc_id")], "rank")
    binned = ranked.crossJoin(F.broadcast(n)).withColumn("bin", (F.ceil(F.col("rank") * bins / F.col("n")) - 1).cast("long"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def threshold_for(calibrated: DataFrame, targets: list[float]) -> DataFrame:
    """``target, least_score, share``: the least raw score that reaches each target after calibration, and how many rows do."""
    per = [F.struct(F.lit(t).alias("target"), F.min(F.when(F.col("calibrated") >= t, F.col("score"))).alias("least_score"), F.avg((F.col("calibrated") >= t).cast("double")).alias("share")) for t in targets]
    return calibrated.agg(F.array(*per).alias("all")).select(F.inline("all"))


def ece(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("correct"), F.lit(2.0))).alias("brier"))


def platt(scored: DataFrame, rounds: int = 200, tol: float = 1e-10) -> tuple[float, float]:
    """Logistic calibration by Newton steps; each is one aggregate of five sums over all rows."""
    a, b = 0.0, 0.0
    x = F.log(F.greatest(F.least(F.col("score"), F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(F.col("score"), F.lit(1 - 1e-6)), F.lit(1e-6))))
    points = scored.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("double")).alias("y"))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w = F.col("n") * p * (1 - p)
        r = points.agg(F.sum((F.col("y") - F.col("n") * p) * F.col("x")).alias("ga"), F.sum(F.col("y") - F.col("n") * p).alias("gb"), F.sum(w * F.col("x") ** 2).alias("aa"), F.sum(w * F.col("x")).alias("ab"), F.sum(w).alias("bb")).first()
        if r["bb"] is None:
            break
        det = r["aa"] * r["bb"] - r["ab"] ** 2
        if abs(det) < 1e-12:
            break
        da, db = (r["bb"] * r["ga"] - r["ab"] * r["gb"]) / det, (r["aa"] * r["gb"] - r["ab"] * r["ga"]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tol:
            break
    return a, b


def apply_platt(scores: DataFrame, a: float, b: float) -> DataFrame:
    """Every row with its calibrated score."""
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-6)), F.lit(1e-6))
    return scores.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(a) * F.log(p / (1 - p)) + F.lit(b)))))


def isotonic(scored: DataFrame, resolution: int = 10_000) -> DataFrame:
    """Pool-adjacent-violators over scores rounded to ``1 / resolution``: the fit sees counts per step, a bounded table."""
    steps = scored.groupBy(F.round(F.col("score") * resolution).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("double")).alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, blocks = pdf.sort_values("k"), []
        for k, n, y in zip(pdf["k"], pdf["n"], pdf["y"], strict=True):
            blocks.append([y, n, [k]])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                y2, n2, k2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + k2]
        return pd.DataFrame([(k / resolution, y / n) for y, n, ks in blocks for k in ks], columns=["score", "calibrated"])

    return steps.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: fit(pdf), "score double, calibrated double")


def apply_isotonic(scores: DataFrame, fitted: DataFrame) -> DataFrame:
    """Interpolate linearly between the fitted points (a bounded table)."""
    points = fitted.orderBy("score").collect()
    xs, ys = np.array([p["score"] for p in points]), np.array([p["calibrated"] for p in points])

    @F.pandas_udf("double")
    def interp(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s, xs, ys))

    return scores.withColumn("calibrated", interp("score"))


def ols_loglog(points: DataFrame, x: str, y: str) -> DataFrame:
    """``y = a * x ** b`` by least squares of logarithms: a, b, R squared and the residual spread."""
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    return points.where((F.col(x) > 0) & (F.col(y) > 0)).agg(
        F.exp(F.regr_intercept(ly, lx)).alias("a"), F.regr_slope(ly, lx).alias("b"), F.regr_r2(ly, lx).alias("r2"),
        F.sqrt(F.regr_syy(ly, lx) * (1 - F.regr_r2(ly, lx)) / (F.count(F.lit(1)) - 2)).alias("sigma_log"), F.count(F.lit(1)).alias("n"),
    )


def threshold_curve(scored: DataFrame, steps: int = 200) -> DataFrame:
    """Kept share, recall and dropped negatives at ``steps + 1`` thresholds: one histogram, then suffix sums over its cells."""
    cells = scored.groupBy(F.least(F.floor(F.col("score") * steps), F.lit(steps)).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("y"))
    grid = F.broadcast(scored.sparkSession.range(steps + 1).withColumnRenamed("id", "k")).join(cells, "k", "left").fillna(0)
    after = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, y = F.sum("n").over(after), F.sum("y").over(after)
    total, pos = F.sum("n").over(whole), F.sum("y").over(whole)
    return grid.select("k", F.try_divide(n.cast("double"), total).alias("kept"), F.try_divide(y.cast("double"), pos).alias("recall"), F.try_divide((total - pos - n + y).cast("double"), total - pos).alias("empty_dropped"))


def last_threshold(curve: DataFrame, recall: float) -> DataFrame:
    """Highest threshold that still recalls enough."""
    return curve.where(F.col("recall") >= recall).agg(F.max("k").alias("k"), F.max_by("kept", "k").alias("kept"))


def regret(table: DataFrame, by: str, policy: str, metric: str) -> DataFrame:
    """Shortfall to the best policy of each load; then worst and mean per policy."""
    best = F.max(metric).over(Window.partitionBy(by))
    return table.withColumn("regret", best - F.col(metric)).groupBy(policy).agg(F.max("regret").alias("worst"), F.avg("regret").alias("mean"))


def tornado(table: DataFrame, by: str, metric: str) -> DataFrame:
    """Range of the metric per setting."""
    return table.groupBy(by).agg((F.max(metric) - F.min(metric)).alias("range"), F.min(metric).alias("low"), F.max(metric).alias("high"))


def size_bucket(size, rule: str):
    """The three boundary rules in use: ``closed`` (32 to 96 inclusive), ``tolerant`` ([32, 96 + 1e-9)), ``half_open`` ([32, 96))."""
    top = {"closed": size <= 96, "tolerant": size < 96 + 1e-9, "half_open": size < 96}[rule]
    return F.when(size < 32, "small").when(top, "medium").otherwise("large")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value changed, appeared or went."""
    o, n = old.select(key, F.col(value).alias("old"), F.lit(True).alias("o")), new.select(key, F.col(value).alias("new"), F.lit(True).alias("n"))
    return o.join(n, key, "full").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("o").isNull() | F.col("n").isNull()).select(key, "old", "new")


def expectations(df: DataFrame, checks: dict) -> DataFrame:
    """A table of named checks over one scan: rows that break each, and whether none does."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    stacked = ", ".join(f"'{name}', `{name}`" for name in checks)
    return counts.select(F.expr(f"stack({len(checks)}, {stacked}) AS (check_name, broken)")).withColumn("ok", F.col("broken") == 0)


def runs_of(df: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """Consecutive rows of one kind within a group: number, kind, length."""
    w = Window.partitionBy(by).orderBy(order)
    turned = df.withColumn("__turn", F.when(F.col(kind).eqNullSafe(F.lag(kind).over(w)), 0).otherwise(1))
    runs = turned.withColumn("run", F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run", kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
