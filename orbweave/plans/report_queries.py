"""Report tables over the driver's tables: sweeps, comparisons, audits, budgets and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbweave.functions import domain
from orbweave.operators import encoding
from orbweave.plans import views as v
from orbweave.plans.book import book
from orbweave.session import table

QUERIES, ORACLES, query = book()
R = lambda c, n=6: F.round(c, n)
D = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
N = lambda name="n": F.count(F.lit(1)).alias(name)
THRESHOLDS = (0.05, 0.25, 0.4, 0.67)


@query("SELECT round(count(*) FILTER (n_ships = 0) / greatest(1, count(*) FILTER (n_ships > 0)), 6) AS weight FROM v_tiles", v.TILES)
def class_imbalance_weight(spark, sf):
    return v.tiles(spark, sf).agg(R(F.count_if(F.col("n_ships") == 0) / F.greatest(F.lit(1), F.count_if(F.col("n_ships") > 0))).alias("weight"))


@query(
    "SELECT i.image, count(g.gt) AS n_boxes, coalesce(max(greatest(g.w, g.h)), 0) AS largest FROM (SELECT DISTINCT image FROM v_det) i LEFT JOIN v_gt g USING (image) GROUP BY 1",
    v.DET,
)
def label_index(spark, sf):
    """Boxes and largest side of every image, without boxes too; one pass, since detections and labels share their rows."""
    b = v.boxes(spark, sf)
    label = F.col("line") % 2 == 1
    return b.groupBy("image").agg(F.count_if(label).alias("n_boxes"), F.coalesce(F.max(F.when(label, F.greatest("w", "h"))), F.lit(0.0)).alias("largest"))


@query(
    """SELECT user_id, day, CAST(CASE WHEN ctx = 'coast' THEN bytes ELSE 0 END AS BIGINT) AS shared_bytes, CASE WHEN ctx <> 'coast' AND n_ships > 0 THEN round(bytes / CAST(n_ships AS DOUBLE), 4) ELSE 0 END AS own_bytes
    FROM v_tiles""",
    v.TILES,
)
def cost_attribution(spark, sf):
    own = F.when((F.col("ctx") != "coast") & (F.col("n_ships") > 0), R(D("bytes") / F.col("n_ships"), 4)).otherwise(0.0)
    return v.tiles(spark, sf).select("user_id", "day", F.when(F.col("ctx") == "coast", F.col("bytes")).otherwise(0).cast("long").alias("shared_bytes"), own.alias("own_bytes"))


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN conf < 0.25 THEN 'below 0.25: not reported' WHEN cx < 200 THEN 'coast: context needed' WHEN conf >= 0.67 THEN 'sure: record alone' ELSE 'unsure: region of interest' END AS reason FROM v_det)
    GROUP BY reason""",
    v.DET,
)
def level_reasons(spark, sf):
    reason = F.when(F.col("conf") < 0.25, "below 0.25: not reported").when(F.col("cx") < 200, "coast: context needed").when(F.col("conf") >= 0.67, "sure: record alone").otherwise("unsure: region of interest")
    return v.detections(spark, sf).groupBy(reason.alias("reason")).agg(N())


@query(
    "SELECT thr, count(*) FILTER (conf >= thr) AS n_records, count(DISTINCT CASE WHEN conf >= thr THEN image END) AS n_images FROM v_det, (SELECT CAST(unnest([0.05, 0.25, 0.4, 0.67]) AS DOUBLE) AS thr) GROUP BY thr",
    v.DET,
)
def threshold_counts(spark, sf):
    """Records and images at each threshold: images first keep their highest confidence, so no row is repeated per threshold."""
    per = v.detections(spark, sf).groupBy("image").agg(F.max("conf").alias("top"), *[F.count_if(F.col("conf") >= t).alias(f"n{i}") for i, t in enumerate(THRESHOLDS)])
    one = per.agg(*[x for i, t in enumerate(THRESHOLDS) for x in (F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.count_if(F.col("top") >= t).alias(f"m{i}"))])
    rows = F.array(*[F.struct(F.lit(t).alias("thr"), F.col(f"n{i}").alias("n_records"), F.col(f"m{i}").alias("n_images")) for i, t in enumerate(THRESHOLDS)])
    return one.select(F.inline(rows))


@query("SELECT level, count(*) AS n, count(*) FILTER ((level = 1) <> (conf > 0.67 AND conf >= 0.25)) AS n_disagree FROM (SELECT conf, CAST(CASE WHEN conf < 0.25 THEN 0 WHEN conf >= 0.67 THEN 1 ELSE 2 END AS INTEGER) AS level FROM v_det) GROUP BY level", v.DET)
def policy_agreement(spark, sf):
    """Levels by the priority rule, and where the level-of-detail encoder sends another product: it wants a confidence above the cut."""
    d = v.detections(spark, sf)
    ship = F.array(F.struct(F.col("det").alias("id"), "conf", F.lit(10.0).alias("px"), F.lit(False).alias("dark")))
    number = (F.col("image") * 100 + F.col("det")).alias("tile")
    tiles = d.select(number, F.lit(0.0).alias("t"), F.lit("ships").alias("ctx"), F.lit(True).alias("gate_empty"), F.lit(0).alias("unconfirmed"), F.lit(0).alias("n_fp"), F.lit(None).cast("double").alias("coast_bytes"), ship.alias("ships"))
    sent = encoding.encode_lod(tiles, audit=0.0).select("tile", F.col("kind").alias("product"))
    judged = v.detections(spark, sf).select(number, domain.level(F.col("conf"), F.lit(False), F.lit(False)).alias("level")).join(sent, "tile", "left")
    return judged.groupBy("level").agg(N(), F.count_if((F.col("level") == 1) != F.coalesce(F.col("product") == "L0", F.lit(False))).alias("n_disagree"))


@query(
    """SELECT bucket, count(*) AS n, round(avg(CASE WHEN conf >= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(1 - pow(1 - greatest(w, h) / 768, 2)), 6) AS expected_cut
    FROM (SELECT *, CASE WHEN greatest(w, h) < 20 THEN 'small' WHEN greatest(w, h) < 40 THEN 'medium' ELSE 'large' END AS bucket FROM v_det) GROUP BY bucket""",
    v.DET,
)
def cut_recall_by_size(spark, sf):
    side = F.greatest("w", "h")
    bucket = F.when(side < 20, "small").when(side < 40, "medium").otherwise("large")
    return v.detections(spark, sf).groupBy(bucket.alias("bucket")).agg(N(), R(F.avg((F.col("conf") >= 0.25).cast("double"))).alias("recall"), R(F.avg(1 - F.pow(1 - side / 768, F.lit(2)))).alias("expected_cut"))


@query("SELECT s.load, s.policy, s.metric, round(s.metric - b.metric, 4) AS delta FROM v_sweep s JOIN v_sweep b ON s.load = b.load AND b.policy = 'O'", v.SWEEP)
def baseline_deltas(spark, sf):
    """Each policy against the baseline row of its load; the baseline comes from a window, not from a second scan."""
    base = F.max(F.when(F.col("policy") == "O", F.col("metric"))).over(Window.partitionBy("load"))
    return v.sweep(spark, sf).withColumn("base", base).where("base IS NOT NULL").select("load", "policy", "metric", R(F.col("metric") - F.col("base"), 4).alias("delta"))


@query(
    """SELECT signal, count(*) AS n_dropped, CAST(sum(n_ships) AS BIGINT) AS ships_at_risk, round(avg(CASE WHEN n_ships = 0 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM (
    SELECT 'score' AS signal, n_ships FROM v_tiles WHERE gate_score < 0.126 UNION ALL SELECT 'context', n_ships FROM v_tiles WHERE ctx = 'empty') GROUP BY signal""",
    v.TILES,
)
def gate_signals(spark, sf):
    fired = F.array_compact(F.array(F.when(F.col("gate_score") < 0.126, "score"), F.when(F.col("ctx") == "empty", "context")))
    t = v.tiles(spark, sf).select(F.explode(fired).alias("signal"), "n_ships")
    return t.groupBy("signal").agg(N("n_dropped"), F.sum("n_ships").alias("ships_at_risk"), R(F.avg((F.col("n_ships") == 0).cast("double"))).alias("precision"))


@query(
    "SELECT l_orderkey AS item, round(sum(CAST(l_quantity AS DOUBLE)) / 100, 6) AS sent, sum(CAST(l_quantity AS DOUBLE)) / 100 >= 1 - 1e-9 AS delivered FROM lineitem GROUP BY 1"
)
def route_totals(spark, sf):
    total = F.sum(D("l_quantity")) / 100
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(R(total).alias("sent"), (total >= 1 - 1e-9).alias("delivered"))


@query(
    """SELECT kind, CAST(sum(size) AS BIGINT) AS bytes, round(100 * (1 - sum(size) / (count(*) * CAST(1769472 AS DOUBLE))), 6) AS reduction, CASE WHEN count(*) = count(*) FILTER (value_c > 0) THEN round(max(created_us) / 1e6, 3) END AS done_s
    FROM v_items GROUP BY kind""",
    v.ITEMS,
)
def mode_results(spark, sf):
    done = F.when(F.count(F.lit(1)) == F.count_if(F.col("value_c") > 0), R(F.max("created_us") / 1e6, 3))
    return v.items(spark, sf).groupBy("kind").agg(F.sum("size").alias("bytes"), R(100 * (1 - F.sum("size") / (F.count(F.lit(1)) * 1769472.0))).alias("reduction"), done.alias("done_s"))


@query(
    """SELECT bucket, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b AND NOT a) AS gained, count(*) FILTER (a AND b) AS both FROM (
    SELECT CASE WHEN greatest(w, h) < 30 THEN 'small' ELSE 'large' END AS bucket, conf >= 0.4 AS a, conf * (1 + (cx % 7 - 3) / 10) >= 0.4 AS b FROM v_det) GROUP BY bucket""",
    v.DET,
)
def model_comparison(spark, sf):
    """What one model finds and another misses, by size."""
    d = v.detections(spark, sf).select(F.when(F.greatest("w", "h") < 30, "small").otherwise("large").alias("bucket"), (F.col("conf") >= 0.4).alias("a"), (F.col("conf") * (1 + (F.col("cx") % 7 - 3) / 10) >= 0.4).alias("b"))
    return d.groupBy("bucket").agg(F.count_if(F.expr("a AND NOT b")).alias("lost"), F.count_if(F.expr("b AND NOT a")).alias("gained"), F.count_if(F.expr("a AND b")).alias("both"))


@query(
    """SELECT round(sum(CASE WHEN ctx <> 'cloud' THEN n_ships ELSE 0 END) / CAST(sum(n_ships) AS DOUBLE), 6) AS recall, round(avg(CASE WHEN ctx <> 'cloud' THEN 1.0 ELSE 0.0 END), 6) AS kept, round(quantile_cont(CAST(bytes AS DOUBLE), 0.9), 4) AS p90_bytes FROM v_tiles""",
    v.TILES,
)
def prefilter_scores(spark, sf):
    clear = F.col("ctx") != "cloud"
    return v.tiles(spark, sf).agg(
        R(F.sum(F.when(clear, F.col("n_ships")).otherwise(0)) / D(F.sum("n_ships"))).alias("recall"), R(F.avg(clear.cast("double"))).alias("kept"), R(F.percentile(D("bytes"), F.lit(0.9)), 4).alias("p90_bytes")
    )


@query(
    """SELECT x_name, x, y_name, round(y, 4) AS y FROM (SELECT 'load' AS x_name, load AS x, metric, CAST(n AS DOUBLE) AS n FROM v_sweep WHERE policy = 'O' UNION ALL SELECT 'policy', policy, metric, CAST(n AS DOUBLE) FROM v_sweep WHERE load = '5-LOW')
    UNPIVOT (y FOR y_name IN (metric, n))""",
    v.SWEEP,
)
def curves_long(spark, sf):
    kind = F.array_compact(F.array(F.when(F.col("policy") == "O", F.struct(F.lit("load").alias("x_name"), F.col("load").alias("x"))), F.when(F.col("load") == "5-LOW", F.struct(F.lit("policy").alias("x_name"), F.col("policy").alias("x")))))
    wide = v.sweep(spark, sf).select(F.explode(kind).alias("k"), "metric", D("n").alias("n")).select("k.x_name", "k.x", "metric", "n")
    return wide.unpivot(["x_name", "x"], ["metric", "n"], "y_name", "y").select("x_name", "x", "y_name", R(F.col("y"), 4).alias("y"))


@query("SELECT kind, round(avg(bytes), 4) AS mean_bytes, count(*) AS n_days FROM (SELECT kind, CAST(floor(created_us / 86400000000) AS BIGINT) AS day, CAST(sum(size) AS DOUBLE) AS bytes FROM v_items GROUP BY 1, 2) GROUP BY kind", v.ITEMS)
def day_byte_budget(spark, sf):
    per = v.items(spark, sf).groupBy("kind", F.floor(F.col("created_us") / 86_400_000_000).alias("day")).agg(D(F.sum("size")).alias("bytes"))
    return per.groupBy("kind").agg(R(F.avg("bytes"), 4).alias("mean_bytes"), N("n_days"))


@query(
    """SELECT hour, count(*) AS n, median(wait_s) AS median_wait_s, round(avg(CASE WHEN wait_s > 14400 THEN 1.0 ELSE 0.0 END), 6) AS relayed FROM (
    SELECT CAST(t // 3600 AS BIGINT) AS hour, CAST(min(rise_s) - t AS DOUBLE) AS wait_s FROM (SELECT unnest(range(0, 86400, 300)) AS t), v_passes WHERE rise_s >= t GROUP BY t) GROUP BY hour""",
    v.PASSES,
)
def capture_hours(spark, sf):
    """Wait for the next pass over a grid of five minutes: median by hour, and the share that a relay would take."""
    rises = v.passes(spark, 2).agg(F.sort_array(F.collect_list("rise_s")).alias("rises"))
    grid = spark.range(0, 86_400, 300).crossJoin(F.broadcast(rises))
    waits = grid.select(F.floor(F.col("id") / 3600).alias("hour"), (F.array_min(F.filter("rises", lambda r: r >= F.col("id"))) - F.col("id")).cast("double").alias("wait_s"))
    return waits.groupBy("hour").agg(N(), F.median("wait_s").alias("median_wait_s"), R(F.avg((F.col("wait_s") > 14_400).cast("double"))).alias("relayed"))


@query("SELECT count(*) AS n_calls, count(DISTINCT md5(text)) AS n_distinct FROM documents WHERE text IS NOT NULL")
def call_memo(spark, sf):
    """Calls that a memo keyed by content would save."""
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("key")).agg(N()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"), N("n_distinct"))


@query(
    """SELECT ctx, count(*) AS n, min(bytes) AS low, median(CAST(bytes AS DOUBLE)) AS middle, round(quantile_cont(CAST(bytes AS DOUBLE), 0.9), 4) AS p90, max(bytes) AS high FROM v_tiles GROUP BY ctx""",
    v.TILES,
)
def tile_sizes(spark, sf):
    b = D("bytes")
    return v.tiles(spark, sf).groupBy("ctx").agg(N(), F.min("bytes").alias("low"), F.median(b).alias("middle"), R(F.percentile(b, F.lit(0.9)), 4).alias("p90"), F.max("bytes").alias("high"))
