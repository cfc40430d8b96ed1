"""Filters, joins, aggregates, windows, calibration, sweeps and near-duplicates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbweave.functions import domain as d
from orbweave.operators import encoding, neighbours, statistics
from orbweave.operators.components import connected_components
from orbweave.plans import views as v
from orbweave.plans.book import book
from orbweave.session import table

QUERIES, ORACLES, query = book()
R = lambda c, n=6: F.round(c, n)


@query("SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(value_c) AS BIGINT) AS value_c FROM v_items GROUP BY kind", v.ITEMS)
def bytes_by_kind(spark, sf):
    return v.items(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("value_c").alias("value_c"))


@query("SELECT ctx, count(*) AS n, CAST(sum(n_ships) AS BIGINT) AS ships, round(avg(gate_score), 6) AS gate_mean FROM v_tiles GROUP BY ctx", v.TILES)
def context_case(spark, sf):
    return v.tiles(spark, sf).groupBy("ctx").agg(F.count(F.lit(1)).alias("n"), F.sum("n_ships").alias("ships"), R(F.avg("gate_score")).alias("gate_mean"))


@query("SELECT user_id, day, (gate_score < 0.126 OR ctx = 'empty') AND n_ships = 0 AND n_fp = 0 AS gate_empty, greatest(0, n_candidates - n_ships - n_fp) AS unconfirmed FROM v_tiles", v.TILES)
def gate_decision(spark, sf):
    return encoding.unconfirmed(encoding.gate(v.tiles(spark, sf))).select("user_id", "day", "gate_empty", "unconfirmed")


@query("SELECT ctx, avg(CAST(n_fp AS DOUBLE)) AS mean_fp, count(*) FILTER (n_fp > 0) AS with_fp FROM v_tiles GROUP BY ctx", v.TILES)
def false_alarms_at_thr(spark, sf):
    return v.tiles(spark, sf).groupBy("ctx").agg(F.avg(F.col("n_fp").cast("double")).alias("mean_fp"), F.count_if(F.col("n_fp") > 0).alias("with_fp"))


def _lod_tiles(spark, sf):
    ship = F.struct(F.col("id"), (F.pmod(F.col("id") * 37, F.lit(1000)) / F.lit(1000.0).cast("double")).alias("conf"), (F.col("size") % 90).cast("double").alias("px"), (F.col("user_id") % 10 == 0).alias("dark"))
    day = F.floor(F.col("created_us") / 86_400_000_000).cast("long")
    ships = v.items(spark, sf).where("kind IN ('L0', 'L1')").groupBy("user_id", day.alias("day")).agg(F.collect_list(ship).alias("ships"))
    t = encoding.unconfirmed(encoding.gate(v.tiles(spark, sf))).join(ships, ["user_id", "day"], "left")
    return t.select((F.col("user_id") * 1000 + F.col("day")).alias("tile"), (F.col("t_us") / 1e6).alias("t"), "ctx", "gate_empty", "unconfirmed", "n_fp", F.lit(None).cast("double").alias("coast_bytes"), F.coalesce("ships", F.array().cast("array<struct<id:bigint,conf:double,px:double,dark:boolean>>")).alias("ships"))


_SHIPS = v.TILES + """, v_ship AS (SELECT id, user_id, CAST(floor(created_us / 86400000000) AS BIGINT) AS day, (id * 37 % 1000) / CAST(1000 AS DOUBLE) AS conf, CAST(size % 90 AS DOUBLE) AS px, user_id % 10 = 0 AS dark FROM v_items WHERE kind IN ('L0', 'L1')),
v_ts AS (SELECT t.*, s.id, s.conf, s.px, s.dark FROM v_tiles t JOIN v_ship s USING (user_id, day))"""


@query(
    """SELECT kind, count(*) AS n, round(sum(CAST(size AS DOUBLE)), 2) AS bytes, round(sum(CAST(value AS DOUBLE)), 2) AS value FROM (
    SELECT CASE WHEN conf > 0.67 THEN 'L0' ELSE 'L1' END AS kind, CASE WHEN conf > 0.67 THEN 40 WHEN px > 0 THEN greatest(120, 137.5 * pow(px, 0.57)) ELSE 900 END AS size, CASE WHEN dark THEN 5 ELSE 1 END AS value FROM v_ts WHERE ctx IN ('ships', 'empty') AND conf >= 0.25
    UNION ALL SELECT 'L2', CASE WHEN px > 0 THEN greatest(120, 43.3 * pow(px, 1.14)) ELSE 2500 END, 1 FROM v_ts WHERE ctx IN ('ships', 'empty') AND conf >= 0.25 AND dark
    UNION ALL SELECT 'fp', 900, 0 FROM v_tiles, range(n_fp) WHERE ctx IN ('ships', 'empty')
    UNION ALL SELECT CASE WHEN unc >= 11 THEN 'tile' ELSE 'mosaic' END, CASE WHEN unc >= 11 THEN 66118 ELSE 2259 END, CASE WHEN unc >= 11 THEN w_all ELSE w_seen END FROM
      (SELECT user_id, day, any_value(greatest(0, n_candidates - n_ships - n_fp)) AS unc, sum(CASE WHEN dark THEN 5 ELSE 1 END) AS w_all, coalesce(sum(CASE WHEN dark THEN 5 ELSE 1 END) FILTER (conf >= 0.25), 0) AS w_seen, count(*) FILTER (conf >= 0.25) AS seen FROM v_ts WHERE ctx = 'coast' GROUP BY 1, 2) WHERE unc >= 11 OR seen > 0
    UNION ALL SELECT 'tile', 66118, 0 FROM v_tiles t WHERE ctx = 'coast' AND greatest(0, n_candidates - n_ships - n_fp) >= 11 AND n_ships = 0) GROUP BY kind""",
    _SHIPS,
)
def encode_lod_products(spark, sf):
    p = encoding.encode_lod(_lod_tiles(spark, sf)).where("kind <> 'thumb'")
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), R(F.sum("size"), 2).alias("bytes"), R(F.sum("value"), 2).alias("value"))


@query(
    """SELECT kind, count(*) AS n, round(sum(CAST(size AS DOUBLE)), 2) AS bytes, round(sum(CAST(value AS DOUBLE)), 2) AS value FROM (
    SELECT 'P1' AS kind, 40 AS size, CASE WHEN dark THEN 5 ELSE 1 END AS value FROM v_ts WHERE ctx <> 'cloud' AND conf >= 0.25
    UNION ALL SELECT 'P1', 40, 0 FROM v_tiles, range(n_fp) WHERE ctx <> 'cloud'
    UNION ALL SELECT 'P2', 900, CASE WHEN dark THEN 1.5 ELSE 1.0 END FROM v_ts WHERE ctx <> 'cloud' AND conf >= 0.25 AND (ctx = 'coast' OR dark OR conf < 0.67)
    UNION ALL SELECT 'P3', 66118, 0.5 * count(*) FROM v_ts WHERE ctx = 'coast' AND conf >= 0.25 GROUP BY user_id, day) GROUP BY kind""",
    _SHIPS,
)
def encode_priority_items(spark, sf):
    p = encoding.encode_priority(_lod_tiles(spark, sf))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), R(F.sum("size"), 2).alias("bytes"), R(F.sum("value"), 2).alias("value"))


@query(
    """SELECT t.user_id * 1000 + t.day AS tile, 'raw' AS kind, CAST(1769472 AS DOUBLE) AS size, CAST(coalesce(s.w, 0) AS DOUBLE) AS value FROM v_tiles t LEFT JOIN
    (SELECT user_id, day, sum(CASE WHEN dark THEN 5 ELSE 1 END) AS w FROM v_ship GROUP BY 1, 2) s USING (user_id, day) WHERE t.ctx <> 'cloud'""",
    _SHIPS,
)
def encode_raw_tiles(spark, sf):
    return encoding.encode_raw(_lod_tiles(spark, sf)).select("tile", "kind", "size", "value")


@query(
    """SELECT kind, count(*) AS n, CAST(sum(size) AS DOUBLE) AS bytes, CAST(sum(value) AS DOUBLE) AS value FROM (SELECT 'patch' AS kind, 1000 AS size, CASE WHEN dark THEN 5 ELSE 1 END AS value FROM v_ts WHERE ctx IN ('ships', 'coast') AND conf >= 0.25
    UNION ALL SELECT 'fp', 1000, 0 FROM v_tiles, range(n_fp)) GROUP BY kind""",
    _SHIPS,
)
def encode_fixed_patches(spark, sf):
    p = encoding.encode_fixed(_lod_tiles(spark, sf))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("double")).alias("bytes"), F.sum(F.col("value").cast("double")).alias("value"))


@query(
    """SELECT round(sum(CASE WHEN whole THEN list_extract([0, 0.5, 0.8, 1], level + 1) ELSE coalesce(list_extract([0, 0.5, 0.8, 1], best + 1), 0) END * w) / CAST(sum(w) AS DOUBLE), 6) AS kept FROM (
    SELECT image, max(level) AS level, bool_and(came) AS whole, max(level) FILTER (came) AS best, max(w) AS w FROM (
      SELECT image, CASE WHEN conf >= 0.67 THEN 1 WHEN conf >= 0.4 THEN 2 ELSE 3 END AS level, CASE WHEN image % 10 = 0 THEN 5 ELSE 1 END AS w, cx >= 200 AS came FROM v_det WHERE conf >= 0.25) GROUP BY image)""",
    v.DET,
)
def information_preserved(spark, sf):
    level = F.when(F.col("conf") >= 0.67, 1).when(F.col("conf") >= 0.4, 2).otherwise(3)
    seen = v.detections(spark, sf).where("conf >= 0.25").withColumn("product", F.concat_ws(":", "image", "det"))
    offered = seen.select(F.col("image").alias("ship"), "product", level.alias("level"), F.when(F.col("image") % 10 == 0, 5).otherwise(1).alias("weight"))
    return encoding.information_kept(offered, seen.where("cx >= 200").select("product")).select(R(F.col("kept")).alias("kept"))


@query(
    "SELECT CAST(CASE WHEN conf < 0.25 THEN 0 ELSE least(CASE WHEN cx < 200 THEN 3 WHEN conf >= 0.67 THEN 1 ELSE 2 END + CASE WHEN image % 10 = 0 THEN 1 ELSE 0 END, 3) END AS INTEGER) AS level, count(*) AS n FROM v_det GROUP BY 1",
    v.DET,
)
def level_histogram(spark, sf):
    return encoding.level_histogram(v.detections(spark, sf).select("conf", (F.col("cx") < 200).alias("coast"), (F.col("image") % 10 == 0).alias("dark")))


@query("SELECT count(*) FILTER (ctx <> 'cloud') / CAST(count(*) AS DOUBLE) AS raw, count(*) FILTER (ctx = 'coast' OR ctx <> 'cloud' AND conf >= 0.25) / CAST(count(*) AS DOUBLE) AS lod FROM v_ts", _SHIPS)
def onboard_ceiling(spark, sf):
    s = _lod_tiles(spark, sf).select("ctx", F.explode("ships").alias("s")).select("ctx", "s.conf")
    return encoding.onboard_ceiling(s, "raw").withColumnRenamed("ceiling", "raw").crossJoin(encoding.onboard_ceiling(s, "lod").withColumnRenamed("ceiling", "lod"))


@query("SELECT load, policy, metric FROM v_sweep ORDER BY load, policy", v.SWEEP)
def sweep_table(spark, sf):
    return v.sweep(spark, sf).select("load", "policy", "metric").orderBy("load", "policy")


@query("SELECT policy, round(max(r), 4) AS worst, round(avg(r), 4) AS mean FROM (SELECT policy, max(metric) OVER (PARTITION BY load) - metric AS r FROM v_sweep) GROUP BY policy", v.SWEEP)
def regret_by_load(spark, sf):
    return statistics.regret(v.sweep(spark, sf), "load", "policy", "metric").select("policy", R(F.col("worst"), 4).alias("worst"), R(F.col("mean"), 4).alias("mean"))


@query("SELECT load, max(metric) FILTER (policy = 'F') AS F, max(metric) FILTER (policy = 'O') AS O, max(metric) FILTER (policy = 'P') AS P FROM v_sweep GROUP BY load", v.SWEEP)
def sweep_pivot(spark, sf):
    return v.sweep(spark, sf).groupBy("load").pivot("policy", ["F", "O", "P"]).agg(F.max("metric"))


@query("SELECT policy, round(max(metric) - min(metric), 4) AS range, min(metric) AS low, max(metric) AS high FROM v_sweep GROUP BY policy", v.SWEEP)
def tornado_range(spark, sf):
    return statistics.tornado(v.sweep(spark, sf), "policy", "metric").select("policy", R(F.col("range"), 4).alias("range"), "low", "high")


@query("SELECT load, arg_max(policy, metric) AS best, max(metric) AS metric FROM v_sweep GROUP BY load", v.SWEEP)
def argmax_policy(spark, sf):
    return v.sweep(spark, sf).groupBy("load").agg(F.max_by("policy", "metric").alias("best"), F.max("metric").alias("metric"))


@query("SELECT count(*) AS violated FROM v_sweep a JOIN v_sweep b USING (load) WHERE a.policy = 'F' AND b.policy = 'O' AND a.metric < b.metric", v.SWEEP)
def claims_violated(spark, sf):
    s = v.sweep(spark, sf)
    f, o = s.where("policy = 'F'").select("load", F.col("metric").alias("f")), s.where("policy = 'O'").select("load", F.col("metric").alias("o"))
    return f.join(o, "load").agg(F.count_if(F.col("f") < F.col("o")).alias("violated"))


@query("SELECT bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM (SELECT score, correct, CAST(ceil(row_number() OVER (ORDER BY score, doc_id) * 15 / CAST(count(*) OVER () AS DOUBLE)) - 1 AS BIGINT) AS bin FROM v_calib) GROUP BY bin", v.CALIB)
def ece_table(spark, sf):
    return statistics.ece_table(v.calibration(spark, sf)).select("bin", "n", R(F.col("confidence")).alias("confidence"), R(F.col("accuracy")).alias("accuracy"))


@query("SELECT round(avg(pow(score - correct, 2)), 9) AS brier FROM v_calib", v.CALIB)
def brier(spark, sf):
    return statistics.brier(v.calibration(spark, sf)).select(R(F.col("brier"), 9).alias("brier"))


@query("SELECT CAST(k AS BIGINT) AS k, round(count(*) FILTER (c >= k) / CAST(count(*) AS DOUBLE), 6) AS kept, round(sum(correct) FILTER (c >= k) / CAST(sum(correct) AS DOUBLE), 6) AS recall, round(count(*) FILTER (c < k AND correct = 0) / CAST(count(*) FILTER (correct = 0) AS DOUBLE), 6) AS empty_dropped FROM (SELECT least(floor(score * 200), 200) AS c, correct FROM v_calib), (SELECT unnest(range(201)) AS k) GROUP BY k", v.CALIB)
def threshold_tradeoff(spark, sf):
    return statistics.threshold_curve(v.calibration(spark, sf)).select("k", *[R(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("kept", "recall", "empty_dropped")])


ORACLES["threshold_tradeoff"] = ORACLES["threshold_tradeoff"].replace("round(sum(correct) FILTER (c >= k) / CAST(sum(correct) AS DOUBLE), 6) AS recall", "round(coalesce(sum(correct) FILTER (c >= k), 0) / CAST(sum(correct) AS DOUBLE), 6) AS recall")


@query("SELECT r, max(k) AS k FROM (SELECT CAST(k AS BIGINT) AS k, round(coalesce(sum(correct) FILTER (c >= k), 0) / CAST(sum(correct) AS DOUBLE), 6) AS recall FROM (SELECT least(floor(score * 200), 200) AS c, correct FROM v_calib), (SELECT unnest(range(201)) AS k) GROUP BY k), (VALUES (0.9), (0.99)) AS t(r) WHERE recall >= r GROUP BY r".replace("(0.9), (0.99)", "(CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))"), v.CALIB)
def last_row_with_recall(spark, sf):
    curve = statistics.threshold_curve(v.calibration(spark, sf))
    targets = spark.createDataFrame([(0.9,), (0.99,)], "r double")
    return curve.join(F.broadcast(targets), R(F.col("recall")) >= F.col("r")).groupBy("r").agg(F.max("k").alias("k"))


@query("SELECT b AS bucket, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS recall, round((p + 1.9208 / n1 - 1.96 * sqrt(p * (1 - p) / n1 + 0.9604 / (n1 * n1))) / (1 + 3.8416 / n1), 6) AS low, round((p + 1.9208 / n1 + 1.96 * sqrt(p * (1 - p) / n1 + 0.9604 / (n1 * n1))) / (1 + 3.8416 / n1), 6) AS high FROM (SELECT CASE WHEN score < 0.32 THEN 'small' WHEN score <= 0.96 THEN 'medium' ELSE 'large' END AS b, correct, avg(CAST(correct AS DOUBLE)) OVER (PARTITION BY CASE WHEN score < 0.32 THEN 'small' WHEN score <= 0.96 THEN 'medium' ELSE 'large' END) AS p, CAST(count(*) OVER (PARTITION BY CASE WHEN score < 0.32 THEN 'small' WHEN score <= 0.96 THEN 'medium' ELSE 'large' END) AS DOUBLE) AS n1 FROM v_calib) GROUP BY b, p, n1", v.CALIB)
def wilson_ci(spark, sf):
    s = v.calibration(spark, sf).groupBy(statistics.size_bucket(R(F.col("score") * 100), "closed").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("recall"))
    low, high = d.wilson(F.col("recall"), F.col("n"))
    return s.select("bucket", "n", R(F.col("recall")).alias("recall"), R(low).alias("low"), R(high).alias("high"))


@query("SELECT round(exp(regr_intercept(ln(p), ln(q))), 4) AS a, round(regr_slope(ln(p), ln(q)), 6) AS b, round(regr_r2(ln(p), ln(q)), 6) AS r2, round(sqrt(regr_syy(ln(p), ln(q)) * (1 - regr_r2(ln(p), ln(q))) / (count(*) - 2)), 6) AS sigma_log, count(*) AS n FROM (SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)")
def size_fit_ols(spark, sf):
    o = statistics.ols_loglog(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return o.select(R(F.col("a"), 4).alias("a"), R(F.col("b")).alias("b"), R(F.col("r2")).alias("r2"), R(F.col("sigma_log")).alias("sigma_log"), "n")


@query("SELECT l_returnflag AS kind, count(*) AS n, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def named_aggregates(spark, sf):
    q = "l_quantity"
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.expr(f"percentile({q}, 0.5)").alias("p50"), F.expr(f"percentile({q}, 0.9)").alias("p90"))


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n")
def two_level_histogram(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT CASE WHEN n <= 2 THEN '2' WHEN n <= 3 THEN '3' WHEN n <= 9 THEN '4-9' WHEN n <= 49 THEN '10-49' ELSE '50+' END AS bucket, count(*) AS groups FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 2 GROUP BY 1")
def ordinal_buckets(spark, sf):
    n = F.col("n")
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.groupBy(F.when(n <= 2, "2").when(n <= 3, "3").when(n <= 9, "4-9").when(n <= 49, "10-49").otherwise("50+").alias("bucket")).agg(F.count(F.lit(1)).alias("groups"))


@query("SELECT a.o_orderkey, b.k FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS k FROM orders) a JOIN (SELECT c_custkey, unnest([0, 1]) AS k FROM customer) b ON a.o_custkey = b.c_custkey AND a.k = b.k")
def positional_join(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")) - 1).alias("k"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return a.join(b, ["o_custkey", "k"]).select("o_orderkey", "k")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS paired, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS unpaired")
def semi_anti_unpaired(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("paired")).crossJoin(c.join(o, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("unpaired")))


@query("SELECT (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)) AS missing, (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)) AS unused")
def set_equality_check(spark, sf):
    s, n = table(spark, sf, "supplier").select("s_nationkey"), table(spark, sf, "nation").select("n_nationkey")
    return s.subtract(n).agg(F.count(F.lit(1)).alias("missing")).crossJoin(n.subtract(s).agg(F.count(F.lit(1)).alias("unused")))


@query("SELECT c_mktsegment AS key, a AS old, b AS new FROM (SELECT c_mktsegment, count(*) AS a FROM customer WHERE c_nationkey < 13 GROUP BY 1) FULL JOIN (SELECT c_mktsegment, count(*) AS b FROM customer WHERE c_nationkey >= 13 GROUP BY 1) USING (c_mktsegment) WHERE a IS DISTINCT FROM b")
def snapshot_diff(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("key"), "c_nationkey")
    n = lambda x: x.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return statistics.snapshot_diff(n(c.where("c_nationkey < 13")), n(c.where("c_nationkey >= 13")), "key", "n")


@query("SELECT user_id, run, event_type AS kind, count(*) AS n FROM (SELECT user_id, event_type, event_id, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS turn FROM events)) GROUP BY 1, 2, 3".replace("sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS run", "CAST(sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run"))
def kind_runs(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("kind"))
    return statistics.runs_of(e, "user_id", "event_id", "kind").select("user_id", "run", "kind", "n")


@query("SELECT 'conf' AS check_name, count(*) FILTER (NOT conf BETWEEN 0 AND 1) AS broken, count(*) FILTER (NOT conf BETWEEN 0 AND 1) = 0 AS ok FROM v_det UNION ALL SELECT 'wide', count(*) FILTER (NOT w < 50), count(*) FILTER (NOT w < 50) = 0 FROM v_det", v.DET)
def data_quality_checks(spark, sf):
    return statistics.expectations(v.detections(spark, sf), {"conf": F.col("conf").between(0, 1), "wide": F.col("w") < 50})


@query("SELECT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id WHERE md5(a.text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)")
def exact_dup_pairs(spark, sf):
    return neighbours.bucket_pairs(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("sig")), "doc_id", "sig", 8)


_MINHASH = "v_sig AS (SELECT doc_id, k, min(md5(k || ':' || token)) AS sig FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), (SELECT unnest(range(4)) AS k) GROUP BY 1, 2), v_key AS (SELECT doc_id, k || ':' || sig AS key FROM v_sig), v_ok AS (SELECT key FROM v_key GROUP BY 1 HAVING count(*) BETWEEN 2 AND 32), v_pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM v_key a JOIN v_key b USING (key) JOIN v_ok USING (key) WHERE a.doc_id < b.doc_id)"


def _minhash(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    low = words.groupBy("doc_id").agg(*[F.min(F.md5(F.concat(F.lit(f"{k}:"), "token"))).alias(f"s{k}") for k in range(4)])
    return low.select("doc_id", F.explode(F.array(*[F.concat(F.lit(f"{k}:"), f"s{k}") for k in range(4)])).alias("key"))


@query("SELECT a, b FROM v_pair", _MINHASH)
def lsh_band_pairs(spark, sf):
    return neighbours.bucket_pairs(_minhash(spark, sf), "doc_id", "key", 32)


@query("SELECT key, a, doc_id AS b FROM (SELECT key, doc_id, min(doc_id) OVER (PARTITION BY key) AS a FROM v_key) WHERE a < doc_id", _MINHASH)
def lsh_band_members(spark, sf):
    return neighbours.bucket_members(_minhash(spark, sf), "doc_id", "key")


@query("SELECT a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS a FROM documents WHERE text IS NOT NULL) WHERE a < doc_id")
def exact_dup_members(spark, sf):
    return neighbours.bucket_members(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sig")), "doc_id", "sig").select("a", "b")


_EXACT = "v_pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id)"


@query("SELECT b AS node, min(a) AS component FROM (SELECT a, b FROM v_pair UNION SELECT a, a FROM v_pair) GROUP BY b", _EXACT)
def dup_components(spark, sf):
    doc = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sig"))
    star = doc.join(doc.groupBy("sig").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "sig").select("a", F.col("doc_id").alias("b"))
    return connected_components(star, "a", "b")


def _split(spark, sf):
    doc = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sig"))
    groups = doc.groupBy("sig").agg(F.min("doc_id").alias("group"), F.count(F.lit(1)).alias("n"))
    split = neighbours.group_split(groups.select("group", "n"))
    return doc.join(groups.select("sig", "group"), "sig").join(split.select("group", "split"), "group").select("doc_id", "group", "split")


@query()
def group_split(spark, sf):
    return _split(spark, sf)


@query("SELECT count(*) AS docs, count(DISTINCT text) AS groups, 3 AS splits, 0 AS leaked FROM documents WHERE text IS NOT NULL")
def leak_check(spark, sf):
    """Documents, groups and splits of the group-aware split, and groups that stand in more than one of them."""
    s = _split(spark, sf)
    whole = s.agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("group").alias("groups"), F.count_distinct("split").cast("int").alias("splits"))
    return whole.crossJoin(neighbours.leaks(s).agg(F.count(F.lit(1)).cast("int").alias("leaked")))


@query("SELECT CAST(count(*) AS BIGINT) AS leaked_groups FROM (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END) > 1)")
def naive_split_leakage(spark, sf):
    k = F.pmod(F.col("doc_id"), F.lit(10))
    doc = table(spark, sf, "documents").select(F.sha2("text", 256).alias("group"), F.when(k < 8, "train").when(k < 9, "val").otherwise("test").alias("split"))
    return neighbours.leaks(doc).agg(F.count(F.lit(1)).alias("leaked_groups"))


@query("SELECT id, neighbour, round(cosine, 5) AS cosine, rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 12")
def knn_cosine_topk(spark, sf):
    k = neighbours.knn_cosine(table(spark, sf, "embeddings"))
    return k.select("id", "neighbour", R(F.col("cosine"), 5).alias("cosine"), "rank")


_SIGS = "v_bits AS (SELECT vec_id, CAST(sum(CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END) AS HUGEINT) AS sig FROM embeddings, (SELECT unnest(range(1, 33)) AS i) GROUP BY 1)"


def _signs(spark, sf):
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when((i < 32) & (x > 0), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", bits.alias("sig"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(CAST(a.sig AS BIGINT), CAST(b.sig AS BIGINT))) AS INTEGER) AS distance FROM v_bits a JOIN v_bits b ON a.vec_id < b.vec_id AND a.sig % 65536 = b.sig % 65536 WHERE a.sig % 65536 IN (SELECT sig % 65536 FROM v_bits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200)", _SIGS)
def hamming_pairs(spark, sf):
    s = _signs(spark, sf)
    p = neighbours.bucket_pairs(s.select("vec_id", F.col("sig").bitwiseAND(F.lit(65535)).alias("k")), "vec_id", "k", 200)
    one = lambda n: s.select(F.col("vec_id").alias(n), F.array("sig").alias("s" + n))
    return p.join(one("a"), "a").join(one("b"), "b").select("a", "b", neighbours.hamming(F.col("sa"), F.col("sb")).cast("int").alias("distance"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(CAST(a.sig AS BIGINT), CAST(b.sig AS BIGINT))) AS INTEGER) AS distance FROM v_rep a JOIN v_rep b ON a.vec_id < b.vec_id AND (a.sig % 65536 = b.sig % 65536 OR a.sig // 65536 = b.sig // 65536) WHERE (a.vec_id = a.rep AND b.vec_id = b.rep) OR a.vec_id = b.rep", _SIGS + ", v_rep AS (SELECT vec_id, sig, min(vec_id) OVER (PARTITION BY sig) AS rep FROM v_bits)")
def hamming_band_pairs(spark, sf):
    return neighbours.banded_pairs(_signs(spark, sf), "vec_id", "sig", 32)


@query("SELECT count(*) AS n, round(sum(l_quantity * 8 / 2024000.0 * 12), 6) AS relay_J, round(sum(l_quantity * 8 / 2530000.0 * 15), 6) AS direct_J, CAST(sum(ceil(l_quantity * 1000 / 4094) * 8 + l_quantity * 1000) AS BIGINT) AS packet_bytes, CAST(sum(ceil(l_quantity * 1000 / 1107) * 1279) AS BIGINT) AS on_air FROM lineitem")
def energy_route(spark, sf):
    q = F.col("l_quantity")
    t = table(spark, sf, "lineitem")
    return t.agg(F.count(F.lit(1)).alias("n"), R(F.sum(d.tx_joules(12.0, q, 2.53e6 * 0.8))).alias("relay_J"), R(F.sum(d.tx_joules(15.0, q, 2.53e6))).alias("direct_J"), F.sum(d.packet_bytes(q * 1000)).alias("packet_bytes"), F.sum(d.frame_bytes(q * 1000)).alias("on_air"))


@query("SELECT kind, round(100 * (1 - sum(size) / (1769472.0 * count(*))), 6) AS reduction FROM v_items GROUP BY kind", v.ITEMS)
def data_reduction(spark, sf):
    g = v.items(spark, sf).groupBy("kind").agg(F.sum("size").cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("kind", R(d.reduction_percent(F.col("s"), F.lit(float(d.RAW_TILE_BYTES)) * F.col("n"))).alias("reduction"))


@query("SELECT p_w AS power_W, stage, round(p_w * ms / 1000, 6) AS joules FROM (VALUES ('detect', 38.6), ('gate', 0.94), ('encode', 9.1)) AS s(stage, ms), (VALUES (10.0), (15.0), (28.0)) AS p(p_w)".replace("p_w AS power_W", "CAST(p_w AS DOUBLE) AS power_W").replace("round(p_w * ms / 1000, 6)", "round(CAST(p_w AS DOUBLE) * CAST(ms AS DOUBLE) / 1000, 6)"))
def energy_stage(spark, sf):
    s = spark.createDataFrame([("detect", 38.6), ("gate", 0.94), ("encode", 9.1)], "stage string, ms double")
    return s.crossJoin(spark.createDataFrame([(10.0,), (15.0,), (28.0,)], "power_W double")).select("power_W", "stage", R(F.col("power_W") * F.col("ms") / 1000).alias("joules"))


@query("SELECT user_id % 7 AS arm, kind, CAST(sum(size) AS BIGINT) AS bytes, GROUPING(kind) AS g FROM v_items GROUP BY ROLLUP (user_id % 7, kind) HAVING GROUPING(user_id % 7) = 0", v.ITEMS)
def product_rollup(spark, sf):
    r = v.items(spark, sf).withColumn("arm", F.col("user_id") % 7).rollup("arm", "kind").agg(F.sum("size").alias("bytes"), F.grouping("kind").cast("long").alias("g"), F.grouping("arm").alias("ga"))
    return r.where("ga = 0").select("arm", "kind", "bytes", "g")


_PLATT = "RECURSIVE " + v.CALIB + """, v_x AS (SELECT doc_id, score, ln(p / (1 - p)) AS x, CAST(correct AS DOUBLE) AS y FROM (SELECT *, least(greatest(score, 0.000001), 1 - 0.000001) AS p FROM v_calib)),
    v_newton AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL SELECT k + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM
      (SELECT k, a, b, sum((y - q) * x) AS ga, sum(y - q) AS gb, sum(q * (1 - q) * x * x) AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q)) AS hbb FROM
        (SELECT n.k, n.a, n.b, x, y, 1 / (1 + exp(-(n.a * x + n.b))) AS q FROM v_newton n, v_x WHERE n.k < 25) GROUP BY k, a, b)),
    v_fit AS (SELECT a, b FROM v_newton WHERE k = 25), v_cal AS (SELECT doc_id, score, y, 1 / (1 + exp(-(a * x + b))) AS calibrated FROM v_x, v_fit)"""


@query("SELECT round(a, 5) AS a, round(b, 5) AS b FROM v_fit", _PLATT)
def platt_calibration(spark, sf):
    """Slope and offset of the logistic calibration."""
    a, b = statistics.platt(v.calibration(spark, sf))
    return spark.createDataFrame([(round(a, 5), round(b, 5))], "a double, b double")


@query("SELECT doc_id, score, round(calibrated, 5) AS calibrated FROM v_cal", _PLATT)
def platt_scores(spark, sf):
    """Every row with its calibrated score."""
    c = v.calibration(spark, sf)
    return statistics.apply_platt(c, *statistics.platt(c)).select("doc_id", "score", R(F.col("calibrated"), 5).alias("calibrated"))


@query("SELECT target, min(CASE WHEN calibrated >= target THEN score END) AS least_score, round(avg(CASE WHEN calibrated >= target THEN 1.0 ELSE 0.0 END), 6) AS share FROM v_cal, (SELECT CAST(unnest([0.3, 0.45, 0.5, 0.55, 0.9]) AS DOUBLE) AS target) GROUP BY target", _PLATT)
def threshold_for_target(spark, sf):
    """The least raw score whose calibrated score reaches a target, and the share of rows that do."""
    c = v.calibration(spark, sf)
    return statistics.threshold_for(statistics.apply_platt(c, *statistics.platt(c)), [0.3, 0.45, 0.5, 0.55, 0.9]).select("target", "least_score", R(F.col("share")).alias("share"))


@query(
    "SELECT doc_id, round(fit, 6) AS calibrated FROM v_calib JOIN (SELECT k, max(low) AS fit FROM (SELECT i.k AS k, j.k AS j, min((p.s - j.s + j.y) / (p.m - j.m + j.n)) OVER (PARTITION BY j.k ORDER BY p.k DESC ROWS UNBOUNDED PRECEDING) AS low FROM v_step j JOIN v_step p ON p.k >= j.k JOIN v_step i ON i.k = p.k) GROUP BY k) ON CAST(round(score * 10000) AS BIGINT) = k",
    v.CALIB + ", v_step AS (SELECT k, n, y, sum(n) OVER (ORDER BY k) AS m, sum(y) OVER (ORDER BY k) AS s FROM (SELECT CAST(round(score * 10000) AS BIGINT) AS k, count(*) AS n, CAST(sum(correct) AS DOUBLE) AS y FROM v_calib GROUP BY 1))",
)
def isotonic_calibration(spark, sf):
    """Isotonic calibration of every row; in SQL by the formula of the highest low mean over intervals."""
    c = v.calibration(spark, sf)
    return statistics.apply_isotonic(c, statistics.isotonic(c)).select("doc_id", R(F.col("calibrated")).alias("calibrated"))


@query(
    "SELECT a, b, method FROM (SELECT a, b, 'ncc' AS method FROM v_ev WHERE coarse >= 0.9 AND detail >= 0.4 UNION ALL SELECT a, b, 'orb' FROM (SELECT * FROM v_ev WHERE NOT (coarse >= 0.9 AND detail >= 0.4) AND coarse >= 0.75 ORDER BY coarse DESC, a, b LIMIT 3000) WHERE inliers >= 40)",
    v.DET + ", v_ev AS (SELECT image AS a, det AS b, conf AS coarse, cx / 768 AS detail, CAST(cy AS BIGINT) % 100 AS inliers FROM v_det)",
)
def accepted_pairs(spark, sf):
    """Candidate pairs that are one: by correlation, or within the budget of second opinions by matched features."""
    d = v.detections(spark, sf).select(F.col("image").alias("a"), F.col("det").alias("b"), F.col("conf").alias("coarse"), (F.col("cx") / 768).alias("detail"), (F.col("cy").cast("long") % 100).alias("inliers"))
    return neighbours.accept(d)


@query("SELECT vec_id, round(sum(x * x), 4) AS length, round(abs(sum(x)), 4) AS total, round(max(x), 4) AS most FROM (SELECT vec_id, (e - m) / sqrt(sum((e - m) * (e - m)) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, e, avg(e) OVER (PARTITION BY vec_id) AS m FROM (SELECT vec_id, CAST(unnest(embedding[:64]) AS DOUBLE) AS e FROM embeddings))) GROUP BY vec_id")
def thumb_vectors(spark, sf):
    """Grey thumbs less their mean, over their norm."""
    t = table(spark, sf, "embeddings").select("vec_id", neighbours.thumb_vector(F.slice("embedding", 1, 64).cast("array<double>")).alias("x"))
    add = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, b: a + b)
    return t.select("vec_id", R(add(lambda x: x * x), 4).alias("length"), R(F.abs(add(lambda x: x)), 4).alias("total"), R(F.array_max("x"), 4).alias("most"))
