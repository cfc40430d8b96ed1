"""The driver's tables in the shapes of the domain, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.session import table

#: Five daily passes: rise offset in seconds, duration in seconds, capacity in bytes.
DAILY_PASSES = ((3600, 420, 300_000), (9000, 540, 450_000), (36_000, 480, 380_000), (43_200, 600, 520_000), (79_200, 300, 200_000))
EPOCH = "2024-01-01 00:00:00"


def cents(column):
    return F.round(F.col(column) * F.lit(100)).cast("long") if isinstance(column, str) else F.round(column * F.lit(100)).cast("long")


def items(spark, sf: str) -> DataFrame:
    """Schedulable products from events."""
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "user_id", "value")
    kind = F.create_map(*[F.lit(x) for p in (("signup", "L0"), ("click", "L1"), ("view", "thumb"), ("purchase", "tile"), ("error", "fp")) for x in p])
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    out = e.select(F.col("event_id").alias("id"), us.alias("created_us"), kind[F.col("event_type")].alias("kind"), "user_id", F.coalesce(cents("value"), F.lit(0)).alias("c"))
    size = F.when(F.col("kind") == "L0", 40).when(F.col("kind") == "L1", 120 + F.col("c")).when(F.col("kind") == "thumb", 1000).when(F.col("kind") == "tile", 20000 + 10 * F.col("c")).otherwise(900)
    worth = F.when(F.col("kind").isin("L0", "L1"), F.when(F.col("user_id") % 10 == 0, 500).otherwise(100)).when(F.col("kind") == "thumb", 1).when(F.col("kind") == "tile", 300).otherwise(0)
    return out.select("id", "created_us", "kind", "user_id", size.cast("long").alias("size"), worth.cast("long").alias("value_c"), (F.col("kind") == "tile").alias("progressive"))


ITEMS = """v_items AS (SELECT id, created_us, kind, user_id,
  CAST(CASE kind WHEN 'L0' THEN 40 WHEN 'L1' THEN 120 + c WHEN 'thumb' THEN 1000 WHEN 'tile' THEN 20000 + 10 * c ELSE 900 END AS BIGINT) AS size,
  CAST(CASE WHEN kind IN ('L0','L1') THEN CASE WHEN user_id % 10 = 0 THEN 500 ELSE 100 END WHEN kind = 'thumb' THEN 1 WHEN kind = 'tile' THEN 300 ELSE 0 END AS BIGINT) AS value_c,
  kind = 'tile' AS progressive FROM (SELECT event_id AS id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS created_us, user_id,
  CASE event_type WHEN 'signup' THEN 'L0' WHEN 'click' THEN 'L1' WHEN 'view' THEN 'thumb' WHEN 'purchase' THEN 'tile' WHEN 'error' THEN 'fp' END AS kind,
  coalesce(CAST(round(value * 100) AS BIGINT), 0) AS c FROM events))"""


def passes(spark, days: int = 31) -> DataFrame:
    """The contact plan: the five daily passes on every day, numbered by rise."""
    daily = spark.createDataFrame(list(DAILY_PASSES), "rise long, dur long, capacity long")
    return spark.range(days).crossJoin(F.broadcast(daily)).select(
        (F.col("id") * 5 + F.when(F.col("rise") == 3600, 0).when(F.col("rise") == 9000, 1).when(F.col("rise") == 36000, 2).when(F.col("rise") == 43200, 3).otherwise(4)).cast("long").alias("pass_id"),
        (F.col("id") * 86400 + F.col("rise")).alias("rise_s"), (F.col("id") * 86400 + F.col("rise") + F.col("dur")).alias("set_s"), "capacity",
    )


PASSES = "v_passes AS (SELECT CAST(d * 5 + k AS BIGINT) AS pass_id, CAST(d * 86400 + rise AS BIGINT) AS rise_s, CAST(d * 86400 + rise + dur AS BIGINT) AS set_s, CAST(cap AS BIGINT) AS capacity FROM (SELECT unnest(range(31)) AS d), (VALUES " + ", ".join(
    f"({k}, {r}, {d}, {c})" for k, (r, d, c) in enumerate(DAILY_PASSES)
) + ") AS p(k, rise, dur, cap))"


def boxes(spark, sf: str) -> DataFrame:
    """Detections from line items: centre-form boxes, numbered within their image."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    qty = F.col("l_quantity").cast("double")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return li.select(
        F.col("l_orderkey").cast("long").alias("image"), F.row_number().over(w).cast("long").alias("det"), F.col("l_linenumber").cast("long").alias("line"),
        ((F.col("l_partkey") * 37) % 768).cast("double").alias("cx"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 11) % 768).cast("double").alias("cy"),
        (qty + 8).alias("w"), ((qty * 3) % 41 + 8).alias("h"), ((cents("l_extendedprice") % 1000) / F.lit(1000.0).cast("double")).alias("conf"),
        (cents("l_discount") % 11).cast("double").alias("shift"),
    )


DET = """v_box AS (SELECT CAST(l_orderkey AS BIGINT) AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS det,
  CAST(l_linenumber AS BIGINT) AS line, CAST((l_partkey * 37) % 768 AS DOUBLE) AS cx, CAST((l_suppkey * 53 + l_linenumber * 11) % 768 AS DOUBLE) AS cy,
  CAST(l_quantity AS DOUBLE) + 8 AS w, (CAST(l_quantity AS DOUBLE) * 3) % 41 + 8 AS h, (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) / CAST(1000 AS DOUBLE) AS conf,
  CAST(CAST(round(l_discount * 100) AS BIGINT) % 11 AS DOUBLE) AS shift FROM lineitem),
v_det AS (SELECT image, det, cx, cy, w, h, conf FROM v_box), v_gt AS (SELECT image, det AS gt, cx + shift AS cx, cy + shift AS cy, w, h FROM v_box WHERE line % 2 = 1)"""


def detections(spark, sf: str) -> DataFrame:
    return boxes(spark, sf).select("image", "det", "cx", "cy", "w", "h", "conf")


def truths(spark, sf: str) -> DataFrame:
    return boxes(spark, sf).where("line % 2 = 1").select("image", F.col("det").alias("gt"), (F.col("cx") + F.col("shift")).alias("cx"), (F.col("cy") + F.col("shift")).alias("cy"), "w", "h")


def tiles(spark, sf: str) -> DataFrame:
    """A tile per user and day, with its context and what was found on it."""
    e = items(spark, sf).withColumn("day", F.floor(F.col("created_us") / 86_400_000_000).cast("long"))
    k = F.pmod(F.col("user_id") * 7 + F.col("day"), F.lit(20))
    ctx = F.when(k < 3, "cloud").when(k < 7, "ships").when(k < 8, "coast").otherwise("empty")
    return e.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("kind").isin("L0", "L1")).alias("n_ships"), F.count_if(F.col("kind") == "fp").alias("n_fp"), F.min("created_us").alias("t_us"), F.sum("size").alias("bytes")
    ).withColumns({"ctx": ctx, "gate_score": F.pmod(F.col("user_id") * 13 + F.col("day") * 7, F.lit(100)) / F.lit(100.0).cast("double")})


TILES = ITEMS + """, v_tiles AS (SELECT *, CASE WHEN (user_id * 7 + day) % 20 < 3 THEN 'cloud' WHEN (user_id * 7 + day) % 20 < 7 THEN 'ships' WHEN (user_id * 7 + day) % 20 < 8 THEN 'coast' ELSE 'empty' END AS ctx,
  ((user_id * 13 + day * 7) % 100) / CAST(100 AS DOUBLE) AS gate_score FROM (SELECT user_id, CAST(floor(created_us / 86400000000) AS BIGINT) AS day, count(*) AS n_candidates, count(*) FILTER (kind IN ('L0','L1')) AS n_ships,
  count(*) FILTER (kind = 'fp') AS n_fp, min(created_us) AS t_us, CAST(sum(size) AS BIGINT) AS bytes FROM v_items GROUP BY 1, 2))"""


def calibration(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", ((F.col("n_chars") % 1000) / F.lit(1000.0).cast("double")).alias("score"), F.col("quality").cast("long").alias("correct"))


CALIB = "v_calib AS (SELECT doc_id, (n_chars % 1000) / CAST(1000 AS DOUBLE) AS score, CAST(quality AS BIGINT) AS correct FROM labels JOIN documents USING (doc_id))"


def sweep(spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("load"), F.col("o_orderstatus").alias("policy")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("metric"), F.count(F.lit(1)).alias("n"))


SWEEP = "v_sweep AS (SELECT o_orderpriority AS load, o_orderstatus AS policy, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS metric, count(*) AS n FROM orders GROUP BY 1, 2)"


def grey(vector):
    """The 64 by 64 greys of a vector's image: its numbers down, and those of the vector turned by 17 places across."""
    e = vector.cast("array<double>")
    return F.flatten(F.transform(e, lambda y: F.transform(F.concat(F.slice(e, 18, 47), F.slice(e, 1, 17)), lambda x: x * y)))


def images(spark, sf: str) -> DataFrame:
    """A grey image per vector."""
    return table(spark, sf, "embeddings").select("vec_id", grey(F.col("embedding")).alias("grey"), F.lit(64).alias("height"), F.lit(64).alias("width"))


# A hash of an image that is a product of two vectors is a product of two sums: ``v_low`` has, for the parts of a side that the
# windows take, the low terms of the cosine transform of 32 means.
IMAGES = """v_part AS (SELECT * FROM (VALUES (0, 0, 64), (1, 0, 38), (2, 25, 64), (3, 12, 51)) AS p(part, lo, hi)),
v_share AS (SELECT part, lo, j, i, greatest(0, least((i + 1) * (hi - lo) / CAST(32 AS DOUBLE), j + 1) - greatest(i * (hi - lo) / CAST(32 AS DOUBLE), j)) * 32 / (hi - lo) AS s
  FROM v_part, (SELECT unnest(range(64)) AS j), (SELECT unnest(range(32)) AS i) WHERE j < hi - lo),
v_coef AS (SELECT part, k, lo + j AS pos, sum(s * cos(pi() * (2 * i + 1) * k / 64) * CASE WHEN k = 0 THEN sqrt(1 / CAST(32 AS DOUBLE)) ELSE sqrt(2 / CAST(32 AS DOUBLE)) END) AS c FROM v_share, (SELECT unnest(range(8)) AS k) GROUP BY 1, 2, 3),
v_num AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
v_low AS (SELECT vec_id, part, k, sum(c * e) AS down, sum(c * turned) AS across FROM (SELECT a.vec_id, a.pos, a.e, b.e AS turned FROM v_num a JOIN v_num b ON a.vec_id = b.vec_id AND b.pos = (a.pos + 17) % 64) JOIN v_coef USING (pos) GROUP BY 1, 2, 3),
v_term AS (SELECT d.vec_id, win, d.k * 8 + x.k AS term, d.down * x.across AS low FROM (VALUES (0, 0, 0), (1, 1, 1), (2, 2, 1), (3, 1, 2), (4, 2, 2), (5, 3, 3)) AS w(win, xp, yp) JOIN v_low d ON d.part = w.yp JOIN v_low x ON x.part = w.xp AND x.vec_id = d.vec_id),
v_hash AS (SELECT vec_id, win, CAST(sum(CASE WHEN low <= mid THEN CAST(0 AS HUGEINT) WHEN term = 0 THEN -CAST(9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << (63 - term) END) AS BIGINT) AS hash
  FROM v_term JOIN (SELECT vec_id, win, median(low) FILTER (term > 0) AS mid FROM v_term GROUP BY 1, 2) USING (vec_id, win) GROUP BY 1, 2)"""
