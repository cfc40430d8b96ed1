"""Box algebra, matching and detection quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import codec
from orbweave.functions import geometry as g
from orbweave.operators import detection as det
from orbweave.plans import views as v
from orbweave.plans.book import book

QUERIES, ORACLES, query = book()
R = lambda c, n=6: F.round(c, n)

_INTER = "greatest(0, least(d.cx + d.w/2, g.cx + g.w/2) - greatest(d.cx - d.w/2, g.cx - g.w/2)) * greatest(0, least(d.cy + d.h/2, g.cy + g.h/2) - greatest(d.cy - d.h/2, g.cy - g.h/2))"
_PAIR = v.DET + f""", v_p AS (SELECT image, det, gt, conf, coalesce(inter / nullif(da + ga - inter, 0), 0) AS iou, inter / (da + ga - inter + 0.000001) AS iou6, inside FROM (
  SELECT d.image, d.det, g.gt, d.conf, {_INTER} AS inter, d.w * d.h AS da, g.w * g.h AS ga,
  g.cx >= d.cx - d.w/2 AND g.cx < d.cx + d.w/2 AND g.cy >= d.cy - d.h/2 AND g.cy < d.cy + d.h/2 AS inside FROM v_det d JOIN v_gt g ON d.image = g.image))"""


@query("SELECT image, det, gt, round(iou, 6) AS iou FROM v_p WHERE iou >= 0.5", _PAIR)
def iou_pairs(spark, sf):
    return det.iou_pairs(v.detections(spark, sf), v.truths(spark, sf), 0.5).select("image", "det", "gt", R(F.col("iou")).alias("iou"))


@query("SELECT d.image, d.det, coalesce(max(p.iou) >= 0.3, FALSE) AS hit FROM v_det d LEFT JOIN v_p p ON d.image = p.image AND d.det = p.det GROUP BY 1, 2", _PAIR)
def match_any_gt(spark, sf):
    return det.match_any(v.detections(spark, sf), v.truths(spark, sf))


@query("SELECT g.image, g.gt, coalesce(bool_or(p.iou >= 0.1 OR p.inside), FALSE) AS found FROM v_gt g LEFT JOIN v_p p ON g.image = p.image AND g.gt = p.gt GROUP BY 1, 2", _PAIR)
def match_loose(spark, sf):
    return det.match_loose(v.detections(spark, sf), v.truths(spark, sf))


@query("SELECT image, det, greatest(cx - w/2, 0) AS x0, greatest(cy - h/2, 0) AS y0, least(cx + w/2, 768) AS x1, least(cy + h/2, 768) AS y1 FROM v_det", v.DET)
def clip_boxes(spark, sf):
    return v.detections(spark, sf).select("image", "det", *[c.alias(k) for k, c in g.clip(g.box(), 768, 768).items()])


@query("SELECT CAST(side AS BIGINT) AS side, CAST(win AS BIGINT) AS win, count(*) AS slices FROM (SELECT DISTINCT side, win, least(i * step, side - win) AS x FROM (VALUES (3072, 768, 614), (3072, 512, 410), (768, 768, 614)) AS t(side, win, step), (SELECT unnest(range(20)) AS i) WHERE (i - 1) * step < side - win OR i = 0) a JOIN (SELECT DISTINCT side, win, least(i * step, side - win) AS y FROM (VALUES (3072, 768, 614), (3072, 512, 410), (768, 768, 614)) AS t(side, win, step), (SELECT unnest(range(20)) AS i) WHERE (i - 1) * step < side - win OR i = 0) b USING (side, win) GROUP BY 1, 2")
def slice_grid(spark, sf):
    out = None
    for side, win in ((3072, 768), (3072, 512), (768, 768)):
        own = spark.createDataFrame([(side, win)], "side long, win long").select("side", "win", F.explode(g.slice_origins(F.col("side"), win)).alias("x"), g.slice_origins(F.col("side"), win).alias("ys")).select("side", "win", "x", F.explode("ys").alias("y"))
        out = own if out is None else out.unionAll(own)
    return out.groupBy("side", "win").agg(F.count(F.lit(1)).alias("slices"))


@query("SELECT image, det, cx + (image % 4) * 614 AS cx, cy + ((image // 4) % 4) * 614 AS cy FROM v_det WHERE conf >= 0.25", v.DET)
def lift_global(spark, sf):
    slices = spark.range(16).select(F.col("id").alias("slice"), (F.col("id") % 4 * 614).cast("double").alias("ox"), (F.floor(F.col("id") / 4) * 614).cast("double").alias("oy"))
    return det.lift(v.detections(spark, sf).withColumn("slice", F.col("image") % 16), slices, 0.25).select("image", "det", "cx", "cy")


@query("SELECT image, det, CAST(floor(cx / 192) * 4 + floor(cy / 192) AS BIGINT) AS cell, (cx - w/2 < 384 AND cx + w/2 > 384) OR (cy - h/2 < 384 AND cy + h/2 > 384) AS straddles FROM v_det", v.DET)
def seam_straddle(spark, sf):
    x, y, w, h = g.box()
    cut = lambda c, s: (c - s / 2 < 384) & (c + s / 2 > 384)
    return v.detections(spark, sf).select("image", "det", (F.floor(x / 192) * 4 + F.floor(y / 192)).cast("long").alias("cell"), (cut(x, w) | cut(y, h)).alias("straddles"))


@query("SELECT image, det, CAST(greatest(trunc(cx - greatest(w, h) * 0.75), 0) AS INTEGER) AS x0, CAST(least(trunc(cx + greatest(w, h) * 0.75), 768) AS INTEGER) AS x1 FROM v_det", v.DET)
def crop_boxes(spark, sf):
    c = g.crop_square(g.box(), 768, 768)
    return v.detections(spark, sf).select("image", "det", c["x0"].alias("x0"), c["x1"].alias("x1"))


@query("SELECT bucket, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT CASE WHEN greatest(any_value(g.w), any_value(g.h)) < 32 THEN 'small' WHEN greatest(any_value(g.w), any_value(g.h)) < 96 THEN 'medium' ELSE 'large' END AS bucket, coalesce(max(p.iou) >= 0.5, FALSE) AS hit FROM v_gt g LEFT JOIN v_p p ON g.image = p.image AND g.gt = p.gt AND p.conf >= 0.25 GROUP BY g.image, g.gt) GROUP BY bucket", _PAIR)
def recall_by_size(spark, sf):
    from orbweave.operators.statistics import size_bucket

    d, t = v.detections(spark, sf).where("conf >= 0.25"), v.truths(spark, sf)
    best = det.pairs(d, t).groupBy("image", "gt").agg(F.max(g.iou(g.box(), g.box("g_"))).alias("best"))
    found = t.join(best, ["image", "gt"], "left").select(size_bucket(F.greatest("w", "h"), "half_open").alias("bucket"), (F.coalesce("best", F.lit(0.0)) >= 0.5).alias("hit"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))).alias("recall"))


@query("SELECT count(*) FILTER (conf >= 0.25) AS n, min(conf) FILTER (conf >= 0.25) AS least, quantile_cont(conf, 0.5) FILTER (conf >= 0.25) AS median, round(avg(conf) FILTER (conf >= 0.25), 6) AS mean, max(conf) AS most FROM v_det", v.DET)
def describe_detections(spark, sf):
    o = det.describe(v.detections(spark, sf))
    return o.select("n", "least", "median", R(F.col("mean")).alias("mean"), "most")


@query("SELECT image, count(*) AS overlapping FROM (SELECT d.image, d.det, g.det AS other, " + _INTER + " AS inter, d.w * d.h AS da, g.w * g.h AS ga FROM v_det d JOIN v_det g ON d.image = g.image AND d.det < g.det) WHERE inter / (da + ga - inter) >= 0.5 GROUP BY image", v.DET)
def overlap_violations(spark, sf):
    d = v.detections(spark, sf)
    o = d.select("image", F.col("det").alias("gt"), *[F.col(k).alias("g_" + k) for k in det.BOX])
    return d.join(o, "image").where((F.col("det") < F.col("gt")) & (g.iou(g.box(), g.box("g_")) >= 0.5)).groupBy("image").agg(F.count(F.lit(1)).alias("overlapping"))


@query("SELECT image, det, arg_min(gt, (dist, gt)) AS nearest, min(dist) AS dist FROM (SELECT d.image, d.det, g.gt, greatest(abs(d.cx - g.cx), abs(d.cy - g.cy), abs(d.w - g.w), abs(d.h - g.h)) AS dist FROM v_det d JOIN v_gt g USING (image)) GROUP BY 1, 2", v.DET)
def nearest_box(spark, sf):
    far = F.greatest(*[F.abs(F.col(k) - F.col("g_" + k)) for k in det.BOX])
    p = det.pairs(v.detections(spark, sf), v.truths(spark, sf)).withColumn("d", far)
    return p.groupBy("image", "det").agg(F.min_by("gt", F.struct("d", "gt")).alias("nearest"), F.min("d").alias("dist"))


def _greedy(row: str, other: str, order: str, prefer: str, least: str) -> str:
    """SQL of a greedy matching: rows in order, each takes the first of its preferences that is still free."""
    rows = "v_det" if row == "det" else "v_gt"
    return f"""RECURSIVE {_PAIR}, v_rank AS (SELECT image, {row}, row_number() OVER (PARTITION BY image ORDER BY {order}) AS k FROM {rows}),
    v_pref AS (SELECT r.image, r.k, any_value(r.{row}) AS own, coalesce(list(p.{other} ORDER BY {prefer}) FILTER ({least}), CAST([] AS BIGINT[])) AS prefs FROM v_rank r LEFT JOIN v_p p ON p.image = r.image AND p.{row} = r.{row} GROUP BY 1, 2),
    v_step AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS own, CAST(NULL AS BIGINT) AS pick FROM v_rank
      UNION ALL SELECT image, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, own, pick FROM
        (SELECT s.image, f.k, s.taken, f.own, list_filter(f.prefs, lambda x: NOT list_contains(s.taken, x))[1] AS pick FROM v_step s JOIN v_pref f ON f.image = s.image AND f.k = s.k + 1)),
    v_met AS (SELECT image, {"own AS det, pick AS gt" if row == "det" else "pick AS det, own AS gt"} FROM v_step WHERE pick IS NOT NULL),
    v_match AS (SELECT d.image, d.det, m.gt, d.conf FROM v_det d LEFT JOIN v_met m ON m.image = d.image AND m.det = d.det
      UNION ALL SELECT g.image, NULL, g.gt, NULL FROM v_gt g WHERE NOT EXISTS (SELECT 1 FROM v_met m WHERE m.image = g.image AND m.gt = g.gt))"""


_VOC = _greedy("det", "gt", "conf DESC, det", "p.iou DESC, p.gt DESC", "p.iou >= 0.5")
_MATCH = "SELECT image, det, gt, conf FROM v_match"


def _pairs(matched):
    return matched.select("image", "det", "gt", "conf")


@query(_MATCH, _VOC)
def match_voc(spark, sf):
    return _pairs(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "voc"))


@query(_MATCH, _greedy("gt", "det", "gt", "p.iou DESC, p.det", "p.iou >= 0.5"))
def match_truth_first(spark, sf):
    return _pairs(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "truth_first"))


@query(_MATCH, _greedy("gt", "det", "gt", "p.iou DESC, p.det DESC", "p.iou >= 0.3"))
def match_truth_last(spark, sf):
    return _pairs(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "truth_last", 0.3))


@query(_MATCH, _greedy("det", "gt", "conf DESC, det", "p.iou6 DESC, p.gt", "p.iou6 >= 0.5"))
def match_conf_argmax(spark, sf):
    return _pairs(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "conf_argmax"))


def _suppressed(over: str) -> str:
    """SQL of greedy suppression: a box stays if none of the better boxes that it overlaps has stayed."""
    return f"""RECURSIVE {v.DET}, v_rank AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det) AS k FROM v_det),
    v_near AS (SELECT d.image, d.k, any_value(d.det) AS det, coalesce(list(g.k) FILTER (g.k < d.k AND {_INTER} / (d.w * d.h + g.w * g.h - {_INTER}) {over}), CAST([] AS BIGINT[])) AS near FROM v_rank d JOIN v_rank g ON d.image = g.image GROUP BY 1, 2),
    v_step AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS det, FALSE AS stays FROM v_rank
      UNION ALL SELECT image, k, CASE WHEN stays THEN list_append(kept, k) ELSE kept END, det, stays FROM
        (SELECT s.image, n.k, s.kept, n.det, len(list_filter(n.near, lambda x: list_contains(s.kept, x))) = 0 AS stays FROM v_step s JOIN v_near n ON n.image = s.image AND n.k = s.k + 1))"""


@query("SELECT image, det FROM v_step WHERE stays", _suppressed(">= 0.5"))
def nms_fuse(spark, sf):
    return det.non_maximum(v.detections(spark, sf)).select("image", "det")


@query("SELECT image, det FROM v_step WHERE stays", _suppressed("> 0.7"))
def nms_detector(spark, sf):
    return det.non_maximum(v.detections(spark, sf), 0.7, strict=True, candidates=30_000, most=300).select("image", "det")


@query(
    """SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS r FROM
    (SELECT count(*) FILTER (conf >= 0.25 AND gt IS NOT NULL) AS tp, count(*) FILTER (conf >= 0.25 AND gt IS NULL) AS fp, count(*) FILTER (gt IS NOT NULL AND coalesce(conf < 0.25, TRUE)) AS fn FROM v_match))""",
    _VOC,
)
def eval_prf(spark, sf):
    o = det.scores(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "voc"), 0.25)
    return o.select("tp", "fp", "fn", *[R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


_CURVE = """v_n AS (SELECT count(gt) AS n FROM v_match), v_pt AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS rec, CAST(1 AS DOUBLE) AS pre UNION ALL
      SELECT i, tp / CAST(n AS DOUBLE), tp / CAST(i AS DOUBLE) FROM (SELECT row_number() OVER o AS i, sum(CASE WHEN gt IS NULL THEN 0 ELSE 1 END) OVER o AS tp FROM v_match WHERE det IS NOT NULL WINDOW o AS (ORDER BY conf DESC, image, det)), v_n
      UNION ALL SELECT 1000000000, 1, 0), v_env AS (SELECT i, rec, max(pre) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pre FROM v_pt),
    v_level AS (SELECT rec, arg_max(pre, i) AS low, arg_min(pre, i) AS high FROM v_env GROUP BY rec),
    v_side AS (SELECT rec, low, lead(rec) OVER (ORDER BY rec) AS next, lead(high) OVER (ORDER BY rec) AS high FROM v_level),
    v_y AS (SELECT x, CASE WHEN x = 1 OR next IS NULL THEN CASE WHEN x = 1 THEN 0 ELSE low END ELSE low + (high - low) * (x - rec) / (next - rec) END AS y FROM (SELECT range / CAST(100 AS DOUBLE) AS x FROM range(101)) g ASOF JOIN v_side s ON g.x >= s.rec)"""


def _area(ctes: str) -> tuple[str, str]:
    return "SELECT round(sum(CASE WHEN x = 0 OR x = 1 THEN y / 2 ELSE y END) / 100, 6) AS ap FROM v_y", ctes + ", " + _CURVE


@query(*_area(_VOC))
def ap50(spark, sf):
    ap = det.average_precision(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "voc"))
    return ap.select(R(F.col("ap")).alias("ap"))


@query(*_area(_VOC.replace("p.iou >= 0.5", "p.iou >= 0.75")))
def ap75(spark, sf):
    ap = det.average_precision(det.match_greedy(v.detections(spark, sf), v.truths(spark, sf), "voc", 0.75))
    return ap.select(R(F.col("ap")).alias("ap"))


@query(
    """SELECT bucket, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT CASE WHEN greatest(g.w, g.h) < 32 THEN 'small' WHEN greatest(g.w, g.h) < 96 + 1e-9 THEN 'medium' ELSE 'large' END AS bucket, coalesce(m.conf >= 0.25, FALSE) AS hit
    FROM v_gt g LEFT JOIN v_match m ON m.image = g.image AND m.gt = g.gt) GROUP BY bucket""",
    _VOC,
)
def matched_recall_by_size(spark, sf):
    """Recall of a one-to-one matching by size, with the tolerant upper edge."""
    from orbweave.operators.statistics import size_bucket

    t = v.truths(spark, sf)
    m = det.match_greedy(v.detections(spark, sf), t, "voc").where("gt IS NOT NULL").select("image", "gt", F.coalesce(F.col("conf") >= 0.25, F.lit(False)).alias("hit"))
    found = t.join(m, ["image", "gt"]).select(size_bucket(F.greatest("w", "h"), "tolerant").alias("bucket"), "hit")
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.col("hit").cast("double"))).alias("recall"))


@query("SELECT image, det, round(cx, 1) AS cx, round(cy, 1) AS cy, w, h, CAST(round_even(conf * 65535, 0) AS BIGINT) AS conf16, 34 AS size FROM v_det", v.DET)
def packed_records(spark, sf):
    """Records in packets, decoded by the ground and set beside their detections."""
    p = codec.pack_detections(v.detections(spark, sf))
    back = codec.decode_downlink(p).select("image", R(F.col("cx"), 1).alias("cx"), R(F.col("cy"), 1).alias("cy"), "w", "h", F.rint(F.col("conf") * 65535).cast("long").alias("conf16"))
    sizes = v.detections(spark, sf).join(p.select("image", "det", F.length("packet").alias("size")), ["image", "det"]).select("image", "det", "cx", "cy", "w", "h", F.rint(F.col("conf") * 65535).cast("long").alias("conf16"), "size")
    return sizes.join(back.distinct(), ["image", "cx", "cy", "w", "h", "conf16"], "left_semi").select("image", "det", "cx", "cy", "w", "h", "conf16", "size")


@query("SELECT image, count(*) AS n, CAST(round(sum(cx) * 10) AS BIGINT) AS cx10 FROM v_det GROUP BY image", v.DET)
def downlink_streams(spark, sf):
    """One byte stream an image, decoded on the ground."""
    p = codec.pack_detections(v.detections(spark, sf))
    got = codec.decode_downlink(codec.downlink_stream(p, "image", "det"), "stream")
    return got.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cx") * 10).cast("long").alias("cx10"))


@query("SELECT image, det, cx + 40000 AS cx, cy FROM v_det", v.DET)
def codec_round_trip(spark, sf):
    """Boxes 40,000 pixels into a scene keep their place."""
    d = v.detections(spark, sf)
    p = codec.pack_detections(d.withColumn("cx", F.col("cx") + 40_000))
    return p.mapInPandas(_unpacked, "image long, det long, cx double, cy double")


def _unpacked(batches):
    for b in batches:
        found = [codec.unpack_record(x)[0] for x in b["record"]]
        yield b[["image", "det"]].assign(cx=[r.cx for r in found], cy=[r.cy for r in found])
