"""Sampling, scenes, perception, energy, volumes and small report rules over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from orbweave.functions import codec, domain
from orbweave.functions import geometry as g
from orbweave.operators import accounting, detection, imaging, neighbours, perception, sampling
from orbweave.plans import views as v
from orbweave.plans.book import book
from orbweave.session import table

QUERIES, ORACLES, query = book()
R = lambda c, n=6: F.round(c, n)
N = lambda name="n": F.count(F.lit(1)).alias(name)

_U = lambda label, col: f"(CAST('0x' || substr(md5('{label}:' || {col}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"
_POOL = v.TILES + ", v_pool AS (SELECT user_id * 1000 + day AS tile, ctx, n_ships, row_number() OVER (PARTITION BY ctx ORDER BY user_id * 1000 + day) AS number, count(*) OVER (PARTITION BY ctx) AS size FROM v_tiles)"


def _day(n: int, seed: int = 0) -> str:
    ctx = f"(SELECT range AS slot, {_U(f't{seed}', 'range')} * 86400 AS t, {_U(f'c{seed}', 'range')} AS u, {_U(f'p{seed}', 'range')} AS p FROM range({n}))"
    return f"v_day AS (SELECT d.slot, d.t, w.tile, w.ctx, w.n_ships FROM (SELECT *, CASE WHEN u < 0.15 THEN 'cloud' WHEN u < 0.15 + 0.2 THEN 'ships' WHEN u < 0.15 + 0.2 + 0.05 THEN 'coast' ELSE 'empty' END AS ctx FROM {ctx}) d JOIN v_pool w ON w.ctx = d.ctx AND w.number = CAST(floor(d.p * w.size) + 1 AS BIGINT))"


def _pool(spark, sf):
    return v.tiles(spark, sf).select((F.col("user_id") * 1000 + F.col("day")).alias("tile"), "ctx", "n_ships")


@query("SELECT slot, round(t, 3) AS t, tile, ctx FROM v_day", _POOL + ", " + _day(5000))
def sampled_day(spark, sf):
    """A day of 5,000 tiles by the orbit's mix of contexts, drawn with replacement."""
    return sampling.sample_day(_pool(spark, sf), 5000).select("slot", R(F.col("t"), 3).alias("t"), "tile", "ctx")


@query("SELECT slot // 16 AS scene, count(*) AS tiles, CAST(sum(n_ships) AS BIGINT) AS ships, count(*) FILTER (ctx = 'cloud') AS clouds, CAST(max((slot % 4) * 768) AS BIGINT) AS x_last FROM v_day GROUP BY 1", _POOL + ", " + _day(3200))
def sampled_scenes(spark, sf):
    """Two hundred scenes of four by four tiles."""
    s = sampling.sample_scenes(_pool(spark, sf), 200)
    return s.groupBy("scene").agg(N("tiles"), F.sum("n_ships").alias("ships"), F.count_if(F.col("ctx") == "cloud").alias("clouds"), F.max("x0").alias("x_last"))


@query(f"SELECT row_number() OVER (ORDER BY t, id) - 1 AS instance, round(t, 3) AS t, scene FROM (SELECT range AS id, {_U('d0', 'range')} * 86400 AS t, CAST(floor({_U('s0', 'range')} * 25) AS BIGINT) AS scene FROM range(400))")
def day_instances(spark, sf):
    scenes = spark.range(25).select(F.col("id").alias("scene"))
    return sampling.day_instances(scenes, 400).select("instance", R(F.col("t"), 3).alias("t"), "scene")


@query("SELECT image, det, cx + (image % 4) * 768 AS cx, cy + (image // 4 % 4) * 768 AS cy, CAST(image % 16 AS BIGINT) AS tile FROM v_det", v.DET)
def scene_boxes(spark, sf):
    """Boxes of tiles in the pixels of their scene, and the tile that holds their centre."""
    d = v.detections(spark, sf)
    own = d.select("image", "det", (F.col("cx") + F.col("image") % 4 * 768).alias("cx"), (F.col("cy") + F.floor(F.col("image") / 4) % 4 * 768).alias("cy"))
    return own.withColumn("tile", sampling.tile_of(F.col("cx"), F.col("cy")))


@query(f"SELECT doc_id, CASE WHEN r <= CAST(floor(0.1 * n) AS BIGINT) THEN 'val' WHEN r <= CAST(floor(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_U('0', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents)")
def sequential_split(spark, sf):
    return sampling.sequential_split(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("SELECT ctx, CASE WHEN thr < 0.25 THEN low ELSE high END AS n_fp, thr FROM (SELECT ctx, CAST(sum(n_fp) AS BIGINT) AS low, CAST(sum(CASE WHEN n_fp > 1 THEN n_fp - 1 ELSE 0 END) AS BIGINT) AS high FROM v_tiles GROUP BY ctx), (SELECT CAST(unnest([0.05, 0.1, 0.25, 0.6]) AS DOUBLE) AS thr)", v.TILES)
def false_alarms_nearest_thr(spark, sf):
    """False alarms at any threshold from the counts measured at two: the nearest one below, else the least."""
    t = v.tiles(spark, sf).select("ctx", F.col("n_fp").alias("n_fp_0.10"), F.greatest(F.lit(0).cast("long"), F.col("n_fp") - 1).alias("n_fp_0.25"))
    out = None
    for thr in (0.05, 0.1, 0.25, 0.6):
        own = t.groupBy("ctx").agg(F.sum(F.col(f"`{nearest_measured(t.columns, thr)}`")).alias("n_fp")).withColumn("thr", F.lit(thr))
        out = own if out is None else out.unionByName(own)
    return out


def nearest_measured(columns: list[str], thr: float) -> str:
    """The column ``n_fp_<threshold>`` with the highest threshold up to ``thr``, else the lowest."""
    at = {float(c.split("_")[-1]): c for c in columns if c.startswith("n_fp_")}
    if not at:
        raise ValueError("no false alarms were measured")
    below = [t for t in at if t <= thr + 1e-9]
    return at[max(below)] if below else at[min(at)]


# One image an order, 1,024 pixels wide; the detector finds the boxes whose centre a window holds, in the window's pixels.
_SEEN = v.DET + ", v_img AS (SELECT DISTINCT image FROM v_det), v_win AS (SELECT image, x, y FROM v_img, (SELECT unnest([0, 256]) AS x), (SELECT unnest([0, 256]) AS y))"


def _detector(spark, sf):
    """An injected detector that knows the truth: rows of its own table are sent along with the images."""
    boxes = F.collect_list(F.struct("cx", "cy", "w", "h", "conf")).alias("boxes")
    images = v.detections(spark, sf).groupBy("image").agg(boxes).withColumns({"width": F.lit(1024), "height": F.lit(1024)})

    def detect(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for image, number, ox, oy, sw, sh, known in zip(b["image"], b["slice"], b["ox"], b["oy"], b["sw"], b["sh"], b["boxes"], strict=True):
            rows += [(image, number, k["cx"] - ox, k["cy"] - oy, k["w"], k["h"], k["conf"]) for k in known if ox <= k["cx"] < ox + sw and oy <= k["cy"] < oy + sh]
        return pd.DataFrame(rows, columns=["image", "slice", "cx", "cy", "w", "h", "conf"])

    return images, detect


@query("SELECT image, count(*) AS n, round(sum(cx), 3) AS cx FROM v_det WHERE conf >= 0.25 GROUP BY image", _SEEN)
def detect_whole(spark, sf):
    """One window an image: what the detector says, weak boxes left out, nothing fused."""
    d = perception.detect_images(*_detector(spark, sf), mode="whole")
    return d.groupBy("image").agg(N(), R(F.sum("cx"), 3).alias("cx"))


@query("SELECT d.image, count(*) AS n, round(sum(d.cx), 3) AS cx FROM v_det d JOIN v_win w ON d.image = w.image AND d.cx >= w.x AND d.cx < w.x + 768 AND d.cy >= w.y AND d.cy < w.y + 768 WHERE conf >= 0.25 GROUP BY d.image", _SEEN)
def detect_sliced_unfused(spark, sf):
    """Overlapping windows without fusion: boxes in the overlap are found once a window, at their place in the image."""
    d = perception.detect_images(*_detector(spark, sf), window=768, overlap=0.2, fuse=None)
    return d.groupBy("image").agg(N(), R(F.sum("cx"), 3).alias("cx"))


@query("SELECT count(*) > 0 AS found, 0 AS doubled FROM v_det", v.DET)
def detect_sliced_fused(spark, sf):
    """After fusion no two boxes of an image overlap by half."""
    d = perception.detect_images(*_detector(spark, sf), window=768, overlap=0.2)
    pairs = detection.iou_pairs(d, d.select("image", F.col("det").alias("gt"), *detection.BOX), 0.5).where("det < gt")
    return d.agg((F.count(F.lit(1)) > 0).alias("found")).crossJoin(pairs.agg(F.count(F.lit(1)).cast("int").alias("doubled")))


@query("SELECT count(*) AS paired, 0 AS live_alone, 0 AS reference_alone, count(*) FILTER ((conf >= 0.25) <> (conf * 0.98 >= 0.25)) AS flips, round(max(conf - conf * 0.98), 6) AS most_apart FROM v_far", v.DET + ", v_far AS (SELECT * FROM v_det WHERE det = 1)")
def live_flips(spark, sf):
    """A live run whose confidences are two hundredths lower: decisions that flip at the cut."""
    one = lambda: v.detections(spark, sf).where("det = 1")
    out = perception.live_against_reference(one().withColumn("conf", F.col("conf") * 0.98), one())
    return out.select("paired", F.col("live_alone").cast("int").alias("live_alone"), F.col("reference_alone").cast("int").alias("reference_alone"), "flips", R(F.col("most_apart")).alias("most_apart"))


@query("SELECT image, bool_or(cx - w/2 - 8 < 384 AND 384 < cx + w/2 + 8) AS touches FROM v_det GROUP BY image", v.DET)
def midline_blobs(spark, sf):
    """Images with a box that touches the middle line within eight pixels."""
    near = (F.col("cx") - F.col("w") / 2 - 8 < 384) & (F.col("cx") + F.col("w") / 2 + 8 > 384)
    return v.detections(spark, sf).groupBy("image").agg(F.bool_or(near).alias("touches"))


@query("SELECT image, arg_max(det, (w * h, -det)) AS det, max(w * h) AS area FROM v_det GROUP BY image", v.DET)
def largest_box(spark, sf):
    area = F.col("w") * F.col("h")
    return v.detections(spark, sf).groupBy("image").agg(F.max_by("det", F.struct(area, -F.col("det"))).alias("det"), F.max(area).alias("area"))


_INT = "least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)"


@query(f"SELECT image, count(*) AS pairs, round(sum(CASE WHEN u > 0 THEN i / u ELSE 0 END), 6) AS iou FROM (SELECT a.image, greatest(0, {_INT}) * greatest(0, {_INT.replace('.x', '.y').replace('.w', '.h')}) / CAST(1 AS DOUBLE) AS i, a.w * a.h + b.w * b.h - greatest(0, {_INT}) * greatest(0, {_INT.replace('.x', '.y').replace('.w', '.h')}) AS u FROM v_int a JOIN v_int b ON a.image = b.image AND a.det < b.det) GROUP BY image", v.DET + ", v_int AS (SELECT image, det, CAST(trunc(cx) AS BIGINT) AS x, CAST(trunc(cy) AS BIGINT) AS y, CAST(trunc(w) AS BIGINT) AS w, CAST(trunc(h) AS BIGINT) AS h FROM v_det)")
def iou_of_corner_boxes(spark, sf):
    """Overlap of whole-pixel boxes given by their top left corner."""
    d = v.detections(spark, sf).select("image", "det", *[F.col(c).cast("long").alias(k) for c, k in (("cx", "x"), ("cy", "y"), ("w", "w"), ("h", "h"))])
    b = d.select("image", F.col("det").alias("other"), *[F.col(k).alias("b_" + k) for k in "xywh"])
    iou = g.iou_corner(tuple(F.col(k) for k in "xywh"), tuple(F.col("b_" + k) for k in "xywh"))
    return d.join(b, "image").where("det < other").groupBy("image").agg(N("pairs"), R(F.sum(iou)).alias("iou"))


@query("SELECT image, det, round(least(768 / w, 768 / h), 6) AS scale, round((768 - w * least(768 / w, 768 / h)) / 2, 6) AS pad_x, round((768 - h * least(768 / w, 768 / h)) / 2, 6) AS pad_y FROM v_det", v.DET)
def letterbox_geometry(spark, sf):
    box = g.letterbox(F.col("w"), F.col("h"))
    return v.detections(spark, sf).select("image", "det", *[R(c).alias(k) for k, c in box.items()])


@query("SELECT image, det, CAST(greatest(trunc(cy - greatest(w, h) * 0.75), 0) AS INTEGER) AS y0, CAST(least(trunc(cy + greatest(w, h) * 0.75), 768) AS INTEGER) AS y1 FROM v_det", v.DET)
def crop_boxes_y(spark, sf):
    c = g.crop_square(g.box(), 768, 768)
    return v.detections(spark, sf).select("image", "det", c["y0"].alias("y0"), c["y1"].alias("y1"))


@query("SELECT CAST(side AS BIGINT) AS side, CASE WHEN side <= 768 THEN 1 ELSE pow(ceil((side - 768) / CAST(614 AS DOUBLE)) + 1, 2) END AS calls, round(CASE WHEN side <= 768 THEN 1 ELSE pow(ceil((side - 768) / CAST(614 AS DOUBLE)) + 1, 2) END / pow(side / CAST(768 AS DOUBLE), 2), 6) AS cost FROM (SELECT unnest([768, 1024, 1536, 3072, 4000]) AS side)")
def slice_cost(spark, sf):
    """Detector calls of a frame, and their share of the calls of plain tiling."""
    s = spark.createDataFrame([(x, x, x) for x in (768, 1024, 1536, 3072, 4000)], "image long, width long, height long")
    n = perception.plan_windows(s).groupBy("image").agg(F.count(F.lit(1)).cast("double").alias("calls"))
    return n.select(F.col("image").alias("side"), "calls", R(F.col("calls") / F.pow(F.col("image") / 768, F.lit(2.0))).alias("cost"))


_CELLS = v.DET + ", v_cell AS (SELECT DISTINCT image, x * 64 + y + 1 AS p FROM (SELECT image, CAST(floor(cx / 12) AS BIGINT) AS x, unnest(range(CAST(floor(cy / 12) AS BIGINT), least(CAST(floor((cy + h) / 12) AS BIGINT), 63) + 1)) AS y FROM v_det))"


@query("SELECT image, string_agg(s || ' ' || n, ' ' ORDER BY s) AS mask FROM (SELECT image, min(p) AS s, count(*) AS n FROM (SELECT image, p, p - row_number() OVER (PARTITION BY image ORDER BY p) AS run FROM v_cell) GROUP BY image, run) GROUP BY image", _CELLS)
def rle_encode(spark, sf):
    """Masks of 64 by 64 cells as runs, column by column."""
    return _cells(spark, sf).transform(lambda c: g.rle_encode(c, "image", "p"))


@query("SELECT image, p FROM v_cell", _CELLS)
def rle_round_trip(spark, sf):
    return g.rle_decode(g.rle_encode(_cells(spark, sf), "image", "p"), "image", "mask")


def _cells(spark, sf):
    cell = lambda c: F.floor(c / 12)
    rows = F.sequence(cell(F.col("cy")), F.least(cell(F.col("cy") + F.col("h")), F.lit(63).cast("long")))
    return v.detections(spark, sf).select("image", cell(F.col("cx")).alias("x"), F.explode(rows).alias("y")).select("image", (F.col("x") * 64 + F.col("y") + 1).alias("p")).distinct()


@query("SELECT count(*) AS n, round(count(*) * (28 * 0.94 + 28 * 38.6) / 1000, 6) AS proposed_J, round(count(*) * (28 * 56.36 + 28 * 38.6) / 1000, 6) AS baseline_J, round(1 - (28 * 0.94 + 28 * 38.6) / (28 * 56.36 + 28 * 38.6), 6) AS saving FROM v_tiles", v.TILES)
def energy_processing(spark, sf):
    e = accounting.processing(v.tiles(spark, sf))
    return e.select("n", *[R(F.col(c)).alias(c) for c in ("proposed_J", "baseline_J", "saving")])


@query("SELECT kind, round(sum(size) * 15 * 8 / 2530000.0, 6) AS direct_J, round(sum(size) * 12 * 8 / 2530000.0 + sum(size) * 15 * 8 / 2530000.0, 6) AS relay_J FROM v_items GROUP BY kind".replace("2530000.0", "CAST(2530000 AS DOUBLE)"), v.ITEMS)
def energy_paths(spark, sf):
    p = accounting.path_joules(F.col("size").cast("double"))
    return v.items(spark, sf).groupBy("kind").agg(R(F.sum(p["direct_J"])).alias("direct_J"), R(F.sum(p["relay_J"])).alias("relay_J"))


@query("SELECT watts, ms, round(watts * ms / 1000, 6) AS joules, watts * ms / 1000 <= 1.1 AS fits FROM (SELECT CAST(unnest([10, 15, 28]) AS DOUBLE) AS watts), (SELECT CAST(unnest([10.71, 38.6, 46.6, 328.8]) AS DOUBLE) AS ms)")
def energy_edge_grid(spark, sf):
    """Detector energy over a grid of powers and times, with the cells that fit a budget."""
    watts, times = spark.createDataFrame([(10.0,), (15.0,), (28.0,)], "watts double"), spark.createDataFrame([(10.71,), (38.6,), (46.6,), (328.8,)], "ms double")
    joules = accounting.stage_joules(F.col("watts"), F.col("ms"))
    return watts.crossJoin(times).select("watts", "ms", R(joules).alias("joules"), (joules <= 1.1).alias("fits"))


@query("SELECT kind, CAST(count(*) * 1769472 AS BIGINT) AS raw, round(100 * (1 - sum(size) / CAST(count(*) * 1769472 AS DOUBLE)), 6) AS reduction, round(CAST(count(*) * 1769472 AS DOUBLE) / sum(size), 4) AS factor, round(sum(size) * 8 / CAST(2530000 AS DOUBLE), 6) AS tx_s FROM v_items GROUP BY kind", v.ITEMS)
def accounting_by_kind(spark, sf):
    per = v.items(spark, sf).groupBy("kind").agg(F.sum("size").cast("double").alias("sent"), F.sum(accounting.raw_bytes(F.lit(768), F.lit(768))).alias("raw"))
    return per.select("kind", "raw", R(accounting.reduction(F.col("sent"), F.col("raw"))).alias("reduction"), R(accounting.factor(F.col("sent"), F.col("raw")), 4).alias("factor"), R(domain.tx_seconds(F.col("sent"), 2.53e6)).alias("tx_s"))


@query("SELECT id, round(0.0396 + 0.0091 + size * 8 / CAST(2530000 AS DOUBLE) + 0.00445, 9) AS total_s, round((0.0396 + 0.0091 + 0.00445) / (0.0396 + 0.0091 + size * 8 / CAST(2530000 AS DOUBLE) + 0.00445), 6) AS own_share FROM v_items", v.ITEMS)
def latency_budget(spark, sf):
    b = accounting.latency_budget(v.items(spark, sf), F.lit(0.0396), F.lit(0.0091), domain.tx_seconds(F.col("size"), 2.53e6), F.lit(0.00445))
    return b.select("id", R(F.col("total_s"), 9).alias("total_s"), R(F.col("own_share")).alias("own_share"))


@query("SELECT side, CAST(18 + side * side * 3 + 8 * ceil((18 + side * side * 3) / CAST(4094 AS DOUBLE)) AS BIGINT) AS bytes FROM (SELECT unnest([64, 768, 3072]) AS side)")
def raw_image_packets(spark, sf):
    s = spark.createDataFrame([(64,), (768,), (3072,)], "side int")
    return s.select("side", codec.raw_packet_bytes(F.col("side"), F.col("side")).alias("bytes"))


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 8) AS l_discount, round(avg(l_tax), 8) AS l_tax FROM lineitem")
def numeric_means(spark, sf):
    """Mean of every decimal column, by type."""
    t = table(spark, sf, "lineitem")
    places = {"l_quantity": 6, "l_extendedprice": 4}
    return t.agg(*[R(F.avg(c), places.get(c, 8)).alias(c) for c, kind in t.dtypes if kind == "double" or kind.startswith("decimal")])


@query("SELECT load, max(metric) FILTER (policy = 'F') AS F_metric, CAST(max(n) FILTER (policy = 'F') AS BIGINT) AS F_n, max(metric) FILTER (policy = 'O') AS O_metric, CAST(max(n) FILTER (policy = 'O') AS BIGINT) AS O_n FROM v_sweep GROUP BY load", v.SWEEP)
def sweep_pivot_values(spark, sf):
    return v.sweep(spark, sf).groupBy("load").pivot("policy", ["F", "O"]).agg(F.max("metric").alias("metric"), F.max("n").alias("n"))


@query("SELECT policy, round(avg(metric), 4) AS mean, round(max(metric) - min(metric), 4) AS spread FROM v_sweep GROUP BY policy", v.SWEEP)
def mean_with_spread(spark, sf):
    return v.sweep(spark, sf).groupBy("policy").agg(R(F.avg("metric"), 4).alias("mean"), R(F.max("metric") - F.min("metric"), 4).alias("spread"))


@query("SELECT count(*) AS shared FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def shared_nations(spark, sf):
    c, s = table(spark, sf, "customer").select("c_nationkey"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return c.intersect(s).agg(N("shared"))


@query("SELECT kind, sha256('[' || string_agg('{\"id\":' || id || ',\"size\":' || size || '}', ',' ORDER BY id) || ']') AS print FROM v_items GROUP BY kind", v.ITEMS)
def input_fingerprints(spark, sf):
    """Digest of the rows of each kind as JSON in order: the same inputs have the same print.

    Rows are gathered by blocks of ids, so that the array of one kind is an array of strings and not of all rows at once.
    """
    i = v.items(spark, sf).select("kind", "id", F.to_json(F.struct("id", "size")).alias("j"), F.floor(F.col("id") / 4096).alias("block"))
    part = i.groupBy("kind", "block").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("id", "j"))), lambda x: x["j"])).alias("p"))
    whole = part.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "p"))), lambda x: x["p"]).alias("ps"))
    return whole.select("kind", F.sha2(F.concat(F.lit("["), F.concat_ws(",", "ps"), F.lit("]")), 256).alias("print"))


@query("SELECT count(*) FILTER (contains(lower(p_name), 'green')) AS named, count(*) FILTER (starts_with(p_type, 'PROMO')) AS promo, CAST(sum(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS brands FROM part")
def string_predicates(spark, sf):
    t = table(spark, sf, "part")
    return t.agg(F.count_if(F.col("p_name").ilike("%green%")).alias("named"), F.count_if(F.col("p_type").startswith("PROMO")).alias("promo"), F.sum(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")).alias("brands"))


@query("SELECT kind, q, count(*) AS n, round(avg(CAST(size AS DOUBLE)), 4) AS measured, round(avg(greatest(120, 137.5 * pow(px, 0.57))), 4) AS modelled FROM (SELECT kind, size, id % 97 + 3 AS px, CASE WHEN id % 3 = 0 THEN 'q40' ELSE 'q70' END AS q FROM v_items) GROUP BY 1, 2", v.ITEMS)
def measured_and_modelled(spark, sf):
    """Sizes of products by quality beside those of the size model."""
    i = v.items(spark, sf).select("kind", F.col("size").cast("double").alias("size"), (F.col("id") % 97 + 3).cast("double").alias("px"), F.when(F.col("id") % 3 == 0, "q40").otherwise("q70").alias("q"))
    model = domain.product_bytes(F.col("px"), domain.SIZE_L1, domain.L1_BYTES)
    return i.groupBy("kind", "q").agg(N(), R(F.avg("size"), 4).alias("measured"), R(F.avg(model), 4).alias("modelled"))


@query("SELECT kind, count(*) AS n, round(sum(size) / 1e6, 6) AS mb, median(CAST(size AS DOUBLE)) AS median, round(quantile_cont(CAST(size AS DOUBLE), 0.9), 4) AS p90, round(sum(size) / CAST(sum(sum(size)) OVER () AS DOUBLE), 6) AS share FROM v_items GROUP BY kind", v.ITEMS)
def product_stats(spark, sf):
    per = v.items(spark, sf).groupBy("kind").agg(N(), F.sum("size").alias("s"), F.median(F.col("size").cast("double")).alias("median"), R(F.expr("percentile(size, 0.9)"), 4).alias("p90"))
    total = per.agg(F.sum("s").cast("double").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("kind", "n", R(F.col("s") / 1e6).alias("mb"), "median", "p90", R(F.col("s") / F.col("all")).alias("share"))


@query("SELECT q, bucket, count(*) AS n, round(avg(found), 6) AS recall, round(avg(found) - max(base), 6) AS delta FROM (SELECT *, avg(CASE WHEN q = 90 THEN found END) OVER (PARTITION BY bucket) AS base FROM (SELECT CASE WHEN greatest(w, h) < 30 THEN 'small' ELSE 'large' END AS bucket, q, CASE WHEN conf >= 0.25 + (90 - q) / CAST(400 AS DOUBLE) THEN 1.0 ELSE 0.0 END AS found FROM v_det, (SELECT unnest([40, 70, 90]) AS q))) GROUP BY q, bucket", v.DET)
def quality_ladder(spark, sf):
    """Recall at falling image quality, by size, against the best quality of that size."""
    d = v.detections(spark, sf).select(F.when(F.greatest("w", "h") < 30, "small").otherwise("large").alias("bucket"), "conf")
    long = d.select("bucket", "conf", F.explode(F.array(F.lit(40), F.lit(70), F.lit(90))).alias("q"))
    per = long.groupBy("q", "bucket").agg(N(), F.avg((F.col("conf") >= 0.25 + (90 - F.col("q")) / F.lit(400.0)).cast("double")).alias("recall"))
    base = F.max(F.when(F.col("q") == 90, F.col("recall"))).over(Window.partitionBy("bucket"))
    return per.withColumn("delta", R(F.col("recall") - base)).select("q", "bucket", "n", R(F.col("recall")).alias("recall"), "delta")


@query("SELECT policy, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN seam AND found THEN 1.0 WHEN seam THEN 0.0 END), 6) AS on_seam, max(calls) AS calls FROM (SELECT policy, calls, conf >= thr AS found, abs(cx - 384) < w / 2 AS seam FROM v_det, (VALUES ('whole', 1, 0.5), ('tiles', 16, 0.3), ('sliced', 25, 0.25)) AS p(policy, calls, thr)) GROUP BY policy", v.DET)
def recall_per_policy(spark, sf):
    """Recall, recall on a seam, and detector calls of each way to cut a frame."""
    d = v.detections(spark, sf).select((F.abs(F.col("cx") - 384) < F.col("w") / 2).alias("seam"), *[(F.col("conf") >= thr).alias(f"found_{p}") for p, thr in (("whole", 0.5), ("tiles", 0.3), ("sliced", 0.25))])
    long = d.unpivot(["seam"], ["found_whole", "found_tiles", "found_sliced"], "policy", "found").withColumn("policy", F.substring("policy", 7, 20))
    hit = F.col("found").cast("double")
    calls = F.when(F.col("policy") == "whole", 1).when(F.col("policy") == "tiles", 16).otherwise(25)
    return long.groupBy("policy").agg(R(F.avg(hit)).alias("recall"), R(F.avg(F.when(F.col("seam"), hit))).alias("on_seam"), F.max(calls).alias("calls"))


# The five payload modes: raw images, detections of whole images, detections, records with regions and context, and the same with a relay.
_MODES = (("B0", "raw_image", False), ("B1", "detections", False), ("B2", "detections", False), ("B3", "semantic", False), ("B4", "semantic", True))


@query(
    """SELECT mode, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
    SELECT 'B0' AS mode, 18 + 768 * 768 * 3 + 8 * ceil((18 + 768 * 768 * 3) / CAST(4094 AS DOUBLE)) AS bytes FROM (SELECT DISTINCT image FROM v_det)
    UNION ALL SELECT m, 34 FROM v_det, (SELECT unnest(['B1', 'B2']) AS m) WHERE conf >= CASE WHEN m = 'B1' THEN 0.5 ELSE 0.25 END
    UNION ALL SELECT m, CASE WHEN conf >= 0.67 THEN 34 ELSE 38 + 18 + s + 8 * ceil((18 + s) / CAST(4094 AS DOUBLE)) END FROM (SELECT *, floor(greatest(120, 137.5 * pow(greatest(w, h), 0.57))) AS s FROM v_det), (SELECT unnest(['B3', 'B4']) AS m) WHERE conf >= 0.25) GROUP BY mode""",
    v.DET,
)
def payload_modes(spark, sf):
    """Bytes down of the five modes over the same inputs: packets of raw images, of records, and of records with their regions."""
    d = v.detections(spark, sf)
    size = F.floor(domain.product_bytes(F.greatest("w", "h"), domain.SIZE_L1, domain.L1_BYTES))
    record = lambda refs: F.lit(26 + 8 + 4 * refs).cast("double")
    level = domain.level(F.col("conf"), F.lit(False), F.lit(False))
    image = 18 + size
    out = None
    for mode, payload, _relay in _MODES:
        if payload == "raw_image":
            own = d.select("image").distinct().select(codec.raw_packet_bytes(F.lit(768), F.lit(768)).cast("double").alias("bytes"))
        elif payload == "detections":
            own = d.where(F.col("conf") >= (0.5 if mode == "B1" else 0.25)).select(record(0).alias("bytes"))
        else:
            own = d.where(level > 0).select(F.when(level == 1, record(0)).otherwise(record(1) + domain.packet_bytes(image)).alias("bytes"))
        own = own.agg(N(), F.sum("bytes").cast("long").alias("bytes")).withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT rule, CAST(least(k, 3) AS INTEGER) AS level, count(*) AS n FROM (SELECT 'fixed' AS rule, CASE WHEN conf < 0.25 THEN 0 ELSE 2 END AS k FROM v_det UNION ALL SELECT 'capped', CASE WHEN conf < 0.25 THEN 0 ELSE least(2, CASE WHEN cx < 200 THEN 3 WHEN conf >= 0.67 THEN 1 ELSE 2 END) END FROM v_det) GROUP BY 1, 2", v.DET)
def ablation_levels(spark, sf):
    """Level rules of ablations: one level for all that is seen, and the usual rule with a cap."""
    d = v.detections(spark, sf)
    usual = domain.level(F.col("conf"), F.col("cx") < 200, F.lit(False))
    seen = F.col("conf") >= 0.25
    rules = F.array(F.struct(F.lit("fixed").alias("rule"), F.when(seen, 2).otherwise(0).alias("level")), F.struct(F.lit("capped").alias("rule"), F.least(usual, F.lit(2)).alias("level")))
    return d.select(F.inline(rules)).groupBy("rule", "level").agg(N())


@query("SELECT kind, count(*) AS n, round(sum(f), 6) AS sent, count(*) FILTER (f >= 1 - 1e-9) AS whole FROM (SELECT user_id, kind, sum(least(1.0, size / CAST(20000 AS DOUBLE))) AS f FROM v_items GROUP BY 1, 2) GROUP BY kind", v.ITEMS)
def route_summary(spark, sf):
    """Products of a route: whole once the shares that came add up to one."""
    per = v.items(spark, sf).groupBy("user_id", "kind").agg(F.sum(F.least(F.lit(1.0), F.col("size") / 20_000.0)).alias("f"))
    return per.groupBy("kind").agg(N(), R(F.sum("f")).alias("sent"), F.count_if(F.col("f") >= 1 - 1e-9).alias("whole"))


_MEASURED = v.TILES + ", v_seen AS (SELECT user_id, day, n_ships, CASE WHEN gate_score >= 0.9 THEN 'cloud' WHEN n_fp % 10 / CAST(50 AS DOUBLE) >= 0.08 OR user_id % 20 / CAST(100 AS DOUBLE) >= 0.12 THEN 'land_coast' WHEN n_candidates % 3 > 0 THEN 'candidates' ELSE 'empty_sea' END AS context FROM v_tiles)"


@query("SELECT context, CASE WHEN context = 'cloud' THEN 'cloud' WHEN context = 'land_coast' THEN 'coast' WHEN n_ships > 0 THEN 'ships' ELSE 'empty' END AS ctx, count(*) AS n FROM v_seen GROUP BY 1, 2", _MEASURED)
def prefilter_contexts(spark, sf):
    """Tiles by what their measures say they show, and by the context that the encoders plan with."""
    measures = (F.col("gate_score"), F.col("user_id") % 20 / F.lit(100.0), F.col("n_fp") % 10 / F.lit(50.0), F.col("n_candidates") % 3)
    t = v.tiles(spark, sf).withColumn("context", imaging.tile_context(*measures))
    return t.groupBy("context", imaging.planning_context(F.col("context"), F.col("n_ships")).alias("ctx")).agg(N())


@query("SELECT vec_id, CAST(win AS INTEGER) AS win, hash FROM v_hash", v.IMAGES)
def image_hashes(spark, sf):
    """Six perceptual hashes an image, one a window."""
    s = imaging.signatures(v.images(spark, sf), "vec_id", proof=False)
    return s.select("vec_id", F.posexplode("hashes").alias("win", "hash"))


@query("SELECT DISTINCT h.hash AS key, a, vec_id AS b FROM v_hash h JOIN (SELECT hash, min(vec_id) AS a FROM v_hash WHERE win = 0 GROUP BY hash) USING (hash) WHERE win = 0 AND vec_id > a", v.IMAGES)
def image_copies(spark, sf):
    """Images whose hash of the whole is one: each beside the least of them, however many they are."""
    s = imaging.signatures(v.images(spark, sf), "vec_id", proof=False).select("vec_id", F.get("hashes", F.lit(0)).alias("key"))
    return neighbours.bucket_members(s, "vec_id", "key")


@query("SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v_band a JOIN v_band b ON a.band = b.band AND a.bits = b.bits AND a.vec_id < b.vec_id JOIN (SELECT band, bits FROM v_band GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 200) r ON r.band = a.band AND r.bits = a.bits", v.IMAGES + ", v_band AS (SELECT DISTINCT vec_id, band, (hash >> (16 * band)) & 65535 AS bits FROM v_hash, (SELECT unnest(range(4)) AS band))")
def image_band_pairs(spark, sf):
    """Images that share 16 bits of any window's hash, in buckets of two to 200 (the rule's bound)."""
    s = imaging.signatures(v.images(spark, sf), "vec_id", proof=False).select("vec_id", F.explode(neighbours.band_keys(F.col("hashes"))).alias("key"))
    return neighbours.bucket_pairs(s, "vec_id", "key", 200)


@query("SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS same, 0 AS apart FROM embeddings WHERE list_max(embedding) > list_min(embedding)")
def image_evidence(spark, sf):
    """Every image beside a copy that is brighter: the proof of overlap finds the whole of each, at correlation one."""
    stored = table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(128).alias("level"))
    other = (-F.col("vec_id") - 1).alias("vec_id")
    pairs = stored.select(F.col("vec_id").alias("a"), other.alias("b"))
    grey = lambda of: F.transform(v.grey(of["embedding"]), lambda x: of["level"] + x * 512)
    found = imaging.image_evidence(pairs, stored.unionByName(stored.select(other, "embedding", F.lit(148).alias("level"))), "vec_id", grey, 64, 64)
    same = (F.col("coarse") > 0.999) & (F.col("share") > 0.9)
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(same).alias("same"), F.count_if(~same).cast("int").alias("apart"))
