"""Detections against ground truth: joins where a rule is many-to-one, per-image scans where it is greedy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import geometry as g
from orbweave.operators.prefix import prefix_sum, rank_within

BOX = ["cx", "cy", "w", "h"]


def pairs(dets: DataFrame, gts: DataFrame, how: str = "inner") -> DataFrame:
    """Detections beside the truths of their image (columns ``gt, g_cx, g_cy, g_w, g_h``)."""
    return dets.join(gts.select("image", "gt", *[F.col(k).alias("g_" + k) for k in BOX]), "image", how)


def iou_pairs(dets: DataFrame, gts: DataFrame, least: float) -> DataFrame:
    """Pairs of one image whose overlap is ``least`` or more."""
    return pairs(dets, gts).withColumn("iou", g.iou(g.box(), g.box("g_"))).where(F.col("iou") >= least)


def match_any(dets: DataFrame, gts: DataFrame, least: float = 0.3) -> DataFrame:
    """Many-to-one rule: a detection is right if any truth of its image overlaps enough; else a false alarm."""
    best = pairs(dets, gts, "left").groupBy("image", "det").agg(F.max(F.when(F.col("gt").isNotNull(), g.iou(g.box(), g.box("g_")))).alias("best"))
    return best.select("image", "det", (F.coalesce("best", F.lit(0.0)) >= least).alias("hit"))


def match_loose(dets: DataFrame, gts: DataFrame, least: float = 0.1) -> DataFrame:
    """A truth is found if any box overlaps a little or holds its centre."""
    near = (g.iou(g.box(), g.box("g_")) >= least) | g.holds_centre(g.box(), g.box("g_"))
    found = pairs(dets, gts).groupBy("image", "gt").agg(F.bool_or(near).alias("f"))
    return gts.select("image", "gt").join(found, ["image", "gt"], "left").select("image", "gt", F.coalesce("f", F.lit(False)).alias("found"))


def iou_matrix(a: np.ndarray, b: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """All overlaps between two arrays of boxes."""
    low = np.maximum(a[:, None, :2] - a[:, None, 2:] / 2, b[None, :, :2] - b[None, :, 2:] / 2)
    high = np.minimum(a[:, None, :2] + a[:, None, 2:] / 2, b[None, :, :2] + b[None, :, 2:] / 2)
    inter = np.prod(np.clip(high - low, 0, None), axis=2)
    union = a[:, 2:].prod(1)[:, None] + b[:, 2:].prod(1)[None, :] - inter + eps
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def greedy(over: np.ndarray, rule: str, least: float) -> list[tuple[int, int]]:
    """One-to-one matching of rows (in their order) to columns.

    ``last``: a later candidate wins ties (``>=``); ``first``: the first wins (strict ``>``), then the
    least overlap applies; ``argmax``: as ``first`` over what is still free.
    """
    free, out = np.ones(over.shape[1], dtype=bool), []
    for i in range(over.shape[0]):
        row = np.where(free, over[i], -1.0)
        if not len(row) or row.max() < least or row.max() <= 0 and rule != "last":
            continue
        best = row.max()
        j = int(np.flatnonzero(row == best)[-1 if rule == "last" else 0])
        free[j] = False
        out.append((i, j))
    return out


def by_image(batch: pd.DataFrame, order: list[str], rising: list[bool]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per image: ids, boxes and confidences in the given order, as slices of three sorted arrays."""
    own = batch.sort_values(["image", *order], ascending=[True, *rising])
    image = own["image"].to_numpy()
    ids = own["det" if "det" in own else "gt"].to_numpy()
    box, conf = own[BOX].to_numpy(float), own["conf"].to_numpy(float) if "conf" in own else np.zeros(len(own))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(image)) + 1, [len(image)]]) if len(image) else [0]
    return {int(image[i]): (ids[i:j], box[i:j], conf[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)}


MATCHED = "image long, det long, gt long, conf double, iou double"


#: Boxes that share a call to Python, about.
BUCKET_BOXES = 8192


def _buckets(boxes: DataFrame) -> int:
    """Groups of images for Python calls of a bounded size, however many boxes there are."""
    return max(1, boxes.count() // BUCKET_BOXES)


def match_greedy(dets: DataFrame, gts: DataFrame, rule: str = "voc", least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matching per image; images share groups of about ``BUCKET_BOXES`` boxes, which spreads the cost of a call.

    ``voc``: detections by falling confidence, later truth wins ties. ``truth_last`` and ``truth_first``:
    truths in order, last or first detection wins ties. ``conf_argmax``: detections by falling
    confidence, first truth wins ties. Unmatched detections have a null ``gt``, unmatched truths a null ``det``.
    """
    by_conf, key = rule in ("voc", "conf_argmax"), F.pmod(F.xxhash64("image"), F.lit(_buckets(dets))).alias("__bucket")
    none = (np.zeros(0, dtype=np.int64), np.zeros((0, 4)), np.zeros(0))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d = by_image(left, ["conf", "det"] if by_conf else ["det"], [False, True] if by_conf else [True])
        t, rows = by_image(right, ["gt"], [True]), []
        for image in d.keys() | t.keys():
            (di, db, dc), (ti, tb, _) = d.get(image, none), t.get(image, none)
            over = iou_matrix(db, tb, 1e-6 if rule == "conf_argmax" else 0.0)
            if by_conf:
                got = greedy(over, "last" if rule == "voc" else "first", least)
            else:
                got = [(i, j) for j, i in greedy(over.T, "last" if rule == "truth_last" else "first", least)]
            used, seen = {i for i, _ in got}, {j for _, j in got}
            rows += [(image, int(di[i]), int(ti[j]), float(dc[i]), float(over[i, j])) for i, j in got]
            rows += [(image, int(di[i]), None, float(dc[i]), None) for i in range(len(di)) if i not in used]
            rows += [(image, None, int(ti[j]), None, None) for j in range(len(ti)) if j not in seen]
        return pd.DataFrame(rows, columns=["image", "det", "gt", "conf", "iou"]).astype({"det": "Int64", "gt": "Int64"})

    left = dets.select("image", "det", *BOX, "conf", key)
    return left.groupBy("__bucket").cogroup(gts.select("image", "gt", *BOX, key).groupBy("__bucket")).applyInPandas(run, MATCHED)


def non_maximum(dets: DataFrame, threshold: float = 0.5, strict: bool = False, candidates: int | None = None, most: int | None = None) -> DataFrame:
    """Greedy suppression per image, by falling confidence. A box goes if it overlaps a kept one by ``threshold``
    or more; with ``strict`` only by more. ``candidates`` and ``most`` bound the boxes of an image that take part and stay, as a
    detector's own rule does (30,000 and 300); the best stay."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        own = batch.sort_values(["image", "conf", "det"], ascending=[True, False, True]).drop(columns="__bucket")
        box, image = own[BOX].to_numpy(float), own["image"].to_numpy()
        cuts, keep = np.concatenate([[0], np.flatnonzero(np.diff(image)) + 1, [len(image)]]), np.ones(len(own), dtype=bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            stop = b if candidates is None else min(b, a + candidates)
            keep[stop:b] = False
            for i in range(a, stop):
                if keep[i]:
                    over = iou_matrix(box[i : i + 1], box[i + 1 : stop])[0]
                    keep[i + 1 : stop] &= ~(over > threshold if strict else over >= threshold)
            if most is not None:
                keep[a + np.flatnonzero(keep[a:b])[most:]] = False
        return own[keep]

    schema = "image long, det long, cx double, cy double, w double, h double, conf double"
    return dets.select("image", "det", *BOX, "conf", F.pmod(F.xxhash64("image"), F.lit(_buckets(dets))).alias("__bucket")).groupBy("__bucket").applyInPandas(run, schema)


def lift(dets: DataFrame, slices: DataFrame, least_conf: float = 0.0) -> DataFrame:
    """Slice coordinates to image coordinates: the slice's origin (``ox, oy``) is added, weak boxes go."""
    return dets.join(slices, "slice").where(F.col("conf") >= least_conf).withColumns({"cx": F.col("cx") + F.col("ox"), "cy": F.col("cy") + F.col("oy")})


def scores(matched: DataFrame, least_conf: float = 0.0) -> DataFrame:
    """Precision, recall and F1 from a matching, of detections of ``least_conf`` or more; null without detections or truths.

    A truth whose match is weaker counts as missed. Higher confidences are matched first, so weaker ones take nothing from them.
    """
    strong = F.col("conf") >= least_conf
    hit, wrong, missed = F.count_if(strong & F.col("gt").isNotNull()), F.count_if(strong & F.col("gt").isNull()), F.count_if(F.col("gt").isNotNull() & ~F.coalesce(strong, F.lit(False)))
    out = matched.agg(hit.alias("tp"), wrong.alias("fp"), missed.alias("fn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    p, r = ratio("tp", "fp"), ratio("tp", "fn")
    return out.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def average_precision(matched: DataFrame, points: int = 100) -> DataFrame:
    """``ap``: area by trapezoids under the precision envelope, linear between recalls, at ``points + 1`` recalls; null without truths.

    Detections come by falling confidence, then image and number. The curve is known from the place of each right
    detection in that order, so all that is kept of it is: per step of the grid the highest precision, and the places of the right
    detections next to a grid point. At one recall the last and lowest precision counts, as it does for interpolation.
    """
    truths = matched.agg(F.count("gt").alias("n")).first()["n"]
    schema = "ap double"
    spark = matched.sparkSession
    if not truths:
        return spark.createDataFrame([(None,)], schema)
    found = matched.where("det IS NOT NULL").select("image", "det", "conf", F.col("gt").isNotNull().cast("long").alias("right"), F.lit(0).alias("all"), (-F.floor(F.col("conf") * 65_536)).alias("block"))
    order = [F.desc("conf"), F.col("image"), F.col("det")]
    ranked = prefix_sum(rank_within(found, ["all"], "block", order, "place"), ["all"], "block", order, "right", "t")
    total, best = ranked.agg(F.count(F.lit(1)), F.coalesce(F.max("t"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([(0.0,)], schema)
    right = ranked.where("right = 1").select("t", "place")
    below = [k * truths // points for k in range(points + 1)]
    near = sorted({t + 1 for t in below})
    cell = F.ceil(F.col("t") * points / truths).cast("int")
    cells = {r["k"]: r["p"] for r in right.groupBy(cell.alias("k")).agg(F.max(F.col("t") / F.col("place")).alias("p")).collect()}
    places = {r["t"]: r["place"] for r in right.where(F.col("t").isin(near)).collect()}
    above = [0.0] * (points + 2)
    for k in range(points, -1, -1):
        above[k] = max(above[k + 1], cells.get(k + 1, 0.0))
    area, heights = 0.0, []
    for k in range(points + 1):
        t, x = min(below[k], best), k / points
        last = places[t + 1] - 1 if t < best else total
        low = 1.0 if not last else max(t / last, above[k])
        ahead, high = ((t + 1) / truths, above[k]) if t < best else (1.0, 0.0)
        at = t / truths
        heights.append(0.0 if k == points else low + (high - low) * (x - at) / (ahead - at) if ahead > at else low)
    for a, b in zip(heights, heights[1:], strict=False):
        area += (a + b) / 2 / points
    return spark.createDataFrame([(area,)], schema)


def describe(dets: DataFrame, least_conf: float = 0.25) -> DataFrame:
    """Counts and confidence statistics where there is no truth."""
    kept = dets.where(F.col("conf") >= least_conf)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("conf").alias("least"), F.expr("percentile(conf, 0.5)").alias("median"), F.avg("conf").alias("mean"), F.max("conf").alias("most"))


