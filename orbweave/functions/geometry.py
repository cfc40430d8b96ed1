"""Box algebra as column expressions. A box is centre-form (cx, cy, w, h) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + k) for k in ("cx", "cy", "w", "h"))


def overlap(a, b) -> Column:
    """Area of the intersection."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k] + a[k + 2] / 2, b[k] + b[k + 2] / 2) - F.greatest(a[k] - a[k + 2] / 2, b[k] - b[k + 2] / 2))
    return side(0) * side(1)


def iou(a, b, eps: float = 0.0) -> Column:
    """Intersection over union, 0 where the union is not positive; ``eps`` is added to the union."""
    inter = overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - inter + F.lit(eps)
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def holds_centre(a, b) -> Column:
    """Whether a holds the centre of b: the low edge counts, the high edge does not."""
    return (a[0] - a[2] / 2 <= b[0]) & (b[0] < a[0] + a[2] / 2) & (a[1] - a[3] / 2 <= b[1]) & (b[1] < a[1] + a[3] / 2)


def clip(a, width: float, height: float) -> dict[str, Column]:
    """Corners of a box clipped to a tile."""
    cut = lambda v, high: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(high)))
    return {"x0": cut(a[0] - a[2] / 2, width), "y0": cut(a[1] - a[3] / 2, height), "x1": cut(a[0] + a[2] / 2, width), "y1": cut(a[1] + a[3] / 2, height)}


def slice_origins(length: Column, window: int = 768, share: float = 0.2) -> Column:
    """Window origins along one side: steps of ``round(window * (1 - share))``, the last held inside, none twice."""
    step = round(window * (1 - share))
    last = F.greatest(length - window, F.lit(0)).cast("long")
    count = F.ceil(last / F.lit(float(step))).cast("long")
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: F.least(i * step, last)))


def crop_square(a, width: int, height: int, margin: float = 0.5) -> dict[str, Column]:
    """A square of side ``max(w, h) * (1 + margin)`` about the centre, truncated to whole pixels and clipped."""
    side = F.greatest(a[2], a[3]) * (1 + margin)
    low = lambda c: F.greatest((c - side / 2).cast("int"), F.lit(0))
    return {"x0": low(a[0]), "y0": low(a[1]), "x1": F.least((a[0] + side / 2).cast("int"), F.lit(width)), "y1": F.least((a[1] + side / 2).cast("int"), F.lit(height))}


def letterbox(width: Column, height: Column, side: int = 768) -> dict[str, Column]:
    """Scale and padding that centre an image in a square."""
    r = F.least(side / width, side / height)
    return {"scale": r, "pad_x": (side - width * r) / 2, "pad_y": (side - height * r) / 2}


def rle_runs(mask: Column) -> Column:
    """``start length ...`` (1-based, column-major) as an array of runs."""
    parts = F.transform(F.split(F.trim(mask), r"\s+"), lambda x: x.cast("long"))
    return F.when(F.trim(mask) == "", F.array().cast("array<struct<start:bigint,len:bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, 2 * i).alias("start"), F.get(parts, 2 * i + 1).alias("len")))
    )


def rle_box(runs: Column, height: int) -> dict[str, Column]:
    """Bounding box of column-major runs without building the mask; a run over several columns spans the full height."""
    first, last = (lambda r: r["start"] - 1), (lambda r: r["start"] + r["len"] - 2)
    wraps = lambda r: F.floor(first(r) / height) < F.floor(last(r) / height)
    x0 = F.array_min(F.transform(runs, lambda r: F.floor(first(r) / height)))
    x1 = F.array_max(F.transform(runs, lambda r: F.floor(last(r) / height)))
    y0 = F.array_min(F.transform(runs, lambda r: F.when(wraps(r), F.lit(0)).otherwise(first(r) % height)))
    y1 = F.array_max(F.transform(runs, lambda r: F.when(wraps(r), F.lit(height - 1)).otherwise(last(r) % height)))
    return {"x": x0, "y": y0, "w": x1 - x0 + 1, "h": y1 - y0 + 1}


def iou_corner(a, b) -> Column:
    """Intersection over union of boxes (x, y, w, h) given by their top left corner; 0 where both are empty."""
    side = lambda k: F.greatest(F.lit(0), F.least(a[k] + a[k + 2], b[k] + b[k + 2]) - F.greatest(a[k], b[k]))
    inter = side(0) * side(1)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def rle_encode(cells: DataFrame, by: str, place: str) -> DataFrame:
    """``by, mask``: the places (1-based, column by column) of each mask as ``start length ...``; runs are places less their rank."""
    ranked = cells.withColumn("__run", F.col(place) - F.row_number().over(Window.partitionBy(by).orderBy(place)))
    runs = ranked.groupBy(by, "__run").agg(F.min(place).alias("__s"), F.count(F.lit(1)).alias("__n"))
    ordered = F.array_sort(F.collect_list(F.struct("__s", "__n")))
    return runs.groupBy(by).agg(F.concat_ws(" ", F.transform(ordered, lambda r: F.concat_ws(" ", r["__s"].cast("string"), r["__n"].cast("string")))).alias("mask"))


def rle_decode(masks: DataFrame, by: str, mask: str) -> DataFrame:
    """``by, p``: every place of each mask."""
    runs = masks.select(by, F.explode(rle_runs(F.col(mask))).alias("r"))
    return runs.select(by, F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.len") - 1)).alias("p"))
