"""Sources and sinks as round trips: tables of the driver written in a format of the domain and read back by its reader."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from orbweave.operators import statistics
from orbweave.plans import views as v
from orbweave.plans.book import book
from orbweave.session import table
from orbweave.sources import readers
from orbweave.storage import shared_path
from orbweave.streaming import online

QUERIES, ORACLES, query = book()
R = lambda c, n=6: F.round(c, n)
_GT = "SELECT CAST(image AS VARCHAR) AS image, count(*) AS n, round(sum(cx), 2) AS cx, round(sum(w), 2) AS w FROM v_gt GROUP BY image"


def _truths(spark, sf):
    return v.truths(spark, sf).withColumn("image", F.col("image").cast("string"))


def _summed(boxes):
    return boxes.groupBy("image").agg(F.count(F.lit(1)).alias("n"), R(F.sum("cx"), 2).alias("cx"), R(F.sum("w"), 2).alias("w"))


@query("SELECT CAST(image AS VARCHAR) AS image, cx, cy, w, h, conf FROM v_det", v.DET)
def csv_round_trip(spark, sf):
    path = shared_path(spark, "predictions-csv")
    readers.write_tagged(v.detections(spark, sf).select("image", "conf", "cx", "cy", "w", "h"), path, None, True)
    return readers.read_csv(spark, path, "predictions")


@query("SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM v_items GROUP BY kind", v.ITEMS)
def json_round_trip(spark, sf):
    path = shared_path(spark, "items-json")
    v.items(spark, sf).select("id", "kind", "size").write.json(path)
    return spark.read.schema("id long, kind string, size long").json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(_GT, v.DET)
def yolo_round_trip(spark, sf):
    """Labels relative to their image, six places, read back to pixels."""
    path = shared_path(spark, "labels-yolo")
    readers.write_yolo_lines(_truths(spark, sf), path, 768.0, 768.0)
    return _summed(readers.parse_yolo(readers.read_lines(spark, path), 768.0, 768.0).select("image", "cx", "w"))


@query(_GT.replace("GROUP BY", "WHERE gt % 3 <> 0 GROUP BY"), v.DET)
def dota_round_trip(spark, sf):
    """Quadrilaterals with a class, of which every third is another one."""
    path = shared_path(spark, "labels-dota")
    x0, x1, y0, y1 = (F.col(a) + s * F.col(b) / 2 for a, b, s in (("cx", "w", -1), ("cx", "w", 1), ("cy", "h", -1), ("cy", "h", 1)))
    line = F.concat_ws(" ", *[c.cast("string") for c in (x0, y0, x1, y0, x1, y1, x0, y1)], F.when(F.col("gt") % 3 == 0, "plane").otherwise("Ship"), F.lit("0"))
    _truths(spark, sf).select(F.concat_ws("\t", "image", line).alias("value")).write.text(path)
    return _summed(readers.parse_dota(readers.read_lines(spark, path)).select("image", "cx", "w"))


@query("SELECT i.image, count(g.gt) AS n FROM (SELECT DISTINCT CAST(image AS VARCHAR) AS image FROM v_det) i LEFT JOIN v_gt g ON CAST(g.image AS VARCHAR) = i.image GROUP BY 1", v.DET)
def coco_round_trip(spark, sf):
    """One document a thousand images: images, annotations, categories; images without boxes stay."""
    path = shared_path(spark, "labels-coco")
    part = F.floor(F.col("image") / 1000).alias("part")
    images = v.detections(spark, sf).select("image").distinct().groupBy(part).agg(F.collect_list(F.struct(F.col("image").alias("id"), F.col("image").cast("string").alias("file_name"), F.lit(768).alias("width"), F.lit(768).alias("height"))).alias("images"))
    box = F.array(F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2, "w", "h")
    notes = v.truths(spark, sf).groupBy(part).agg(F.collect_list(F.struct(F.col("image").alias("image_id"), F.lit(3).cast("long").alias("category_id"), box.alias("bbox"))).alias("annotations"))
    kinds = F.array(F.struct(F.lit(3).cast("long").alias("id"), F.lit("Ship").alias("name")))
    images.join(notes, "part", "left").select("images", "annotations", kinds.alias("categories")).write.json(path)
    return readers.read_coco(spark, path, multi_line=False).select(F.col("file_name").alias("image"), F.size("boxes").cast("long").alias("n"))


@query("SELECT CAST(g.image AS VARCHAR) AS image, count(*) AS n, CAST(max(CASE WHEN g.image % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS has_labels FROM v_det g WHERE g.image % 2 = 0 GROUP BY 1", v.DET)
def paired_files(spark, sf):
    """Images joined to label files by the stem of their paths; images without labels, and labels without images, are left out."""
    d = v.detections(spark, sf)
    images = d.select(F.concat(F.lit("/img/"), "image", F.lit(".jpg")).alias("path")).distinct()
    labels = d.where("image % 2 = 0").select(F.concat(F.lit("/ann/"), "image", F.lit(".txt")).alias("path")).unionByName(spark.createDataFrame([("/ann/none.txt",)], "path string"))
    return readers.paired(images, labels).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("has_labels"))


@query("SELECT CASE WHEN gt % 5 = 0 THEN 'fields' WHEN gt % 5 = 1 THEN 'number' END AS error, count(*) AS n FROM v_gt GROUP BY 1", v.DET)
def label_errors(spark, sf):
    """Label lines that cannot be read keep their reason: too few fields, or one that is no number."""
    good = F.concat_ws(" ", F.lit("0"), *[(F.col(c) / 768).cast("string") for c in ("cx", "cy", "w", "h")])
    line = F.when(F.col("gt") % 5 == 0, "0 0.5 0.5").when(F.col("gt") % 5 == 1, "0 0.5 x 0.1 0.1").otherwise(good)
    rows = _truths(spark, sf).select("image", line.alias("value"))
    return readers.checked_labels(rows).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(image AS VARCHAR) AS image, cx FROM v_det WHERE image % 7 = 0", v.DET)
def zip_csv(spark, sf):
    """A CSV member of ZIP archives, one archive a task."""
    path = shared_path(spark, "archives")

    def pack(batches):
        for b in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("a/predictions.csv", b.to_csv(index=False))
            yield pd.DataFrame({"path": ["x"], "content": [out.getvalue()]})

    made = v.detections(spark, sf).where("image % 7 = 0").select(F.col("image").cast("string").alias("image"), "cx").mapInPandas(pack, "path string, content binary")
    made.select("content").write.parquet(path)
    return readers.zip_csv(spark.read.parquet(path), "a/predictions.csv", "image string, cx double")


@query("SELECT 'stage_' || (k % 3) AS stage, round(max(v), 6) AS ms FROM (SELECT range AS k, range * CAST(0.25 AS DOUBLE) AS v FROM range(12)) GROUP BY 1")
def stage_times(spark, sf):
    """Times that several reports carry, put into one table; of one stage the latest report counts."""
    path = shared_path(spark, "reports")
    spark.range(12).select("id", F.map_from_arrays(F.array(F.concat(F.lit("stage_"), F.col("id") % 3)), F.array(F.col("id") * 0.25)).alias("stage_ms")).write.json(path)
    rows = spark.read.schema("id long, stage_ms map<string,double>").json(path).select("id", F.explode("stage_ms").alias("stage", "ms"))
    return rows.groupBy("stage").agg(R(F.max_by("ms", "id")).alias("ms"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, count(*) AS n FROM events GROUP BY 1")
def streamed_days(spark, sf):
    """Tumbling days by the streaming operator over all events, run to its end."""
    src, out, state = (shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("all").alias("kind"), F.lit(1).cast("long").alias("size"))
    e.repartition(4).write.parquet(src)
    flood = spark.sql("SELECT TIMESTAMP '2100-01-01' AS ts, 'end' AS kind, CAST(0 AS BIGINT) AS size")
    stream = spark.readStream.schema(e.schema).parquet(src)
    daily = online.daily_totals(stream)
    run = daily.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    flood.write.mode("append").parquet(src)  # the watermark passes the last day
    run = daily.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).where("kind = 'all'").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT check_name, broken, broken = 0 AS ok FROM (SELECT 'conf in range' AS check_name, count(*) FILTER (NOT conf BETWEEN 0 AND 1) AS broken FROM v_det UNION ALL SELECT 'positive size', count(*) FILTER (NOT (w > 0 AND h > 0)) FROM v_det UNION ALL SELECT 'inside the tile', count(*) FILTER (NOT (cx BETWEEN 0 AND 768 AND cy BETWEEN 0 AND 768)) FROM v_det UNION ALL SELECT 'known context', count(*) FILTER (ctx NOT IN ('cloud', 'ships', 'coast', 'empty')) FROM v_tiles UNION ALL SELECT 'gate score in range', count(*) FILTER (NOT gate_score BETWEEN 0 AND 1) FROM v_tiles UNION ALL SELECT 'found among candidates', count(*) FILTER (NOT n_ships + n_fp <= n_candidates) FROM v_tiles UNION ALL SELECT 'positive bytes', count(*) FILTER (NOT size > 0) FROM v_items UNION ALL SELECT 'known kind', count(*) FILTER (kind NOT IN ('L0', 'L1', 'thumb', 'tile', 'fp')) FROM v_items UNION ALL SELECT 'records of 40 bytes', count(*) FILTER (kind = 'L0' AND size <> 40) FROM v_items UNION ALL SELECT 'pass ends after it rises', count(*) FILTER (NOT set_s > rise_s) FROM v_passes UNION ALL SELECT 'pass carries bytes', count(*) FILTER (NOT capacity > 0) FROM v_passes)", v.TILES + ", " + v.DET + ", " + v.PASSES)
def validation_list(spark, sf):
    """Named checks over detections, tiles, items and passes, one scan each."""
    c = F.col
    parts = [
        statistics.expectations(v.detections(spark, sf), {"conf in range": c("conf").between(0, 1), "positive size": (c("w") > 0) & (c("h") > 0), "inside the tile": c("cx").between(0, 768) & c("cy").between(0, 768)}),
        statistics.expectations(v.tiles(spark, sf), {"known context": c("ctx").isin("cloud", "ships", "coast", "empty"), "gate score in range": c("gate_score").between(0, 1), "found among candidates": c("n_ships") + c("n_fp") <= c("n_candidates")}),
        statistics.expectations(v.items(spark, sf), {"positive bytes": c("size") > 0, "known kind": c("kind").isin("L0", "L1", "thumb", "tile", "fp"), "records of 40 bytes": (c("kind") != "L0") | (c("size") == 40)}),
        statistics.expectations(v.passes(spark), {"pass ends after it rises": c("set_s") > c("rise_s"), "pass carries bytes": c("capacity") > 0}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
