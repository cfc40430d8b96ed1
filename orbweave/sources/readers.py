"""Typed readers and writers: catalogues, labels, masks, images, archives, reports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the tables that come as CSV.
SCHEMAS = {
    "tiles": "image string, context string, cloud_frac double, edge_density double, big_blob_frac double, n_candidates int, n_ships int, ctx3 string, gate_score double",
    "ships": "image string, size_px double, found boolean, conf double, ctx3 string, cloud_frac double",
    "predictions": "image string, cx double, cy double, w double, h double, conf double",
    "passes": "rise_utc string, set_utc string, duration_min double, max_elev_deg double, capacity_MB double",
    "isl_windows": "start timestamp, end timestamp, duration_s double, min_range_km double, mean_range_km double",
    "splits": "ImageId string, group int, split string, n_ships int",
}


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV table under its declared schema; columns are taken by name, those the file lacks are null."""
    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    header = spark.read.option("header", True).csv(path)
    return header.select(*[(F.col(f.name).cast(f.dataType) if f.name in header.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def zip_csv(archives: DataFrame, member: str, schema: str) -> DataFrame:
    """A CSV member of ZIP archives (binary column ``content``), one archive at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = {c.split()[0]: str for c in schema.split(", ") if c.split()[1] == "string"}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as f:
                    for part in pd.read_csv(f, chunksize=50_000, dtype=text):
                        yield part[names]

    return archives.select("content").mapInPandas(rows, schema)


def read_zip_csv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    return zip_csv(spark.read.format("binaryFile").load(path), member, schema)


def read_zip_images(spark: SparkSession, path: str, suffix: str = ".jpg") -> DataFrame:
    """``archive, image, content`` of the images in ZIP archives; an archive is read by one task, its members one by one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in sorted(m for m in z.namelist() if m.lower().endswith(suffix)):
                        yield pd.DataFrame({"archive": [name], "image": [member.rsplit("/", 1)[-1].rsplit(".", 1)[0]], "content": [z.read(member)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "archive string, image string, content binary")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Image paths beside the label paths of the same stem. Both: path."""
    return images.select(stem(F.col("path")).alias("image"), F.col("path").alias("image_path")).join(labels.select(stem(F.col("path")).alias("image"), F.col("path").alias("label_path")), "image")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``image, value`` of label lines that carry their image before a tab: one file for many images."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias("image"), parts[1].alias("value"))


def checked_labels(lines: DataFrame) -> DataFrame:
    """Label lines (image, value) with their fields and, where they cannot be read, the reason in ``error``."""
    f = F.split(F.trim("value"), r"\s+")
    number = [F.expr(f"try_cast(f[{i}] AS DOUBLE)") for i in range(5)]
    split = lines.withColumn("f", f)
    unread = F.lit(False)
    for n in number:
        unread = unread | n.isNull()
    return split.withColumn("error", F.when(F.size("f") < 5, "fields").when(unread, "number")).select("image", "value", *[F.when(F.size("f") >= 5, n).alias(k) for n, k in zip(number, ("cls", "x", "y", "bw", "bh"), strict=True)], "error")


def read_images(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """Image files with their sniffed format."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(stem(F.col("path")).alias("image"), "path", "length", sniff(F.col("content")).alias("format"), "content")


def sniff(content: Column) -> Column:
    """Format by magic bytes; null if none is known."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.startswith("424D"), "bmp").when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``image, value`` of label files named after their image."""
    return spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("image"), "value")


def parse_yolo(lines: DataFrame, width: float, height: float, classes: tuple[int, ...] | None = None) -> DataFrame:
    """Relative centre-form labels to pixels; lines with fewer than five fields or with words are skipped."""
    rows = checked_labels(lines).where("error IS NULL")
    rows = rows.where(F.col("cls").isin(*classes)) if classes else rows
    return rows.select("image", F.col("cls").cast("int").alias("cls"), (F.col("x") * width).alias("cx"), (F.col("y") * height).alias("cy"), (F.col("bw") * width).alias("w"), (F.col("bh") * height).alias("h"))


def read_yolo(spark: SparkSession, path: str, width: float, height: float, classes: tuple[int, ...] | None = None) -> DataFrame:
    return parse_yolo(_lines(spark, path), width, height, classes)


def parse_dota(lines: DataFrame, classes: tuple[str, ...] = ("ship",)) -> DataFrame:
    """Quadrilaterals to their upright boxes; other classes and header lines are skipped."""
    split = lines.select("image", F.split(F.trim("value"), r"\s+").alias("f"))
    num = [F.expr(f"try_cast(f[{i}] AS DOUBLE)").alias(f"c{i}") for i in range(8)]
    rows = split.where(F.size("f") >= 9).select("image", *num, F.lower(F.get("f", F.lit(8))).alias("cls"))
    rows = rows.where(" AND ".join(f"c{i} IS NOT NULL" for i in range(8))).where(F.col("cls").isin(*[c.lower() for c in classes]))
    xs, ys = [F.col(f"c{i}") for i in (0, 2, 4, 6)], [F.col(f"c{i}") for i in (1, 3, 5, 7)]
    x0, x1, y0, y1 = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    return rows.select("image", "cls", ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def read_dota(spark: SparkSession, path: str, classes: tuple[str, ...] = ("ship",)) -> DataFrame:
    return parse_dota(_lines(spark, path), classes)


COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def read_coco(spark: SparkSession, path: str, names: tuple[str, ...] = ("ship",), multi_line: bool = True) -> DataFrame:
    """Images with their boxes of the named categories; images without any keep an empty list. A document a file, or a line."""
    doc = spark.read.option("multiLine", multi_line).schema(COCO).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    cats = doc.select(F.explode("categories").alias("c")).where(F.lower("c.name").isin(*[n.lower() for n in names])).select(F.col("c.id").alias("category_id")).distinct()
    found = doc.select(F.explode("annotations").alias("a")).select("a.*").join(cats, "category_id", "left_semi")
    box = F.struct((F.col("bbox")[0] + F.col("bbox")[2] / 2).alias("cx"), (F.col("bbox")[1] + F.col("bbox")[3] / 2).alias("cy"), F.col("bbox")[2].alias("w"), F.col("bbox")[3].alias("h"))
    per = found.groupBy(F.col("image_id").alias("id")).agg(F.collect_list(box).alias("boxes"))
    return images.join(per, "id", "left").select("id", "file_name", "width", "height", F.coalesce("boxes", F.array().cast("array<struct<cx:double,cy:double,w:double,h:double>>")).alias("boxes"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Run-length masks per image; images without a mask keep an empty list."""
    rows = spark.read.option("header", True).schema("ImageId string, EncodedPixels string").csv(path)
    return rows.groupBy("ImageId").agg(F.collect_list("EncodedPixels").alias("masks"))


def write_yolo(boxes: DataFrame, path: str, width: float, height: float) -> None:
    """``0 cx cy w h`` to six places, one directory per split and image."""
    line = F.format_string("0 %.6f %.6f %.6f %.6f", F.col("cx") / width, F.col("cy") / height, F.col("w") / width, F.col("h") / height)
    boxes.select("split", "image", line.alias("value")).write.partitionBy("split", "image").text(path)


def write_yolo_lines(boxes: DataFrame, path: str, width: float, height: float) -> None:
    """The same lines, many images to a file, each line after its image and a tab."""
    line = F.format_string("0 %.6f %.6f %.6f %.6f", F.col("cx") / width, F.col("cy") / height, F.col("w") / width, F.col("h") / height)
    boxes.select(F.concat_ws("\t", "image", line).alias("value")).write.text(path)


def write_tagged(df: DataFrame, path: str, tag: str | None, default: bool) -> None:
    """CSV output; a run that isn't the default must carry a tag, and nothing is overwritten."""
    if not default and not tag:
        raise ValueError("a variant run needs a tag")
    df.write.mode("errorifexists").option("header", True).csv(path + (f"_{tag}" if tag else ""))


def write_report(summary: DataFrame, path: str) -> None:
    """A one-row summary as JSON on the driver."""
    with open(path, "w") as f:
        json.dump(summary.first().asDict(recursive=True), f, indent=2, default=str)
