"""Tiles and their detections to schedulable products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import domain as d

PRODUCT = "struct<kind:string,size:double,value:double,progressive:boolean,ship:bigint>"


def _product(kind: str, size, value, progressive: bool = False, ship: Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    ship = F.lit(None).cast("bigint") if ship is None else ship
    return F.struct(F.lit(kind).alias("kind"), as_col(size).cast("double").alias("size"), as_col(value).cast("double").alias("value"), F.lit(progressive).alias("progressive"), ship.alias("ship")).cast(PRODUCT)


def gate(tiles: DataFrame, threshold: float = d.GATE_EMPTY) -> DataFrame:
    """A tile may be dropped if its gate score says empty (or its context does) and nothing was found on it; no score means no."""
    empty = F.coalesce((F.col("gate_score") < threshold) | (F.col("ctx") == "empty"), F.lit(False))
    return tiles.withColumn("gate_empty", empty & (F.coalesce("n_ships", F.lit(0)) == 0) & (F.coalesce("n_fp", F.lit(0)) == 0))


def unconfirmed(tiles: DataFrame) -> DataFrame:
    """Candidates that no detection explains."""
    return tiles.withColumn("unconfirmed", F.greatest(F.lit(0).cast("long"), F.coalesce("n_candidates", F.lit(0)) - F.coalesce("n_ships", F.lit(0)) - F.coalesce("n_fp", F.lit(0))))


def encode_lod(tiles: DataFrame, low: float = d.CONF_LOW, high: float = d.CONF_HIGH, escalate: int = d.ESCALATE, audit: float = d.AUDIT_SHARE) -> DataFrame:
    """Level-of-detail products, one row each.

    ``tiles``: tile, ctx, gate_empty, unconfirmed, n_fp, coast_bytes, ``ships`` array<struct<id,conf,px,dark>>.
    Clouds give nothing. A thumbnail goes with every tile that isn't gated, and with an audited share of the
    gated (by hash of the tile). Coasts send the whole tile if ``unconfirmed`` reaches ``escalate`` and a mosaic
    of the seen ships otherwise; at sea each seen ship is L0 above ``high`` (40 bytes) or L1, and dark
    ones add L2. False alarms off the coast cost their bytes for no value.
    """
    seen = F.filter("ships", lambda s: s["conf"] >= low)
    worth = lambda ships: F.aggregate(ships, F.lit(0.0), lambda a, s: a + d.weight(s["dark"]).cast("double"))
    audited = F.pmod(F.xxhash64("tile", F.lit(7)), F.lit(1000)) < int(audit * 1000)
    none = F.array().cast(f"array<{PRODUCT}>")
    thumb = F.when(~F.col("gate_empty") | audited, F.array(_product("thumb", d.THUMB_BYTES, d.THUMB_VALUE))).otherwise(none)
    coast = F.when(F.col("unconfirmed") >= escalate, F.array(_product("tile", F.coalesce("coast_bytes", F.lit(d.COAST_TILE_BYTES)), worth(F.col("ships")), True))).otherwise(
        F.when(F.size(seen) > 0, F.array(_product("mosaic", d.MOSAIC_BYTES, worth(seen)))).otherwise(none)
    )
    per_ship = lambda s: F.concat(
        F.array(F.when(s["conf"] > high, _product("L0", d.L0_BYTES, d.weight(s["dark"]), ship=s["id"])).otherwise(_product("L1", d.product_bytes(s["px"], d.SIZE_L1, d.L1_BYTES), d.weight(s["dark"]), ship=s["id"]))),
        F.when(s["dark"], F.array(_product("L2", d.product_bytes(s["px"], d.SIZE_L2, d.L2_BYTES), 1, True, s["id"]))).otherwise(none),
    )
    sea = F.concat(F.flatten(F.transform(seen, per_ship)), F.array_repeat(_product("fp", d.L1_BYTES, 0), F.col("n_fp").cast("int")))
    found = F.when(F.col("ctx") == "cloud", none).otherwise(F.concat(thumb, F.when(F.col("ctx") == "coast", coast).otherwise(sea)))
    return tiles.select("tile", "t", F.explode(found).alias("p")).select("tile", "t", "p.*")


def encode_raw(tiles: DataFrame) -> DataFrame:
    """Every tile that isn't cloud as raw pixels."""
    worth = F.aggregate("ships", F.lit(0.0), lambda a, s: a + d.weight(s["dark"]).cast("double"))
    return tiles.where("ctx <> 'cloud'").select("tile", "t", F.lit("raw").alias("kind"), F.lit(float(d.RAW_TILE_BYTES)).alias("size"), worth.alias("value"))


def encode_fixed(tiles: DataFrame, patch: int = 1000, low: float = d.CONF_LOW, coastal: bool = True) -> DataFrame:
    """One fixed patch per seen ship, and per false alarm for no value."""
    where = F.col("ctx").isin("ships", "coast") if coastal else F.col("ctx") == "ships"
    ships = F.transform(F.filter("ships", lambda s: s["conf"] >= low), lambda s: _product("patch", patch, d.weight(s["dark"]), ship=s["id"]))
    wrong = F.array_repeat(_product("fp", patch, 0), F.col("n_fp").cast("int"))
    return tiles.select("tile", "t", F.explode(F.concat(F.when(where, ships).otherwise(F.array().cast(f"array<{PRODUCT}>")), wrong)).alias("p")).select("tile", "t", "p.*")


def encode_priority(tiles: DataFrame, roi_bytes: float = 900.0, low: float = d.CONF_LOW) -> DataFrame:
    """Priority products: P1 a 40-byte record worth the ship's weight, P2 a region, P3 context; on coasts one tile for all of level 3."""
    levels = F.transform(F.filter("ships", lambda s: s["conf"] >= low), lambda s: F.struct(s["id"].alias("id"), s["dark"].alias("dark"), d.level(s["conf"], F.col("ctx") == "coast", s["dark"]).alias("level")))
    none = F.array().cast(f"array<{PRODUCT}>")
    one = lambda s: F.concat(
        F.array(_product("P1", d.L0_BYTES, d.weight(s["dark"]), ship=s["id"])),
        F.when(s["level"] >= 2, F.array(_product("P2", roi_bytes, F.when(s["dark"], 1.5).otherwise(1.0), True, s["id"]))).otherwise(none),
    )
    deep = F.size(F.filter(levels, lambda s: s["level"] == 3))
    tile = F.when((F.col("ctx") == "coast") & (deep > 0) & ~F.col("gate_empty"), F.array(_product("P3", F.coalesce("coast_bytes", F.lit(d.COAST_TILE_BYTES)), deep * 0.5, True))).otherwise(none)
    wrong = F.array_repeat(_product("P1", d.L0_BYTES, 0), F.col("n_fp").cast("int"))
    found = F.when(F.col("ctx") == "cloud", none).otherwise(F.concat(F.flatten(F.transform(levels, one)), tile, wrong))
    return tiles.select("tile", "t", F.explode(found).alias("p")).select("tile", "t", "p.*")


def level_histogram(dets: DataFrame) -> DataFrame:
    """Detections (conf, coast, dark) per level."""
    return dets.select(d.level(F.col("conf"), F.col("coast"), F.col("dark")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def onboard_ceiling(ships: DataFrame, kind: str, low: float = d.CONF_LOW) -> DataFrame:
    """Share of ships that a product kind can report at all (ctx, conf): never under cloud."""
    fired, sea = F.col("conf") >= low, F.col("ctx") == "ships"
    known = {"raw": F.lit(True), "ocean": sea & fired, "detected": fired, "priority": fired, "lod": (F.col("ctx") == "coast") | fired}[kind]
    return ships.agg(F.avg(F.when((F.col("ctx") != "cloud") & known, 1.0).otherwise(0.0)).alias("ceiling"))


def information_kept(offered: DataFrame, got: DataFrame) -> DataFrame:
    """Weighted share of information delivered: full credit of a ship's level if all its products came, else of the best that did.

    ``offered``: ship, product, level, weight; ``got``: product.
    """
    credit = lambda c: F.when(F.col(c) == 1, 0.5).when(F.col(c) == 2, 0.8).when(F.col(c) == 3, 1.0).otherwise(0.0)
    came = offered.join(got.select("product", F.lit(True).alias("came")), "product", "left")
    per = came.groupBy("ship").agg(F.max("level").alias("level"), F.max("weight").alias("weight"), F.bool_and(F.coalesce("came", F.lit(False))).alias("whole"), F.max(F.when(F.col("came"), F.col("level"))).alias("best"))
    share = F.when(F.col("whole"), credit("level")).otherwise(credit("best"))
    return per.agg((F.sum(share * F.col("weight")) / F.sum("weight")).alias("kept"))
