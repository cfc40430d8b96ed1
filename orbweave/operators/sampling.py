"""Draws that depend on ids alone: days of tiles by context mix, scenes, splits of a shuffled list. Uniform numbers come from MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.prefix import rank_within

# Contexts and their shares on an orbit, side of a tile, tiles a side of a scene.
CONTEXTS = ("cloud", "ships", "coast", "empty")
ORBIT_MIX = (0.15, 0.20, 0.05, 0.60)
TILE, PER_SIDE = 768, 4


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: its first 32 bits."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def context_of(u: Column, mix: dict[str, float]) -> Column:
    """The context at a uniform number: shares in the fixed order of contexts, added up to one."""
    total, at, out = sum(mix.values()), 0.0, F
    for name in [c for c in CONTEXTS if mix.get(c)]:
        at += mix[name]
        out = out.when(u < at / total, F.lit(name))
    return out.otherwise(F.lit([c for c in CONTEXTS if mix.get(c)][-1]))


def sample_day(pool: DataFrame, n: int, hours: float = 24.0, mix: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``slot, t, ctx`` and the columns of a tile of that context, drawn with replacement; contexts without tiles are left out of the mix.

    ``pool``: tile, ctx and other columns. The tiles of a context are numbered by two-level ranks, the slots name a number,
    and an equi-join brings them together, so a day of any size draws from a pool of any size.
    """
    numbered = rank_within(pool.withColumn("__block", F.floor(F.col("tile") / 4096)), ["ctx"], "__block", [F.col("tile")], "number").drop("__block")
    sizes = {r["ctx"]: r["n"] for r in pool.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).collect() if r["ctx"] in CONTEXTS}
    shares = {c: s for c, s in (mix or dict(zip(CONTEXTS, ORBIT_MIX, strict=True))).items() if sizes.get(c) and s}
    if not shares:
        raise ValueError("no tile has a context of the mix")
    size = F.element_at(F.create_map(*[x for c, k in sizes.items() for x in (F.lit(c), F.lit(k).cast("long"))]), F.col("ctx"))
    slots = pool.sparkSession.range(n).select(F.col("id").alias("slot"), (uniform(F.lit(f"t{seed}"), "id") * hours * 3600).alias("t"), context_of(uniform(F.lit(f"c{seed}"), "id"), shares).alias("ctx"))
    slots = slots.withColumn("number", (F.floor(uniform(F.lit(f"p{seed}"), "slot") * size) + 1).cast("long"))
    return slots.join(numbered, ["ctx", "number"]).drop("number")


def sample_scenes(pool: DataFrame, n: int, per_side: int = PER_SIDE, mix: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Scenes of ``per_side`` by ``per_side`` tiles: ``scene, row, col, x0, y0`` and the tile's columns."""
    day = sample_day(pool, n * per_side * per_side, mix=mix, seed=seed).drop("t")
    place = F.col("slot") % (per_side * per_side)
    row, col = F.floor(place / per_side), place % per_side
    return day.withColumns({"scene": F.floor(F.col("slot") / (per_side * per_side)), "row": row, "col": col, "x0": col * TILE, "y0": row * TILE}).drop("slot")


def scene_truths(scenes: DataFrame, truths: DataFrame) -> DataFrame:
    """Boxes of each scene in its own pixels. ``truths``: tile, cx, cy, w, h."""
    return scenes.select("scene", "row", "col", "x0", "y0", "tile").join(truths, "tile").select("scene", "row", "col", "tile", (F.col("cx") + F.col("x0")).alias("cx"), (F.col("cy") + F.col("y0")).alias("cy"), "w", "h")


def tile_of(cx: Column, cy: Column, per_side: int = PER_SIDE) -> Column:
    """Number of the tile of a scene that holds a point; points beyond the edge belong to the last tile."""
    cell = lambda v: F.least(F.greatest(F.floor(v / TILE), F.lit(0)), F.lit(per_side - 1))
    return (cell(cy) * per_side + cell(cx)).cast("long")


def day_instances(scenes: DataFrame, n: int, hours: float = 24.0, seed: int = 0) -> DataFrame:
    """``instance, t, scene``: scenes of a day in order of time, drawn with replacement from ``scene`` 0 to the last."""
    last = scenes.agg(F.max("scene")).first()[0]
    drawn = scenes.sparkSession.range(n).select((uniform(F.lit(f"d{seed}"), "id") * hours * 3600).alias("t"), F.floor(uniform(F.lit(f"s{seed}"), "id") * (last + 1)).alias("scene"), "id")
    return rank_within(drawn.withColumns({"all": F.lit(0), "block": F.floor(F.col("t") / 60)}), ["all"], "block", [F.col("t"), F.col("id")], "instance").select((F.col("instance") - 1).alias("instance"), "t", "scene")


def sequential_split(rows: DataFrame, key: str, cuts: tuple[tuple[str, float], ...] = (("val", 0.1), ("test", 0.2), ("train", 1.0)), seed: int = 0) -> DataFrame:
    """Rows in hash order, cut at shares of their number: by default a tenth, a tenth and the rest."""
    total = rows.count()
    u = rows.withColumn("u", uniform(F.lit(str(seed)), key)).withColumns({"all": F.lit(0), "block": F.floor(F.col("u") * 4096)})
    ranked, name = rank_within(u, ["all"], "block", [F.col("u"), F.col(key)], "rank"), F
    for split, share in cuts:
        name = name.when(F.col("rank") <= int(share * total), F.lit(split))
    return ranked.withColumn("split", name.otherwise(F.lit(cuts[-1][0]))).drop("u", "all", "block", "rank")


def last_rows(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group by an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
