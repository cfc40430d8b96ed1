"""Helpers that the operators share: joins that survive hot keys, and names that the input lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; fewer than its inverse can be.
HOT_SHARE = 1 / 512
#: Rows of a hot key that go to one task, about, at the least.
SALT_ROWS = 256


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}".lower() in taken:
        name += "_"
    return f"__{name}"


def salted_join(wide: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``wide`` joined to ``unique``, which has each key once at most; null keys meet nothing.

    Keys that hold over ``HOT_SHARE`` of the wide rows, fewer than 512 whatever the table, are counted first and
    collected; their rows are dealt to several tasks, and their one row on the other side is repeated for each.
    """
    total = wide.count()
    sizes = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(SALT_ROWS, total * HOT_SHARE)).collect()
    if not sizes:
        return wide.join(unique, keys, how)
    salt = spare(wide.join(unique, keys), "salt")
    spread = max(SALT_ROWS, total >> 12)
    hot = wide.sparkSession.createDataFrame([(*[r[k] for k in keys], -(-r["n"] // spread)) for r in sizes], ", ".join(f"{k} {t}" for k, t in wide.select(*keys).dtypes) + f", {salt} long")
    hot = F.broadcast(hot)
    dealt = wide.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(salt)), F.lit(0)))
    repeated = unique.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(salt) - 1, F.lit(0).cast("long")))))
    return dealt.join(repeated, [*keys, salt], how).drop(salt)
