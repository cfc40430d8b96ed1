"""Downlink planning as sets: as-of joins to a contact plan, first-in-first-out as running sums, metrics of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.prefix import prefix_sum

#: Seconds of a step of the plan, and the number of steps up to which the plan is broadcast.
STEP_S = 86_400
BROADCAST_STEPS = 1 << 14


def next_window(items: DataFrame, windows: DataFrame, at: str, start: str, carry: list[str]) -> DataFrame:
    """Forward as-of join to a contact plan: the first window that starts at ``at`` or later; null beyond the plan.

    The plan is cut into days. A day's row has the day's windows in order and the first window after the day, whether the
    next day has one or not, so an item meets one row and compares itself with the windows of one day. The items are neither
    sorted nor, while the plan has up to ``BROADCAST_STEPS`` days, shuffled.
    """
    day = lambda c: F.floor(F.col(c).cast("double") / STEP_S).cast("long")
    window = F.struct(F.col(start).cast("double").alias("__s"), *carry)
    own = windows.where(F.col(start).isNotNull()).groupBy(day(start).alias("__day")).agg(F.array_sort(F.collect_list(window)).alias("__own"))
    span = own.agg(F.min("__day").alias("low"), F.max("__day").alias("high")).first()
    if span["low"] is None:
        return items.select("*", *[F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in carry])
    low, high = span["low"], span["high"]
    days = items.sparkSession.range(low, high + 1).withColumnRenamed("id", "__day").join(own, "__day", "left")
    after = Window.orderBy("__day").rowsBetween(1, Window.unboundedFollowing)  # one row a day of the plan
    plan = days.withColumn("__later", F.first(F.get("__own", F.lit(0)), ignorenulls=True).over(after))
    plan = F.broadcast(plan) if high - low < BROADCAST_STEPS else plan
    met = items.withColumn("__day", F.greatest(day(at), F.lit(low))).join(plan, "__day", "left")
    hit = F.coalesce(F.get(F.filter("__own", lambda w: w["__s"] >= F.col(at)), F.lit(0)), F.when(F.col(at).isNotNull(), F.col("__later")))
    return met.withColumn("__hit", hit).select(*items.columns, *[F.col("__hit")[c].alias(c) for c in carry])


def fifo(queue: DataFrame, group: str, order: list[str], size: str, capacity: str, block_s: int = 600, time_us: str = "created_us") -> DataFrame:
    """Oldest first until the first that does not fit: a running sum, since sizes are positive. ``order`` begins with the time of creation."""
    blocks = queue.withColumn("__block", F.floor(F.col(time_us) / (block_s * 1_000_000)))
    summed = prefix_sum(blocks, [group], "__block", [F.col(c) for c in order], size, "cum").drop("__block")
    return summed.withColumn("sent", F.col("cum") <= F.col(capacity))


def no_buffer(items: DataFrame, windows: DataFrame) -> DataFrame:
    """First-in-first-out over what arrived since the last pass; nothing is carried, so passes are independent."""
    placed = next_window(items.withColumn("created_s", F.col("created_us") / 1e6), windows, "created_s", "rise_s", ["pass_id", "rise_s", "set_s", "capacity"])
    return fifo(placed.where("pass_id IS NOT NULL"), "pass_id", ["created_us", "id"], "size", "capacity")


def delivery_metrics(delivered: DataFrame) -> DataFrame:
    """Per kind: deliveries, bytes, value, latency percentiles."""
    return delivered.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("value").alias("value"), F.expr("percentile(latency_s, 0.5)").alias("p50"), F.expr("percentile(latency_s, 0.9)").alias("p90"), F.max("latency_s").alias("most")
    )


def ship_metrics(delivered: DataFrame, carried: DataFrame, ships: DataFrame) -> DataFrame:
    """Per scenario: share of ships, and of dark ones, of which anything came, share of the value, hours to the first news.

    ``carried``: scenario, id, ship; ``ships``: scenario, ship, created_s, dark, weight. A ship of which nothing came counts.
    """
    first = delivered.join(carried, ["scenario", "id"]).groupBy("scenario", "ship").agg(F.min("delivered_s").alias("first_s"))
    seen = ships.join(first, ["scenario", "ship"], "left").withColumns({"came": F.col("first_s").isNotNull().cast("double"), "hours": (F.col("first_s") - F.col("created_s")) / 3600})
    value = delivered.groupBy("scenario").agg(F.sum("value").alias("got"), F.sum("bytes").alias("bytes"))
    hours = lambda q, dark=False: F.percentile(F.when(F.col("dark") | F.lit(not dark), F.col("hours")), F.lit(q))
    per = seen.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("ships"), F.avg("came").alias("recall"), F.avg(F.when(F.col("dark"), F.col("came"))).alias("dark_recall"), F.sum("weight").alias("weight"),
        hours(0.5).alias("p50_h"), hours(0.9).alias("p90_h"), hours(0.5, True).alias("dark_p50_h"),
    )
    out = per.join(value, "scenario", "left")
    return out.select("scenario", "ships", "recall", "dark_recall", (F.coalesce("got", F.lit(0.0)) / F.col("weight")).alias("value_share"), "p50_h", "p90_h", "dark_p50_h", F.coalesce("bytes", F.lit(0.0)).alias("bytes"))


def path_summary(routed: DataFrame, *by: str) -> DataFrame:
    """Per path, and what else is named: items, bytes, latency percentiles, seconds on the links, energy, share that met the deadline."""
    per = routed.groupBy("path", *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.expr("percentile(latency_s, array(0.5, 0.9))").alias("at"), F.max("latency_s").alias("most"),
        F.sum("tx_s").alias("tx_s"), F.sum("isl_s").alias("isl_s"), F.sum("energy_J").alias("energy_J"), F.avg(F.col("deadline_met").cast("double")).alias("met"),
    )
    return per.select("path", "n", "bytes", F.col("at")[0].alias("p50"), F.col("at")[1].alias("p90"), "most", "tx_s", "isl_s", "energy_J", "met", *by)


def scaled(windows: DataFrame, share: float) -> DataFrame:
    """A contact plan of which the payload gets a share."""
    return windows.withColumn("capacity", F.col("capacity") * share)


def pass_rates(windows: DataFrame, share: float = 1.0) -> DataFrame:
    """Mean bits a second of each pass: of the payload, and of the transmitter that serves it with ``share`` of its time."""
    seconds = F.col("set_s") - F.col("rise_s")
    own = F.when(seconds > 0, F.col("capacity") * 8 / seconds).otherwise(F.lit(0.0))
    return windows.withColumns({"payload_bps": own, "physical_bps": own / share if share > 0 else F.lit(0.0)})
