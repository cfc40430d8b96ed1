"""Contact windows from arithmetic on time grids: circular orbit with secular J2 drift, sidereal time, an ellipsoidal station."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.domain import link_rate

# Earth and the default orbit and station.
MU, RADIUS_KM, J2, FLATTENING, SIDEREAL = 398600.4418, 6378.137, 1.08262668e-3, 1 / 298.257223563, 7.2921158553e-5
ALTITUDE_KM, INCLINATION_DEG, STATION = 500.0, 97.4, (34.74, 10.76)


def satellite(t: Column, raan_deg: float = 0.0, anomaly_deg: float = 0.0, altitude_km: float = ALTITUDE_KM, inclination_deg: float = INCLINATION_DEG) -> dict[str, Column]:
    """Inertial position in km at ``t`` seconds from the epoch."""
    a, i = RADIUS_KM + altitude_km, math.radians(inclination_deg)
    n = math.sqrt(MU / a**3)
    k = 1.5 * J2 * (RADIUS_KM / a) ** 2 * n
    u = math.radians(anomaly_deg) + t * (n + k * (1 - 1.5 * math.sin(i) ** 2) + k * (2 - 2.5 * math.sin(i) ** 2))
    node = math.radians(raan_deg) - t * (k * math.cos(i))
    return {
        "x": a * (F.cos(u) * F.cos(node) - F.sin(u) * F.sin(node) * math.cos(i)),
        "y": a * (F.cos(u) * F.sin(node) + F.sin(u) * F.cos(node) * math.cos(i)),
        "z": a * F.sin(u) * math.sin(i),
    }


def elevation(t: Column, sat: dict[str, Column], lat_deg: float, lon_deg: float, gmst0_rad: float) -> tuple[Column, Column]:
    """Elevation in degrees and range in km from a station on the ellipsoid."""
    lat, e2 = math.radians(lat_deg), FLATTENING * (2 - FLATTENING)
    c = RADIUS_KM / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    theta = gmst0_rad + math.radians(lon_deg) + SIDEREAL * t
    dx, dy = sat["x"] - c * math.cos(lat) * F.cos(theta), sat["y"] - c * math.cos(lat) * F.sin(theta)
    dz = sat["z"] - c * (1 - e2) * math.sin(lat)
    reach = F.sqrt(dx * dx + dy * dy + dz * dz)
    up = (dx * F.cos(theta) + dy * F.sin(theta)) * math.cos(lat) + dz * math.sin(lat)
    return F.degrees(F.asin(up / reach)), reach


def islands(samples: DataFrame, time: str, visible: str, step: float, *by: str) -> DataFrame:
    """Runs of consecutive visible samples: start, end and length of each.

    A sample's run is its time less its rank times the step, so one window by group suffices.
    """
    own = Window.partitionBy(*by).orderBy(time) if by else Window.partitionBy(F.lit(0)).orderBy(time)
    runs = samples.where(visible).withColumn("__run", F.round(F.col(time) / step - F.row_number().over(own)).cast("long"))
    return runs.groupBy(*by, "__run").agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.count(F.lit(1)).alias("samples")).drop("__run")


def find_passes(spark: SparkSession, hours: float = 36.0, stations: list[tuple[str, float, float]] | None = None, least_deg: float = 5.0, step_s: int = 5, gmst0_rad: float = 0.0, raan_deg: float = 0.0, altitude_km: float = ALTITUDE_KM) -> DataFrame:
    """Passes over each station: rise, set, highest elevation and capacity (trapezoids of the link rate)."""
    stations = stations or [("main", *STATION)]
    grid = spark.range(0, int(hours * 3600) + 1, step_s).select(F.col("id").cast("double").alias("t"))
    out = None
    for name, lat, lon in stations:
        el, reach = elevation(F.col("t"), satellite(F.col("t"), raan_deg, altitude_km=altitude_km), lat, lon, gmst0_rad)
        own = grid.select(F.lit(name).alias("station"), "t", el.alias("el"), reach.alias("range_km"))
        out = own if out is None else out.unionAll(own)
    seen = out.where(F.col("el") >= least_deg).withColumn("bps", link_rate(altitude_km, F.col("range_km")))
    run = Window.partitionBy("station").orderBy("t")
    numbered = seen.withColumn("run", (F.col("t") / step_s).cast("long") - F.row_number().over(run))
    inner = Window.partitionBy("station", "run").orderBy("t")
    parts = numbered.withColumn("part", (F.col("bps") + F.lag("bps").over(inner)) / 2 * step_s / 8)
    return parts.groupBy("station", "run").agg(
        F.min("t").alias("rise_s"), F.max("t").alias("set_s"), F.max("el").alias("max_elevation"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("capacity")
    ).drop("run")


def relay_windows(spark: SparkSession, hours: float = 36.0, raan_deg: float = 90.0, grazing_km: float = 100.0, max_range_km: float | None = None, step_s: int = 10) -> DataFrame:
    """Windows in which two satellites see each other over the Earth's limb."""
    grid = spark.range(0, int(hours * 3600) + 1, step_s).select(F.col("id").cast("double").alias("t"))
    a, b = satellite(F.col("t")), satellite(F.col("t"), raan_deg)
    dot = sum(a[k] * b[k] for k in "xyz")
    far = F.sqrt(sum((a[k] - b[k]) * (a[k] - b[k]) for k in "xyz"))
    r = RADIUS_KM + ALTITUDE_KM
    least = F.sqrt((r * r + dot) / 2)  # distance of the chord's middle from the centre: both radii are equal
    clear = (least > RADIUS_KM + grazing_km) & (F.lit(True) if max_range_km is None else far <= max_range_km)
    return islands(grid.select("t", clear.alias("clear"), far.alias("range_km")), "t", "clear", step_s)


def max_gap(passes: DataFrame, start: float, end: float) -> DataFrame:
    """Longest time without a pass, edges included."""
    w = Window.partitionBy("station").orderBy("rise_s")
    reach = F.max("set_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = passes.withColumn("gap", F.col("rise_s") - F.coalesce(reach, F.lit(float(start))))
    return gaps.groupBy("station").agg((F.greatest(F.max("gap"), F.lit(float(end)) - F.max("set_s"), F.lit(0.0)) / 3600).alias("max_gap_h"))


def thin(windows: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """Keep each window with a probability, by hash."""
    return windows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
