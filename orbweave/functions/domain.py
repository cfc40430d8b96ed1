"""Encoding rules, packet sizes, link and energy formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the product encoders and the links.
CONF_LOW, CONF_HIGH = 0.25, 0.670
DARK_WEIGHT, L0_BYTES, L1_BYTES, L2_BYTES, MOSAIC_BYTES, THUMB_BYTES, THUMB_VALUE = 5, 40, 900, 2500, 2259, 1000, 0.01
RAW_TILE_BYTES, COAST_TILE_BYTES, ESCALATE = 1_769_472, 66_118.0, 11
GATE_EMPTY, AUDIT_SHARE = 0.126, 0.02
SIZE_L1, SIZE_L2, SIZE_FLOOR = (137.5, 0.57), (43.3, 1.14), 120.0
LINK = {"p_tx_W": 15.0, "p_isl_W": 12.0, "isl_bps": 2.53e6, "isl_efficiency": 0.8, "share": 0.25}


def product_bytes(px: Column, model: tuple[float, float], fallback: float) -> Column:
    """``max(120, a * px ** b)``, or the median where the size is unknown."""
    a, b = model
    return F.when(F.coalesce(px, F.lit(0.0)) > 0, F.greatest(F.lit(SIZE_FLOOR), a * F.pow(px, F.lit(b)))).otherwise(F.lit(float(fallback)))


def weight(dark: Column) -> Column:
    return F.when(dark, DARK_WEIGHT).otherwise(1)


def escalation(pressure: Column, low: float = 0.9, high: float = 3.5, top: int = 40) -> Column:
    """Escalation threshold under queue pressure: clamped, then rounded half to even."""
    share = F.lit(0.0) if high <= low else F.least(F.greatest((pressure - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.rint(share * top).cast("int")


def level(conf: Column, coast: Column, dark: Column, low: float = CONF_LOW, high: float = CONF_HIGH, coast_all: bool = True) -> Column:
    """Priority level 0 to 3."""
    base = F.when(conf >= high, 1).otherwise(2)
    raised = F.when(coast & (F.lit(coast_all) | (base == 2)), 3).otherwise(base)
    return F.when(conf < low, 0).otherwise(F.when(dark, F.least(raised + 1, F.lit(3))).otherwise(raised)).cast("int")


def record_bytes(geo: Column, roi: Column, ctx: Column) -> Column:
    """26 bytes, 8 for a position, 4 for each reference."""
    return 26 + F.when(geo, 8).otherwise(0) + F.when(roi, 4).otherwise(0) + F.when(ctx, 4).otherwise(0)


def packet_bytes(n: Column) -> Column:
    """Payload with its space-packet headers and checksums."""
    return (n + 8 * F.ceil(n / 4094)).cast("long")


def frame_bytes(n: Column) -> Column:
    """On-air bytes of telemetry frames."""
    return (F.ceil(n / 1107) * 1279).cast("long")


def link_rate(alt_km: float, range_km: Column, bandwidth_hz: float = 2e6, snr0_db: float = 12.0, cap_bps: float = 8e6, efficiency: float = 0.8) -> Column:
    """Shannon rate at a range, capped."""
    snr = 10 ** (snr0_db / 10) * F.pow(alt_km / range_km, F.lit(2.0))
    return F.least(bandwidth_hz * F.log2(1 + snr), F.lit(cap_bps)) * efficiency


def tx_seconds(n_bytes: Column, rate_bps) -> Column:
    """Transmission time: bytes times eight over bits a second; the rate must be positive."""
    rate = rate_bps if isinstance(rate_bps, Column) else F.lit(float(rate_bps))
    return F.when(rate > 0, n_bytes * 8 / rate).otherwise(F.raise_error(F.lit("rate must be positive")).cast("double"))


def tx_joules(power_w: float, n_bytes: Column, rate_bps) -> Column:
    return power_w * tx_seconds(n_bytes, rate_bps)


def reduction_percent(sent: Column, raw: Column) -> Column:
    return F.when(raw > 0, 100 * (1 - sent / raw)).otherwise(F.raise_error(F.lit("raw bytes must be positive")).cast("double"))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a rate; null without trials."""
    m = F.when(n > 0, n.cast("double"))
    middle, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (middle - spread) / (1 + z * z / m), (middle + spread) / (1 + z * z / m)


def kept_value(value: Column, fraction: Column, progressive: Column) -> Column:
    """Value of a delivered fraction: the root of the fraction counts for progressive items."""
    return F.when(progressive, value * F.sqrt(fraction)).otherwise(value)


def best_rate(value: Column, size: Column, progressive: Column, floor: float = 0.1) -> tuple[Column, Column]:
    """Best value per byte and the bytes at which it is used up."""
    rate = F.when(size > 0, F.when(progressive, value / size / math.sqrt(floor)).otherwise(value / size)).otherwise(0.0)
    return rate, F.when(rate > 0, value / rate).otherwise(0.0)
