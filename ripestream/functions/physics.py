"""Sensor physics and device-timing rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the gas-sensor circuit and curve.
ADC_MAX = 4095
ADC_VREF = 3.3
DIVIDER = 100000 / 156000
V_SUPPLY = 5.0
R_LOAD = 1000.0
V_MIN = 0.01
CURVE_B = 0.35
CURVE_M = -0.47
R0_DEFAULT = 20000.0
# Fixed values of the arrival-time controller.
TARGET_MS = 50000
EARLY_LIMIT_MS = 45000
EARLY_MARGIN_MS = 2000
EARLY_MIN_MS = 5000
MAX_ADJUST_MS = 10000
MIN_SLEEP_MS = 100
# Fixed values of sensor plausibility / warm-up / low light.
WARMUP_S = 15
LOW_LIGHT_EXPOSURE_US = 20000
LOW_LIGHT_GAIN = 4.0


def v_out(adc: Column) -> Column:
    """Sensor output voltage before the divider: adc / 4095 · 3.3 / (100k / 156k)."""
    return adc / ADC_MAX * ADC_VREF / DIVIDER


def adc_to_rs(adc: Column) -> Column:
    """ADC counts -> sensor resistance (C1); NULL when v_out < 0.01 or >= 5."""
    v = v_out(adc)
    return F.when((v >= V_MIN) & (v < V_SUPPLY), R_LOAD * (V_SUPPLY - v) / v)


def rs_to_ppm(rs: Column, r0: Column | None = None) -> Column:
    """Resistance -> ppm (C2): 10^((log10(Rs/R0) - 0.35) / -0.47); NULL unless Rs > 0 and R0 > 0."""
    r0 = F.coalesce(r0, F.lit(R0_DEFAULT)) if r0 is not None else F.lit(R0_DEFAULT)
    ppm = F.pow(F.lit(10.0), (F.log10(rs / r0) - CURVE_B) / CURVE_M)
    ok = (rs > 0) & (r0 > 0)
    return F.when(ok & ~F.isnan(ppm) & (F.abs(ppm) != F.lit(float("inf"))), ppm)


def arrival_adjust(arrival_ms: Column) -> Column:
    """Send-time correction (C12) for a packet arriving ``arrival_ms`` after wake.

    Early (< 45 s): max(5000, 50000 - a + 2000).  Otherwise the error
    e = a - 50000 is scaled by a gain (0.5 if |e| > 10 s, 0.45 if > 5 s, else
    0.4) in float32 and truncated toward zero, then clamped to ±10 s.
    """
    err = arrival_ms - TARGET_MS
    gain = (F.when(F.abs(err) > 10000, F.lit(0.5)).when(F.abs(err) > 5000, F.lit(0.45)).otherwise(F.lit(0.4))).cast("float")
    late = ((-err).cast("float") * gain).cast("int")
    late = F.greatest(F.lit(-MAX_ADJUST_MS), F.least(F.lit(MAX_ADJUST_MS), late))
    early = F.greatest(F.lit(EARLY_MIN_MS), TARGET_MS - arrival_ms + EARLY_MARGIN_MS).cast("int")
    return F.when(arrival_ms < EARLY_LIMIT_MS, early).otherwise(late)


def remaining_sleep(cycle_ms: Column, active_ms: Column, adjust_ms: Column) -> Column:
    """Sleep until the next cycle (C13): cycle - active + adjustment, at least 100 ms."""
    return F.greatest(F.lit(MIN_SLEEP_MS), cycle_ms - active_ms + adjust_ms)


def plausible_climate(temp: Column, hum: Column) -> Column:
    """-40 < t < 80 and 0 <= h <= 100, both present."""
    return F.coalesce((temp > -40) & (temp < 80) & (hum >= 0) & (hum <= 100), F.lit(False))


def status_letter(ok: Column, sampled: Column | None = None, elapsed_s: Column | None = None) -> Column:
    """B13: '-' not sampled in this tick (climate sensor), 'x' failed check, 'w' ok but still
    warming up (air-quality sensor, first 15 s since boot), 'o' ok.  A failure shows during warm-up, too."""
    letter = F.when(~F.coalesce(ok, F.lit(False)), "x")
    if elapsed_s is not None:
        letter = letter.when(elapsed_s < WARMUP_S, "w")
    letter = letter.otherwise("o")
    return letter if sampled is None else F.when(F.coalesce(sampled, F.lit(False)), letter).otherwise("-")


def baseline_plausible(tvoc_base: Column, eco2_base: Column) -> Column:
    """Both present, non-zero and <= 60000."""
    return F.coalesce((tvoc_base != 0) & (eco2_base != 0) & (tvoc_base <= 60000) & (eco2_base <= 60000), F.lit(False))


def low_light(exposure_us: Column, gain: Column) -> Column:
    """Exposure > 20000 µs or gain > 4.0; a missing exposure counts as 0, a missing gain as 1.0."""
    return (F.coalesce(exposure_us, F.lit(0)) > LOW_LIGHT_EXPOSURE_US) | (F.coalesce(gain, F.lit(1.0)) > LOW_LIGHT_GAIN)


def capture_delay_s(exposure_us: Column, gain: Column) -> Column:
    """6 s in low light, 3 s otherwise, 5 s without any metadata."""
    return (F.when(exposure_us.isNull() & gain.isNull(), F.lit(5))
            .when(low_light(exposure_us, gain), F.lit(6)).otherwise(F.lit(3)))
