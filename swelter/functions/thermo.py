"""Humidity and apparent temperature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bolton-type saturation vapour pressure (hPa, Celsius).
SVP_BASE = 6.112
SVP_SLOPE = 17.67
SVP_OFFSET = 243.5

# NOAA heat-index regression, coefficient of F^i * RH^j.
HEAT_INDEX_TERMS = (
    (0, 0, -42.379),
    (1, 0, 2.04901523),
    (0, 1, 10.14333127),
    (1, 1, -0.22475541),
    (2, 0, -0.00683783),
    (0, 2, -0.05481717),
    (2, 1, 0.00122874),
    (1, 2, 0.00085282),
    (2, 2, -0.00000199),
)


def saturation_vapour_pressure(t_c: Column) -> Column:
    return F.lit(SVP_BASE) * F.exp(F.lit(SVP_SLOPE) * t_c / (t_c + F.lit(SVP_OFFSET)))


def relative_humidity(dewpoint_c: Column, t_c: Column) -> Column:
    """Percent; deliberately not clamped, so a dew point above ``t`` exceeds 100."""
    return F.lit(100.0) * (saturation_vapour_pressure(dewpoint_c) / saturation_vapour_pressure(t_c))


def celsius_to_fahrenheit(t_c: Column) -> Column:
    return F.lit(9.0 / 5.0) * t_c + F.lit(32.0)


def fahrenheit_to_celsius(t_f: Column) -> Column:
    return F.lit(5.0 / 9.0) * (t_f - F.lit(32.0))


def _power(base: Column, exponent: int) -> Column | None:
    return {0: None, 1: base, 2: base * base}[exponent]


def heat_index_c(t_c: Column, rh: Column) -> Column:
    """NOAA heat index in Celsius; NULL when either input is NULL.

    Below 80 F the simple mean formula applies. From 80 F on it is the regression plus a
    dry-air correction (RH < 13, up to 112 F) and a humid-air one (RH > 85, up to 87 F).
    """
    f = celsius_to_fahrenheit(t_c)
    simple = F.lit(0.5) * (f + F.lit(61.0) + (f - F.lit(68.0)) * F.lit(1.2) + rh * F.lit(0.094))

    regression = None
    for i, j, coef in HEAT_INDEX_TERMS:
        term = F.lit(coef)
        for factor in (_power(f, i), _power(rh, j)):
            if factor is not None:
                term = term * factor
        regression = term if regression is None else regression + term

    dry = F.when(
        (rh < 13.0) & (f <= 112.0),
        -((F.lit(13.0) - rh) / F.lit(4.0)) * F.sqrt((F.lit(17.0) - F.abs(f - F.lit(95.0))) / F.lit(17.0)),
    ).otherwise(F.lit(0.0))
    humid = F.when(
        (rh > 85.0) & (f <= 87.0),
        ((rh - F.lit(85.0)) / F.lit(10.0)) * ((F.lit(87.0) - f) / F.lit(5.0)),
    ).otherwise(F.lit(0.0))
    return fahrenheit_to_celsius(F.when(f < 80.0, simple).when(f >= 80.0, regression + dry + humid))
