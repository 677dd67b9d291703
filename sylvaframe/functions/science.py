"""Formulas of columns. Numbers below are fixed values of the formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = 273.15


def saturation_pressure(t_c: Column) -> Column:
    """kPa over water, Tetens."""
    return 0.61078 * F.exp(17.27 * t_c / (t_c + 237.3))


def vpd(t_k: Column, q_gkg: Column, p_hpa: Column) -> Column:
    """Vapour pressure deficit in kPa, at least 0, from kelvin, g/kg and hPa."""
    q = q_gkg / 1000.0
    return F.greatest(F.lit(0.0), saturation_pressure(t_k - KELVIN) - q * (p_hpa / 10.0) / (0.622 + 0.378 * q))


def conductivity(theta: Column, saturated: float = 45.4, exponent: float = 17.8, k_sat: float = 4.6e-7) -> Column:
    """Soil conductivity (m/s) at a water content: a power law up to saturation, constant beyond."""
    s = theta / saturated
    return F.when(s > 1, F.lit(k_sat)).otherwise(k_sat * F.pow(s, F.lit(exponent)))


#: Fixed factors: (from, to) -> (factor, offset).
UNITS = {
    ("kg C m-2 s-1", "micro mol m-2 s-1"): (1e6 / 0.01201, 0.0),
    ("bar", "MPa"): (0.1, 0.0),
    ("K", "deg C"): (1.0, -KELVIN),
    ("W m-2 down", "W m-2 up"): (-1.0, 0.0),
    ("m", "mm"): (1000.0, 0.0),
}


def convert(value: Column, source: str, target: str) -> Column:
    factor, offset = UNITS[(source, target)]
    return value * factor + offset


def log_cm_day_to_m_s(value: Column) -> Column:
    """log10 of a conductivity in cm/day -> m/s."""
    return F.pow(F.lit(10.0), value) / 100.0 / 86_400


def solar_declination(doy: Column) -> Column:
    return -math.radians(23.4) * F.cos(2 * math.pi * (doy + 10) / 365.0)


def equation_of_time(doy: Column) -> Column:
    """Minutes."""
    g = 2 * math.pi * (doy - 1) / 365.0
    return 0.017 + 0.4281 * F.cos(g) - 7.351 * F.sin(g) - 3.349 * F.cos(2 * g) - 9.731 * F.sin(g)


def solar_noon(lon: Column, doy: Column) -> Column:
    """Hour of the day, for the standard meridian of the nearest 15 degrees."""
    return 12.0 + (4.0 * (F.round(lon / 15.0) * 15 - lon) - equation_of_time(doy)) / 60.0


def cos_zenith(lat: Column, lon: Column, doy: Column, hour: Column) -> Column:
    """Cosine of the sun's zenith angle, between 0 and 1."""
    phi, dec = F.radians(lat), solar_declination(doy)
    angle = math.pi * (hour - solar_noon(lon, doy)) / 12.0
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(angle)))


def day_length(lat: Column, doy: Column) -> Column:
    """Hours of daylight; 0 in polar night and 24 on polar day."""
    phi = F.radians(lat)
    sin_dec = -math.sin(math.radians(23.5)) * F.cos(2 * math.pi * (doy + 10.0) / 365.0)
    x = F.try_divide(F.sin(phi) * sin_dec, F.cos(phi) * F.cos(F.asin(sin_dec)))  # at a pole the cosine is tiny, not 0
    return F.when(x < -1.0, 0.0).when(x > 1.0, 24.0).otherwise(12.0 * (1.0 + 2.0 / math.pi * F.asin(x)))


def diurnal_temperature(t_min: Column, t_max: Column, length: Column, hour: Column) -> Column:
    """Sine by day, exponential decay by night, from the day's extremes and its length (hours)."""
    a, b, c = 1.86, 2.2, -0.17
    rise, down = 12.0 - length / 2 + c, 12.0 + length / 2
    by_day = lambda m: (t_max - t_min) * F.sin(math.pi * m / (length + 2 * a)) + t_min
    at_sunset = by_day(down - rise + c)
    d = (at_sunset - t_min) / (math.exp(b) - 1.0)
    since = F.when(hour > down, hour - down).otherwise(24.0 + hour - down)
    by_night = (t_min - d) + (at_sunset - t_min - d) * F.exp(-b * since / (24.0 - length + c))
    return F.when((hour >= rise) & (hour <= down), by_day(hour - rise + c)).otherwise(by_night)


def relative_humidity(t_c: Column, pressure: Column, q: Column) -> Column:
    """Daily mean, between 0 and 1, from deg C, Pa and kg/kg."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.263 * pressure * q / F.exp(17.67 * t_c / (t_c + 243.5)) / 100.0))


def specific_humidity(t_c: Column, pressure: Column, rh: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), rh / 0.263 / pressure * 100.0 * F.exp(17.67 * t_c / (t_c + 243.5))))


def diffuse_fraction(transmissivity: Column) -> Column:
    """Share of diffuse light, from the clearness of the day."""
    t = transmissivity
    return F.when(t < 0.07, 1.0).when(t < 0.36, 1.0 - 2.3 * (t - 0.07) * (t - 0.07)).when(t < 0.75, 1.33 - 1.46 * t).otherwise(0.23)
