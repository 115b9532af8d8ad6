"""Geohash, distance, grid cells and point/line text as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

# Mean earth radius (IUGG); every distance here uses this sphere.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _char_table(lon_bits: int) -> str:
    """Base 32 letters indexed by (lon bits, lat bits) of one geohash character.

    Bits alternate; the axis holding three of the five bits comes first.
    """
    lat_bits = 5 - lon_bits
    letters = []
    for lon in range(2**lon_bits):
        for lat in range(2**lat_bits):
            value, lo, la = 0, lon_bits, lat_bits
            lon_turn = lon_bits == 3
            for _ in range(5):
                if lon_turn:
                    lo -= 1
                    value = value * 2 + (lon >> lo & 1)
                else:
                    la -= 1
                    value = value * 2 + (lat >> la & 1)
                lon_turn = not lon_turn
            letters.append(BASE32[value])
    return "".join(letters)


def _axis_bits(value: Column, low: float, span: float, bits: int) -> Column:
    # Double literals throughout: decimal ones would lose digits in the division.
    cell = F.floor((value.cast("double") - F.lit(low)) / F.lit(span) * F.lit(float(2**bits))).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(cell, F.lit(2**bits - 1)))


def geohash(lat: Column | str, lon: Column | str, precision: int) -> Column:
    """Base 32 geohash; two longs hold the axes, so up to 24 characters work."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    x = _axis_bits(col(lon), -180.0, 360.0, lon_bits)
    y = _axis_bits(col(lat), -90.0, 180.0, lat_bits)
    chars, lon_left, lat_left = [], lon_bits, lat_bits
    for i in range(precision):
        nx = 3 if i % 2 == 0 else 2
        ny = 5 - nx
        lon_left -= nx
        lat_left -= ny
        xi = F.shiftright(x, lon_left).bitwiseAND(F.lit(2**nx - 1))
        yi = F.shiftright(y, lat_left).bitwiseAND(F.lit(2**ny - 1))
        index = (xi * F.lit(2**ny) + yi + F.lit(1)).cast("int")
        chars.append(F.substring(F.lit(_char_table(nx)), index, F.lit(1)))
    return F.concat(*chars)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    # Not least(): that skips NULL, and a missing point must give a missing distance.
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def snap(value: Column | str, size: float = 0.01) -> Column:
    """Index of the nearest grid line, a long: safe to group and join on."""
    return F.rint(col(value) / F.lit(size)).cast("long")


def wkt_point(lat: Column, lon: Column, digits: int = 6) -> Column:
    return F.format_string(f"POINT(%.{digits}f %.{digits}f)", lon, lat)


def cell_label(cell_lat: Column | str, cell_lon: Column | str, size: float = 0.01, digits: int = 2) -> Column:
    """Text of a grid point, built from the cell indexes last."""
    return wkt_point(col(cell_lat) * F.lit(size), col(cell_lon) * F.lit(size), digits)


_POINT = r"POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"


def parse_wkt_point(text: Column | str) -> Column:
    """``POINT(lon lat)`` to struct(lat, lon); other text gives NULL fields."""
    text = col(text)
    lon = F.nullif(F.regexp_extract(text, _POINT, 1), F.lit("")).cast("double")
    lat = F.nullif(F.regexp_extract(text, _POINT, 2), F.lit("")).cast("double")
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def geojson_line(points: Column | str) -> Column:
    """Array of struct(lat, lon) to a GeoJSON LineString, lon first."""
    coords = F.transform(col(points), lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")))


def parse_geojson_line(text: Column | str) -> Column:
    """GeoJSON LineString to array of struct(lat, lon)."""
    parsed = F.from_json(col(text), "type string, coordinates array<array<double>>")
    return F.transform(
        parsed["coordinates"], lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"))
    )


def wkt_line(points: Column | str, digits: int = 6) -> Column:
    """Ordered array of struct(lat, lon) to WKT text."""
    texts = F.transform(col(points), lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["lon"], p["lat"]))
    return F.concat(F.lit("LINESTRING("), F.array_join(texts, ", "), F.lit(")"))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """x, y, z of a point on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def vector_lat(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def vector_lon(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def route_number(text: Column | str) -> Column:
    """First number in a text such as ``12.5 km``."""
    return F.nullif(F.regexp_extract(col(text), r"([0-9.]+)", 1), F.lit("")).cast("double")
