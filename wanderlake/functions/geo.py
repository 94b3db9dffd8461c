"""Distances and grid cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the Earth's mean radius in metres.
EARTH_RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, null where a coordinate is; the square root's argument is kept at 1 at most, where rounding would give NaN."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a.isNotNull(), F.least(a, F.lit(1.0)))))


def valid_point(lat: Column, lon: Column) -> Column:
    """True for finite coordinates in range; null and NaN are false."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def micro_cell(degrees: Column, size_micro: int) -> Column:
    """The cell of a coordinate in whole millionths of a degree, so that values on a border go the same way in any engine."""
    return F.floor(F.round(degrees * 1e6).cast("long") / F.lit(size_micro))


#: Fixed value: the letters of geohashes, by code.
GEOHASH_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"


def _geohash_bits(precision: int) -> tuple[int, int]:
    """Bits of the longitude and of the latitude."""
    return (precision * 5 + 1) // 2, precision * 5 // 2


def _geohash_of(x: Column, y: Column, precision: int) -> Column:
    """The letters of a cell's numbers: bits of the longitude and latitude in turn, five a letter."""
    n_lon, n_lat = _geohash_bits(precision)
    out = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            axis, bit = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            code = code * 2 + F.shiftright(axis, bit).bitwiseAND(F.lit(1))
        out.append(F.substr(F.lit(GEOHASH_LETTERS), code.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Base-32 geohash."""
    n_lon, n_lat = _geohash_bits(precision)
    x = F.least(F.floor((lon + 180) / 360 * F.lit(float(1 << n_lon))), F.lit((1 << n_lon) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * F.lit(float(1 << n_lat))), F.lit((1 << n_lat) - 1)).cast("long")
    return _geohash_of(x, y, precision)


def geohash_cell(code: Column, precision: int) -> tuple[Column, Column]:
    """The numbers of a geohash's cell along longitude and latitude; null if a letter is none or the length is another."""
    x = y = F.lit(0).cast("long")
    for k in range(precision):
        at = F.instr(F.lit(GEOHASH_LETTERS), F.substring(code, k + 1, 1)) - 1
        for b in range(5 * k, 5 * k + 5):
            bit = F.shiftright(at, 4 - b % 5).bitwiseAND(F.lit(1))
            x, y = (x * 2 + bit, y) if b % 2 == 0 else (x, y * 2 + bit)
    ok = code.rlike(f"^[{GEOHASH_LETTERS}]{{{precision}}}$")
    return F.when(ok, x), F.when(ok, y)


def geohash_center(code: Column, precision: int) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a geohash's cell."""
    n_lon, n_lat = _geohash_bits(precision)
    x, y = geohash_cell(code, precision)
    return (y + 0.5) / float(1 << n_lat) * 180 - 90, (x + 0.5) / float(1 << n_lon) * 360 - 180


def geohash_neighbours(code: Column, precision: int) -> Column:
    """The geohashes of the cells around, and the cell's own, in order; fewer at the poles, and around the line of 180 degrees."""
    n_lon, n_lat = _geohash_bits(precision)
    x, y = geohash_cell(code, precision)
    near = [F.when((y + dy).between(0, (1 << n_lat) - 1), _geohash_of(F.pmod(x + dx, F.lit(1 << n_lon)), y + dy, precision)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*near))))
