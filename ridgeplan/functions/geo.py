"""Distances, coordinate shifts, grid arithmetic and cost formulas as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Metres of a degree, statute miles of a degree's arc, kilometres of a mile.
DEGREE_M, ARC_MILES, MILE_KM = 111120.0, 1.1515, 1.609344


def _half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    return F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance, arcsine form."""
    return 2 * EARTH_KM * F.asin(F.sqrt(_half_chord(lat1, lng1, lat2, lng2)))


def haversine_array(lat1: np.ndarray, lat2: np.ndarray, lng1: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """As :func:`haversine_km` for arrays."""
    up, aside = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lng2 - lng1) / 2)
    return 2 * EARTH_KM * np.arcsin(np.sqrt(up * up + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * aside * aside))


def haversine_atan_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, scale: float = 1.0) -> Column:
    """Great-circle distance, two-argument arctangent form, times a map scale."""
    a = _half_chord(lat1, lng1, lat2, lng2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * scale


def cosine_law_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, unit: str = "K") -> Column:
    """Spherical law of cosines in kilometres (K), nautical (N) or statute (M) miles."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng1 - lng2)
    c = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(d)))
    miles = F.degrees(F.acos(c)) * 60 * ARC_MILES
    return miles * {"K": MILE_KM, "N": 0.8684, "M": 1.0}[unit]


def equirectangular_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Plane approximation in metres; longitudes shrink with the first latitude."""
    dlat, dlng = lat1 - lat2, (lng1 - lng2) * F.cos(F.radians(lat1))
    return F.sqrt(dlat * dlat + dlng * dlng) * DEGREE_M


def planar_km(r1: Column, c1: Column, r2: Column, c2: Column, row_m: Column, col_m: Column) -> Column:
    """Distance of two cells by the grid's cell height and width in metres."""
    dr, dc = (r1 - r2) * row_m, (c1 - c2) * col_m
    return F.sqrt(dr * dr + dc * dc) / 1000


def shifted(lat: Column, lng: Column, dx_km: float, dy_km: float) -> tuple[Column, Column]:
    """The point dx east and dy north."""
    degree = 180 / 3.141592653589793
    new_lat = lat + F.lit(dy_km / EARTH_KM * degree)
    return new_lat, lng + F.lit(dx_km / EARTH_KM * degree) / F.cos(F.radians(lat))


def cell_size_m(km: Column, cells: Column) -> Column:
    return km / cells * 1000


def row_of(cell: Column, n_cols: Column) -> Column:
    return F.floor(cell / n_cols).cast("int")


def col_of(cell: Column, n_cols: Column) -> Column:
    return F.pmod(cell, n_cols).cast("int")


def elevation_bucket(z: Column, width: int = 10) -> Column:
    """Bucket of an elevation; quotients of negative elevations go towards zero."""
    return F.when(z.isNotNull(), (z / width).cast("int"))


def unit_cost(km: Column) -> Column:
    """Cost of a link by its length, as the whole number that the solver gets."""
    return F.floor(link_cost(km)).cast("long")


def link_cost(km: Column) -> Column:
    return 0.1258 * km * km + 6.7747 * km + 63.429


def visible_percent(n: Column, total: Column) -> Column:
    return F.ceil(n / total * 100).cast("long")


def rounding_percent(flow: Column, capacity: Column) -> Column:
    """Chance in percent that an arc is kept; an arc without capacity is never kept."""
    return F.when(capacity > 0, F.ceil(flow / capacity * 100).cast("long")).otherwise(F.lit(0).cast("long"))


def gradient(z_tgt: Column, z_obs: Column, h_tgt: Column, h_obs: Column, steps: Column) -> Column:
    """Slope of the line of sight to the top of the target."""
    return (z_tgt + h_tgt - z_obs - h_obs) / steps


def tile_name(lat: Column, lng: Column) -> Column:
    """Name of the 1 by 1 degree tile of a point, such as N35W107."""
    ns = F.when(lat >= 0, "N").otherwise("S")
    ew = F.when(lng >= 0, "E").otherwise("W")
    return F.concat(ns, F.lpad(F.abs(F.floor(lat)).cast("string"), 2, "0"), ew, F.lpad(F.abs(F.floor(lng)).cast("string"), 3, "0"))


def tile_origin(name: Column) -> tuple[Column, Column]:
    """South-west corner of a tile by its file name; null if the name is of another form."""
    form = r"^([NS])(\d+)([EW])(\d+)\.hgt$"
    part = lambda k: F.regexp_extract(name, form, k)
    signed = lambda side, digits, minus: F.when(part(side) == minus, -part(digits).cast("int")).when(part(side) != "", part(digits).cast("int"))
    return signed(1, 2, "S"), signed(3, 4, "W")


def expected_rows(height_km: Column) -> Column:
    return F.floor(height_km * 1000 / 30).cast("long")


def expected_cols(width_km: Column) -> Column:
    return F.floor(width_km * 1000 / 25).cast("long")


#: Grid sizes from which so many percent of the cells are removed.
REMOVAL_STEPS = ((640_001, 99.7), (360_000, 99.5), (160_000, 99.3), (40_000, 99.0), (10_000, 98.5))
LARGEST_GRID, RESCALED_GRID = 640_000, 638_000


def removal_percent(cells: Column) -> Column:
    out = None
    for least, percent in REMOVAL_STEPS:
        out = F.when(cells >= least, percent) if out is None else out.when(cells >= least, percent)
    return out.otherwise(0.0)


def rescale_target(cells: Column) -> Column:
    """Cells to resample to; a grid that is not too large keeps its size."""
    return F.when(cells > LARGEST_GRID, F.lit(RESCALED_GRID).cast("long")).otherwise(cells.cast("long"))


def proportional_size(n_rows: int, n_cols: int, target: int) -> tuple[int, int]:
    """Rows and columns of about ``target`` cells in the proportions of a grid."""
    aspect, k = n_rows / n_cols, 1
    while int(k * aspect) * k <= target:
        k += 1
    return max(1, int(k * aspect)), k


def ramp_colour(value: Column, low: Column, high: Column, from_rgb: tuple[int, int, int], to_rgb: tuple[int, int, int]) -> Column:
    """Linear colour between two ends as an array of three ints."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(high > low, (value - low) / (high - low)).otherwise(0.0)))
    return F.array(*[F.floor(a + share * (b - a)).cast("int") for a, b in zip(from_rgb, to_rgb, strict=True)])


def length_text(km: Column) -> Column:
    """Two decimals, halves up."""
    hundredths = F.floor(km * 100 + 0.5).cast("long")
    return F.format_string("%d.%02d Km", F.floor(hundredths / 100).cast("long"), hundredths % 100)


def cost_text(cost: Column) -> Column:
    return F.format_string("$%d", cost.cast("long"))


def in_box(lat: Column, lng: Column, n: Column, s: Column, e: Column, w: Column) -> Column:
    return lat.between(s, n) & lng.between(w, e)


def tidy_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def after_first_space(text: Column) -> Column:
    return F.regexp_replace(text, "^[^ ]* ", "")


def split_ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), " +"), lambda x: x != ""), lambda x: x.cast("int"))
