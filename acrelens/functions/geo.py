"""Geohash cells as column expressions: arithmetic on two integers, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _index(value: Column, low: float, span: float, bits: int) -> Column:
    return F.least(F.greatest(F.floor((value - low) / span * float(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def encode(lon: Column, lat: Column, precision: int = 4) -> Column:
    """The geohash cell of a point; null for a null or non-finite coordinate.

    Points on an edge belong to the north-east cell; the poles and the date line to the last one.
    """
    n_lon, n_lat = -(-5 * precision // 2), 5 * precision // 2
    x, y = _index(lon, -180.0, 360.0, n_lon), _index(lat, -90.0, 180.0, n_lat)
    chars = []
    for i in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            at = 5 * i + j
            bit = F.shiftright(x, n_lon - 1 - at // 2) if at % 2 == 0 else F.shiftright(y, n_lat - 1 - at // 2)
            value = value + bit.bitwiseAND(F.lit(1)) * (1 << (4 - j))
        chars.append(F.substring(F.lit(ALPHABET), value.cast("int") + 1, F.lit(1)))
    finite = (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf")) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.when(finite, F.concat(*chars))


def bounds(cell: Column, precision: int = 4) -> Column:
    """Struct west, south, east, north of cells of a known precision; null where the cell has other letters or another length."""
    x = y = F.lit(0).cast("long")
    for i in range(precision):
        value = F.instr(F.lit(ALPHABET), F.substring(cell, i + 1, 1)) - 1
        for j in range(5):
            bit = F.shiftright(value, 4 - j).bitwiseAND(F.lit(1)).cast("long")
            if (5 * i + j) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    n_lon, n_lat = -(-5 * precision // 2), 5 * precision // 2
    width, height = 360.0 / (1 << n_lon), 180.0 / (1 << n_lat)
    west, south = x * width - 180.0, y * height - 90.0
    box = F.struct(west.alias("west"), south.alias("south"), (west + width).alias("east"), (south + height).alias("north"))
    return F.when(cell.rlike(f"^[{ALPHABET}]{{{precision}}}$"), box)


def center(cell: Column, precision: int = 4) -> Column:
    """Struct lng, lat of the middle of a cell."""
    box = bounds(cell, precision)
    lng, lat = (box["west"] + box["east"]) / 2, (box["south"] + box["north"]) / 2
    return F.when(box.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))


def region(cell: Column, letters: int = 3) -> Column:
    return F.substring(cell, 1, letters)
