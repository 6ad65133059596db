"""Range conditions between prices as equalities.

One side is filed under the binary intervals around its price cell, one per width. The other side looks up the few disjoint
intervals that tile the cells it wants. A pair then shares exactly one interval if the cells fit, and none if not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 7  # price cells of a hundredth, 0 to 100, in a range of 128


def price_cell(price: Column) -> Column:
    return F.least(F.greatest(F.floor(price * 100), F.lit(0)), F.lit(2 ** BITS - 1)).cast("int")


def around(cell: Column) -> Column:
    """Ids of the binary intervals that hold a cell, one per width."""
    return F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda h: h * 256 + F.floor(cell / F.pow(F.lit(2), h)).cast("int"))


def _tiles(many: Column, mirrored: bool) -> Column:
    """The first `many` cells: one interval per binary digit of the number; mirrored, the last ones."""
    def tile(h: Column) -> Column:
        up = F.floor(many / F.pow(F.lit(2), h)).cast("int")
        place = (F.pow(F.lit(2), F.lit(BITS) - h).cast("int") - up) if mirrored else up - 1
        return F.when((many > 0) & (up % 2 == 1), h * 256 + place)
    return F.transform(F.sequence(F.lit(0), F.lit(BITS)), tile)


def up_to(cell: Column) -> Column:
    """Ids of disjoint binary intervals that together hold the cells 0 to `cell`; none below 0."""
    return F.array_compact(_tiles(F.least(cell, F.lit(2 ** BITS - 1)) + 1, False))


def apart(cell: Column, distance: int) -> Column:
    """Ids of disjoint binary intervals that together hold the cells at least `distance` away."""
    return F.array_compact(F.concat(_tiles(cell - (distance - 1), False), _tiles(F.lit(2 ** BITS - distance) - cell, True)))
