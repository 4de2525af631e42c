"""Rules about places on a page, as column expressions. Boxes are arrays [x0, y0, x1, y1] on a grid of 1000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000
#: Shares of the page height for header and signature, and margins on the grid.
HEADER, SIGNATURE, TOP, BOTTOM = 0.25, 0.75, 120, 880


def _on_grid(v: Column, size: Column) -> Column:
    return F.bround(GRID * v / size).cast("int")


def line_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Rounded half to even and clamped; at least one cell wide and high; null for an empty or unplaced line."""
    a = F.greatest(F.lit(0), F.least(F.lit(GRID - 1), _on_grid(x0, width)))
    b = F.greatest(F.lit(0), F.least(F.lit(GRID - 1), _on_grid(y0, height)))
    c = F.greatest(a + 1, F.least(F.lit(GRID), _on_grid(x1, width)))
    d = F.greatest(b + 1, F.least(F.lit(GRID), _on_grid(y1, height)))
    return F.when((width > 0) & (height > 0) & (x1 > x0) & (y1 > y0), F.array(a, b, c, d))


def table_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """As ``line_box``, but the far corner's least value is 1."""
    low = lambda v, s: F.greatest(F.lit(0), F.least(F.lit(GRID - 1), _on_grid(v, s)))
    high = lambda v, s: F.greatest(F.lit(1), F.least(F.lit(GRID), _on_grid(v, s)))
    box = F.array(low(x0, width), low(y0, height), high(x1, width), high(y1, height))
    return F.when((width > 0) & (height > 0) & (box[2] > box[0]) & (box[3] > box[1]), box)


def union_box(box: Column) -> Column:
    """Aggregate: the box around all boxes; null without any."""
    return F.when(F.count(box) > 0, F.array(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])))


def is_box(box: Column) -> Column:
    inside = F.forall(box, lambda v: (v >= 0) & (v <= GRID))
    return (F.size(box) == 4) & inside & (box[0] < box[2]) & (box[1] < box[3])


def margin_band(box: Column) -> Column:
    return F.when(box[3] <= TOP, F.lit("top")).when(box[1] >= BOTTOM, F.lit("bottom"))


def zone(center: Column, height: Column) -> Column:
    return F.when(center <= HEADER * height, F.lit("header")).when(center >= SIGNATURE * height, F.lit("signature")).otherwise(F.lit("body"))


def side(x0: Column, width: Column) -> Column:
    return F.when(x0 < 0.40 * width, F.lit("left")).otherwise(F.lit("right"))


def is_centered(x0: Column, x1: Column, width: Column) -> Column:
    return (F.abs((x0 + x1) / 2 - width / 2) < 0.08 * width) & (x1 - x0 < 0.60 * width)


def is_indented(x0: Column, width: Column) -> Column:
    return x0 > 0.12 * width


def anchor(kind: Column, box: Column) -> Column:
    """Seals, stamps and signatures in the lower quarter belong to the signature block."""
    return F.when(kind.isin("seal", "stamp", "signature") & ((box[1] + box[3]) / 2 >= SIGNATURE * GRID), F.lit("signature"))


def emu(v: Column, size: Column) -> Column:
    """Grid value to length units, cut off."""
    return (v / GRID * size).cast("bigint")


def span(lo: Column, hi: Column, bounds: Column, tolerance: float = 0.5) -> Column:
    """How many grid columns (or rows) lie between two edges, given the sorted distinct bounds; at least 1."""
    inner = F.filter(bounds, lambda b: (b >= lo - tolerance) & (b < hi - tolerance))
    return F.greatest(F.lit(1), F.size(inner))
