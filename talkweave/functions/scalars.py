"""Numeric functions as native column expressions.

greatest and least skip nulls, so every value takes its default before it is clamped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null for what isn't a finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_or(x: Column, fallback: Column) -> Column:
    return F.coalesce(finite(x), fallback)


def parsed_or(raw: Column, fallback: float) -> Column:
    """A number from text, else the fallback."""
    return F.coalesce(raw.try_cast("double"), F.lit(fallback))


def samples(seconds: Column, rate: Column) -> Column:
    """Half-even rounding, null and negative count as 0."""
    return F.greatest(F.rint(F.coalesce(seconds, F.lit(0.0)) * rate), F.lit(0.0)).cast("long")


def window_bounds(n_samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """Struct of effective start, end and total seconds, and sample bounds; null if the rate isn't positive."""
    total = n_samples / rate
    clamp = lambda x, top: F.least(F.greatest(x, F.lit(0.0)), top)
    begin = clamp(finite_or(start, F.lit(0.0)), total)
    stop = F.greatest(clamp(finite_or(end, total), total), begin)
    at = lambda s: F.rint(s * rate).cast("long")
    return F.when(rate > 0, F.struct(begin.alias("start_seconds"), stop.alias("end_seconds"), total.alias("total_seconds"), at(begin).alias("start_sample"), at(stop).alias("end_sample")))


def edge_distances(start: Column, end: Column, window_start: Column, window_end: Column) -> tuple[Column, Column]:
    """Distance of a segment to either side of its window, 0 at least; null in, null out."""
    left, right = start - window_start, window_end - end
    positive = lambda x: F.when(x > 0, x).when(x <= 0, F.lit(0.0))
    return positive(left), positive(right)


def clipped(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """struct(start, end) inside the window, null if nothing is left."""
    low, high = F.greatest(start, window_start), F.least(end, window_end)
    whole = start.isNotNull() & end.isNotNull() & (end > window_start) & (start < window_end) & (high > low)
    return F.when(whole, F.struct(low.alias("start"), high.alias("end")))


def frame_time(index: Column, fps: Column) -> Column:
    """P12."""
    return F.when(fps > 0, index / fps).otherwise(0.0)


def byte_size(n: Column) -> Column:
    """1024 ladder, two decimals (halves to even, on the exact quotient), up to TB; null, negative and zero are 0B."""
    out = F.lit("0B")
    value, steps = n.cast("double"), []
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scaled = value / float(1024**k)
        whole = F.floor(scaled)
        cents = whole * 100 + F.rint((scaled - whole) * 100).cast("long")  # format_string rounds halves up
        steps.append((scaled < 1024 if unit != "TB" else F.lit(True), F.format_string(f"%d.%02d{unit}", F.floor(cents / 100), cents % 100)))
    shown = None
    for ok, text in steps:
        shown = F.when(ok, text) if shown is None else shown.when(ok, text)
    return F.when(n > 0, shown).otherwise(out)


def multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with the product unrounded, as one fused instruction does it: halves of the numbers give the rounding errors. Factors are bound once, so the expression stays short where it is repeated."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)

    def added(s: Column) -> Column:
        product, total = s["p"], s["p"] + s["c"]
        al, bl, back = s["a"] - s["ah"], s["b"] - s["bh"], total - product
        lost = (s["ah"] * s["bh"] - product) + s["ah"] * bl + al * s["bh"] + al * bl
        exact = total + (lost + ((product - (total - back)) + (s["c"] - back)))
        return F.when(F.isnan(exact), total).otherwise(exact)  # numbers too large for halves

    bound = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b).alias("p"), high(a).alias("ah"), high(b).alias("bh"))
    return F.transform(F.array(bound), added)[0]


def clock(seconds: Column) -> Column:
    """MM:SS, cut off, minutes without bound."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("int"))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    common = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    norm = F.sqrt(total(a) * total(b))
    return F.when(norm > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - common / norm))).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def color_name(r: Column, g: Column, b: Column) -> Column:
    """Rule-based name of a colour."""
    return (
        F.when((r > 200) & (g > 200) & (b > 200), "white")
        .when((r < 50) & (g < 50) & (b < 50), "black")
        .when((r > g) & (r > b), "red-ish")
        .when((g > r) & (g > b), "green-ish")
        .when((b > r) & (b > g), "blue-ish")
        .otherwise("mixed")
    )
