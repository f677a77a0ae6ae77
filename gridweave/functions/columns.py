"""Scalar column expressions. All of them stay in the JVM and in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave import constants as C


def strip(c: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def masked_number(c: Column, kind: str = "float") -> Column:
    """A count as text: the mask token and blanks are null, other text that is no number is an error."""
    v = strip(c)
    return F.when(~v.isin(C.MASK_TOKENS), v.cast(kind))


def compact_date(c: Column) -> Column:
    return F.to_date(c, "yyyyMMdd")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyyMM")


def time_bin(hour: Column) -> Column:
    """Hours 0 to 5 are one bin, each later hour its own."""
    return F.when(hour <= 5, F.lit("00")).otherwise(F.lpad(hour.cast("string"), 2, "0"))


def bin_rank(b: Column, order: Sequence[str] = tuple(C.TIME_BINS)) -> Column:
    """Place of a code in its order; an unknown code is an error."""
    ranks = F.create_map(*(F.lit(x) for i, code in enumerate(order) for x in (code, i)))
    rank = F.try_element_at(ranks, b)
    return F.when(b.isNotNull() & rank.isNull(), F.raise_error(F.concat(F.lit("unknown code "), b)).cast("int")).otherwise(rank)


def sum_of(*columns: Column) -> Column:
    """Sum over columns, nulls as 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def ratio(part: Column, whole: Column) -> Column:
    """part / whole where whole is above 0, else null."""
    return F.when(whole > 0, part / whole)


def zero_sum(c: Column) -> Column:
    """Sum of a group where a group without values sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def district(code: Column) -> Column:
    return F.substring(code, 1, 5)


def threshold_flags(c: Column, thresholds: Sequence[float] = (25, 50, 100)) -> dict[str, Column]:
    return {f"active_{t:g}": c >= t for t in thresholds}


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def grid_index(coordinate: Column, origin: float, step: float = C.GRID_STEP) -> Column:
    """Nearest grid line, halves to even."""
    return F.rint((coordinate - origin) / step).cast("int")


def station_key(name: Column) -> Column:
    """A station's name without parentheses, blanks and the closing word for station."""
    s = F.regexp_replace(F.regexp_replace(name, r"\(.*?\)", ""), " ", "")
    s = strip(s)
    return F.when((F.length(s) > 1) & s.endswith("역"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


def arg_max(values: Column) -> Column:
    """Place (from 0) of the first greatest element; null if there is none."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)).cast("int") - 1)


def top_margin(values: Column) -> Column:
    """Greatest less second greatest element."""
    s = F.sort_array(values, asc=False)
    return s[0] - s[1]


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, also where it is used inside lambdas."""
    return F.transform(F.array(value), then)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    powers = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(_total(e), lambda t: F.transform(e, lambda x: x / t)))


def entropy(shares: Column, states: int) -> Column:
    """Shannon entropy of shares over the logarithm of the number of states."""
    return -_total(F.transform(shares, lambda p: F.when(p > 0, p * F.ln(p + 1e-12)).otherwise(F.lit(0.0)))) / math.log(states)


def top_parts(names: Sequence[str], shares: Column, most: int = 3) -> Column:
    """The greatest shares as name=0.xx;..., equal ones in the order of names."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.struct((-F.element_at(shares, i + 1)).alias("s"), i.alias("i")))
    labels = F.array(*(F.lit(n) for n in names))
    best = F.slice(F.array_sort(pairs), 1, most)
    return F.array_join(F.transform(best, lambda x: F.concat(F.element_at(labels, x["i"] + 1), F.lit("="), F.format_number(-x["s"], 2))), ";")


def clr(shares: Column, delta: float = C.ZERO_REPLACEMENT) -> Column:
    """Centred log-ratio of an array of shares after multiplicative replacement of zeros by delta.

    A constant factor cancels in it, so the replaced shares need not be closed to a sum of 1 again.
    """
    filled = let(F.size(F.filter(shares, lambda x: x == 0)), lambda z: F.transform(shares, lambda x: F.ln(F.when(x == 0, F.lit(delta)).otherwise(x * (1 - z * delta)))))
    return let(filled, lambda logs: let(_total(logs) / F.size(shares), lambda m: F.transform(logs, lambda x: x - m)))


def inverse_clr(values: Column) -> Column:
    return softmax(values)


def korea_unified(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of geographic coordinates on GRS80: transverse Mercator, origin 38 N 127.5 E, scale 0.9996."""
    a, f, lat0, lon0, k0, fe, fn = 6378137.0, 1 / 298.257222101, math.radians(38), math.radians(127.5), 0.9996, 1_000_000.0, 2_000_000.0
    n = f / (2 - f)
    # Krueger's series to the fourth order.
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = math.sqrt(f * (2 - f))

    def conformal(s):
        return math.sinh(math.atanh(s) - e * math.atanh(e * s))

    t0 = conformal(math.sin(lat0))
    xi0 = math.atan(t0)
    m0 = big_a * (xi0 + sum(c * math.sin(2 * (j + 1) * xi0) for j, c in enumerate(alpha)))
    phi, lam = F.radians(lat), F.radians(lon) - lon0
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, c in enumerate(alpha):
        north = north + c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta)
        east = east + c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta)
    return fe + k0 * big_a * east, fn + k0 * (big_a * north - m0 / 1.0)
