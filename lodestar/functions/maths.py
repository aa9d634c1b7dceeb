"""Mathematical functions with the semantics that differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.strings import col


def round_(c: Column | str, digits: int = 0) -> Column:
    """Half away from zero; an integer without digits."""
    out = F.round(col(c).cast("double"), digits)
    return out.cast("bigint") if digits == 0 else out


def truncate(c: Column | str, digits: int = 0) -> Column:
    """Toward zero; an integer without digits."""
    scale = float(10**digits)
    out = F.signum(col(c)) * F.floor(F.abs(col(c).cast("double")) * scale) / scale
    return out.cast("bigint") if digits == 0 else out


def mod(a: Column | str, b: Column | str) -> Column:
    """Remainder of the truncated operands, with the sign of the first."""
    return F.call_function("mod", col(a).cast("bigint"), col(b).cast("bigint"))


def sign(c: Column | str) -> Column:
    return F.signum(col(c)).cast("int")


def acos(c: Column | str) -> Column:
    return F.when(F.abs(col(c)) <= 1, F.acos(col(c)))


def asin(c: Column | str) -> Column:
    return F.when(F.abs(col(c)) <= 1, F.asin(col(c)))


def cot(c: Column | str) -> Column:
    return F.when(F.sin(col(c)) != 0, F.cot(col(c)))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def lerp(a: Column | str, b: Column | str, t: Column | float) -> Column:
    return col(a) + (col(b) - col(a)) * t


def gcd(a: Column | str, b: Column | str) -> Column:
    """Euclid's steps as a fold; 100 suffice for any two 64-bit numbers."""
    start = F.struct(F.abs(col(a).cast("bigint")).alias("x"), F.abs(col(b).cast("bigint")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step, lambda s: s["x"])


def lcm(a: Column | str, b: Column | str) -> Column:
    x, y = col(a).cast("bigint"), col(b).cast("bigint")
    return F.when((x == 0) | (y == 0), F.lit(0).cast("bigint")).otherwise(F.abs(x) / gcd(x, y) * F.abs(y)).cast("bigint")


def is_prime(c: Column | str) -> Column:
    """By trial division of odd numbers up to the root."""
    n = col(c).cast("bigint")
    tried = F.sequence(F.lit(3).cast("bigint"), F.greatest(F.floor(F.sqrt(n)), F.lit(3)).cast("bigint"), F.lit(2).cast("bigint"))
    return F.when(n < 2, False).when(n < 4, True).when(n % 2 == 0, False).otherwise(~F.exists(tried, lambda d: (d * d <= n) & (n % d == 0)))


def fibonacci(c: Column | str) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    turns = F.filter(F.sequence(F.lit(1), F.greatest(col(c).cast("int"), F.lit(1))), lambda i: i <= col(c))
    return F.aggregate(turns, start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["a"])


def binomial(n: Column | str, k: Column | str) -> Column:
    a, b = col(n).cast("bigint"), col(k).cast("bigint")
    steps = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(b, F.lit(1).cast("bigint"))), lambda i: i <= b)
    return F.when((b < 0) | (b > a), F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: F.floor(acc * (a - b + i) / i).cast("bigint")))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    la1, lo1, la2, lo2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bounding_box(lat, lon, km: float) -> Column:
    """min_lat, max_lat, min_lon, max_lon around a point."""
    d = F.degrees(F.lit(km / 6371.0))
    e = d / F.cos(F.radians(col(lat)))
    return F.struct((col(lat) - d).alias("min_lat"), (col(lat) + d).alias("max_lat"), (col(lon) - e).alias("min_lon"), (col(lon) + e).alias("max_lon"))


def sinh(c: Column | str) -> Column:
    return F.sinh(col(c))


def cosh(c: Column | str) -> Column:
    return F.cosh(col(c))


def tanh(c: Column | str) -> Column:
    return F.tanh(col(c))


def log2(c: Column | str) -> Column:
    return F.log2(col(c))


def cbrt(c: Column | str) -> Column:
    return F.cbrt(col(c))


def hypot(a: Column | str, b: Column | str) -> Column:
    return F.hypot(col(a), col(b))


def div(a: Column | str, b: Column | str) -> Column:
    """Quotient without its fraction, toward zero; NULL for a divisor of 0."""
    x, y = col(a).cast("bigint"), col(b).cast("bigint")
    return F.when(y != 0, F.call_function("div", x, F.when(y != 0, y)))


def is_nan(c: Column | str) -> Column:
    return F.isnan(col(c))


def is_inf(c: Column | str) -> Column:
    return F.abs(col(c)) == F.lit(float("inf"))


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """Whole numbers from low to high, both included."""
    return (F.floor((F.rand(seed) if seed is not None else F.rand()) * (high - low + 1)) + low).cast("bigint")


_GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the digits of a geohash


def geohash(lat: Column | str, lon: Column | str, length: int = 12) -> Column:
    """Bits of longitude and latitude in turn, five to a digit."""
    bits = 5 * length
    wide, high = (bits + 1) // 2, bits // 2
    cell = lambda c, span, n: F.least(F.greatest(F.floor((col(c).cast("double") + span) / (2 * span) * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("bigint")
    x, y, out = cell(lon, 180.0, wide), cell(lat, 90.0, high), []
    bit = lambda k: F.shiftright(x, wide - 1 - k // 2).bitwiseAND(F.lit(1)) if k % 2 == 0 else F.shiftright(y, high - 1 - k // 2).bitwiseAND(F.lit(1))
    for d in range(length):
        digit = sum((bit(5 * d + i) * (16 >> i) for i in range(1, 5)), bit(5 * d) * 16)
        out.append(F.substring(F.lit(_GEOHASH), (digit + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash_point(c: Column | str) -> Column:
    """lat and lon of the middle of a cell."""
    digits = F.transform(F.filter(F.split(F.lower(col(c)), ""), lambda x: x != ""), lambda x: F.instr(F.lit(_GEOHASH), x) - 1)
    bits = F.flatten(F.transform(digits, lambda d: F.transform(F.array(*(F.lit(i) for i in (4, 3, 2, 1, 0))), lambda i: F.call_function("mod", F.floor(d / F.pow(F.lit(2.0), i)).cast("int"), F.lit(2)))))
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("a", -180.0), ("b", 180.0), ("c", -90.0), ("d", 90.0))), F.lit(True).alias("even"))

    def halve(s: Column, bit: Column) -> Column:
        x, y = (s["a"] + s["b"]) / 2, (s["c"] + s["d"]) / 2
        even, up = s["even"], bit == 1
        keep = lambda cond, new, old: F.when(cond, new).otherwise(old)
        return F.struct(keep(even & up, x, s["a"]).alias("a"), keep(even & ~up, x, s["b"]).alias("b"), keep(~even & up, y, s["c"]).alias("c"), keep(~even & ~up, y, s["d"]).alias("d"), (~even).alias("even"))

    return F.aggregate(bits, start, halve, lambda s: F.struct(((s["c"] + s["d"]) / 2).alias("lat"), ((s["a"] + s["b"]) / 2).alias("lon")))
