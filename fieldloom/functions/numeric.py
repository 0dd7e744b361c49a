"""Exact rounding, half-precision quantising and hash-derived draws, as built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Half precision: 10 fraction bits, smallest exponent -14, and the first value that rounds to infinity.
HALF_BITS, HALF_LEAST, HALF_LIMIT = 10, -14, 65520.0


def fp16(x: Column) -> Column:
    """x rounded half-even to half precision, as a double; null where it would not be finite."""
    size = F.greatest(F.abs(x), F.lit(2.0**-30))
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(HALF_LEAST)) - HALF_BITS)
    return F.when(F.abs(x) < HALF_LIMIT, F.rint(x / ulp) * ulp + 0.0)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def exact_round(v: Column, digits: int) -> Column:
    """v rounded to `digits` decimals by its exact binary value, ties to even, never -0.

    |v| times 2 * 10**digits is kept as a sum and its rounding error, so that the half is told from its neighbours.
    """
    k = float(2 * 10**digits)

    def nearest(q: Column) -> Column:
        f, t = q["f"], q["t"]
        return F.when(t > 0, f + 1).when(t < 0, f).when(F.pmod(f, F.lit(2.0)) == 0, f).otherwise(f + 1)

    def split(p: Column) -> Column:
        x, y = p["x"], p["y"]
        rest = lambda s, f: F.struct(f.alias("f"), ((s / 2 - f - 0.5) + ((x - (s - (s - x))) + (y - (s - x))) / 2).alias("t"))
        return bound(x + y, lambda s: bound(bound(F.floor(s / 2).cast("double"), lambda f: rest(s, f)), nearest))

    high = lambda a: bound(a * 134217729.0, lambda g: g - (g - a))
    size = bound(F.abs(v), lambda a: bound(high(a), lambda hi: bound(F.struct((hi * k).alias("x"), ((a - hi) * k).alias("y")), split)))
    return F.signum(v) * size / float(10**digits) + 0.0


def draw(n: Column | int, *key: Column | str | int) -> Column:
    """An integer in [0, n), or null if n is 0, from the SHA-256 of the key's parts, joined by ':'."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in key]
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("bigint")
    return F.try_mod(h, n if isinstance(n, Column) else F.lit(n)).cast("int")


def order_key(*key: Column | str | int) -> Column:
    """A reproducible shuffle order: the SHA-256 hex of the key's parts."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in key]
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def uniform(*key: Column | str | int) -> Column:
    """A double in [0, 1), of 48 bits, from the SHA-256 of the key's parts."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in key]
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("bigint")
    return h / F.lit(float(1 << 48))


#: Rounds of the Feistel network, an even number; and how often a number may be walked on: each walk ends with a chance over one half.
ROUNDS, WALKS = 8, 64


def permuted(i: Column, n: Column, *key: Column | str | int) -> Column:
    """The i-th number of a random order of 0 ... n - 1 that the key sets: distinct for distinct i below n, without listing the others.

    A Feistel network permutes the numbers of as many bits as n - 1 has; one that lands at n or above walks on until it doesn't.
    """
    bits = F.greatest(F.lit(2), F.length(F.conv((n - 1).cast("string"), 10, 2)))
    left = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    right = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / right).cast("long").alias("l"), (x % right).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            size = F.when(k % 2 == 0, left).otherwise(right)
            return F.struct(s["r"].alias("l"), ((s["l"] + draw(size, *key, "round", k, s["r"])) % size).cast("long").alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * right + s["r"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), once(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no number below n was met")).cast("long"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers by Euclid's rule; 91 steps suffice for 63 bits."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step, lambda s: s["x"])


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("int")


def cost_bucket(n: Column) -> Column:
    """Number of bits that n - 1 needs: sizes of equal value fit the same power of two."""
    return F.length(F.regexp_replace(F.conv((n - 1).cast("string"), 10, 2), "^0+", ""))


def floor_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.length(F.conv(n.cast("string"), 10, 2)) - 1).cast("long")


def warmup_cosine(step: Column, warmup: int, total: int, floor: float = 0.0) -> Column:
    """Learning-rate factor: linear up to warmup, then half a cosine down to floor."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(part * math.pi)))
