"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ratio(num: Column, den: Column, floor: float = 0.0) -> Column:
    """num / den where den exceeds the floor, else null."""
    return F.when(den > floor, num / den)


def cp_k(value: Column, depth: Column, target: float) -> Column:
    """Counts per `target`; zero depth gives zero."""
    return F.when(depth > 0, value * target / depth).otherwise(0.0)


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, eps: float = EPS) -> Column:
    """Pearson from moments; null where either side is constant."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    den = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.when(den > eps, (sxy - sx * sy / n) / den)


def pearson(x: Column, y: Column, eps: float = 1e-9) -> Column:
    """Aggregate: guarded Pearson of two columns over rows where both are there."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(F.when(both, F.lit(1)))
    return pearson_from_sums(n, F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y), eps)


def cosine(x: Column, y: Column, eps: float = EPS) -> Column:
    """Aggregate: cosine; null for a zero vector."""
    den = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return F.when(den > eps, F.sum(x * y) / den)


def spearman_brown(rho: Column) -> Column:
    """Reliability of the whole from that of halves."""
    return F.when(rho > -1, 2 * rho / (1 + rho))


def disattenuate(r: Column, rho: Column, min_rho: float = 0.05, clip: float = 1.5) -> Column:
    """r over the root of a reliability above min_rho, clipped; else null."""
    return F.when(rho > min_rho, F.least(F.lit(clip), F.greatest(F.lit(-clip), r / F.sqrt(F.greatest(rho, F.lit(0.0))))))


def noise_ceiling(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))


def quality_band(rho: Column, high: float = 0.8, moderate: float = 0.5) -> Column:
    return F.when(rho.isNull(), "not estimable").when(rho >= high, "high").when(rho >= moderate, "moderate").otherwise("low")


def draw_key(*parts: Column | str | int) -> Column:
    """A hash that orders rows at random, alike in every SQL engine: md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw_index(key: Column, n: Column) -> Column:
    """A whole number from 0 to n - 1 from a hash."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % n


def log2_fold_change(profile: Column, delta: Column, floor: Column, clip: float = 10.0) -> Column:
    """log2 of the changed over the unchanged profile, both log1p, floored and clipped."""
    num, den = F.greatest(F.expm1(profile + delta), floor), F.greatest(F.expm1(profile), floor)
    return F.least(F.lit(clip), F.greatest(F.lit(-clip), F.log2(num / den)))


def seed_for(key: Column) -> Column:
    """A seed from the first four bytes, little-endian, of the SHA-256 of a key."""
    h = F.sha2(key, 256)
    swapped = F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")
