"""Vector distances as column expressions (higher-order functions, no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.array(*(F.lit(x) for x in v))


def _sum(a, b, f) -> Column:
    terms = F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), f)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2(a, b) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a, b) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def inner_product(a, b) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine_similarity(a, b) -> Column:
    norm = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norm > 0, inner_product(a, b) / norm)


#: The similarity under the name that the query language gives it: it grows with likeness.
cosine_distance = cosine_similarity


def hamming(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def jaccard(a, b) -> Column:
    """1 - |a and b| / |a or b| on bit arrays; null where no bit is set."""
    both = F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x & y).cast("int")), F.lit(0), lambda s, x: s + x)
    some = F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x | y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(some > 0, 1 - both / some)


METRICS = {"l2": l2, "l1": l1, "inner": inner_product, "cosine": cosine_similarity, "hamming": hamming, "jaccard": jaccard}


def sphere_distance(lon1, lat1, lon2, lat2, radius=6370986.0) -> Column:
    """Metres along a sphere between two points in degrees."""
    lon1, lat1, lon2, lat2 = (F.radians(c) for c in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))
