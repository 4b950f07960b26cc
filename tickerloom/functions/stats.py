"""Guarded z-score, robust centre and spread, exact rounding helpers."""

from pyspark.sql import functions as F

from tickerloom.functions.session import _col
from tickerloom.schema import MAD_TO_SIGMA


def _finite(x):
    x = F.abs(x)
    return x < F.lit(float("inf"))  # NaN sorts above infinity in Spark


def zguard(value, center, sigma, floor):
    """(value - center) / max(sigma, floor), NULL where that is not a finite number."""
    value, center, sigma, floor = (_col(x).cast("double") for x in (value, center, sigma, floor))
    used = F.greatest(sigma, floor)
    z = (value - center) / F.when(used > 0, used)
    ok = _finite(value) & _finite(center) & _finite(sigma) & _finite(floor)
    return F.when(ok & _finite(z), z)


def sorted_median(values):
    """Median of an ascending array; 0 for an empty one."""
    n = F.size(values)
    high = F.get(values, F.floor(n / 2).cast("int"))
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, high).otherwise((low + high) / 2)


def with_robust(df, **columns):
    """df with (median, 1.4826 * median absolute deviation) of array columns.

    columns: array column -> (median name, sigma name). Steps are separate projections, so
    each array is sorted once.
    """
    keep = [c for c in df.columns if c not in columns]
    arrays = list(columns)
    df = df.select(*keep, *[F.sort_array(a).alias(a) for a in arrays])
    meds = [sorted_median(F.col(a)).alias(columns[a][0]) for a in arrays]
    df = df.select(*keep, *arrays, *meds)

    def spread(a):
        m = F.col(columns[a][0])
        return F.sort_array(F.transform(a, lambda x: F.abs(x - m))).alias(a)

    df = df.select(*keep, *[columns[a][0] for a in arrays], *[spread(a) for a in arrays])
    sigmas = [(sorted_median(F.col(a)) * MAD_TO_SIGMA).alias(columns[a][1]) for a in arrays]
    return df.select(*keep, *[columns[a][0] for a in arrays], *sigmas)


def padded(values, n):
    """The array with zeros added up to n samples."""
    values = F.coalesce(values, F.array().cast("array<double>"))
    return F.concat(values, F.array_repeat(F.lit(0.0), (_col(n) - F.size(values)).cast("int")))


def ratio(a, b):
    """a / b, NULL where b is 0 or NULL."""
    return _col(a) / F.nullif(_col(b), F.lit(0.0))
