"""Text forms and colour flags of metric cells (for reading, never for joins)."""

from pyspark.sql import functions as F

from tickerloom.functions.session import _col
from tickerloom.schema import BREADTH_HIGHLIGHT, DEAD_BAND, Z_HIGHLIGHT


def _three_figures(x, unit):
    digits = F.when(x < 10, F.format_string("%.2f", x)).when(x < 100, F.format_string("%.1f", x))
    return F.concat(digits.otherwise(F.format_string("%.0f", x)), F.lit(unit))


def fmt_dollars(value):
    """550, 1.50k, 53.3M, 1.23B."""
    v = _col(value)
    return (
        F.when(v >= 1e9, _three_figures(v / 1e9, "B"))
        .when(v >= 1e6, _three_figures(v / 1e6, "M"))
        .when(v >= 1e3, _three_figures(v / 1e3, "k"))
        .otherwise(F.format_string("%.0f", v))
    )


def fmt_usd(value):
    """$1.2B, $34.5M, $680K, $0."""
    v = _col(value)
    return (
        F.when(v >= 1e9, F.format_string("$%.1fB", v / 1e9))
        .when(v >= 1e6, F.format_string("$%.1fM", v / 1e6))
        .when(v >= 1e3, F.format_string("$%.0fK", v / 1e3))
        .otherwise(F.format_string("$%.0f", v))
    )


def z_flag(z):
    """green / red when |z| reaches the highlight level."""
    z = _col(z)
    return F.when(z >= Z_HIGHLIGHT, "green").when(z <= -Z_HIGHLIGHT, "red")


def breadth_flag(up, down, members):
    """green / red when more than 70% of the members hold one side."""
    up, down, n = _col(up), _col(down), _col(members)
    return F.when(up / n > BREADTH_HIGHLIGHT, "green").when(down / n > BREADTH_HIGHLIGHT, "red")


def benchmark_flag(ret):
    """green / red outside the dead band, yellow inside it, NULL when unmeasured."""
    r = _col(ret)
    return (
        F.when(r > DEAD_BAND, "green")
        .when(r < -DEAD_BAND, "red")
        .when(r.isNotNull(), "yellow")
    )
