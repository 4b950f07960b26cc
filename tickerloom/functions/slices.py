"""Which print classes a metric counts. Each slice is a (shares, dollars) pair of columns."""

from pyspark.sql import functions as F

# The classes of each slice.
COUNTED = ("continuous", "block", "non_price_forming")
AUCTIONS = COUNTED + ("cross_open", "cross_reopen", "cross_close")
EXTENDED = ("non_flow",)


def _total(classes, part):
    cols = [F.col(f"{c}_{part}") for c in classes]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def class_slice(classes):
    """(shares, dollars) of any list of classes: a slice of the user's own."""
    return _total(classes, "shares"), _total(classes, "dollars")


def counted():
    """Regular flow."""
    return class_slice(COUNTED)


def counted_with_auctions():
    """Regular flow and the auction crosses."""
    return class_slice(AUCTIONS)


def extended_hours():
    """Extended-hours flow; only meaningful in a pre- or post-market window."""
    return class_slice(EXTENDED)


def notional(price, size):
    """price * size as a double."""
    return F.col(price) * F.col(size)
