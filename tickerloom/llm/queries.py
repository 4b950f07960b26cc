"""Imports the operators, which register their queries."""

from tickerloom.llm import (  # noqa: F401
    anchors,
    base,
    divergence,
    licenses,
    linedup,
    mixing,
    ogg,
    packing,
    quality,
    simhash,
    suffix,
    tokenfile,
    urllists,
    vectorcodes,
)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
