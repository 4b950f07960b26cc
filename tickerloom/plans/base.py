"""How a query is registered, shaped and paired with its SQL.

A column spec is a list of `kind:name` texts shared by both sides, so names and types agree:
d date as text, s text, i integer; doubles by digits kept: m 3 (large sums), f 6, p 8, x 11
(short decimals that would otherwise tie).
"""

DIGITS = {"f": 6, "p": 8, "m": 3, "x": 11}
QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    """Add fn(spark, sf_dir) under a name, with the SQL that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def cols(text):
    """'d:day s:symbol' -> [('d', 'day'), ('s', 'symbol')]."""
    return [tuple(part.split(":")) for part in text.split()]


def shape(df, spec):
    """df with exactly the columns of a spec."""
    out = []
    for kind, name in cols(spec):
        if kind in "ds":
            e = f"cast({name} as string)"
        elif kind == "i":
            e = f"cast({name} as bigint)"
        else:
            e = f"round(cast({name} as double), {DIGITS[kind]}) + 0D"  # no negative zero
        out.append(f"{e} AS {name}")
    return df.selectExpr(*out)


def pick(spec, **exprs):
    """The select list of a spec; `exprs` gives the SQL of columns that are not plain names."""
    out = []
    for kind, name in cols(spec):
        e = exprs.get(name, name)
        if kind in "ds":
            e = f"CAST({e} AS VARCHAR)"
        elif kind == "i":
            e = f"CAST({e} AS BIGINT)"
        else:
            e = f"round(CAST({e} AS DOUBLE), {DIGITS[kind]}) + 0.0::DOUBLE"
        out.append(f"{e} AS {name}")
    return ", ".join(out)


def select(ctes, spec, source, tail="", **exprs):
    """WITH ctes SELECT spec FROM source."""
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {pick(spec, **exprs)}\nFROM {source} {tail}"
