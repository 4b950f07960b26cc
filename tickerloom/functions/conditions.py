"""Sale-condition codes: parsing, print classes, lateness flag.

The class of a print is looked up in a literal array, one slot at a time, so the
expression stays inside generated code; only arrays of more than eight ids take a higher-order
function. Readers keep eight ids and count the rest; `classify` sees whatever array it is given.
"""

from pyspark.sql import functions as F

from tickerloom.functions.session import _col
from tickerloom.schema import CLASSES, MAX_CONDITIONS, RANK

# Condition ids of each print class.
CLASS_IDS = {
    "non_flow": (7, 12, 13, 15, 16, 20, 29, 38),
    "duplicate": (2,),
    "non_price_forming": (5, 10, 21, 22, 32, 33, 52, 53),
    "cross_reopen": (18, 28),
    "cross_open": (17, 25, 55),
    "cross_close": (8, 19),
    "block": (9, 24),
    "continuous": (1, 3, 4, 6, 11, 14, 23, 27, 30, 31, 34, 35, 36, 37),
}
# Ids that say nothing about the print.
NEUTRAL_IDS = (41, 57, 58, 59, 60, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71)
# Ids of "sold last" prints.
SOLD_LAST_IDS = (30, 31)


def _rank_by_id():
    ranks = {i: RANK["continuous"] for i in NEUTRAL_IDS}
    for name, ids in CLASS_IDS.items():
        ranks.update({i: RANK[name] for i in ids})
    return [ranks.get(i) for i in range(max(ranks) + 1)]


def rank_table_sql():
    """Literal array: id -> class rank, NULL where the id is not known."""
    return "array(" + ", ".join("NULL" if r is None else str(r) for r in _rank_by_id()) + ")"


def _known_rank(cond_id):
    return F.get(F.expr(rank_table_sql()), cond_id)


def parse_conditions(text):
    """Every id of a condition text; a token that is no number becomes -1."""
    tokens = F.filter(F.split(F.coalesce(_col(text), F.lit("")), "[, ;]+"), lambda t: t != "")
    return F.transform(
        tokens,
        lambda t: F.when(
            t.rlike("^[+-]?[0-9]+$"), F.coalesce(t.try_cast("int"), F.lit(-1))
        ).otherwise(F.lit(-1)),
    )


def cap_conditions(ids):
    """The first eight ids."""
    return F.slice(ids, 1, MAX_CONDITIONS)


def overflowed(ids):
    """1 when a message carried more than eight ids."""
    return (F.coalesce(F.size(ids), F.lit(0)) > MAX_CONDITIONS).cast("int")


def classify_sql(conditions):
    """Class rank over every id of the array: the first slots in generated code, longer ones whole."""
    table, top, unknown = rank_table_sql(), RANK["continuous"], RANK["unknown"]
    slots = [f"get({conditions}, {i})" for i in range(MAX_CONDITIONS)]
    ranks = [f"if({s} IS NULL, {top}, coalesce(get({table}, {s}), {unknown}))" for s in slots]
    rank = f"if(x IS NULL, {top}, coalesce(get({table}, x), {unknown}))"
    every = f"array_min(transform({conditions}, x -> {rank}))"
    return f"CASE WHEN size({conditions}) > {MAX_CONDITIONS} THEN {every} ELSE least({', '.join(ranks)}) END"


def classify(conditions):
    """Class rank of an id array column of any length (0 = highest precedence)."""
    return F.expr(classify_sql(conditions))


def class_name(rank):
    """Upper-case class name of a rank."""
    return F.get(F.array(*[F.lit(c.upper()) for c in CLASSES]), _col(rank))


def is_unknown(cond_id):
    """True for an id that is in neither table."""
    return _known_rank(_col(cond_id)).isNull()


def unknown_ids(conditions):
    """Every id of the array that is in neither table, repeats kept."""
    return F.filter(_col(conditions), lambda i: _known_rank(i).isNull())


def monitor_lateness(rank, conditions):
    """True for prints whose reporting delay is logged."""
    rank = _col(rank)
    sold_last = F.arrays_overlap(
        F.coalesce(_col(conditions), F.array().cast("array<int>")),
        F.array(*[F.lit(i) for i in SOLD_LAST_IDS]),
    )
    return (rank == RANK["non_price_forming"]) | ((rank == RANK["continuous"]) & sold_last)


def quote_conditions(raw):
    """Ids of a quote's condition field: a bare int or an int array, else none."""
    raw = _col(raw)
    many = F.from_json(raw, "array<int>")
    one = F.when(raw.rlike("^\\s*-?[0-9]+\\s*$"), F.array(raw.try_cast("int")))
    return F.coalesce(cap_conditions(F.coalesce(one, many)), F.array().cast("array<int>"))
