import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns whose names clash with those that operators use inside or return.
CLASHING = "size bigint, `_row` string, `_key` int, `_hash` string, length int, start int, anchor string, n_lines int"


@pytest.fixture(scope="session")
def docs(spark):
    """make(rows of (doc_id, text[, source])) -> documents, with clashing columns if wanted."""

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3) if full else spark.createDataFrame([], DOCS)
        if clash:
            extra = [f"cast(null as {c.split()[1]}) AS {c.split()[0]}" for c in CLASHING.split(", ")]
            df = df.selectExpr("*", *extra)
        return df

    return make


def prose(seed, n):
    """n invented words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "lo", "mi", "tu", "re", "é")) for _ in range(r.randint(1, 4))) for _ in range(n))


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (None, "no id here at all " * 4),
    (None, None),
    (4, prose(1, 200)),
    (4, prose(1, 200)),  # a repeated row
    (5, prose(2, 9000)),
    (6, "ééé " * 500),
    (7, "x" * 3000),
]
