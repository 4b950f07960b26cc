"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Nothing is shuffled and no Python runs on the executors. Each rule bounds a ratio of two counts of
the document, written as integers so that both sides of a comparison are exact.
"""

from pyspark.sql import functions as F

from tickerloom.llm import base

#: Characters counted as symbols, as a class of a regular expression.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# Frequent words of the four languages of the documents.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les un du une que pour est dans qui par sur pas au avec en "
    "el y los se las del por con no una su para al es lo"
).split()

#: name, counts above and below, the ratio's least and greatest value in thousandths (None: no
#: bound), and how many words a document must have for the rule to be asked.
RULES = [
    ("mean_word_length", "word_chars", "n_words", 2000, 12000, 1),
    ("symbols_per_word", "n_symbols", "n_words", None, 100, 1),
    ("stop_words_per_word", "n_stop_words", "n_words", 50, None, 30),
    ("duplicate_lines_per_line", "n_dup_lines", "n_lines", None, 400, 1),
]
MIN_WORDS = 10
REPEAT_PERCENT = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def failed(rules):
    """Array of the names of the rules that a row of counts breaks."""

    def broken(name, above, below, least, most, words):
        a, b = 1000 * F.col(above), F.col(below)
        out = F.lit(False)
        out = out | (a < least * b) if least is not None else out
        out = out | (a > most * b) if most is not None else out
        return F.when((F.col("n_words") >= words) & out, F.lit(name))

    return F.array_compact(F.array(*(broken(*r) for r in rules)))


def _repeated_places(order):
    """Where windows start that occur twice or more, ascending.

    `order` holds (window, place) sorted: equal windows are neighbours.
    """
    at = lambda i: F.get(order, i)["window"]
    again = lambda x, i: (at(i - 1) == x["window"]) | (at(i + 1) == x["window"])
    return F.array_sort(F.transform(F.filter(order, again), lambda x: x["place"]))


def measure(docs):
    """docs (doc_id, text) with the counts of COUNTS and n_lines, n_stop_words.

    A null text has no words and counts of 0. Words, lines and windows are of whole texts.
    """
    text = F.col("_text")
    df = docs.select("doc_id", base.text_or_empty().alias("_text"))
    has_word = r"[^\x20\x09-\x0D]"
    df = df.select(
        "doc_id",
        base.once(base.words(text)).alias("_words"),
        base.once(F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))).alias("_lines"),
        base.once(F.length(F.regexp_replace(text, base.SPACE, ""))).alias("word_chars"),
        base.once(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))).alias("n_symbols"),
    )
    word = lambda i: [F.get("_words", i + k) for k in range(WINDOW)]
    enough = F.size("_words") >= WINDOW
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    df = df.withColumn("_hashes", base.once(F.when(enough, F.transform(starts, lambda i: F.xxhash64(*word(i))))))
    # Where all hashes differ, all windows do; only other documents compare the windows themselves.
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pair = lambda i: F.struct(F.concat_ws(" ", *word(i)).alias("window"), i.alias("place"))
    df = df.withColumn("_order", base.once(F.when(some, F.array_sort(F.transform(starts, pair)))))
    df = df.withColumn("_places", base.once(_repeated_places("_order")))
    gap = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - x, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("_places", gap), F.lit(0), lambda a, x: a + x)
    long = lambda c: base.once(c.cast("bigint"))
    return df.select(
        "doc_id",
        long(F.size("_words")).alias("n_words"),
        long(F.col("word_chars")).alias("word_chars"),
        long(F.col("n_symbols")).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
    )


def judge(counts, rules=None):
    """Rows of counts with base_failed, kept and the names of the broken rules."""
    rules = RULES if rules is None else rules
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    out = counts.withColumn("base_failed", base_failed).withColumn("broken", failed(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs, rules=None):
    """The rows of docs that no rule rejects, all columns as they are.

    Repeated rows are judged alike; an empty or null text has too few words and goes. Columns of
    docs named like a count are kept apart from it.
    """
    row = base.free_name(docs, "_row")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id")
    own = docs.select(whole, F.col("text"))
    judged = judge(measure(own), rules).filter("kept").select(F.col("doc_id").alias(row))
    return judged.select(*(F.col(row)[c].alias(c) for c in docs.columns))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, sum(n) AS n FROM (
    SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM rep)
  GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda x: list_contains({STOP_WORDS!r}, lower(x)))) AS n_stop_words
  FROM w LEFT JOIN cov ON w.doc_id IS NOT DISTINCT FROM cov.doc_id),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars BETWEEN 2 * n_words AND 12 * n_words
    AND 10 * n_symbols <= n_words
    AND (n_words < 30 OR 20 * n_stop_words >= n_words)
    AND 10 * n_dup_lines <= 4 * n_lines AS kept
FROM v
"""


@base.register("op5_quality_rules", ORACLE)
def op5(spark, sf_dir):
    """Every document's counts and verdict."""
    out = judge(measure(base.documents(spark, sf_dir)))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
