"""The pipeline over documents: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes the rows that the one before kept and returns the columns of documents; the last
returns the pieces of packed sequences. Other columns pass through unchanged, whatever their names.
Empty tables give empty tables.
"""

from pyspark.sql import functions as F

from tickerloom.llm import base, linedup, mixing, nearcopies, packing, quality

#: Near copies share 0.8 of their shingles of five words.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark, docs, sf_dir):
    """Documents that no quality rule rejects.

    A null or empty text has no words and is rejected. Every row is judged by itself, so repeated
    rows go or stay together.
    """
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Later occurrences of three lines gone; n_chars, where there is one, follows the text.

    Null and empty texts stay as they are. The first occurrence is that of the least doc_id, null
    ids last; texts of equal id are ordered by their hash. Rows equal in doc_id and text are one
    document and keep the same lines.
    """
    name = {c: base.free_name(docs, f"_{k}") for k, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_removed")}
    aside = docs.withColumnsRenamed(name)  # counts of the operator's own have these names
    out = linedup.remove_lines(aside).select(*(F.col(f"`{name.get(c, c)}`").alias(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: the least doc_id, null last, then the least row hash.

    Texts without words, null ones too, are one group. Rows equal in all columns are copies.
    """
    return nearcopies.keep_one(docs, SHINGLE, SIMILARITY)


def source_mix(spark, docs, sf_dir):
    """Sources at their target weights: each document as often as the mix takes it.

    Null and empty texts have no words and are not needed for any target. Ties between documents of
    one length go by a seeded hash; rows equal in doc_id and text are told apart by their order in it.
    """
    return mixing.take(docs)


def packing_windows(spark, docs, sf_dir):
    """The documents as sequences of 4096 tokens.

    A null or empty text is the end token alone. Every row is packed, repeated ones too.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mix),
    ("packing", packing_windows),
]

#: Fingerprints, the fit and tokens are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = base.settled(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
