"""Line dedup by overlapping windows of three lines.

Consecutive lines that have a word are hashed in threes. A window that occurs anywhere before, by
(doc_id, hash of the text, place), is a later occurrence, and every line that a later occurrence
covers is removed. All windows are judged on the input. A removed line always stays somewhere: it
equals the line at its place in the first occurrence, which comes earlier, and so on to one kept.
"""

from pyspark.sql import functions as F

from tickerloom.llm import base

LINES = 3


def windows(docs, n=LINES):
    """(no_id, id, hash, place, h1, h2): every window of n consecutive lines that have a word.

    `place` counts such lines from 0. h1 and h2 are two 64-bit hashes of the same lines, which
    together stand for the window.
    """
    text = base.text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    doc_id = F.col("doc_id").cast("bigint").alias("id")
    df = docs.select(doc_id, F.xxhash64(text).alias("hash"), base.once(lines).alias("lines"))
    mine = lambda i: [F.get("lines", i + k) for k in range(n)]
    two = lambda i: F.struct(F.xxhash64(*mine(i)).alias("h1"), F.xxhash64(F.lit(n), *mine(i)).alias("h2"))
    every = F.transform(F.sequence(F.lit(0), F.size("lines") - n), two)
    df = df.withColumn("all", base.once(F.when(F.size("lines") >= n, every)))
    df = df.select(F.col("id").isNull().alias("no_id"), "id", "hash", F.posexplode("all").alias("place", "window"))
    return df.select("no_id", "id", "hash", "place", "window.h1", "window.h2")


def covered(docs, n=LINES):
    """(no_id, id, hash, places): the lines to remove of each document that has some, ascending.

    A window's first occurrence comes from an aggregate that combines before the shuffle, so a
    window that a third of all documents share costs one row per task.
    """
    all_windows = windows(docs, n)
    where = F.struct("no_id", "id", "hash", "place")
    first = all_windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(where).alias("first"))
    again = all_windows.join(first.filter("n > 1"), ["h1", "h2"]).filter(~where.eqNullSafe(F.col("first")))
    lines = F.explode(F.sequence(F.col("place"), F.col("place") + n - 1)).alias("line")
    again = again.select("no_id", F.coalesce("id", F.lit(0)).alias("id"), "hash", lines)
    return again.groupBy("no_id", "id", "hash").agg(F.array_sort(F.collect_set("line")).alias("places"))


def remove_lines(docs, n=LINES):
    """docs with later occurrences gone from `text`, plus n_lines and n_removed (lines with a word).

    Null and empty texts stay as they are, lines without a word too. Rows equal in doc_id and text
    are one document and get the same text. Documents of equal doc_id are ordered by a hash of
    the text, null doc_ids come last. Existing columns n_lines and n_removed are replaced.
    """
    names = ("_no", "_key", "_hash", "_places", "_lines")
    no_id, key, text_hash, places, lines = (base.free_name(docs, c) for c in names)
    worded, every = base.free_name(docs, "_worded"), base.free_name(docs, "_every")
    text = base.text_or_empty()
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    found = covered(docs, n).toDF(no_id, key, text_hash, places)
    df = docs.withColumn(no_id, F.col("doc_id").isNull())
    df = df.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)))
    df = df.withColumn(text_hash, F.xxhash64(text))
    df = df.join(found, [no_id, key, text_hash], "left")
    df = df.withColumn(lines, base.once(F.split(text, "\n")))
    df = df.withColumn(worded, base.once(F.transform(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    # Places count lines with a word; turn them to places among all lines, then drop those.
    all_lines = F.sequence(F.lit(0), F.size(lines) - 1)
    df = df.withColumn(every, base.once(F.filter(all_lines, lambda i: F.get(worded, i))))
    gone = F.transform(places, lambda p: F.get(every, p))
    kept = F.array_except(all_lines, gone)
    clean = F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i)))
    out = {c: F.col(f"`{c}`") for c in columns}
    name = next(c for c in columns if c.lower() == "text")
    out[name] = F.when(F.col(places).isNull(), F.col("text")).otherwise(clean)
    counts = [
        F.size(every).cast("bigint").alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("bigint").alias("n_removed"),
    ]
    return df.select(*(e.alias(c) for c, e in out.items()), *counts)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
worded AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT a.doc_id, a.place, a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM worded a
  JOIN worded b ON b.doc_id = a.doc_id AND b.place = a.place + 1
  JOIN worded c ON c.doc_id = a.doc_id AND c.place = a.place + 2),
later AS (
  SELECT doc_id, place FROM win
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, place) > 1),
gone AS (
  SELECT DISTINCT doc_id, place + k AS place FROM later, (SELECT unnest([0, 1, 2]) AS k)),
kept AS (
  SELECT l.doc_id, l.pos, l.line FROM l
  WHERE NOT EXISTS (
    SELECT 1 FROM worded w JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place
    WHERE w.doc_id = l.doc_id AND w.pos = l.pos)),
texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  md5(coalesce(t, '')) AS kept_md5
FROM documents d
LEFT JOIN texts USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


@base.register("op10_line_windows", ORACLE)
def op10(spark, sf_dir):
    """Every document's lines, how many go, and a digest of the text that stays."""
    out = remove_lines(base.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(base.text_or_empty()).alias("kept_md5"))
