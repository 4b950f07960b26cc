"""URL filters by a temporal join: captures against the list entries active when they were fetched.

List entries are dated. Each entry holds from its day until the day of its pattern's next entry, so
a pattern's entries become validity intervals. A pattern is a host; it covers its subdomains too,
and the longest pattern with an active entry decides. A capture is judged as of its fetch day.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm import base

#: Days of one bucket of the interval join: both sides are dealt by (pattern, bucket).
BUCKET_DAYS = 32


def host(url):
    """Lower-case host of an absolute URL, without user, port and final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    found = F.regexp_replace(found, r"\.$", "")
    return F.when(found != "", found)


def suffixes(name):
    """All suffixes of a host at dots, the host itself first."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries):
    """entries (pattern, since: date, action) -> (pattern, first, until, action); days since 1970.

    Entries of a pattern and day are one: 'block' if any of them says so. So a pattern has a row
    per day at most before it is sorted, however often lists repeat it. Entries with a null
    pattern, day or action say nothing. The last interval of a pattern has a null `until`.
    """
    day = F.unix_date(F.col("since").cast("date"))
    one = entries.select(F.lower("pattern").alias("pattern"), day.alias("first"), "action").dropna()
    one = one.groupBy("pattern", "first").agg(F.max(F.col("action") == "block").alias("blocks"))
    until = F.lead("first").over(W.partitionBy("pattern").orderBy("first"))
    action = F.when(F.col("blocks"), "block").otherwise("allow").alias("action")
    return one.select("pattern", "first", until.alias("until"), action)


def _verdicts(seen, entries):
    """seen (host, day), distinct -> (host, day, pattern, listed_since, action) where an entry decides."""
    spans = intervals(entries)
    last = F.lit(seen.agg(F.max("day")).first()[0]).cast("int")  # no capture asks about later days
    spans = spans.filter(F.col("first") <= last)
    end = F.least(F.coalesce(F.col("until") - 1, last), last)
    bucket = lambda c: F.floor(c / BUCKET_DAYS)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(end))))
    asked = seen.select("host", "day", F.posexplode(suffixes(F.col("host"))).alias("level", "pattern"))
    asked = asked.withColumn("bucket", bucket(F.col("day")))
    hits = asked.join(spans, ["pattern", "bucket"])
    hits = hits.filter("first <= day AND (until IS NULL OR day < until)")
    best = hits.groupBy("host", "day").agg(
        F.min_by("pattern", "level").alias("pattern"),
        F.min_by("first", "level").alias("first"),
        F.min_by("action", "level").alias("action"),
    )
    return best.select("host", "day", "pattern", F.date_from_unix_date("first").alias("listed_since"), "action")


def filter_captures(captures, entries):
    """captures (url, fetched: date) with host, pattern, listed_since, action and kept.

    Verdicts are made once per host and day, so a host with a third of all captures costs no more
    than its days. A capture without a host or fetch day, or that no active entry covers, is kept.
    Repeated captures are judged alike; an empty list keeps all. Columns of captures with the
    names of the results are replaced.
    """
    name, day = base.free_name(captures, "_host"), base.free_name(captures, "_day")
    new = ("host", "pattern", "listed_since", "action", "kept")
    own = [c for c in captures.columns if c.lower() not in new]
    df = captures.withColumn(name, host(F.col("url").cast("string")))
    df = df.withColumn(day, F.unix_date(F.col("fetched").cast("date")))
    seen = df.select(F.col(name).alias("host"), F.col(day).alias("day")).dropna().distinct()
    fresh = {c: base.free_name(captures, f"_{c}_") for c in ("pattern", "listed_since", "action")}
    found = _verdicts(seen, entries).withColumnsRenamed({"host": name, "day": day, **fresh})
    df = df.select(*(F.col(f"`{c}`") for c in own), name, day).join(found, [name, day], "left")
    kept = F.coalesce(F.col(fresh["action"]) != "block", F.lit(True))
    return df.select(
        *(F.col(f"`{c}`") for c in own),
        F.col(name).alias("host"),
        *(F.col(f).alias(c) for c, f in fresh.items()),
        kept.alias("kept"),
    )


def derived_tables(spark, sf_dir):
    """Captures and list entries over `pages`: fetch days from ids, entries from hosts' digests.

    Every host has up to three dated entries, and every host's parent domain up to two.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    captures = pages.withColumn("fetched", fetched)
    hosts = pages.select(host(F.col("url")).alias("h")).dropna().distinct()
    parents = hosts.select(F.regexp_replace("h", r"^[^.]+\.", "").alias("h")).filter(F.col("h").contains(".")).distinct()
    both = hosts.select("h", F.lit(3).alias("most")).union(parents.select("h", F.lit(2)))
    digest = F.md5(F.concat_ws("|", "h", F.col("k").cast("string")))
    code = lambda i: F.ascii(F.substring(digest, i, 1))
    both = both.select("h", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("k"))
    both = both.filter(code(1) % 3 != 0)
    offset = (code(2) * 31 + code(3) * 7 + code(4)) % 366
    entries = both.select(
        F.col("h").alias("pattern"),
        F.date_add(F.lit("2024-01-01").cast("date"), offset).alias("since"),
        F.when(code(5) % 2 == 0, "block").otherwise("allow").alias("action"),
    )
    return captures, entries


ORACLE = r"""
WITH captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched,
    nullif(regexp_replace(lower(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS h FROM captures WHERE host IS NOT NULL),
parents AS (
  SELECT DISTINCT regexp_replace(h, '^[^.]+\.', '') AS h FROM hosts
  WHERE contains(regexp_replace(h, '^[^.]+\.', ''), '.')),
numbered AS (
  SELECT h, unnest([1, 2, 3]) AS k FROM hosts UNION ALL SELECT h, unnest([1, 2]) FROM parents),
digests AS (SELECT h, md5(h || '|' || k) AS d FROM numbered),
entries AS (
  SELECT h AS pattern,
    DATE '2024-01-01' + CAST((ascii(d[2]) * 31 + ascii(d[3]) * 7 + ascii(d[4])) % 366 AS INTEGER) AS since,
    ascii(d[5]) % 2 = 0 AS blocks
  FROM digests WHERE ascii(d[1]) % 3 <> 0),
days AS (SELECT pattern, since, bool_or(blocks) AS blocks FROM entries GROUP BY pattern, since),
hits AS (
  SELECT c.page_id, e.pattern, e.since, e.blocks,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(e.pattern) DESC, e.since DESC) AS k
  FROM captures c JOIN days e
    ON e.since <= c.fetched AND (c.host = e.pattern OR ends_with(c.host, '.' || e.pattern)))
SELECT c.page_id, CAST(c.fetched AS VARCHAR) AS fetched, c.host, h.pattern,
  CAST(h.since AS VARCHAR) AS listed_since,
  CASE WHEN h.blocks THEN 'block' WHEN NOT h.blocks THEN 'allow' END AS action,
  NOT coalesce(h.blocks, FALSE) AS kept
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.k = 1
"""


@base.register("op7_url_lists_as_of", ORACLE)
def op7(spark, sf_dir):
    """Every capture with the list entry that decides on its fetch day."""
    out = filter_captures(*derived_tables(spark, sf_dir))
    day = lambda c: F.col(c).cast("string").alias(c)
    return out.select("page_id", day("fetched"), "host", "pattern", day("listed_since"), "action", "kept")
