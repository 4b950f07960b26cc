"""Source divergence audit: how the sources of a language differ in their terms.

CountVectorizer, one for each language, makes a sparse count vector of every document over all
terms that `minDF` documents of its language hold. A language with more than VOCABULARY terms has
its terms dealt to several; languages beyond the OWN largest share some, in which a term carries
its language. The vectors are summed by (language, source), sparse as they are. Shares of a group
and of another are compared term by term where either has the term; what all other terms add
follows from counts.
"""

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm import base

MIN_DOCUMENTS = 3
ONE = 1_000_000_000
#: Counts below this times ONE fit 64 bits.
MOST = 9_000_000_000
TOP = 200
#: Different terms that one vectorizer counts, about; its vocabulary passes through the driver.
VOCABULARY = 3 << 19
#: Different terms, about, of the vectorizers that go over the documents together.
TOGETHER = 2 * VOCABULARY
#: Languages with vectorizers of their own.
OWN = 64
#: Sources compared by one task, and cells of groups, about.
TILE = 256
CELLS = 1 << 18
#: Terms that a task holds as text at once.
HELD = 1 << 18
#: Between a term and its language where languages share a vectorizer; no term holds it.
MARK = b"\x00"

_LETTERS = bytes(string.ascii_letters, "ascii") + bytes(range(128, 256))
_TABLE = bytes(c if c in _LETTERS else 32 for c in range(256)).lower()


def terms_of(text):
    """The terms of a UTF-8 text in order: runs of letters, A-Z in lower case."""
    return text.translate(_TABLE).split()


def _plain(docs):
    """(lang, source, group: a number for the two, text), nulls as ''."""
    names = ("lang", "source", "text")
    df = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))
    return df.select("lang", "source", F.xxhash64("lang", "source").alias("group"), "text")


def _lists(found):
    ends = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([t for x in found for t in x], pa.binary()).cast(pa.string()))


def _split(texts):
    """Texts of letters and spaces, none at their ends -> the lists of their terms."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    n = np.diff(lists.offsets.to_numpy())
    n[[not t for t in texts]] = 0  # an empty text is split into one empty term
    values = lists.flatten()
    ends = np.append(0, np.cumsum(n, dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values.filter(pc.not_equal(values, "")))


def thinned(docs, least):
    """docs -> (lang, terms): each document's different terms, but those that `least` documents of
    its language before it in the same batch hold. As many documents have a term as before, or
    at least `least`.
    """

    def run(batches):
        for batch in batches:
            seen, out = {}, []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held = seen.setdefault(lang, {})
                times = held.get
                new = [t for t in set(terms_of(text.as_py())) if times(t, 0) < least]
                for t in new:
                    held[t] = times(t, 0) + 1
                out.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], ["lang", "terms"])

    own = _plain(docs).select("lang", "text")
    return base.settled(base.map_arrow(own, run, "lang string, terms array<string>"), "thinned")


def places(thin):
    """({language: (first column, columns)}, columns of the other languages, terms of each column, about)."""
    terms = thin.select("lang", F.explode("terms").alias("t"))
    n = terms.groupBy("lang").agg(F.approx_count_distinct("t", 0.02).alias("n"))
    n = base.settled(n, "sizes")
    found, sizes = {}, []
    for r in n.orderBy(F.desc("n"), "lang").limit(OWN).collect():
        k = -(-r.n // VOCABULARY)
        found[r.lang] = (len(sizes), k)
        sizes += [r.n // k] * k
    rest = n.filter(~F.col("lang").isin(list(found))).agg(F.sum("n")).first()[0] or 0
    others = -(-rest // VOCABULARY)
    place = (len(sizes), others)
    return found, place, sizes + [rest // max(1, others)] * others


def passes(sizes):
    """Columns that are summed together: their vocabularies are with every task at once."""
    out, held = [], 0
    for k, n in enumerate(sizes):
        if not out or held + n > TOGETHER or len(out[-1]) == 256:
            out.append([])
            held = 0
        out[-1].append(k)
        held += n
    return out


def _column(place, k, term):
    """Whether a term is counted by column k of these."""
    first, n = place
    return F.lit(True) if n == 1 else F.pmod(F.crc32(term), F.lit(n)) == k - first


def dealt(docs, own, others, columns):
    """docs -> (group, t<k> ...): every document's terms in those of the columns that count them."""
    names = [f"t{k}" for k in columns]
    whole = {first for first, k in own.values() if k == 1}  # counted from the text as it is

    def run(batches):
        import zlib

        for batch in batches:
            first_row, held, found = 0, 0, {k: [] for k in columns}
            for row, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()))):
                first, k = own.get(lang, others)
                for j, column in found.items():
                    column.append(b"" if j in whole else ())
                if first in whole and first in found:
                    letters = text.as_py().translate(_TABLE).strip()
                    held += letters.count(b" ") + 1
                    found[first][-1] = letters
                elif any(j in found for j in range(first, first + k)):
                    terms = terms_of(text.as_py())
                    held += len(terms)
                    if lang not in own:
                        end = MARK + lang.encode()
                        terms = [t + end for t in terms]
                    parts = [terms] if k == 1 else [[] for _ in range(k)]
                    for t in terms if k > 1 else ():
                        parts[zlib.crc32(t) % k].append(t)
                    for j, part in enumerate(parts):
                        if first + j in found:
                            found[first + j][-1] = part
                if held > HELD or row == len(batch) - 1:  # few terms at a time
                    groups = batch.column(0).slice(first_row, row + 1 - first_row)
                    lists = [(_split if j in whole else _lists)(column) for j, column in found.items()]
                    yield pa.RecordBatch.from_arrays([groups, *lists], ["group", *names])
                    first_row, held, found = row + 1, 0, {k: [] for k in columns}

    schema = ", ".join(["group bigint", *(f"{c} array<string>" for c in names)])
    return base.map_arrow(_plain(docs).select("group", "lang", "text"), run, schema)


def fitted(thin, place, k, lang, least):
    """(model, vocabulary (key, lang, term)) of column k, over one language or, for None, over
    the rows given with their terms marked.
    """
    spark = thin.sparkSession
    rows = thin if lang is None else thin.filter(F.col("lang") == lang)
    mine = F.filter("terms", lambda t: _column(place, k, t)) if place[1] > 1 else F.col("terms")
    # As many rows as a term needs keep a vocabulary from being empty.
    spare = spark.range(least).select(F.array(F.lit("")).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=(1 << 31) - 1)
    model = counter.fit(rows.select(mine.alias("terms")).union(spare))
    path = base.new_path(spark, "vectorizer")
    model.save(path)
    words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "t")).filter("t <> ''")
    own = F.lit(lang) if lang is not None else F.expr("substring(t, length(term) + 2)")
    words = words.withColumn("term", F.substring_index("t", MARK.decode(), 1) if lang is None else F.col("t"))
    return model, words.select((F.lit(k << 32) + F.col("index")).cast("bigint").alias("key"), own.alias("lang"), "term")


def summed(rows, models):
    """rows (group, t<k> ...), {k: model} -> (group, key, n): sums of the documents' vectors.

    key holds column and index. Each batch is summed before the shuffle.
    """
    for k, model in models.items():
        rows = model.setInputCol(f"t{k}").setOutputCol(f"v{k}").transform(rows).drop(f"t{k}")
        rows = rows.withColumn(f"v{k}", F.unwrap_udt(f"v{k}"))
    parts = [F.col(f"v{k}.{c}").alias(f"{c}{k}") for k in models for c in ("indices", "values")]
    columns = np.array(list(models), np.int64)

    def run(batches):
        for batch in batches:
            groups, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            keys, counts = [], []
            for j in range(len(columns)):
                indices, values = batch.column(1 + 2 * j), batch.column(2 + 2 * j)
                at = np.repeat(own, np.diff(indices.offsets.to_numpy()))
                keys.append(at << 40 | j << 32 | indices.flatten().to_numpy())
                counts.append(values.flatten().to_numpy())
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
            key = columns[found >> 32 & 255] << 32 | found & 0xFFFFFFFF
            cols = [pa.array(groups[found >> 40]), pa.array(key), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, ["group", "key", "n"])

    found = base.map_arrow(rows.select("group", *parts), run, "group bigint, key bigint, n bigint")
    return found.groupBy("group", "key").agg(F.sum("n").alias("n"))


def counted(docs, least=MIN_DOCUMENTS):
    """(vocabulary (key, lang, term), cells (group, key, n), groups (group, lang, source))."""
    thin = thinned(docs, least)
    own, others, sizes = places(thin)
    marked = thin.filter(~F.col("lang").isin(list(own)))
    marked = marked.select(F.transform("terms", lambda t: F.concat(t, F.lit(MARK.decode()), "lang")).alias("terms"))
    lang_of = {first + j: (lang, (first, n)) for lang, (first, n) in own.items() for j in range(n)}
    spark = docs.sparkSession
    words = spark.createDataFrame([], "key bigint, lang string, term string")
    cells = spark.createDataFrame([], "group bigint, key bigint, n bigint")
    for columns in passes(sizes):
        models = {}
        for k in columns:
            lang, place = lang_of.get(k, (None, others))
            models[k], found = fitted(marked if lang is None else thin, place, k, lang, least)
            words = words.union(found)
        cells = cells.union(summed(dealt(docs, own, others, columns), models))
    groups = _plain(docs).select("group", "lang", "source").distinct()
    return base.settled(words, "vocabulary"), base.settled(cells, "cells"), groups


def share(count, total, terms):
    """1 + floor(ONE * (count + 1) / (total + terms)), exact: the product has up to 31 digits."""
    small = f"({ONE}L * ({count} + 1)) div ({total} + {terms})"
    large = f"({ONE} * cast({count} + 1 as decimal(20,0))) div ({total} + {terms})"
    return F.expr(f"1 + if({count} < {MOST}, {small}, {large})")


def gap(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _gap(p, q):
    return (p - q) ** 2 // q


def compared(s, first, cells):
    """s, first: source numbers of two tiles and the shares of an unseen term; cells: (term, source
    number, share) in order of term. The sums of gaps over all terms that either source of a pair
    has, less those of an unseen term for each term counted: see `pairs`.
    """
    term, who, p = cells
    m, who = len(s), np.searchsorted(s, who)
    out, other = np.zeros((m, m), np.int64), np.zeros((m, m), np.int64)
    order = np.lexsort((p, who))
    i, x = who[order], p[order]
    new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (x[1:] != x[:-1]))) if len(i) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(i)))
    for at in range(0, len(new), 4096):  # each share against every source that lacks the term
        k, n = new[at : at + 4096], times[at : at + 4096, None]
        np.add.at(out, i[k], _gap(x[k, None], first[None]) * n)
        np.add.at(other, i[k], _gap(first[None], x[k, None]) * n)
    out += other.T
    flat, ends = out.reshape(-1), np.searchsorted(term, term, "right")
    left, k = np.arange(len(term)), 1
    while len(left := left[left + k < ends[left]]):  # pairs that both have the term
        for a, b in ((left, left + k), (left + k, left)):
            i, j = who[a], who[b]
            both = _gap(p[a], p[b]) - _gap(p[a], first[j]) - _gap(first[i], p[b]) + _gap(first[i], first[j])
            np.add.at(flat, i * m + j, both)
        k += 1
    return out


def _pair_sums(table, tile):
    """One task's cells of the sources of two tiles -> (lang_no, i, j, value) of their pairs."""
    term, s, p = (table.column(c).to_numpy() for c in ("term", "s", "p"))
    group = np.flatnonzero(term < 0)
    group = group[np.argsort(s[group])]
    order = np.flatnonzero(term >= 0)
    order = order[np.argsort(term[order], kind="stable")]
    found = compared(s[group], p[group], (term[order], s[order], p[order]))
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    i, j = np.nonzero(~np.eye(len(group), dtype=bool))
    tiles = s[group] // tile
    keep = (tiles[i] != tiles[j]) | (a == b)
    i, j = i[keep], j[keep]
    lang = np.full(len(i), table.column("lang_no")[0].as_py(), np.int64)
    cols = [pa.array(lang), pa.array(s[group][i]), pa.array(s[group][j]), pa.array(found[i, j])]
    return pa.Table.from_arrays(cols, ["lang_no", "i", "j", "value"])


def pairs(cells, groups):
    """cells (lang_no, s, key, p), groups (lang_no, s, first, n, terms) -> (lang_no, i, j, value).

    Sources of a language are compared by tiles of TILE, each two tiles by as many tasks as their
    cells need. value: gaps of all terms of the vocabulary, i against j.
    """
    n = max(1, -(-cells.count() // CELLS))
    last = F.expr(f"cast((max(s) over (partition by lang_no)) div {TILE} as int)")
    groups = groups.withColumn("last", last)
    cells = cells.join(groups.select("lang_no", "s", "last"), ["lang_no", "s"])
    cells = cells.select("lang_no", "s", "last", F.col("key").alias("term"), "p", F.pmod(F.xxhash64("key"), F.lit(n)).alias("part"))
    whole = groups.select("lang_no", "s", "last", F.lit(-1).cast("bigint").alias("term"), F.col("first").alias("p"))
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    rows = cells.unionByName(whole).withColumn("tile", F.expr(f"cast(s div {TILE} as int)"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.select("part", "lang_no", F.least("tile", "t").alias("a"), F.greatest("tile", "t").alias("b"), "term", "s", "p")
    base.reachable(rows.sparkSession)
    tile, schema = TILE, "lang_no bigint, i bigint, j bigint, value bigint"
    found = rows.groupBy("part", "lang_no", "a", "b").applyInArrow(lambda table: _pair_sums(table, tile), schema)
    found = found.groupBy("lang_no", "i", "j").agg(F.sum("value").alias("value"))
    a = groups.select("lang_no", F.col("s").alias("i"), F.col("first").alias("p"), F.col("n").alias("n1"), "terms")
    b = groups.select("lang_no", F.col("s").alias("j"), F.col("first").alias("q"), F.col("n").alias("n2"))
    found = found.join(a, ["lang_no", "i"]).join(b, ["lang_no", "j"])
    rest = (F.col("terms") - F.col("n1") - F.col("n2")) * gap("p", "q")
    value = F.when(F.col("terms") == 0, F.lit(0).cast("bigint")).otherwise(F.col("value") + rest)
    return found.select("lang_no", "i", "j", value.alias("value"))


def audit(docs, least=MIN_DOCUMENTS, top=TOP):
    """docs (text, lang, source) -> (lang, source, part, item, value, rank).

    Part 'pair': every other source of the language, by how far its shares of terms are from the
    group's. Part 'term': the terms the group holds more often than its language, `top` at most.
    Terms are runs of letters (A-Z in lower case; all beyond ASCII counts as letter) that `least`
    documents of the language hold. Null text, lang and source are ''. Repeated rows are documents
    of their own; doc_ids do not matter. Ties go by the item's UTF-8. A language without terms gives
    pairs of value 0; one with a single source gives none. No rows give no rows; other columns are
    not looked at.
    """
    words, cells, groups = counted(docs, least)
    terms = words.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = cells.groupBy("group").agg(F.sum("n").alias("total"), F.count("*").alias("n"))
    groups = groups.join(sums, "group", "left").join(terms, "lang", "left").fillna(0, ["total", "n", "terms"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("bigint") - 1
    groups = groups.withColumn("s", number)
    first = F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(1).cast("bigint"))
    groups = groups.withColumn("first", first)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    langs = base.settled(langs.withColumn("lang_no", F.monotonically_increasing_id()), "langs")
    groups = base.settled(groups.join(langs, "lang"), "groups")

    cells = cells.join(groups.select("group", "lang_no", "s", "total", "lang_total", "terms"), "group")
    cells = cells.withColumn("p", share("n", "total", "terms"))
    cells = cells.withColumn("m", F.sum("n").over(W.partitionBy("key")))
    cells = cells.withColumn("q", share("m", "lang_total", "terms"))
    cells = base.settled(cells.select("lang_no", "s", "key", "p", "q"), "shares")

    near = pairs(cells.select("lang_no", "s", "key", "p"), groups)
    names = groups.select("lang_no", "s", "source")
    near = near.join(groups.select("lang_no", F.col("s").alias("i"), "lang", "source"), ["lang_no", "i"])
    near = near.join(names.toDF("lang_no", "j", "item"), ["lang_no", "j"])
    near = near.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    more = cells.filter("p > q").select("lang_no", "s", "key", gap("p", "q").alias("value"))
    more = more.join(words.select("key", "term"), "key").join(groups.select("lang_no", "s", "lang", "source"), ["lang_no", "s"])
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    more = more.withColumn("rank", rank).filter(F.col("rank") <= top)
    return near.withColumn("rank", rank).unionByName(more)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1))
      // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM grid JOIN v USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@base.register("op11_source_divergence", ORACLE)
def op11(spark, sf_dir):
    """How far each source of a language is from the others, and the terms that set it apart."""
    return audit(base.documents(spark, sf_dir))
