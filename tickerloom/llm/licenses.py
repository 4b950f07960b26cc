"""License scans: MinHash bands over overlapping windows of shingles, verified by containment.

A template of n shingles is looked for by windows of w shingles, w the largest power of two up to
two thirds of n, a window every w/2. So wherever the template stands, some window lies inside it.
Windows of a document and of the templates meet where a band of their MinHash values is equal: with
BANDS bands of ROWS values, windows of similarity 0.8 meet with probability 1 - (1 - 0.8^2)^6, over
0.997, and equal windows always. A met template is verified by its shingles that the document has.

Everything is built-in functions in one projection of the documents. Templates are a bounded
parameter: their band values become literals, so documents are not shuffled to find candidates,
and what does travel is one row per document and template met.
"""

from pyspark.sql import functions as F

from tickerloom.llm import base

SHINGLE = 5
CONTAINED = 0.8
BANDS, ROWS = 6, 2
#: A scan takes at most this many shingles of templates, all templates together.
MOST_SHINGLES = 20_000

# Notices that are looked for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
    " file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met",
}


def _words(text):
    """Lower-case words without the punctuation that notices vary in."""
    return base.words(F.lower(F.regexp_replace(text, r"[.,;:()\"']+", " ")))


def _shingles(words, make):
    """make(five words) at every place of an array of words; none where there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    each = F.transform(places, lambda i: make(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def _window(n):
    """Shingles of the windows that a template of n shingles is looked for by."""
    return 1 << max(0, (2 * n // 3).bit_length() - 1)


def _band_keys(hashes, w, step):
    """Band values of all windows of w shingles, `step` apart, the last one at the end."""
    if w == 1:  # the least of one value is that value
        return F.transform(hashes, lambda x: F.xxhash64(F.lit(1), x))
    last = F.size(hashes) - w
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))

    def keys(s):
        own = F.slice(hashes, s + 1, w)
        least = lambda k: F.array_min(F.transform(own, lambda x: F.xxhash64(x, F.lit(k))))
        bands = [[least(b * ROWS + r) for r in range(ROWS)] for b in range(BANDS)]
        return F.array(*(F.xxhash64(F.lit(w), F.lit(b), *values) for b, values in enumerate(bands)))

    every = F.flatten(F.transform(starts, keys))
    return F.when(F.size(hashes) >= w, every).otherwise(F.array().cast("array<bigint>"))


def _index(spark, templates):
    """[(name, shingles, hashes, window, band keys)] of {name: text}; bounded by MOST_SHINGLES."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    rows = rows.withColumn("w", _words(F.col("text")))
    rows = rows.select("name", F.array_distinct(_shingles(F.col("w"), F.xxhash64)).alias("h"))
    hashes = {r.name: r.h for r in rows.collect()}
    if short := [n for n, h in hashes.items() if not h]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    if sum(map(len, hashes.values())) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles")
    windows = {n: _window(len(h)) for n, h in hashes.items()}
    out = []
    for w in sorted(set(windows.values())):
        own = [(n, hashes[n]) for n in hashes if windows[n] == w]
        frame = spark.createDataFrame(own, "name string, h array<bigint>")
        for r in frame.select("name", "h", _band_keys(F.col("h"), w, 1).alias("keys")).collect():
            out.append((r["name"], r["h"], w, sorted(set(r["keys"]))))
    return out


def scan(docs, templates=None, contained=CONTAINED):
    """docs (doc_id, text) -> (doc_id, template, shared, shingles, containment) of each match.

    `shared` of a template's `shingles` are in the document, at least `contained` of them. Null
    and short texts match nothing; rows equal in doc_id and text give one row per template; null
    doc_ids are kept. Other columns are not looked at. No templates or rows, no matches.
    """
    spark = docs.sparkSession
    index = _index(spark, TEMPLATES if templates is None else templates)
    known = sorted({h for t in index for h in t[1]})
    df = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(base.text_or_empty()).alias("hash"),
        base.once(_words(F.col("text").cast("string"))).alias("words"),
    )
    df = df.withColumn("h", base.once(_shingles(F.col("words"), F.xxhash64)))
    # A document without a single shingle of a template contains none: no need of its windows.
    df = df.filter(F.exists("h", lambda x: x.isin(known))) if known else df.limit(0)
    found = F.array().cast("array<bigint>")
    for w in sorted({t[2] for t in index}):
        keys = sorted({k for t in index if t[2] == w for k in t[3]})
        mine = F.filter(_band_keys(F.col("h"), w, max(1, w // 2)), lambda k: k.isin(keys))  # noqa: B023
        found = F.concat(found, mine)
    own = F.array_intersect("h", F.array(*map(F.lit, known)) if known else F.array().cast("array<bigint>"))
    df = df.select("doc_id", "hash", base.once(F.array_distinct(found)).alias("keys"), base.once(own).alias("own"))
    df = df.select("doc_id", "hash", F.explode("keys").alias("key"), "own")
    rows = [(k, n, h) for n, h, _, keys in index for k in keys]
    bands = spark.createDataFrame(rows, "key bigint, template string, of array<bigint>")
    met = df.join(bands, "key").select(
        "doc_id",
        "hash",
        "template",
        F.size("of").cast("bigint").alias("shingles"),
        F.size(F.array_intersect("of", "own")).cast("bigint").alias("shared"),
    )
    met = met.filter(F.col("shared") >= contained * F.col("shingles")).distinct()
    share = F.round(F.col("shared") / F.col("shingles"), 6).alias("containment")
    return met.select("doc_id", "template", "shared", "shingles", share)


def _oracle():
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    words = """list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[.,;:()"'']+', ' ', 'g')),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""
    return f"""
WITH templates(template, text) AS (VALUES {rows}),
tw AS (SELECT template, {words} AS w FROM templates),
ts AS (
  SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
dw AS (SELECT doc_id, {words} AS w FROM documents),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
n AS (SELECT template, count(*) AS shingles FROM ts GROUP BY template),
m AS (SELECT doc_id, template, count(*) AS shared FROM ds JOIN ts USING (s) GROUP BY doc_id, template)
SELECT doc_id, template, CAST(shared AS BIGINT) AS shared, CAST(shingles AS BIGINT) AS shingles,
  round(shared / shingles, 6) AS containment
FROM m JOIN n USING (template) WHERE shared >= 0.8 * shingles
"""


@base.register("op8_license_minhash", _oracle())
def op8(spark, sf_dir):
    """Every document's license notices."""
    return scan(base.documents(spark, sf_dir))
