"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Strings of LENGTH bytes are dealt to buckets by their least anchor, a hashed substring: equal
strings have equal anchors. Neighbouring strings of one text with the same anchor position travel
as one piece. A piece that occurs whole elsewhere is repeated; an anchor with different pieces needs
an index, and gets a run-length index (runindex) whose matching statistics show the rest. Pieces
travel as hashes and places; only pieces that need an index are cut from their texts.

Anchors with more than BUCKET different pieces are dealt anew by a longer anchor, at last by the
whole string, so no index grows with the corpus.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from tickerloom.llm import base, runindex

LENGTH = 400
#: Anchor lengths in 400ths of LENGTH, one level after the other.
ANCHORS = (128, 264, 400)
#: Occurrences of a piece that are looked up together.
HOT = 4096
#: Different pieces of one anchor in one index, and bytes of buckets put in one index together.
BUCKET = 2048
INDEX_BYTES = 1 << 20
#: Start positions of a text looked at together.
STEP = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {}


def _powers(n):
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if n > _POWERS.get("n", 0):
        n = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for name, x in (("up", _B), ("down", inverse)):
            row = np.full(n, x, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(data, m):
    """A 64-bit hash of each substring of m bytes of an array of bytes."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[m:] - total[:-m]) * down[: len(data) - m + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x, w):
    """Least of each w neighbouring values."""
    n = len(x)
    if w == 1:
        return x
    wide = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    wide[:n] = x
    rows = wide.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def pieces(data, m, length=LENGTH):
    """(first, length, anchor, hash) of the pieces of a text of bytes: every string of `length` in one."""
    out = []
    for at in range(0, len(data) - length + 1, STEP):
        part = np.frombuffer(data, np.uint8, min(STEP + length - 1, len(data) - at), at)
        h = gram_hashes(part, m)
        order = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(order, length - m + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        size = np.diff(np.append(first, len(place))) + length - 1
        view, start = memoryview(data), first + at
        d = xxhash.xxh3_64_intdigest
        whole = np.array([d(view[a : a + n]) for a, n in zip(start.tolist(), size.tolist())], np.uint64)
        out.append((start, size, h[place[first]].view(np.int64), whole.view(np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


KEY = "id bigint, hash bigint, base bigint"
KEYS = ["id", "hash", "base"]
STRINGS = f"{KEY}, n bigint, data binary"
PIECES = f"{KEY}, n bigint, first bigint, size bigint, anchor bigint, whole bigint"
SPANS = "id bigint, hash bigint, start bigint, stop bigint"


def _batch(schema, *columns):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _cut(strings, m, length):
    """strings (STRINGS, data compressed) -> their pieces (PIECES)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(4)]
            out, counts, held = [], [], 0
            for at, data in enumerate(batch.column(4)):
                out.append(pieces(unpack(data.as_py()), m, length))
                counts.append(len(out[-1][0]))
                held += counts[-1]
                if held > 1 << 16 or at == len(batch) - 1:
                    own = slice(at + 1 - len(counts), at + 1)
                    repeat = [np.repeat(k[own], counts) for k in keys]
                    yield _batch(PIECES, *repeat, *(np.concatenate(c) for c in zip(*out)))
                    out, counts, held = [], [], 0

    return base.map_arrow(strings, run, PIECES)


def _texts(wanted, strings):
    """wanted (KEYS, first, size, n, anchor) -> with `data`, cut from the strings."""
    own = F.collect_list(F.struct("first", "size", "n", "anchor")).alias("parts")
    both = strings.select(*KEYS, "data").join(wanted.groupBy(*KEYS).agg(own), KEYS)
    schema = f"{KEY}, n bigint, anchor bigint, data binary"

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data = unpack(row["data"])
                for p in row["parts"]:
                    a = p["first"]
                    rows.append((row["id"], row["hash"], row["base"] + a, p["n"], p["anchor"], data[a : a + p["size"]]))
                if len(rows) > 4096:
                    yield _batch(schema, *zip(*rows))
                    rows = []
            if rows:
                yield _batch(schema, *zip(*rows))

    return base.map_arrow(both.select(*KEYS, "data", "parts"), run, schema)


def _indexed(parts, length):
    """parts (KEYS, n, anchor, data), sorted by anchor in each partition -> SPANS of repeated strings."""

    def spans(rows):
        ids, hashes, bases, ns, data = zip(*rows)
        out = []
        for k, hits in enumerate(runindex.RunIndex(list(data)).repeated(length)):
            if ns[k] > 1 or not len(hits):
                continue  # pieces that occur again as a whole are known already
            cut = np.flatnonzero(np.append(True, np.diff(hits) > 1))
            last = np.append(cut[1:], len(hits)) - 1
            out += [(ids[k], hashes[k], bases[k] + a, bases[k] + b + length) for a, b in zip(hits[cut], hits[last])]
        return _batch(SPANS, *(zip(*out) if out else [[]] * 4))

    def run(batches):
        rows, held, anchor = [], 0, None
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(5)]
            for i, h, b, n, a, d in zip(*keys, batch.column(5).to_pylist()):
                if a != anchor and held > INDEX_BYTES:
                    yield spans(rows)
                    rows, held = [], 0
                anchor = a
                rows.append((i, h, b, n, d))
                held += len(d)
        if rows:
            yield spans(rows)

    return base.map_arrow(parts, run, SPANS)


def _level(strings, m, length, last):
    """(spans found, pieces of crowded anchors as strings of the next level or None)."""
    spark = strings.sparkSession
    found = base.settled(_cut(strings, m, length), "pieces")
    anchors = found.groupBy("anchor").agg(F.sum("n").alias("k"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    anchors = anchors.filter("k > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    anchors = base.settled(anchors, "anchors")  # so both sides of the join are split where one is hot
    found = base.settled(found.join(anchors, "anchor"), "repeated")
    distinct = found.groupBy("anchor", "whole", "size", "mixed").agg(
        F.sum("n").alias("total"), F.min(F.struct(*KEYS, "first")).alias("at")
    )
    distinct = base.settled(distinct.select("anchor", "whole", "size", "mixed", "total", "at.*"), "distinct")
    piece = ["anchor", "whole", "size"]
    blocks = F.ceil(F.col("total") / HOT).cast("bigint")
    again = distinct.filter("total > 1").select(*piece, blocks.alias("blocks"))
    hot = base.settled(again.filter("blocks > 1"), "hot")  # dealt to blocks, which meet a copy each
    again = again.select(*piece, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    block = F.pmod(F.xxhash64(*KEYS, "first"), F.coalesce("blocks", F.lit(1).cast("bigint")))
    start = (F.col("base") + F.col("first")).alias("start")
    spans = found.join(hot, piece, "left").withColumn("block", block).join(again, [*piece, "block"], "left_semi")
    spans = spans.select("id", "hash", start, (F.col("base") + F.col("first") + F.col("size")).alias("stop"))

    mixed = distinct.filter("mixed")
    crowded = mixed.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > BUCKET)
    wanted = mixed.select(*KEYS, "first", "size", F.col("total").alias("n"), "anchor")
    crowd = wanted.join(crowded, "anchor", "left_semi")
    if not last:
        wanted = wanted.join(crowded, "anchor", "left_anti")
    parts = _texts(wanted, strings).repartition(base.partitions(spark), "anchor").sortWithinPartitions("anchor")
    spans = spans.union(_indexed(parts, length))
    if last or crowd.isEmpty():
        return spans, None
    packed = _packed(_texts(crowd, strings).select(*KEYS, "n", "data"))
    return spans, base.settled(packed, "crowded")


def _packed(rows):
    """rows (KEYS, n, data: text or bytes) with the data compressed."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data = pa.array([pack(d.as_py()) for d in batch.column(4).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], data], [c.split()[0] for c in STRINGS.split(", ")])

    return base.map_arrow(rows, run, STRINGS)


def repeats(strings, length=LENGTH):
    """strings (STRINGS) -> SPANS: bytes covered by strings of `length` that also start elsewhere."""
    every = []
    anchors = [max(1, a * length // 400) for a in ANCHORS]
    for k, m in enumerate(anchors):
        spans, strings = _level(strings, m, length, k == len(anchors) - 1)
        every.append(spans)
        if strings is None:
            break
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    return out


OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_kept bigint, kept binary"


def _apply(rows, keep):
    """rows (id, no_id, data, spans) -> OUT; `kept` is null unless wanted."""

    def one(data, spans):
        n = len(data)
        if not spans:
            return n, 0, 0, data
        gone = np.zeros(n + 2, np.int64)
        np.add.at(gone, [s["start"] + 1 for s in spans], 1)
        np.add.at(gone, [s["stop"] + 1 for s in spans], -1)
        gone = np.cumsum(gone) > 0
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        parts = [data[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], n])]
        removed = int((edges[1::2] - edges[::2]).sum())
        return n, removed, len(edges) // 2, b"".join(parts)

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n, removed, n_spans, kept = one(unpack(row["data"]), row["spans"])
                doc_id = None if row["n"] else row["id"]
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((doc_id, n, removed, n_spans, digest, len(kept), kept if keep else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return base.map_arrow(rows, run, OUT)


def remove_repeats(docs, length=LENGTH, keep=True):
    """docs (doc_id, text) -> OUT: what stays of each text without bytes that a repeat covers.

    Texts are UTF-8, null is empty, and nothing crosses documents. Every occurrence of a string
    goes, the first one too, and strings are judged on the input. Rows equal in doc_id and text
    repeat each other; doc_id may be null. Texts shorter than `length` stay. `kept` may end inside
    a character and so is binary. Other columns are not looked at. No rows in, no rows out.
    """
    text, no_id = base.text_or_empty(), F.col("doc_id").isNull()
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64(text, no_id).alias("hash"),
        F.lit(0).cast("bigint").alias("base"),
        no_id.cast("bigint").alias("n"),
        text.alias("data"),
    )
    packed = base.settled(_packed(rows), "texts")
    spans = repeats(packed.withColumn("n", F.lit(1).cast("bigint")), length)
    own = F.collect_set(F.struct("start", "stop")).alias("spans")  # rows equal in doc_id and text have the same
    spans = base.settled(spans, "spans").groupBy("id", "hash").agg(own)
    both = packed.join(spans, ["id", "hash"], "left").select("id", "n", "data", "spans")
    return _apply(both, keep)


@base.register("op1_run_index_dedup")
def op1(spark, sf_dir):
    """Every document's removed bytes and a digest of the rest."""
    out = remove_repeats(base.documents(spark, sf_dir), keep=False)
    return out.drop("kept")
