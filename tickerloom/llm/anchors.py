"""Substring dedup by fixed-block anchors.

A repeated window of WINDOW words holds one whole block of BLOCK words of any text that is cut into
such blocks from its start on. So blocks that do not overlap are the index, every rolling window of
BLOCK words is a probe, and each hit is extended over the windows around it, which are compared as
a whole. Neighbouring windows that are found again join to maximal repeats.

Texts travel in slices of some million words. A slice sends each distinct block or probe once,
packed by buckets of the hash, with its least and largest doc_id: a passage that a third of all
documents hold is one entry a slice. A bucket answers the slices with the entries that meet.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from tickerloom.llm import base

WINDOW = 13
#: Words of a slice (a longer text is a slice of its own) and entries of a bucket, about.
SLICE_WORDS = 1 << 20
BUCKET = 1 << 21
#: Bits that bucket entries keep of a block's hash; whole windows are compared by 128.
ANCHOR_BITS = 52

_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_NONE = np.iinfo(np.int64).max

SLICES = "slice bigint, words bigint, docs binary, data binary"
ENTRIES = "bucket bigint, slice bigint, data binary"
ANSWERS = "slice bigint, data binary"


def block_words(window=WINDOW):
    """The longest block of which every window holds a whole one."""
    return (window + 1) // 2


def _pack(*columns):
    raw = [np.ascontiguousarray(c, np.int64 if c.dtype != np.uint64 else np.uint64).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(data, k):
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
    return flat.reshape(k, -1)


def _bytes_by_place(x):
    """Integers as their lowest bytes of all, then the next ones, ...: high bytes repeat and pack well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _shrunk(h, lo, hi):
    """Entries in order of h: differences of the hashes, and ids as places in a list of them."""
    ids = np.unique(np.concatenate([lo[lo != _NONE], hi]))
    places = np.searchsorted(ids, hi), np.where(lo == _NONE, 0, np.searchsorted(ids, lo) + 1)
    columns = np.diff(h, prepend=np.uint64(0)), *(p.astype(np.int64) for p in places)
    head = np.array([len(h), len(ids)], np.int64).tobytes() + ids.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_bytes_by_place, columns)))


def _grown(data):
    """(h, lo, hi) of _shrunk."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, k = np.frombuffer(data, np.int64, 2)
    ids = np.append(np.frombuffer(data, np.int64, k, 16), _NONE)
    rows = np.frombuffer(data, np.uint8, offset=16 + 8 * k).reshape(3, 8, n)
    h, hi, lo = (np.ascontiguousarray(r.T).view(np.int64).ravel() for r in rows)
    return np.cumsum(h.view(np.uint64), dtype=np.uint64), np.append(_NONE, ids)[lo], ids[hi]


def rolled(words, n, factor):
    """A 64-bit hash of each n neighbouring values of words (uint64), mixed."""
    m = len(words) - n + 1
    out = np.zeros(max(0, m), np.uint64)
    for k in range(n if m > 0 else 0):
        out *= np.uint64(factor)
        out += words[k : k + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class Slice:
    """The texts of a slice: words, their hashes, where documents start, and their ids."""

    def __init__(self, docs, data):
        self.ids, self.sizes, self.missing = _unpack(docs, 3)
        self.words = zstandard.ZstdDecompressor().decompress(data).split()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def windows(self, n):
        """(places where n words of one document start, the document of each)."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(doc))
        ok = at + n <= self.ends[doc]
        return at[ok], doc[ok]

    def anchors(self, n, bits):
        """(hash of so many bits, document, whether it is a block, place) of every n neighbouring words."""
        at, doc = self.windows(n)
        h = rolled(self.hashes, n, _A)[at] >> np.uint64(64 - bits)
        return h, doc, (at - self.starts[doc]) % n == 0, at


def slices(docs):
    """docs (doc_id, text) as SLICES; nulls are empty texts, and null ids count as the largest."""

    def row(held, at, k):
        ids, words = zip(*held)
        sizes = np.array([len(w) for w in words], np.int64)
        missing = np.array([i is None for i in ids], np.int64)
        own = np.array([_NONE if i is None else i for i in ids], np.int64)
        data = zstandard.ZstdCompressor(level=3).compress(b" ".join(b" ".join(w) for w in words if w))
        cols = [[(at << 40) + k], [int(sizes.sum())], [_pack(own, sizes, missing)], [data]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["slice", "words", "docs", "data"])

    def run(batches):
        at, k, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held.append((i, text.as_py().split()))
                n += len(held[-1][1]) + 1
                if n > SLICE_WORDS:
                    yield row(held, at, k)
                    k, held, n = k + 1, [], 0
        if held:
            yield row(held, at, k)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.map_arrow(own, run, SLICES)


def _dealt(key, slice_id, buckets, pack):
    """One row for each bucket of sorted keys: pack(from, to) of its entries."""
    number = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(buckets + 1))
    found = np.flatnonzero(np.diff(cuts))
    data = [pack(order[cuts[b] : cuts[b + 1]]) for b in found]
    cols = [pa.array(found.astype(np.int64)), pa.array(np.full(len(found), slice_id, np.int64)), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "slice", "data"])


def _ends(order, cuts, lo, hi):
    """Least lo and largest hi of each group of entries."""
    return np.minimum.reduceat(lo[order], cuts), np.maximum.reduceat(hi[order], cuts)


def _row(batch, k):
    return batch.slice(k, 1).to_pylist()[0]


def _probes(kept, buckets, block):
    """SLICES -> ENTRIES of blocks and probes."""

    def run(batches):
        for batch in batches:
            for row in map(_row, [batch] * batch.num_rows, range(batch.num_rows)):
                s = Slice(row["docs"], row["data"])
                h, doc, is_block, _ = s.anchors(block, ANCHOR_BITS)
                if not len(h):
                    continue
                order = np.argsort(h)
                cuts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                lo, hi = _ends(order, cuts, np.where(is_block, s.ids[doc], _NONE), s.ids[doc])
                key = h[order][cuts]
                yield _dealt(key, row["slice"], buckets, lambda k: _shrunk(key[k], lo[k], hi[k]))

    return base.map_arrow(kept, run, ENTRIES)


def _answers(slice_of, wanted, *columns):
    """ANSWERS: of each slice its wanted entries."""
    order = np.flatnonzero(wanted)
    order = order[np.argsort(slice_of[order], kind="stable")]
    own = slice_of[order]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
    data = [_pack(*(c[k] for c in columns)) for k in np.split(order, cuts[1:])] if len(own) else []
    cols = [pa.array(own[cuts] if len(own) else [], pa.int64()), pa.array(data, pa.binary())]
    return pa.Table.from_arrays(cols, ["slice", "data"])


def _met(entries):
    """ENTRIES of blocks and probes -> ANSWERS (hash, least block, largest probe) of those that meet:
    a block of a lesser document than a probe.
    """

    def run(table):
        parts = [_grown(d) for d in table.column("data").to_pylist()]
        slice_of = np.repeat(table.column("slice").to_numpy(), [len(p[0]) for p in parts])
        h, lo, hi = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        first, last = _ends(order, np.flatnonzero(new), lo, hi)
        group = np.cumsum(new) - 1
        h, lo, hi, slice_of = h[order], lo[order], hi[order], slice_of[order]
        first, last = first[group], last[group]
        return _answers(slice_of, (first < hi) | (lo < last), h, first, last)

    return entries.groupBy("bucket").applyInArrow(run, ANSWERS)


def _whole(h, answers, k):
    """Of answers (h, ...) the row at which each value of h is found, and whether it is."""
    found = np.concatenate([_unpack(d, k) for d in answers], axis=1) if len(answers) else np.zeros((k, 0), np.int64)
    keys = found[0].view(np.uint64)
    found = found[:, np.argsort(keys)]
    keys = np.ascontiguousarray(found[0]).view(np.uint64)
    if not len(keys):
        return found, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return found, at, keys[at] == h


def _extended(kept, answers, buckets, window):
    """SLICES and ANSWERS of their hits -> ENTRIES of the windows around them (a, b, least id where it
    holds a block that is asked for, largest id where it holds a hit).
    """
    block = block_words(window)

    def run(left, right):
        out = []
        for row in left.to_pylist() if right.num_rows else []:
            s = Slice(row["docs"], row["data"])
            h, doc, is_block, at = s.anchors(block, ANCHOR_BITS)
            found, place, ok = _whole(h, right.column("data").to_pylist(), 3)
            at, place, is_block, mine = at[ok], place[ok], is_block[ok], s.ids[doc[ok]]
            marks = []
            for hit in (is_block & (mine < found[2][place]), found[1][place] < mine):
                near = np.zeros(len(s.words) + 1, np.int64)
                np.add.at(near, np.maximum(at[hit] - (window - block), 0), 1)
                np.add.at(near, at[hit] + 1, -1)
                marks.append(np.cumsum(near)[:-1] > 0)
            at, doc = s.windows(window)
            some = marks[0][at] | marks[1][at]
            at, doc = at[some], doc[some]
            a, b = (rolled(s.hashes, window, x)[at] for x in (_A, _B))
            lo = np.where(marks[0][at], s.ids[doc], _NONE)
            hi = np.where(marks[1][at], s.ids[doc], -_NONE)
            order = np.lexsort((b, a))
            new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
            if not len(at):
                continue
            lo, hi = _ends(order, np.flatnonzero(new), lo, hi)
            a, b = a[order][new], b[order][new]
            pack = lambda k: _pack(a[k].view(np.int64), b[k].view(np.int64), lo[k], hi[k])
            out.append(_dealt(a, row["slice"], buckets, pack))
        if out:
            return pa.Table.from_batches(out)
        names = ["bucket", "slice", "data"]
        return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names)

    return kept.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, ENTRIES)


def _verified(entries):
    """ENTRIES of windows -> ANSWERS (a, b, least id) of those that start in a lesser document too."""

    def run(table):
        parts = [_unpack(d, 4) for d in table.column("data").to_pylist()]
        slice_of = np.repeat(table.column("slice").to_numpy(), [p.shape[1] for p in parts])
        a, b, lo, hi = np.concatenate(parts, axis=1)
        order = np.lexsort((b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        first, _ = _ends(order, np.flatnonzero(new), lo, hi)
        first = first[np.cumsum(new) - 1]
        return _answers(slice_of[order], first < hi[order], a[order], b[order], first)

    return entries.groupBy("bucket").applyInArrow(run, ANSWERS)


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_kept bigint, n_spans bigint, kept binary"


def _removed(kept, answers, window, keep):
    """SLICES and ANSWERS of their repeated windows -> OUT."""

    def run(left, right):
        rows = []
        for row in left.to_pylist():
            s = Slice(row["docs"], row["data"])
            gone = np.zeros(len(s.words) + 1, np.int64)
            if right.num_rows:
                at, doc = s.windows(window)
                a, b = (rolled(s.hashes, window, x)[at] for x in (_A, _B))
                found = np.concatenate([_unpack(d, 3) for d in right.column("data").to_pylist()], axis=1)
                found = found[:, np.argsort(found[0].view(np.uint64))]
                # Windows with the same a are few; look through the rows from its first one on.
                first = np.ascontiguousarray(found[0]).view(np.uint64)
                place = np.searchsorted(first, a)
                hit = np.zeros(len(a), bool)
                left_over = np.arange(len(a))
                while len(left_over):
                    here = place[left_over]
                    ok = here < len(first)
                    ok[ok] = first[here[ok]] == a[left_over[ok]]
                    left_over, here = left_over[ok], here[ok]
                    same = found[1].view(np.uint64)[here] == b[left_over] if len(here) else np.zeros(0, bool)
                    hit[left_over[same]] = found[2][here[same]] < s.ids[doc[left_over[same]]]
                    left_over = left_over[~same]
                    place[left_over] += 1
                np.add.at(gone, at[hit], 1)
                np.add.at(gone, at[hit] + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, a, b, no in zip(s.ids.tolist(), s.starts.tolist(), s.ends.tolist(), s.missing.tolist()):
                mine = gone[a:b]
                words = s.words[a:b]
                n = int(mine.sum())
                stay = b" ".join(words if not n else [w for w, g in zip(words, mine.tolist()) if not g])
                spans = int(mine[:1].sum()) + int((mine[1:] & ~mine[:-1]).sum())
                digest = hashlib.sha256(stay).hexdigest()
                rows.append((None if no else i, b - a, n, digest, b - a - n, spans, stay if keep else None))
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return kept.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, OUT)


def remove_repeats(docs, window=WINDOW, keep=True):
    """docs (doc_id, text) -> OUT: the words that stay when repeats of lesser documents go.

    A word goes if a window of so many words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input and do not cross documents. `kept` holds the
    words that stay, joined by one space. Null and empty texts have no words. Null doc_ids count as
    the largest one, and rows of equal doc_id do not repeat each other. One row per row of docs;
    other columns are not looked at. Blocks and windows are known by hashes (windows by 128 bits).
    """
    base.reachable(docs.sparkSession)
    kept = base.settled(slices(docs), "slices")
    total = kept.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    hits = base.settled(_met(_probes(kept, buckets, block_words(window))), "hits")
    windows = _extended(kept, hits, buckets, window)
    return _removed(kept, base.settled(_verified(windows), "repeated"), window, keep)


@base.register("op12_fixed_block_anchors")
def op12(spark, sf_dir):
    """Every document's removed words and a digest of the rest."""
    return remove_repeats(base.documents(spark, sf_dir), keep=False).drop("kept")
