"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into as few segments as leave one with at most one differing bit
whenever two fingerprints differ in `bits` or fewer. Each segment is indexed once per bit with that
bit left out: two segments that differ in at most one bit share such a variant. Variants are joined
by equality and all bits of the pairs verified.

The index is over distinct fingerprints, so copies cost nothing, and a bucket (all fingerprints
that share a variant) gives links that connect it, not its pairs. Buckets beyond BLOCK members are
cut to blocks, and every two blocks are verified by a task of their own.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm import base, components

SHINGLE = 4
BITS = 4
SEED = 42
BLOCK = 4096
#: Buckets of at most this many members are verified pair by pair.
FEW = 32
SLICE = 1 << 16


def shingle_hashes(data, n):
    """XXH64 of each shingle of n words of a UTF-8 text, A-Z in lower case."""
    found = data.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(found)] if len(found) <= n else map(b" ".join, zip(*(found[k:] for k in range(n))))
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in parts], np.uint64)


def _majority(hashes):
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data, n=SHINGLE):
    """The bits set in over half of the shingles' hashes, as an unsigned integer; no words: 0."""
    return _majority(shingle_hashes(data, n))


def fingerprints(docs, keys, n=SHINGLE):
    """keys of docs and the fingerprint of `text` (null: no words) as signed bigint `fp`."""
    schema = ", ".join(f"{k} bigint" for k in [*keys, "fp"])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keys)).cast(pa.binary())
            fps = pa.array(np.array([fingerprint(t.as_py(), n) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*keys, "fp"])

    return base.map_arrow(docs.select(*keys, base.text_or_empty()), run, schema)


def segments(bits):
    """(lowest bit, width) of the fewest segments of which one has at most one of `bits` differences."""
    n = max(2, bits // 2 + 1)
    ends = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def variants(fps, bits):
    """fps (fp) with `variant` (the bit left out) and `key`: that number and the segment."""
    keys = []
    for low, width in segments(bits):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            rest = part.bitwiseAND(F.lit((1 << width) - 1 - (1 << p)))
            keys.append(rest + F.lit((low + p) << 33))
    return fps.select("fp", F.posexplode(F.array(*keys)).alias("variant", "key"))


def _first_only(x, variant, segs):
    """Whether this variant is the first at which two fingerprints with difference x meet."""
    ok = np.zeros(len(x), bool)
    earlier = np.ones(len(x), bool)  # no earlier segment has at most one difference
    for low, width in segs:
        own = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        here = (variant >= low) & (variant < low + width)
        n = np.bitwise_count(own)
        first = np.where(n == 0, variant == low, own == np.uint64(1) << (variant - low).clip(0).astype(np.uint64))
        ok |= here & earlier & (n <= 1) & first
        earlier &= n > 1
    return ok


def _distance(f, g):
    return np.bitwise_count(f ^ g).astype(np.int64)


def forest(f, bits):
    """The places of pairs that connect what links of `bits` or fewer connect, the closest first: a
    spanning forest of least distances, at most len(f) - 1 of them. Memory goes with len(f).
    """
    a, b = [], []
    left = np.arange(1, len(f))
    near = np.zeros(len(left), np.int64)  # the place of the closest one that is in, for each left
    far = _distance(f[left], f[0])
    while len(left):
        k = int(far.argmin())
        i = left[k]
        if far[k] <= bits:
            a.append(near[k])
            b.append(i)
        left, near, far = (np.delete(x, k) for x in (left, near, far))
        now = _distance(f[left], f[i])
        closer = now < far
        near[closer] = i
        far[closer] = now[closer]
    return np.array(a, np.int64), np.array(b, np.int64)


def _shifts(at, ends):
    """(places, the k-th ones after them) of all pairs of a group; ends: where each place's group ends."""
    k = 1
    while len(at := at[at + k < ends[at]]):
        yield at, at + k
        k += 1


def _batch(u, v):
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def _by_group(linked):
    """For mapInArrow over rows (group, ...) sorted by group: what linked(group, ...) gives of whole groups."""

    def run(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            last = np.flatnonzero(held[0] == held[0][-1])[0]
            if last:
                yield from linked(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield from linked(*held)

    return run


def _cut(group):
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return cuts, np.diff(np.append(cuts, len(group)))


def _links(bits):
    """Of rows (group, fp, variant): links (u, v) that connect each group; a pair of a small group is
    given at its first variant only.
    """
    segs = segments(bits)

    def linked(group, fp, variant):
        f = fp.view(np.uint64)
        cuts, sizes = _cut(group)
        for c, s in zip(cuts[sizes > FEW], sizes[sizes > FEW]):
            a, b = forest(f[c : c + s], bits)
            yield _batch(f[c + a], f[c + b])
        small = np.repeat(sizes <= FEW, sizes)
        for a, b in _shifts(np.flatnonzero(small), np.repeat(cuts + sizes, sizes)):
            x = f[a] ^ f[b]
            ok = np.bitwise_count(x) <= bits
            ok[ok] = _first_only(x[ok], variant[a[ok]], segs)
            if ok.any():
                yield _batch(f[a[ok]], f[b[ok]])

    return _by_group(linked)


def hot_keys(rows, block=BLOCK):
    """(key, blocks) of the keys of rows with over `block` rows, counted before they are dealt."""
    many = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    return base.settled(many.select("key", F.ceil(F.col("n") / block).alias("blocks")), "hot")


def dealt(rows, hot, name="fp"):
    """rows (key, ...) with `group` and sorted by it: the key's rows, or two of its blocks where it is
    hot. A row's block is by the hash of column `name`. Rows alone in their group are left out.
    """
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    mine = F.pmod(F.xxhash64(name), blocks).alias("mine")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other")
    names = [c for c in rows.columns if c != "key"]
    rows = rows.join(hot, "key", "left").select("key", *names, mine, other)
    group = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("group")
    whole = W.partitionBy("group").orderBy(name).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(group, *names).withColumn("n", F.count("*").over(whole))
    return rows.filter("n > 1").drop("n")


def links(fps, bits=BITS, block=BLOCK):
    """fps (fp, distinct) -> (u, v): links that connect all fingerprints within `bits` of each other."""
    rows = variants(fps, bits)
    rows = dealt(rows, hot_keys(rows, block)).select("group", "fp", "variant")
    return base.map_arrow(rows, _links(bits), "u bigint, v bigint")


def classes(fps, bits=BITS):
    """fps (fp, any number of rows each) -> (fp, root): one row per distinct fingerprint."""
    nodes = fps.select("fp").distinct()
    found = components.roots(links(nodes, bits)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components_of(docs, n=SHINGLE, bits=BITS):
    """docs (doc_id, text) -> (doc_id, fingerprint, component_id), one row per row of docs.

    component_id is the least doc_id reachable over links; null where all of them are null. A
    text without words has fingerprint 0, which links like any other; repeated rows share
    everything. Other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fps = base.settled(fingerprints(own, ["doc_id"], n), "fingerprints")
    found = base.settled(classes(fps, bits), "classes")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = least.join(found, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    out = fps.join(found.join(least, "root"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@base.register("op2_simhash_variants")
def op2(spark, sf_dir):
    """Every document's fingerprint and component."""
    return components_of(base.documents(spark, sf_dir))
