"""Near copies by similarity of their shingle sets, found through SimHash and joined without pair lists.

Texts are known by their set of shingles, and by a sketch of it: bits that over half of the hashes
have, mixed anew for every word of 64 bits. The first word is a SimHash fingerprint: texts whose
fingerprints `simhash` links by deletion variants are candidates first. Texts at the similarity often
differ in more bits than that; so texts that share a piece of their sketches meet in a group, too, and
small sets meet by their least hashes, which is exact. A group hands on only links
between texts within some bits of each other that join what is still apart, so the links of a
family go with its members. Components of links are candidates; their members meet once more, with
their shingles, and again only links that join two parts come out: the components of all pairs of
a candidate that have the similarity.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm import base, components, simhash
from tickerloom.llm.simhash import SEED, shingle_hashes

#: Chance that two texts at the similarity share a piece.
FOUND = 0.99
#: Bits of a piece up to so many texts; a piece grows with the root of the texts beyond.
PIECE, TEXTS = 18, 1 << 20
#: Sets of at most this many shingles meet by least hashes, which finds every pair of them.
SMALL = 64
#: Words of a sketch that groups compare, and members of a group compared pair by pair.
WORDS, FEW = 4, 32
#: Members and shingles of a block; groups beyond are verified block against block.
BLOCK, SHINGLES = 4096, 1 << 22


def differing(similarity):
    """Share of bits in which the sketches of two sets of this similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def pieces_for(n_texts, similarity):
    """(bits of a piece, pieces): random meetings stay few, pairs meet with probability FOUND."""
    bits = PIECE + max(0, math.ceil(math.log2(max(n_texts, 1) / TEXTS) / 2))
    share = (1 - differing(similarity)) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - share))


def bound(n_bits, similarity, deviations=5):
    """Differing bits that (but for one pair in three million) texts of this similarity keep to."""
    p = differing(similarity)
    return math.floor(n_bits * p + deviations * math.sqrt(n_bits * p * (1 - p)))


def sketch(hashes, words):
    """`words` words of 64 bits of a set of hashes."""
    ones, half = np.zeros(64 * words, np.int64), len(hashes)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        part = hashes[at : at + 255]
        mixed = np.empty((len(part), words), "<u8")
        for k in range(words):
            mixed[:, k] = part
            part = (part ^ part >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            part ^= part >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > half, bitorder="little").view("<u8")


def prefix(n, similarity):
    """Of n hashes in order, so many first ones: sets of this similarity have one of them in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def keys_of(hashes, words, bits, pieces, similarity):
    """The keys by which a set meets others: pieces of its sketch, or its least hashes if it is small.

    Sets that are as large as a partner of a small one may be have both.
    """
    keys = []
    if len(hashes) > SMALL:
        row = np.unpackbits(words.view(np.uint8), bitorder="little")[: bits * pieces].reshape(pieces, bits)
        value = row @ (np.int64(1) << np.arange(bits, dtype=np.int64))
        keys.append(value + (np.arange(1, pieces + 1, dtype=np.int64) << 32))
    if 0 < len(hashes) <= SMALL / similarity:
        keys.append(hashes[: prefix(len(hashes), similarity)].view(np.int64))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def sketches(docs, own, n, similarity, bits, pieces):
    """own columns of docs, with `fp` (a hash of the set of shingles of `text`), `size`, the sketch's
    words as bytes and `keys`. Letters are put in lower case.
    """
    words = max(WORDS, -(-bits * pieces // 64))
    few = [f"w{k}" for k in range(WORDS)]
    schema = ", ".join(f"{k} bigint" for k in [*own, "fp", "size", *few]) + ", bits binary, keys array<bigint>"
    names = [*own, "fp", "size", *few, "bits", "keys"]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(own)).cast(pa.binary())
            out = []
            for text in texts:
                hashes = np.unique(shingle_hashes(text.as_py(), n))
                fp = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
                row = sketch(hashes, words)
                keys = keys_of(hashes, row, bits, pieces, similarity)
                out.append((fp, len(hashes), *row[:WORDS].view(np.int64), row.tobytes(), keys))
            *whole, row, keys = zip(*out) if out else [[]] * (WORDS + 4)
            ends = pa.array(np.append(0, np.cumsum([len(k) for k in keys], dtype=np.int64)).astype(np.int32))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            more = [*(pa.array(c, pa.int64()) for c in whole), pa.array(row, pa.binary())]
            more.append(pa.ListArray.from_arrays(ends, flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names)

    return base.map_arrow(docs.select(*own, F.lower(base.text_or_empty()).alias("text")), run, schema)


def _distance(f, g):
    return np.bitwise_count(f ^ g).sum(axis=-1, dtype=np.int64)


def _whole_groups(fn):
    """For mapInArrow over rows (group, ...) in order of group: fn(columns) of batches of whole groups."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            group = held.column(0).to_numpy()
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from fn(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None:
            yield from fn(held.combine_chunks())

    return run


def joining(u, v, root_u, root_v):
    """Whether each pair in turn joins two parts that are still apart, from the roots on."""
    parent, out = {}, np.zeros(len(u), bool)

    def find(x):
        top = x
        while (y := parent.get(top, top)) != top:
            top = y
        while (y := parent.get(x, x)) != top:
            parent[x], x = top, y
        return top

    for k, (a, b) in enumerate(zip(root_u.tolist(), root_v.tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[b] = a
            out[k] = True
    return out


def connected(f, most):
    """Pairs of places that connect at least what distances of `most` or less connect.

    Everything near a first one is joined to it; what is not is compared with all.
    """
    near, label = _distance(f, f[0]) <= most, np.arange(len(f))
    label[near] = 0
    b = [np.flatnonzero(near)[1:]]
    a = [np.zeros(len(b[0]), np.int64)]
    for k in np.flatnonzero(~near):
        ok = np.flatnonzero((label != label[k]) & (_distance(f, f[k]) <= most))
        parts, first = np.unique(label[ok], return_index=True)
        a.append(np.full(len(parts), k))
        b.append(ok[first])
        if len(parts):
            label[np.isin(label, parts)] = label[k]
    return np.concatenate(a), np.concatenate(b)


def _links(most):
    """Rows (group, id, root, WORDS words) -> links (u, v, ru, rv) between texts within `most` bits that
    join what is still apart.
    """
    names = ["u", "v", "ru", "rv"]

    def some(table):
        group, ids, root, *words = (c.to_numpy() for c in table.columns)
        f = np.stack([w.view(np.uint64) for w in words], axis=1)
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(cuts, len(group)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, s in zip(cuts[sizes > FEW], sizes[sizes > FEW]):
            if (root[c : c + s] != root[c]).any():
                x, y = connected(f[c : c + s], most)
                a.append(c + x)
                b.append(c + y)
        at, ends, k = np.flatnonzero(np.repeat(sizes <= FEW, sizes)), np.repeat(cuts + sizes, sizes), 1
        while len(at := at[at + k < ends[at]]):
            ok = at[(root[at] != root[at + k])]
            ok = ok[_distance(f[ok], f[ok + k]) <= most]
            a.append(ok)
            b.append(ok + k)
            k += 1
        a, b = np.concatenate(a), np.concatenate(b)
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        ok = joining(ids[a], ids[b], root[a], root[b])
        a, b = a[ok], b[ok]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], root[a], root[b])], names)

    return _whole_groups(some)


def dealt(rows, name, weight, block):
    """rows (key, name, weight, ...) with `group`, `mine` and `other`, in order of group.

    A key's rows are one group. Where their count or weight is beyond `block`, they are cut to
    blocks by a hash of column `name`, and each two blocks are a group. Rows alone in their group
    are left out. Counts come from an aggregate that combines before the shuffle.
    """
    total = F.greatest(F.count("*") / block[0], F.sum(weight) / block[1])
    hot = rows.groupBy("key").agg(total.alias("n")).filter("n > 1")
    hot = base.settled(hot.select("key", F.ceil("n").cast("bigint").alias("blocks")), "hot")
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    names = [c for c in rows.columns if c != "key"]
    rows = rows.join(hot, "key", "left").select("key", *names, F.pmod(F.xxhash64(name), blocks).alias("mine"), blocks.alias("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", *names, "mine", other)
    group = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("group")
    whole = W.partitionBy("group").orderBy(name).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(group, *names, "mine", "other").withColumn("n", F.count("*").over(whole))
    return rows.filter("n > 1").drop("n")


def _met(texts, keys, most):
    """texts (id, root, words, keys) -> links (u, v, ru, rv) of texts that share one of `keys`."""
    names = [f"w{k}" for k in range(WORDS)]
    rows = texts.select(F.explode(keys).alias("key"), "id", "root", *names)
    rows = dealt(rows, "id", F.lit(1), (BLOCK, BLOCK)).select("group", "id", "root", *names)
    return base.settled(base.map_arrow(rows, _links(most), "u bigint, v bigint, ru bigint, rv bigint"), "links")


def _rooted(texts):
    """texts with `root`: the least id of those whose fingerprints deletion variants link."""
    found = base.settled(simhash.classes(texts.select(F.col("w0").alias("fp"))), "classes")
    rows = texts.join(found.select(F.col("fp").alias("w0"), F.col("root").alias("class")), "w0")
    least = rows.groupBy("class").agg(F.min("id").alias("root"))
    return rows.join(least, "class").select(*texts.columns, "root")


def _same(similarity):
    """Rows (group, id, mine, other, size, bits, shingles), each group's in a row: links (u, v) of
    similar sets that join two parts of the group. In a group of two blocks only pairs across count.
    """
    wide = None

    def group_links(ids, block, sizes, f, sets):
        nonlocal wide
        wide = wide or (bound(64 * WORDS, similarity), bound(64 * f.shape[1], similarity))
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.append(0, np.cumsum(sizes))
        mark = np.zeros(codes.max() + 1 if len(codes) else 1, bool)
        label, two, out = np.arange(len(ids)), block.min() != block.max(), []
        few = np.ascontiguousarray(f[:, :WORDS])
        for i in range(len(ids) - 1):
            ok = label[i + 1 :] != label[i]
            if two:
                ok &= block[i + 1 :] != block[i]
            at = i + 1 + np.flatnonzero(ok)
            lo, hi = np.minimum(sizes[at], sizes[i]), np.maximum(sizes[at], sizes[i])
            at = at[lo >= similarity * hi]
            small = np.minimum(sizes[at], sizes[i]) <= SMALL  # a sketch of few hashes says less
            at = at[small | (_distance(few[at], few[i]) <= wide[0])]
            small = np.minimum(sizes[at], sizes[i]) <= SMALL
            at = at[small | (_distance(f[at], f[i]) <= wide[1])]
            if not len(at):
                continue
            own = codes[starts[i] : starts[i + 1]]
            mark[own] = True
            ends = np.cumsum(sizes[at])
            flat = np.repeat(starts[at] - ends + sizes[at], sizes[at]) + np.arange(ends[-1])
            shared = np.add.reduceat(mark[codes[flat]].astype(np.int64), ends - sizes[at])
            mark[own] = False
            for j in at[shared >= similarity * (sizes[at] + sizes[i] - shared)]:
                if label[j] != label[i]:
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return out

    def some(table):
        group, ids, mine, sizes = (table.column(k).to_numpy() for k in range(4))
        f = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(len(group), -1)
        sets = [np.frombuffer(s, np.uint64) for s in table.column(5).to_pylist()]
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        out = []
        for a, b in zip(cuts, cuts[1:]):
            out += group_links(ids[a:b], mine[a:b], sizes[a:b], f[a:b], sets[a:b])
        u, v = zip(*out) if out else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _whole_groups(some)


def _with_sets(members, n):
    """members (text, ...) -> with the hashes of the distinct shingles, in order, in place of `text`."""
    names = [c for c in members.columns if c != "text"]
    schema = ", ".join([*(f"{c} {members.schema[c].dataType.simpleString()}" for c in names), "shingles binary"])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names)).cast(pa.binary())
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), n)).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*names, "shingles"])

    return base.map_arrow(members.select(*names, F.lower(base.text_or_empty()).alias("text")), run, schema)


def classes(texts, similarity, with_text, n):
    """texts (id, size, w0 ..., bits, keys) -> (node, root): components of pairs of this similarity.

    with_text(ids) gives the rows with their `text`. Ids without a partner have no row.
    """
    most = bound(64 * WORDS, similarity, 6)
    known = base.settled(_rooted(texts), "rooted")
    first = known.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    more = _met(known, F.col("keys"), most)
    links = first.union(more.select("u", "v"))
    found = components.roots(links).withColumnRenamed("node", "id")
    ends = found.select("id", "root").union(found.select(F.col("root").alias("id"), "root").distinct())
    members = with_text(ends).join(texts.select("id", "size", "bits"), "id")
    members = _with_sets(members.select(F.col("root").alias("key"), "id", "size", "bits", "text"), n)
    members = base.settled(members, "members")
    groups = dealt(members, "id", F.col("size"), (BLOCK, SHINGLES))
    groups = groups.select("group", "id", "mine", "size", "bits", "shingles")
    return components.roots(base.settled(base.map_arrow(groups, _same(similarity), "u bigint, v bigint"), "similar"))


def keep_one(docs, n=5, similarity=0.8):
    """docs with one row of each class: the least doc_id (null last), then the least row hash.

    A class is a component of pairs of texts whose sets of n-word shingles have this similarity
    (Jaccard). Texts of one set are one class; so are all texts without words, null ones too. Pairs
    of small sets are all found, others with probability FOUND at the similarity and more above;
    what is found is compared shingle by shingle. Rows equal in all columns are copies, and one
    stays. Columns stay as they are, and other columns only break ties. No rows give no rows.
    """
    key, row, no_id = (base.free_name(docs, c) for c in ("_key", "_row", "_no_id"))
    whole = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))
    df = docs.withColumn(no_id, F.col("doc_id").isNull().cast("bigint"))
    df = df.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")))
    df = df.withColumn(row, whole)
    own = df.select(F.col(no_id).alias("no_id"), F.col(key).alias("key"), F.col(row).alias("row"), "text")
    mine = ["no_id", "key", "row"]
    bits, pieces = pieces_for(docs.count(), similarity)
    found = base.settled(sketches(own, mine, n, similarity, bits, pieces), "sketches")
    more = ["size", *(f"w{k}" for k in range(WORDS)), "bits", "keys"]
    first = found.groupBy("fp").agg(F.min(F.struct(*mine, *more)).alias("first"))
    first = first.select(F.col("fp").alias("id"), *(F.col(f"first.{c}").alias(c) for c in [*mine, *more]))
    first = base.settled(first, "first")

    def with_text(ids):
        rows = first.select("id", *mine).join(ids, "id")
        return own.join(rows, mine).select("id", "root", "text").dropDuplicates(["id"])

    roots = classes(first.select("id", *more), similarity, with_text, n).withColumnRenamed("node", "id")
    roots = first.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    stay = roots.groupBy("root").agg(F.min(F.struct(*mine)).alias("first"))
    names = zip(mine, (no_id, key, row))
    stay = stay.select(*(F.col(f"first.{c}").alias(own_name) for c, own_name in names))
    kept = df.join(stay, [no_id, key, row], "left_semi").dropDuplicates([no_id, key, row])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
