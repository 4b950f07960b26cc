"""Vector code compression: product codes, their codebooks trained over a trie of distinct parts.

Vectors become integers and are cut into equal parts. The distinct parts of each position are
counted, sorted and kept as one table, so parts with a common prefix are neighbours: the trie. Each
round walks it depth first. A node holds the vector of distances accumulated from the root to each
codebook entry, shared by everything below it; a leaf takes the least of them, and adds its
components, times the number of its vectors, to that entry's sums. Only those sums reach the
driver, at most entries x dimensions of them.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tickerloom.llm import base

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves below this many are walked level by level together.
LEAVES = 8192
#: Largest integer component: squared distances of parts then fit 64 bits.
LARGEST = 1 << 27


def walk(rows, book, leaves=LEAVES):
    """rows (n, d), distinct and in lexicographic order; book (k, d): (nearest entry, distance) of each.

    Ties go to the lower entry.
    """
    n, d = rows.shape
    best, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return best, least
    fresh = np.ones((n, d), bool)  # a node of depth j + 1 starts here
    fresh[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    stack = [(0, n, 0, np.zeros(len(book), np.int64))]
    while stack:
        a, b, depth, shared = stack.pop()
        if b - a > leaves and depth < d:
            starts = a + np.flatnonzero(fresh[a:b, depth])
            starts = starts if starts[:1] == a else np.append(a, starts)
            ends = np.append(starts[1:], b)
            i = 0
            while i < len(starts):
                if ends[i] - starts[i] > leaves:
                    step = (rows[starts[i], depth] - book[:, depth]) ** 2
                    stack.append((starts[i], ends[i], depth + 1, shared + step))
                    i += 1
                else:  # as many siblings as fit go on together
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + leaves, "right")))
                    stack.append((starts[i], ends[j - 1], depth, shared))
                    i = j
            continue
        node, owner = shared[None], np.zeros(b - a, np.int64)
        for j in range(depth, d):
            mine = fresh[a:b, j].copy()
            mine[0] = True
            start = np.flatnonzero(mine)
            node = node[owner[start]] + (rows[a + start, j][:, None] - book[:, j]) ** 2
            owner = np.cumsum(mine) - 1
        best[a:b] = node.argmin(axis=1)[owner]
        least[a:b] = node.min(axis=1)[owner]
    return best, least


def integers(values, width):
    """Flat float components of vectors of this width as rows of whole numbers, padded to full parts."""
    x = np.floor(np.asarray(values, np.float64) * SCALE).reshape(-1, width) if width else np.zeros((len(values), 0))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE} in magnitude")
    return np.pad(x.astype(np.int64), ((0, 0), (0, -width % PARTS)))


def packed(part):
    """Rows of whole numbers as bytes whose order is the numbers' lexicographic order."""
    return (part + (1 << 31)).astype(">u4").view(np.uint8).reshape(len(part), -1)


def unpacked(data, n):
    rows = np.frombuffer(data, ">u4").reshape(n, -1)
    return rows.astype(np.int64) - (1 << 31)


def distinct(part):
    """(distinct rows in lexicographic order, for each row its place among them, their counts)."""
    if not part.shape[1]:
        return part[:1], np.zeros(len(part), np.int64), np.array([len(part)])
    keys = np.ascontiguousarray(packed(part)).view(f"V{4 * part.shape[1]}").ravel()
    _, first, place, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return part[first], place.ravel(), counts


def kept(vectors):
    """(vec_id, label, embedding) of the rows whose vector is neither null nor holds null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    return own.filter(F.col("embedding").isNotNull() & F.forall("embedding", fine))


def smallest(rows, n):
    """The n rows (vec_id, embedding) of least vec_id, one for each; null comes last.

    Of rows with the same vec_id the least vector is taken. Each task hands on n rows.
    """

    def run(batches):
        held = {}
        for batch in batches:
            ids = batch.column(0)
            order = pc.sort_indices(ids).to_pylist()
            for k in order:
                key = (ids[k].as_py() is None, ids[k].as_py() or 0)
                if key not in held and len(held) >= n and key > max(held):
                    break
                v = batch.column(1)[k].as_py()
                held[key] = min(held.get(key, v), v)
                if len(held) > n:
                    del held[max(held)]
        if held:
            ids = [None if no else i for no, i in held]
            own = [pa.array(ids, pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(own, ["vec_id", "embedding"])

    own = rows.select("vec_id", F.col("embedding").cast("array<double>"))
    out = base.map_arrow(own, run, "vec_id bigint, embedding array<double>")
    out = out.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return [r.embedding for r in out.orderBy(F.col("vec_id").asc_nulls_last()).limit(n).collect()]


def parts_table(rows, width):
    """rows (embedding of this width) -> (position, part, n): each position's distinct parts, counted,
    in lexicographic order within and across partitions.
    """

    def run(batches):
        for batch in batches:
            x = integers(batch.column(0).flatten().to_numpy(zero_copy_only=False), width)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                own, _, counts = distinct(part)
                data = [r.tobytes() for r in packed(own)]
                number, n = np.full(len(own), p, np.int32), counts.astype(np.int64)
                cols = [pa.array(number), pa.array(data, pa.binary()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, ["position", "part", "n"])

    found = base.map_arrow(rows.select("embedding"), run, "position int, part binary, n bigint")
    found = found.groupBy("position", "part").agg(F.sum("n").alias("n"))
    found = found.repartitionByRange(base.partitions(rows.sparkSession), "position", "part")
    return base.settled(found.sortWithinPartitions("position", "part"), "parts")


def _sums(parts, books):
    """parts -> (position, entry, dim, total): what each entry's parts add up to; dim -1 is their count."""
    schema = "position int, entry int, dim int, total bigint"

    def run(batches):
        k, d = books.shape[1:]
        total = np.zeros((PARTS, k, d + 1), np.int64)
        for batch in batches:
            position, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                data = b"".join(batch.column(1).slice(at[0], len(at)).to_pylist())
                rows = unpacked(data, len(at))
                best, _ = walk(rows, books[p], LEAVES)
                np.add.at(total[p], best, np.column_stack([rows * n[at, None], n[at]]))
        p, e, c = np.nonzero(total)
        dim = np.where(c == d, -1, c).astype(np.int32)
        cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(dim), pa.array(total[p, e, c])]
        yield pa.RecordBatch.from_arrays(cols, ["position", "entry", "dim", "total"])

    return base.map_arrow(parts, run, schema)


def train(parts, books, rounds=ROUNDS):
    """books (PARTS, k, d) after so many rounds over the table of parts."""
    for _ in range(rounds):
        total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        sums = _sums(parts, books).groupBy("position", "entry", "dim").agg(total)
        found = {(r.position, r.entry, r.dim): int(r.total) for r in sums.collect()}
        books = books.copy()
        for p, e, _ in [key for key in found if key[2] == -1]:
            books[p, e] = [found.get((p, e, j), 0) // found[p, e, -1] for j in range(books.shape[2])]
    return books


def assigned(rows, books, width):
    """rows (vec_id, label, embedding) -> (vec_id, label, code, error) under the books."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False), width)
            x = x if width else np.zeros((len(batch), 0), np.int64)
            codes, error = [], np.zeros(len(x), np.int64)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                own, place, _ = distinct(part)
                best, least = walk(own, books[p], LEAVES)
                codes.append(best[place])
                error += least[place]
            text = [bytes(r).hex() for r in np.stack(codes, axis=1).astype(np.uint8)]
            cols = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error"])

    return base.map_arrow(rows, run, f"vec_id bigint, label {label}, code string, error bigint")


def encode(vectors, rounds=ROUNDS):
    """vectors (vec_id, embedding, label) -> (rows (vec_id, label, code, error), codebooks).

    Rows whose vector is null or holds nulls, NaN or infinities are dropped, as are vectors of
    another length than the one of least vec_id. A length that PARTS does not divide is filled up
    with zeros. Null vec_ids come last in the order that picks the first entries, repeated vec_ids
    count once there (their least vector); every row gets its code. Fewer than ENTRIES vectors
    give as many entries. Null labels are a label. Components beyond 2^15 in magnitude are an
    error. No rows give no rows. Other columns are not looked at.
    """
    fine = kept(vectors)
    first = smallest(fine, ENTRIES)
    width = len(first[0]) if first else 0
    first = [v for v in first if len(v) == width]
    fine = fine.filter(F.size("embedding") == width)
    start = integers([x for v in first for x in v] if width else first, width)
    books = np.stack(np.split(start, PARTS, axis=1))
    if first and width:
        books = train(parts_table(fine, width), books, rounds)
    return base.settled(assigned(fine, books, width), "codes"), books


@base.register("op13_vector_codes")
def op13(spark, sf_dir):
    """Every vector's code and error, its label's error, and a digest of the codebooks."""
    rows, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
