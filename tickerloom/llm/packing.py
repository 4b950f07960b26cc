"""Packing token sequences into windows by minimum bin slack.

Each partition of the documents packs its own: whole windows are cut from long documents, what is
left of each document waits in a pool of bounded size, and each window is filled from the pool by
a subset-sum program over the counts of waiting lengths. A window that no subset fills takes the
beginning of the longest piece that waits; what is left at the end of a partition is cut to
sequences whose lengths are powers of two, so there is no padding at all.
"""

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tickerloom.llm import base, tokens

WINDOW = 4096
END_ID = 2
#: Documents' rests that wait in a task: at most this many, of less than a window each.
POOL = 8192

OUT = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)


def fullest(counts, capacity):
    """The multiset of lengths {length: times} within counts whose sum is closest to capacity.

    Bit s of `reach` says that s is the sum of some multiset. Times are split in powers of two,
    and the sets before each step are kept, to walk back from the best sum. Lengths are tried from
    the largest down, and no further once the capacity itself is reached.
    """
    mask = (1 << capacity + 1) - 1
    reach, steps = 1, []
    for length in sorted((n for n, k in counts.items() if k and n <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= reach << length * part & mask
            left -= part
            part *= 2
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    taken = defaultdict(int)
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            taken[length] += part
    return dict(taken)


class Packer:
    """Packs the documents of one task; `add` and `finish` give finished sequences' pieces."""

    def __init__(self, first_sequence, window=WINDOW, pool=POOL):
        self.sequence, self.window, self.most = first_sequence, window, pool
        self.waiting = defaultdict(list)
        self.counts = defaultdict(int)
        self.n = 0

    def _wait(self, piece):
        length = len(piece[2]) // 4
        self.waiting[length].append(piece)
        self.counts[length] += 1
        self.n += 1

    def _next(self, length):
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.n -= 1
        return self.waiting[length].pop()

    def _out(self, pieces):
        rows, at = [], 0
        for doc_id, start, ids, n_doc in pieces:
            n = len(ids) // 4
            rows.append((doc_id, start, n, zlib.crc32(ids), n_doc, self.sequence, at))
            at += n
        self.sequence += 1
        return rows

    def _fill(self):
        """The pieces of one window: the longest that waits, and the fullest multiset beside it."""
        first = max(self.counts)
        pieces = [self._next(first)]
        room = self.window - first
        for length, times in sorted(fullest(self.counts, room).items(), reverse=True):
            pieces += [self._next(length) for _ in range(times)]
            room -= length * times
        if room and self.counts:  # every length that waits is longer than the room
            doc_id, start, ids, n_doc = self._next(max(self.counts))
            pieces.append((doc_id, start, ids[: 4 * room], n_doc))
            self._wait((doc_id, start + room, ids[4 * room :], n_doc))
            room = 0
        return pieces, room

    def add(self, doc_id, ids):
        rows, n, step = [], len(ids) // 4, 4 * self.window
        for at in range(0, len(ids) - len(ids) % step, step):
            rows += self._out([(doc_id, at // 4, ids[at : at + step], n)])
        if len(ids) % step:
            at = len(ids) - len(ids) % step
            self._wait((doc_id, at // 4, ids[at:], n))
        if self.n > self.most:
            while self.n > self.most // 2:
                rows += self._out(self._fill()[0])
        return rows

    def finish(self):
        rows = []
        while self.n:
            pieces, room = self._fill()
            if not room:
                rows += self._out(pieces)
                continue
            left = self.window - room  # the last one: cut to powers of two, the largest first
            while left:
                size = need = 1 << left.bit_length() - 1
                now = []
                while need:
                    doc_id, start, ids, n_doc = pieces.pop(0)
                    n = min(need, len(ids) // 4)
                    now.append((doc_id, start, ids[: 4 * n], n_doc))
                    if 4 * n < len(ids):
                        pieces.insert(0, (doc_id, start + n, ids[4 * n :], n_doc))
                    need -= n
                rows += self._out(now)
                left -= size
        return rows


def pack(docs, tokenizer=None, window=WINDOW, end_id=END_ID, pool=POOL):
    """docs (doc_id, text) -> one row per piece: OUT.

    A null text is empty and gives the end id alone; a null doc_id stays null; repeated rows are
    documents of their own. A sequence holds pieces of one task's documents. Other columns are
    not looked at. No rows in, no rows out.
    """
    path = tokenizer or tokens.default_tokenizer()

    def run(batches):
        enc = tokens.encoder(path)
        end = int(end_id).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, window, pool)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                rows += packer.add(doc_id, enc.encode(text.as_py()) + end)
            if rows:
                yield table(rows)
        if rows := packer.finish():
            yield table(rows)

    return base.map_arrow(docs.select(F.col("doc_id").cast("bigint"), base.text_or_empty()), run, OUT)


@base.register("op4_pack_min_slack")
def op4(spark, sf_dir):
    """Every document packed into sequences of 4096."""
    return pack(base.documents(spark, sf_dir))
