"""Token ids in a binary table: one zstandard frame per document, under a shared dictionary.

A table is a folder with two Parquet datasets.
`dictionary`: dict_hash (sha256, hex), dictionary (bytes), tokenizer (the file's name), end_id.
`blocks`: documents in ascending doc_id order, nulls first, cut to blocks of bounded size:
    shard, block       place in the order
    dict_hash          the dictionary of this block's frames
    first_id, last_id  range of doc_ids, for finding a document's block without reading payloads
    doc_ids, n_tokens  one entry per document
    offsets            where each document's frame begins in the payload, and where the last ends
    payload            the frames, each the ids of one document as little-endian uint16 or uint32
Parquet carries the blocks, so writing is committed by Spark and survives lost executors, and the
payload column of blocks that are not wanted is never read.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm import base, tokens

END_ID = 1
#: The dictionary is trained on this many documents at most, this many ids of each at most.
SAMPLE_DOCS = 1000
SAMPLE_IDS = 1000
DICT_BYTES = 32 * 1024
LEVEL = 3
#: A block is closed when it holds this many compressed bytes or documents.
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096

BLOCKS = (
    "shard int, block int, dict_hash string, first_id bigint, last_id bigint,"
    " doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"
)
READ = "shard int, block int, at int, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def _width(vocabulary, end_id):
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def train_dictionary(docs, path, end_id, width):
    """A dictionary trained on the ids of a bounded sample, chosen by hash.

    The bound is SAMPLE_DOCS x SAMPLE_IDS, whatever the table's size: a share of the documents is
    let through that gives about twice as many, and the first SAMPLE_DOCS of them are taken.
    Which ones they are changes the frames and never what is read back. Too little to train on
    gives an empty dictionary.
    """
    share = min(1 << 20, -(-(2 * SAMPLE_DOCS << 20) // max(1, docs.count())))
    mark = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20))
    beginning = F.substring("text", 1, 8 * SAMPLE_IDS)  # of the sample only: no row is read from it
    sample = docs.filter(mark < share).select(beginning.alias("t")).limit(SAMPLE_DOCS)
    enc, ids = tokens.encoder(path), []
    for row in sample.collect():
        data = np.frombuffer(enc.encode(row.t.encode()), "<u4")[:SAMPLE_IDS]
        ids.append(np.append(data, end_id).astype(width).tobytes())
    try:
        return zstandard.train_dictionary(DICT_BYTES, ids, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs, path, tokenizer=None, end_id=END_ID):
    """Write docs (doc_id, text) as a token table at `path`.

    A null text is empty: the end id alone. Null doc_ids come first. Documents of equal doc_id
    are ordered by a hash of their text; repeated rows are written as often as they occur. Other
    columns are not looked at. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    vocab = tokenizer or tokens.default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), base.text_or_empty().alias("text"))
    width = _width(tokens.encoder(vocab).whole.get_vocab_size(), end_id)
    dictionary = train_dictionary(docs, vocab, end_id, width)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    one = [(dict_hash, bytearray(dictionary), vocab.rpartition("/")[2], end_id, width)]
    spark.createDataFrame(
        one, "dict_hash string, dictionary binary, tokenizer string, end_id int, width string"
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches):
        enc = tokens.encoder(vocab)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        shard, block = TaskContext.get().partitionId(), 0
        ids_of, sizes, frames, held = [], [], [], 0

        def closed():
            known = [i for i in ids_of if i is not None]
            ends = np.cumsum([0, *map(len, frames)]).tolist()
            row = {
                "shard": [shard], "block": [block], "dict_hash": [dict_hash],
                "first_id": [min(known, default=None)], "last_id": [max(known, default=None)],
                "doc_ids": [ids_of], "n_tokens": [sizes], "offsets": [ends], "payload": [b"".join(frames)],
            }
            return pa.RecordBatch.from_pydict(row, schema=_arrow())

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = np.append(np.frombuffer(enc.encode(text.as_py()), "<u4"), np.uint32(end_id))
                frames.append(pack(data.astype(width).tobytes()))
                ids_of.append(doc_id)
                sizes.append(len(data))
                held += len(frames[-1])
                if held >= BLOCK_BYTES or len(frames) >= BLOCK_DOCS:
                    yield closed()
                    block += 1
                    ids_of, sizes, frames, held = [], [], [], 0
        if frames:
            yield closed()

    order = ["doc_id", F.xxhash64("text")]
    placed = docs.repartitionByRange(base.partitions(spark), *order).sortWithinPartitions(*order)
    made = base.map_arrow(placed, run, BLOCKS)
    made.write.option("compression", "none").parquet(f"{path}/blocks")  # frames are compressed already
    return path


def _arrow():
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds["array<bigint>"] = pa.list_(pa.int64())
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in BLOCKS.split(", ")])


def _dictionary(spark, path):
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dict_hash:
        raise ValueError(f"{path}: the dictionary does not have its hash")
    return data, row.dict_hash, row.width


def blocks(spark, path):
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def unpacker(dictionary, dict_hash, width):
    """frames(block columns, at) -> ids of the document at that place, as little-endian uint32."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def ids(block_hash, offsets, payload, at):
        if block_hash != dict_hash:
            raise ValueError(f"block of dictionary {block_hash}, read with {dict_hash}")
        frame = payload[offsets[at] : offsets[at + 1]]
        return np.frombuffer(unpack(frame), width).astype("<u4")

    return ids


def read_tokens(spark, path):
    """Every document of a token table, decoded: READ (place, doc_id, n_tokens, crc of its ids)."""
    dictionary = _dictionary(spark, path)

    def run(batches):
        unpack = unpacker(*dictionary)
        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                found = [
                    unpack(row["dict_hash"], row["offsets"], row["payload"], k) for k in range(len(row["doc_ids"]))
                ]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(range(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(map(len, found), pa.int64()),
                        pa.array((zlib.crc32(x) for x in found), pa.int64()),
                    ],
                    names,
                )

    return base.map_arrow(blocks(spark, path), run, READ)


def fetch(spark, path, doc_id):
    """(doc_id, ids) of the documents with this doc_id: reads the blocks that may hold it only."""
    dictionary = _dictionary(spark, path)

    def run(batches):
        unpack = unpacker(*dictionary)
        for batch in batches:
            for r in batch.to_pylist():
                at = [k for k, i in enumerate(r["doc_ids"]) if i == doc_id]
                ids = [unpack(r["dict_hash"], r["offsets"], r["payload"], k).tolist() for k in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(at), pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"]
                )

    near = blocks(spark, path).filter(f"first_id <= {int(doc_id)} AND last_id >= {int(doc_id)}")
    return base.map_arrow(near, run, "doc_id bigint, ids array<bigint>")


def starts(spark, path):
    """(shard, block, at, start): ids of all documents before each, from the block index alone.

    Totals are summed per block and per shard first; the two running sums see one row per shard
    and one row per block of a shard.
    """
    size = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    index = blocks(spark, path).select("shard", "block", "n_tokens", size.alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = index.groupBy("shard").agg(F.sum("size").alias("size"))
    shards = shards.select("shard", before(W.orderBy("shard")).alias("shard_start"))
    own = W.partitionBy("shard").orderBy("block")
    index = index.withColumn("block_start", before(own)).join(shards, "shard")
    start = F.col("shard_start") + F.col("block_start")
    index = index.select("shard", "block", start.alias("block_start"), F.posexplode("n_tokens").alias("at", "n"))
    inner = W.partitionBy("shard", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("block_start") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    return index.select("shard", "block", "at", start.cast("bigint").alias("start"))


@base.register("op6_token_file")
def op6(spark, sf_dir):
    """Every document written to a token table and read back from it."""
    path = write_tokens(base.documents(spark, sf_dir), base.new_path(spark, "tokens"))
    rows = read_tokens(spark, path).join(starts(spark, path), ["shard", "block", "at"])
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
