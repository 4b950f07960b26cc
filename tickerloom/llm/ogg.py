"""Media columns: Ogg containers of 8-bit PCM, written and read without loss.

A payload is cut to frames of 576 samples, a sample a byte. Frames alternate between two logical
streams; each stream has a header packet and then its frames, as packets. Pages of both streams
are interleaved. The granule position of a page is the number of samples that its stream has when
the last packet ending on the page is played; a page on which no packet ends has -1. The reader
checks every page's checksum, sequence number and flags, puts packets together from the lacing
values, separates the streams by serial number, and takes timestamps from granule positions.
"""

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tickerloom.llm import base

FRAME = 576
RATE = 8000
STREAMS = 2
#: Fixed values of the format: capture pattern, page header, header flags, lacing.
MAGIC = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SEGMENTS, LACE = 255, 255
#: Header packet: name, sample rate, samples of a frame, streams, which of them, payload bytes.
HEAD = struct.Struct("<8sIHBBQ")
HEAD_NAME = b"PCM8\0\0\0\1"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

OUT = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint,"
    " media_bytes bigint, media_sha256 string, feature string"
)


def padded(data):
    """data and bytes 255 up to a positive multiple of FRAME."""
    return data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))


def checksum(page):
    """The format's CRC: polynomial 04C11DB7, highest bit first, from zero, of a page whose own is 0.

    zlib has the same polynomial lowest bit first and inverted, so bits are turned round twice.
    """
    reg = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reg.to_bytes(4, "little").translate(_REVERSED), "big")


def _lacing(n):
    return bytes([LACE]) * (n // LACE) + bytes([n % LACE])


def _pages(serial, packets):
    """Pages of one stream, as (granule for interleaving, bytes); packets: (bytes, granule after)."""
    laces, body, ends = bytearray(), bytearray(), []
    for data, granule in packets:
        laces += _lacing(len(data))
        body += data
        ends.append((len(laces), granule))
    pages, at, byte, k, seen = [], 0, 0, 0, 0
    cuts = [ends[0][0]]  # the header has a page of its own
    while cuts[-1] < len(laces):
        cuts.append(min(cuts[-1] + SEGMENTS, len(laces)))
    for number, cut in enumerate(cuts):
        part = bytes(laces[at:cut])
        size, granule = sum(part), -1
        while k < len(ends) and ends[k][0] <= cut:
            granule = seen = ends[k][1]
            k += 1
        flags = CONTINUED * (at > 0 and laces[at - 1] == LACE) | FIRST * (at == 0) | LAST * (cut == len(laces))
        head = lambda crc: HEADER.pack(MAGIC, 0, flags, granule, serial, number, crc, len(part)) + part  # noqa: B023, E731
        rest = bytes(body[byte : byte + size])
        pages.append((number > 0, seen, serial, number, head(checksum(head(0) + rest)) + rest))
        at, byte = cut, byte + size
    return pages


def encode(payload):
    """An Ogg file of a payload whose length is a positive multiple of FRAME."""
    pages = []
    for s in range(STREAMS):
        packets, played = [(HEAD.pack(HEAD_NAME, RATE, FRAME, STREAMS, s, len(payload)), 0)], 0
        for at in range(s * FRAME, len(payload), STREAMS * FRAME):
            played += FRAME
            packets.append((payload[at : at + FRAME], played))
        pages += _pages(s + 1, packets)
    return b"".join(p[-1] for p in sorted(pages))  # headers first, then by time


def demultiplex(media):
    """{serial: [(packet, granule of the page it ends on, whether it is the last there)]}."""
    at, streams, parts, numbers, ended = 0, {}, {}, {}, set()
    while at < len(media):
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != MAGIC or version:
            raise ValueError(f"no page at byte {at}")
        body = at + HEADER.size + n
        laces = media[body - n : body]
        end = body + sum(laces)
        if end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at} is damaged")
        if (serial not in streams) != bool(flags & FIRST) or serial in ended or number != numbers.get(serial, 0):
            raise ValueError(f"page at byte {at} is out of order")
        if bool(parts.get(serial)) != bool(flags & CONTINUED):
            raise ValueError(f"page at byte {at} does not go on where its stream stopped")
        found, part, size = streams.setdefault(serial, []), parts.setdefault(serial, []), 0
        start, done = body, []
        for lace in laces:
            size += lace
            if lace < LACE:
                done.append(b"".join([*part, media[start : start + size]]))
                part.clear()
                start, size = start + size, 0
        if start < end:
            part.append(media[start:end])
        found += [(p, granule, k == len(done) - 1) for k, p in enumerate(done)]
        numbers[serial] = number + 1
        if flags & LAST:
            ended.add(serial)
        at = end
    if ended != set(streams) or any(parts.values()):
        raise ValueError("a stream does not end")
    return streams


def decode(media):
    """(payload, {stream: (packets, timestamp in seconds of each packet's end)}).

    Only a page's last packet has its granule written; the others' follow from the frame size,
    counted back from it.
    """
    streams, frames, times, total = demultiplex(media), {}, {}, 0
    for packets in streams.values():
        name, rate, frame, n_streams, which, total = HEAD.unpack(packets[0][0])
        if name != HEAD_NAME:
            raise ValueError("not a PCM stream")
        played, ends, behind = 0, [], 0
        for data, granule, closes in packets[1:]:
            behind += len(data)
            ends.append(played + behind)
            if closes:
                if granule != played + behind:
                    raise ValueError("granule position and samples differ")
                played, behind = granule, 0
        frames[which] = [p[0] for p in packets[1:]]
        times[which] = [e / rate for e in ends]
    out = [b""] * sum(map(len, frames.values()))
    for which, own in frames.items():
        out[which :: len(frames)] = own
    payload = b"".join(out)
    if len(payload) != total:
        raise ValueError("samples are missing")
    return payload, times


def feature(payload, times):
    """Integers of the sound: packets and microseconds of each stream, mean level, crossings of it."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) * 1000 // len(x)
    high = x >= 128
    cross = int(np.count_nonzero(high[1:] != high[:-1]))
    parts = [f"s{k}={len(t)}/{round(t[-1] * 1e6) if t else 0}us" for k, t in sorted(times.items())]
    return ";".join([*parts, f"mean={mean}", f"cross={cross}", f"peak={int(x.max())}"])


def write_media(docs, path):
    """docs (doc_id, text) as a media table at `path`: doc_id, n_bytes, media.

    A null text is empty, and an empty one a single frame of bytes 255. Null doc_ids and repeated
    rows are kept as they are; other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, len(ids), 256):
                part = texts.slice(at, 256).to_pylist()
                media = [encode(padded(t)) for t in part]
                sizes = pa.array(map(len, part), pa.int64())
                columns = [ids.slice(at, 256), sizes, pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("bigint"), base.text_or_empty())
    made = base.map_arrow(docs, run, "doc_id bigint, n_bytes bigint, media binary")
    made.write.option("compression", "zstd").parquet(path)
    return path


def read_media(spark, path):
    """One row per document of a media table, decoded: OUT."""

    def run(batches):
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(*(batch.column(k) for k in range(3))):
                data = media.as_py()
                payload, times = decode(data)
                sha = lambda b: hashlib.sha256(b).hexdigest()
                rows.append(
                    (
                        doc_id.as_py(), n.as_py(), len(payload), sha(payload), zlib.crc32(payload[-32:]),
                        len(data), sha(data), feature(payload, times),
                    )
                )
            if rows:
                kinds = [pa.string() if "sha" in c or c == "feature" else pa.int64() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    stored = spark.read.schema("doc_id bigint, n_bytes bigint, media binary").parquet(path)
    return base.map_arrow(stored, run, OUT)


@base.register("op9_ogg_media")
def op9(spark, sf_dir):
    """Every document stored as an Ogg file and read back."""
    return read_media(spark, write_media(base.documents(spark, sf_dir), base.new_path(spark, "media")))
