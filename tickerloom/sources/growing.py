"""Captures that are still being written, as a streaming source with byte offsets.

Spark's file source takes a file once. Here a batch is the byte ranges that files have grown by, up
to their last whole line; a torn tail is left for the next batch. Offsets are kept in the query's
checkpoint, so a restart goes on where the last batch ended. Files are found and opened through
Arrow's file systems (a local or mounted folder, or a URI), by the driver for sizes and tails only.
"""

from tickerloom.sources.capture import parse_lines

NAME = "growing_lines"
#: Bytes of one task, and of a step when the last line end is looked for.
CHUNK, STEP = 64 << 20, 1 << 20


def _source():
    """The data source; made in a function so that workers need not find this package."""
    import pyarrow as pa
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    class Range(InputPartition):
        def __init__(self, path, start, stop, first):
            self.path, self.start, self.stop, self.first = path, start, stop, first

    def opened(path):
        from pyarrow import fs

        if "://" in path:
            return fs.FileSystem.from_uri(path)
        return fs.LocalFileSystem(), path.removeprefix("file:")

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.path, self.chunk = options["path"], int(options.get("chunkbytes", CHUNK))

        def initialOffset(self):
            return {}

        def latestOffset(self):
            from pyarrow import fs

            files, root = opened(self.path)
            found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            own = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
            return {f.path: self._whole(files, f) for f in own}

        @staticmethod
        def _whole(files, info):
            """Bytes up to the end of the last whole line."""
            with files.open_input_file(info.path) as f:
                stop = info.size
                while stop > 0:
                    start = max(0, stop - STEP)
                    f.seek(start)
                    at = f.read(stop - start).rfind(b"\n")
                    if at >= 0:
                        return start + at + 1
                    stop = start
            return 0

        def partitions(self, start, end):
            out = []
            for path, stop in sorted(end.items()):
                first = start.get(path, 0)
                if stop < first:
                    raise ValueError(f"{path} is shorter than what was read of it")
                out += [Range(path, a, min(a + self.chunk, stop), first) for a in range(first, stop, self.chunk)]
            return out

        def read(self, part):
            import io

            files, _ = opened(self.path)
            with files.open_input_file(part.path) as raw:
                # A line belongs to the range that its first byte is in.
                at = part.start if part.start == part.first else part.start - 1
                raw.seek(at)
                f = io.BufferedReader(raw, STEP)
                if at < part.start:
                    at += len(f.readline())
                lines = []
                while at < part.stop:
                    line = f.readline()
                    at += len(line)
                    lines.append(line.rstrip(b"\r\n").decode(errors="replace"))
                    if len(lines) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                        lines = []
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    class Source(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return "value string"

        def streamReader(self, schema):
            return Reader(self.options)

    return Source


def stream_growing_lines(spark, path, chunk_bytes=CHUNK):
    """(value): lines of the files of a folder as they grow."""
    spark.dataSource.register(_source())
    return spark.readStream.format(NAME).option("chunkBytes", chunk_bytes).load(path)


def stream_growing_capture(spark, path, chunk_bytes=CHUNK):
    """(recv_ns, frame) of captures that are still being written."""
    return parse_lines(stream_growing_lines(spark, path, chunk_bytes))
