"""Lines of zstd files, frame by frame: frames of one file go to different tasks.

A file's frames are found without decoding: a frame's header tells its size or, block by block, where it ends. Runs of
frames of about CHUNK bytes are decoded by themselves. Lines that cross runs are put together from what each run has before
its first and behind its last line feed; those small rows also give each run the number of its first line. A file that
is one frame is one run, and one task decodes it, a piece at a time; a broken end of a file fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.token_files import file_system_of

#: Compressed bytes of a run, bytes of a piece of decoded text, and lines and (about) bytes of a batch.
CHUNK, PIECE, LINES, BATCH = 8 << 20, 1 << 20, 10_000, 8 << 20
_MAGIC, _SKIPPED = b"\x28\xb5\x2f\xfd", range(0x184D2A50, 0x184D2A60)


def _open(path: str) -> pa.NativeFile:
    at, name = file_system_of(path)
    return at.open_input_file(name)


def frames(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(offset, length) of each frame of data."""
    import zstandard

    size, at = file.size(), 0

    def read(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    while at < size:
        head = read(at, 18)
        if int.from_bytes(head[:4], "little") in _SKIPPED:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if head[:4] != _MAGIC:
            raise ValueError(f"no zstd frame at byte {at}")
        end = at + zstandard.frame_header_size(head)
        last = False
        while not last:
            block = int.from_bytes(read(end, 3), "little")
            if end + 3 > size:
                raise ValueError("the last zstd frame is cut off")
            last, kind, length = bool(block & 1), block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else length)
        end += 4 if head[4] & 4 else 0
        yield at, end - at
        at = end


def runs(file: pa.NativeFile, chunk: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of frames with at least chunk bytes, but for the last."""
    start = end = None
    for at, length in frames(file):
        start = at if start is None else start
        end = at + length
        if end - start >= chunk:
            yield start, end - start
            start = None
    if start is not None:
        yield start, end - start


def decoded(path: str, offset: int, length: int) -> Iterator[bytes]:
    import io

    import zstandard

    with _open(path) as file:
        file.seek(offset)

        class Part(io.RawIOBase):
            left = length

            def readable(self) -> bool:
                return True

            def read(self, n: int = -1) -> bytes:
                got = file.read(min(self.left, n if n >= 0 else self.left))
                self.left -= len(got)
                return got

        reader = zstandard.ZstdDecompressor().stream_reader(Part(), read_across_frames=True)
        while piece := reader.read(PIECE):
            yield piece


def edges(pieces: Iterator[bytes]) -> tuple[int, bytes, bytes]:
    """Line feeds of a text, and what is behind the last of them; all of it, if there is none."""
    feeds, tail = 0, []
    for piece in pieces:
        n = piece.count(b"\n")
        if n:
            feeds, tail = feeds + n, [piece[piece.rindex(b"\n") + 1 :]]
        else:
            tail.append(piece)
    return feeds, b"".join(tail)


def lines(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, line_num, value): the lines of the files, numbered from 0 in each."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _open(name) as file:
                    found = list(runs(file, chunk))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["path", "run", "offset", "length"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                feeds, tail = edges(decoded(r["path"], r["offset"], r["length"]))
                yield pa.RecordBatch.from_pylist([{**r, "feeds": feeds, "tail": tail}], schema=pa.schema(placed))

    def joined(part: pa.Table) -> pa.Table:
        out, before, start = [], b"", 0
        rows = sorted(part.to_pylist(), key=lambda r: r["run"])
        for r in rows:
            out.append({k: r[k] for k in ("path", "run", "offset", "length")} | {"before": before, "start": start, "last": r is rows[-1]})
            before, start = (r["tail"] if r["feeds"] else before + r["tail"]), start + r["feeds"]
        return pa.Table.from_pylist(out, schema=pa.schema(known))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                number, held, found, size = r["start"], r["before"], [], 0

                def told(r=r) -> pa.RecordBatch:
                    values = pa.array([x.removesuffix(b"\r").decode() for x in found], pa.string())
                    return pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found), pa.string()), pa.array(range(number, number + len(found)), pa.int64()), values], names=["path", "line_num", "value"])

                for piece in decoded(r["path"], r["offset"], r["length"]):
                    if b"\n" not in piece:
                        held += piece
                        continue
                    first, *inner, tail = piece.split(b"\n")
                    found += [held + first, *inner]
                    size += len(held) + len(piece)
                    held = tail
                    if len(found) >= LINES or size >= BATCH:
                        yield told()
                        number, found, size = number + len(found), [], 0
                if r["last"] and held:
                    found.append(held)
                if found:
                    yield told()

    base = [("path", pa.string()), ("run", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
    placed, known = [*base, ("feeds", pa.int64()), ("tail", pa.binary())], [*base, ("before", pa.binary()), ("start", pa.int64()), ("last", pa.bool_())]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes of small rows aren't put together again
    cut = files.repartition(tasks, "path").mapInArrow(index, "path string, run int, offset long, length long").repartition(tasks, "path", "run")
    told = cut.mapInArrow(ends, "path string, run int, offset long, length long, feeds long, tail binary")
    numbered = told.groupBy("path").applyInArrow(joined, "path string, run int, offset long, length long, before binary, start long, last boolean")
    return numbered.repartition(tasks, "path", "run").mapInArrow(split, "path string, line_num long, value string").select("path", "line_num", F.col("value"))
