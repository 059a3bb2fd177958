"""Token files as a Spark data source: `.bin` (the tokens of a part's documents, end to end) beside `.idx` (their numbers of
tokens and, last, the number of documents), both of little-endian unsigned integers.

    write_token_files(encoded, path, parts=8)                  # (key, ids) -> train-part-1-of-8.bin, train-part-1-of-8.idx, ...
    examples(spark, path, context=1024)                        # (part, example, inputs, targets)
    documents_of(spark, path)                                  # (part, doc, ids)

Writing: a task streams its parts to files of its own below `_temporary`; when all tasks are done the driver moves them to
their names, and whatever killed or repeated attempts have left goes with `_temporary`. Reading: a part is read by byte
ranges, so that its size bounds neither a task nor its memory, and a task reads many small parts.

Defined results: rows with null ids are left out; an empty list is a document of no tokens; documents stand in the order
of their keys (null keys first, rows of one key by a hash of their ids); no documents give no files.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.operators.staging import even_part, staged, with_ordinal

KINDS = {"uint32": "<u4", "uint16": "<u2"}
_NAME = re.compile(r"(?P<split>.+)-part-(?P<part>\d+)-of-(?P<parts>\d+)\.bin")
#: Tokens that a task reads, and that a batch holds.
TASK_TOKENS, BATCH_TOKENS = 32 << 20, 1 << 20


def file_system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there. Hadoop's name for S3 is understood too."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class _Span:
    file: str
    part: int
    first: int
    last: int
    tokens: int


@dataclass
class _Spans(InputPartition):
    """What a task reads: parts of few tokens come together, however many there are."""

    spans: list[_Span]


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[int, str, int, int]]  # part, path without suffix, documents, tokens


class TokenFiles(DataSource):
    """Options: path, split (`train`), dtype (`uint32`); to read, context (examples) or none (documents); to write, parts."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "part int, example long, inputs array<int>, targets array<int>" if self.options.get("context") else "part int, doc long, ids array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Files:
    def __init__(self, options: dict):
        self.path, self.split, self.kind = options["path"].rstrip("/"), options.get("split", "train"), KINDS[options.get("dtype", "uint32")]
        self.width = int(self.kind[-1])

    def of_split(self) -> list[tuple[int, str, int]]:
        """(part from 0, path without suffix, tokens) of the split's files."""
        at, root = file_system_of(self.path)
        found = []
        for info in at.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            m = _NAME.fullmatch(info.base_name)
            if m and m["split"] == self.split:
                found.append((int(m["part"]) - 1, info.path.removesuffix(".bin"), info.size // self.width))
        return sorted(found)


class _Reader(_Files, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.context, self.each, self.tasks = int(options.get("context", 0)), int(options.get("task_tokens", TASK_TOKENS)), int(options.get("tasks", 1))

    def partitions(self) -> list[InputPartition]:
        at, root = file_system_of(self.path)
        files = self.of_split()
        sizes = {} if self.context else {i.path.removesuffix(".idx"): i.size for i in at.get_file_info(fs.FileSelector(root, allow_not_found=True))}
        most = min(self.each, -(-sum(tokens for *_, tokens in files) // self.tasks))  # tokens of a task of several parts
        out, held = [], 0
        for part, file, tokens in files:
            if self.context:
                total, step = max(0, tokens - 1) // self.context, max(1, self.each // self.context)
            else:
                total = sizes[file] // self.width - 1
                step = max(1, -(-total * self.each // max(1, tokens)))
            for lo in range(0, total, step):
                span = _Span(file, part, lo, min(lo + step, total), tokens * min(step, total - lo) // total)
                if not out or held + span.tokens > most:
                    out.append(_Spans([]))
                    held = 0
                out[-1].spans.append(span)
                held += span.tokens
        return out or [_Spans([])]

    def read(self, task: _Spans) -> Iterator[pa.RecordBatch]:
        for span in task.spans:
            yield from self._examples(span) if self.context else self._documents(span)

    def _tokens(self, file, first: int, n: int) -> np.ndarray:
        file.seek(first * self.width)
        return np.frombuffer(file.read(n * self.width), self.kind).astype(np.int32)

    def _examples(self, span: _Span) -> Iterator[pa.RecordBatch]:
        at, _ = file_system_of(self.path)
        step = max(1, BATCH_TOKENS // self.context)
        with at.open_input_file(f"{span.file}.bin") as file:
            for lo in range(span.first, span.last, step):
                n = min(step, span.last - lo)
                ids = self._tokens(file, lo * self.context, n * self.context + 1)
                edges = pa.array(np.arange(0, (n + 1) * self.context, self.context, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (ids[:-1], ids[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, span.part, np.int32)), pa.array(np.arange(lo, lo + n)), *lists], names=["part", "example", "inputs", "targets"])

    def _documents(self, span: _Span) -> Iterator[pa.RecordBatch]:
        at, _ = file_system_of(self.path)
        with at.open_input_file(f"{span.file}.idx") as index:
            before = sum(int(self._tokens(index, lo, min(BATCH_TOKENS, span.first - lo)).sum(dtype=np.int64)) for lo in range(0, span.first, BATCH_TOKENS))
            sizes = self._tokens(index, span.first, span.last - span.first).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        with at.open_input_file(f"{span.file}.bin") as file:
            while lo < len(sizes):
                start = ends[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, start + BATCH_TOKENS, "right")))
                ids = self._tokens(file, before + int(start), int(ends[hi - 1] - start))
                edges = np.concatenate([[0], ends[lo:hi] - start]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, span.part, np.int32)), pa.array(np.arange(span.first + lo, span.first + hi)), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))], names=["part", "doc", "ids"]
                )
                lo = hi


class _Writer(_Files, DataSourceArrowWriter):
    """Rows (part, ids), sorted by part within a task; all rows of a part come to one task."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        self.overwrite, self.parts, self.job = overwrite, int(options["parts"]), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        at, root = file_system_of(self.path)
        own = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        at.create_dir(own, recursive=True)
        done: list[tuple[int, str, int, int]] = []
        part, tokens, docs, bin_, idx = None, 0, 0, None, None

        def close() -> None:
            if part is not None:
                idx.write(np.array([docs], self.kind).tobytes())
                bin_.close()
                idx.close()
                done.append((part, f"{own}/{part}", docs, tokens))

        for batch in iterator:
            which, lists = batch.column(0).to_numpy(), batch.column(1)
            edges = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if which[lo] != part:
                    close()
                    part, tokens, docs = int(which[lo]), 0, 0
                    bin_, idx = (at.open_output_stream(f"{own}/{part}.{kind}") for kind in ("bin", "idx"))
                run = lists.slice(lo, hi - lo)
                ids = run.flatten().to_numpy(zero_copy_only=False)
                if self.width == 2 and len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("a token does not fit into uint16")
                bin_.write(ids.astype(self.kind).tobytes())
                idx.write(np.diff(run.offsets.to_numpy()).astype(self.kind).tobytes())
                tokens, docs = tokens + len(ids), docs + hi - lo
        close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        at, root = file_system_of(self.path)
        made = sorted(p for m in messages if m for p in m.parts)
        if len({p for p, *_ in made}) < len(made):
            self.abort(messages)
            raise RuntimeError("two tasks wrote one part")
        if self.overwrite:
            for _, file, _ in self.of_split():
                for kind in ("bin", "idx"):
                    at.delete_file(f"{file}.{kind}")
        for part, file, _, _ in made:
            for kind in ("idx", "bin"):  # a part is there when its tokens are
                at.move(f"{file}.{kind}", f"{root}/{self.split}-part-{part + 1}-of-{self.parts}.{kind}")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        at, root = file_system_of(self.path)
        if at.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/_temporary/{self.job}")
        rest = f"{root}/_temporary"
        if at.get_file_info(rest).type == fs.FileType.Directory and not at.get_file_info(fs.FileSelector(rest)):
            at.delete_dir(rest)


def write_token_files(encoded: DataFrame, path: str, parts: int | None = None, docs_per_part: int | None = None, key: str = "doc_id", split: str = "train", dtype: str = "uint32") -> DataFrame:
    """Writes (key, ids) as token files; returns (part, doc, ids) of what was written.

    Documents are dealt in the order of their keys to contiguous parts: `parts` of near-equal numbers of documents, or of
    docs_per_part each. Only keys are ranked; the first of each part are known to all tasks, and the token lists
    shuffle once, to the task of their part.
    """
    spark = encoded.sparkSession
    rows = staged(encoded.filter(F.col("ids").isNotNull()).select(F.col(key).alias("key"), "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row")))
    order = ["key", "tie", "row"]
    ranked = with_ordinal(rows.select(*order), *order, to="_o")
    total = rows.count()
    if docs_per_part:
        parts, part = max(1, -(-total // docs_per_part)), F.floor(F.col("_o") / docs_per_part).cast("int")
    else:
        part = even_part(F.col("_o"), total, parts or 1)
        parts = max(1, min(parts or 1, total or 1))
    firsts = ranked.withColumn("part", part).groupBy("part").agg(F.min_by(F.struct(*order), "_o").alias("first")).collect()  # a row for each part
    bounds = [(r["first"]["key"] is not None, r["first"]["key"], r["first"]["tie"], r["first"]["row"]) for r in sorted(firsts, key=lambda r: r["part"])]
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def part_of(key: pa.Array, tie: pa.Array, row: pa.Array) -> pa.Array:
        ranks = zip(key.to_pylist(), tie.to_pylist(), row.to_pylist(), strict=True)
        return pa.array([bisect.bisect_right(shared.value, (k is not None, k, t, r)) - 1 for k, t, r in ranks], pa.int32())

    spark.dataSource.register(TokenFiles)
    dealt = rows.withColumn("part", part_of(*order)).repartition("part").sortWithinPartitions("part", *order)
    dealt.select("part", "ids").write.format("token_files").options(path=path, split=split, dtype=dtype, parts=parts).mode("overwrite").save()
    return documents_of(spark, path, split, dtype)


def _tasks(spark: SparkSession) -> int:
    """Tasks to read with, about: more where they would have over TASK_TOKENS."""
    return 4 * spark.sparkContext.defaultParallelism


def examples(spark: SparkSession, path: str, context: int, split: str = "train", dtype: str = "uint32", task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(part, example, inputs, targets): (tokens - 1) // context examples of each part, targets one token further."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(path=path, split=split, dtype=dtype, context=context, task_tokens=task_tokens, tasks=_tasks(spark)).load()


def documents_of(spark: SparkSession, path: str, split: str = "train", dtype: str = "uint32") -> DataFrame:
    """(part, doc, ids): the documents of each part, numbered from 0."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(path=path, split=split, dtype=dtype, tasks=_tasks(spark)).load()
