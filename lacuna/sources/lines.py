"""Text files of any size as numbered lines: splits cut at line ends, a count of each, and what stands before."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .rawimage import located

SPLIT, READ = 64 << 20, 4 << 20
#: Bytes that a task reads of splits smaller than that, and how many splits at most; bytes beyond a small split that are read at once for its last line.
TASK_BYTES, TASK_SPLITS, LINE = 16 << 20, 10_000, 4096
#: Splits whose counts are sent to every task at most.
SENT_SPLITS = 1_000_000
LINES, COUNTS = "line_file string, split bigint, at bigint, line string", "line_file string, split bigint, n bigint"


class Piece(InputPartition):
    """Splits (path, number, start, end) that one task reads."""

    def __init__(self, splits: list[tuple[str, int, int, int]]):
        self.splits = splits


def count_starts(f, start: int, end: int) -> int:
    """Lines that begin in start..end of a file: at its start, or behind a line feed."""
    n, at = int(start == 0 and end > 0), max(0, start - 1)
    while at < end - 1:
        block = f.read_at(min(READ, end - 1 - at), at)
        n, at = n + block.count(b"\n"), at + len(block)
    return n


def line_lists(f, start: int, end: int, read_bytes: int = READ) -> Iterator[list[bytes]]:
    """The lines, without their ends (a line feed, or that and a carriage return before it), that begin in start..end; the last one may reach beyond."""
    at = start
    while start and at < end:  # to behind the first line feed from start - 1 on
        block = f.read_at(read_bytes, at - 1)
        found = block.find(b"\n")
        if found >= 0:
            at += found
            break
        at = at + len(block) if block else end
    held, read = [], at
    while at < end:
        block = f.read_at(read_bytes, read)
        read += len(block)
        cut = block.rfind(b"\n")
        if block and cut < 0:
            held.append(block)
            continue
        whole = b"".join(held) + (block[:cut] if block else b"")
        lines = whole.split(b"\n") if block or whole else []
        kept, size = [], 0
        for line in lines:
            if at + size >= end:
                break
            kept.append(line[:-1] if line.endswith(b"\r") else line)
            size += len(line) + 1
        yield kept
        if not block or len(kept) < len(lines):
            return
        at += len(whole) + 1
        held = [block[cut + 1 :]]


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.size, self.counts = json.loads(options["files"]), int(options["split_bytes"]), options.get("counts") == "true"

    def partitions(self) -> list[InputPartition]:
        """Splits in a row, so many that a task has TASK_BYTES or a split: small splits don't make small tasks. An empty file has none."""
        pieces, held, left = [], [], 0
        for path, n in self.files:
            for i, a in enumerate(range(0, n, self.size)):
                z = min(a + self.size, n)
                if z - a > left or len(held) >= TASK_SPLITS:
                    held, left = [], max(TASK_BYTES, z - a)
                    pieces.append(Piece(held))
                held.append((path, i, a, z))
                left -= z - a
        return pieces or [Piece([])]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        for path, splits in itertools.groupby(piece.splits, key=lambda x: x[0]):
            fs, place = located(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
            with fs.open_input_file(place) as f:
                yield from self.counted(f, path, list(splits)) if self.counts else itertools.chain.from_iterable(self.lines(f, *split) for split in splits)

    def counted(self, f, path: str, splits: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"line_file": [path] * len(splits), "split": [x[1] for x in splits], "n": [count_starts(f, x[2], x[3]) for x in splits]})

    def lines(self, f, path: str, split: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        at = 0
        for lines in line_lists(f, start, end, min(READ, self.size + LINE)):
            for lo in range(0, len(lines), 10_000):
                part = [x.decode("utf-8", "replace") for x in lines[lo : lo + 10_000]]
                yield pa.RecordBatch.from_pydict({"line_file": [path] * len(part), "split": [split] * len(part), "at": list(range(at, at + len(part))), "line": part})
                at += len(part)


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "splitlines"

    def schema(self) -> str:
        return COUNTS if self.options.get("counts") == "true" else LINES

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(dict(self.options))


def numbered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(line_file, line_no from 1, line) of text files: a line ends with a line feed, or that and a carriage return before it; the last one needs no end, and an empty file has none.

    A file is cut into splits of split_bytes; a line belongs to the split in which it begins. Splits are counted first (line feeds alone); the number of a line is
    its place in its split and the sum of the counts of the file's splits before. Bytes that aren't UTF-8 become replacement characters.
    """
    spark.dataSource.register(LinesSource)
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # names and sizes, no contents
    source = spark.read.format("splitlines").option("files", json.dumps(files)).option("split_bytes", split_bytes)
    before = Window.partitionBy("line_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = source.option("counts", "true").load().select("line_file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    splits = sum(-(-n // split_bytes) for _, n in files)
    lines = source.option("counts", "false").load().join(F.broadcast(counts) if splits <= SENT_SPLITS else counts, ["line_file", "split"])
    return lines.select("line_file", (F.col("before") + F.col("at") + 1).alias("line_no"), "line")
