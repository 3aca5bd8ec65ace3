"""Data source 'rawimage': byte ranges of raw images as rows (image_id, offset, length, data), split over tasks.

Options: path (a file or block device that every worker can open, or a folder of parts that write_parts() laid down on any file system pyarrow knows), start, end (0: to the end), tile (bytes of a row), overlap (bytes that each row
repeats of the next one), stride (0: rows follow one another; otherwise a row of tile bytes at every stride), partition_bytes, image_id.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import small_batches

SCHEMA = "image_id string, offset bigint, length int, data binary"
TILE, PARTITION = 4 << 20, 64 << 20
#: Bytes of a part of a split image; the note that tells a split image's sizes.
PART, NOTE = 4 << 20, "image.json"
#: Codec and level of parts that get smaller by it.
PACKED = ("zstd", 1)
#: Bytes of a local file's blocks that aren't written where they are zeros.
HOLE = 4096
_ZEROS = bytes(HOLE)


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class ImageFile:
    """A raw image to seek in and read from: a file or block device, or a folder of parts of equal size (a part that isn't there is zeros, one whose file is shorter is packed)."""

    def __init__(self, path: str):
        self.fs, self.root = located(path)
        self.file, self.place, self.opened = None, 0, {}
        note = f"{self.root}/{NOTE}"
        if isinstance(self.fs, pyarrow.fs.LocalFileSystem) and not os.path.isdir(self.root):
            self.file = open(self.root, "rb")  # noqa: SIM115
            self.bytes = os.fstat(self.file.fileno()).st_size or self.file.seek(0, os.SEEK_END)
        else:
            with self.fs.open_input_stream(note) as f:
                told = json.loads(f.read())
            self.bytes, self.part = told["bytes"], told["part_bytes"]

    def __enter__(self) -> ImageFile:
        return self

    def __exit__(self, *error) -> None:
        for f in [self.file, *self.opened.values()]:
            if f is not None:
                f.close()

    def seek(self, place: int) -> None:
        self.place = place

    def read(self, n: int) -> bytes:
        if self.file is not None:
            self.file.seek(self.place)
            out = self.file.read(n)
        else:
            pieces, at, stop = [], self.place, min(self.place + n, self.bytes)
            while at < stop:
                inner = at % self.part
                take = min(stop - at, self.part - inner)
                pieces.append(self._piece(at // self.part, inner, take))
                at += take
            out = b"".join(pieces)
        self.place += len(out)
        return out

    def _piece(self, i: int, inner: int, n: int) -> bytes:
        if i not in self.opened:
            while len(self.opened) > 3:  # the oldest
                old = self.opened.pop(next(iter(self.opened)))
                if old is not None:
                    old.close()
            name = f"{self.root}/{part_name(i)}"
            info, length = self.fs.get_file_info(name), min(self.part, self.bytes - i * self.part)
            found = self.fs.open_input_file(name) if info.type == pyarrow.fs.FileType.File else None
            if found is not None and info.size < length:
                with found as f:
                    found = pa.BufferReader(pa.Codec(*PACKED).decompress(f.read(), length))
            self.opened[i] = found
        f = self.opened[i]
        return bytes(n) if f is None else f.read_at(n, inner).ljust(n, b"\x00")


class SparseFile:
    """A new local file to write to from start to end: blocks of zeros are passed over, so they take no disk where the file system has holes."""

    def __init__(self, path: str):
        self.file, self.held = open(path, "wb"), b""  # noqa: SIM115

    def __enter__(self) -> SparseFile:
        return self

    def __exit__(self, *error) -> None:
        with self.file as f:
            f.write(self.held)
            f.truncate(f.tell())

    def write(self, data: bytes) -> None:
        """Whole blocks go to the file, what is left waits for more."""
        data = self.held + data
        whole, start = len(data) // HOLE * HOLE, 0
        for at in range(0, whole, HOLE):
            if data[at : at + HOLE] == _ZEROS:
                self.file.write(data[start:at])
                self.file.seek(HOLE, os.SEEK_CUR)
                start = at + HOLE
        self.file.write(data[start:whole])
        self.held = data[whole:]


def new_file(fs: pyarrow.fs.FileSystem, path: str):
    """A new file to write to in pieces; a local one leaves zeros out (SparseFile)."""
    return SparseFile(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_output_stream(path)


def part_name(i: int) -> str:
    return f"{i:010d}.part"


def write_parts(pieces: DataFrame, size: int, folder: str, part: int = PART) -> str:
    """Lays pieces (place, data) that don't overlap into an image of `size` bytes, as parts in a new folder; the folder's path. Between pieces are zeros.

    Pieces are cut at part borders and dealt by part, so that every part is one task's work and a piece may be larger than many. A part is written under a name of its
    own and renamed, so repeated tasks do no harm; the note that makes the folder an image is written last. A part of zeros isn't written, and a part is packed where that makes it smaller.
    """
    fs, root = located(folder)
    fs.create_dir(root)
    small_batches(pieces.sparkSession)
    length = F.octet_length("data")
    at = pieces.where(length > 0).select("place", "data", F.explode(F.sequence(F.floor(F.col("place") / part), F.floor((F.col("place") + length - 1) / part))).alias("part"))
    cut = at.select("part", F.greatest(F.lit(0), F.col("place") - F.col("part") * part).alias("inner"), F.expr(f"substring(data, CAST(greatest(0, part * {part} - place) + 1 AS INT), CAST({part} - greatest(0, place - part * {part}) AS INT))").alias("data"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, _ = located(folder)
        held, now, done = bytearray(), None, []

        def close() -> None:
            done.append(len(held))
            if held.count(0) == len(held):
                return
            name = f"{root}/{part_name(now)}"
            part_file, packed = f"{name}.{uuid.uuid4().hex}", pa.Codec(*PACKED).compress(bytes(held))
            with target.open_output_stream(part_file) as f:
                f.write(packed if packed.size < len(held) else bytes(held))
            target.move(part_file, name)

        for batch in batches:
            for i, inner, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != now:
                    if now is not None:
                        close()
                    held, now = bytearray(min(part, size - i * part)), i
                held[inner : inner + len(data)] = data
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([sum(done)], pa.int64())], ["n"])

    cut.repartition("part").sortWithinPartitions("part", "inner").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row
    with fs.open_output_stream(f"{root}/{NOTE}") as f:
        f.write(json.dumps({"bytes": size, "part_bytes": part}).encode())
    return folder


def input_size(path: str) -> int:
    """Bytes of a file, a split image, or of a device by a seek to its end."""
    with ImageFile(path) as f:
        return f.bytes


def clamp(start: int, end: int, size: int) -> tuple[int, int]:
    """The range within the input; an end of 0 is the input's."""
    end = size if end <= 0 else min(end, size)
    return max(0, min(start, end)), end


class RangePartition(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RawImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default: int(options.get(name, default))
        self.path, self.image_id = options["path"], options.get("image_id") or options["path"]
        self.tile, self.overlap, self.stride = number("tile", TILE), number("overlap", 0), number("stride", 0)
        self.size = input_size(self.path)
        self.start, self.end = clamp(number("start", 0), number("end", 0), self.size)
        step = self.stride or self.tile
        self.share = max(step, number("partition_bytes", PARTITION) // step * step)

    def partitions(self) -> list[InputPartition]:
        """Ranges of whole steps, so the rows don't depend on how they are split."""
        return [RangePartition(a, min(a + self.share, self.end)) for a in range(self.start, self.end, self.share)] or [RangePartition(self.start, self.start)]

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        step = self.stride or self.tile
        with ImageFile(self.path) as f:
            for at in range(partition.start, partition.end, step):
                f.seek(at)
                own = min(self.tile, self.end - at)
                data = f.read(own if self.stride else own + self.overlap)
                yield self.image_id, at, min(own, len(data)), data


class RawImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawImageReader(dict(self.options))


def read_image(spark: SparkSession, path: str, **options) -> DataFrame:
    """A raw image's tiles."""
    spark.dataSource.register(RawImageSource)
    return spark.read.format("rawimage").options(path=path, **options).load()
