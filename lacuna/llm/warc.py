"""WARC archives: records compressed one by one with a Zstandard dictionary that leads the file in a skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialise, shared_dir, small_batches, small_slices, table

#: Magic of the skippable frame that holds a dictionary in .warc.zst files, and of a plain Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that an archive's dictionary is trained on, its size, and bytes of payload after which an archive is closed.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 1 << 20, 32 << 10, 256 << 20
#: Bytes of the pieces that a dictionary learns from where the sample has fewer than 8 records.
PIECE_BYTES = 16 << 10
#: Equal payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000


def header_value(text: str) -> str:
    """text without line ends, such that plain_value() gives it back."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain_value(value: str | None) -> str | None:
    return value if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def build_record(urn: str, name: str | None, url: str | None, payload: bytes, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record of a name of its own: a response, or a revisit (the HTTP head alone) of another page's response if refers_to is given."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, urn)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("WARC-Refers-To-Target-URI", None if refers_to is None or refers_url is None else refers_url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Refers-To-Date", None if refers_to is None else date),
        ("X-Page-Id", None if name is None else header_value(name)),
        ("X-Refers-To-Page-Id", None if refers_to is None else header_value(refers_to)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from sample records, smaller where they are few; where they are too few or too alike for training, their own first bytes are the dictionary."""
    content = b"".join(samples)[:size]
    while len(samples) >= 8 and size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=200, d=8)
        except zstandard.ZstdError:
            size //= 4
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one .warc.zst: records wait until the sample is full, then the dictionary frame and all records go out."""

    def __init__(self, sink, sample_bytes: int, dictionary_bytes: int, level: int):
        self.sink, self.sample_bytes, self.dictionary_bytes, self.level = sink, sample_bytes, dictionary_bytes, level
        self.waiting: list[bytes] | None = []
        self.size = self.records = 0

    def add(self, record: bytes) -> None:
        self.size, self.records = self.size + len(record), self.records + 1
        if self.waiting is None:
            self.sink.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        if self.size >= self.sample_bytes:
            self._begin()

    def _begin(self) -> None:
        waiting, self.waiting = self.waiting, None
        samples = waiting
        if len(samples) < 8:  # large records: the first bytes of each, up to sample_bytes in all
            share = self.sample_bytes // max(1, len(waiting))
            samples = [r[at : min(at + PIECE_BYTES, share)] for r in waiting for at in range(0, min(len(r), share), PIECE_BYTES)]
        dictionary = train_dictionary(samples, self.dictionary_bytes)
        packed = zstandard.ZstdCompressor(level=self.level).compress(dictionary.as_bytes())
        self.sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True)
        for record in waiting:
            self.sink.write(self.compressor.compress(record))

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.sink.close()


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an open .warc.zst."""
    lead, dictionary = source.read(8), None
    if len(lead) == 8 and struct.unpack("<II", lead)[0] == DICTIONARY_MAGIC:
        raw, lead = source.read(struct.unpack("<II", lead)[1]), b""
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)

    class Rest(io.RawIOBase):  # what was read ahead, then the rest of the file
        def readable(self):
            return True

        def readinto(self, buffer):
            nonlocal lead
            got = lead or source.read(len(buffer))
            lead = b""
            buffer[: len(got)] = got
            return len(got)

    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BufferedReader(Rest(), 1 << 20), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 18)
    while first := stream.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record without its end")
        yield fields, block


def _write(folder: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, at, writer, archive = TaskContext.get(), 0, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{archive}"], "records": [writer.records - 1], "bytes": [writer.size]})

        for batch in small_slices(batches):
            for name, url, payload, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    archive = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{at}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{root}/{archive}", compression=None), sample_bytes, dictionary_bytes, level)
                    writer.add(info_record(date))
                writer.add(build_record(f"{archive}:{writer.records}", name, url, payload, refers_to, refers_url, date))
                if writer.size >= archive_bytes:
                    yield closed()
                    writer, at = None, at + 1
        if writer is not None:
            yield closed()

    return run


def revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(name, digest, refers_to, refers_url) of the pages (name, url, payload) whose payload, of `least` bytes or more, a page of larger name holds too.

    Digests, names and urls alone are shuffled, those of a payload that very many pages have not even that (join_hot). Rows repeated with the largest name stay responses all; a null name refers
    to any other and is never referred to.
    """
    ids = pages.select("name", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least).drop("n")
    ids = materialise(ids)
    keepers = ids.groupBy("digest").agg(F.max(F.when(F.col("name").isNotNull(), F.struct("name", "url"))).alias("_k"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keepers = keepers.select("digest", F.col("_k.name").alias("refers_to"), F.col("_k.url").alias("refers_url"), "n")
    found = join_hot(ids.drop("url"), ids.count(), keepers, "digest", "n").where("refers_to IS NOT NULL AND NOT (name <=> refers_to)")
    return materialise(found.select("name", "digest", "refers_to", "refers_url").distinct())


def write_archives(df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str, *, least_shared: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of df into .warc.zst files of folder (any URI pyarrow opens); returns the manifest (archive, records, bytes).

    The payload is the column's UTF-8 bytes (or bytes), null as empty. Of equal payloads of least_shared bytes or more the row of the largest
    id is the response and the others are revisits of it. A task streams its rows into archives of its own, each
    with a dictionary trained on its first sample_bytes of records; a retried task writes new files, and only files
    that the manifest (itself written durably) names count. Payloads meet their revisit row by id, not by digest, so thousands of
    copies don't meet in one task. Null urls have no target field. An empty df gives an empty manifest.
    """
    small_batches(df.sparkSession)
    pages = df.select(F.col(id_col).alias("name"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    again = revisits(pages, least_shared).select(F.col("name").alias("other"), F.col("digest").alias("same"), "refers_to", "refers_url")
    joined = pages.join(again, pages["name"].eqNullSafe(again["other"]) & (F.sha1(pages["payload"]) == again["same"]), "left")
    rows = joined.select(F.col("name").cast("string").alias("name"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "refers_url")
    return materialise(rows.mapInArrow(_write(folder, archive_bytes, sample_bytes, dictionary_bytes, level, date), "archive string, records long, bytes long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())])
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            fs, path = pyarrow.fs.FileSystem.from_uri(archive)
            out: list[tuple] = []
            with fs.open_input_stream(path, compression=None) as source:
                for fields, block in read_records(source):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    whole = fields["warc-type"] == "revisit" or (len(payload) == length and hashlib.sha1(payload).hexdigest() == digest)
                    out.append((plain_value(fields.get("x-page-id")), fields.get("warc-target-uri"), length, digest, fields["warc-type"], plain_value(fields.get("x-refers-to-page-id")), whole))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The index of all records of a manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to (ids as strings), intact.

    intact is false where a response's payload doesn't have the length and digest its record states.
    """
    n = min(max(manifest.count(), 1), 4000)
    return manifest.select("archive").repartition(n, "archive").mapInArrow(_read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives of all rows of pages; null html is an empty payload, repeated rows are records of their own."""
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    found = read_archives(write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", folder))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= {LEAST_SHARED} GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM p LEFT JOIN k USING (payload_digest)
"""
