"""Block-compressed gzip text (BGZF) as many tasks a file.

Such a file is a row of gzip members of at most 64 kB that each say how long they are, so
a reader that starts anywhere can find the next member. Files are cut into byte ranges; a
range owns the members that begin in it. Lines cross members: as with any split text,
every range but a file's first leaves its first line to the range before it, which reads
on until its last line ends.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes of a task, and of one read.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Lines of text in one batch.
BATCH_BYTES = 4 << 20
MAGIC, MOST_MEMBER, MEMBER_BYTES = b"\x1f\x8b\x08\x04", 1 << 16, 65_000
SCHEMA = "file string, line_no bigint, value string"


def member_size(data: bytes, at: int) -> int | None:
    """Length of the member whose header is at ``at``; None if none is there."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return None
    field, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while field + 4 <= min(end, len(data)):
        name, size = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
        if name == b"BC" and size == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def member(text: bytes) -> bytes:
    """One member holding ``text`` (at most about 64 kB)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(text) + packer.flush()
    head = MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(text), len(text))


def compress(text: bytes, each: int = MEMBER_BYTES) -> bytes:
    """Members of ``each`` bytes of text and the empty one that marks the end."""
    return b"".join(member(text[i : i + each]) for i in range(0, len(text), each)) + member(b"")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path names, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    system, inner = _located(path)
    return system.open_input_file(inner)


def _first_member(source, start: int, size: int) -> int | None:
    """Where the first member at or after ``start`` begins. A header counts if another one, or the end, follows it."""
    source.seek(start)
    data = source.read(2 * MOST_MEMBER + 64)
    at = data.find(MAGIC)
    while at >= 0:
        length = member_size(data, at)
        if length and (start + at + length == size or member_size(data, at + length)):
            return start + at
        at = data.find(MAGIC, at + 1)
    return None


def _members(source, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the members from ``at`` on."""
    held, base = b"", at
    source.seek(at)
    while at < size:
        length = member_size(held, at - base)
        if length is None or at - base + length > len(held):
            held, base = held[at - base :], at
            more = source.read(READ_BYTES)
            if not more:
                raise ValueError(f"a member at byte {at} is cut short")
            held += more
            continue
        begin = at - base
        skip = 12 + struct.unpack_from("<H", held, begin + 10)[0]
        yield at, zlib.decompress(held[begin + skip : begin + length - 8], -15)
        at += length


def _whole(source) -> Iterator[tuple[int, bytes]]:
    """Ordinary gzip: text in pieces, in one go; the offsets only keep lines apart and in order."""
    source.seek(0)
    unpacker, number = zlib.decompressobj(31), 0
    while data := source.read(READ_BYTES):
        while data:
            text = unpacker.decompress(data, MOST_MEMBER - 1)
            if text:
                yield number, text
                number += 1
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data, unpacker = unpacker.unused_data, zlib.decompressobj(31)


def range_lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(line number, line) of the lines of a byte range; numbers grow along the file (member's offset, place in its text)."""
    with _open(path) as source:
        size = source.size()
        split = member_size(source.read(4096), 0) is not None
        if not split and start > 0:
            return  # one stream: the first range reads it all
        at = (0 if start == 0 else _first_member(source, start, size)) if split else 0
        if at is None or at >= end:
            return
        rest, rest_at, skipping = b"", at << 16, at > 0
        for offset, text in _members(source, at, size) if split else _whole(source):
            past = split and offset >= end
            if past and skipping:
                return  # no line begins in this range
            pieces, place = text.split(b"\n"), offset << 16
            for i, piece in enumerate(pieces[:-1]):
                if skipping:
                    skipping = False
                else:
                    yield rest_at, rest + piece
                    if past:
                        return
                place += len(piece) + 1
                rest, rest_at = b"", place
            if not skipping:
                rest += pieces[-1]
        if rest and not skipping:
            yield rest_at, rest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(path, numbers, lines):
        texts = [x.decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(lines), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["file", "line_no", "value"]
        )

    for ranges in batches:
        for r in ranges.to_pylist():
            numbers, lines, held = [], [], 0
            for number, line in range_lines(r["path"], r["start"], r["end"]):
                numbers.append(number)
                lines.append(line)
                held += len(line)
                if held >= BATCH_BYTES:
                    yield batch(r["path"], numbers, lines)
                    numbers, lines, held = [], [], 0
            if lines:
                yield batch(r["path"], numbers, lines)


def read_block_gzip(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, line_no, value`` of gzip text, one task for each ``range_bytes`` of a block-compressed file.

    Carriage returns are removed. A gzip file without block lengths is one task. Only names
    and sizes are listed first. The tasks open the files themselves, so the paths must be
    of a file system that Arrow knows (local or mounted, S3, GCS, HDFS).
    """
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    ranges = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + range_bytes)
    tasks = listed.agg(F.sum(F.ceil(F.greatest("length", F.lit(1)) / range_bytes))).first()[0] or 1
    read = ranges.repartition(int(tasks)).mapInArrow(_read, SCHEMA)
    return read.withColumn("value", F.regexp_replace("value", "\r+$", ""))


def write_block_gzip(lines: DataFrame, path: str) -> None:
    """The ``value`` column as block-compressed text, one file for each partition of ``lines``, in its order.

    A file appears under its name when it is whole, so a repeated task replaces it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, folder = _located(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():05d}.gz"
        draft, rows = f"{folder}/.draft-{context.taskAttemptId()}", 0
        with system.open_output_stream(draft, compression=None) as out:
            held = b""
            for batch in batches:
                rows += len(batch)
                held += b"".join(f"{x or ''}\n".encode("utf-8", "surrogatepass") for x in batch.column("value").to_pylist())
                whole = len(held) - len(held) % MEMBER_BYTES
                for at in range(0, whole, MEMBER_BYTES):
                    out.write(member(held[at : at + MEMBER_BYTES]))
                held = held[whole:]
            out.write(member(held) + member(b"") if held else member(b""))
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    lines.select("value").mapInArrow(write, "rows bigint").count()
