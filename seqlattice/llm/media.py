"""Media columns: images in archives on shared storage, written and read by a custom Spark data source.

``format("image_archives")`` has both directions.  The writer streams record batches of ``name, payload`` into zip archives,
each payload as a grey 8-bit PNG, lossless.  Every task writes files of its own; the driver's commit writes the list of
archives that count, so lost or repeated tasks leave nothing behind that is read.  The reader plans byte ranges over the
archives of a directory, reads the members whose headers start in its range by their offsets, and yields Arrow batches;
each member is retried on its own.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .session import new_folder
from .words import pieces

#: Pixels in a row; payloads are whole rows.
WIDTH = 192
FORMAT = "image_archives"
_LIST = "_archives.json"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of a text, filled with spaces to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Grey 8-bit PNG whose pixels, row by row, are the payload's bytes."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(pixels), WIDTH + 1), np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = pixels
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The payload of :func:`to_png`; raises ValueError if a checksum or the size doesn't hold."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, height, data = 8, 0, []
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum of a chunk differs")
        if kind == b"IHDR":
            height = struct.unpack(">I", body[4:8])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("row filter other than none")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Level histogram in eight bins, sum of all levels and of the steps between neighbours in a row."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bins = np.bincount(pixels.ravel() >> 5, minlength=8)
    steps = int(np.abs(np.diff(pixels.astype(np.int16), axis=1)).sum())
    return f"{','.join(map(str, bins))};{int(pixels.sum())};{steps}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or path; s3a:// names the same store as s3://."""
    try:
        return pafs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"{uri}: archives need a path, or a URI of one of the schemes file, hdfs, viewfs, s3, s3a, gs, abfs and abfss") from e


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    """Members whose local header starts in [start, end) of an archive."""

    path: str
    start: int
    end: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, archive_bytes: int):
        self.uri, self.archive_bytes = uri, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = file_system(self.uri)
        fs.create_dir(folder)
        done: list[tuple[str, int]] = []
        out = archive = None
        for batch in iterator:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    own = f"{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{folder}/{own}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(name), to_png(payload))
                if archive.fp.tell() >= self.archive_bytes:
                    archive.close()
                    size, archive = out.tell(), out.close()
                    done.append((own, size))
        if archive is not None:
            archive.close()
            size = out.tell()
            out.close()
            done.append((own, size))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, folder = file_system(self.uri)
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/{_LIST}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Nothing to undo: what no list names is never read."""


class _Reader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int, attempts: int):
        self.uri, self.range_bytes, self.attempts = uri, range_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        fs, folder = file_system(self.uri)
        with fs.open_input_stream(f"{folder}/{_LIST}") as f:
            archives = json.loads(f.read())
        return [ByteRange(path, start, min(start + self.range_bytes, size)) for path, size in archives for start in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, folder = file_system(self.uri)
        path = f"{folder}/{part.path}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = sorted((i.header_offset, i.filename, i.file_size) for i in archive.infolist() if part.start <= i.header_offset < part.end)
        rows, size, file = [], 0, None
        for offset, name, length in members:
            image, error, file = self._member(fs, path, offset, length, file)
            rows.append((part.path, offset, name, image, error))
            size += length
            if size > 4_000_000:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _member(self, fs: pafs.FileSystem, path: str, offset: int, length: int, file: pa.NativeFile | None) -> tuple[bytes | None, str | None, pa.NativeFile | None]:
        """One member by its offset, and the open file; a failure is tried again on a file opened anew, and reported at last."""
        error = None
        for attempt in range(self.attempts):
            try:
                file = file or fs.open_input_file(path)
                head = file.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member starts here")
                name, extra = struct.unpack("<HH", head[26:30])
                image = file.read_at(length, offset + 30 + name + extra)
                from_png(image)
                return image, None, file
            except (OSError, ValueError, zlib.error, struct.error) as e:
                error, file = f"{type(e).__name__}: {e}", None
                time.sleep(0.05 * attempt)
        return None, error, file

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "image", "error"])


class ImageArchives(DataSource):
    """Zip archives of PNG images under ``path``; options ``archive_bytes``, ``range_bytes``, ``attempts``.

    Reading gives ``archive, offset, name, image, error``: a member that cannot be read after ``attempts`` tries has a null
    image and its error, and the others are unaffected.  Writing takes ``name string, payload binary``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, offset bigint, name string, image binary, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options.get("range_bytes", 8 << 20)), int(self.options.get("attempts", 3)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", 64 << 20)))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches):
        names = [f"{'null' if i is None else i}/{len((t or '').encode())}" for i, t in zip(rows["doc_id"], rows["text"], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([padded(t) for t in rows["text"]], pa.binary())], names=["name", "payload"])


def store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 64 << 20) -> None:
    """Write each row's text, padded, as an image ``<id>/<bytes before padding>`` into archives under ``path`` (a URI or path).

    Null and empty texts become one row of spaces; a null id is named ``null``; repeated rows are members of their own.
    """
    docs.sparkSession.dataSource.register(ImageArchives)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_payloads, "name string, payload binary")
    rows.write.format(FORMAT).mode("append").option("archive_bytes", archive_bytes).save(path)


def load(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Members under ``path``: ``archive, offset, name, image, error``."""
    spark.dataSource.register(ImageArchives)
    reader = spark.read.format(FORMAT)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
    for batch in batches:
        rows = []
        for name, image, error in zip(batch.column("name").to_pylist(), batch.column("image").to_pylist(), batch.column("error").to_pylist(), strict=True):
            own, n = name.split("/")
            key = None if own == "null" else int(own)
            if image is None:
                rows.append((key, int(n), None, None, None, None, None, None, error))
                continue
            payload = from_png(image)
            rows.append((key, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of stored members, computed from the bytes read back; an unread member has nulls and its error."""
    return members.select("name", "image", "error").mapInArrow(_features, _FEATURES)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every row's text as an image in a folder of its own in the shared one, and return what is read back.

    The folder stays, as the result is read from it.
    """
    path = new_folder(docs.sparkSession, "media")
    store(docs, path, id_col=id_col, text_col=text_col)
    return media_features(load(docs.sparkSession, path))
