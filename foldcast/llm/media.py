"""Media columns: lossless 8-bit images in archives, read by a custom Spark data source.

A payload becomes an 8-bit greyscale PNG, 192 samples a row. Tasks write PNGs into ZIP archives (stored, as they are
compressed already) in the shared folder and report each finished archive; only reported archives are read, so what a
lost or repeated task leaves behind is ignored. The data source cuts every archive into byte ranges; the task of a
range takes the members of the archive's central directory whose offset is in it, and streams them in Arrow batches of
bounded size. A member that can't be read is tried again by its offset on a fresh handle, without the others; one that
stays damaged fails the read, or, if so asked, becomes a row with an error instead of a payload.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Workspace, flat_bytes, read, slices

WIDTH, UNIT = 192, 192
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 64 << 20, 16 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes) -> bytes:
    """An 8-bit greyscale image whose samples are the payload (a positive multiple of WIDTH bytes)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that png() made; a damaged one raises ValueError."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, width, height = 8, [], 0, 0
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        part = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", part)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError(f"not 8-bit greyscale: {form}")
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)


class _Archives:
    """Writes members into archives of about ARCHIVE_BYTES in a folder; ``done`` lists the finished ones."""

    def __init__(self, folder: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.zip, self.done = None, []

    def add(self, name: str, body: bytes) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.file = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.zip, self.count, self.size = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED), 0, 0
        self.zip.writestr(zipfile.ZipInfo(f"{self.count}-{name}.png"), body)
        self.count, self.size = self.count + 1, self.size + len(body)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.file.close()
            self.done.append((self.name, self.fs.get_file_info(f"{self.folder}/{self.name}").size, self.count))
            self.zip = None


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image; gives (archive, bytes, members) of each finished archive. Must run once, by writing it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(folder)
        for whole in batches:
            for batch in slices(whole, "t", BATCH_BYTES):
                data, offsets = flat_bytes(batch.column("t"))
                for i, who in enumerate(batch.column("d").to_pylist()):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    out.add(f"{'' if who is None else who}_{len(text)}", png(padded(text)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out.done], pa.string()), pa.array([x[1] for x in out.done], pa.int64()), pa.array([x[2] for x in out.done], pa.int64())], names=["archive", "bytes", "members"])

    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1])
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "archive string, bytes long, members long")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        super().__init__(f"{archive}:{start}")
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"], options["manifest"]
        self.tries = int(options.get("tries", TRIES))
        self.keep = options.get("damaged", "fail") == "keep"
        self.step = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[_Range]:
        import pyarrow.dataset

        fs, where = pa.fs.FileSystem.from_uri(self.manifest)
        files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(where)) if f.path.endswith(".parquet")]
        found = pyarrow.dataset.dataset(files, filesystem=fs, format="parquet").to_table(columns=["archive", "bytes"]) if files else None
        ranges = [_Range(a, lo, lo + self.step) for a, n in zip(*(found.column(c).to_pylist() for c in ("archive", "bytes"))) for lo in range(0, n, self.step)] if found is not None else []
        return ranges or [_Range("", 0, 0)]

    def _member(self, path: str, fs, info: zipfile.ZipInfo) -> tuple[bytes | None, bytes | None, str | None]:
        """(stored form, payload, error) of one member by its offset alone."""
        for attempt in range(self.tries):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member starts here")
                    f.seek(info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                    body = f.read(info.compress_size)
                if zlib.crc32(body) != info.CRC:
                    raise ValueError("checksum differs")
                return body, samples(body), None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                if attempt == self.tries - 1:
                    if self.keep:
                        return None, None, f"{type(e).__name__}: {e}"
                    raise
        raise AssertionError

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, folder = pa.fs.FileSystem.from_uri(self.folder)
        path = f"{folder}/{partition.archive}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]
        held: list[tuple] = []
        size = 0
        with fs.open_input_file(path) as f:
            for m in members:
                try:
                    f.seek(m.header_offset + 26)
                    f.seek(m.header_offset + 30 + sum(struct.unpack("<HH", f.read(4))))
                    body = f.read(m.compress_size)
                    if zlib.crc32(body) != m.CRC:
                        raise ValueError("checksum differs")
                    payload, error = samples(body), None
                except (OSError, ValueError, zlib.error, struct.error):
                    body, payload, error = self._member(path, fs, m)
                who, length = m.filename.removesuffix(".png").split("-", 1)[1].rsplit("_", 1)
                held.append((int(who) if who else None, int(length), partition.archive, m.header_offset, body, payload, error))
                size += len(body or b"") + len(payload or b"")
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


SCHEMA = "doc_id long, n_bytes long, archive string, offset long, media binary, payload binary, error string"
_TYPES = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("error", pa.string()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], names=[n for n, _ in _TYPES])


class MediaSource(DataSource):
    """Options: path (folder of the archives), manifest (Parquet folder that lists them), rangeBytes, tries, damaged (fail or keep).

    With damaged = keep a member that can't be read after all tries has an error and neither media nor payload.
    """

    @classmethod
    def name(cls) -> str:
        return "foldcast_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def feature(payload: bytes) -> str:
    """Mean and spread of the samples in thousandths, and a difference hash of the means of 65 even parts of the payload."""
    x = np.frombuffer(payload, np.uint8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    edges = np.arange(66) * n // 65
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    parts, sizes = sums[edges[1:]] - sums[edges[:-1]], np.diff(edges)
    rises = parts[1:] * sizes[:-1] > parts[:-1] * sizes[1:]
    return f"mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};dhash={np.packbits(rises).tobytes().hex()}"


def features(media: DataFrame) -> DataFrame:
    """The rows of the data source with a feature string, computed from the payload that was read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if p is None else feature(p) for p in batch.column("payload").to_pylist()], pa.string())], names=[*batch.schema.names, "feature"])

    return media.mapInArrow(run, SCHEMA + ", feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: str = "fail") -> DataFrame:
    """Store every whole text as an image and read it back: doc_id, n_bytes, archive, offset, media, payload, error, feature.

    A member that is damaged for good fails the read, or with damaged = "keep" has an error and neither media, payload nor
    feature; error is null otherwise.

    The payload is the text's UTF-8 bytes and spaces up to a positive multiple of 192; a null text counts as empty. A
    null id comes back null; repeated rows each give a member. Extra columns are ignored; an empty table gives an empty
    result. The archives stay in the shared folder until the process ends.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "media")
    ws.save(write_archives(docs, ws.path("archives"), id_col, text_col), "manifest")
    return features(load(spark, ws.path("archives"), ws.path("manifest"), damaged=damaged))


def load(spark: SparkSession, archives: str, manifest: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format(MediaSource.name()).options(path=archives, manifest=manifest, **options).load()


def op2(spark, sf_dir: str) -> DataFrame:
    """Digests of the payload and the stored form of every document, as read back."""
    out = media_columns(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
