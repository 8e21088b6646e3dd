"""Media columns: texts stored as grey images in archives, and a Spark data source that reads the archives back.

``write_archives`` stores every text's UTF-8 bytes, padded with spaces to rows of 192 samples, as an 8-bit greyscale PNG;
each task appends its images to zip archives (members stored, so an offset and a size are all that reading one takes) in
the shared folder. An archive's closing comment lists the offsets at which a new byte range may begin. An attempt that dies
leaves an archive that no manifest names.

The data source ``sextant_media`` plans one partition per byte range from names and sizes alone: those of the manifest, or of
the folder's listing. No archive is opened in the driver. A task finds the members that begin in its range by its archive's
comment, or by the directory in archives of other writers, whose members may be stored or deflated, with sizes after them or
not, and streams them as Arrow batches. A member that cannot be decoded is read again on its own, by its offset, and fails
the task if that does not help: no member is left out in silence.
"""

from __future__ import annotations

import json
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, table

WIDTH = 192
#: An archive is closed, and a byte range ends, after about so many bytes.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: Byte ranges are made longer rather than more than about so many.
MOST_RANGES = 100_000
BATCH_BYTES = 4 << 20
RETRIES = 3
LEVEL = 1

_PNG = b"\x89PNG\r\n\x1a\n"
_SCHEMA = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string, archive string, offset long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of the width."""
    return data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(data: bytes) -> bytes:
    """An image whose rows are the padded bytes; a text chunk holds the length before padding."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, bytes]:
    """(length before padding, samples); raises ValueError for an image that is damaged or not of this form."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, n, shape = 8, [], None, None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at) if at + 8 <= len(media) else (0, b"")
        data = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if n is None or shape is None or shape[0] != WIDTH or len(raw) != shape[1] * (WIDTH + 1):
        raise ValueError("not an image of this form")
    raw = raw.reshape(-1, WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return n, raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Rows and width, sum of samples, distinct values, and sum of steps between neighbours of a row."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    steps = np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64)
    return f"{len(x)}x{WIDTH}:sum={x.sum(dtype=np.int64)}:values={np.count_nonzero(np.bincount(x.reshape(-1), minlength=256))}:steps={steps}"


# --- archives ---------------------------------------------------------------------------------------------------------

_LOCAL, _CENTRAL, _END = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
_LOCAL_SIZE = struct.calcsize(_LOCAL)
#: The id in a member's name, which a running number may precede; other names give a null id.
_NAME = re.compile(r"(?:\d+_)?(-?\d+)\.png")


class ArchiveWriter:
    """A zip archive of stored members, written front to back; its comment lists where byte ranges begin."""

    def __init__(self, out, range_bytes: int = RANGE_BYTES):
        self.out, self.at, self.members, self.ranges, self.range_bytes = out, 0, [], [], range_bytes

    def add(self, name: str, data: bytes) -> None:
        if not self.ranges or self.at - self.ranges[-1] >= self.range_bytes:
            self.ranges.append(self.at)
        title, crc = name.encode(), zlib.crc32(data)
        self.out.write(struct.pack(_LOCAL, b"PK\3\4", 20, 0, 0, 0, 33, crc, len(data), len(data), len(title), 0) + title)
        self.out.write(data)
        self.members.append((title, crc, len(data), self.at))
        self.at += _LOCAL_SIZE + len(title) + len(data)

    def full(self, limit: int) -> bool:
        return self.at >= limit or len(self.members) >= 65_000

    def close(self) -> None:
        begin = self.at
        for title, crc, size, at in self.members:
            self.out.write(struct.pack(_CENTRAL, b"PK\1\2", 20, 20, 0, 0, 0, 33, crc, size, size, len(title), 0, 0, 0, 0, 0, at) + title)
            self.at += struct.calcsize(_CENTRAL) + len(title)
        comment = json.dumps([*self.ranges, begin]).encode()
        n = len(self.members)
        end = struct.pack(_END, b"PK\5\6", 0, 0, n, n, self.at - begin, begin, len(comment)) + comment
        self.out.write(end)
        self.at += len(end)
        self.out.close()


class _Range(InputPartition):
    """The members of an archive that begin between two of its bytes."""

    def __init__(self, path: str, size: int, begin: int, end: int):
        self.path, self.size, self.begin, self.end = path, size, begin, end


def planned(archives: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, most: int = MOST_RANGES) -> list[_Range]:
    """Byte ranges of (path, size) archives. Names and sizes are all that the driver needs; where archives hold so much that
    there would be more than about ``most`` ranges, these are longer."""
    step = max(range_bytes, sum(size for _, size in archives) // most)
    return [_Range(path, size, at, min(at + step, size)) for path, size in archives for at in range(0, max(1, size), step)]


def listed(directory: bytes) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
    """(name, offset, (method, crc, stored size)) of each entry of a directory."""
    at = 0
    while at < len(directory):
        magic, _, _, _, method, _, _, crc, size, _, title, extra, remark, _, _, _, offset = struct.unpack_from(_CENTRAL, directory, at)
        if magic != b"PK\1\2":
            raise ValueError("damaged archive directory")
        text = at + struct.calcsize(_CENTRAL)
        at = text + title + extra + remark
        yield directory[text : text + title].decode("utf-8", "replace"), offset, (method, crc, size)


def ending(f, part: _Range) -> tuple[list[int] | None, bytes | None]:
    """What an archive's last bytes tell: the offsets that its comment lists, or else its directory, of at most 65,534 entries.

    Archives with 64-bit directories are refused.
    """
    tail = f.read_at(min(part.size, 65_557), max(0, part.size - 65_557))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError(f"{part.path} has no archive directory")
    *_, n, length, begin, _ = struct.unpack_from(_END, tail, at)
    try:
        begins = json.loads(tail[at + struct.calcsize(_END) :])
    except ValueError:
        begins = None
    if isinstance(begins, list) and begins and begins[-1] == begin:
        return begins, None
    if n == 0xFFFF or begin == 0xFFFFFFFF:
        raise ValueError(f"{part.path} has a 64-bit directory")
    return None, f.read_at(length, begin)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> int:
    """Writes all texts into archives below ``folder`` and a manifest of them; returns the number of members."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = fs.FileSystem.from_uri(folder)
        writer, name, done = None, "", []

        def close() -> None:
            writer.close()
            done.append((name, writer.at, len(writer.members)))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if writer is None or writer.full(archive_bytes):
                    if writer is not None:
                        close()
                    name = f"{uuid.uuid4().hex}.zip"
                    filesystem.create_dir(top, recursive=True)
                    writer = ArchiveWriter(filesystem.open_output_stream(f"{top}/{name}", buffer_size=1 << 20), range_bytes)
                writer.add(f"{len(writer.members)}_{'' if doc is None else doc}.png", to_png(text.as_buffer().to_pybytes() if text.is_valid else b""))
        if writer is not None:
            close()
        names, sizes, members = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.int64())], ["archive", "size", "members"])

    # a row for each archive: what one task writes, or 256 MB of it
    rows = own.mapInArrow(run, "archive string, size long, members long").collect()
    filesystem, top = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(top, recursive=True)
    with filesystem.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps(sorted((r["archive"], r["size"]) for r in rows)).encode())
    return sum(r["members"] for r in rows)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.retries = int(options.get("retries", RETRIES))
        self.listing = options.get("listing", "false") == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        filesystem, top = fs.FileSystem.from_uri(self.folder)
        if self.listing:
            archives = sorted((x.base_name, x.size) for x in filesystem.get_file_info(fs.FileSelector(top)) if x.base_name.endswith(".zip"))
        else:
            with filesystem.open_input_stream(f"{top}/manifest.json") as f:
                archives = json.loads(f.read())
        return planned([(f"{top}/{name}", size) for name, size in archives], self.range_bytes) or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        import hashlib

        filesystem, _ = fs.FileSystem.from_uri(self.folder)
        rows, size = [], 0
        if partition.path:
            with filesystem.open_input_file(partition.path) as f:
                for at, (name, n, samples, media, _) in self._members(f, partition):
                    doc = _NAME.fullmatch(name.rpartition("/")[2])
                    rows.append((int(doc[1]) if doc else None, n, samples, len(media), hashlib.sha256(media).hexdigest(), feature(samples), partition.path.rpartition("/")[2], at))
                    size += len(samples)
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows or not partition.path:
            yield self._batch(rows)

    def _members(self, f, part: _Range) -> Iterator[tuple[int, tuple[str, int, bytes, bytes, int]]]:
        """(offset, member) of every member of a partition; folders of an archive are none."""
        begins, directory = ending(f, part)
        if begins is None:
            for name, at, told in listed(directory):
                if part.begin <= at < part.end and not name.endswith("/"):
                    yield at, self._member(f, at, told)
            return
        # each stretch that the comment lists begins in one range and is read by it, to its end
        for at, end in ((a, b) for a, b in zip(begins[:-1], begins[1:], strict=True) if part.begin <= a < part.end):
            while at < end:
                got = self._member(f, at)
                yield at, got
                at = got[-1]

    def _member(self, f, at: int, told: tuple[int, int, int] | None = None) -> tuple[str, int, bytes, bytes, int]:
        """(name, length, samples, image, next offset) of the member at an offset, read again if it cannot be decoded.

        ``told``: method, checksum and stored size by the directory, which hold where the member's own head has none.
        """
        for attempt in range(self.retries + 1):
            try:
                head = f.read_at(_LOCAL_SIZE, at)
                magic, _, _, method, _, _, crc, size, _, title, extra = struct.unpack(_LOCAL, head)
                method, crc, size = told or (method, crc, size)
                if magic != b"PK\3\4":
                    raise ValueError("no member here")
                body = f.read_at(title + extra + size, at + _LOCAL_SIZE)
                media = body[title + extra :]
                if len(media) < size or method not in (0, 8):
                    raise ValueError("damaged member")
                media = zlib.decompress(media, -15) if method else media
                if zlib.crc32(media) != crc:
                    raise ValueError("damaged member")
                n, samples = from_png(media)
                return body[:title].decode(), n, samples, media, at + _LOCAL_SIZE + title + extra + size
            except (ValueError, OSError, struct.error, zlib.error):
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sextant_media"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str, listing: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, payload, media_bytes, media_sha256, feature, archive, offset) of every member below ``folder``.

    The archives are those of the manifest that ``write_archives`` leaves; with ``listing``, all .zip files of the folder.
    """
    spark.dataSource.register(MediaSource)
    return spark.read.format("sextant_media").option("listing", str(listing).lower()).option("range_bytes", range_bytes).load(folder)


def stored_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as an image, read back and described: one row per row of ``docs``.

    Nulls: a null text is the empty text, one row of spaces; a null id is kept. Repeated rows are stored each, and equal
    texts give equal values. An empty table gives no rows; texts of any length are stored whole. Only the id and the text
    are read, so other names cannot clash.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    return read_archives(spark, folder)


def op8_archive_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored_as_media(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


QUERIES = {"op8_archive_source": op8_archive_source}
ORACLE: dict[str, str] = {}
