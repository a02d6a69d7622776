"""Media columns: payloads in archives, read through a Spark data source.

``sievelight_archive`` is a Python data source over ZIP files whose members are
stored, not compressed (media are compressed already). The writer makes one
or more archives a task and lists those of successful tasks in a manifest.
The reader plans byte ranges from the manifest's archive sizes alone; each
task reads its archive's central directory and takes the members that begin in
its range, by offset, one by one, and repeats a failed member by itself.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sievelight.llm.common import shared_dir, table, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 576


def padded(text: bytes, unit: int = ROW) -> bytes:
    """``text`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(samples: bytes, width: int = ROW, level: int = 1) -> bytes:
    """A greyscale PNG of 8-bit samples, ``width`` to a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_decode(media: bytes) -> np.ndarray:
    """The samples (height x width) of a PNG that ``png_encode`` made; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, height = 8, b"", 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, row gradient and eight-bin histogram of an image."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    grey = samples.astype(np.float32)
    step = float(np.abs(np.diff(grey, axis=1)).mean()) if samples.shape[1] > 1 else 0.0
    bins = ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(axis=1) / samples.size)
    return f"mean={grey.mean(dtype=np.float64):.4f};std={grey.std(dtype=np.float64):.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f};hist={bins}"


# ---------------------------------------------------------------- archives


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: An index record: where a member begins, its size and checksum, and where its name and comment stand in the index.
_RECORD = struct.Struct("<QQIQI")


def _index_bytes(entries: list[tuple[int, int, int, str, str]]) -> bytes:
    """The index that lies beside an archive: records in order of offset, names and comments, and the number of records."""
    texts = [json.dumps(e[3:]).encode() for e in entries]
    at, records = _RECORD.size * len(entries), []
    for (offset, size, crc, *_), text in zip(entries, texts, strict=True):
        records.append(_RECORD.pack(offset, size, crc, at, len(text)))
        at += len(text)
    return b"".join(records + texts) + struct.pack("<Q", len(entries))


def _indexed(store: fs.FileSystem, path: str, start: int, end: int) -> list[tuple[int, int, int, str, str]]:
    """The members of an archive that begin in [start, end), by a search in its index; the rest of the index is not read."""

    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    with store.open_input_file(f"{path}.idx") as file:
        count = struct.unpack("<Q", read(file.size() - 8, 8))[0]

        def first(least: int) -> int:
            a, b = 0, count
            while a < b:
                m = (a + b) // 2
                a, b = (m + 1, b) if _RECORD.unpack(read(m * _RECORD.size, _RECORD.size))[0] < least else (a, m)
            return a

        low, high = first(start), first(end)
        records = list(_RECORD.iter_unpack(read(low * _RECORD.size, (high - low) * _RECORD.size)))
        if not records:
            return []
        base = records[0][3]
        texts = read(base, records[-1][3] + records[-1][4] - base)
        return [(offset, size, crc, *json.loads(texts[at - base : at - base + n])) for offset, size, crc, at, n in records]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class Written(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int]]):
        self.archives = archives


class ArchiveSource(DataSource):
    """``path``: the folder; ``rangeMb``: bytes of archive a task reads; ``archiveMb``: size at which a writer begins another archive; ``attempts``: for each member."""

    @classmethod
    def name(cls) -> str:
        return "sievelight_archive"

    def schema(self) -> str:
        return "member string, comment string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


class ArchiveWriter(DataSourceArrowWriter):
    """Takes rows of (member, comment, media); a member name may repeat."""

    def __init__(self, options):
        self.path, self.most = options["path"].rstrip("/"), int(float(options.get("archiveMb", "256")) * (1 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        done, out, archive, entries = [], None, None, []

        def close():
            archive.close()
            done.append((name, out.tell()))
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(_index_bytes(entries))
            entries.clear()

        for batch in iterator:
            for member, comment, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(member or "")
                info.comment = (comment or "").encode()
                archive.writestr(info, media or b"")
                entries.append((info.header_offset, info.file_size, info.CRC, member or "", comment or ""))
                if out.tell() > self.most:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        archives = sorted(a for m in messages if m for a in m.archives)
        with store.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(archives).encode())

    def abort(self, messages: list) -> None:
        """Archives that no manifest names are never read."""


class _Forward(io.RawIOBase):
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.span = options["path"].rstrip("/"), int(float(options.get("rangeMb", "32")) * (1 << 20))
        self.attempts, self.batch = int(options.get("attempts", "3")), int(options.get("batchMb", "8")) << 20

    def partitions(self) -> list[Range]:
        store, root = _open(self.path)
        found = []
        for info in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            if info.base_name.startswith("manifest-"):
                with store.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [Range(name, at, at + self.span) for name, size in found for at in range(0, size, self.span)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, root = _open(self.path)
        path = f"{root}/{part.path}"
        members = _indexed(store, path, part.start, part.end)
        rows, held = [], 0
        with _Again(store, path, self.attempts) as source:
            for offset, size, crc, name, comment in members:
                rows.append((name, comment, source.member(offset, size, crc)))
                held += size
                if held >= self.batch:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names, comments, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(comments, pa.string()), pa.array(media, pa.binary())], ["member", "comment", "media"])


class _Again:
    """A file whose members are read by offset; a failed read reopens it and repeats that member alone."""

    def __init__(self, store, path: str, attempts: int, wait: float = 0.2):
        self.store, self.path, self.attempts, self.wait, self.file = store, path, attempts, wait, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.file is not None:
            self.file.close()

    def member(self, offset: int, size: int, crc: int) -> bytes:
        for n in range(1, self.attempts + 1):
            try:
                if self.file is None:
                    self.file = self.store.open_input_file(self.path)
                self.file.seek(offset)
                names, extra = struct.unpack("<HH", self.file.read(30)[26:])
                self.file.seek(offset + 30 + names + extra)
                data = self.file.read(size)
                if len(data) != size or zlib.crc32(data) != crc:
                    raise OSError(f"{self.path}: member at {offset} is damaged")
                return data
            except (OSError, struct.error):
                if self.file is not None:
                    self.file.close()
                    self.file = None
                if n == self.attempts:
                    raise
                time.sleep(self.wait * n)
        raise AssertionError


# ---------------------------------------------------------------- documents as media


def _imaged(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, batch.num_rows, 256):
            rows = [(str(d), json.dumps({"doc_id": d, "n_bytes": len(t)}), png_encode(padded(t))) for d, t in zip(ids[i : i + 256], utf8(texts.slice(i, 256)), strict=True)]
            yield ArchiveReader._batch(rows)


def write_media(docs: DataFrame, path: str) -> None:
    """Store each text of ``docs`` (doc_id, text; null as empty) as an image in archives under ``path``.

    Ids may be null or repeat, and equal texts of different rows are stored as
    often; other columns are ignored; an empty table gives a manifest without
    archives. A text of any length is one image, held whole by its task.
    """
    docs.sparkSession.dataSource.register(ArchiveSource)
    images = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_imaged, "member string, comment string, media binary")
    images.write.format("sievelight_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """member, comment and media of the archives under ``path``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("sievelight_archive").options(**options).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches):
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for comment, media in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            meta, samples = json.loads(comment), png_decode(media)
            payload = samples.tobytes()
            rows.append((meta["doc_id"], meta["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def media_features(media: DataFrame) -> DataFrame:
    """Decode stored images and describe them; all figures come from the stored bytes."""
    return media.select("member", "comment", "media").mapInArrow(_described, FEATURES)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "op1")
    write_media(table(spark, sf_dir, "documents"), path)
    return media_features(read_media(spark, path))
