"""Media columns: documents as lossless 8-bit images in archives, read back by a custom Spark data source.

Each document's bytes, padded with spaces to full rows of ``width``, become one greyscale PNG. Every task writes its members
to an archive of its own with an index of offsets beside it; both appear under their names only when complete, and only
archives of tasks that Spark committed are listed. The data source plans byte ranges over the listed archives, finds a
range's members in the index, streams their payloads in Arrow batches, and retries each member by its offset.

Defined results: a null text is an empty one, which is one row of spaces; repeated rows become members of their own; an
empty table gives no archive and an empty frame; equal texts give equal payloads, files and features; other columns are
ignored. A member that can't be read after all retries fails the task; nothing is skipped.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fixwave.llm.common import prepare, slices

INDEX = np.dtype([("offset", "<i8"), ("length", "<i8")])
HEAD = "<4sqBqq"  # magic, doc_id, whether it is null, bytes before padding, bytes of the image
HEAD_BYTES = struct.calcsize(HEAD)
MAGIC = b"MBR1"
MEMBERS = "doc_id long, n_bytes long, payload binary, media binary"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(payload: bytes, width: int, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of whole rows."""
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)  # filter type 0 ahead of each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def unpng(media: bytes) -> bytes:
    """The samples of an image that ``png`` made; each chunk's checksum is verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, width, data = 8, 0, []
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def filesystem(uri: str):
    """The Arrow file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(docs: DataFrame, folder: str, width: int = 192) -> list[tuple[str, int]]:
    """Write all documents as members; returns each committed archive with its bytes (one entry per task, no members)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id is {kind}, not an integer")

    def run(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, index, at, out = f"{uuid.uuid4().hex}.members", [], 0, None
        for batch in slices(batches):
            out = out or store.open_output_stream(f"{root}/.{name}")
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                body = (text or "").encode("utf-8", "surrogatepass")
                payload = body.ljust(max(width, -(-len(body) // width) * width))
                media = png(payload, width)
                out.write(struct.pack(HEAD, MAGIC, doc_id or 0, doc_id is None, len(body), len(media)) + media)
                index.append((at, HEAD_BYTES + len(media)))
                at += index[-1][1]
        if out:
            out.close()
            with store.open_output_stream(f"{root}/{name}.index") as f:
                f.write(np.array(index, INDEX).tobytes())
            store.move(f"{root}/.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at])], names=["name", "bytes"])

    done = docs.select("doc_id", "text").mapInArrow(run, "name string, bytes long").collect()
    return sorted((r["name"], r["bytes"]) for r in done)


class Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        super().__init__((name, start, stop))
        self.name, self.start, self.stop = name, start, stop


class MediaReader(DataSourceReader):
    """Reads the members whose headers begin in a byte range of an archive."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.archives = [(n, int(b)) for n, b in (x.split(":") for x in options["archives"].split(",") if x)]
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or 8 << 20)
        self.batch_bytes = int(options.get("batchbytes") or options.get("batchBytes") or 4 << 20)
        self.retries = int(options.get("retries") or 3)

    def partitions(self):
        return [Range(n, a, min(a + self.range_bytes, size)) for n, size in self.archives for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def _member(self, source, path, offset: int, length: int):
        """One member by its offset, opened anew after a failure; what other members hold doesn't matter to it."""
        store, opened = source
        for left in range(self.retries, -1, -1):
            try:
                if opened[0] is None:
                    opened[0] = store.open_input_file(path)
                raw = opened[0].read_at(length, offset)
                magic, doc_id, null, n_bytes, size = struct.unpack_from(HEAD, raw)
                if magic != MAGIC or len(raw) != HEAD_BYTES + size:
                    raise ValueError("no member begins here")
                return (None if null else doc_id), n_bytes, raw[HEAD_BYTES :]
            except (OSError, ValueError, struct.error) as e:
                opened[0] = None
                if not left:
                    raise RuntimeError(f"{path} at {offset}: {e}") from e
                time.sleep(0.05 * (self.retries - left + 1))
        return None

    def read(self, partition):
        if not partition.name:
            return
        store, root = filesystem(self.folder)
        with store.open_input_file(f"{root}/{partition.name}.index") as f:
            index = np.frombuffer(f.read(), INDEX)
        first, last = np.searchsorted(index["offset"], [partition.start, partition.stop])
        opened, rows, size = [None], [], 0
        for offset, length in index[first:last].tolist():
            doc_id, n_bytes, media = self._member((store, opened), f"{root}/{partition.name}", offset, length)
            rows.append((doc_id, n_bytes, unpng(media), media))
            size += len(media) + n_bytes
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    doc_ids, n, payloads, media = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(payloads, pa.binary()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload", "media"])


class MediaSource(DataSource):
    """format("media_archive"): path, archives (name:bytes, comma-joined), rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, archives: list[tuple[str, int]], range_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, payload, media) of every member, read back from the archives."""
    prepare(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("archives", ",".join(f"{n}:{b}" for n, b in archives)).option("rangeBytes", range_bytes).load(folder)


def features(members: DataFrame, width: int = 192) -> DataFrame:
    """Digests of the stored and the restored bytes, and image statistics: mean, deviation, entropy, gradient, 8-bin histogram."""
    prepare(members.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for payload, media in zip(batch.column("payload").to_pylist(), batch.column("media").to_pylist()):
                x = np.frombuffer(payload, np.uint8)
                full = np.bincount(x, minlength=256)
                level = np.arange(256)
                mean = float(full @ level) / len(x)
                dev = max(0.0, float(full @ (level * level)) / len(x) - mean * mean) ** 0.5
                p = full[full > 0] / len(x)
                step = np.abs(np.diff(x.reshape(-1, width).astype(np.int16), axis=1)).mean()
                hist = ".".join(map(str, full.reshape(8, 32).sum(1).tolist()))
                feature = f"rows={len(x) // width};mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};gradient={float(step):.4f};hist={hist}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out)) if out else [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
