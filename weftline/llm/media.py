"""Media columns: payloads as images in tar shards, rows with digest, offset and length.

A payload is stored as the 8-bit grey samples of a PNG of ``WIDTH`` columns, which is lossless.  Each task appends its
images to tar files of bounded size in the shared folder, named by their SHA-256, and once per file however many rows
hold the same bytes; a row carries shard, offset, length and digest.  The large bytes are never shuffled.  The metadata
columns come from the first bytes of an image alone, read by range; features come from the whole image, read by range,
once for rows of equal content next to each other.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import settled, small_batches, text_chunks
from weftline.llm.files import RangeReader, ShardWriter, split_by_volume
from weftline.plans.shared import Stash, fresh_path

WIDTH = 192
SHARD_BYTES = 256 << 20
HEADER = 33  # signature and IHDR chunk of a PNG
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
CHUNK = 4 << 20
REMEMBERED = 20_000


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, blanks appended up to a positive multiple of ``WIDTH``; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG whose samples are the payload."""
    height = len(payload) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def image_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first ``HEADER`` bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def decode_image(data: bytes) -> bytes:
    """The samples of a PNG as written here; checksums are verified."""
    width, height, _ = image_header(data)
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Integer statistics of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    return f"mean={int(x.mean(dtype=np.float64))};min={x.min()};max={x.max()};bins=" + ",".join(map(str, counts.tolist()))


def _tar_head(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def store(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the texts of ``docs`` to tar shards: ``(doc_id, n_bytes, digest, shard, offset, length)`` per row.

    ``digest`` is the SHA-256 of the stored image, ``n_bytes`` the length before padding.  Null texts count as empty,
    repeated rows share an image, an empty table writes none.  The rows are a written table: what they refer to is not
    written again when they are read.
    """
    spark = docs.sparkSession
    place = folder or fresh_path(spark, "media")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]

    @settled("media")
    def run(batches):
        out, held = ShardWriter(place, ".tar", shard_bytes), {}
        try:
            for batch in batches:
                for part in text_chunks(batch, "text", CHUNK):
                    sizes, found = [], []
                    for t in part.column(1).to_pylist():
                        payload = payload_of(t)
                        key = hashlib.sha256(payload).digest()
                        sizes.append(len((t or "").encode("utf-8", "surrogatepass")))
                        if key not in held:
                            image = encode_image(payload)
                            digest = hashlib.sha256(image).hexdigest()
                            room = 1024 + len(image)
                            if out.out is not None and out.size + room > shard_bytes:
                                out.close(b"\0" * 1024)
                            if out.room(room):
                                held.clear()
                            out.write(_tar_head(f"{digest}.png", len(image)))
                            at = out.write(image)
                            out.write(b"\0" * (-len(image) % 512))
                            held[key] = (digest, out.name, at, len(image))
                        found.append(held[key])
                    cols = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *cols], names=names)
        finally:
            out.close(b"\0" * 1024)

    schema = f"doc_id {kind}, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
    return Stash(spark).keep(small_batches(base).mapInArrow(run, schema), "media-rows")


def _read(refs: DataFrame, added: str, types: list, work):
    """Append columns that ``work(reader, shard, offset, length)`` gives; equal places are worked out once in a while."""
    at = [refs.columns.index(c) for c in ("shard", "offset", "length")]

    @settled("media")
    def run(batches):
        reader, seen = RangeReader(), OrderedDict()
        try:
            for batch in batches:
                rows = []
                for place in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
                    if place not in seen:
                        seen[place] = work(reader, *place)
                        if len(seen) > REMEMBERED:
                            seen.popitem(last=False)
                    rows.append(seen[place])
                more = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *new])
        finally:
            reader.close()

    new = [x.split()[0] for x in added.split(", ")]
    schema = ", ".join(f"`{c}` {t}" for c, t in refs.dtypes) + ", " + added
    return refs.mapInArrow(run, schema)


def with_metadata(refs: DataFrame) -> DataFrame:
    """Rows of ``store`` with width, height and bits, from range reads of the images' headers only."""
    return _read(
        split_by_volume(refs, ["shard", "offset", "doc_id"], ("shard", "offset")), "width bigint, height bigint, bits bigint", [pa.int64()] * 3,
        lambda reader, shard, offset, length: image_header(reader.read(shard, offset, min(length, HEADER))),
    )


def with_features(refs: DataFrame) -> DataFrame:
    """Rows of ``store`` with what the stored bytes, read back, hold: digests, tail checksum and feature string."""
    def work(reader, shard, offset, length):
        data = reader.read(shard, offset, length)
        payload = decode_image(data)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(data).hexdigest(), feature_of(payload),
        )

    return _read(
        refs, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string",
        [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], work,
    )


def shard_members(shard: bytes) -> list[str]:
    """Names in a shard, by the standard library; for tests and inspection."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as t:
        return t.getnames()
