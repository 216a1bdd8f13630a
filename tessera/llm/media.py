"""Media columns: texts stored as lossless WebP images and read back as pixel arrays.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are the RGBA samples of an image 144 pixels
wide. A payload of more rows than the format has is stored as several files one after the other. What is stored is then
decoded (prefix codes, back-references, colour cache, transforms) and every value returned comes from the decoded pixels.

Defined results: a null text is stored as an empty one; equal texts have equal values; null doc_ids and repeated rows get
a row each; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import webp
from tessera.llm.common import chunks, read_spread, text_or_empty

UNIT = 576
WIDTH = UNIT // 4
FILL = b"\xff"
#: Bytes of payloads that are encoded and decoded by the same array operations.
TOGETHER = 1 << 17


def payload_of(data: bytes) -> bytes:
    return data + FILL * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store(payload: bytes) -> bytes:
    return store_many([payload])[0]


def store_many(payloads: Sequence[bytes]) -> list[bytes]:
    most = webp.MOST_SIDE * UNIT
    pieces = [(k, x[a : a + most]) for k, x in enumerate(payloads) for a in range(0, len(x), most)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in chunks((len(x) for _, x in pieces), TOGETHER):
        for (k, _), file in zip(pieces[a:b], webp.encode_columns([x for _, x in pieces[a:b]], WIDTH), strict=True):
            out[k].append(file)
    return [b"".join(x) for x in out]


def load(media: bytes) -> np.ndarray:
    """(rows, 144, 4) of RGBA."""
    return load_many([media])[0]


def load_many(stored: Sequence[bytes]) -> list[np.ndarray]:
    files: list[tuple[int, bytes]] = []
    for k, media in enumerate(stored):
        at = 0
        while at < len(media):
            size = 8 + struct.unpack_from("<I", media, at + 4)[0]
            files.append((k, media[at : at + size]))
            at += size
    out: list[list[np.ndarray]] = [[] for _ in stored]
    for a, b in chunks((len(x) for _, x in files), TOGETHER):
        for (k, _), pixels in zip(files[a:b], webp.decode_many([x for _, x in files[a:b]]), strict=True):
            out[k].append(pixels)
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each channel, and a 64-bit average hash: which cells of an 8 x 8 grid are brighter than the mean cell."""
    rows, columns = (np.arange(8) * n // 8 for n in pixels.shape[:2])
    flat = pixels.reshape(len(pixels), -1)
    cells = np.add.reduceat(np.add.reduceat(flat, rows, axis=0, dtype=np.int64), 4 * columns, axis=1).astype(float)
    area = np.maximum(np.diff(np.append(rows, pixels.shape[0])), 1)[:, None] * np.diff(np.append(columns, pixels.shape[1]))[None, :]
    cells /= area
    marks = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    sums = flat.sum(axis=0, dtype=np.int64).reshape(-1, 4).sum(axis=0)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{','.join(str(int(s) // (pixels.shape[0] * pixels.shape[1])) for s in sums)};{marks}"


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", with_media: bool = False) -> DataFrame:
    """A row for each row of ``docs``; ``with_media`` adds the stored bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    kinds = [docs.schema[key].dataType.simpleString(), "long", "long", "string", "long", "long", "string", "string"] + ["binary"] * with_media

    def rows_of(texts: list[bytes]) -> Iterator[tuple]:
        stored = store_many([payload_of(x) for x in texts])
        for data, media, pixels in zip(texts, stored, load_many(stored), strict=True):
            payload = pixels.tobytes()
            out = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels))
            yield (*out, media) if with_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column(1)
                rows: list[tuple] = []
                for b, e in chunks((UNIT + (len(x.as_buffer()) if x.is_valid else 0) for x in texts), TOGETHER):
                    rows += rows_of([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts.slice(b, e - b)])
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names)

    rows = docs.select(F.col(key).alias("doc_id"), F.encode(text_or_empty(text), "utf-8").alias("data"))
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_spread(spark, sf_dir, "documents"))
