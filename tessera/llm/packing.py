"""Harmonic packing of token sequences.

A piece of length L belongs to class ``capacity // L``: class k takes pieces in (capacity/(k+1), capacity/k], and each of
its bins takes exactly k of them. Each worker fills the bins of its classes by itself, with no exchange. A document is
cut so that its pieces nearly fill their class: whole bins first (class 1), then, while a remainder would waste over
``slack`` of itself in its class, the next smaller reciprocal is cut off. What a worker's open bins hold at its end is
packed first-fit decreasing into shared bins.

A bin's length needs no padding at a power of two: it is then its own bucket; every other bin is padded to the capacity.

Defined results: a null or empty text is the end token alone; repeated rows, doc_ids and null doc_ids are packed row by
row; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, read_spread, text_or_empty
from tessera.llm.pretokens import Numbers, PreTokenizer
from tessera.llm.tokens import RankMerger

CAPACITY = 1024
#: A remainder stays whole if its class wastes at most this share of it.
SLACK = 0.03
#: So short a remainder always stays whole.
LEAST = 16
#: Distinct pre-tokens whose ids a worker remembers, and one batch's; beyond, it forgets all. Speed only.
REMEMBERED = 400_000
BATCH_BYTES = 2 << 20


class IdEncoder:
    """Token ids of whole texts, equal to the library's; the ids of pre-tokens met before are remembered."""

    def __init__(self, path: str | None = None):
        self.splitter = PreTokenizer(path)
        self.merger = RankMerger(self.splitter.description)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        special = self.splitter.special
        flat, n = self.merger.merge([b"" if w in special else w.encode() for w in words])
        for i in [i for i, w in enumerate(words) if w in special]:
            flat = np.insert(flat, n[:i].sum(), special[words[i]])
            n[i] = 1
        begin, end = len(self.known) - len(words), len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while end > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[begin:end] = self.used + np.cumsum(n) - n
        self.lengths[begin:end] = n
        self.used += len(flat)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        places = [self.known.of(self.splitter.split(t)[0]) for t in texts]
        self._learn(self.known.taken())
        for at in places:
            n = self.lengths[at]
            ends = np.cumsum(n)
            yield self.ids[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def worker_encoder(path: str | None) -> IdEncoder:
    """One for each Python worker, which outlives its tasks."""
    return IdEncoder(path)


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths, in order, of a document of so many tokens."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest <= LEAST or capacity / k - rest <= SLACK * rest:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class HarmonicBins:
    """A worker's open bins, one for each class. Pieces are (doc_id, start, length, crc, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self._close(self.open.pop(k))

    def finish(self) -> None:
        """First fit, longest first, for what is left: under ``k`` pieces of each class, whatever the input's size."""
        bins: list[tuple[int, list[tuple]]] = []
        for piece in sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2]):
            for i, (room, pieces) in enumerate(bins):
                if room >= piece[2]:
                    pieces.append(piece)
                    bins[i] = (room - piece[2], pieces)
                    break
            else:
                bins.append((self.capacity - piece[2], [piece]))
        for _, pieces in bins:
            self._close(pieces)
        self.open = {}

    def taken(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` with the sequence and offset each is at; no shuffle. Sequence ids are unique:
    the upper bits are the partition's number. ``with_ids`` adds the pieces' token ids."""
    kind = docs.schema[key].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(path)
        bins = HarmonicBins(TaskContext.get().partitionId() << 40, capacity)

        def out(key_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*bins.taken(), strict=True)) or [()] * (7 + with_ids)
            ids = [columns.pop(4)] if with_ids else []
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:]), *(pa.array(c, pa.list_(pa.int32())) for c in ids)]
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for a, b in chunks(batch.column(2).to_pylist(), BATCH_BYTES):
                doc_ids, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                    n, start = len(ids) + 1, 0
                    data = np.append(ids, np.uint32(0)).astype("<u4")
                    for length in cuts(n, capacity):
                        piece = data[start : start + length]
                        row = (doc_id, start, length, zlib.crc32(piece.tobytes()), n)
                        bins.add((*row[:4], piece.astype(np.int32), n) if with_ids else row)
                        start += length
                if len(bins.done) > 20_000:
                    yield out(key_type)
            yield out(key_type)
        bins.finish()
        yield out(key_type)

    text_col = text_or_empty(text)
    rows = docs.select(F.col(key).alias("doc_id"), text_col.alias("text"), F.octet_length(text_col).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_spread(spark, sf_dir, "documents"))
