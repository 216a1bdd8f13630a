"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits differ in at most one bit of their upper or of their lower half. So every
distinct fingerprint emits all variants within radius 1 of either half (2 x 33 rows); rows are shuffled on the variants,
and fingerprints that meet are verified. Exact copies share a fingerprint and emit once. Of what meets in one place only
the edges of a spanning forest are kept (no pair list), since links are asked for as components.

A place where over ``CROWD`` fingerprints meet is not verified there: all its fingerprints emit the ball of the whole
fingerprint instead (65 variants within radius 1 and 2016 at radius 2). Whoever has a variant within radius 1 is at most
2 bits from any other such one and at most 3 from whoever has it at radius 2, so linking all who meet there to one of the
former loses no link and needs no comparison; at most 2081 distinct fingerprints can meet in such a place.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null doc_id gets its row,
but is no component_id unless the whole component has none (then null); repeated rows each get their row; an empty table
gives no row; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, read_spread, text_or_empty, written
from tessera.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Most fingerprints of one place that are verified there.
CROWD = 4096
#: Larger groups are compared in blocks.
SQUARE = 256

BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
HALF_BALL = np.append(np.uint64(0), BIT[:32])
NEAR_BALL = np.append(np.uint64(0), BIT)
FAR_RING = np.array([BIT[i] | BIT[j] for i in range(64) for j in range(i)], np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of every shingle of the text's words, repeats included; words are parted by ASCII white space, A-Z is
    lower-cased. A text of fewer words is one shingle, one of none has none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    join = b" ".join
    return np.array([xxh64_intdigest(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], np.uint64)


#: The bits of every byte, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For rows of 64-bit numbers: which of their bits, lowest first, are set in over half the rows. Bytes are counted by
    value, then values' bits."""
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1)
    n, width = columns.shape
    counts = np.zeros(width * 256, np.int64)
    offsets = np.arange(width) * 256
    for a, b in chunks([1] * n, 1 << 16) if n > 1 << 16 else [(0, n)]:
        counts += np.bincount((columns[a:b] + offsets).ravel(), minlength=width * 256)
    return (2 * (counts.reshape(width, 256) @ BYTE_BITS) > n).ravel()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    return int(BIT[majority(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, fp long")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _half_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = _columns(batch)[0].view(np.uint64)
        for a, b in chunks([1] * len(fps), 4096):
            own = fps[a:b, None]
            low, high = (own & np.uint64(0xFFFFFFFF)) ^ HALF_BALL, (own >> np.uint64(32)) ^ HALF_BALL
            places = np.concatenate([low, high | (np.uint64(1) << np.uint64(32))], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(places.view(np.int64)), pa.array(np.repeat(fps[a:b], 66).view(np.int64))], ["place", "fp"])


def _ball_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = _columns(batch)[0].view(np.uint64)
        for a, b in chunks([1] * len(fps), 128):
            own = fps[a:b, None]
            places = np.concatenate([own ^ NEAR_BALL, own ^ FAR_RING], axis=1).ravel()
            ring = np.tile(np.repeat([0, 1], [len(NEAR_BALL), len(FAR_RING)]), b - a).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(places.view(np.int64)), pa.array(ring), pa.array(np.repeat(fps[a:b], len(NEAR_BALL) + len(FAR_RING)).view(np.int64))], ["place", "ring", "fp"])


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between distinct fingerprints (uint64); at most one fewer than they are."""
    if len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else []
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):  # breadth first; a block of the front at a time
            block, front = front[:SQUARE], front[SQUARE:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= radius
            hit = near.any(axis=0)
            reached = rest[hit]
            out += zip(block[near[:, hit].argmax(axis=0)].tolist(), reached.tolist(), strict=True)
            front, rest = np.concatenate([front, reached]), rest[~hit]
    return out


def _edges(pairs: list[tuple[int, int]], crowded: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    found = np.unique(np.array(pairs, np.uint64).reshape(-1, 2), axis=0)
    a = np.concatenate([found[:, 0], *(np.full(len(fps), hub, np.uint64) for hub, fps in crowded)])
    b = np.concatenate([found[:, 1], *(fps for _, fps in crowded)])
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.arange(len(a)) >= len(found))], ["a", "b", "crowded"])


def verified(crowd: int, radius: int = RADIUS):
    """For rows sorted by place: edges among those that meet; of crowded places each fingerprint (b) with the first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, hub = None, [], None  # of the group that may go on; hub: the first of a crowded one
        for batch in batches:
            places, fps = _columns(batch)
            fps = fps.view(np.uint64)
            pairs, crowded = [], []
            starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.empty(0, int)
            ends = np.append(starts[1:], len(places)) if len(places) else starts
            # The first group may go on with the held one; the last may go on in the next batch.
            inner = np.flatnonzero((ends - starts > 1) & (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < len(starts) - 1))
            for i in ([0] if len(starts) else []) + inner.tolist() + ([len(starts) - 1] if len(starts) > 1 else []):
                group = fps[starts[i] : ends[i]]
                if i == 0 or i == len(starts) - 1:
                    if place != places[starts[i]]:
                        if sum(map(len, held)) > 1 and hub is None:
                            pairs += forest(np.concatenate(held), radius)
                        place, held, hub = places[starts[i]], [], None
                    held.append(group)
                    if hub is not None or sum(map(len, held)) > crowd:
                        hub = held[0][0] if hub is None else hub
                        crowded += [(hub, x) for x in held]
                        held = []
                elif len(group) > crowd:
                    crowded.append((group[0], group))
                else:
                    pairs += forest(group, radius)
            if pairs or crowded:
                yield _edges(pairs, crowded)
        if sum(map(len, held)) > 1 and hub is None:
            yield _edges(forest(np.concatenate(held), radius), [])

    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by place and ring: each fingerprint's edge to the first within radius 1 of its place, if any."""
    place, hub = None, None
    for batch in batches:
        places, rings, fps = _columns(batch)
        if not len(places):
            continue
        fresh = np.append(places[0] != place, places[1:] != places[:-1])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), -1))
        known = (at >= 0) | (hub is not None)
        first = np.where(at >= 0, fps[at], hub if hub is not None else 0)
        good = known & np.where(at >= 0, rings[at] == 0, hub is not None) & (first != fps)
        found = np.unique(np.stack([first[good], fps[good]], axis=1), axis=0)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        place, last = places[-1], at[-1]
        if last >= 0:
            hub = fps[last] if rings[last] == 0 else None


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``distinct``: fp, each once. Edges (a, b) between fingerprints at RADIUS bits or fewer: as many as connect all
    fingerprints that such links connect."""
    met = distinct.select("fp").mapInArrow(_half_variants, "place long, fp long").repartition("place").sortWithinPartitions("place")
    met = written(met.mapInArrow(verified(crowd), "a long, b long, crowded boolean"), "met")
    # These are few: distinct fingerprints of places with over CROWD of them.
    balls = met.where("crowded").select(F.col("b").alias("fp")).distinct().mapInArrow(_ball_variants, "place long, ring byte, fp long")
    dense = balls.repartition("place").sortWithinPartitions("place", "ring", "fp").mapInArrow(_hubs, "a long, b long")
    return met.where("not crowded").select("a", "b").union(dense)


def named_components(fps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``fps`` (doc_id, fp). ``nodes``: each fp and its least doc_id; ``edges``:
    links (a, b) between them."""
    linked = nodes.join(components(edges).withColumnRenamed("v", "fp"), "fp")
    linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    named = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp and component_id."""
    fps = written(fingerprints(docs, text, key, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return named_components(fps, nodes, links(nodes, crowd))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_spread(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
