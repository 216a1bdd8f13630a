"""SimHash near-dedup at a similarity: texts whose sets of five-word shingles are 0.8 alike or more (Jaccard).

So alike, two fingerprints differ in a tenth to a sixth of their bits, and no ball around a whole fingerprint that can be
written down holds the other. The fingerprint is therefore longer: beside 64 bits it has ``PARTS`` parts of ``WIDTH`` bits
of their own, and two texts meet where they differ in two or fewer bits of one part. As in ``simhash``, every distinct
fingerprint emits all variants within half of that radius (of each part the part itself and its WIDTH neighbours),
variants are shuffled, and those that collide are verified: first by their 64 bits (``FILTER``), then by the exact
similarity of their texts. Fingerprints are over words' triples, of which an edit spoils fewer than of fives: at equal
recall that takes half of the variants. The number of variants a text emits doesn't depend on the size of the corpus.

What passes the filter in a place is kept as the edges of a spanning forest (of a place of over ``CROWD`` fingerprints as
a star, without a look). Their components are families, and alike texts that meet are of one family. A family's texts are
dealt into blocks, and every two blocks meet in one task: pairs that pass the filter are compared there, the nearest
first and none that is connected already, and again a forest is kept. So no pairs of fingerprints or texts are written,
a text is copied once for each block of its family, and no task holds more than two blocks, however large a family is.

Defined results: words are parted by ASCII white space, A-Z is lower-cased; a text of fewer words than a shingle is one
shingle; null and empty texts are alike; texts of one 64-bit fingerprint are taken for alike without a comparison; a row
without a key stays only if its group has none with one; rows that repeat key and text count once; keys that repeat with
different texts are told apart by the text; an empty table gives no row; further columns stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, free_names, text_or_empty, written
from tessera.llm.components import components
from tessera.llm.simhash import majority, shingle_hashes, verified

SHINGLE = 5
ALIKE = 0.8
#: Words of the shingles that fingerprints are made of.
PRINTED = 3
PARTS, WIDTH = 8, 28
#: Most differing bits, of 64, of fingerprints whose texts are compared. At a similarity of 0.8 they are about 7.
FILTER = 13
#: Most fingerprints of one place that are compared there.
CROWD = 1 << 16
#: Bytes of text of a block, about, at most; a family of n texts has sqrt(n) / BLOCKS blocks at least.
BLOCK_BYTES = 4 << 20
BLOCKS = 8
#: Rows compared at a time.
SQUARE = 512

BALL = np.append(np.int64(0), np.int64(1) << np.arange(WIDTH, dtype=np.int64))
#: Odd factors that make further hashes of a shingle's.
FACTORS = (np.arange(1 + -(-PARTS * WIDTH // 64), dtype=np.uint64) * np.uint64(2 * 7919) + np.uint64(24_691)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def long_fingerprint(text: str) -> tuple[int, list[int]]:
    """64 bits (as a signed number) and the parts, over the set of the text's shingles."""
    hashes = np.unique(shingle_hashes(text, PRINTED))
    if not len(hashes):
        return 0, [0] * PARTS
    mixed = hashes[:, None] * FACTORS
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    bits = majority(mixed)
    fp = int(np.packbits(bits[:64], bitorder="little").view("<i8")[0])
    return fp, (bits[64 : 64 + PARTS * WIDTH].reshape(PARTS, WIDTH) @ BALL[1:]).tolist()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks([1] * batch.num_rows, 512):
            fps = batch.column(0).slice(a, b - a).to_numpy()
            parts = batch.column(1).slice(a, b - a).flatten().to_numpy().astype(np.int64).reshape(-1, PARTS)
            places = (parts[:, :, None] ^ BALL) | (np.arange(PARTS, dtype=np.int64) << np.int64(WIDTH))[None, :, None]
            yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), pa.array(np.repeat(fps, PARTS * len(BALL)))], ["place", "fp"])


def linked(fps: np.ndarray, texts: list[str], first: np.ndarray | None) -> list[tuple[int, int]]:
    """Places of a spanning forest's edges between alike texts: of all, or, where ``first`` marks one of two blocks, of one
    block with the other."""
    mine = {}  # shingles' hashes

    def shingles(i: int) -> set[int]:
        if i not in mine:
            mine[i] = set(shingle_hashes(texts[i], SHINGLE).tolist())
        return mine[i]

    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    rows, columns = (np.arange(len(fps)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    near = []
    for a in range(0, len(rows), SQUARE):
        bits = np.bitwise_count(fps[rows[a : a + SQUARE], None] ^ fps[None, columns])
        i, j = np.nonzero(bits <= FILTER)
        found = np.stack([bits[i, j].astype(np.int64), rows[a + i], columns[j]])
        near.append(found[:, found[1] < found[2]] if first is None else found)
    pairs = np.concatenate([np.empty((3, 0), np.int64), *near], axis=1)
    out = []
    for _, i, j in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
        if find(i) != find(j):
            x, y = shingles(i), shingles(j)
            if min(len(x), len(y)) >= ALIKE * max(len(x), len(y)) and (both := len(x & y)) >= ALIKE * (len(x) + len(y) - both):
                root[find(i)] = find(j)
                out.append((i, j))
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (root, i, j, block, fp, text) sorted by family and pair of blocks: edges between alike texts."""

    def of(group: list[tuple]) -> list[tuple[int, int]]:
        (_, i, j), fps, texts = group[0][0], np.array([x[2] for x in group], np.int64), [x[3] for x in group]
        first = np.array([x[1] for x in group]) == i if i != j else None
        return [(int(fps[a]), int(fps[b])) for a, b in linked(fps.view(np.uint64), texts, first)]

    held, group, out = None, [], []
    for batch in batches:
        for root, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, i, j) != held:
                out += of(group) if len(group) > 1 else []
                held, group = (root, i, j), []
            group.append((held, *row))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["a", "b"])
            out = []
    if len(group) > 1 and (out := of(group)):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["a", "b"])


def links(nodes: DataFrame, texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``nodes``: fp (each once), parts and hash; ``texts``: hash and text of rows. (v, root): the component of each fp that
    is alike another, by links between those that meet."""
    met = nodes.select("fp", "parts").mapInArrow(_variants, "place long, fp long").repartition("place").sortWithinPartitions("place")
    met = written(met.mapInArrow(verified(crowd, FILTER), "a long, b long, crowded boolean").select("a", "b"), "met")
    family = written(components(met).withColumnRenamed("v", "fp").join(nodes.select("fp", "hash"), "fp"), "family")
    asked = written(texts.join(family, "hash").dropDuplicates(["fp"]).select("root", "fp", "text"), "asked")
    sizes = asked.groupBy("root").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.sqrt("n") / BLOCKS), F.lit(1)).cast("int").alias("blocks"))
    placed = asked.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = copies.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "text")
    dealt = copies.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "fp")
    return components(dealt.mapInArrow(_alike, "a long, b long"))


def alike_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, hash (of its text) and root, the same for all texts that links connect."""
    whole = text_or_empty(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [long_fingerprint(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "fp", "parts"])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    prints = written(rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, hash long, fp long, parts array<int>"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("parts").alias("parts"), F.min("hash").alias("hash")), "nodes")
    found = links(nodes, rows.select("hash", "text"))
    return prints.join(found.withColumnRenamed("v", "fp"), "fp", "left").select("doc_id", "hash", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each group the row of the least key stays (of equal keys that of the
    least hash of its text, of equal rows one). Whole rows are shuffled once, by key and text's hash."""
    name, hash_, none = free_names(docs, "dedup_key", "dedup_hash", "dedup_none")
    found = alike_groups(docs, text, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    chosen = found.groupBy("root").agg(first.alias("m"), F.count("*").alias("n")).select("m.*", "n")
    stay = written(chosen.select(F.col("none").alias(none), F.col("doc_id").alias(name), F.col("hash").alias(hash_), "n"), "stay")
    rows = docs.withColumn(hash_, F.xxhash64(text_or_empty(text)))
    same = lambda side: (F.col(key).isNull() == side[none]) & F.col(key).eqNullSafe(side[name]) & (rows[hash_] == side[hash_])
    alone, several = (stay.where(c).drop("n") for c in ("n = 1", "n > 1"))
    kept = rows.join(alone.hint("merge"), same(alone), "left_semi")
    # Of rows that repeat key and text one stays.
    repeated = rows.join(several, same(several), "left_semi").dropDuplicates([key, hash_])
    return kept.select(*docs.columns).unionByName(repeated.select(*docs.columns))
