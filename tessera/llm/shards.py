"""Sharding by a two-pass external shuffle.

Pass 1 scatters every record into a bucket by seeded hashes: the shard is the highest of the keyed hashes of doc_id and
shard (so one more shard takes rows only into itself), and within a shard the bucket is a hash as well. There are so many
buckets that each holds about ``bucket_bytes`` of text, at any size of the corpus; a shuffle partition takes several of
them one after the other where there are more than ``MOST_PARTITIONS``. Rows that are equal in doc_id and text can't be
told apart by a hash: where more of them than ``REPEATS`` are, each goes to a bucket by a number of its own, so a hot row
is spread over all buckets of its shard. Pass 2 puts each bucket in a fixed order and permutes it by a Fisher-Yates
shuffle seeded by the bucket; a record's slot is its place there behind the shard's earlier buckets.

Defined results: a null text has size 1 and the CRC of no bytes; null doc_ids are hashed as one key and share a shard;
repeated rows get slots of their own; an empty table gives no row; further columns ride along if asked for."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read_table, written

SHARDS = 8
SEED = 20_240_501
#: Text that a bucket holds about: what a task shuffles in memory.
BUCKET_BYTES = 16 << 20
#: Partitions of the shuffle at most: beyond, a partition is sorted by bucket and holds several; a task holds one at a time.
MOST_PARTITIONS = 20_000
#: Rows of one doc_id and text that stay in one bucket.
REPEATS = 1000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose keyed hash is highest; a tie goes to the higher shard."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*scores)["s"] if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n places: each place from the last on swaps with a random one up to itself."""
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    out = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """For rows sorted by bucket: each bucket's rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
            if held and held[-1].column(held[-1].schema.get_field_index("bucket"))[-1].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def permuted(table: pa.Table, seed: int) -> Iterator[pa.RecordBatch]:
    """The rows of whole buckets, each bucket put in a fixed order and shuffled, with their places."""
    if not table.num_rows:
        return
    table = table.sort_by([("bucket", "ascending"), ("h", "ascending"), ("doc_id", "ascending"), ("text_crc32", "ascending")])
    bucket = table["bucket"].to_numpy()
    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    order = np.concatenate([a + fisher_yates(b - a, seed + int(bucket[a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    place = np.concatenate([np.arange(b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    table = table.take(pa.array(order)).append_column("place", pa.array(place, pa.int64()))
    names = ["doc_id", "text", "size", "shard", "grown_shard", "text_crc32", "bucket", "place"]
    yield from table.select(names).to_batches(max_chunksize=4096)


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text, size, text_crc32, shard, slot and grown_shard of every row, each bucket in one partition in slot order."""
    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("doc_id"), t.alias("text"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards, seed)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1, seed))
    rows = rows.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).withColumn("h", F.xxhash64(F.lit(seed + 2), "doc_id", "text"))
    # Texts are read twice: here, for a narrow table of how many rows there are of each, and where they are shuffled.
    seen = written(rows.groupBy("shard", "h").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "seen")
    total = seen.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / shards / bucket_bytes))
    part = lambda *by: F.pmod(F.xxhash64(F.lit(seed + 1), "h", *by), F.lit(parts)).cast("int")
    bucket = lambda *by: F.col("shard").cast("long") * parts + part(*by)
    hot = written(seen.where(F.col("n") > REPEATS).select("h", "shard", "n"), "hot") if parts > 1 else None
    if hot is not None and hot.isEmpty():
        hot = None
    if hot is None:
        rows = rows.withColumn("bucket", bucket())
        counts = seen.withColumn("bucket", bucket()).groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    else:
        # The k-th of the equal rows goes to the bucket of h and k mod parts; which of them is the k-th makes no difference.
        names = hot.select("h", F.lit(True).alias("repeated"))
        marked = rows.join(names, "h", "left")
        turn = F.when(F.col("repeated"), F.monotonically_increasing_id() % parts)
        marked = written(marked.withColumn("turn", turn), "turns")
        rows = marked.withColumn("bucket", F.when(F.col("repeated"), bucket("turn")).otherwise(bucket())).drop("repeated", "turn")
        counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # One row for each bucket: as many as the corpus has memory-sized pieces.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    kind = docs.schema[key].dataType.simpleString()
    dealt = rows.repartitionById(min(shards * parts, MOST_PARTITIONS), F.pmod(F.col("bucket"), F.lit(MOST_PARTITIONS)).cast("int"))
    dealt = dealt.sortWithinPartitions("bucket") if shards * parts > MOST_PARTITIONS else dealt

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shards * parts <= MOST_PARTITIONS:
            held = list(batches)
            return permuted(pa.Table.from_batches(held), seed) if held else iter(())
        return (x for table in whole_buckets(batches) for x in permuted(table, seed))

    out = dealt.mapInArrow(shuffle, f"doc_id {kind}, text string, size long, shard int, grown_shard int, text_crc32 long, bucket long, place long")
    return out.join(offsets, "bucket").withColumn("slot", F.col("offset") + F.col("place")).drop("bucket", "place", "offset")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shuffled_shards(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
