"""Mixing of sources to target weights by Poisson replication, with DataFrame functions alone.

A source's mean repetition rate is its share of the target size over its documents. Each document draws its number of
copies by inverting the Poisson distribution function at a number in [0, 1) made from a keyed hash of its doc_id and text,
so a draw depends on nothing but the key, the document and the rate. Documents are exploded by their counts and sorted by
a second keyed hash of document and copy: a global shuffle that any run repeats. As that hash is uniform, the ranges of
the sort's partitions are equal shares of its span, and nothing is computed twice to sample them. A rate over ``MOST_RATE`` is split into
equal parts with draws of their own, whose sum is distributed alike.

Defined results: null sources are one source; rows that share a doc_id (null, say) draw by their texts as well; rows that
repeat both draw alike and get their copies each, side by side in the order; null and empty texts are documents like any other; an empty table gives no row; further columns stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_names, read_table, written

SEED = 7
#: Above it a rate is split, so that e^-rate stays far from zero.
MOST_RATE = 32.0
#: Terms of the distribution function: at MOST_RATE the rest is under 1e-17.
TERMS = 110
#: So many sources at most are broadcast (under 1 kB each); more are joined by a shuffle, salted.
BROADCAST_SOURCES = 10_000
SALTS = 64


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, size: int | None = None) -> DataFrame:
    """source, rate, draws and cdf (of rate / draws) of each source. ``weights``: by source, others get none; equal
    weights for all by default. ``size``: target number of documents; as many as there are by default."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else F.lit(None).cast("map<string,double>")
        counts = counts.withColumn("weight", F.coalesce(F.get(F.transform(F.array("source"), lambda s: table[s]), F.lit(0)), F.lit(0.0)))
    else:
        counts = counts.withColumn("weight", F.lit(1.0))
    counts = written(counts, "sources")
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    target, all_weights = float(size if size is not None else total["n"] or 0), float(total["w"] or 0) or 1.0
    rate = F.lit(target) * F.col("weight") / F.lit(all_weights) / F.col("n")
    out = counts.withColumn("rate", rate).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("s"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["s"] + p).alias("s"), F.concat(acc["cdf"], F.array(acc["s"] + p)).alias("cdf"))

    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cdf"]).select("source", "n", "rate", "draws", "cdf")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = SEED, copy: str = "mix_copy", order: str = "mix_order") -> DataFrame:
    """All columns of ``docs`` with the number of the copy (from 1) and the sort key, in its order."""
    their_source, name, draws, cdf, salt, their_salt, number = free_names(docs, "mix_source", "mix_name", "mix_draws", "mix_cdf", "mix_salt", "mix_their_salt", "mix_n")
    table = written(rates(docs, source, weights, size).select(F.col("source").alias(their_source), F.col("draws").alias(draws), F.col("cdf").alias(cdf)), "rates")
    rows = docs.withColumn(name, F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    same = F.col(source).eqNullSafe(F.col(their_source))
    if table.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn(their_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(name, text), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, same & (F.col(salt) == F.col(their_salt)))
    seeds = F.lit(str(seed))
    # One element at a time, so that each draw is hashed once and then compared with the terms.
    drawn = lambda j: F.aggregate(F.transform(F.array(unit(seeds, F.col(name), j.cast("string"))), lambda u: F.size(F.filter(cdf, lambda c: c <= u))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn(number, F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda a, j: a + drawn(j))).where(F.col(number) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number))))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), name, F.col(copy).cast("string"))), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn(order, place).select(*docs.columns, copy, order)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, F.floor(F.col(order) / F.lit(2.0**60 / parts)).cast("int")).sortWithinPartitions(order, key)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "text", F.col("mix_copy").cast("long").alias("copy"), F.col("mix_order").alias("shuffle_key"))


OP9_SQL = """
WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * 1.0::DOUBLE / (SELECT count(*) FROM n) / n AS rate FROM n),
p AS (SELECT source, rate, greatest(1, ceil(rate / 32))::INT AS draws FROM r),
t AS (SELECT source, k, exp(-rate / draws) * pow(rate / draws, k) / gamma(k + 1) AS pk FROM p, range(0, 111) AS x(k)),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (SELECT source, k, sum(pk) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t) GROUP BY source),
named AS (SELECT d.doc_id, d.source, d.text, coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, '')) AS name, p.draws, c.cdf,
  row_number() OVER () AS r FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON c.source IS NOT DISTINCT FROM p.source),
u AS (SELECT *, ('0x' || substr(md5('7|' || name || '|' || j), 1, 13))::BIGINT / pow(2.0, 52) AS u FROM (SELECT *, unnest(range(1, draws + 1)) AS j FROM named)),
k AS (SELECT r, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(text) AS text, any_value(name) AS name,
  sum(len(list_filter(cdf, lambda x: x <= u)))::BIGINT AS n FROM u GROUP BY r),
e AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM k)
SELECT doc_id, source, text, copy, ('0x' || substr(md5('7/order|' || name || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM e
"""
