"""Host-level quality rules, with DataFrame functions alone.

Every document is measured once (words, repeated three-word windows, repeated lines, symbols) and tested by its rules.
Failures are summed by host (a column; ``source`` for the documents table), each host's failure rate is shrunk towards
the corpus rate with a beta prior fitted to the hosts' rates by moments, and a host whose shrunk rate is over
``max_rate`` loses all its documents. The verdicts are joined back; the measures were written, so the texts are read once.

Defined results: a null or empty text has no words and fails the base rule; null hosts are one host of their own;
repeated rows and null doc_ids get a row each; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_spread, text_or_empty, written

#: White space that parts words, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
#: A document fails further rules beyond these shares.
MAX_SYMBOL_SHARE = 0.1
MAX_DUP_LINE_SHARE = 0.3
#: A host is rejected if its shrunk rate of failing documents is over this.
MAX_RATE = 0.5


def _long(c: Column) -> Column:
    return c.cast("long")


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that the text has at least twice.

    Windows are sorted by their hash, so equal ones are neighbours; neighbours of equal hash are compared word by word.
    The places of repeated windows, in order, then cover 3 words each, less what overlaps."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        def same(p: Column, q: Column) -> Column:
            a, b = F.get(s, p), F.get(s, q)
            equal = lambda k: F.get(words, a["i"] + k) == F.get(words, b["i"] + k)
            return F.coalesce((a["h"] == b["h"]) & equal(0) & equal(1) & equal(2), F.lit(False))

        return F.filter(s, lambda _, p: same(p, p + 1) | same(p - 1, p))

    # A one-element transform binds the sorted array, so that it is computed once.
    marked = F.get(F.transform(F.array(F.sort_array(windows)), lambda s: F.sort_array(F.transform(places(s), lambda x: x["i"]))), F.lit(0))
    covered = lambda m: F.aggregate(m, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))["n"]
    return F.when(n < 3, F.lit(0)).otherwise(covered(marked))


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """doc_id, host, the counts, and whether the base rule and any rule fail."""
    t = F.col("text")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), text_or_empty(text).alias("text"))
    # The array is bound by an array column of its own; Spark would otherwise split the text anew wherever it is used.
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0)
    counted = rows.select(
        "doc_id", "host",
        F.inline(F.array(F.struct(words.alias("words"), lines.alias("lines"), _long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"), _long(F.length(F.translate(t, " \t\n\u000b\f\r", ""))).alias("word_chars")))),
    )
    counted = counted.select(
        "doc_id", "host", _long(F.size("words")).alias("n_words"), "word_chars", "n_symbols",
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), _long(F.size("lines")).alias("n_lines"), _long(repeated_words(F.col("words"))).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    other = (F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars")) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
    return counted.withColumn("base_failed", base).withColumn("failed", base | other)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, documents, failures, shrunk_rate, host_ok: one row per host."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("documents"), F.count_if("failed").alias("failures"))
    rate = F.col("failures") / F.col("documents")
    # Moments over hosts: the spread of rates beyond what hosts of that size show by chance.
    moments = hosts.agg(
        F.sum("documents").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("k"), F.sum(1 / F.col("documents")).alias("inverse"),
        F.sum(rate).alias("s"), F.sum(rate * rate).alias("ss"),
    )
    n, f, k = F.col("n"), F.col("f"), F.col("k")
    mean = (f + 0.5) / (n + 1)
    chance = mean * (1 - mean) * F.col("inverse") / k
    spread = F.greatest(F.col("ss") / k - 2 * mean * F.col("s") / k + mean * mean - chance, F.lit(1e-6))
    prior = moments.select(mean.alias("mean"), F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)).alias("strength"))
    one = prior.first()  # two numbers
    shrunk = (F.col("failures") + F.lit(one["mean"] or 0.0) * F.lit(one["strength"] or 1.0)) / (F.col("documents") + F.lit(one["strength"] or 1.0))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_ok", F.col("shrunk_rate") <= max_rate)


#: Hosts are salted so that one with a third of all documents meets its verdict in many tasks.
SALTS = 64


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of every document with its host's verdict in ``kept``."""
    measured = written(measures(docs, text, key, host), "measures")
    verdicts = written(host_verdicts(measured, max_rate).select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("unknown"), "shrunk_rate", "host_ok"), "hosts")
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Of the measures, not the key alone, lest rows of one doc_id all get one salt.
    salt = F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int")
    rows = measured.withColumn("h", F.coalesce("host", F.lit(""))).withColumn("unknown", F.col("host").isNull()).withColumn("salt", salt)
    return rows.join(salted, ["h", "unknown", "salt"]).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(read_spread(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: For DuckDB. Its regular expressions are bytes' classes alike; windows are compared as lists of words.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), numbered AS (SELECT row_number() OVER () AS r, * FROM d),
pos AS (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM numbered WHERE len(words) >= 3),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(3, i - coalesce(prev, -9))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM dup) GROUP BY r),
m AS (
  SELECT doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN rep USING (r)
), t AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols > 0.1::DOUBLE * word_chars OR n_dup_lines > 0.3::DOUBLE * n_lines AS other FROM m
), h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR other) AS f FROM t GROUP BY source),
s AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(1.0::DOUBLE / n) AS inverse, sum(f / n) AS s, sum((f / n) * (f / n)) AS ss FROM h),
p AS (SELECT *, (f + 0.5::DOUBLE) / (n + 1) AS mean FROM s),
q AS (SELECT mean, greatest(mean * (1 - mean) / greatest(ss / k - 2 * mean * s / k + mean * mean - mean * (1 - mean) * inverse / k, 1e-6::DOUBLE) - 1, 1.0::DOUBLE) AS strength FROM p),
v AS (SELECT source, (f + mean * strength) / (n + strength) <= 0.5 AS host_ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM t JOIN v ON t.source IS NOT DISTINCT FROM v.source
"""
