"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every unfinished sequence
applies its lowest-ranked pair at all its places at once, until no sequence has a pair with a rank; the symbols that
survive are the tokens. Merging all places at once equals the library's one-by-one order because every symbol of the
vocabulary has one merge only, so a pair with a new symbol always ranks after the merge that made it.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id and repeated rows pass through, a row for
each row; an empty table gives no row; further columns are ignored (``count_tokens`` takes the names of its two)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, read_spread, text_or_empty
from tessera.llm.pretokens import Numbers, PreTokenizer, byte_symbols

#: Distinct pre-tokens that a worker remembers at most; it forgets all of them beyond that. Speed only.
REMEMBERED = 400_000
#: UTF-8 bytes of text that are split and merged together.
BATCH_BYTES = 2 << 20


class RankMerger:
    """Byte-pair merges of many short byte sequences at once."""

    def __init__(self, description: dict):
        vocab = description["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in description["model"]["merges"]]
        symbols = byte_symbols()
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.width = 1 + max(vocab.values())
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.append(np.array([vocab[a + b] for a, b in merges], np.int64), -1)
        self._index(left * self.width + right)

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table of the pairs: slot to pair, slot to rank."""
        self.mask = (1 << (len(keys) * 4).bit_length()) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, len(keys), np.int64)
        left, ranks = keys, np.arange(len(keys))
        slots = self._slot(left)
        while len(left):
            free = self.slot_key[slots] == -1
            self.slot_key[slots[free]] = left[free]  # of several for one slot the last stays
            won = self.slot_key[slots] == left
            self.slot_rank[slots[won]] = ranks[won]
            left, ranks, slots = left[~won], ranks[~won], (slots[~won] + 1) & self.mask
        self.unranked = len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``unranked`` for pairs that never merge."""
        keys = left * self.width + right
        slots = self._slot(keys)
        out = self.slot_rank[slots]
        there = self.slot_key[slots]
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            there = self.slot_key[slots[todo]]
            out[todo] = self.slot_rank[slots[todo]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        return out

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that survive, of all sequences one after the other, and how many each sequence has."""
        counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        if not len(symbols):
            return symbols, counts
        began = np.cumsum(counts) - counts
        out = np.empty(len(symbols), np.int64)
        alive = np.flatnonzero(counts > 0)
        lengths = counts[alive]
        ranks = np.full(len(symbols), self.unranked)
        ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
        ranks[np.cumsum(lengths) - 1] = self.unranked
        while len(alive):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < self.unranked
            owner = np.repeat(np.arange(len(alive)), lengths)
            if not going.all():  # finished sequences leave
                still = going[owner]
                ended = ~still
                within = np.arange(len(symbols)) - starts[owner]
                out[(began[alive][owner] + within)[ended]] = symbols[ended]
                counts[alive[~going]] = lengths[~going]
                symbols, ranks, alive, lengths, lowest = symbols[still], ranks[still], alive[going], lengths[going], lowest[going]
                owner = np.repeat(np.arange(len(alive)), lengths)
                if not len(alive):
                    break
            place = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            # In a run such as "aaa" the places overlap: take the first, third ... of each run.
            fresh = np.ones(len(place), bool)
            fresh[1:] = place[1:] != place[:-1] + 1
            if not fresh.all():
                head = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
                place = place[(place - head) % 2 == 0]
            symbols[place] = self.made[ranks[place]]
            lengths = lengths - np.bincount(owner[place], minlength=len(alive))
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            # The merged symbol and the one before it have new neighbours.
            changed = place - np.arange(len(place))
            symbols, ranks = symbols[keep], ranks[keep]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(lengths) - 1] = True
            changed = np.concatenate([changed, changed[changed > 0] - 1])
            inner = changed[~last[changed]]
            ranks[changed] = self.unranked
            ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        total = int(counts.sum())
        return out[np.repeat(began - (np.cumsum(counts) - counts), counts) + np.arange(total)], counts

    def count(self, sequences: list[bytes]) -> np.ndarray:
        return self.merge(sequences)[1]


class TokenCounter:
    """Counts tokens of whole texts; remembers the counts of pre-tokens it has met."""

    def __init__(self, path: str | None = None):
        self.splitter = PreTokenizer(path)
        self.merger = RankMerger(self.splitter.description)
        self.known, self.counts = Numbers(), np.empty(0, np.int64)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known, self.counts = Numbers(), np.empty(0, np.int64)
        places = [self.known.of(self.splitter.split(t)[0]) for t in texts]
        new = self.known.taken()
        counts = self.merger.count([b"" if w in self.splitter.special else w.encode() for w in new])
        counts[[w in self.splitter.special for w in new]] = 1
        self.counts = np.concatenate([self.counts, counts])
        return [int(self.counts[at].sum()) for at in places]


@cache
def worker_counter(path: str | None) -> TokenCounter:
    """One for each Python worker, which outlives its tasks."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row of ``docs``; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            for a, b in chunks(sizes, BATCH_BYTES):
                n = counter.count(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    text_col = text_or_empty(text)
    rows = docs.select(F.col(key).alias("doc_id"), text_col.alias("text"), F.octet_length(text_col).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_spread(spark, sf_dir, "documents"))
