"""Token counts and packing against the library, and packing's laws."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.packing import CAPACITY, HarmonicBins, IdEncoder, cuts, op5_packing, pack
from tessera.llm.pretokens import vocabulary_path
from tessera.llm.tokens import TokenCounter, count_tokens, op1_token_counts

ODD = [
    "", " ", "a", "it's we'LL 'sx ''s", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endof", "aaaa" * 900, "ababab" * 300, "  \n\n \t x  ",
    "² ½ Ⅷ x2", "x\x1cy\x1d z", "漢字かなカナ", "é àb", "😀😀👩‍👩‍👧", "__a_b1__", "1234567 12.5", "  x", "Ünïcödé ñandú ßtraße", "\x00\x01", "a" * 5000, "end ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_odd_texts(library):
    wanted = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert TokenCounter().count(ODD) == [len(w) for w in wanted]
    assert [list(x) for x in IdEncoder().encode(ODD)] == wanted


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    library = Tokenizer.from_file(vocabulary_path())
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in IdEncoder().encode(texts)] == wanted
    assert TokenCounter().count(texts) == [len(w) for w in wanted]


def test_forgetting(library, monkeypatch):
    from tessera.llm import packing, tokens

    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    counter, encoder = TokenCounter(), IdEncoder()
    for text in ["one two three four five six seven", "one eight nine ten", "two three"]:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert counter.count([text]) == [len(wanted)] and [list(x) for x in encoder.encode([text])] == [wanted]


def test_counts_of_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def test_count_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")], "doc_id long, text string, n_tokens string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df).collect()) == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert count_tokens(df.limit(0)).collect() == []


def laws(rows, wanted):
    """wanted: token ids of each document, the end token with them."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(wanted)
    for doc_id, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(wanted[doc_id])
            assert p.ids_crc32 == zlib.crc32(np.array(wanted[doc_id][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(wanted[doc_id])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= CAPACITY
        padding += 0 if at & (at - 1) == 0 else CAPACITY - at
    return padding


def test_packing_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    padding = laws(op5_packing(spark, sf_dir).collect(), wanted)
    assert padding < 0.02 * sum(map(len, wanted.values())) + 2 * CAPACITY


def test_packing_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 3000)], "doc_id long, text string").repartition(3)
    rows = pack(df, with_ids=True).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and all(len(r.ids) == r.length for r in rows)
    assert [r.ids for r in rows if r.doc_id == 1] == [[0]]
    assert pack(df.limit(0)).collect() == []
    twice = pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert len(twice) == 3


@given(st.lists(st.integers(1, 5000), max_size=200))
def test_bins(lengths):
    bins = HarmonicBins(0)
    for i, n in enumerate(lengths):
        pieces = cuts(n)
        assert sum(pieces) == n and all(0 < p <= CAPACITY for p in pieces)
        start = 0
        for p in pieces:
            bins.add((i, start, p, 0, n))
            start += p
    open_before = {k: len(v) for k, v in bins.open.items()}
    assert all(n < k for k, n in open_before.items())
    bins.finish()
    used = {}
    for *_, length, _, _, sequence, offset in [(p[0], p[1], p[2], p[3], p[4], p[5], p[6]) for p in bins.taken()]:
        assert used.get(sequence, 0) == offset
        used[sequence] = offset + length
    assert all(u <= CAPACITY for u in used.values()) and sum(used.values()) == sum(lengths)


def test_most_pieces_of_a_class_fill_its_bin():
    for n in range(1, CAPACITY):
        for p in cuts(n):
            k = CAPACITY // p
            assert k * p > 0.96 * CAPACITY


def test_no_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for f, q in ((count_tokens, op1_token_counts), (pack, op5_packing)):
        assert "Exchange" not in f(docs)._jdf.queryExecution().toString()
        # The query deals out a table of few row groups.
        assert "RoundRobinPartitioning" in q(spark, sf_dir)._jdf.queryExecution().toString()
