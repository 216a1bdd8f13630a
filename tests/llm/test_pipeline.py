"""The pipeline against a brute-force version of each stage, on the stage's own input."""

import pytest

import corpus_pipeline
from tessera.llm import packing, pii, toxicity
from tests.llm.test_native import named, poisson
from tests.llm.test_similar import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    home = tmp_path_factory.mktemp("stages")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        after = spark.read.parquet(f"{home}/{name}")
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(stages, spark, sf_dir):
    before, after, _ = stages[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if scores[r.doc_id] < toxicity.THRESHOLD)


def test_near_dedup(stages):
    before, after, _ = stages[1]
    before = sorted(before, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(before[i].doc_id for i in set(brute([r.text or "" for r in before])))


def test_pii(stages):
    before, after, _ = stages[2]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    texts = {r.doc_id: r.text for r in before}
    assert any(r.text != texts[r.doc_id] for r in after) and all("AKIA" not in (r.text or "") for r in after)
    assert pii.ROUNDS % 2 == 0


def test_mixing(stages):
    import hashlib
    from collections import Counter

    before, after, _ = stages[3]
    n = Counter(r.source for r in before)
    got = Counter(r.doc_id for r in after)
    for r in before:
        u = int(hashlib.md5(f"7|{named(r.doc_id, r.text)}|1".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert got[r.doc_id] == poisson(u, len(before) / len(n) / n[r.source])


def test_packing(stages):
    from collections import Counter

    from tokenizers import Tokenizer

    from tessera.llm.pretokens import vocabulary_path

    before, after, _ = stages[4]
    library = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in before:
        for start, length in _pieces(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1):
            want[(r.doc_id, start, length)] += 1
    assert Counter((r.doc_id, r.start, r.length) for r in after) == want


def _pieces(n):
    at = 0
    for length in packing.cuts(n):
        yield at, length
        at += length


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, (r[:5] for r in got.collect()))) == sorted(map(str, (r[:5] for r in stages[4][1])))
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
