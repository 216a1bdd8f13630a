"""SimHash near-dedup at a similarity, against all pairs."""

import random
from itertools import combinations

import pytest
from xxhash import xxh64_intdigest

from tessera.llm import similar


def shingles(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {" ".join(words)}


def alike(a, b):
    x, y = shingles(a, 5), shingles(b, 5)
    return len(x & y) / len(x | y) >= 0.8


def printed(text):
    """All bits of the long fingerprint, one by one."""
    found = shingles(text, 3) - {""}
    mask, votes = (1 << 64) - 1, []
    for factor in similar.FACTORS.tolist():
        sums = [0] * 64
        for s in found:
            h = xxh64_intdigest(s.encode(), 42) * factor & mask
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
            h ^= h >> 32
            for k in range(64):
                sums[k] += h >> k & 1
        votes += [2 * x > len(found) for x in sums]
    return votes


def grouped(n, linked):
    least = list(range(n))
    for i, j in linked:
        a, b = least[i], least[j]
        least = [min(a, b) if x in (a, b) else x for x in least]
    return least


def brute(texts):
    """The least place of each text's group: pairs that print alike, or are of one family (by pairs that meet in a part and
    pass the filter), pass the filter and are alike."""
    bits = [printed(t) for t in texts]
    apart = lambda i, j, a, b: sum(x != y for x, y in zip(bits[i][a:b], bits[j][a:b], strict=True))
    ends = range(64, 64 + similar.PARTS * similar.WIDTH, similar.WIDTH)

    def linked(i, j):
        far = apart(i, j, 0, 64)
        meets = any(apart(i, j, a, a + similar.WIDTH) <= 2 for a in ends)
        return far == 0, far <= similar.FILTER and meets, far <= similar.FILTER and alike(texts[i], texts[j])

    found = {(i, j): linked(i, j) for i, j in combinations(range(len(texts)), 2)}
    family = grouped(len(texts), [at for at, (_, met, _) in found.items() if met])
    return grouped(len(texts), [(i, j) for (i, j), (same, _, near) in found.items() if same or (family[i] == family[j] and near)])


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(2), []
    for n in (30, 60, 200, 400):
        for changed in (0, 1, 2, 4, 8, 16, 40):
            base = [f"w{rng.randrange(10_000)}" for _ in range(n)]
            other = list(base)
            for i in rng.sample(range(n), min(changed, n)):
                other[i] = "other"
            out += [" ".join(base), " ".join(other)]
    for _ in range(20):  # ends cut off
        base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
        out += [" ".join(base), " ".join(base[: rng.randrange(140, 200)])]
    return [*out, "", " ", "a b", "A  B", "a b c"]


def stays(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in similar.one_of_each(df).collect())


def test_same_as_all_pairs(spark, texts):
    assert stays(spark, texts) == sorted(set(brute(texts)))


def test_recall(spark, texts):
    wanted = [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(texts[i], texts[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in similar.alike_groups(df).collect()}
    assert sum(root[i] == root[j] for i, j in wanted) >= 0.9 * len(wanted)
    exact = grouped(len(texts), wanted)
    assert all(exact[i] == exact[j] for i, j in combinations(range(len(texts)), 2) if root[i] == root[j])


@pytest.mark.parametrize("changed", [1, 6, 9])
def test_large_groups(spark, changed):
    """120 texts, each with so many words of 150 replaced: all are linked, or chains and single texts are left."""
    rng = random.Random(changed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        words = list(base)
        for i in rng.sample(range(150), changed if k % 3 else 1):
            words[i] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(words))
    assert stays(spark, texts) == sorted(set(brute(texts)))


def test_places_of_any_size(spark, texts, monkeypatch):
    """Places over CROWD are taken for families without a look, families of many blocks are compared block by block: whoever
    meets is compared all the same."""
    near = similar.verified(0, similar.FILTER)
    monkeypatch.setattr(similar, "verified", lambda crowd, radius: near)
    monkeypatch.setattr(similar, "BLOCK_BYTES", 2000)
    met = set(brute(texts))
    assert set(stays(spark, texts)) <= met


def test_blocks():
    """Edges within blocks and between them connect what all pairs connect."""
    import numpy as np

    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(99)}" for w in base) for _ in range(60)]
    fps = np.array([similar.long_fingerprint(t)[0] for t in texts], np.int64).view(np.uint64)
    near = lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= similar.FILTER and alike(texts[i], texts[j])
    want = grouped(60, [(i, j) for i, j in combinations(range(60), 2) if near(i, j)])
    block = np.array([rng.randrange(3) for _ in texts])
    edges = []
    for i, j in [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]:
        at = np.flatnonzero((block == i) | (block == j))
        found = similar.linked(fps[at], [texts[k] for k in at], block[at] == i if i != j else None)
        edges += [(int(at[a]), int(at[b])) for a, b in found]
    assert 1 < len(set(want)) < 60 and grouped(60, edges) == want == grouped(60, similar.linked(fps, texts, None))


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None), (3, ""), (None, " "), (None, "lone words here now"), (8, "x y z"), (8, "x y z"), (8, "other words than these")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in similar.one_of_each(df).collect()]
    assert sorted(kept, key=str) == [(3, ""), (8, "other words than these"), (8, "x y z"), (None, "lone words here now")]
    assert similar.one_of_each(df.limit(0)).collect() == []


def test_texts_as_keys_and_clashing_names(spark):
    rows = [("b", "x y z w", 1, 2, 3), ("a", "x y z w", 4, 5, 6), ("c", "long " * 100_000, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id string, body string, fp int, dedup_key int, hash int")
    assert sorted(tuple(r) for r in similar.one_of_each(df, "body", "id").collect()) == sorted([rows[1], rows[2]])
