"""SimHash, sharding, HTML and toxicity against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import html, shards, simhash, toxicity
from tessera.llm.components import components


def brute_components(fps):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def fingerprint(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    if not words:
        return 0
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ["", " \n", "One", "one TWO", "a b c", "a  b\tc\x0bd", "ÄB c d e", "x " * 500, "a\x1cb c d", "a b c d e f"]:
        assert simhash.fingerprint(text) == fingerprint(text)


def test_same_hash_as_the_engine(spark):
    from pyspark.sql import functions as F

    words = ["a b c", "ñandú", "", "漢字 x y"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()
    assert [r.h % 2**64 for r in got] == [xxh64_intdigest(w.encode(), 42) for w in words]


def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = simhash.op8_simhash_near_dedup(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fingerprint(texts[r.doc_id]):016x}"
    label = brute_components([int(r.fingerprint, 16) for r in rows])
    least = defaultdict(lambda: 1 << 62)
    for one, r in zip(label, rows, strict=True):
        least[one] = min(least[one], r.doc_id)
    assert [r.component_id for r in rows] == [least[one] for one in label]


@pytest.mark.parametrize("crowd", [4096, 6, 1])
def test_dense_clusters(spark, crowd):
    rng = random.Random(crowd)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5), crowd)
    for e in edges.collect():
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 3
    root = {r.v: r.root for r in components(edges).collect()}
    label = brute_components(fps)
    pairs = {(root.get(x, x), one) for x, one in zip(signed, label, strict=True)}
    assert len(pairs) == len(set(label.tolist())) == len({a for a, _ in pairs})


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7000, 7001), (7001, 7000)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = defaultdict(set)
    for r in got:
        by[r.root].add(r.v)
    assert sorted(map(len, by.values())) == [2, 300, 401] and all(root in members for root, members in by.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest():
    rng = random.Random(3)
    for n in (2, 3, 40, 700):
        base = rng.getrandbits(64)
        fps = np.array(sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n)}), np.uint64)
        edges = simhash.forest(fps)
        assert len(edges) == len(fps) - len(set(brute_components(fps).tolist()))


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(5, None, 1), (3, "", 1), (None, " ", 1), (None, "lone words here now", 1), (8, long, 1), (9, long, 1), (9, long, 1)], "doc_id long, text string, fp int")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == Counter([(5, 3), (3, 3), (None, 3), (None, None), (8, 8), (9, 8), (9, 8)])
    assert simhash.near_duplicates(df.limit(0)).collect() == []


# Sharding.


def test_shards(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = shards.op4_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and any(r.grown_shard == 8 for r in rows)


def test_shards_of_many_buckets(spark):
    rows = [(i % 900, f"text {i % 450} " * 20, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    got = shards.shuffled_shards(df, bucket_bytes=2000).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == 3000 and all(sorted(s) == list(range(len(s))) for s in by.values())
    again = shards.shuffled_shards(df.repartition(7), bucket_bytes=2000).collect()
    assert sorted((r.doc_id, r.text, r.slot, r.shard) for r in again) == sorted((r.doc_id, r.text, r.slot, r.shard) for r in got)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == 0]
    assert order != sorted(order)


def test_hot_rows_are_spread(spark):
    """A row that repeats many times over a bucket's size: no partition holds them all, slots have no gap."""
    rows = [(7, "the same text")] * 4000 + [(i, f"text {i}") for i in range(100, 600)] + [(8, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = shards.shuffled_shards(df, bucket_bytes=2000)
    held = [r["count"] for r in out.where("doc_id = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(held) == 4000 and max(held) < 1000
    by = defaultdict(list)
    for r in out.collect():
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_more_buckets_than_partitions(spark, monkeypatch):
    rows = [(i, f"text {i} " * 10) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.shard, r.slot, r.text) for r in shards.shuffled_shards(df, bucket_bytes=1000).collect())
    monkeypatch.setattr(shards, "MOST_PARTITIONS", 5)
    assert sorted((r.doc_id, r.shard, r.slot, r.text) for r in shards.shuffled_shards(df, bucket_bytes=1000).collect()) == want


def test_shard_edge_rows(spark):
    df = spark.createDataFrame([(None, None), (None, "x"), (1, ""), (1, "")], "doc_id long, text string")
    got = shards.shuffled_shards(df).collect()
    assert len(got) == 4 and sorted(r.size for r in got) == [1, 1, 1, 2] and len({r.shard for r in got if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert shards.shuffled_shards(df.limit(0)).collect() == []


def test_fisher_yates_is_uniform():
    counts = Counter(tuple(shards.fisher_yates(3, seed)) for seed in range(3000))
    assert len(counts) == 6 and min(counts.values()) > 380


# HTML.


def test_lines():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>c</div><header>top</header><article><header><h1>Head&amp;ing</h1></header><p>One<br>two <b>three<p>Four&nbsp; five<ul><li>a<li>b</ul><div class=comments>no</div><script>if (a<b) {}</script></article><aside>x</aside><footer>f</footer>"
    assert [x for x, kind in html.lines_of(page) if kind == html.DECLARED] == ["Head&ing", "One two three", "Four five", "a", "b"]
    assert [x for x, kind in html.lines_of(page) if kind == html.APART] == ["t", "menu", "c", "top", "no", "x", "f"]
    assert html.lines_of("<p>one <button>Share</button> two</p>") == [("Share", html.APART), ("one two", html.PLAIN)]


def alone(page):
    """A page's text without neighbours."""
    found = html.lines_of(page)
    return "\n".join(x for (x, _), c in zip(found, html.content(found), strict=True) if c)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a</p >b<i>c</i>", "a\nbc"), ("<!-- x --><p>y<!-- unclosed", "y"), ("<script>unclosed <p>x", ""), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"),
        ("<div id='sidebar'>s<div>t</div></div><p>u", "u"), ("<p class='lead'>v</p><form>f<p>g</p></form>", "v"), ("<p title='a>b'>w</p>", "w"), ("</div></p><p>x", "x"), ("<table><tr><td>a<td>b</table>", "a\nb"), ("<p hidden>n</p><p>m", "m"),
        ("<main><p>in</p></main><p>out</p>", "in"), ("<P>UP</P><STYLE>s</STYLE>", "UP"), ("<p>caf&#233; &euro;5 &#x41;", "café €5 A"), ("<article></article><p>z", "z"), ("<article class='post has-sidebar comments-open'><p>q</p></article>", "q"), ("<div class='content with-sidebar'>r</div>", "r"), ("<div data-id='comment'>k</div>", "k"), ("<p>a<p 'b'>c <x", "a\nc"),
        ("<div class='cookie-notice'>c</div><div class='sidebar'>d</div><p>e", "e"), ("<main class='comments'>m</main>", "m"), ("<p>x</p><!doctype y><?z?>w", "x\nw"), ("<article hidden>a</article>", "a"), ("a<b", "a"), ("1<2", "1<2"),
    ],
)
def test_pages(page, text):
    assert alone(page) == text


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 11))] for _ in range(2))
        kept = [x for x, s in zip(a, html.shared(a, b), strict=True) if s]
        rest = iter(b)
        assert len(kept) == longest(a, b) and all(x in rest for x in kept)


def test_alignment_in_halves(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(html, "TABLE_BITS", 12)
    for _ in range(600):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        kept = [x for x, s in zip(a, html.shared(a, b), strict=True) if s]
        rest = iter(b)
        assert len(kept) == longest(a, b) and all(x in rest for x in kept)


@pytest.mark.parametrize("page", ["<a '" * 20_000, "<span>" * 20_000 + "</b>" * 20_000, "<span>" * 5000 + "<div></div>" * 20_000, "<script <" * 20_000, "<ul>" + "<div>" * 1500 + "<li>x</li>" * 5000, "<!-- " * 20_000, "<p x=\"" * 20_000, "<" * 50_000, "<p>x" * 50_000, "<script></scriptx>" * 10_000])
def test_odd_pages_take_no_longer(page):
    import time

    began = time.process_time()
    html.lines_of(page)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("parts", [1, 9])
def test_differencing(spark, parts):
    """The same however pages are dealt to tasks."""
    shell = "<div>Our site</div><div>All rights</div>{}<div>Write to us</div>"
    rows = [(i, f"http://h.example/a/{i}", shell.format(f"<p>Story {i} is long enough</p><p>More of it {i * 7} to read</p>")) for i in range(40)] + [(70, "http://other.example/a/1", shell.format("<p>alone</p>")), (80, "http://c.example/x", "<p>same words here</p>"), (90, "http://c.example/x?q", "<p>same words here</p>"), (100, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in html.extracted(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i in range(40):
        assert got[i] == f"Story {i} is long enough\nMore of it {i * 7} to read"
    assert got[70] == "Our site\nAll rights\nalone\nWrite to us" and got[80] == got[90] == "same words here" and got[100] == ""


def test_nearest_of_both_neighbours(spark):
    page = "<p>{}</p><p>own text of page {}, quite long as texts go</p>"
    rows = [(1, "http://h/a/1", page.format("left", 1)), (2, "http://h/b/1", page.format("right", 2)), (3, "http://h/b/2", page.format("right", 3)), (4, "http://h/b/2", None), (5, "http://h/b/3", page.format("left", 5))]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].startswith("own") and got[1].startswith("left") and got[3].startswith("right") and got[4] == "" and got[5].startswith("left")


def test_declared_content_is_differenced(spark):
    """Notices in an article that the next page of the host has too go; copied articles stay."""
    page = "<nav>menu</nav><article><p>Support our site today</p><p>Story {0} is long enough to be read</p></article>"
    rows = [(i, f"http://h/a/{i}", page.format(i)) for i in range(20)] + [(50, "http://c/x/1", page.format(1)), (51, "http://c/x/2", page.format(1)), (60, "http://lone/x", page.format(2))]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is long enough to be read" for i in range(20))
    assert got[50] == got[51] == "Support our site today\nStory 1 is long enough to be read" and got[60].startswith("Support")


def test_short_articles_in_long_templates(spark):
    """However much of a page its template is; copies are passed over for the next nearest page."""
    shell = "".join(f"<div>Link number {i} of the site's menu</div>" for i in range(30)) + "<p>{}</p><div>All rights reserved by us</div>"
    half = "<div>Our site has this and that</div><p>{}</p><div>All rights reserved</div>"
    rows = [(i, f"http://long/a/{i}", shell.format(f"Short story {i}")) for i in range(10)] + [(20 + i, f"http://half/a/{i}", half.format(f"Tale {i}")) for i in range(10)]
    rows += [(40 + i, f"http://copied/a/{i}", half.format("The same story for all of these pages")) for i in range(6)] + [(50, "http://copied/b/1", half.format("Another story that is told here, and no other one"))]
    rows += [(60, "http://two/a/1", shell.format("one")), (61, "http://two/a/2", shell.format("two"))]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Short story {i}" and got[20 + i] == f"Tale {i}" for i in range(10))
    assert {got[40 + i] for i in range(6)} == {"The same story for all of these pages"} and got[50].startswith("Another")
    assert len(got[60].split("\n")) == 32


def test_host_and_path(spark):
    rows = spark.createDataFrame([("HTTPS://A.b:80/x/y?q#f",), ("//h/p",), ("/only/path",), (None,), ("http://h",)], "url string")
    got = [tuple(r) for r in rows.select(html.host_of(rows.url), html.path_of(rows.url)).collect()]
    assert got == [("a.b:80", "/x/y"), ("h", "/p"), ("", "/only/path"), ("", ""), ("h", "")]


def plain_lines(page):
    """(text, whether content) of each block of a well-formed page, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.buffer, self.stack = [], "", []

        def flush(self):
            if self.buffer.split():
                self.out.append((" ".join(self.buffer.split()), "article" in self.stack))
            self.buffer = ""

        def handle_starttag(self, tag, attributes):
            if tag == "br":
                self.buffer += " "
            elif tag != "meta":
                if tag not in ("b", "a", "i"):
                    self.flush()
                self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i"):
                self.flush()
            while self.stack.pop() != tag:
                pass

        def handle_data(self, data):
            if not {"script", "style"} & set(self.stack):
                self.buffer += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.out


def on_longest(a, b):
    """Which of a lie on a longest common subsequence: equal ends, then from the end of the whole table."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    m = next((i for i, (x, y) in enumerate(zip(a[n:][::-1], b[n:][::-1], strict=False)) if x != y), min(len(a), len(b)) - n)
    x, y = a[n : len(a) - m], b[n : len(b) - m]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
    out, j = [False] * len(x), len(y)
    for i in range(len(x), 0, -1):
        if table[i][j] > table[i - 1][j]:
            while table[i][j - 1] > table[i - 1][j - 1]:
                j -= 1
            out[i - 1], j = True, j - 1
    return [True] * n + out + [True] * m


def test_page_table(spark, sf_dir):
    """Against a differ of its own: every page's text is its article less what lies on an alignment with its nearest page."""
    import re

    pages = [(r.page_id, r.url, plain_lines(r.html)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    split = lambda url: re.match(r"\w+://([^/?#]*)([^?#]*)", url).groups()
    pages.sort(key=lambda p: (*split(p[1]), p[0]))
    rows = {r.page_id: r for r in html.op7_html_extraction(spark, sf_dir).collect()}
    changed = 0
    for k, (page_id, url, lines) in enumerate(pages):
        host, path = split(url)
        near = sorted((j for j in range(len(pages)) if j != k and split(pages[j][1])[0] == host and abs(j - k) <= html.REACH), key=lambda j: (-html.common_prefix(path, split(pages[j][1])[1]), abs(j - k), j > k))
        whole, size = [x for x, _ in lines], sum(len(x) for x, c in lines if c)
        drop, alike = [False] * len(lines), []
        for other in (pages[j][2] for j in near):
            theirs = [x for x, _ in other]
            if theirs == whole:
                continue
            on = on_longest(whole, theirs)
            both = sum(len(x) for (x, c), d in zip(lines, on, strict=True) if c and d)
            if both == size:
                continue
            if both >= 0.9 * size and both >= 0.9 * sum(len(x) for x, c in other if c):
                alike.append(on)
                if len(alike) < 3:
                    continue
                on = alike[0]
            drop = on
            break
        assert rows[page_id].text == "\n".join(x for (x, c), d in zip(lines, drop, strict=True) if c and not d)
        assert rows[page_id].n_chars == len(rows[page_id].text)
        changed += any(drop)
    assert changed
    assert html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").limit(0)).collect() == []


# Toxicity.


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 2, 77, None)], "doc_id long")
    got = [r[0] for r in rows.select(toxicity.held_out(rows.doc_id)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 == 1 for i in (0, 1, 2, 77)] + [False]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["zorkish", "vexpuk", "quoxle"]) + rng.choice(["", "er", "en"]))
        texts.append(" ".join(own))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy():
    texts, labels = corpus(1500, 1)
    weights, bias = toxicity.fit(texts[:1000], labels[:1000])
    features = toxicity.Features()
    scores = [1 / (1 + np.exp(-(weights[features.of(t)].sum() + bias))) for t in texts[1000:]]
    assert np.mean([(s >= toxicity.THRESHOLD) == bool(y) for s, y in zip(scores, labels[1000:], strict=True)]) > 0.99


def test_training_ignores_held_out_labels(spark):
    texts, labels = corpus(600, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flipped = [1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y for i, y in enumerate(labels)]
    a = toxicity.trained(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    b = toxicity.trained(docs, spark.createDataFrame(list(enumerate(flipped)), "doc_id long, toxic int"))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_unlike():
    base = " ".join(f"word{i}" for i in range(100))
    assert toxicity.unlike([base, "something else altogether, not the same", base, base.replace("word50", "other")]) [:2] == [0, 1]


def test_scores_of_odd_rows(spark):
    texts, labels = corpus(300, 3)
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (None, None), (9999, ""), (9998, "\U0001f600" * 10)], "doc_id long, text string")
    model = toxicity.trained(docs, spark.createDataFrame([*enumerate(labels), (None, 1), (1, None), (2, 7)], "doc_id long, toxic int"))
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 303 and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    clash = docs.selectExpr("*", "1 AS tox_score", "2 AS Tox_Score_")
    kept = toxicity.accepted(clash, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    assert kept.columns == clash.columns and 0 < kept.count() < 303
    assert toxicity.scored(docs.limit(0), model).collect() == []


def plain_score(text, weights, bias):
    """One character after the other, one n-gram after the other."""
    import math

    chars, found, low = f" {(text or '').lower()} " if text else "", set(), (1 << 32) - 1
    for i in range(len(chars)):
        h = 0
        for n, c in enumerate(chars[i : i + 5], 1):
            h = (h + ord(c) + 1) * 0x9E3779B1 & low
            h ^= h >> 15
            if n >= 4:
                found.add((h * 0x85EBCA6B & low) >> 12)
    z = sum(float(weights[i]) for i in found) + bias
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def test_scores_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights, bias = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.op6_toxicity(spark, sf_dir).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], weights, bias)) < 1e-6
    odd = ["\U0001f600" * 10, "abc", "x", "", None, "word " * 200_000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in toxicity.scored(df, (weights, bias)).collect():
        assert abs(r.score - plain_score(odd[r.doc_id], weights, bias)) < 1e-6


def test_documents_scores(spark, sf_dir):
    rows = toxicity.op6_toxicity(spark, sf_dir).collect()
    assert all(r.predicted == int(r.score >= 0.7) for r in rows) and len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
