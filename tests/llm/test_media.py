import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import media, webp

rng = np.random.default_rng(5)


def image(few):
    h, w = rng.integers(1, 32, 2)
    if few:
        palette = rng.integers(0, 256, (int(rng.choice([1, 2, 3, 4, 9, 16, 30])), 4)).astype(np.uint8)
        return palette[rng.integers(0, len(palette), (h, w))]
    return rng.integers(0, 256, (h, w, 4)).astype(np.uint8)


@pytest.mark.parametrize("seed", range(40))
def test_round_trips(seed):
    random.seed(seed)
    few = seed % 2 == 0
    im = image(few)
    h, w = im.shape[:2]
    block = random.randint(2, 4)
    shape = (webp.ceil_shift(h, block), webp.ceil_shift(w, block))
    transforms = []
    if few and seed % 4 == 0:
        transforms.append((webp.PALETTE,))
    else:
        if random.random() < 0.7:
            transforms.append((webp.PREDICTOR, block, rng.integers(0, 14, shape)))
        if random.random() < 0.7:
            transforms.append((webp.CROSS_COLOUR, block, rng.integers(0, 1 << 32, shape).astype(np.uint32) | np.uint32(0xFF000000)))
        if random.random() < 0.7:
            transforms.append((webp.SUBTRACT_GREEN,))
        random.shuffle(transforms)
    data = webp.encode(im, transforms, random.choice([0, 1, 5, 10]), random.random() < 0.7, random.choice([0, 2, 3]))
    assert (webp.decode(data) == im).all()


def test_every_predictor():
    im = rng.integers(0, 256, (9, 9, 4)).astype(np.uint8)
    for mode in range(14):
        assert (webp.decode(webp.encode(im, [(webp.PREDICTOR, 2, np.full((3, 3), mode))])) == im).all()


def test_references_and_cache_shrink_repeats():
    im = np.tile(rng.integers(0, 256, (1, 8, 4)).astype(np.uint8), (20, 4, 1))
    plain, short = webp.encode(im), webp.encode(im, references=True)
    assert len(short) < len(plain) / 2 and (webp.decode(short) == im).all()
    cached = webp.encode(im, cache_bits=6)
    assert len(cached) < len(plain) and (webp.decode(cached) == im).all()


def test_known_bytes():
    """One opaque white pixel, its codes of one symbol each, as the format's description spells it."""
    w = webp.BitWriter()
    for value, n in ((0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.write(value, n)
    for symbol in (255, 255, 255, 255):
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            w.write(value, n)
    for value, n in ((1, 1), (0, 1), (0, 1), (0, 1)):
        w.write(value, n)
    assert webp.decode(webp.riff(w.bytes())).tolist() == [[[255, 255, 255, 255]]]


def test_bad_files():
    good = webp.encode_column(random.Random(1).randbytes(576), 144)
    for bad in (b"", b"RIFF", good[:20], good[:8] + b"XXXX" + good[12:], good[:40]):
        with pytest.raises(Exception):  # noqa: B017
            webp.decode(bad)


def test_prefix_codes_are_complete():
    for counts in ([1, 1], [5, 1, 1, 1], [2**k for k in range(30)], [0, 3, 0, 9, 1]):
        lengths = webp.huffman_lengths(counts, 7 if len(counts) < 20 else 15)
        assert sum(2.0**-n for n in lengths if n) == 1
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120


@pytest.mark.parametrize("data", [b"", b"x", b"a" * 576, b"b" * 577, bytes(range(256)) * 9, "ÿñ漢😀".encode() * 200, np.random.default_rng(1).bytes(5000)])
def test_payloads(data):
    payload = media.payload_of(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255} and len(payload) - len(data) <= 576
    stored = media.store(payload)
    assert media.load(stored).tobytes() == payload and media.store(payload) == stored


def test_payload_of_several_files(monkeypatch):
    monkeypatch.setattr(webp, "MOST_SIDE", 4)
    payload = media.payload_of(bytes(range(256)) * 30)
    stored = media.store(payload)
    assert stored.count(b"WEBPVP8L") == 4 and media.load(stored).tobytes() == payload


class Slow:
    """A decoder of its own for what columns store, bit by bit; counts what it meets."""

    def __init__(self, data):
        assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L"
        size = int.from_bytes(data[16:20], "little")
        self.bits = "".join(f"{b:08b}"[::-1] for b in data[20 : 20 + size])
        self.at, self.met = 0, Counter()

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at][::-1] or "0", 2)

    def code(self, alphabet):
        lengths = [0] * alphabet
        if self.take(1):
            two, wide = self.take(1), self.take(1)
            symbols = [self.take(8 if wide else 1)] + [self.take(8) for _ in range(two)]
            if not two:
                return {"": symbols[0]}
            lengths[symbols[0]] = lengths[symbols[1]] = 1
        else:
            own = [0] * 19
            order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
            for s in order[: 4 + self.take(4)]:
                own[s] = self.take(3)
            assert not self.take(1)
            small, i = self.table(own), 0
            while i < alphabet:
                s = self.symbol(small)
                if s < 16:
                    lengths[i] = s
                    i += 1
                else:
                    i += {17: 3, 18: 11}[s] + self.take({17: 3, 18: 7}[s])
        return self.table(lengths)

    def table(self, lengths):
        if sum(1 for n in lengths if n) == 1:
            return {"": next(s for s, n in enumerate(lengths) if n)}
        out, code = {}, 0
        for n in range(1, 16):
            code *= 2
            for s, length in enumerate(lengths):
                if length == n:
                    out[f"{code:0{n}b}"] = s
                    code += 1
        return out

    def symbol(self, table):
        n = 0
        while self.bits[self.at : self.at + n] not in table:
            n += 1
        self.at += n
        return table[self.bits[self.at - n : self.at]]

    def number(self, prefix):
        if prefix < 4:
            return prefix + 1
        extra = prefix // 2 - 1
        return (2 + prefix % 2 << extra) + self.take(extra) + 1

    def image(self, width, height, main):
        cache_bits = self.take(4) if self.take(1) else 0
        if main:
            assert not self.take(1)
        codes = [self.code(n) for n in (280 + (2**cache_bits if cache_bits else 0), 256, 256, 256, 40)]
        out, cache = [], {}
        while len(out) < width * height:
            s, at = self.symbol(codes[0]), len(out)
            if s < 256:
                r, b, a = (self.symbol(c) for c in codes[1:4])
                out.append((a, r, s, b))
            elif s < 280:
                self.met["copies"] += main
                length, far = self.number(s - 256), self.number(self.symbol(codes[4]))
                x, y = webp.NEAR[far - 1] if far <= 120 else (far - 120, 0)
                far = max(1, x + y * width)
                for _ in range(length):
                    out.append(out[-far])
            else:
                self.met["cache"] += main
                out.append(cache[s - 280])
            for p in out[at:]:
                if cache_bits:
                    cache[int.from_bytes(bytes(p), "big") * 0x1E35A7BD % 2**32 >> 32 - cache_bits] = p
        return out

    def pixels(self):
        assert self.take(8) == 0x2F
        width, height = self.take(14) + 1, self.take(14) + 1
        self.take(4)
        undo, coded = [], width
        while self.take(1):
            kind = self.take(2)
            self.met[kind] += 1
            if kind == 0:
                bits = self.take(3) + 2
                modes = {p[2] for p in self.image(-(-width // 2**bits), -(-height // 2**bits), False)}
                undo.append((kind, *modes))
            elif kind == 3:
                n = self.take(8) + 1
                colours = [(0, 0, 0, 0)]
                for p in self.image(n, 1, False):
                    colours.append(tuple((x + y) % 256 for x, y in zip(p, colours[-1], strict=True)))
                each = 8 // (8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1)
                coded = -(-width * each // 8)
                undo.append((kind, colours[1:], each))
            else:
                undo.append((kind,))
        out = self.image(coded, height, True)
        for kind, *rest in undo:
            if kind == 2:
                out = [(a, (r + g) % 256, g, (b + g) % 256) for a, r, g, b in out]
            elif kind == 3:
                colours, each = rest
                rows = [sum(p[2] << 8 * x for x, p in enumerate(out[y * coded : (y + 1) * coded])) for y in range(height)]
                out = [colours[row >> each * x & 2**each - 1] for row in rows for x in range(width)]
            elif kind == 0:
                (mode,) = rest
                for i, p in enumerate(out):
                    left = mode == 1 and i % width or i < width
                    from_ = (255, 0, 0, 0) if i == 0 else out[i - 1] if left else out[i - width]
                    out[i] = tuple((x + y) % 256 for x, y in zip(p, from_, strict=True))
        return bytes(x for a, r, g, b in out for x in (r, g, b, a))


def samples():
    rnd = random.Random(7)
    words = [bytes(rnd.choices(b"abcdefghijklmnop \xc3\xa9", k=rnd.randint(2, 9))) for _ in range(300)]
    texts = [b" ".join(rnd.choices(words, k=n)) for n in (0, 1, 90, 400, 2500)] + [b"four" * 999, bytes(5000), rnd.randbytes(3000), b"ab" * 4000, b"lines that repeat \n" * 300]
    texts.append(bytes(x % 256 for i in range(2500) for x in (i // 3, i // 5, i // 7, 200)))  # slopes
    texts.append(bytes(x % 256 for _ in range(2500) for g in [rnd.randrange(256)] for x in (g + 3, g, g + 9 + rnd.randrange(2), 255)))  # grey
    return texts


def test_independent_decoder():
    met = Counter()
    for data in samples():
        payload = media.payload_of(data)
        stored = media.store(payload)
        slow = Slow(stored)
        assert slow.pixels() == payload == media.load(stored).tobytes()
        met += slow.met
    assert met["copies"] and met["cache"] and met[webp.PALETTE] and met[webp.PREDICTOR] and met[webp.SUBTRACT_GREEN]


def test_documents_use_references(sf_dir):
    """Over the table: what is stored is half of the payload, by references and the cache."""
    import duckdb

    texts = [(r[0] or "").encode() for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet'").fetchall()]
    payloads = [media.payload_of(t) for t in texts]
    stored = [media.store(p) for p in payloads]
    met = Counter()
    for data in stored[::5]:
        slow = Slow(data)
        slow.pixels()
        met += slow.met
    assert met["copies"] > 50 and met["cache"] > 20 and sum(map(len, stored)) < 0.55 * sum(map(len, payloads))


def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = media.media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.payload_of(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert media.load(bytes(r.media)).tobytes() == payload


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3), (None, "x", 3)], "doc_id long, text string, feature int")
    rows = media.media_columns(df).collect()
    assert len(rows) == 4 and len({r.media_sha256 for r in rows}) == 2
    assert media.media_columns(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_reading_at_once_is_reading_pixel_by_pixel(seed, monkeypatch):
    own = np.random.default_rng(seed)
    few = own.integers(0, 256, (6, 4)).astype(np.uint8)
    im = np.where(own.random((40, 30, 1)) < 0.8, few[own.integers(0, 6, (40, 30))], own.integers(0, 256, (40, 30, 4))).astype(np.uint8)
    data = webp.encode(im, [], [0, 1, 4, 11][seed % 4], seed % 3 > 0)
    for window in (1, 16, 1 << 11):
        monkeypatch.setattr(webp, "WINDOW", window)
        assert (webp.decode(data) == im).all()
    monkeypatch.setattr(webp, "_at_once", lambda *_: None)
    assert (webp.decode(data) == im).all()


def test_a_cache_that_was_never_filled():
    w = webp.BitWriter()
    for value, n in ((0x2F, 8), (15, 14), (15, 14), (1, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)):
        w.write(value, n)
    codes = webp.write_code(w, [int(s in (0, 281)) for s in range(282)])
    for _ in range(4):
        webp.write_code(w, [0] * 256)
    for _ in range(256):
        w.write(int(codes[281]), 1)
    assert not webp.decode(webp.riff(w.bytes())).any()


def test_prefixes_of_many():
    values = np.arange(1, 5000)
    assert list(zip(*(x.tolist() for x in webp._prefixes(values)), strict=True)) == [webp._prefix(v) for v in values.tolist()]


def test_files_are_the_same_alone_and_together():
    texts = samples() + [bytes([k]) * 700 * k for k in range(20)]
    payloads = [media.payload_of(x) for x in texts]
    alone = [media.store(p) for p in payloads]
    assert media.store_many(payloads) == alone and webp.encode_columns(payloads[::-1], 144) == alone[::-1]
    for files in (alone, alone[::-1]):
        assert [x.tobytes() for x in webp.decode_many(files)] == [media.load(x).tobytes() for x in files]


def test_many_images_share_array_operations():
    """CPU time of many small images together is well below their sum."""
    rnd = random.Random(4)
    payloads = [media.payload_of(rnd.randbytes(300) + b"some words " * rnd.randrange(60)) for _ in range(150)]
    together, alone = [], []
    for _ in range(3):
        began = time.process_time()
        stored = media.store_many(payloads)
        media.load_many(stored)
        between = time.process_time()
        assert [media.store(p) for p in payloads] == stored
        [media.load(x) for x in stored]
        together.append(between - began)
        alone.append(time.process_time() - between)
    assert min(together) < 0.6 * min(alone)


def test_a_bad_file_among_good_ones():
    good = webp.encode_column(random.Random(1).randbytes(5760), 144)
    for bad in (good[:40], good[: len(good) // 2]):
        with pytest.raises(ValueError):
            webp.decode_many([good, bad, good])


@pytest.mark.parametrize("gap", [(1 << 20) - 120 - 300, (1 << 20) - 119 - 300])
def test_repeats_beyond_the_farthest_distance(gap):
    """The last of the 40 distance symbols ends at 2 ** 20, and 120 codes are those of near pixels."""
    mark = random.Random(3).randbytes(1200)
    payload = media.payload_of(mark + bytes(4 * gap) + mark)
    assert media.load(media.store(payload)).tobytes() == payload
