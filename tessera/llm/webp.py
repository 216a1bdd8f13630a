"""Lossless WebP (VP8L) files to pixel arrays, and back.

The decoder reads prefix codes (simple and normal, in one or several groups), literals, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.

The encoder writes any mix of these on request; ``encode_columns`` is the form for columns: for many images at
once it finds back-references and hits of the colour cache by sorting, weighs transforms by entropy and packs all codes
with array operations."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import cached_property, lru_cache

import numpy as np

#: Fixed values of the format.
SIGNATURE = 0x2F
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Distances 1 to 120 as (columns to the left, rows up).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MOST_SIDE = 1 << 14


def ceil_shift(x: int, bits: int) -> int:
    return (x + (1 << bits) - 1) >> bits


def _reversals(most: int) -> list[np.ndarray]:
    """For each n, every n-bit number with its bits reversed."""
    out = [np.zeros(1, np.int64)]
    for _ in range(most):
        out.append(np.concatenate([out[-1] * 2, out[-1] * 2 + 1]))
    return out


LONGEST_CODE = 15
_REVERSED = _reversals(LONGEST_CODE)


def _in_order(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that have codes, by length, then symbol, and their lengths."""
    all_lengths = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(all_lengths)
    used = used[np.argsort(all_lengths[used], kind="stable")]
    return used, all_lengths[used].astype(np.int64)


def canonical(lengths: Sequence[int]) -> np.ndarray:
    """Each symbol's code with its first bit lowest, as the stream has it; codes go by length, then symbol."""
    used, own = _in_order(bytes(lengths))
    span = 1 << (LONGEST_CODE - own)
    codes = np.zeros(len(lengths), np.int64)
    codes[used] = _REVERSED[LONGEST_CODE][np.cumsum(span) - span & (1 << LONGEST_CODE) - 1]
    return codes


class Bits:
    """Reads a stream, lowest bits first. Bits beyond its end are zeros; reading far beyond is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) + 9
        self.words = np.ndarray(len(data) + 17, "<u8", data + bytes(24), strides=(1,)).copy()  # 64 bits from every byte on
        self.windows = memoryview(self.words)[: self.end]

    def peek(self) -> int:
        """The next 57 bits or more."""
        if self.at >> 3 >= self.end:
            raise ValueError("the stream has ended")
        return self.windows[self.at >> 3] >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


#: What a symbol that begins no literal adds to a place: more than any place.
BEYOND = 1 << 40


class Code:
    """A prefix code as a table: the next bits to symbol << 4 | length."""

    def __init__(self, entries: np.ndarray):
        self.mask, self.entries = len(entries) - 1, entries

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    @cached_property
    def sizes(self) -> np.ndarray:
        return self.entries & 15

    @cached_property
    def literals(self) -> np.ndarray:
        """The lengths of symbols below 256."""
        return np.where(self.entries < 256 << 4, self.sizes, BEYOND)


def codes_of(lengths: Sequence[bytes]) -> list[Code]:
    """The codes of such lengths, made together."""
    if not lengths:
        return []
    sizes = np.array([len(x) for x in lengths])
    of, flat = np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(lengths), np.uint8)
    used = np.flatnonzero(flat)
    used = used[np.argsort(of[used] << 4 | flat[used], kind="stable")]
    row, own = of[used], flat[used].astype(np.int64)
    counts = np.bincount(row, minlength=len(sizes))
    ends = np.cumsum(counts)
    most = np.where(counts > 1, np.append(own, 0)[ends - 1], 0)
    span = 1 << np.maximum(most[row] - own, 0)
    if (np.bincount(row, span, len(sizes)) != 1 << most)[counts > 1].any():
        raise ValueError("a prefix code is not complete")
    entry = (used - (np.cumsum(sizes) - sizes)[row] << 4) + np.where(counts[row] > 1, own, 0)
    entries, out, at = np.repeat(entry, span), [], 0
    for n, bits in zip(counts.tolist(), most.tolist(), strict=True):
        out.append(Code(entries[at : at + (1 << bits)][_REVERSED[bits]] if n else np.zeros(1, np.int64)))
        at += 1 << bits if n else 0
    return out


_REVERSED_LISTS = [x.tolist() for x in _REVERSED[:8]]


@lru_cache(256)
def _length_table(lengths: bytes) -> list[int]:
    """The table of a code for code lengths."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) <= 1:
        return [used[0][1] << 4 if used else 0]
    most = used[-1][0]
    table, at = [0] * (1 << most), 0
    if sum(1 << most - n for n, _ in used) != 1 << most:
        raise ValueError("a prefix code is not complete")
    for n, s in used:
        table[_REVERSED_LISTS[n][at >> most - n] :: 1 << n] = [s << 4 | n] * (1 << most - n)
        at += 1 << most - n
    return table


def read_codes(bits: Bits, alphabets: Sequence[int]) -> list[bytes]:
    """The code lengths of a group. Where the bits ahead are those of the code read last, for the same alphabet, it is that
    code."""
    out: list[bytes] = []
    whole, began, last, size = int.from_bytes(bits.data, "little"), 0, None, 0
    for alphabet in alphabets:
        if size and alphabet == last and (whole >> bits.at ^ whole >> began) & ((1 << size) - 1) == 0:
            out.append(out[-1])
            bits.at += size
            continue
        began, last = bits.at, alphabet
        out.append(read_code(bits, alphabet))
        size = bits.at - began
    return out


def read_code(bits: Bits, alphabet: int) -> bytes:
    """The lengths of a code."""
    lengths = bytearray(alphabet)
    if bits.read(1):
        symbols, wide = bits.read(1) + 1, bits.read(1)
        found = [bits.read(8 if wide or k else 1) for k in range(symbols)]
        if max(found) >= alphabet:
            raise ValueError("a symbol outside its alphabet")
        for s in found:
            lengths[s] = 1
        return bytes(lengths)
    own = bytearray(19)
    given = 4 + bits.read(4)
    v = bits.peek()  # 57 bits, all that they can be
    for i in range(given):
        own[CODE_LENGTH_ORDER[i]] = v >> 3 * i & 7
    bits.at += 3 * given
    table = _length_table(bytes(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    mask, at, last, v, have = len(table) - 1, 0, 8, 0, 0
    for _ in range(left):
        if at >= alphabet:
            break
        if have < 14:  # the most that a symbol and its extra bits take
            v, have = bits.peek(), 57
        entry = table[v & mask]
        n = entry & 15
        s = entry >> 4
        if s < 16:
            lengths[at] = s
            if s:
                last = s
            at += 1
            v >>= n
            have -= n
            bits.at += n
            continue
        value, least, extra = (last, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
        times = least + (v >> n & ((1 << extra) - 1))
        n += extra
        v >>= n
        have -= n
        bits.at += n
        if at + times > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        if value:
            lengths[at : at + times] = bytes([value]) * times
        at += times
    return bytes(lengths)


def _extra(ahead: int, prefix: int) -> tuple[int, int]:
    """A length or distance from its prefix symbol and the bits ahead, and how many of these are its own."""
    if prefix < 4:
        return prefix + 1, 0
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + (ahead & ((1 << n) - 1)) + 1, n


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height, width) of ARGB."""
    return read_images([(bits, width, height)], main)[0]


def read_images(images: Sequence[tuple[Bits, int, int]], main: bool) -> list[np.ndarray]:
    """``read_pixels`` of many streams: their codes are made together, and so are their pixels."""
    heads, lengths = [], {}
    for bits, width, height in images:
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits > 11:
            raise ValueError("too large a colour cache")
        groups, meta, meta_bits = 1, None, 0
        if main and bits.read(1):
            meta_bits = bits.read(3) + 2
            meta = (read_pixels(bits, ceil_shift(width, meta_bits), ceil_shift(height, meta_bits), False) >> 8) & 0xFFFF
            groups = int(meta.max()) + 1
        cache_size = 1 << cache_bits if cache_bits else 0
        own = [read_codes(bits, (280 + cache_size, 256, 256, 256, 40)) for _ in range(groups)]
        lengths |= dict.fromkeys(x for group in own for x in group)
        heads.append((cache_bits, meta, meta_bits, own))
    codes = dict(zip(lengths, codes_of(list(lengths)), strict=True))
    out: list[np.ndarray | None] = [None] * len(images)
    some: list[tuple] = []
    for k, ((bits, width, height), (cache_bits, meta, _, own)) in enumerate(zip(images, heads, strict=True)):
        began = bits.at
        if meta is None and (tokens := _at_once(bits, width * height, [codes[x] for x in own[0]])):
            some.append((k, began, width, width * height, cache_bits, *tokens))
    for (k, began, *_), pixels in zip(some, _resolved([x[2:] for x in some]), strict=True):
        out[k], bits = pixels, images[k][0]
        bits.at = bits.at if pixels is not None else began
    for k, ((bits, width, height), (cache_bits, meta, meta_bits, own)) in enumerate(zip(images, heads, strict=True)):
        if out[k] is None:
            out[k] = _body(bits, width, width * height, cache_bits, [[codes[x] for x in group] for group in own], meta, meta_bits)
        out[k] = out[k].reshape(height, width)
    return out


#: Images of fewer pixels are read pixel by pixel.
AT_ONCE = 128
#: Bytes of the stream that are looked at together.
WINDOW = 1 << 10
_WITHIN = np.arange(8, dtype=np.uint64)
_NEAR = np.array(NEAR)


def _at_once(bits: Bits, total: int, codes: list[Code]) -> tuple[np.ndarray, list[tuple[int, int, int]]] | None:
    """The literals of an image of one group, in order, and what else its stream has: (pixel, pixels copied, distance code),
    or (pixel, 1, -1 - slot) of the cache. At every bit of a window it is looked up where a literal that began there would
    end, and where four in a row would; following these ends finds the literals' places, and array operations read them.
    None for a small image."""
    if total < AT_ONCE:
        return None
    green, red, blue, alpha, far = codes
    green_table, far_table = memoryview(green.entries), memoryview(far.entries)
    at, i, parts, others = bits.at, 0, [], []
    while i < total:
        base = at >> 3
        if base >= bits.end:
            raise ValueError("the stream has ended")
        size = min(WINDOW, bits.end - base)
        ahead = (bits.words[base : base + size + 8, None] >> _WITHIN).view(np.int64).ravel()
        place, last = np.arange(len(ahead)), len(ahead) - 1
        hops = {c: c.sizes.take(ahead & c.mask, mode="clip") for c in {red, blue, alpha}}
        for hop in hops.values():
            hop += place
        place += green.literals.take(ahead & green.mask, mode="clip")
        # No literal has more than 60 bits, so from within the window none ends at the last of the 64 bits behind it.
        ends = hops[alpha].take(hops[blue].take(hops[red].take(place, mode="clip"), mode="clip"), mode="clip")
        twice = ends.take(ends, mode="clip")
        follow, by_four, window, limit, p = memoryview(ends), memoryview(twice.take(twice, mode="clip")), memoryview(ahead), size * 8, at - base * 8
        fours: list[int] = []
        ones: list[int] = []
        while i < total and p < limit:
            q = by_four[p]
            if q < last and i + 4 <= total:
                fours.append(p)
                i += 4
                p = q
                continue
            q = follow[p]
            if q < last:
                ones.append(p)
                i += 1
                p = q
                continue
            # 57 bits or more are ahead; a back-reference has 58 at most, and 43 behind its first code.
            entry = green_table[window[p] & green.mask]
            p += entry & 15
            symbol = entry >> 4
            if symbol >= 280:
                others.append((i, 1, 279 - symbol))
                i += 1
                continue
            v = window[p]
            length, n = _extra(v, symbol - 256)
            entry = far_table[v >> n & far.mask]
            n += entry & 15
            code, more = _extra(v >> n, entry >> 4)
            p += n + more
            others.append((i, length, code))
            i += length
        at = base * 8 + p
        own = np.array(fours, np.int64)
        own = np.concatenate([own, ends[own], twice[own], ends[twice[own]], np.array(ones, np.int64)])
        own.sort()
        symbol = green.entries.take(ahead.take(own) & green.mask)
        first = place.take(own)
        second = hops[red].take(first)
        third = hops[blue].take(second)
        parts.append(
            (alpha.entries.take(ahead.take(third) & alpha.mask) >> 4) << 24
            | (red.entries.take(ahead.take(first) & red.mask) >> 4) << 16
            | (symbol >> 4) << 8
            | blue.entries.take(ahead.take(second) & blue.mask) >> 4
        )
    if i > total:
        raise ValueError("a back-reference outside the image")
    bits.at = at
    return np.concatenate(parts), others


def _resolved(images: Sequence[tuple]) -> list[np.ndarray | None]:
    """The pixels of images given as (width, pixels, bits of the cache, literals, others). A copied pixel points to its
    source, one of the cache to the last pixel in its slot. None where the cache is asked for what it was never given: only
    pixel by pixel are the slots known then."""
    if not images:
        return []
    widths, totals, cache_bits = (np.array(x) for x in list(zip(*images, strict=True))[:3])
    ends = np.cumsum(totals)
    begins = ends - totals
    of = np.repeat(np.arange(len(images)), [len(x[4]) for x in images])
    start, length, code = np.array([x for image in images for x in image[4]], np.int64).reshape(-1, 3).T
    total = int(ends[-1])
    at = begins[of] + start
    edges = np.zeros(total + 1, np.int64)
    edges[at] += 1
    edges[at + length] -= 1
    values = np.zeros(total, np.int64)
    values[np.cumsum(edges[:-1]) == 0] = np.concatenate([x[3] for x in images])
    source = np.arange(total)
    copies = np.flatnonzero(code > 0)
    if len(copies):
        x, y = _NEAR[np.minimum(code[copies], len(NEAR)) - 1].T
        distance = np.where(code[copies] > len(NEAR), code[copies] - len(NEAR), np.maximum(1, x + y * widths[of[copies]]))
        if (distance > start[copies]).any():
            raise ValueError("a back-reference outside the image")
        times = length[copies]
        source[np.repeat(at[copies] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))] -= np.repeat(distance, times)
    hits, unknown = np.flatnonzero(code < 0), set()
    if len(hits):
        source = _roots(source)
        image, shift = np.repeat(np.arange(len(images)), totals), np.repeat(32 - np.maximum(cache_bits, 1), totals).astype(np.uint32)
        slot = ((values.astype(np.uint32) * np.uint32(CACHE_FACTOR)) >> shift).astype(np.uint16)
        slot[at[hits]] = -1 - code[hits]
        slot = slot[source]
        order = np.argsort(slot, kind="stable")
        later, earlier = order[1:], order[:-1]
        again = (slot[later] == slot[earlier]) & (image[later] == image[earlier])
        before = np.full(total, -1)
        before[later[again]] = earlier[again]
        before = before[at[hits]]
        unknown = set(of[hits[before < 0]].tolist())
        source[at[hits[before >= 0]]] = before[before >= 0]
    values = values[_roots(source)].astype(np.uint32)
    return [None if k in unknown else values[a:b] for k, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True))]


def _roots(source: np.ndarray) -> np.ndarray:
    """Where each place ends up when it is followed to a place that is its own source."""
    moved = np.flatnonzero(source != np.arange(len(source)))
    at = source[moved]
    while True:
        further = source[at]
        if (further == at).all():
            return source
        source[moved] = at = further


def _body(bits: Bits, width: int, total: int, cache_bits: int, codes: list, meta: np.ndarray | None, meta_bits: int) -> np.ndarray:
    if meta is not None:
        meta = meta.tolist()
    out: list[int] = []
    put = out.append
    cache, cached, shift = [0] * (1 << cache_bits), 0, 32 - cache_bits
    windows, at, end = bits.windows, bits.at, bits.end
    (green, red, blue, alpha, far), i = codes[0], 0
    green_table, green_mask, red_table, red_mask = green.table, green.mask, red.table, red.mask
    blue_table, blue_mask, alpha_table, alpha_mask = blue.table, blue.mask, alpha.table, alpha.mask
    while i < total:
        if meta is not None:
            green, red, blue, alpha, far = codes[meta[i // width >> meta_bits][i % width >> meta_bits]]
            green_table, green_mask, red_table, red_mask = green.table, green.mask, red.table, red.mask
            blue_table, blue_mask, alpha_table, alpha_mask = blue.table, blue.mask, alpha.table, alpha.mask
        if at >> 3 >= end:
            raise ValueError("the stream has ended")
        # 57 bits or more; three codes have 45 at most.
        v = windows[at >> 3] >> (at & 7)
        entry = green_table[v & green_mask]
        n = entry & 15
        s = entry >> 4
        if s < 256:
            entry = red_table[v >> n & red_mask]
            n += entry & 15
            r = entry >> 4
            entry = blue_table[v >> n & blue_mask]
            n += entry & 15
            b = entry >> 4
            if n > 42:
                at += n
                n = 0
                v = windows[at >> 3] >> (at & 7) if at >> 3 < end else 0
            entry = alpha_table[v >> n & alpha_mask]
            at += n + (entry & 15)
            put((entry >> 4) << 24 | r << 16 | s << 8 | b)
            i += 1
        elif s < 280:
            bits.at = at + n
            length, more = _extra(bits.peek(), s - 256)
            bits.at += more
            entry = far.table[bits.peek() & far.mask]
            bits.at += entry & 15
            code, more = _extra(bits.peek(), entry >> 4)
            at = bits.at + more
            if code > len(NEAR):
                distance = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > i or i + length > total:
                raise ValueError("a back-reference outside the image")
            if distance >= length:
                out += out[i - distance : i - distance + length]
            else:
                out += (out[i - distance : i] * (length // distance + 1))[:length]
            i += length
        else:
            at += n
            while cached < i:
                pixel = out[cached]
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
                cached += 1
            put(cache[s - 280])
            i += 1
    bits.at = at
    return np.array(out, np.uint32)


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """Of four channels."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        # Whichever of left and top is nearer to left + top - top_left, over all channels.
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [_clamp(m + int((m - c) / 2)) for m, c in zip(_average(left, top), top_left, strict=True)]
    return [255, 0, 0, 0]


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _argb(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., k].astype(np.uint32) & 0xFF for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def _predict(residual: np.ndarray | None, pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverse: pixels from residuals; with residual None forward: residuals from pixels."""
    height, width = (pixels if residual is None else residual).shape[:2]
    kinds = np.unique(modes)
    if residual is None and len(kinds) == 1 and kinds[0] in (1, 2):
        # One mode everywhere, left or top: the first row goes by its left neighbours, the first column by its top ones.
        axis = 1 if kinds[0] == 1 else 0
        out = pixels.copy()
        out[:, 1:] -= pixels[:, :-1] if axis else 0
        out[1:] -= 0 if axis else pixels[:-1]
        out[1:, 0] -= pixels[:-1, 0] if axis else 0
        out[0, 1:] -= 0 if axis else pixels[0, :-1]
        out[0, 0] -= np.array([255, 0, 0, 0])
        return out & 0xFF
    done = (pixels if residual is None else residual).tolist()
    out = done if residual is not None else [[[0] * 4 for _ in range(width)] for _ in range(height)]
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = done[0][x - 1]
            elif x == 0:
                guess = done[y - 1][0]
            else:
                # Right of the last column comes the next row's first pixel.
                corner = done[y - 1][x + 1] if x + 1 < width else done[y][0]
                guess = predicted(int(modes[y >> bits, x >> bits]), done[y][x - 1], done[y - 1][x], corner, done[y - 1][x - 1])
            if residual is None:
                out[y][x] = [(p - q) & 0xFF for p, q in zip(done[y][x], guess, strict=True)]
            else:
                done[y][x] = [(p + q) & 0xFF for p, q in zip(done[y][x], guess, strict=True)]
    return np.array(out, np.int64).reshape(height, width, 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 0xFF) ^ 0x80) - 0x80


def _cross(channels: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Elements: (red to blue, green to blue, green to red) in red, green and blue of each block. sign 1 inverts."""
    height, width = channels.shape[:2]
    of = elements[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    red_to_blue, green_to_blue, green_to_red = (_signed(of[..., k]) for k in (1, 2, 3))
    out = channels.copy()
    green, first_red = _signed(channels[..., 2]), channels[..., 1]
    out[..., 1] = (first_red + sign * (green_to_red * green >> 5)) & 0xFF
    original_red = out[..., 1] if sign == 1 else first_red
    out[..., 3] = (channels[..., 3] + sign * ((green_to_blue * green >> 5) + (red_to_blue * _signed(original_red) >> 5))) & 0xFF
    return out


def palette_bits(size: int) -> int:
    """Pixels share a byte in groups of two to this."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with a VP8L chunk: (height, width, 4) of RGBA bytes."""
    return decode_many([data])[0]


def decode_many(files: Sequence[bytes]) -> list[np.ndarray]:
    """``decode`` of each; the main images are read together."""
    heads = [_head(_stream(x)) for x in files]
    images = read_images([(bits, coded, height) for bits, coded, height, _ in heads], True)
    return [_undone(argb, transforms) for argb, (*_, transforms) in zip(images, heads, strict=True)]


def _stream(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def _head(data: bytes) -> tuple[Bits, int, int, list[tuple]]:
    """A stream up to its main image: where it is read, that image's width and height, and the transforms."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless image")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    transforms: list[tuple] = []
    coded = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, block, read_pixels(bits, ceil_shift(coded, block), ceil_shift(height, block), False)))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            deltas = _channels(read_pixels(bits, size, 1, False))[0]
            packing = palette_bits(size)
            transforms.append((kind, packing, np.cumsum(deltas, axis=0) & 0xFF, coded))
            coded = ceil_shift(coded, packing)
        else:
            transforms.append((kind,))
    return bits, coded, height, transforms


def _undone(argb: np.ndarray, transforms: list[tuple]) -> np.ndarray:
    """The image's RGBA bytes, its transforms inverted."""
    for kind, *rest in reversed(transforms):
        if kind == PREDICTOR:
            modes = (rest[1] >> 8) & 0xF
            mode = int(modes[0, 0])
            if mode in (1, 2) and (modes == mode).all():
                argb = _summed(argb, mode)
            else:
                argb = _argb(_predict(_channels(argb), None, modes, rest[0]))
        elif kind == CROSS_COLOUR:
            argb = _argb(_cross(_channels(argb), _channels(rest[1]), rest[0], 1))
        elif kind == SUBTRACT_GREEN:
            argb = argb.copy()
            own = argb.view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha
            own[..., 0] += own[..., 1]
            own[..., 2] += own[..., 1]
        else:
            packing, colours, full = rest
            x = np.arange(full)
            each = 8 >> packing
            index = (argb[:, x >> packing] >> (8 + (x & ((1 << packing) - 1)) * each).astype(np.uint32)) & np.uint32((1 << each) - 1)
            argb = np.append(_argb(colours), np.zeros(256, np.uint32))[index]
    rgba = (argb & np.uint32(0xFF00FF00)) | (argb & np.uint32(0xFF)) << np.uint32(16) | argb >> np.uint32(16) & np.uint32(0xFF)
    return np.ascontiguousarray(rgba, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _summed(argb: np.ndarray, mode: int) -> np.ndarray:
    """Inverse of one prediction everywhere, left (1) or top (2): the first row goes by its left neighbours, the first column
    by its top ones."""
    out = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4).copy()
    out[:1, :1, 3] += np.uint8(255)
    if mode == 1:
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    else:
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    return np.cumsum(out, axis=2 - mode, dtype=np.uint8).view("<u4")[..., 0]


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def huffman_lengths(counts: Sequence[int] | np.ndarray, most: int = 15) -> list[int]:
    """Code lengths of a complete prefix code; small counts are raised until none is longer than ``most``."""
    ranked = sorted([c << 16 | s for s, c in enumerate(counts) if c])
    lengths = [0] * len(counts)
    for x, n in zip(ranked, _depths([x >> 16 for x in ranked], most), strict=True):
        lengths[x & 0xFFFF] = n
    return lengths


def _depths(counts: list[int], most: int) -> list[int]:
    """The code lengths of ascending counts above zero."""
    n, floor = len(counts), 1
    if n < 2:
        return [1] * n
    while True:
        # Leaves and the inner nodes as they are made both ascend, so the two least are at their fronts.
        leaves = [max(x, floor) for x in counts] if floor > 1 else counts[:]
        none = sum(leaves) + 1
        leaves.append(none)
        inner = [none] * n
        over_leaf, over_inner = [0] * n, [0] * n
        a = b = 0
        for node in range(n - 1):
            if leaves[a] <= inner[b]:
                total = leaves[a]
                over_leaf[a] = node
                a += 1
            else:
                total = inner[b]
                over_inner[b] = node
                b += 1
            if leaves[a] <= inner[b]:
                total += leaves[a]
                over_leaf[a] = node
                a += 1
            else:
                total += inner[b]
                over_inner[b] = node
                b += 1
            inner[node] = total
        depth = [1] * n
        for node in range(n - 3, -1, -1):
            depth[node] = depth[over_inner[node]] + 1
        if depth[over_leaf[0]] <= most:
            return [depth[node] for node in over_leaf]
        floor *= 2


def write_code(out: BitWriter, lengths: Sequence[int]) -> np.ndarray:
    """Writes the code; returns each symbol's bits (a lone symbol has none)."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256 and all(lengths[s] == 1 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        wide = int(used[0] > 1)
        out.write(wide, 1)
        out.write(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.write(used[1], 8)
    else:
        tokens: list[tuple[int, int, int]] = []  # symbol, extra, extra bits
        last = -1
        for s in [*used, len(lengths)]:
            gap = s - last - 1
            while gap >= 11:
                run = min(gap, 138)
                tokens.append((18, run - 11, 7))
                gap -= run
            if gap >= 3:
                tokens.append((17, gap - 3, 3))
            else:
                tokens += [(0, 0, 0)] * gap
            if s < len(lengths):
                tokens.append((lengths[s], 0, 0))
            last = s
        counts = [0] * 19
        for s, _, _ in tokens:
            counts[s] += 1
        own = huffman_lengths(counts, 7)
        if sum(1 for n in own if n) == 1:  # a second one makes the code complete
            own[next(s for s in range(19) if not own[s])] = 1
        n = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
        value, at = (n - 4) << 1, 5
        for s in CODE_LENGTH_ORDER[:n]:
            value |= own[s] << at
            at += 3
        at += 1  # all lengths are given
        codes = canonical(own).tolist()
        for s, extra, size in tokens:
            value |= (codes[s] | extra << own[s]) << at
            at += own[s] + size
        out.write(value, at)
    return canonical(lengths) if len(used) > 1 else np.zeros(len(lengths), np.int64)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of many values."""
    v = values - 1
    n = np.maximum(np.frexp(v)[1].astype(np.int64) - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & (1 << n) - 1), np.where(v < 4, 0, n)


def write_pixels(out: BitWriter, argb: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> None:
    height, width = argb.shape
    pixels = argb.ravel().tolist()
    cache: dict[int, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    tokens: list[tuple] = []  # (pixel, symbols...)
    i = 0

    def remember(pixel: int) -> None:
        if cache_bits:
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while i < len(pixels):
        p, length, distance = pixels[i], 0, 0
        start = seen.get(tuple(pixels[i : i + 3])) if references else None
        if start is not None:
            distance = i - start
            while length < 4096 and i + length < len(pixels) and pixels[i + length] == pixels[i + length - distance]:
                length += 1
        slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if length >= 3:
            tokens.append((i, "copy", length, near.get(distance, distance + len(NEAR))))
        elif cache.get(slot) == p:
            tokens.append((i, "cache", slot))
            length = 1
        else:
            tokens.append((i, "literal", p))
            length = 1
        for k in range(i, i + length):
            seen[tuple(pixels[k : k + 3])] = k
            remember(pixels[k])
        i += length
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    group_of = lambda at: 0
    groups = 1
    if main:
        out.write(1 if group_bits else 0, 1)
        if group_bits:
            # Two groups, as a chessboard.
            h, w = ceil_shift(height, group_bits), ceil_shift(width, group_bits)
            board = (np.arange(h)[:, None] + np.arange(w)[None, :]) % 2
            out.write(group_bits - 2, 3)
            write_pixels(out, (board.astype(np.uint32) << 8) | np.uint32(0xFF000000), False)
            groups = int(board.max()) + 1
            group_of = lambda at: int(board[at // width >> group_bits, at % width >> group_bits])
    cache_size = 1 << cache_bits if cache_bits else 0
    counts = [[[0] * n for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    for at, kind, *rest in tokens:
        own = counts[group_of(at)]
        if kind == "literal":
            for k, s in enumerate((8, 16, 0, 24)):
                own[k][rest[0] >> s & 0xFF] += 1
        elif kind == "cache":
            own[0][280 + rest[0]] += 1
        else:
            own[0][256 + _prefix(rest[0])[0]] += 1
            own[4][_prefix(rest[1])[0]] += 1
    codes = []
    for own in counts:
        lengths = [huffman_lengths(c) if sum(1 for x in c if x) != 1 or max(i for i, x in enumerate(c) if x) < 256 else _two(c) for c in own]
        sizes = [n if len(n) - n.count(0) > 1 else [0] * len(n) for n in lengths]
        codes.append([list(zip(write_code(out, n).tolist(), size, strict=True)) for n, size in zip(lengths, sizes, strict=True)])
    for at, kind, *rest in tokens:
        own = codes[group_of(at)]
        if kind == "literal":
            for k, s in enumerate((8, 16, 0, 24)):
                out.write(*own[k][rest[0] >> s & 0xFF])
        elif kind == "cache":
            out.write(*own[0][280 + rest[0]])
        else:
            for k, base, value in ((0, 256, rest[0]), (4, 0, rest[1])):
                prefix, extra, n = _prefix(value)
                out.write(*own[k][base + prefix])
                out.write(extra, n)


def _two(counts: Sequence[int]) -> list[int]:
    """For a lone symbol beyond 255, which no simple code can name: a normal code of it and symbol 0."""
    return [1 if c or i == 0 else 0 for i, c in enumerate(counts)]


def riff(stream: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode(rgba: np.ndarray, transforms: Sequence[tuple] = (), cache_bits: int = 0, references: bool = False, group_bits: int = 0) -> bytes:
    """A WebP file. ``transforms``, in order: (PREDICTOR, bits, modes by block), (CROSS_COLOUR, bits, ARGB elements by
    block), (SUBTRACT_GREEN,), (PALETTE,)."""
    height, width = rgba.shape[:2]
    out = BitWriter()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    channels = rgba[..., [3, 0, 1, 2]].astype(np.int64)
    for kind, *rest in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        if kind == PREDICTOR:
            bits, modes = rest
            out.write(bits - 2, 3)
            write_pixels(out, (np.asarray(modes, np.uint32) << 8) | np.uint32(0xFF000000), False)
            channels = _predict(None, channels, np.asarray(modes), bits)
        elif kind == CROSS_COLOUR:
            bits, elements = rest
            out.write(bits - 2, 3)
            write_pixels(out, elements, False)
            channels = _cross(channels, _channels(elements), bits, -1)
        elif kind == SUBTRACT_GREEN:
            channels[..., 1] = (channels[..., 1] - channels[..., 2]) & 0xFF
            channels[..., 3] = (channels[..., 3] - channels[..., 2]) & 0xFF
        else:
            colours, index = np.unique(_argb(channels), return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            index = index.reshape(channels.shape[:2])
            table = _channels(colours)
            out.write(len(colours) - 1, 8)
            write_pixels(out, _argb(np.diff(table, axis=0, prepend=0) & 0xFF)[None, :], False)
            packing = palette_bits(len(colours))
            wide = ceil_shift(index.shape[1], packing) << packing
            index = np.pad(index, ((0, 0), (0, wide - index.shape[1])))
            packed = sum(index[:, k :: 1 << packing] << (k * (8 >> packing)) for k in range(1 << packing))
            channels = np.zeros((*packed.shape, 4), np.int64)
            channels[..., 0], channels[..., 2] = 255, packed
    out.write(0, 1)
    write_pixels(out, _argb(channels), True, cache_bits, references, group_bits)
    return riff(out.bytes())


#: Longest prefix code that ``encode_columns`` uses, bits of its colour cache and symbols of its first code.
LONGEST = 10
CACHE_BITS = 8
GREEN = 280 + (1 << CACHE_BITS)
LONGEST_COPY = 4096
#: The last of the 40 distance symbols ends here.
FARTHEST_COPY = (1 << 20) - len(NEAR)
#: Pixels by which a transform is chosen.
LOOK = 1024
_CHANNEL = np.arange(4) * 256
_CODE_LENGTH_ORDER = np.array(CODE_LENGTH_ORDER)


def _entropies(pixels: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """For each image (so many rows each), bits of the four channels, each with a code of its own, in units of 2 ** -20.
    Whole numbers, so that an image's sum doesn't depend on the images beside it."""
    rows, width = pixels.shape
    of = np.repeat(np.arange(len(heights)) * 1024, heights)
    c = np.bincount((pixels.view(np.uint8).reshape(rows, width, 4) + (of[:, None] + _CHANNEL)[:, None]).ravel(), minlength=len(heights) * 1024)
    n = np.arange(int(heights.max()) * width + 1)
    weight = np.rint(n * np.log2(np.maximum(n, 1)) * (1 << 20)).astype(np.int64)
    return 4 * weight[heights * width] - weight[c].reshape(-1, 1024).sum(axis=1)


def _copies(argb: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references, in order and apart: runs of pixels that repeat, pair by pair, the
    last place in the same image where the pair was."""
    pairs = argb[:-1].astype(np.uint64) << np.uint64(32) | argb[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
    later, before = order[again + 1], order[again]
    # A pair across two images is the first one's last, so it is nobody's source; here it stops to be a copy.
    within = (image[later] == image[before]) & (image[later] == image[later + 1]) & (later - before <= FARTHEST_COPY)
    distance = np.zeros(len(argb), np.int64)
    distance[later[within]] = later[within] - before[within]
    change = np.flatnonzero(np.append(True, distance[1:] != distance[:-1]))
    ends = np.append(change[1:], len(distance))
    out, free = [], 0
    run = distance[change] > 0
    for a, b, d in zip(change[run].tolist(), ends[run].tolist(), distance[change[run]].tolist(), strict=True):
        a = max(a, free)
        while b + 1 - a >= 2:
            length = min(b + 1 - a, LONGEST_COPY)
            out.append((a, length, d))
            a += length
            free = a
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _hits(argb: np.ndarray, image: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pixels their image's colour cache holds when they come, and all pixels' slots."""
    slot = ((argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    later, before = order[1:], order[:-1]
    hit = np.zeros(len(argb), bool)
    hit[later] = (slot[later] == slot[before]) & (argb[later] == argb[before]) & (image[later] == image[before])
    return hit, slot.astype(np.int64)


@lru_cache(64)
def _near_codes(width: int) -> np.ndarray:
    """The code of each distance up to the farthest one in ``NEAR``; 0 where it has none."""
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    out = np.zeros(max(near) + 1, np.int64)
    out[list(near)] = list(near.values())
    return out


def _distance_codes(distance: np.ndarray, widths: np.ndarray) -> np.ndarray:
    out = distance + len(NEAR)
    for width in np.unique(widths).tolist():
        near = _near_codes(width)
        own = np.flatnonzero((widths == width) & (distance < len(near)))
        code = near[distance[own]]
        out[own[code > 0]] = code[code > 0]
    return out


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """``huffman_lengths`` of each row."""
    rows, symbols = np.nonzero(counts)
    order = np.lexsort((symbols, counts[rows, symbols], rows))
    rows, symbols = rows[order], symbols[order]
    ranked, ends = counts[rows, symbols].tolist(), np.cumsum(np.bincount(rows, minlength=len(counts))).tolist()
    depths: list[int] = []
    for a, b in zip([0, *ends], ends, strict=False):
        depths += _depths(ranked[a:b], most)
    out = np.zeros(counts.shape, np.uint8)
    out[rows, symbols] = depths
    return out


def _canonical_rows(lengths: np.ndarray) -> np.ndarray:
    """``canonical`` of each row."""
    rows, symbols = np.nonzero(lengths)
    own = lengths[rows, symbols].astype(np.int64)
    order = np.argsort(rows << 4 | own, kind="stable")
    rows, symbols, own = rows[order], symbols[order], own[order]
    span = 1 << (LONGEST_CODE - own)
    before = np.cumsum(span) - span
    before -= before[np.searchsorted(rows, rows)]
    codes = np.zeros(lengths.shape, np.int64)
    codes[rows, symbols] = _REVERSED[LONGEST_CODE][before & (1 << LONGEST_CODE) - 1]
    return codes


def _codes_of(counts: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A prefix code for each row of counts: each symbol's bits << 4 | their number (none for a lone symbol), and what
    ``write_code`` writes of the codes, as rows, values and bits in order."""
    lengths = _lengths(counts, LONGEST)
    used = np.count_nonzero(lengths, axis=1)
    # No simple code can name a lone symbol beyond 255.
    lengths[(used == 1) & (lengths[:, 256:] > 0).any(axis=1), 0] = 1
    used, greatest = np.count_nonzero(lengths, axis=1), lengths.shape[1] - 1 - (lengths[:, ::-1] > 0).argmax(axis=1)
    simple = (used == 0) | (used <= 2) & (greatest < 256)
    entries = np.where(used[:, None] > 1, _canonical_rows(lengths) << 4 | lengths, 0).astype(np.uint64)
    fields: list[tuple[Sequence[int] | np.ndarray, ...]] = []
    for row in np.flatnonzero(simple).tolist():
        named = np.flatnonzero(lengths[row]).tolist() or [0]
        size = 8 if named[0] > 1 else 1
        value = 1 | len(named) - 1 << 1 | (size == 8) << 2 | named[0] << 3
        if len(named) == 2:
            value |= named[1] << 3 + size
        fields.append(([row], [value], [3 + size + 8 * (len(named) - 1)]))
    normal = np.flatnonzero(~simple)
    if len(normal):
        rows, token, extra, size = _length_tokens(lengths[normal], alphabets[normal])
        own = _lengths(np.bincount(rows * 19 + token, minlength=len(normal) * 19).reshape(-1, 19), 7)
        alone = np.flatnonzero(np.count_nonzero(own, axis=1) == 1)
        own[alone, (own[alone] == 0).argmax(axis=1)] = 1  # a second one makes the code complete
        ordered = own[:, _CODE_LENGTH_ORDER].astype(np.int64)
        given = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(axis=1))
        fields.append((normal, given - 4 << 1, np.full(len(normal), 5)))
        fields.append((normal, (ordered << 3 * np.arange(19)).sum(axis=1), 3 * given + 1))  # the last: all lengths are given
        bits = own[rows, token].astype(np.int64)
        fields.append((normal[rows], _canonical_rows(own)[rows, token] | extra << bits, bits + size))
    row, value, size = (np.concatenate(x).astype(np.int64) for x in zip(*fields, strict=True))
    order = np.argsort(row, kind="stable")
    return entries, (row[order], value[order].astype(np.uint64), size[order])


def _length_tokens(lengths: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of each code as symbols of the code for lengths: rows, symbols, extra bits and their number."""
    ended = np.zeros((len(lengths), lengths.shape[1] + 1), np.int64)
    ended[:, :-1] = lengths
    ended[np.arange(len(lengths)), alphabets] = -1
    rows, symbols = np.nonzero(ended)
    gap = np.diff(symbols, prepend=-1) - 1
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    gap[first] = symbols[first]
    long, left = gap // 138, gap % 138
    tail = np.where(left >= 3, 1, left)
    last = ended[rows, symbols]
    times = long + tail + (last > 0)
    of = np.repeat(np.arange(len(rows)), times)
    k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    left, within = left[of], k - long[of]
    own, middle = within == tail[of], (within >= 0) & (left >= 3)
    token = np.where(own, last[of], np.where(within < 0, 18, np.where(left >= 11, 18, np.where(left >= 3, 17, 0))))
    extra = np.where(own, 0, np.where(within < 0, 127, np.where(left >= 11, left - 11, np.where(middle, left - 3, 0))))
    return rows[of], token, extra, np.where(own | (token == 0), 0, np.where(token == 18, 7, 3))


def _put(words: np.ndarray, at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Puts values of so many bits at ascending places of a stream of zeros."""
    if not len(at):
        return
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[starts]] |= np.bitwise_or.reduceat(values << shift, starts)
    over = np.flatnonzero((at & 63) + sizes > 64)
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])


def _streams(heads: list[BitWriter], argb: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """Each image's stream: what its head has, then the codes and pixels of the main image."""
    count = len(heads)
    image = np.repeat(np.arange(count), sizes)
    place, lengths, distances = _copies(argb, image)
    edges = np.zeros(len(argb) + 1, np.int64)
    edges[place] += 1
    edges[place + lengths] -= 1
    single = np.cumsum(edges[:-1]) == 0
    hit, slot = _hits(argb, image, CACHE_BITS)
    hit &= single
    cached = np.bincount(image[hit], minlength=count) > 3
    hit &= cached[image]
    literal, hits = np.flatnonzero(single & ~hit), np.flatnonzero(hit)
    length_code, length_extra, length_bits = _prefixes(lengths)
    far_code, far_extra, far_bits = _prefixes(_distance_codes(distances, widths[image[place]]))
    # Symbols by image; the channels but green share a code.
    green = image * GREEN
    green[literal] += argb[literal] >> np.uint32(8) & np.uint32(255)
    green[hits] += 280 + slot[hits]
    green[place] += 256 + length_code
    rest = [(image[literal] << 8) + (argb[literal] >> np.uint32(k) & np.uint32(255)) for k in (16, 0, 24)]
    far = image[place] * 40 + far_code
    token = single
    token[place] = True
    token = np.flatnonzero(token)
    codes = []
    for symbols, alphabet, own in ((green[token], GREEN, np.where(cached, GREEN, 280)), (np.concatenate(rest), 256, np.full(count, 256)), (far, 40, np.full(count, 40))):
        counts = np.bincount(symbols, minlength=count * alphabet).reshape(count, alphabet)
        entries, fields = _codes_of(counts, own)
        codes.append((entries.ravel(), fields, np.bincount(fields[0], fields[2], count).astype(np.int64)))
    (green_entries, *green_code), (rest_entries, *rest_code), (far_entries, *far_code) = codes
    # A token's bits together: 40 of a literal at most, 55 of a copy.
    values, bits = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.uint64)

    def add(at: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        values[at] |= value << bits[at]
        bits[at] += size

    four, low = np.uint64(4), np.uint64(15)
    entry = green_entries[green[token]]
    add(token, entry >> four, entry & low)
    for symbols in rest:
        entry = rest_entries[symbols]
        add(literal, entry >> four, entry & low)
    add(place, length_extra.astype(np.uint64), length_bits.astype(np.uint64))
    entry = far_entries[far]
    add(place, entry >> four, entry & low)
    add(place, far_extra.astype(np.uint64), far_bits.astype(np.uint64))
    body = (image[token], values[token], bits[token].astype(np.int64))
    for k, head in enumerate(heads):
        head.write(1 | CACHE_BITS << 1 if cached[k] else 0, 6 if cached[k] else 2)  # the last: one group
    at = np.array([head.n for head in heads])
    parts = []
    for fields, size in (green_code, rest_code, rest_code, rest_code, far_code, (body, np.bincount(body[0], body[2], count).astype(np.int64))):
        parts.append((at, fields))
        at = at + size
    taken = at + 63 >> 6
    base = np.cumsum(taken) - taken
    words = np.zeros(int(taken.sum()), "<u8")
    for begin, (row, value, size) in parts:
        before = np.cumsum(size) - size
        first = np.searchsorted(row, np.arange(count))
        _put(words, before + (base * 64 + begin - before[np.minimum(first, len(before) - 1)])[row], value, size)
    stream, out = words.view(np.uint8), []
    for head, begin, end in zip(heads, (base * 8).tolist(), at.tolist(), strict=True):
        own = np.frombuffer(head.bytes(), np.uint8)
        stream[begin : begin + len(own)] |= own
        out.append(stream[begin : begin + (end + 7) // 8].tobytes())
    return out


def encode_column(data: bytes, width: int) -> bytes:
    return encode_columns([data], width)[0]


def encode_columns(payloads: Sequence[bytes], width: int) -> list[bytes]:
    """For each payload a WebP file of so wide an image whose RGBA samples it is. Where an image has few colours they become
    a palette; else green is subtracted, or pixels are predicted from their left or top neighbours, where that makes the
    channels' entropy less. The images share array operations and nothing else: a file is the same whatever is beside it."""
    rgba = np.frombuffer(b"".join(payloads), "<u4")
    argb = (rgba & np.uint32(0xFF00FF00)) | (rgba & np.uint32(0xFF)) << np.uint32(16) | rgba >> np.uint32(16) & np.uint32(0xFF)
    heights = np.array([len(x) // 4 // width for x in payloads])
    heads = []
    for height in heights.tolist():
        heads.append(BitWriter())
        heads[-1].write(SIGNATURE | width - 1 << 8 | height - 1 << 22 | 1 << 36, 40)
    widths, parts = _transformed(heads, argb.reshape(-1, width), heights)
    for head in heads:
        head.write(0, 1)
    return [riff(x) for x in _streams(heads, np.concatenate(parts), np.array([len(x) for x in parts]), widths)]


def _transformed(heads: list[BitWriter], pixels: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Writes the transform of each image (so many rows each), if any; the widths and pixels left to be coded."""
    width, ends = pixels.shape[1], np.cumsum(heights)
    starts = ends - heights
    widths, parts = np.full(len(heads), width), [pixels[a:b].ravel() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    plain = []
    for k, (out, argb) in enumerate(zip(heads, parts, strict=True)):
        look = np.sort(argb[:LOOK])
        colours = np.unique(argb) if np.count_nonzero(look[1:] != look[:-1]) < 256 else argb
        if len(colours) > 256 or 4 * len(colours) >= len(argb):
            plain.append(k)
            continue
        index = np.searchsorted(colours, argb).reshape(-1, width)
        packing = palette_bits(len(colours))
        wide = ceil_shift(width, packing) << packing
        index = np.pad(index, ((0, 0), (0, wide - width)))
        packed = sum(index[:, k :: 1 << packing] << (k * (8 >> packing)) for k in range(1 << packing))
        out.write(1, 1)
        out.write(PALETTE, 2)
        out.write(len(colours) - 1, 8)
        write_pixels(out, _argb(np.diff(_channels(colours), axis=0, prepend=0) & 0xFF)[None, :], False)
        widths[k], parts[k] = packed.shape[1], np.uint32(0xFF000000) | (packed.astype(np.uint32) << np.uint32(8)).ravel()
    if not plain:
        return widths, parts
    plain = np.array(plain)
    seen = np.minimum(heights[plain], -(-LOOK // width))
    some, firsts = _rows_of(pixels, starts[plain], seen)
    options = ((SUBTRACT_GREEN, 0), (PREDICTOR, 1), (PREDICTOR, 2))
    bits = [_entropies(some, seen) * 0.98] + [_entropies(_residual(some, *option, firsts), seen) for option in options]
    best = np.argmin(bits, axis=0)
    for option, (kind, mode) in enumerate(options, 1):
        own = plain[best == option]
        if not len(own):
            continue
        rows, firsts = _rows_of(pixels, starts[own], heights[own])
        left = np.split(_residual(rows, kind, mode, firsts), firsts[1:])
        for k, residual in zip(own.tolist(), left, strict=True):
            parts[k], out = residual.ravel(), heads[k]
            out.write(1, 1)
            out.write(kind, 2)
            if kind == PREDICTOR:
                out.write(7, 3)
                out.write(0, 1)  # an image of one colour: five codes of a symbol each, and no bits for its pixels
                for symbol in (mode, 0, 0, 255, 0):
                    wide = int(symbol > 1)
                    out.write(1 | wide << 2 | symbol << 3, 11 if wide else 4)
    return widths, parts


def _rows_of(pixels: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """So many rows from each start on, and where each start's rows begin among them."""
    firsts = np.cumsum(counts) - counts
    return pixels[np.arange(int(counts.sum())) + np.repeat(starts - firsts, counts)], firsts


def _residual(pixels: np.ndarray, kind: int, mode: int, firsts: np.ndarray) -> np.ndarray:
    """What is left of the rows of images, which begin at ``firsts``, less green, or less their left (1) or top (2)
    neighbours."""
    own = pixels.view(np.uint8).reshape(*pixels.shape, 4)  # blue, green, red, alpha
    out = own.copy()
    if kind == SUBTRACT_GREEN:
        out[..., 0] -= own[..., 1]
        out[..., 2] -= own[..., 1]
    else:
        if mode == 1:
            out[:, 1:] -= own[:, :-1]
            out[1:, 0] -= own[:-1, 0]
        else:
            out[1:] -= own[:-1]
            out[firsts, 1:] = own[firsts, 1:] - own[firsts, :-1]
        out[firsts, 0] = own[firsts, 0]
        out[firsts, 0, 3] += np.uint8(1)  # less 255, by 256
    return out.view("<u4").reshape(pixels.shape)
