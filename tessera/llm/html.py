"""Main text of web pages by nearest-URL page differencing.

Pages are put in order of host and URL path; each is paired with the neighbour of its host whose path shares the longer
prefix. All text lines of a page (blocks outside scripts and styles, menus and footers included) are aligned with all of
the neighbour's by a longest common subsequence, and shared lines are deleted. Of the lines that alignment leaves, markup
decides: lines of elements that are no content by their role in HTML (menus, footers, asides, forms ...) or by a whole
class, id or role go, and where a page declares its content (article, main), lines outside of it go. An article or main is
never dropped for its class.

A page with the same lines, one that holds all of a page's content, and one that shares ``COPY`` of both pages' content
characters or more are taken for copies, and the next nearest page of the host decides (up to ``REACH`` pages before and
after). Where ``TEMPLATE`` pages met first share that much without being the same, it is the host's template, and the
nearest of them decides. A page with copies alone around it is left to markup.

Pages are parsed twice. First, keys and the lines' hashes and lengths are written and put in order: a range exchange, a
sort, and ranks across ranges (from the ranges' sizes, one number each). Blocks of consecutive ranks, with a margin of
pages before and after, are compared by themselves, so a host of any size is spread over tasks, and the pairs are the same
however the data is partitioned. Then the texts meet what they lose.

Defined results: null or empty html gives empty text; a null url is a host and path of its own (empty); repeated rows are
each other's neighbours and copies; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_spread, written

#: Share of both pages' characters from which on they are copies, and how many such pages in a row show a template.
COPY = 0.9
TEMPLATE = 3
#: Pages before and after a page that it is compared with at most, and consecutive pages that are compared together.
REACH = 64
RUN = 1024

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe map math menu nav noframes noscript object search select svg template title video".split())
DROPPED_OUTSIDE = frozenset(["header"])
CONTENT = frozenset(["article", "main"])
#: Class, id and role names, or words of a name that has none but these, that say an element isn't content.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies "
    "disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion "
    "related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Elements nested deeper than this are taken for a part of their parent.
DEEPEST = 2000
#: Bits of a table of alignments that is kept whole; a larger one is halved.
TABLE_BITS = 1 << 26
#: What a line is by markup.
APART, PLAIN, DECLARED = range(3)
#: Start tags that end an open element of the first kind, up to the second.
CLOSES = {"li": ("li", frozenset("ul ol menu".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr", frozenset(["table"])), "td": ("td th", frozenset("tr table".split())), "th": ("td th", frozenset("tr table".split())), "option": ("option", frozenset(["select"]))}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, with quoted values that may hold >.
_QUOTED_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "xmp")}
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in order: ("text", "", the text), ("start", name, attributes) and ("end", name, ""). Comments,
    declarations, scripts and styles are passed over. Every character is looked at a bounded number of times: what has
    once not been found up to the end isn't looked for again."""
    at, end = 0, len(html)
    quotes, raws = True, dict(_RAW_END)
    while at < end:
        opened = html.find("<", at)
        if opened != at:
            yield "text", "", html[at : opened if opened >= 0 else end]
            if opened < 0:
                return
            at = opened
        if html.startswith("<!--", at):
            closed = html.find("-->", at + 4)
            at = closed + 3 if closed >= 0 else end
            continue
        named = _NAME.match(html, at + 1)
        if named is None and html[at + 1 : at + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            at += 1
            continue
        closed = _QUOTED_END.match(html, named.end()) if named and quotes else None
        quotes = quotes and (named is None or closed is not None)
        stop = closed.end() if closed else html.find(">", at) + 1
        if not stop:  # an unfinished tag at the end
            return
        if named:
            name = named[2].lower()
            yield ("end", name, "") if named[1] else ("start", name, html[named.end() : stop - 1])
            if not named[1] and name in _RAW_END:
                found = raws[name].search(html, stop) if raws[name] else None
                if found is None:
                    return  # runs to the end
                stop = found.start()
        at = stop


def named_apart(attributes: str, inside: bool) -> bool:
    """Whether a whole class, id or role names something that isn't content."""
    if not attributes or not attributes.strip():
        return False
    for m in _NAMED.findall(attributes):
        for name in m.lower().strip("\"'").split():
            words = set(_WORD.findall(name))
            if words and (words <= NOT_CONTENT or (not inside and words == {"header"})):
                return True
    return bool(_HIDDEN.search(attributes))


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The page's text blocks in order, and what each is by markup: APART, DECLARED as content, or PLAIN. Text of an element
    set apart is a line of its own, even inside a paragraph."""
    out: list[tuple[str, int]] = []
    buffers: tuple[list[str], list[str]] = ([], [])  # of content, of what is set apart
    # Open elements: name, whether dropped, whether in content; the places of blocks among them; how many there are of each.
    stack: list[tuple[str, bool, bool]] = []
    blocks: list[int] = []
    open_: dict[str, int] = {}

    def flush(both: bool = True) -> None:
        for apart in (1, 0) if both else (1,):
            if buffers[apart]:
                text = " ".join(unescape("".join(buffers[apart])).split())
                if text:
                    out.append((text, APART if apart else DECLARED if stack and stack[-1][2] else PLAIN))
                buffers[apart].clear()

    def close(at: int) -> None:
        if blocks and blocks[-1] >= at:
            flush()
        elif stack[-1][1] and not stack[at][1]:
            flush(both=False)
        for name, _, _ in stack[at:]:
            open_[name] -= 1
        while blocks and blocks[-1] >= at:
            blocks.pop()
        was_dropped = stack[-1][1]
        del stack[at:]
        if was_dropped and not (stack and stack[-1][1]):
            flush(both=False)

    for kind, name, rest in tokens(html or ""):
        if kind == "text":
            buffers[bool(stack) and stack[-1][1]].append(rest)
        elif kind == "end":
            if open_.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in BLOCK:
                flush()
        else:
            if name in BLOCK:
                # A block ends an open paragraph; items end items of their list.
                if blocks and stack[blocks[-1]][0] == "p":
                    close(blocks[-1])
                if name in CLOSES:
                    kinds, until = CLOSES[name]
                    if any(open_.get(k) for k in kinds.split()):
                        for i in reversed(blocks):
                            if stack[i][0] in kinds.split():
                                close(i)
                                break
                            if stack[i][0] in until:
                                break
                flush()
            elif name == "br":
                buffers[bool(stack) and stack[-1][1]].append(" ")
            if name in VOID or (rest.endswith("/") and name not in BLOCK) or len(stack) >= DEEPEST:
                continue
            dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            apart = name in DROPPED or (name in DROPPED_OUTSIDE and not inside) or (name not in ("html", "body", "article", "main") and named_apart(rest, inside))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append((name, dropped or apart, inside or name in CONTENT))
            open_[name] = open_.get(name, 0) + 1
    flush()
    return out


def content(lines: list[tuple[str, int]]) -> list[bool]:
    """Which lines markup takes for the page's content: those declared as it, or else all that aren't set apart."""
    least = DECLARED if any(kind == DECLARED for _, kind in lines) else PLAIN
    return [kind >= least for _, kind in lines]


def _rows(mine: list, other: list, keep: bool) -> list[int]:
    """Bit j of a row is 0 where my first j + 1 lines have a longer common subsequence with what of the other page has been
    read than my first j lines have. The row of nothing read, and then, with ``keep``, all others, else the last."""
    places: dict = {}
    for j, line in enumerate(mine):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(mine)) - 1
    rows = [full]
    for line in other:
        hit = rows[-1] & places.get(line, 0)
        row = ((rows[-1] + hit) | (rows[-1] - hit)) & full
        if keep:
            rows.append(row)
        else:
            rows[-1] = row
    return rows


def _lengths(row: int, n: int) -> list[int]:
    """Length of the longest common subsequence of my first 0, 1, ... n lines."""
    out = [0]
    for c in f"{row:0{n}b}"[::-1] if n else "":
        out.append(out[-1] + (c == "0"))
    return out


def shared(mine: list, other: list) -> list[bool]:
    """Which of my lines lie on a longest common subsequence with the other page's. Equal ends are taken off first; a large
    table is never held: the other page is halved, and mine where both halves have most in common (bit-parallel)."""
    a, b = 0, 0
    while a < min(len(mine), len(other)) and mine[a] == other[a]:
        a += 1
    while b < min(len(mine), len(other)) - a and mine[-1 - b] == other[-1 - b]:
        b += 1
    x, y = mine[a : len(mine) - b], other[a : len(other) - b]
    return [True] * a + _inner(x, y) + [True] * b


def _inner(mine: list, other: list) -> list[bool]:
    if not mine or not other:
        return [False] * len(mine)
    if len(other) > 1 and len(mine) * len(other) > TABLE_BITS:
        half = len(other) // 2
        left = _lengths(_rows(mine, other[:half], False)[0], len(mine))
        right = _lengths(_rows(mine[::-1], other[half:][::-1], False)[0], len(mine))[::-1]
        cut = max(range(len(mine) + 1), key=lambda j: left[j] + right[j])
        return shared(mine[:cut], other[:half]) + shared(mine[cut:], other[half:])
    rows = _rows(mine, other, True)
    out = [False] * len(mine)
    i = len(other)
    for j in range(len(mine) - 1, -1, -1):
        if rows[i] >> j & 1:
            continue  # this line doesn't lengthen it
        while i and not rows[i - 1] >> j & 1:
            i -= 1  # an earlier line of the other page does as well
        out[j] = True
        i -= 1
    return out


def less_shared(mine: tuple, others: Iterable[tuple]) -> list[int]:
    """Places, among my lines, of those shared with the nearest of ``others`` (in order of nearness) that isn't a copy. Pages
    are (marks, sizes): the lines' hashes, and their lengths where they are content by markup, else 0."""
    marks, sizes = mine
    alike: list[list[int]] = []
    for other in others if any(sizes) else ():
        if other[0] == marks:
            continue
        drop = shared(marks, other[0])
        places = [i for i, d in enumerate(drop) if d]
        size = sum(n for n, d in zip(sizes, drop, strict=True) if d)
        if size == sum(sizes):
            continue
        if size < COPY * sum(sizes) or size < COPY * sum(other[1]):
            return places
        alike.append(places)
        if len(alike) == TEMPLATE:
            return alike[0]
    return []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def keyed(pages: DataFrame, key: str) -> DataFrame:
    """id (the same for equal rows alone), page_id, url and html."""
    url, html = (F.col(c).cast("string") for c in ("url", "html"))
    whole = F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(key), url, html)))
    return pages.select(F.md5(whole).alias("id"), F.col(key).alias("page_id"), url.alias("url"), html.alias("html"))


def measured(rows: DataFrame) -> DataFrame:
    """id, page_id, url, host and path of every row, and its marks and sizes."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [lines_of(h.as_py()) for h in part.column(5)]
                marks = [[xxh64_intdigest(x) - (1 << 63) for x, _ in lines] for lines in found]
                sizes = [[len(x) if c else 0 for (x, _), c in zip(lines, content(lines), strict=True)] for lines in found]
                arrays = [pa.array(marks, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), *arrays], ["id", "page_id", "url", "host", "path", "marks", "sizes"])

    rows = rows.select("id", "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    return rows.mapInArrow(run, f"id string, page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, path string, marks array<long>, sizes array<int>")


def contents(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """page_id, url and text of every row: the lines that alignment leaves and markup takes for content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, texts = batch.slice(a, 500), []
                for html, gone in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                    lines, gone = lines_of(html.as_py()), set(gone or ())
                    texts.append("\n".join(x for i, ((x, _), c) in enumerate(zip(lines, content(lines), strict=True)) if c and i not in gone))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(drop, "id", "left").select("page_id", "url", "html", "dropped")
    return joined.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")


def by_rank(rows: DataFrame) -> DataFrame:
    """id, host, path, marks and sizes of every row, and its rank in the order of hosts and paths."""
    order = ["host", "path", "page_id", "url", "id"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number has the range above 33 bits and the place in it below.
    placed = written(sorted_.withColumn("at", F.monotonically_increasing_id()).select("id", "host", "path", "marks", "sizes", "at"), "order")
    of_range = F.shiftright("at", 33)
    sizes = placed.groupBy(of_range.alias("range")).count().orderBy("range").collect()  # as many as ranges
    firsts, total = [], 0
    for size in sizes:
        firsts.append((size["range"], total))
        total += size["count"]
    firsts = rows.sparkSession.createDataFrame(firsts, "range long, first long")
    ranked = placed.join(F.broadcast(firsts), of_range == F.col("range"))
    return ranked.select("id", "host", "path", "marks", "sizes", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def outwards(i: int, hosts: list[str], paths: list[str]) -> Iterator[int]:
    """Places of the pages of the host of page i, up to REACH before and after it, those of the longer common prefix first
    (of equals the page before): in sorted order, prefixes get no longer outwards."""
    near = lambda j: common_prefix(paths[j], paths[i]) if 0 <= j < len(hosts) and abs(j - i) <= REACH and hosts[j] == hosts[i] else -1
    a, b = i - 1, i + 1
    while (left := near(a)) >= 0 or near(b) >= 0:
        if left >= near(b):
            yield a
            a -= 1
        else:
            yield b
            b += 1


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by block and rank: the places of the lines that pages of the block lose."""

    def of_block(block: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, hosts, paths, marks, sizes, ranks = zip(*rows, strict=True)
        pages, out = list(zip(marks, sizes, strict=True)), []
        for i, rank in enumerate(ranks):
            if rank // RUN == block and (drop := less_shared(pages[i], (pages[j] for j in outwards(i, hosts, paths)))):
                out.append((ids[i], drop))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([d for _, d in out], pa.list_(pa.int32()))], ["id", "dropped"])

    held, rows = None, []
    for batch in batches:
        for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != held and rows:
                yield of_block(held, rows)
                rows = []
            held = block
            rows.append(tuple(row))
    if rows:
        yield of_block(held, rows)


def dropped(rows: DataFrame) -> DataFrame:
    """id and places of the lines it loses, of each page that loses any. Pages in order are cut into blocks of RUN; each
    gets the REACH pages before and after it too, so a block is a task's whole input whatever the hosts' sizes."""
    ranks = by_rank(rows)
    block = lambda rank: F.floor(rank / RUN).cast("long")
    blocks = F.array_distinct(F.array(*(block(F.col("rank") + d) for d in (-REACH, 0, REACH))))
    dealt = ranks.select(F.explode(blocks).alias("block"), "id", "host", "path", "marks", "sizes", "rank").repartition("block").sortWithinPartitions("block", "rank")
    return dealt.mapInArrow(_dropped, "id string, dropped array<int>").groupBy("id").agg(F.min("dropped").alias("dropped"))


def extracted(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = keyed(pages, key)
    drop = written(dropped(written(measured(rows), "pages")), "dropped")
    found = contents(rows, drop)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_spread(spark, sf_dir, "pages"))
