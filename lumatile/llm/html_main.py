"""Main text of web pages by nearest-URL page differencing.

Pages are put in order of host and URL path; each is compared with the neighbour of its host whose
path is nearest and that isn't a copy of it. Their text lines are aligned by a longest common
subsequence, and lines that both have are deleted as the site's. A check by markup follows, for
what two pages can't tell: lines inside an article come back if another page repeats them, and
lines inside menus, forms, comments and the like go even if no neighbour has them.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, to_batch, written

#: Elements whose content is never main text, those that end a line, and those without an end tag (fixed values of HTML).
NEVER = frozenset("head nav footer aside form button select option datalist noscript iframe object canvas svg math audio video template dialog menu map".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose nesting matters; of others only the line breaks do.
NESTED = (NEVER | frozenset("article main header section div ul ol dl table blockquote figure body html span".split())) - VOID
#: Elements that hold a whole page or its main part.
WHOLE = frozenset({"html", "body", "main", "article"})
#: Words in class, id or role that mark what isn't main text.
MARKS = frozenset("ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation navigational menu submenu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion search searchbox pagination pager widget complementary contentinfo copyright disclaimer skip hidden paywall outbrain taboola".split())
#: Those that count inside an article too only if they stand alone: an article has its own header.
HEADERS = frozenset({"header", "head"})
PLAIN, ARTICLE, OTHER = 0, 1, 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marked(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is not main text, is a header, is the main part, isn't shown, by its attributes."""
    if not attributes or attributes.isspace():
        return False, False, False, False
    words, off, main = set(), False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in _WORD.findall(value))
            main |= name == "role" and value.lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            off = True
    return off or not words.isdisjoint(MARKS), not words.isdisjoint(HEADERS) or "banner" in words, main, off


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """A page's text lines (one per block, white space made one space, no empty ones) and for each PLAIN, ARTICLE or OTHER."""
    lines, kinds, held = [], [], []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    kind = PLAIN

    def end_line() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append(text)
                kinds.append(kind)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[4] != ">":  # the page ends inside a tag
            break
        if name in RAW and not m[1]:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if name == "title" or name in BLOCKS:
                end_line()
            at = stop.start() if stop else size
            continue
        if name in BLOCKS:
            end_line()
        elif name in ("br", "wbr", "img", "input"):
            held.append(" " if name != "wbr" else "")
        if name not in NESTED:
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if k:
                if any(x[1] != stack[k - 1][1] for x in stack[k:]):
                    end_line()
                del stack[k:]
        elif not m[3].rstrip().endswith("/") or name not in ("svg", "span"):
            off, header, main, off_by_style = _marked(m[3])
            new = kind
            if name in WHOLE and not off_by_style and all(x[0] != "article" for x in stack):
                off = header = False  # class words of a page or its main part tell what it is about
            if name in NEVER or off or (header or name == "header") and kind != ARTICLE:
                new = OTHER
            elif kind != OTHER and (name in ("article", "main") or main):
                new = ARTICLE
            if new != kind:
                end_line()
            stack.append((name, new))
        kind = stack[-1][1]
    end_line()
    return lines, kinds


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of one longest common subsequence of a and b, in order."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    i_of = [i for i in range(head, len(a) - tail) if a[i] in both]
    j_of = [j for j in range(head, len(b) - tail) if b[j] in both]
    inner = _align([a[i] for i in i_of], [b[j] for j in j_of])
    return [(i, i) for i in range(head)] + [(i_of[i], j_of[j]) for i, j in inner] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _rows(a: list, b: list) -> Iterator[int]:
    """After each of a's lines: bits that are 0 where the length of the common subsequence grows with b (Hyyrö's bit-parallel rows)."""
    match: dict = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & match.get(x, 0)
        v = ((v + u) | (v - u)) & every
        yield v


def _align(a: list, b: list, most_bits: int = 1 << 28) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > most_bits:  # halve a where both halves' subsequences add up to the most
        half = len(a) // 2
        grown = lambda x, y: np.cumsum(1 - np.unpackbits(np.frombuffer(list(_rows(x, y))[-1].to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little")[: len(y)].astype(np.int64))
        up = np.concatenate(([0], grown(a[:half], b)))
        down = np.concatenate(([0], grown(a[half:][::-1], b[::-1])))[::-1]
        cut = int(np.argmax(up + down))
        return _align(a[:half], b[:cut], most_bits) + [(half + i, cut + j) for i, j in _align(a[half:], b[cut:], most_bits)]
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append((i, j := j - 1))
    return out[::-1]


def unshared(lines: list[str], kinds: list[int], other: list[str] | None) -> set[int]:
    """The lines that differencing leaves: those not aligned with a line of the other page.

    If it would delete all lines that markup says nothing of, the pages are versions of one
    another, and what they share is no site's: all lines stay.
    """
    shared = {i for i, _ in common_lines(lines, other)} if other is not None else set()
    plain = [i for i, k in enumerate(kinds) if k == PLAIN]
    return set(range(len(lines))) - (set() if plain and shared.issuperset(plain) else shared)


def main_lines(lines: list[str], kinds: list[int], other: list[str] | None) -> list[str]:
    """What stays of a page's lines, given those of its neighbour: differencing, then the check by markup.

    A page that has an article keeps the whole of that, and nothing else.
    """
    left, article = unshared(lines, kinds, other), ARTICLE in kinds
    return [x for i, (x, k) in enumerate(zip(lines, kinds, strict=True)) if k == ARTICLE or k == PLAIN and not article and i in left]


def split_url(url: str) -> tuple[str, str]:
    """(host without port and www., path without query, fragment and a slash at its end) of a URL; as much of them as there is."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", url)
    m = re.match(r"//([^/?#]*)([^?#]*)", rest)
    host, path = (m[1], m[2]) if m else ("", re.match(r"[^?#]*", rest)[0])
    host = re.sub(r":\d*$", "", host.rpartition("@")[2].lower()).removeprefix("www.")
    return host, unquote(path).rstrip("/")


def nearness(a: str, b: str) -> tuple[int, int]:
    """How near two paths are: equal steps from the start, then equal characters in what follows."""
    x, y = a.split("/"), b.split("/")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    p, q = "/".join(x[n:]), "/".join(y[n:])
    k = 0
    while k < min(len(p), len(q)) and p[k] == q[k]:
        k += 1
    return n, k


EXTRACTED = "page_id long, url string, text string, n_chars long"
#: Bytes of html that a task gets, about; one page may have more.
PART_BYTES = 32 << 20
#: Columns of a page's row in its part: role is 0 for the part's own pages and 1 for a page of another part that is here to be compared with.
ROW = "part int, role int, host string, path string, h long, page_id long, url string, html string"


def _diff(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, host, path, h, page_id: each own page with the nearer one of the pages before and after it that have another h."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def runs():
        """(part, host, h, lines and kinds, path of the first and the last page, own pages as (page_id, url, path)) of successive copies."""
        run = None
        for b in parts:
            for part, role, host, path, h, page_id, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run is None or run[:3] != [part, host, h]:
                    if run:
                        yield run
                    run = [part, host, h, lines_of(page or ""), path, path, []]
                run[5] = path
                if not role:
                    run[6].append((page_id, url, path))
        if run:
            yield run
        yield None

    out, size, before, own = [], 0, None, None
    for after in runs():
        if own is not None:
            lines, kinds = own[3]
            prev = before if before and before[:2] == own[:2] else None
            following = after if after and after[:2] == own[:2] else None
            texts = {}  # by neighbour: copies under one path, or near it, share theirs
            for page_id, url, path in own[6]:
                near = [(nearness(path, p[k]), k) for p, k in ((prev, 5), (following, 4)) if p]
                k = max(near, key=lambda x: x[0])[1] if near else 0
                if k not in texts:
                    texts[k] = "\n".join(main_lines(lines, kinds, {5: prev, 4: following}[k][3][0] if k else None))
                out.append((page_id, url, texts[k], len(texts[k])))
                size += len(texts[k])
                if size > BATCH_BYTES:
                    yield to_batch(out, schema)
                    out, size = [], 0
        before, own = own, after
    if out:
        yield to_batch(out, schema)


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, h, page_id, size) from (page_id, url, h, size)."""
    for b in parts:
        both = [split_url(u or "") for u in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string()), b.column(2), b.column(0), b.column(3)], names=["host", "path", "h", "page_id", "size"])


def order_of(key: tuple) -> tuple:
    """Sorts keys (host, path, h, page_id) as Spark does: text by UTF-8 bytes, null first."""
    return key[0].encode(), key[1].encode(), key[2], key[3] is not None, key[3] or 0


def _sections(part_bytes: int):
    """Of a sorted partition's sections of about part_bytes: the first key, the first with another h, the last with another h than the last, the last, and the bytes."""
    kind = pa.list_(pa.struct([("host", pa.string()), ("path", pa.string()), ("h", pa.int64()), ("page_id", pa.int64())]))
    schema = pa.schema([("keys", kind), ("size", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            own = None
            for b in parts:
                for *key, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if own is None or own[4] + size > part_bytes:
                        if own:
                            yield own
                        own = [key, None, None, key, 0]
                    if own[1] is None and key[2] != own[0][2]:
                        own[1] = key
                    if key[2] != own[3][2]:
                        own[2] = own[3]
                    own[3], own[4] = key, own[4] + size
            if own:
                yield own

        names = ("host", "path", "h", "page_id")
        yield to_batch([([k and dict(zip(names, k, strict=True)) for k in r[:4]], r[4]) for r in rows()], schema)

    return run


def cuts(sections: list[tuple[list, int]], part_bytes: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First keys of the parts, and for each key of a page that is compared with pages of other parts the numbers of these.

    sections: (first, first other, last other, last) as (host, path, h, page_id) and bytes, in order.
    Small neighbours make one part. A part's first pages, which are copies of one another, need the
    last page before that has another h, of any part; likewise its last ones.
    """
    parts: list[list] = []
    for (first, other, other_last, last), size in sections:
        if parts and parts[-1][4] + size <= part_bytes:
            p = parts[-1]
            if p[1] is None:
                p[1] = first if first[2] != p[0][2] else other
            p[2] = other_last or (p[3] if p[3][2] != last[2] else p[2])
            p[3], p[4] = last, p[4] + size
        else:
            parts.append([first, other, other_last, last, size])
    wanted: dict[tuple, list[int]] = {}
    for step, (near, beyond, edge) in ((1, (3, 2, 0)), (-1, (0, 1, 3))):
        one = two = None  # the nearest page seen, and the nearest with another h than that
        for n in range(len(parts))[::step]:
            p = parts[n]
            for seen in (one, two):
                if seen and seen[2] != p[edge][2]:
                    if seen[0] == p[edge][0]:
                        wanted.setdefault(tuple(seen), []).append(n)
                    break
            if p[beyond]:
                two = p[beyond]
            elif one and one[2] != p[near][2]:
                two = one
            one = p[near]
    return [tuple(p[0]) for p in parts], wanted


def _placed(firsts: list[tuple], wanted: dict[tuple, list[int]]):
    """Rows (part, role, host, path, h, page_id, url, html) from (page_id, url, h, html)."""
    order = [order_of(k) for k in firsts]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # a repeated row need not be compared with more than once
        for b in parts:
            rows = []
            for i, (page_id, url, h) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
                key = (*split_url(url or ""), h, page_id)
                rows.append((i, max(0, bisect.bisect_right(order, order_of(key)) - 1), 0, key[0], key[1]))
                if key in wanted and key not in sent:
                    sent.add(key)
                    rows += [(i, n, 1, key[0], key[1]) for n in wanted[key]]
            at, part, role, host, path = zip(*rows, strict=True) if rows else [()] * 5
            own = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(role, pa.int32()), pa.array(host, pa.string()), pa.array(path, pa.string()), own.column(2), own.column(0), own.column(1), own.column(3)],
                                             names=["part", "role", "host", "path", "h", "page_id", "url", "html"])

    return run


def extract(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of pages (columns page_id, url, html): page_id, url, text, n_chars.

    text: the blocks' text in page order, joined by line breaks; empty for a null or empty page or
    one without main text. Pages with a null url count as of one host without a name. A page alone
    of its host, or with copies of it only, is judged by its markup. Repeated rows give equal rows.
    An empty table gives none. Nothing depends on how the rows are partitioned.

    The driver holds four keys for each part_bytes of html, no more; pages move once.
    """
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    light = light.withColumn("h", F.xxhash64("html"))
    keys = written(light.select("page_id", "url", "h", F.octet_length("html").cast("long").alias("size")).mapInArrow(_keys, "host string, path string, h long, page_id long, size long"))
    number = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ("host", "path", "h", "page_id")
    found = keys.repartitionByRange(number, *by).sortWithinPartitions(*by).mapInArrow(_sections(part_bytes), "keys array<struct<host:string,path:string,h:long,page_id:long>>, size long").collect()
    sections = sorted((([k and tuple(k) for k in r["keys"]], r["size"]) for r in found), key=lambda s: order_of(s[0][0]))
    firsts, wanted = cuts(sections, part_bytes)
    rows = light.select("page_id", "url", "h", "html").mapInArrow(_placed(firsts, wanted), ROW)
    return rows.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", *by).mapInArrow(_diff, EXTRACTED)
