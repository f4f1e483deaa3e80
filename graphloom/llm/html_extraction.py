"""Main text of web pages by differencing each page against its nearest URLs.

A page is cut into text lines, one for each block.  Elements that the markup names as no article
(nav, footer, aside, form, script, adverts by class, reader comments and so on) yield no lines.
Within each host pages are ordered by URL path; each page is aligned with the page before and the
page after it by a longest common subsequence of lines, and lines that they share are deleted.
A page equal to its neighbour says nothing about templates and is passed over.  Of two neighbours one
may be an edition of the same text (four fifths of the characters are shared): then only lines that
both neighbours share go.  Lines inside an explicit article or main element stay, as prose may well be
quoted on another page.

Pages are dealt into ranges of the URL order; the range borders come from a bounded sample, and the
last and first page of each range are sent to the next one too, so every page meets its true
neighbours and the result does not depend on the number of ranges.  A host may hold any share of
all pages.  The html is parsed once and its lines are shuffled once.  A range is sorted by Spark and
read as a stream, so beyond `most_ranges` ranges grow without taking more memory.

Nulls: null html is empty, a null url has the empty host and path, a null page_id stays null and
sorts last.  Repeated rows each get a result; an empty table gives an empty one; extra columns are
ignored.  Pages are read whole; unclosed elements end with the article or the page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_id_of, parts, sliced

#: Elements without article text, and class, id or role names of page furniture.
SKIPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg canvas select option button textarea menu dialog".split())
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies disclaimer disqus feedback footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion promoted recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
MAIN = re.compile(r"""\b(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""", re.I)
LINES = "bucket int, host string, path string, key long, url string, halo boolean, lines string, inside string"
RESULT = "key long, url string, text string, n_chars long, n_shared long"
#: Of several neighbours, one that shares this part of a page's characters is an edition of it.
EDITION = 0.8
#: Names of furniture that articles of their own may stand in: reader comments and the like.
VOICES = frozenset("comment comments disqus feedback related recommended promoted sponsored".split())


def _furniture(attributes: str) -> str:
    """The part of a name that says an element is page furniture; empty if none does."""
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            ends = re.split(r"[-_]+", name)
            if name in FURNITURE:
                return name
            if len(ends) > 1 and not {"article", "content", "post", "entry", "body"} & set(ends):
                for end in (ends[0], ends[-1]):
                    if end in FURNITURE:
                        return end
    return ""


def page_lines(html: str) -> tuple[list[str], list[bool]]:
    """The text lines of a page in order, and which of them lie inside an article or main element."""
    lines, inside, held = [], [], []
    skip, voice, depth, main, at = "", False, 0, [], 0

    def flush():
        line = " ".join(entities.unescape("".join(held)).split()) if held else ""
        held.clear()
        if line:
            lines.append(line)
            inside.append(bool(main))

    for m in MARKUP.finditer(html):
        if not skip and m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        close = bool(m[2])
        if skip and tag in ("article", "main") and not close and not voice and skip != tag:
            skip, depth = "", 0  # an unclosed menu ends where the article starts
        elif skip:
            if tag == skip:
                depth += -1 if close else 1
                if depth == 0:
                    skip = ""
            continue
        if tag not in INLINE:
            flush()
        if close:
            if main and tag == main[-1]:
                main.pop()
        elif tag not in VOID:
            attributes = m[4]
            named = _furniture(attributes) if attributes else ""
            if (tag in SKIPPED or (tag == "header" and not main) or named) and tag not in ("html", "body") and not attributes.endswith("/"):
                skip, voice, depth = tag, named in VOICES, 1
            elif tag in ("article", "main") or (attributes and MAIN.search(attributes)):
                main.append(tag)
    if not skip and at < len(html):
        held.append(html[at:])
    flush()
    return lines, inside


def _rows(a: list, b: list):
    """Bit rows of the alignment: a zero bit j of row i raises the common length at b[j]."""
    place: dict = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _common_lengths(a: list, b: list) -> np.ndarray:
    v = 0
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, (1 - bits.astype(np.int64)).cumsum()]


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    in_a, in_b = set(a), set(b)
    where = [i for i, x in enumerate(a) if x in in_b]
    return [where[i] for i in _align([a[i] for i in where], [x for x in b if x in in_a])]


def _align(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if a == b:
        return list(range(len(a)))
    if len(a) > 1 and len(a) * len(b) > 1 << 24:  # halves of a against the best cut of b: rows stay small
        half = len(a) // 2
        cut = int((_common_lengths(a[:half], b) + _common_lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def deletable(lines: list[str], inside: list[bool], neighbours: list[list[str]]) -> set[int]:
    """The lines that neighbours share and nothing keeps."""
    shared = [set(common_lines(lines, other)) for other in neighbours if other != lines]
    if not shared:
        return set()
    size, gone = sum(map(len, lines)), set.intersection(*shared)
    for own in shared:
        if sum(len(lines[i]) for i in own) < EDITION * size:
            gone |= own
    return {i for i in gone if not inside[i]}


def _url_parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(pages["url"], F.lit(""))
    return pages.select(
        F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"(?:/|\.html?)$", "").alias("path"),
        F.coalesce(pages["page_id"].cast("long"), F.lit(NULL_KEY)).alias("key"),
        pages["url"].alias("url"),
        F.coalesce(pages["html"], F.lit("")).alias("html"),
    )


def _parse(borders: list, halo: dict):
    """html to lines, each page in its range, and the pages at its borders in the neighbouring one too."""

    def run(batches):
        names = ["bucket", "host", "path", "key", "url", "halo", "lines", "inside"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            for rows in sliced(batch, 4 << 20):
                out = []
                for host, path, key, url, html in zip(*(rows[c].to_pylist() for c in ("host", "path", "key", "url", "html")), strict=True):
                    lines, inside = page_lines(html)
                    row = (host, path, key, url)
                    text, marks = "\n".join(lines), "".join("01"[x] for x in inside)
                    out.append((bisect_right(borders, (host, path, key)), *row, False, text, marks))
                    out += [(b, *row, True, text, marks) for b in halo.get((host, path, key), ())]
                columns = zip(*out, strict=True) if out else ((),) * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _difference(batches):
    """Rows come ordered by range, host and path; a page is done when the one after it is known."""

    def done(before, page, after):
        gone = deletable(page[5], page[6], [other[5] for other in (before, after) if other and other[:2] == page[:2]])
        text = " ".join(x for i, x in enumerate(page[5]) if i not in gone)
        return page[2], page[3], text, len(text), len(gone)

    def flush(out):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = zip(*out, strict=True) if out else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "url", "text", "n_chars", "n_shared"])

    before = page = None
    for batch in batches:
        for rows in sliced(batch, 4 << 20):
            out = []
            for bucket, host, key, url, halo, lines, marks in zip(*(rows[c].to_pylist() for c in ("bucket", "host", "key", "url", "halo", "lines", "inside")), strict=True):
                new = (bucket, host, key, url, halo, lines.split("\n") if lines else [], [x == "1" for x in marks])
                if page and not page[4]:
                    out.append(done(before, page, new))
                before, page = page, new
            yield flush(out)
    if page and not page[4]:
        yield flush([done(before, page, None)])


def extract(pages: DataFrame, range_bytes: int = 4 << 20, most_ranges: int = 65536, sample_per_range: int = 4) -> DataFrame:
    """page_id, url, text and n_chars of every page, and how many lines differencing deleted."""
    found = _url_parts(pages)
    total = found.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = min(most_ranges, parts(total, range_bytes))
    order = ["host", "path", "key"]
    borders, halo = [], {}
    if n > 1:
        sample = found.select(*order).orderBy(F.xxhash64("key", "path"), *order).limit(n * sample_per_range).collect()  # at most 262,144 keys
        keys = sorted(tuple(r) for r in sample)
        borders = sorted({keys[len(keys) * k // n] for k in range(1, n)})
        edges = found.select(*order).mapInArrow(_ranges(borders), "bucket int, host string, path string, key long").groupBy("bucket").agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).orderBy("bucket").collect()
        for a, b in zip(edges, edges[1:], strict=False):
            halo.setdefault(tuple(a["high"]), set()).add(b["bucket"])
            halo.setdefault(tuple(b["low"]), set()).add(a["bucket"])
    lines = found.mapInArrow(_parse(borders, halo), LINES)
    ordered = lines.repartition("bucket").sortWithinPartitions("bucket", *order, "url", "lines")
    done = ordered.mapInArrow(_difference, RESULT)
    return done.select(doc_id_of(done["key"]).alias("page_id"), "url", "text", "n_chars", "n_shared")


def _ranges(borders: list):
    def run(batches):
        for rows in batches:
            keys = zip(*(rows[c].to_pylist() for c in ("host", "path", "key")), strict=True)
            bucket = [bisect_right(borders, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), rows["host"], rows["path"], rows["key"]], ["bucket", "host", "path", "key"])

    return run
