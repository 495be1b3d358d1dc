"""Main text of HTML pages by nearest-URL page differencing.

A page is cut into text lines (blocks). Pages of a host are put in order of URL path; each is aligned, by the
longest common subsequence of lines, with the page whose path is nearest, and the lines both share are deleted:
menus, notices and footers that a site repeats. Pages that share most of their sentences are copies of one article,
so the next page that is none is taken instead, however far it is in the block. One other page says little about
the inside of an article: there a line goes only from the beginning or the end, and only if two more pages that
differ from each other share it. Markup judges what the alignment leaves: text in elements for navigation, adverts,
forms or comments is no content however rare it is; and if article elements hold most of the text that is left,
only theirs is content. Where they hold less they are teasers, whose links go.

The order is cut into blocks at sampled places, so a host that holds most pages is spread over many tasks; each
block also gets the nearest pages before and after it, eight on either side whose sentences differ, so a run of
copies counts as one page. A task holds the lines of one block.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches, forget, hashed_sample, written
from corpusmill.llm.tokens import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
SPLIT_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\?[^#]*)?")

RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_TEXT = frozenset("nav footer aside form button select menu dialog fieldset svg canvas object video audio head math map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main".split())
#: Elements of an article that a name for comments takes out of it; all else in it stays whatever its names.
BOXES = frozenset("div section ul ol dl table details center".split())
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
#: Words in the class or id of an element around or beside an article that say that it is no part of it.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond reply replies share sharing social related recommended widget widgets login signup "
    "search pagination pager hidden copyright legal skip".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
ARTICLE_NAMES = frozenset("article-body article-content article-text post-content post-body entry-content story-body story-content articlebody".split())

#: TEASER: a line inside an article that is all links.
TEASER, CONTENT, OTHER, NO_TEXT = 3, 2, 1, 0
#: Pages of different sentences on either side of a block that it also gets; words that make a line a sentence in the test for copies; pages besides its own that must share a line of an article before it goes.
NEIGHBOURS, SENTENCE, WITNESSES = 8, 8, 2


@dataclass
class Page:
    lines: list[str] = field(default_factory=list)
    #: CONTENT or TEASER inside an article, NO_TEXT where markup says so, else OTHER.
    kinds: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Open:
    """`wraps`: numbers of the elements around and including this one that their names, or a form tag, would drop."""

    tag: str
    dropped: bool
    article: bool
    header: bool
    link: bool = False
    wraps: tuple[int, ...] = ()


def element(tag: str, attributes: str, parent: Open, number: int) -> Open:
    """What an element that opens inside `parent` means for its text."""
    dropped, article, header, wraps = parent.dropped, parent.article, parent.header, parent.wraps
    named: dict[str, str] = {}
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = named.get("role", "").strip().lower()
    if tag == "header":
        header = True
        dropped = dropped or not article
    elif tag == "form" or role in ("form", "search"):
        wraps += (number,)
    elif tag in NOT_TEXT or role in ASIDE_ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower():
        dropped = True
    names = (named.get("class", "") + " " + named.get("id", "")).lower()
    aside = COMMENT_WORDS if article else ASIDE_WORDS
    if names != " " and tag not in WHOLE and not dropped and (not article or tag in BOXES) and not aside.isdisjoint(WORDS.findall(names)):
        wraps += (number,)
    if not dropped and (tag in ("article", "main") or role in ("main", "article") or named.get("itemprop", "").lower() == "articlebody" or not ARTICLE_NAMES.isdisjoint(names.split())):
        article = True
    return Open(tag, dropped, article, header, parent.link or tag == "a", wraps)


def layout(n_chars: dict[int, int], articles: list[tuple[int, ...]], total: int) -> set[int]:
    """Elements that stay although their names, or a form tag, speak against them: they hold all articles of the page, or most of its text."""
    if articles:
        return set.intersection(*map(set, articles))
    return {k for k, n in n_chars.items() if 2 * n > total}


def parse(source: str) -> Page:
    """Lines of a page, white space in each turned into single spaces, character references decoded."""
    page, stack, text = Page(), [Open("", False, False, False)], []
    around: list[tuple[int, ...]] = []
    n_chars: dict[int, int] = {}
    articles: list[tuple[int, ...]] = []
    at = total = number = 0
    plain = False

    def add(piece: str) -> None:
        nonlocal plain
        text.append(piece)
        plain = plain or not stack[-1].link and not piece.isspace()

    def flush() -> None:
        nonlocal total, plain
        linked, plain = not plain, False
        line = " ".join(html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if line:
            top = stack[-1]
            away = top.dropped or top.header and not any(o.tag in HEADINGS for o in stack)
            page.lines.append(line)
            page.kinds.append(NO_TEXT if away else OTHER if not top.article else TEASER if linked else CONTENT)
            around.append(top.wraps)
            if not away:
                total += len(line)
                for k in top.wraps:
                    n_chars[k] = n_chars.get(k, 0) + len(line)

    for m in iter(lambda: TOKEN.search(source, at), None):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] if m[2] else m[4]
        if closing:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in INLINE and any(o.tag not in INLINE for o in stack[k + 1 :]):
                        del stack[k]
                    else:
                        del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
            continue
        if tag not in INLINE:
            flush()
            # A new block ends an open paragraph, a new list item or cell the one before it.
            if tag not in ("br", "hr", "img", "input") and stack[-1].tag == "p":
                stack.pop()
            elif stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
            elif len(stack) > 2 and tag == "p" and stack[-1].tag in INLINE:
                while len(stack) > 1 and stack[-1].tag in INLINE:
                    stack.pop()
                if stack[-1].tag == "p":
                    stack.pop()
        if tag not in VOID and not m[0].endswith("/>"):
            number += 1
            inner = element(tag, (m[3] if m[2] else m[6]) or "", stack[-1], number)
            if inner.article and not stack[-1].article:
                articles.append(tuple(k for k in inner.wraps if k != number))
            stack.append(inner)
    if at < len(source):
        add(source[at:])
    flush()
    stay = layout(n_chars, articles, total)
    page.kinds = [NO_TEXT if any(k not in stay for k in w) else kind for kind, w in zip(page.kinds, around, strict=True)]
    return page


def columns_of(x: list[str], y: list[str], every: bool) -> list[int]:
    """The matrix of the longest common subsequence as whole numbers, one column for each line of `y` (or the last alone); a bit is 0 where the length grows."""
    where: dict[str, int] = {}
    for i, line in enumerate(x):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(x)) - 1
    column, columns = full, []
    for line in y:
        hit = column & where.get(line, 0)
        column = ((column + hit) | (column - hit)) & full
        if every:
            columns.append(column)
    return columns if every else [column]


def lengths_of(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of `y` and each beginning of `x`."""
    column = columns_of(x, y, False)[0]
    bits = np.unpackbits(np.frombuffer(column.to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(x)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(x: list[str], y: list[str], most_bits: int) -> list[int]:
    """Places in `x` of one longest common subsequence of `x` and `y`. Beyond `most_bits` the longer task is halved, so memory stays bounded."""
    found: list[int] = []
    tasks = [(0, x, y)]
    while tasks:
        low, a, b = tasks.pop()
        if not a or not b:
            continue
        if len(a) * len(b) > most_bits and len(b) > 1:
            half = len(b) // 2
            cut = int((lengths_of(a, b[:half]) + lengths_of(a[::-1], b[half:][::-1])[::-1]).argmax())
            tasks += [(low, a[:cut], b[:half]), (low + cut, a[cut:], b[half:])]
            continue
        columns = columns_of(a, b, True)
        i, j = len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            if columns[j] >> i & 1:
                i -= 1
            elif j and not columns[j - 1] >> i & 1:
                j -= 1
            else:
                found.append(low + i)
                i, j = i - 1, j - 1
    return found


def common_lines(a: list[str], b: list[str], most_bits: int = 1 << 26) -> list[int]:
    """Places in `a` of one longest common subsequence of `a` and `b`; lines alike at both ends need no search."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner = aligned(a[low : len(a) - high], b[low : len(b) - high], most_bits)
    return sorted([*range(low), *range(len(a) - high, len(a)), *(low + i for i in inner)])


def sentences(page: Page) -> list[str]:
    """Lines that may be content and are long enough to tell articles apart; all that may be content if none is."""
    own = [x for x, k in zip(page.lines, page.kinds, strict=True) if k != NO_TEXT]
    return [x for x in own if x.count(" ") >= SENTENCE - 1] or own


def is_copy(a: Page, b: Page) -> bool:
    """Whether most of the text in the sentences of `a` stands in `b` too."""
    own, there = sentences(a), {x for x, k in zip(b.lines, b.kinds, strict=True) if k != NO_TEXT}
    return 2 * sum(len(x) for x in own if x in there) > sum(map(len, own))


def sides(pages: list[Page], hosts: list[str]) -> tuple[list[int | None], list[int | None]]:
    """For each of the pages in order the places of the nearest pages of its host before and after it that are no copies of it."""

    def walk(order: range) -> list[int | None]:
        # Copies stand in runs: what a page passes over, the next copy passes over at once.
        out: list[int | None] = [None] * len(pages)
        before = None
        for i in order:
            k = before
            while k is not None and hosts[k] == hosts[i] and is_copy(pages[i], pages[k]):
                k = out[k]
            out[i] = k if k is not None and hosts[k] == hosts[i] else None
            before = i
        return out

    return walk(range(len(pages))), walk(range(len(pages) - 1, -1, -1))


def partner_of(i: int, low: list[int | None], high: list[int | None], paths: list[str]) -> int | None:
    """Of the nearest pages on either side the one whose path has more in common, the one before among equals.

    Their distance does not count, as a block lacks copies that stand between.
    """
    some = [k for k in (low[i], high[i]) if k is not None]
    return min(some, key=lambda k: (-nearness(paths[i], paths[k]), k)) if some else None


def witnesses(i: int, partner: int, pages: list[Page], low: list[int | None], high: list[int | None]) -> list[Page]:
    """The nearest two pages, of three on either side, that are copies neither of page `i`, nor of its partner, nor of each other."""
    found, before, after = [pages[partner]], i, i
    for _ in range(3):
        before, after = (None if k is None else side[k] for k, side in ((before, low), (after, high)))
        for k in (before, after):
            if len(found) <= WITNESSES and k is not None and k not in (i, partner) and not is_copy(pages[i], pages[k]) and not any(is_copy(pages[k], p) or is_copy(p, pages[k]) for p in found):
                found.append(pages[k])
    return found[1:]


def deleted(page: Page, partner: Page, others: Callable[[], list[Page]]) -> set[int]:
    """Places of the lines that the alignment deletes."""
    shared = set(common_lines(page.lines, partner.lines))
    article = [i for i, k in enumerate(page.kinds) if k >= CONTENT]
    inside = shared.intersection(article)
    if inside:
        told = [set(common_lines(page.lines, p.lines)) for p in others()]
        common = {i for i in inside if sum(i in t for t in told) >= WITNESSES}
        edge: set[int] = set()
        for order in (article, article[::-1]):
            for i in order:
                if i not in common:
                    break
                edge.add(i)
        shared -= inside - edge
    return shared


def main_text(page: Page, partner: Page | None, others: Callable[[], list[Page]] = list) -> tuple[str, int, int, int]:
    """Text, and how many lines the alignment deletes, how many of these inside articles, and how many of the rest markup does."""
    gone = deleted(page, partner, others) if partner else set()
    rest = [(x, k) for i, (x, k) in enumerate(zip(page.lines, page.kinds, strict=True)) if i not in gone]
    inside, outside = (sum(len(x) for x, k in rest if (k >= CONTENT) == own and k != NO_TEXT) for own in (True, False))
    wanted = (CONTENT, TEASER) if inside > outside else (OTHER, CONTENT)
    kept = [x for x, k in rest if k in wanted]
    return " ".join(kept), len(gone), sum(page.kinds[i] >= CONTENT for i in gone), len(rest) - len(kept)


def url_key(url: str | None) -> tuple[str, str]:
    m = SPLIT_URL.match(url or "")
    return (m[1].lower(), m[2] + (m[3] or "")) if m else ("", url or "")


def nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def sort_key(url: str | None, page_id: int | None) -> tuple[str, str, str, int]:
    return (*url_key(url), url or "", -(2**63) if page_id is None else page_id)


def block_rows(pages: DataFrame, block_bytes: int, sample_per_block: int, most_sampled: int = 1 << 20) -> tuple[int, list[tuple], dict[tuple, list[int]]]:
    """The number of blocks, where they begin, from a bounded sample of URLs, and the pages near their rims with the blocks that they are also read in."""
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    urls = pages.select("page_id", "url")
    seen = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(source)), F.lit(0))).first()
    blocks = max(math.ceil(seen[1] / block_bytes), 1)
    sample = min(blocks * sample_per_block, max(most_sampled, 2 * blocks))
    got = sorted(sort_key(r["url"], r["page_id"]) for r in hashed_sample(urls, sample, "url", "page_id").collect()) if blocks > 1 else []
    starts = sorted({got[len(got) * k // blocks] for k in range(1, blocks)}) if got else []
    if not starts:
        return 1, [], {}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, links, sources = (c.to_pylist() for c in part.columns)
                keys = [sort_key(u, p) for p, u in zip(ids, links, strict=True)]
                digests = [xxhash.xxh64_intdigest("\n".join(sorted(sentences(parse(h))))) - (1 << 63) for h in sources]
                columns = [pa.array([bisect.bisect_right(starts, k) for k in keys], pa.int32()), *(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([k[3] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[:2], pa.array(digests, pa.int64())], names=["block", "host", "path", "link", "number", "page_id", "url", "digest"])

    kind = pages.select("page_id", "url").schema
    schema = f"block int, host string, path string, link string, number long, page_id {kind['page_id'].dataType.simpleString()}, url string, digest long"
    placed = bounded_batches(pages.select("page_id", "url", source.alias("html"))).mapInArrow(place, schema).select("block", "digest", F.struct("host", "path", "link", "number", "page_id", "url").alias("page"))
    # The first and the last pages with the same sentences, and of these the outermost.
    ends = written(placed.groupBy("block", "digest").agg(F.min("page").alias("first"), F.max("page").alias("last")), "page-ends")
    window = Window.partitionBy("block")
    first = ends.withColumn("rank", F.row_number().over(window.orderBy("first"))).where(F.col("rank") <= NEIGHBOURS).collect()
    last = ends.withColumn("rank", F.row_number().over(window.orderBy(F.desc("last")))).where(F.col("rank") <= NEIGHBOURS).collect()
    forget(ends)
    also: dict[tuple, set[int]] = {}
    for side, rows, step in (("first", first, 1), ("last", last, -1)):
        of: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            of.setdefault(r["block"], []).append((r["digest"], (r[side]["page_id"], r[side]["url"])))
        for block in range(len(starts) + 1):
            told: set[int] = set()
            beyond = block + step
            while 0 <= beyond <= len(starts) and len(told) < NEIGHBOURS:
                for digest, page in of.get(beyond, ()):
                    if digest not in told and len(told) < NEIGHBOURS:
                        told.add(digest)
                        also.setdefault(page, set()).add(block)
                beyond += step
    return len(starts) + 1, starts, {page: sorted(blocks) for page, blocks in also.items()}


def main_texts(pages: DataFrame, block_bytes: int = 8 << 20, sample_per_block: int = 50) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared, n_inside, n_dropped and paired, a row for each row of `pages`.

    n_shared lines are deleted by the alignment, n_inside of them inside articles, n_dropped of the rest by markup;
    `paired` is whether the page had a partner. A null or empty html has an empty text. Pages without a host in their URL, or without any URL, form
    a host of their own. Pages whose URL repeats stand beside each other in order of page_id. A page without a
    neighbour on its host, or with nothing but copies in its block and among the pages near it, has no partner and
    keeps what markup leaves. Broken markup is read as far as it goes. Blocks hold about `block_bytes` of html; the
    driver holds their limits, `sample_per_block` URLs a block and a million in all, and those of 16 pages a block.
    """
    spark = pages.sparkSession
    blocks, starts, also = block_rows(pages, block_bytes, sample_per_block)
    shared = spark.sparkContext.broadcast((starts, also))
    id_type = pages.schema["page_id"].dataType.simpleString()
    columns = f"block int, rim boolean, host string, path string, link string, number long, page_id {id_type}, url string, lines array<string>, kinds binary"
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, rims = shared.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for page_id, url, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    key, page = sort_key(url, page_id), parse(source or "")
                    block = bisect.bisect_right(begins, key)
                    for to in (block, *(b for b in rims.get((page_id, url), ()) if b != block)):
                        rows.append((to, to != block, *key, page_id, url, page.lines, bytes(page.kinds)))
                kinds = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), part.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    lines = bounded_batches(pages).select("page_id", "url", F.col("html").cast("string")).mapInArrow(cut, columns)
    dealt = lines.repartitionById(blocks, F.col("block")).sortWithinPartitions("host", "path", "link", "number", "rim")
    out_names = ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_inside", "n_dropped", "paired"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], []
        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("page_id").type
            for part in slices(batch):
                for rim, host, path, page_id, url, page_lines, kinds in zip(*(part.column(c).to_pylist() for c in ("rim", "host", "path", "page_id", "url", "lines", "kinds")), strict=True):
                    held.append((rim, host, path, page_id, url))
                    found.append(Page(page_lines or [], list(kinds or b"")))
        hosts, paths = [h[1] for h in held], [h[2] for h in held]
        low, high = sides(found, hosts)
        own = [i for i, h in enumerate(held) if not h[0]]
        for at in range(0, len(own), 256):
            rows = []
            for i in own[at : at + 256]:
                k = partner_of(i, low, high, paths)
                text, *counts = main_text(found[i], None if k is None else found[k], lambda i=i, k=k: witnesses(i, k, found, low, high))
                rows.append((held[i][3], held[i][4], text, len(text), len(found[i].lines), *counts, k is not None))
            kinds = (id_arrow, pa.string(), pa.string(), *[pa.int64()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=out_names)

    return dealt.mapInArrow(pair, f"page_id {id_type}, url string, text string, n_chars long, n_lines long, n_shared long, n_inside long, n_dropped long, paired boolean")
