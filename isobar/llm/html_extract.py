"""Main text of web pages by site template removal.

Every element subtree of a page is hashed, and the hashes are counted per host in Spark; subtrees that recur across
many pages of their host are its template and are deleted. There are two hashes:

* The shape of a subtree (names, classes, ids and roles, with its texts masked and like neighbours folded) counts outside
  what the page marks as its article, and for blocks of nothing but links. So a menu, an advert slot or a footer is found though
  its words change from page to page.
* The content of a subtree (shape and texts) counts inside the article, and everywhere on pages that mark none. Running text of
  a marked article (paragraphs, headings, lists ... that name no class, id or role) is what unlike articles may quote alike; it is template only if
  it stands on half of all pages of the host.

What no template decides (hosts of few pages, rare blocks) falls to what elements say of themselves (menus, notices, adverts,
forms, comments ...), and where a page marks its article, only that is text.

Copies of an article share its paragraphs without being a template. So a page is told by min-hashes of the three-word
runs of its text outside the subtree: copies mostly share them, pages of a template do not.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, mix, signed, sliced, small
from isobar.llm.url_filter import host_and_path

#: A subtree is template on a host if at least PAGES unlike pages hold it, however many pages the host has.
PAGES = 4
#: Min-hashes of a subtree's surroundings; those of template differ on at least UNLIKE of the pages (by the seed that tells most apart).
SEEDS, UNLIKE = np.arange(1, 5, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), 0.5
#: Running text of marked articles is template from this share of the host's pages on.
SHARE = 0.5
#: Bytes of templates that may be broadcast.
BROADCAST_BYTES = 32_000_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold text, and those that say what they are.
SILENT = set("script style noscript template iframe svg math select option textarea input object embed canvas audio video applet map head title datalist".split())
DROP = SILENT | set("nav header footer aside form button dialog menu fieldset".split())
CLOSES = {  # an opening tag ends these open elements first
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Parts of running text, a list or a table, which are no template without it.
PIECES = INLINE | VOID | set("td th tr li dt dd".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | set("p blockquote pre ul ol dl table figure".split())
# Words of class, id and role that mark what is not article text.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead header footer foot copyright share sharing social related recommended recommendations trending comment comments commentlist disqus reply replies respond discussion pagination pager search hidden skip tags".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|$)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))|([^\s=/"']+)""")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Page:
    """A parsed page as lists in page order: of each element or text its name (None: a text), attributes or text, parent and the place after its last part."""

    def __init__(self):
        self.name: list[str | None] = ["#root"]
        self.value: list[str] = [""]
        self.up, self.end = [0], [1]
        self._marks: dict[int, set[str]] = {}

    def add(self, name: str | None, value: str, up: int) -> int:
        self.name.append(name)
        self.value.append(value)
        self.up.append(up)
        self.end.append(len(self.name))
        return len(self.name) - 1

    def marks(self, i: int) -> set[str]:
        """The words of an element's class, id and role, or its hiding, that say it is not article text."""
        if i not in self._marks:
            self._marks[i] = marks(self.name[i], self.value[i])
        return self._marks[i]


def parse(text: str) -> Page:
    """A tolerant parse without recursion: unknown closing tags are skipped, open elements end with their parents, and what an unclosed comment opens is a comment to the end."""
    page = Page()
    stack, walls = [0], [0]  # open elements, and for each the place in the stack of the nearest that is not inline
    held: Counter[str] = Counter()

    def close(at: int) -> None:
        for i in stack[at:]:
            page.end[i] = len(page.name)
            held[page.name[i]] -= 1
        del stack[at:], walls[at:]

    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        at = m.end()
        name = m[2]
        if name is None:
            if text[m.start()] != "<" or m.end() - m.start() == 1:
                page.add(None, m[0], stack[-1])
            continue
        name = name.lower()
        if m[1]:
            if held[name]:
                i = len(stack) - 1
                while page.name[stack[i]] != name:
                    i -= 1
                close(i)
            continue
        ends = CLOSES.get(name) or ({"p"} if name in ENDS_P else ())
        if any(held[e] for e in ends):
            i = walls[-1]
            while i > 0 and page.name[stack[i]] not in ends and page.name[stack[i]] in ("p", "tbody", "thead"):
                i = walls[i - 1]
            if page.name[stack[i]] in ends:
                close(i)
        value = m[3] or ""
        own = page.add(name, value, stack[-1])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(text, at)
            page.add(None, text[at : end.start() if end else n], own)
            page.end[own] = len(page.name)
            at = end.end() if end else n
        elif name not in VOID and (name in ("svg", "math") or not value.rstrip().endswith("/")):
            held[name] += 1
            walls.append(walls[-1] if name in INLINE else len(stack))
            stack.append(own)
    close(0)
    return page


def marks(name: str, attrs: str) -> set[str]:
    if not attrs.strip() or name in ("html", "body", "main"):
        return set()
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attrs):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("hidden")
        elif key in ("class", "id", "role"):
            found |= {w.lower() for w in NAME_PARTS.findall(value)} & MARKS
    return found


def main_elements(page: Page) -> list[int]:
    """The outermost article elements (else main elements) outside what is dropped; none if the page marks no article."""
    for name in ("article", "main"):
        found, i = [], 1
        while i < len(page.name):
            own = page.name[i]
            if own is not None and (own == name or name == "main" and re.search(r"""role\s*=\s*["']?main\b""", page.value[i])) and not marked_comment(page.value[i]):
                found.append(i)
                i = page.end[i]
            else:
                i = page.end[i] if own in DROP else i + 1
        if found:
            return found
    return []


def marked_comment(attrs: str) -> bool:
    return bool(re.search(r"\b(?:comment|reply|related|teaser|promo|ad)", attrs, re.I))


def told(attrs: str) -> str:
    return " ".join(sorted(f"{m[1]}={m[2] or m[3] or m[4]}" for m in ATTRIBUTE.finditer(attrs) if m[1] and m[1].lower() in ("class", "id", "role"))) if attrs else ""


def digests(page: Page, mains: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """Hashes of the shapes and of the contents of subtrees, where each of the two counts; what holds an article has neither."""
    n = len(page.name)
    within = bytearray(n)
    holds = {0}
    for m in mains:
        within[m + 1 : page.end[m]] = b"\1" * (page.end[m] - m - 1)
        while m not in holds:
            holds.add(m)
            m = page.up[m]
    words, linked = word_counts(page)
    shape: dict[int, int] = {}
    content: dict[int, int] = {}
    for out, counts in ((shape, lambda i: not within[i]), (content, lambda i: within[i] or not mains)):
        parts: dict[int, list[str]] = {}
        for i in range(n - 1, 0, -1):  # parts come before what they are in
            if not counts(i) or i in holds:
                continue
            name = page.name[i]
            if name is None:
                piece = " ".join(page.value[i].split())
                if not piece:
                    continue
                if out is shape:
                    piece = "#"
            else:
                own, said = parts.pop(i, [])[::-1], told(page.value[i])
                if out is shape:
                    own, said = [k for k, _ in groupby(own)], re.sub(r"\d+", "0", said)
                out[i] = signed(xxhash.xxh64_intdigest("\x1f".join([name, said, *own]), seed=int(out is shape)))
                piece = str(out[i])
            parts.setdefault(page.up[i], []).append(piece)
    text = lambda i: words[page.end[i]] > words[i]
    content = {i: h for i, h in content.items() if page.name[i] not in PIECES and text(i) and not (mains and page.name[i] in DROP)}
    if mains:
        shape = {i: h for i, h in shape.items() if page.name[i] not in SILENT and text(i)}
    else:
        links = lambda i: words[page.end[i]] - words[i] == linked[page.end[i]] - linked[i]
        shape = {i: h for i, h in shape.items() if page.name[i] not in PIECES and page.name[i] not in SILENT and text(i) and links(i)}
    return shape, content


def word_counts(page: Page) -> tuple[list[int], list[int]]:
    """Before each place, the words of texts, and those of them in links."""
    words, linked, until, silent = [0], [0], 0, 0
    for i, name in enumerate(page.name):
        if name == "a":
            until = max(until, page.end[i])
        elif name in SILENT:
            silent = max(silent, page.end[i])
        n = len(page.value[i].split()) if name is None and i >= silent else 0
        words.append(words[-1] + n)
        linked.append(linked[-1] + (n if i < until else 0))
    return words, linked


def text_of(page: Page, roots: list[int], gone: set[int], inside: bool, hints: bool = True) -> str:
    """The blocks of elements in page order, white space turned into one space, joined by line ends."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        got = " ".join(html.unescape("".join(line)).split())
        if got:
            blocks.append(got)
        line.clear()

    for root in roots:
        flush()
        i, open_ = root + 1, [(page.end[root], False, False)]  # where an element ends, is it a block, and do only its headings count
        while i <= page.end[root]:
            while open_ and open_[-1][0] <= i:
                if open_.pop()[1]:
                    flush()
            if not open_:
                break
            name, headings = page.name[i], open_[-1][2]
            if name is None:
                if not headings:
                    line.append(page.value[i])
                i += 1
                continue
            if i in gone:
                flush()
                i = page.end[i]
                continue
            said = page.marks(i) if hints else set()
            if name in (DROP if hints else SILENT) or said:
                flush()
                if inside and (name == "header" or name not in DROP and said == {"header"}):  # an article's own heading stays
                    open_.append((page.end[i], True, True))
                    i += 1
                else:
                    i = page.end[i]
                continue
            if name in ("br", "hr", "wbr"):
                line.append("" if name == "wbr" else " ")
                if name == "hr":
                    flush()
            block = name not in INLINE and name not in VOID
            if block:
                flush()
            open_.append((page.end[i], block, headings and name not in HEADINGS))
            i += 1
    flush()
    return "\n".join(blocks)


def extract(text: str | None, template: set[int], hints: bool = True) -> str:
    """The text of a page without the subtrees of `template`, and (hints) without what elements say is no article text."""
    if not text:
        return ""
    page = parse(text)
    mains = main_elements(page)
    gone = {i for own in digests(page, mains) for i, h in own.items() if h in template} if template else set()
    return text_of(page, mains, gone, True) if mains and hints else text_of(page, [0], gone, False, hints)


def spans(page: Page, roots: list[int]) -> tuple[list[str], list[int]]:
    """The words that may be text, in page order, and how many of them come before each place."""
    words: list[str] = []
    before = [0] * (len(page.name) + 1)
    at = 0
    for root in roots:
        for i in range(at, root + 1):
            before[i] = len(words)
        i = root + 1
        while i < page.end[root]:
            before[i] = len(words)
            if page.name[i] is None:
                words.extend(page.value[i].split())
            elif page.name[i] in DROP or page.marks(i):
                before[i : page.end[i]] = [len(words)] * (page.end[i] - i)
                i = page.end[i] - 1
            i += 1
        at = page.end[root]
    before[at:] = [len(words)] * (len(before) - at)
    return words, before


def surroundings(words: list[str], ranges: list[tuple[int, int]]) -> np.ndarray:
    """For each range of words, min-hashes of the runs of three words before and after it (of all the rest, if it is too short)."""
    n = max(0, len(words) - 2)
    run = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(n)], dtype=np.uint64)
    hashed = mix(run[None, :] ^ SEEDS)
    most = np.full((len(SEEDS), 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    before = np.concatenate([most, np.minimum.accumulate(hashed, axis=1)], axis=1)  # of the first i runs
    after = np.concatenate([np.minimum.accumulate(hashed[:, ::-1], axis=1)[:, ::-1], most], axis=1)  # of the runs from i
    out = np.empty((len(ranges), len(SEEDS)), dtype=np.uint64)
    for row, (a, b) in enumerate(ranges):
        if a < 3 and b > len(words) - 3:
            out[row] = xxhash.xxh64_intdigest("\x1f".join([*words[:a], "", *words[b:]]))
        else:
            out[row] = np.minimum(before[:, max(0, a - 2)], after[:, min(b, n)])
    return out.view(np.int64)


def subtrees(text: str) -> Iterator[tuple[int, bool, bool, np.ndarray | None]]:
    """A page's hashes: (hash, is it of a shape, is it of an article's running text, min-hashes of the surroundings of a content), each once, a content by its first place."""
    page = parse(text)
    mains = main_elements(page)
    shape, content = digests(page, mains)
    for h in set(shape.values()):
        yield h, True, False, None
    first = {h: i for i, h in sorted(content.items(), reverse=True)}
    if first:
        words, before = spans(page, mains or [0])
        seen = surroundings(words, [(before[i], before[page.end[i]]) for i in first.values()])
        for (h, i), m in zip(first.items(), seen, strict=True):
            yield h, False, bool(mains) and page.name[i] in RUNNING and not told(page.value[i]), m


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        hosts, hashes, shapes, running, seen = [], [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for h, is_shape, runs, m in subtrees(page) if page else ():
                hosts.append(host)
                hashes.append(h)
                shapes.append(is_shape)
                running.append(runs)
                seen.append(np.zeros(len(SEEDS), dtype=np.int64) if is_shape else m)
        cols = np.array(seen, dtype=np.int64).reshape(-1, len(SEEDS)).T
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(shapes, pa.bool_()), pa.array(running, pa.bool_()), *map(pa.array, cols)], names=["host", "subtree", "shape", "running", *(f"m{i}" for i in range(len(SEEDS)))])


def _extract(hints: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held: dict[str | None, set[int]] = {}
            out = []
            for host, page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host not in held:
                    held[host] = set(template.as_py() or ())
                out.append(extract(page, held[host], hints))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return f


def site_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (host, subtree, held) of pages (host, html): the hashes that are template on a host, with the number of its pages that hold them."""
    seeds = [f"m{i}" for i in range(len(SEEDS))]
    each = pages.select("host", "html").mapInArrow(_subtrees, ", ".join(["host string", "subtree long", "shape boolean", "running boolean", *(f"{m} long" for m in seeds)]))
    each = scratch.keep(each, "subtrees")
    often = each.groupBy("host", "subtree", "shape").agg(F.count("*").alias("held"), F.max("running").alias("running")).where(F.col("held") >= PAGES)
    of_host = pages.groupBy("host").agg(F.count("*").alias("pages"))
    often = often.join(of_host, "host").where(~F.col("running") | (F.col("held") >= F.lit(SHARE) * F.col("pages"))).drop("pages", "running")
    often = scratch.keep(often, "often")
    # Copies have like surroundings; only contents that recur are told apart by them.
    again = each.where("not shape").join(small(often.where("not shape")).drop("shape"), ["host", "subtree"])
    counted = again.groupBy("host", "subtree").agg(F.first("held").alias("held"), *(F.count_distinct(m).alias(m) for m in seeds)).withColumn("unlike", F.greatest(*seeds))
    contents = counted.where((F.col("unlike") >= PAGES) & (F.col("unlike") >= F.lit(UNLIKE) * F.col("held")))
    found = scratch.keep(contents.select("host", "subtree", "held").unionByName(often.where("shape").select("host", "subtree", "held")), "templates")
    scratch.drop(each)
    scratch.drop(often)
    return found


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """Returns for each row: page_id, url, text (empty if none) and n_chars (its code points).

    Blocks are in page order, joined by one line end; white space inside a block is one space (a line break
    too); character references are decoded. A null or empty page has an empty text; a page is parsed however deep it
    nests. Pages without a host share one. Repeated rows count as pages of their own; other columns are not read; an
    empty table gives an empty table. Subtrees are told apart by 64-bit hashes. A content most of whose pages are copies is
    no template. Without `hints` the templates alone decide, and the text is the rest of the whole page.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    templates = scratch.keep(site_templates(rows, scratch).groupBy("host").agg(F.collect_list("subtree").alias("template")), "by_host")
    size = templates.agg(F.sum(F.size("template") * 8 + F.length("host") + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")
    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(_extract(hints), "page_id long, url string, text string, n_chars long")
