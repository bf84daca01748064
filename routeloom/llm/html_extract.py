"""Main text of web pages, with site templates found by counting element subtrees per host.

A page is read into blocks of text. Every element that could be a site's is hashed with all that it
holds, menus and footers included. Spark counts, for each host, beside how many different texts a
hashed subtree occurs; subtrees that recur beside many, on enough of the host's pages, are the site's
and not the page's, and are deleted wherever they are. What an element says that it is (a menu, a
form, an advert) decides about the rest: parts of a page that no other page repeats.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .sieve import Filter, dealt_join
from .storage import settle
from .textbatch import bounded_batches, pick

#: Different texts of a host beside which a subtree must occur to be a template, and their least share of the host's different pages.
LEAST_PAGES = 5
LEAST_SHARE = 0.01
#: The same for single paragraphs and headings, which pages may well have in common by chance.
LEAST_LINE_SHARE = 0.1

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>""",
    re.S,
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
#: Elements whose text isn't read, and those that are never part of an article.
UNREAD = frozenset("head noscript template object canvas svg math button select option datalist audio video map applet".split()) | RAW
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset("html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption hr header footer aside nav form fieldset address details summary center hgroup search menu dialog".split())
#: Containers that may be a site's template, and single lines that may be one outside of articles.
CONTAINER = frozenset("div section ul ol dl table figure details fieldset center header address blockquote summary hgroup".split()) | OUTSIDE
LINE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre".split())
#: Elements whose start tag ends an open paragraph, and those that end an open element of their own kind.
ENDS_P = BLOCK - {"html", "body", "thead", "tbody", "tfoot", "tr", "caption"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article main section div body html aside nav form footer header".split())
#: Roles that aren't an article's.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that say that an element is not the article. A name says so if it consists of such words and of NEUTRAL ones.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs
    sidebar widget widgets footer masthead topbar comment comments disqus respond replies share sharing social related recommended recommendations
    pagination pager toolbar login search skip advertorial advertorials sponsorship disclaimer""".split()
)
#: Words that say so outside of articles only.
SITE_MARKS = frozenset(("header", "top"))
NEUTRAL = frozenset("site page global top bottom left right inner outer box block bar container wrapper wrap area section list item items links icons buttons form column col row slot unit thread reader user users legal body content text title head group panel inline mobile desktop sticky fixed small large count author meta".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Names in lower case with their values; a name without a value has an empty one."""
    return {name.lower(): a or b or c for name, a, b, c in ATTR.findall(attrs)}


def _telling(names: str, site: bool) -> bool:
    """Whether one of the white-space separated names says that its element is not the article."""
    marks = MARKS | SITE_MARKS if site else MARKS
    for name in names.split():
        parts = {x.lower() for x in NAME_PARTS.findall(name) if not x.isdigit()}
        if parts & marks and parts <= marks | NEUTRAL:
            return True
    return False


@dataclass(slots=True)
class _Element:
    """An open element; ``first`` is the number of the block that comes next when it opens."""

    name: str
    dropped: bool
    in_article: bool
    in_main: bool
    first: int
    key: str
    outside: bool = False
    in_heading: bool = False
    marked: bool = False
    holds: bool = False


@dataclass(slots=True)
class _Block:
    text: str
    rank: int
    outside: bool
    heading: bool
    digest: int
    #: (hash, whether it is a single line) of the elements around it that may be a template.
    around: list[tuple[int, bool]]


def parse(page: str) -> list[tuple[str, list[tuple[int, bool]], bool]]:
    """The blocks of a page in order, each with the hashes of what is around it and may be a template, and whether it is in the main part.

    The main part is what articles hold, if that is most of the page's text or has its heading; or
    else what main elements hold, if that is; or else all that isn't in menus, footers, forms and the
    like. Elements that name themselves as something else go, unless they hold most of the page's text
    and its heading, article or main element, or all of its text: then the name is no evidence.
    """
    blocks: list[_Block] = []
    marked: list[tuple[int, int, bool]] = []
    stack = [_Element("", False, False, False, 0, "")]
    open_names: Counter[str] = Counter()
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append(_Block(text, 2 if top.in_article else 1 if top.in_main else 0, top.outside, top.in_heading, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), []))

    def close() -> None:
        element = stack.pop()
        open_names[element.name] -= 1
        if (element.name in ("h1", "article", "main") and not element.outside) or element.holds:
            stack[-1].holds = True
        inside = blocks[element.first :]
        if element.dropped or not inside:
            return
        if element.marked:
            marked.append((element.first, len(blocks), element.holds))
        line = element.name in LINE and not (element.in_article or element.in_main)
        if line or element.name in CONTAINER:
            seed = xxhash.xxh64_intdigest(element.key.encode("utf-8", "surrogatepass"))
            own = xxhash.xxh64_intdigest(np.array([b.digest for b in inside], dtype=np.uint64).tobytes(), seed)
            for block in inside:
                block.around.append((own - (1 << 64) if own >> 63 else own, line))

    def close_to(names: tuple[str, ...], scope: frozenset[str]) -> None:
        """Close the nearest open element of these names, if no element of the scope stands between."""
        if not any(open_names[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                flush()
                while len(stack) > depth:
                    close()
                return
            if stack[depth].name in scope:
                return

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not stack[-1].dropped:
            buffer.append(page[at:stop])
        if not found:
            break
        at = found.end()
        name = found["start"] or found["odd"]
        if name:
            name = name.lower()
            if name in ENDS_P:
                close_to(("p",), SCOPE)
            if name in SIBLINGS:
                close_to(SIBLINGS[name], SCOPE)
            if name in BLOCK:
                flush()
            elif name in ("br", "td", "th", "img", "wbr") and not stack[-1].dropped:
                buffer.append(" " if name != "wbr" else "")
            if name in VOID:
                continue
            if name in RAW:
                rest = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
                at = rest.end() if rest else end
                continue
            up = stack[-1]
            element = _Element(name, up.dropped or name in UNREAD, up.in_article or name == "article", up.in_main or name == "main", len(blocks), name, up.outside or name in OUTSIDE, up.in_heading or name == "h1")
            if not element.dropped:
                attrs = found["attrs"] if found["start"] else found["rest"]
                if attrs and attrs.strip():
                    given = _attributes(attrs)
                    roles = set(given.get("role", "").lower().split())
                    element.dropped = "hidden" in given or bool(UNSEEN.search(given.get("style", "")))
                    if roles & ROLES:
                        element.outside, element.dropped = True, element.dropped or name not in BLOCK
                    element.in_main |= "main" in roles
                    names = f"{given.get('class', '')} {given.get('id', '')}".strip()
                    element.key = f"{name} {names}"
                    telling = name not in ("html", "body", "main") and _telling(names, not up.in_article and name != "article")
                    # Part of a line holds no page's text, so its name is believed at once.
                    element.marked, element.dropped = telling and name in BLOCK, element.dropped or (telling and name not in BLOCK)
                # A header is an article's own only inside of it.
                element.outside |= name == "header" and not (up.in_article or up.in_main)
            stack.append(element)
            open_names[name] += 1
        elif found["end"]:
            name = found["end"].lower()
            if name in BLOCK:
                flush()
            if open_names[name] > 0:
                flush_inline = name not in BLOCK
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        while len(stack) > depth:
                            close()
                        break
                    if flush_inline and stack[depth].name in BLOCK:
                        break
    flush()
    while len(stack) > 1:
        close()
    kept = set(range(len(blocks))) - _named(blocks, marked) - {k for k, b in enumerate(blocks) if b.outside}
    total = sum(len(blocks[k].text) for k in kept)
    for rank in (2, 1):
        inner = {k for k in kept if blocks[k].rank >= rank}
        if 2 * sum(len(blocks[k].text) for k in inner) > total or any(blocks[k].heading for k in inner):
            kept = inner
            break
    return [(b.text, b.around, k in kept) for k, b in enumerate(blocks)]


def _named(blocks: list[_Block], marked: list[tuple[int, int, bool]]) -> set[int]:
    """The blocks inside elements that name themselves as something else than the article."""
    sizes = np.concatenate(([0], np.cumsum([0 if b.outside else len(b.text) for b in blocks], dtype=np.int64)))
    gone: set[int] = set()
    for first, stop, holds in marked:
        inside = sizes[stop] - sizes[first]
        if not (inside == sizes[-1] or (holds and 2 * inside > sizes[-1])):
            gone.update(range(first, stop))
    return gone


def host_of(url):
    """The host of a URL in lower case without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_line_share: float = LEAST_LINE_SHARE) -> DataFrame:
    """Extract the main text of every page.

    Returns one row for each input row: id, url, text, n_chars. Null and empty pages, and pages
    without article text, give the empty text. Pages without a host are one host of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    rows = pick(pages, id=page_id, url=url, html=body).withColumns({"host": host_of(F.col("url")), "print": F.xxhash64("html")})
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "host", "print", "html").mapInArrow(_subtrees, f"id {kind}, host string, print long, whole long, subtrees array<struct<subtree:bigint,line:boolean,beside:bigint,main:boolean>>")
    found = settle(found, "subtrees")
    templates = recurring(found, least_pages, least_share, least_line_share)
    # A footer is on all pages of its host, and a host may have a third of all pages.
    # What is in menus and the like goes by its name already; only subtrees with a block of the main part change a page.
    held = found.select("id", "host", "print", F.inline("subtrees")).where("main").select("id", "print", F.xxhash64("host", "subtree").alias("key"), "subtree", "host")
    wanted = settle(templates.withColumnsRenamed({"host": "of_host", "subtree": "of_subtree"}).withColumn("key", F.xxhash64("of_host", "of_subtree")), "templates")
    met = dealt_join(held, wanted, "key", F.col("print")).where((F.col("host") == F.col("of_host")) & (F.col("subtree") == F.col("of_subtree")))
    gone = met.groupBy("id", "print").agg(F.collect_set("subtree").alias("gone"))
    seen = Observation()
    gone = settle(gone.observe(seen, F.count("*").alias("n")), "template-subtrees")
    # Pages without any aren't shuffled.
    flagged = Filter.of(gone, seen.get["n"], "id", "print").admits(rows, F.col("id"), F.col("print"))
    gone = gone.withColumnsRenamed({"id": "__id", "print": "__print"})
    marked = flagged.where("__maybe").join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")), "left").select("id", "url", "html", "gone")
    marked = marked.unionByName(flagged.where("NOT __maybe").select("id", "url", "html", F.lit(None).cast("array<bigint>").alias("gone")))
    texts = marked.select("id", "url", "html", "gone").mapInArrow(_texts, f"id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def recurring(found: DataFrame, least_pages: int, least_share: float, least_line_share: float) -> DataFrame:
    """(host, subtree, n) of the templates (and how many different pages have each) among the subtrees of pages (host, whole, subtrees).

    A subtree is told from others by the longest block of each page that lies outside of it. It is a
    template if there are ``least_pages`` different such blocks, as many as the least share of the
    host's different pages, and half as many as different pages that have it. So copies of an article
    make no template of its parts, even if a line, an advert or a menu differs in each: their longest
    blocks are the same ones. Pages of which a subtree is the larger part are no evidence about it.
    """
    hosts = found.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = found.select("host", "whole", F.inline("subtrees")).where("beside IS NOT NULL")
    beside = seen.select("host", "subtree", "line", "beside", "whole").distinct().groupBy("host", "subtree", "line", "beside").agg(F.count("*").alias("pages"))
    counted = beside.groupBy("host", "subtree", "line").agg(F.count("*").alias("texts"), F.sum("pages").alias("pages")).where((F.col("texts") >= least_pages) & (2 * F.col("texts") >= F.col("pages")))
    share = F.when(F.col("line"), F.lit(least_line_share)).otherwise(F.lit(least_share))
    return counted.join(hosts, "host").where(F.col("texts") >= share * F.col("host_pages")).select("host", "subtree", F.col("pages").alias("n"))


def _signed(h: int) -> int:
    h &= (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


def _evidence(blocks: list[tuple[str, list[tuple[int, bool]], bool]]) -> tuple[int, list[dict]]:
    """A hash of the main part's blocks, and for each subtree whether it has one of them and the hash of the longest one outside of it; none, if most of the main part is inside."""
    whole, inside, members, lines = 0, Counter(), {}, {}
    digests = [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) for text, _, _ in blocks]
    for k, (text, around, main) in enumerate(blocks):
        whole += digests[k] if main else 0
        for h, line in set(around):
            inside[h] += len(text) if main else 0
            members.setdefault(h, set()).add(k)
            lines[h] = line
    total = sum(len(text) for text, _, main in blocks if main)
    longest = sorted((k for k, (_, _, main) in enumerate(blocks) if main), key=lambda k: (-len(blocks[k][0]), digests[k]))
    out = []
    for h in sorted(members):
        other = next((k for k in longest if k not in members[h]), None)
        out.append({"subtree": h, "line": lines[h], "beside": None if other is None or 2 * inside[h] > total else _signed(digests[other]), "main": inside[h] > 0})
    return _signed(whole), out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every page as a hash, and its subtrees that may be templates."""
    kind = pa.list_(pa.struct([("subtree", pa.int64()), ("line", pa.bool_()), ("beside", pa.int64()), ("main", pa.bool_())]))
    for batch in batches:
        held = [_evidence(parse(x or "")) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([*(batch.column(c) for c in ("id", "host", "print")), pa.array([w for w, _ in held], pa.int64()), pa.array([x for _, x in held], kind)], names=["id", "host", "print", "whole", "subtrees"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            held = frozenset(gone or ())
            texts.append("\n".join(text for text, around, main in parse(page or "") if main and held.isdisjoint(h for h, _ in around)))
        yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])
