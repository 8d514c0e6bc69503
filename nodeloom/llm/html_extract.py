"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Parts that are never the article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, comments of readers) are known by their tags, roles and the words of class and id.
Pass one classes each remaining block by length, link density and stop-word density as good, bad or short. Pass two
lets short, undecided blocks inherit: where the nearest decided neighbours agree, their label, else that of the nearer
one, a tie going to good. Article and main elements are a prior and no more: what is undecided there is bad only
between two bad blocks inside as well. Blocks outside them are classed like those of pages without such elements.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import FUNCTION_WORDS

#: Tags that begin and end blocks, in the order of the HTML standard's list.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no part of an article, and those whose content is not text at all.
OUTSIDE_TAGS = frozenset("aside button dialog fieldset footer form head label menu nav noscript object option select".split())
RAW_TAGS = frozenset("applet canvas iframe math noframes script style svg template textarea title video audio".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name what is not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads adslot adsense advert advertisement adverts alert author-box banner breadcrumb breadcrumbs byline-social comment comments "
    "commentlist consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget".split()
)
#: Tags whose start ends open elements of the first set, down to the nearest open one of the second.
_CELLS, _ROWS, _GROUPS = {"td", "th"}, {"tr", "td", "th"}, {"tbody", "thead", "tfoot"}
ENDS = {
    **dict.fromkeys(("td", "th"), (_CELLS, {"table", "tr"})),
    "tr": (_ROWS, {"table", *_GROUPS}),
    **dict.fromkeys(sorted(_GROUPS), (_ROWS | _GROUPS, {"table"})),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl", "table", "td", "th"})),
}
KEPT_TAGS = frozenset("article body html main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD_STOP, SOME_STOP, LINKS, SHORT, LONG = 0.30, 0.10, 0.50, 70, 200

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>\"']*)")
#: A whole tag without angle brackets inside; it never looks further than the next one, nor back.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[\s_]+|-+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("parts", "linked", "inside", "heading", "text")

    def __init__(self, inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.inside, self.heading, self.text = inside, heading, ""


def _outside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is known not to be the article."""
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in KEPT_TAGS:
            if tag == "header" or not value:
                continue
            words = [w.lower() for w in _SPLIT.split(value) if w]
            if OUTSIDE_WORDS.intersection(words):
                return True
    return False


class Tags:
    """The markup of a page in one pass over it, whatever it holds: no part is read again because a tag or quote is left open."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`: past the first > outside quotes, or -1.

        A quote that nothing closes is a plain character. Once all that is left of a page would lie inside a tag, quotes
        no longer count and tags end at the first >.
        """
        k = at
        while self.quotes:
            found = _MARK.search(self.page, k)
            if found is None:
                self.quotes = False
                break
            mark, k = found[0], found.end()
            if mark == ">":
                return k
            if self.last[mark] >= k:
                k = self.page.index(mark, k) + 1
        return self.page.find(">", at) + 1 or -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, closing, name and attributes of the next markup from `at` on; the name is empty for comments and the like."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= len(page):
                return None
            plain = _PLAIN.match(page, start)
            if plain:
                return start, plain.end(), plain[1] != "", plain[2].lower(), plain[3]
            if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
                close = "-->" if page[start + 2] == "-" else "]]>"
                end = page.find(close, start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if self.last[">"] < start:
                return None
            if page[start + 1] in "!?":
                return start, page.index(">", start) + 1, False, "", ""
            named = _NAME.match(page, start + 1)
            end = self._end(named.end()) if named else -1
            if end < 0:
                at = start + 1
                continue
            return start, end, bool(named[1]), named[2].lower(), page[named.end() : end - 1]


def blocks(page: str) -> list[Block]:
    """The blocks of a page that are not known to be outside the article, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, outside, inside an article, inside a heading
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    anchors, at, length, current = 0, 0, len(page), None
    tags = Tags(page)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def text(raw: str) -> None:
        nonlocal current
        if stack and stack[-1][1] or not raw:
            return
        if current is None:
            _, _, inside, heading = stack[-1] if stack else ("", False, False, False)
            current = Block(inside, heading)
            out.append(current)
        decoded = html.unescape(raw)
        current.parts.append(decoded)
        if anchors:
            current.linked += len(decoded.strip())

    while at < length:
        found = tags.next(at)
        if found is None:
            text(page[at:])
            break
        start, end, closing, tag, attributes = found
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if not closing and tag in RAW_TAGS and not attributes.rstrip().endswith("/"):
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = over.end() if over else length
            if tag in BLOCK_TAGS:
                current = None
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                text(" ")
            continue
        if tag in BLOCK_TAGS:
            current = None
        if tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        if closing:
            if places.get(tag):
                close(places[tag][-1])
        elif tag not in VOID_TAGS and not attributes.rstrip().endswith("/"):
            if tag in ("p", "li", "option"):  # their end tags may be left out
                if stack and stack[-1][0] == tag:
                    close(len(stack) - 1)
            elif tag in ENDS:
                ended, bounds = ENDS[tag]
                bound = max((places[t][-1] for t in bounds if places.get(t)), default=-1)
                found_at = [places[t][bisect_right(places[t], bound)] for t in ended if places.get(t) and places[t][-1] > bound]
                if found_at:
                    close(min(found_at))
            above = stack[-1] if stack else ("", False, False, False)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, above[1] or _outside(tag, attributes, above[2]), above[2] or tag in ("article", "main"), above[3] or tag in HEADINGS))
    kept = []
    for block in out:
        block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
        if block.text:
            kept.append(block)
    return kept


def _first(block: Block) -> str:
    """Pass one: good, bad or short. Inside an article or main element what the densities leave open is short, not bad."""
    size = len(block.text)
    links = block.linked / size
    words = _WORD.findall(block.text.lower())
    stop = sum(w in FUNCTION_WORDS for w in words) / max(1, len(words))
    if links > LINKS:
        return "short" if block.inside and size >= SHORT and stop >= SOME_STOP else "bad"
    if size < SHORT or block.heading:
        return "short"
    if stop >= GOOD_STOP:
        return "good"
    if stop >= SOME_STOP:
        return "good" if size >= LONG or block.inside else "short"
    if block.inside:
        return "short"
    return "bad" if links > 0.2 or size < LONG else "short"


def labelled(page: str | None) -> list[tuple[Block, str, str]]:
    """The blocks of a page with the class that pass one gives (good, bad, short) and that they end with (good, bad)."""
    found = blocks(page or "")
    labels = [_first(b) for b in found]
    decided = [k for k, x in enumerate(labels) if x != "short"]
    final = list(labels)
    if not decided:
        final = ["good"] * len(labels)
    else:
        before, place = None, 0
        for k, label in enumerate(labels):
            while place < len(decided) and decided[place] < k:
                before = decided[place]
                place += 1
            if label != "short":
                continue
            after = decided[place] if place < len(decided) else None
            if found[k].inside:  # the prior: bad only between bad ones of its own element
                among = before is not None and after is not None and found[before].inside and found[after].inside
                final[k] = "bad" if among and labels[before] == labels[after] == "bad" else "good"
            elif found[k].heading and after is not None:  # a heading goes with what follows it
                final[k] = labels[after]
            elif before is None or after is None:
                final[k] = labels[after if before is None else before]
            elif labels[before] == labels[after]:
                final[k] = labels[before]
            else:
                final[k] = labels[before] if k - before < after - k else labels[after] if after - k < k - before else "good"
    return list(zip(found, labels, final, strict=True))


def main_text(page: str | None) -> str:
    """The main text of a page, a line a block; empty if there is none."""
    return "\n".join(b.text for b, _, x in labelled(page) if x == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of text).

    Null and empty html give an empty text. Rows are independent: repeated rows repeat, null ids and urls stay, an
    empty table gives no rows; other columns are not read. A page without markup is its text.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string"))
    return chosen.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
