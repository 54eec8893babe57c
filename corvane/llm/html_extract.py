"""Main text of web pages by two passes over blocks.

A page is cut at block-level tags; text of scripts, styles, forms and the like is not text of a block.
Pass one classifies each block by its length, its share of stop words and its share of characters in
links.  Pass two gives a short or undecided block the label of its nearest decided neighbours.
What the page itself marks as no article is not classified at all: navigation, header, footer, sidebar and
form elements, and elements whose class, id or role names an advert, a notice, a comment
section and so on (whole names; never the page, its body or its main element).  Where an article or main element holds
most of the text, only blocks inside it are candidates, and boilerplate needs evidence; elsewhere main text needs
it: stop words, or where a page has hardly any of those known, length and few links.  Paragraphs of medium length count
together with those next to them.  Within an article a row of links alone is a menu, a linked heading or line is not, and
elements of doubtful names (search, meta, legal and so on) keep what reads as prose.

A header inside an article is no part of its text either.

Edge cases: a null or empty page has the text ''; very long pages are read whole, repeated rows each; a quote that is never closed
ends with its tag; unclosed and misnested tags, comments and pages
cut off anywhere are read as far as they go; repeated rows are returned each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import small_batches

#: Common short words of four languages.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to
    was we were which who will with you all than been into would there what when aber als am an auch auf aus bei bin bis da das dass
    dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so um und
    von war was wenn wie wir zu zum zur avec ce cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    pour qu que qui sa se ses son sur un une vous al como con de del el ella en es esta este ha la las lo los más me mi muy no o para pero por
    que se si sin sobre su sus también un una y ya""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre search section select
    summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose content is never text, up to their closing tag.
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "math", "xmp", "noembed")
#: Elements that a page uses for everything but its article.
OUTSIDE_TAGS = frozenset("nav header footer aside form button select dialog menu label fieldset".split())
OUTSIDE_NAMES = re.compile(
    r"(?:^|\s)(?:ad|ads|advert\w*|advertisement|adsense|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|header|footer|"
    r"sidebar\w*|side|aside|widget\w*|related\w*|recommend\w*|share|sharing|social\w*|comments?|commentlist|disqus|respond|reply|replies|"
    r"cookies?\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|search\w*|pagination|pager|"
    r"copyright|legal|disclaimer|toolbar|hidden|skip|tags?|meta|byline|toc|outbrain|taboola|"
    r"(?:site|page|main|top|global)[_-](?:nav|navigation|header|footer|menu|sidebar)|"
    r"(?:ads?|banner|nav|navbar|cookies?|consent|sidebar|share|social|comments?|related|newsletter|widget|footer|header|menu|popup|modal)"
    r"[_-](?:box|bar|area|wrapper|container|list|links?|block|section|slot|unit|banner|notice|buttons?|icons?|inner|form|items?|posts?|articles?|stories))(?:$|\s)",
    re.IGNORECASE,
)
#: Elements that no class or id shuts out, and the names of an article that is a remark on another one.
CONTENT_TAGS = frozenset("html body main article".split())
REMARK_NAMES = re.compile(r"(?:^|\s)(?:comments?|reply|replies|teaser|related|promo|ad|ads|advert|sponsored)(?:$|\s)", re.IGNORECASE)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a new tag of the given kind closes, if they are innermost.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.IGNORECASE) for t in RAW_TAGS}
SPACES = re.compile(r"\s+")

#: Names that shut an element out, but not within an article, where its blocks need evidence instead.
DOUBTFUL_NAMES = re.compile(r"(?:^|\s)(?:search\w*|meta|legal|side|login|signup|header|footer)(?:$|\s)", re.IGNORECASE)

SHORT, LONG = 70, 200
#: So many blocks of links alone in a row are a menu, also within an article.
MENU = 3
#: From here on, characters of writing without spaces, each of which says as much as three of an alphabet.
WIDE = "\u2e80"
STOP_LOW, STOP_HIGH = 0.10, 0.16
LINKS_HIGH = 0.33


def _outside(tag: str, attributes: str, remarks: bool, inside: bool = False) -> bool | None:
    """Whether an element is shut out; None within an article where only a doubtful name says so."""
    if tag in OUTSIDE_TAGS:
        return True
    doubtful = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if tag == "article" and remarks and name in ("class", "id") and REMARK_NAMES.search(value):
            return True
        if name == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in CONTENT_TAGS and OUTSIDE_NAMES.search(value):
            if not inside or OUTSIDE_NAMES.search(DOUBTFUL_NAMES.sub(" ", value)):
                return True
            doubtful = True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return None if doubtful else False


class Block:
    __slots__ = ("text", "links", "inside", "heading", "doubtful", "label")

    def __init__(self, text: str, links: int, inside: bool, heading: bool, doubtful: bool = False) -> None:
        self.text, self.links, self.inside, self.heading, self.doubtful, self.label = text, links, inside, heading, doubtful, ""

    @property
    def size(self) -> int:
        """The text's length, in which a character of writing without spaces counts three."""
        return len(self.text) + (0 if self.text.isascii() else 2 * sum(c >= WIDE for c in self.text))


def blocks_of(page: str, remarks: bool = True) -> tuple[list[Block], bool]:
    """The text blocks outside excluded elements, and whether an article or main element holds most of their text.

    ``remarks``: articles named as remarks are excluded too.
    """
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, whether it excludes, whether it is doubtful
    opened: dict[str, int] = {}  # open elements by tag, so that a closing tag without one costs nothing
    shut = articles = links = headings = doubts = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACES.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, min(linked, len(text)), articles > 0, headings > 0, doubts > 0))
        parts, linked = [], 0

    def close(upto: int) -> None:
        nonlocal shut, articles, links, headings, doubts
        while len(stack) > upto:
            tag, excludes, doubtful = stack.pop()
            opened[tag] -= 1
            shut -= excludes
            doubts -= doubtful
            articles -= tag in ("article", "main")
            links -= tag == "a"
            headings -= tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if not m and (cut := re.search(r"<[a-zA-Z/!][^<>]*$", page[at:])):
            end = at + cut.start()  # a page that ends inside a tag
        if end > at and not shut:
            parts.append(page[at:end])
            linked += (end - at) if links else 0
        if not m:
            break
        at = m.end()
        # the second form is a tag with a quote that nothing closes: it ends at the next bracket
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW_END:
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID_TAGS:
            continue
        while stack and stack[-1][0] in CLOSED_BY.get(tag, ()):
            close(len(stack) - 1)
        excludes = _outside(tag, attributes, remarks, articles > 0)
        stack.append((tag, bool(excludes), excludes is None))
        opened[tag] = opened.get(tag, 0) + 1
        shut += bool(excludes)
        doubts += excludes is None
        articles += tag in ("article", "main")
        links += tag == "a"
        headings += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    inside = sum(len(b.text) - b.links for b in found if b.inside)
    has_article = any(b.inside for b in found) and 2 * inside >= sum(len(b.text) - b.links for b in found)
    if not has_article:
        for b in found:
            b.inside = False
    return found, has_article


def _stops(text: str) -> tuple[int, int]:
    """A text's stop words and words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def _menus(blocks: list[Block]) -> list[bool]:
    """Which blocks stand in a row of MENU or more that are links alone, short, and no headings."""
    alone = [b.links > 0.9 * len(b.text) and b.size < SHORT and not b.heading for b in blocks]
    out, first = [False] * len(blocks), 0
    for i in range(len(blocks) + 1):
        if i == len(blocks) or not alone[i]:
            if i - first >= MENU:
                out[first:i] = [True] * (i - first)
            first = i + 1
    return out


def classify(blocks: list[Block], has_article: bool) -> None:
    """Sets each block's label to good or bad."""
    counts = [_stops(b.text) for b in blocks]
    prose = [c for b, c in zip(blocks, counts, strict=True) if b.size >= SHORT and b.links <= LINKS_HIGH * len(b.text)]
    # a page of another language: length and links decide
    foreign = sum(k for k, _ in prose) < STOP_LOW * sum(n for _, n in prose)
    dense = []
    for b, (k, words), menu in zip(blocks, counts, _menus(blocks), strict=True):
        stops = k / max(1, words)
        density = b.links / len(b.text)
        dense.append(density <= LINKS_HIGH and b.size >= SHORT and (stops >= STOP_HIGH or foreign))
        if has_article and not b.inside:
            b.label = "bad"
        elif density > LINKS_HIGH:
            b.label = "bad" if not b.inside or menu or b.doubtful else "good" if b.heading else "near"
        elif b.inside:
            b.label = "good" if dense[-1] or not b.doubtful and (b.size >= SHORT or b.heading or stops >= STOP_LOW) else "bad" if b.doubtful else "short"
        elif b.size < SHORT:
            b.label = "short"
        elif dense[-1]:
            b.label = "good" if b.size > LONG else "near"
        else:
            b.label = "near" if stops >= STOP_LOW else "bad"
    n = len(blocks)
    # paragraphs that are each of medium length decide themselves where they are long together
    first = 0
    for i in range(n + 1):
        if i == n or blocks[i].label == "bad":
            row = [j for j in range(first, i) if dense[j] and blocks[j].label == "near"]
            if sum(blocks[j].size for j in row) > LONG:
                for j in row:
                    blocks[j].label = "good"
            first = i + 1
    before, after = [""] * n, [""] * n
    for nearest, order in ((before, range(n)), (after, reversed(range(n)))):
        last = ""
        for i in order:
            nearest[i] = last
            last = blocks[i].label if blocks[i].label in ("good", "bad") else last
    for b, left, right, firm in zip(blocks, before, after, dense, strict=True):
        if b.label in ("short", "near"):
            sides = {left, right} - {""}
            if b.inside:
                b.label = "bad" if sides == {"bad"} else "good"
            elif len(sides) == 1:
                b.label = sides.pop()
            elif b.heading and right == "good":
                b.label = "good"  # the heading of what follows
            else:
                b.label = "good" if b.label == "near" and (sides or firm) else "bad"


def main_text(page: str | None) -> str:
    for remarks in (True, False):  # a page whose only article is named as a remark is read again
        blocks, has_article = blocks_of(page or "", remarks)
        classify(blocks, has_article)
        good = [b.text for b in blocks if b.label == "good"]
        if good or "<article" not in (page or "").lower():
            break
    return "\n".join(good)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", pages["html"].cast("string")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
