"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser streams a page's events.  Block-level tags part the text into lines, and
sectioning elements, lists and tables make nested boxes.  A line's ratio is its text outside of links
over its tags, strengthened in an article or main element.  What can't be text (scripts, styles,
templates, navigation, form controls, hidden elements) makes no line.

Boxes that usually aren't the article (footers, asides, forms, those whose class, id or role says so, and
what follows a heading like "3 Comments") compete by place: their lines have a ratio only where no box
less deep in such boxes holds prose, however dense they are.  One that holds the main element, or all
first-level headings and more prose than the rest of the page, or a form around most of the prose, is
taken for the page's frame and counts as any other box.

Ratios are smoothed by a Gaussian along the page; lines above a share of their spread form the content
clusters.  The region is the innermost box that holds most of the clusters' text, widened to the
article or main element around it, or to the outermost box that adds lines which are content by
themselves; beside an article, other articles with prose belong to it, and the main element's h1 where
the articles have none.  All of the region is kept but lists of links outside of clusters, boxes that
usually aren't the article, and, unless the region is an article or main element, boxes that no cluster
touches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import rowwise

SIGMA, SHARE = 1.5, 0.5
NAMED = 5.0  # strengthens the ratio of lines in an article or main element
MOST = 0.5  # share of the clusters' text that the region's core holds
NEVER = set("script style noscript template head title nav menu button select option textarea input iframe svg canvas object".split())
BLOCKS = set("p div article section main body h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre hr figure figcaption address details summary fieldset center html header footer aside form dialog".split())
BOXES = set("article main section div body td th blockquote ul ol dl table header footer aside form dialog figure fieldset center".split())
LOOSE = set("div section center fieldset".split())  # boxes that may stand around anything
WHOLE = set("article main".split())
WEAK = set("footer aside form dialog label".split())
NEVER_FRAME = set("footer aside dialog label header li p".split())  # weak boxes that can't be the page's frame
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Before a token of ASIDE: the element has such a part, it isn't one (has-sidebar, no-sidebar).
ABOUT = set("has no not with without".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tokens of class, id or role that make it less likely that an element is the article.
ASIDE = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login menu modal nav navbar navigation newsletter notice notices alert pagination popup promo related recommended replies reply responses commentlist thread share sharing shares sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search discussion gdpr masthead topbar".split())
#: Start tags that end an open p.
CLOSES_P = BLOCKS - set("td th tr thead tbody tfoot caption body html summary figcaption".split())
#: Elements whose end tag may be left out: start tag -> what it ends, and the elements that this may not leave.
IMPLIED = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
#: What the end of a p may not leave.
AROUND_P = tuple(BOXES | {"li", "dt", "dd"})
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none")
_SENTENCE = re.compile(r"[.!?\u2026\u3002]\W*$")
#: Headings of reader comments, in the languages of the documents.
_COMMENTS = re.compile(r"\W*(\d+\W*)?(reader |user )?(comments?|replies|responses|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas)\W*(\d+\W*)?|leave a (comment|reply)\W*", re.I)


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    box: int
    block: str  # tag of the innermost block element


class Box(NamedTuple):
    tag: str
    outer: int  # number of the box around it, always a smaller one
    weak: bool


def is_hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    return tag in NEVER or any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _HIDDEN.search(v) for k, v in attrs)


def says_aside(attrs: list[tuple[str, str | None]]) -> bool:
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            for name in v.split():
                tokens = re.split(r"[^a-z]+", _CAMEL.sub(r"\1-\2", name).lower())
                if any(t in ASIDE and not (i and tokens[i - 1] in ABOUT) for i, t in enumerate(tokens)):
                    return True
    return False


class Lines(HTMLParser):
    """Lines and boxes of a page; the time for an event doesn't depend on how deep elements are nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, box, hidden
        self.opened: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self.blocks: list[int] = []  # those of blocks
        self.boxes = [Box("", 0, False)]
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []
        self.root = 0  # box of what no element is around
        self.comments: dict[int, tuple[str, int]] = {}  # depth of an element -> heading of its reader comments, box before

    def line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            block = self.stack[self.blocks[-1]][0] if self.blocks else ""
            if block in HEADINGS:
                self._heading(block, text)
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), self.stack[-1][1] if self.stack else self.root, block))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _heading(self, tag: str, text: str) -> None:
        """Reader comments begin at a heading that says so and end at one of its rank, or with the element around."""
        at = self.blocks[-1]
        held = self.comments.get(at)
        if held and tag <= held[0]:
            self._rebox(at, held[1])
            del self.comments[at]
            held = None
        if not held and tag != "h1" and self.lines and _COMMENTS.fullmatch(text):
            before = self.stack[at - 1][1] if at else self.root
            self.boxes.append(Box("comments", before, True))
            self.comments[at] = (tag, before)
            self._rebox(at, len(self.boxes) - 1)

    def _rebox(self, at: int, box: int) -> None:
        """Put the element around place ``at`` of the stack, and those of ``at`` and on, into ``box``."""
        if at:
            self.stack[at - 1] = (self.stack[at - 1][0], box, self.stack[at - 1][2])
        else:
            self.root = box
        for i in range(at, len(self.stack)):
            self.stack[i] = (self.stack[i][0], box, self.stack[i][2])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in CLOSES_P:
            self._end("p", AROUND_P)
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            for t in ended:
                self._end(t, within)
        _, box, hidden = self.stack[-1] if self.stack else ("", self.root, False)
        if tag in BLOCKS:
            self.line()
        self.tags += not hidden
        if tag in VOID:
            return
        hidden = hidden or is_hidden(tag, attrs)
        if not hidden and tag in BLOCKS and tag not in ("html", "body"):
            weak = tag in WEAK or says_aside(attrs) or tag == "header" and not any(self.opened[t] for t in ("article", "main", "section"))
            if weak or tag in BOXES:
                self.boxes.append(Box(tag, box, weak))
                box = len(self.boxes) - 1
        self.opened[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, box, hidden))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in NEVER:  # <p/> is a start tag to browsers
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self._end("p", AROUND_P)
        elif tag in IMPLIED:
            self._end(tag, IMPLIED[tag][1])
        elif tag not in VOID:
            self._end(tag, ())

    def _end(self, tag: str, within: tuple[str, ...]) -> None:
        """End the innermost ``tag``, unless an element of ``within`` lies in it (or a block, for what isn't one)."""
        if not self.opened[tag]:
            return
        at = self.opened[tag][-1]
        if tag not in BLOCKS and tag not in NEVER and self.blocks and self.blocks[-1] > at:
            return
        if any(self.opened[t] and self.opened[t][-1] > at for t in within):
            return
        if self.blocks and self.blocks[-1] >= at:
            self.line()
        for i, (t, _, _) in enumerate(self.stack[at:], at + 1):
            self.opened[t].pop()
            self.comments.pop(i, None)
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)
            if self.opened["a"]:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.line()


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, k / k.sum(), "same") if len(x) > 2 * reach else np.convolve(np.pad(x, reach), k / k.sum(), "valid")


def is_prose(line: Line) -> bool:
    """A paragraph, a sentence or five words, no heading."""
    return line.block not in HEADINGS and (line.block == "p" or line.text.count(" ") >= 4 or bool(_SENTENCE.search(line.text)))


def weak_boxes(boxes: list[Box], of: np.ndarray, prose: np.ndarray, titles: list[float]) -> list[bool]:
    """Weak boxes but those that are the page's frame; ``prose`` by line, ``titles`` (h1) by box with those in it."""
    mains, owner = [b.tag == "main" for b in boxes], [0] * len(boxes)
    for b in range(len(boxes) - 1, 0, -1):
        mains[boxes[b].outer] |= mains[b]
    for b in range(1, len(boxes)):
        owner[b] = b if boxes[b].weak else owner[boxes[b].outer]
    own = np.bincount(np.array(owner)[of], prose, len(boxes))  # of each weak box, without weak boxes in it
    most = own > own[0]
    return [x.weak and not (x.tag not in NEVER_FRAME and (mains[b] or most[b] and (x.tag == "form" or 0 < titles[b] == titles[0]))) for b, x in enumerate(boxes)]


def content(lines: list[Line], boxes: list[Box]) -> list[str]:
    """Lines of the content region."""
    if not lines:
        return []
    outer = [b.outer for b in boxes]
    of = np.array([x.box for x in lines])
    chars, linked, tags = (np.array(x, float) for x in zip(*((len(x.text), x.linked, x.tags) for x in lines), strict=True))
    prose = (2 * linked <= chars) & np.array([is_prose(x) for x in lines])

    def totals(x: np.ndarray) -> list[float]:
        """Sums of the lines in each box and the boxes in it."""
        out = np.bincount(of, x, len(boxes)).tolist()
        for b in range(len(boxes) - 1, 0, -1):
            out[outer[b]] += out[b]
        return out

    weak = weak_boxes(boxes, of, chars * prose, totals(np.array([x.block == "h1" for x in lines], float)))
    deep, named = [0] * len(boxes), [False] * len(boxes)
    for b in range(1, len(boxes)):
        deep[b] = deep[outer[b]] + weak[b]
        named[b] = named[outer[b]] or boxes[b].tag in WHOLE
    depth = np.array(deep)[of]
    # lines deeper in weak boxes than the least deep prose have no ratio
    least = int(depth[prose].min() if prose.any() else depth.min())
    able = depth <= least
    ratio = able * (chars - linked) / np.maximum(tags, 1) * np.where(np.array(named)[of], NAMED, 1.0)
    even = smooth(ratio)
    level = min(SHARE * even.std(), even.max())
    high = able & (even >= level)
    mass, alone = totals(chars * high), totals(chars * (high & (ratio >= level)))

    # the innermost box with most of the clusters' text, widened
    core = 0
    for b in range(1, len(boxes)):  # boxes in it come after it
        if outer[b] == core and mass[b] > 0 and mass[b] >= MOST * mass[0]:
            core = b
    path = [core]
    while path[-1] and boxes[path[-1]].tag not in WHOLE:
        path.append(outer[path[-1]])
    region = path[-1] if boxes[path[-1]].tag in WHOLE else core
    if boxes[region].tag not in WHOLE:
        for inner, b in zip(path, path[1:], strict=False):
            if alone[b] > alone[inner] * (1 + 1e-9):
                region = b
    sure = boxes[region].tag in WHOLE

    # what of the region isn't content
    n, some, links, told, up = totals(np.ones(len(lines))), totals(chars), totals(linked), totals(prose & able), totals(high * 1.0)
    kept, head = [False] * len(boxes), [False] * len(boxes)  # head: in the main element around the article
    kept[region] = True
    around = region
    while around and boxes[around].tag != "main":
        around = outer[around]
    for b in range(1, len(boxes)):
        head[b] = b == around or head[outer[b]]
        if b == region:
            continue
        if boxes[region].tag == "article" and boxes[b].tag == "article" and not kept[outer[b]]:
            kept[b] = deep[b] <= least and told[b] > 0 and 2 * links[b] <= some[b]  # another article
            continue
        kept[b] = kept[outer[b]] and n[b] > 0
        if weak[b] and (deep[b] > least or not up[b]):
            kept[b] = False
        elif 2 * links[b] > some[b] and 2 * up[b] < n[b]:
            kept[b] = False
        elif not sure and boxes[b].tag in LOOSE and not up[b]:
            kept[b] = False
    menu = (2 * linked > chars) & ~high & (not sure)
    stay = np.array(kept)[of] & ~menu
    title = np.array([x.block == "h1" for x in lines])
    if sure and around and around != region and not (title & stay).any():
        stay |= title & able & np.array(head)[of]
    return [x.text for x, s in zip(lines, stay, strict=True) if s]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    return "\n\n".join(content(parser.lines, parser.boxes))


def _extracted(batches):
    for batch in batches:
        for part in rowwise(batch, 256):
            texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    Null or empty html, or a page without a content line, gives the empty text.  Character references
    are decoded, white space inside a block is one space, blocks are trimmed and joined in page order
    by two line feeds.  Rows are independent: repeated rows give repeated results; other columns are
    not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
