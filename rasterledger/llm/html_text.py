"""Main text of web pages from flat blocks and a decision tree.

A page becomes a flat list of text blocks: text between tags of block level, with
character references decoded and white space turned into single spaces. Scripts,
styles, comments and markup are never text. Each block is described by its own
number of words and share of linked words, by those of the block before and after
it, and by what it stands in (article, heading, menu, page frame, form, or a part
whose class or id names a notice, advert, side bar or reader comments). A
classification tree, grown by Gini impurity on the small labelled table
``LABELLED``, says which blocks are main text; these are joined in page order.

Null html is empty. A page without main text gives an empty string. Unclosed and
wrongly nested tags, cut-off tags and references are read as far as they go.
Repeated rows stay; an empty table gives an empty result. One pass, no shuffle, whole
pages. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts

#: One step of the scan: comment, declaration, tag or a cut-off rest of one.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z|[\"'][^>]*(?:>|\Z))", re.DOTALL)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select")}
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSED_BY_SAME = frozenset("p li dt dd option tr td th".split())

#: Kinds of surrounding parts; the innermost one counts.
ARTICLE, FRAME, FORM, ASIDE, OUTSIDE = range(5)
_PART = {"article": ARTICLE, "main": ARTICLE, "nav": FRAME, "header": FRAME, "footer": FRAME, "menu": FRAME, "form": FORM, "button": FORM, "fieldset": FORM, "aside": ASIDE, "dialog": ASIDE, "head": FRAME}
_BY_NAME = re.compile(r"(?:^|[\s_-])(?:(ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|related|recommend\w*|widget|notice|cookies?|consent|gdpr|popup|modal|comments?|respon[ds]\w*|repl(?:y|ies)|disqus|share|social|newsletter|subscribe|alert|complementary)|(nav\w*|menu|breadcrumbs?|pagination|header|footer|masthead|topbar|toolbar|navigation|banner|contentinfo)|(form|login|search|signup))(?=$|[\s_-])", re.IGNORECASE)


class Block:
    __slots__ = ("heading", "linked", "part", "text", "words")

    def __init__(self, text: str, words: int, linked: int, part: int, heading: bool):
        self.text, self.words, self.linked, self.part, self.heading = text, words, linked, part, heading


def _part_of(name: str, attributes: str) -> int | None:
    """What a tag opens: a kind of part, or None."""
    own = _PART.get(name)
    if attributes and own != ARTICLE and name not in ("body", "html"):
        for m in _NAMES.finditer(attributes):
            if found := _BY_NAME.search(m[1] or m[2] or m[3] or ""):
                return ASIDE if found[1] else FRAME if found[2] else FORM
    return own


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    #: Open tags: name, and what holds inside it: within a link, within a heading, kind of part.
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, OUTSIDE)]
    depth: dict[str, int] = {}
    at, end = 0, len(page)

    def close_block() -> None:
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip(" ")
            if text:
                words = text.count(" ") + 1
                linked = sum(len(p.split()) for p, link in pieces if link)
                out.append(Block(text, words, min(linked, words), stack[-1][3], stack[-1][2]))
            pieces.clear()

    def close_tag(name: str) -> None:
        while depth.get(name):
            gone = stack.pop()[0]
            depth[gone] -= 1
            if gone == name:
                break

    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            pieces.append((page[at:stop], stack[-1][1]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _RAW_END and not m[1]:
            done = _RAW_END[name].search(page, at)
            at = done.end() if done else end
            continue
        if name not in _INLINE:
            close_block()
        elif name != "a":
            continue
        if m[1]:
            close_tag(name)
            continue
        if name in _CLOSED_BY_SAME and (stack[-1][0] == name or stack[-1][0] == "a" and len(stack) > 2 and stack[-2][0] == name):
            close_tag(name)
        elif name == "a":
            close_tag(name)
        if name not in _VOID and not m[3].endswith("/"):
            _, link, heading, part = stack[-1]
            own = _part_of(name, m[3])
            stack.append((name, link or name == "a", heading or len(name) == 2 and name[0] == "h" and name[1].isdigit(), part if own is None else own))
            depth[name] = depth.get(name, 0) + 1
    close_block()
    return out


FEATURES = 12


def describe(own: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` numbers per block: words and link density of it and its neighbours, and its surroundings."""
    n = len(own)
    words = np.zeros(n + 2)
    density = np.zeros(n + 2)
    words[1:-1] = [b.words for b in own]
    density[1:-1] = [b.linked / b.words for b in own]
    out = np.zeros((n, FEATURES))
    for k, shift in enumerate((1, 0, 2)):
        out[:, k] = np.minimum(words[shift : shift + n], 100)
        out[:, 3 + k] = density[shift : shift + n]
    for k, b in enumerate(own):
        out[k, 6 + b.part] = 1
        out[k, 11] = b.heading
    return out


class Tree:
    """A binary classification tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.value = float(y.mean()) if len(y) else 0.0
        self.column = -1
        if depth == 0 or len(y) < 2 * least or self.value in (0.0, 1.0):
            return
        best = (self._impurity(y) - 1e-9, -1, 0.0)
        for column in range(x.shape[1]):
            levels = np.unique(x[:, column])
            for cut in (levels[1:] + levels[:-1]) / 2:
                low = x[:, column] < cut
                if min(low.sum(), (~low).sum()) >= least:
                    share = low.mean()
                    best = min(best, (share * self._impurity(y[low]) + (1 - share) * self._impurity(y[~low]), column, float(cut)))
        if best[1] >= 0:
            _, self.column, self.cut = best
            low = x[:, self.column] < self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = float(y.mean())
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.value)
        low = x[:, self.column] < self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


#: The labelled table: pages whose main blocks carry the mark ``@`` in front.
LABELLED = [
    '<body><a href="#c">Skip to content</a><p>The evening post</p><h1>@A long day on the river</h1><p>@We set out before dawn with two boats and food for a week and nobody knew what would come of it</p><p>@At noon the wind turned and we had to row for the rest of the way to the first camp on the shore</p><p>Tags: river, boats</p></body>',
    '<body><p>Login</p><p><a href="/1">Sports and games of the week</a></p><div><p>@The match ended without a goal although both teams had many chances in the second half of the game</p><p>@Fans left the ground early because of the heavy rain that had set in after the break of the match</p></div><p><a href="/2">All results of the season so far</a></p><p>Share</p></body>',
    '<body><div>Date</div><h2>@Old maps</h2><p>@Maps of the coast were drawn by hand and copied for sale in the ports where sailors met in winter</p><h2>@New maps</h2><p>@Today most maps are made from pictures taken by satellites and checked on the ground by a few people</p><div>Top</div><div><a href="/m">Shop for maps and globes and more</a></div></body>',
    '<body><p>Menu</p><p>Close</p><p>@Only one paragraph is on this page and it says all that there is to say about the small matter at hand</p><p>Print</p><p>Back to top</p></body>',
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>@A title of five words</h1><p>@The first paragraph tells in many words what has happened and where it was seen by people</p><p>@Short one.</p><p>@More text with <a href="/x">one link</a> within a long sentence that goes on for a while</p></article><footer>Imprint and contact of the publisher since 1999</footer>',
    '<header><p>The daily paper</p><a href="/">Home</a></header><main><h2>@Weather</h2><p>@It rains.</p><p>@Tomorrow the sun is expected to return to most parts of the country says the office</p></main><aside><h3>More</h3><p>Ten things that you have not known about the weather in the north of the land</p></aside><footer><a href="/i">Imprint</a></footer>',
    '<body><div class="ad">Buy the best shoes in town now</div><article><p>@One.</p></article><div class="sidebar"><ul><li><a href="/1">First story of the week</a></li><li><a href="/2">Second</a></li></ul></div></body>',
    '<body><div id="menu"><a href="/a">Start</a> <a href="/b">Shop</a></div><div id="content"><h1>@How bread is made at home</h1><p>@Take flour and water and salt and let the dough rest over night in a cool place before baking</p><p>@Bake it hot for forty minutes until the crust is brown and sounds hollow when you knock at it</p></div><div class="comments"><p>Great recipe and my family has loved it thank you very much for writing it down</p><p>Nice</p></div></body>',
    '<article><header><h1>Site of the town</h1></header><h2>@Council decides</h2><ul><li>@A new bridge</li><li>@Two schools</li></ul><p>@The vote was close and ended after midnight with many guests still in the hall</p><form><label>Your mail</label><button>Send</button></form><section class="comments"><p>I do not think that this bridge will ever be built in my life to be honest</p></section></article><div class="cookie-notice">We use cookies to make this page better for you and for our partners</div>',
    '<body><div class="topbar"><a href="/l">Log in</a></div><p>@A plain page without any parts has its text right in the body and tells it in long lines of words</p><p>@The second such paragraph follows the first and is about as long as the one that came before it</p><p><a href="/p">Previous page</a> <a href="/n">Next page</a></p></body>',
    '<nav><a href="/a">One</a></nav><article><h1>@Notes</h1><p>@See.</p><p>@A b.</p><blockquote>@To be or not to be that is what the man asks himself again and again on the stage</blockquote><table><tr><td>@Rows</td><td>@12</td></tr></table><div class="advert">Sale of the year with large prices cut by half</div><p>@End of the notes.</p></article><aside>Related reading for the long evenings of the winter <a href="/r">here</a></aside><footer>All rights reserved by the authors of this page</footer>',
    '<div class="nav">Start Shop Team</div><div><h2>@Travel by train</h2><p>@From the old station the line runs along the river through forests and fields up to the border of the land</p><p>@It takes three hours and there is a dining car on board for all who did not bring food of their own</p></div><form class="search">Search this site</form><div class="footer"><p>Contact us by mail or phone on all days of the week but sundays</p></div>',
    '<article><h1>@Minutes</h1><p>@<a href="/l">The list of all members who came to the meeting</a></p><p>@Ok.</p></article><div class="related"><p>Other minutes of the same year that you may want to read as well</p></div><form><p>Leave your name</p></form>',
]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED:
        own = blocks(page)
        labels += [b.text.startswith("@") for b in own]
        rows.append(describe(own))
    return np.vstack(rows), np.array(labels, float)


def train() -> Tree:
    return Tree(*labelled_blocks())


def main_text(page: str, tree: Tree) -> str:
    own = blocks(page)
    if not own:
        return ""
    chosen = tree.predict(describe(own)) >= 0.5
    return " ".join(b.text for b, keep in zip(own, chosen, strict=True) if keep)


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", url_column: str = "url") -> DataFrame:
    """``id, url, text, n_chars`` of every row of ``pages``."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                found = [main_text(page, tree) for page in texts(part.column("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html")).mapInArrow(run, "id long, url string, text string, n_chars long")
