"""Main text of web pages by tag-path ratios.

The text nodes of a page are grouped by their path of tags from the root. A path's ratios are text length and
punctuation per node; they are fused into one score, the scores are smoothed along the page, and paths above a
threshold hold content. The innermost element that holds most of the content is the container: an ``article`` or
``main`` if there is one, several articles, or any other element. The text of the container is the article, with its
headings, lists, tables, quotations and code; in a container that is no article, other elements without any content
path are left out, and so are lists of links.

Elements that never hold article text (``nav``, ``footer``, ``form``, ``script``, ...), hidden ones and those with such a
role take no part. Names only weigh: an element named like an advert, a menu or comments is left out unless an article
lies in it or, in an article or a page without one, it holds at least half of the text; names that say less
(``widget``, ``legal``) count as whole names only, and not in an article.

A page is read once from left to right, and what is kept of an element is its parent, so the time grows with the
page's length whatever its tags are.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.tables import map_batches

TAG_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_PART = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
SKIP = frozenset("head title script style noscript template iframe object svg canvas nav footer aside form button select "
                 "option textarea input dialog menu embed noembed noframes audio video map datalist fieldset".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                       "toolbar".split())
STRONG_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
                         "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr popup "
                         "modal newsletter subscribe subscription social related recommended recommendations comment "
                         "comments disqus replies pagination pager".split())
WEAK_NAMES = frozenset("side aside widget widgets footer header head masthead topbar notice notices alert overlay signup login "
                       "signin search share sharing reply skip copyright legal disclaimer hidden toolbar".split())
#: Elements of an article beside its paragraphs.
BODY_PARTS = HEADINGS | frozenset("p ul ol dl table blockquote pre figure figcaption code q".split())
#: A start tag of the key closes the open elements named here, up to the nearest of the fences.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SMOOTH = np.exp(-np.arange(-2, 3) ** 2 / 2.0) / np.exp(-np.arange(-2, 3) ** 2 / 2.0).sum()
SHARE = 0.3      # of the mean score by text, above which a path is content
CONTAINS = 0.8   # share of the content a container must hold
MOST = 0.5       # share of the text from which a name counts for nothing
LINKED = 0.8     # share of linked text from which a list is one of links


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(source)}


def weigh(tag: str, source: str, in_article: bool) -> int:
    """3: none of the article by tag, role or state; 2 and 1: named strongly or weakly like such an element; else 0."""
    if tag in SKIP or (tag == "header" and not in_article):
        return 3
    if not source or source == "/":
        return 0
    got = attributes(source)
    if got.get("role", "").lower() in SKIP_ROLES or got.get("aria-hidden", "").lower() == "true" or "hidden" in got:
        return 3
    if "none" in got.get("style", "") and re.search(r"display\s*:\s*none", got["style"]):
        return 3
    if tag in ("body", "html"):
        return 0
    names = f"{got.get('class', '')} {got.get('id', '')}".lower().split()
    if not STRONG_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", " ".join(names))):
        return 2
    return 1 if not in_article and tag not in ARTICLES and tag not in HEADINGS and not WEAK_NAMES.isdisjoint(names) else 0


class Page:
    """Elements (parent, tag, path, depth, name's weight) and wanted text nodes of a page, in order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.depth, self.named = [-1], [""], [0], [0], [0]
        self.node_of, self.block_of, self.text, self.heading, self.linked = [], [], [], [], []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [0]                                    # open elements
        self._bad = [0]                                      # 1 for those that take no part
        self._open: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self._solid = [0]                                    # places of the elements that are no inline ones
        self._skipping = self._headings = self._block = 0
        self._read(source)

    def _add(self, piece: str) -> None:
        if piece and not self._skipping:
            self.node_of.append(self._stack[-1])
            self.block_of.append(self._block)
            self.text.append(html.unescape(piece))
            self.heading.append(self._headings > 0)
            self.linked.append(bool(self._open["a"]))

    def _pop(self) -> None:
        tag = self.tag[self._stack.pop()]
        self._skipping -= self._bad.pop()
        self._open[tag].pop()
        self._headings -= tag in HEADINGS
        if self._solid[-1] == len(self._stack):
            self._solid.pop()

    def _cut(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def _last(self, tags) -> int:
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)

    def _start(self, tag: str, source: str) -> None:
        if tag not in INLINE:
            self._block += 1
            if tag not in VOID and self.tag[self._stack[self._solid[-1]]] == "p":
                self._cut(self._solid[-1])                  # a block ends an open paragraph
        elif tag == "br":
            self._add(" ")
        if tag in CLOSES:
            ends, fences = CLOSES[tag]
            if self._last(ends) > self._last(fences):
                fence = self._last(fences)
                self._cut(min(p for t in ends for p in self._open.get(t, ())[-1:] if p > fence))
        if tag in VOID or source.endswith("/") and tag in ("svg", "path"):
            return
        up = self._stack[-1]
        weight = weigh(tag, source, any(self._open.get(t) for t in ARTICLES))
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self._paths.setdefault((self.path[up], tag), len(self._paths) + 1))
        self.depth.append(self.depth[up] + 1)
        self.named.append(weight % 3)
        place = len(self._stack)
        self._stack.append(len(self.tag) - 1)
        self._bad.append(int(weight == 3))
        self._skipping += weight == 3
        self._open[tag].append(place)
        self._headings += tag in HEADINGS
        if tag not in INLINE:
            self._solid.append(place)

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._block += 1
        if self._open.get(tag):
            self._cut(self._open[tag][-1])

    def _read(self, page: str) -> None:
        at, size, quotes = 0, len(page), True
        while at < size:
            m = TAG_START.search(page, at)
            self._add(page[at:m.start() if m else size])
            if not m:
                break
            start = m.start()
            if m[0] in ("<!--", "<![CDATA["):
                close = "-->" if m[0] == "<!--" else "]]>"
                end = page.find(close, m.end())
                if m[0] != "<!--":
                    self._add(page[m.end():end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
                continue
            end, at_part = -1, m.end()
            while quotes:                                    # the next > that is not quoted
                part = TAG_PART.search(page, at_part)
                if part and part[0] == ">":
                    end = part.start()
                    break
                close = page.find(part[0], part.end()) if part else -1
                if close < 0:
                    quotes = False                           # all that follow are quoted: read them as they are
                at_part = close + 1
            if end < 0:
                end = page.find(">", start)
            if end < 0:                                      # no tag ends any more
                self._add(page[start:])
                break
            at = end + 1
            if m[0] in ("<!", "<?"):
                continue
            name = TAG_NAME.match(page, start + 1 + (page[start + 1] == "/"))
            tag = name[0].lower()
            if page[start + 1] == "/":
                self._end(tag)
                continue
            if tag in RAW:
                if tag not in INLINE:
                    self._block += 1
                closing = RAW_ENDS[tag].search(page, at)
                at = closing.end() if closing else size
                continue
            self._start(tag, page[name.end():end])


RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def content_paths(page: Page, own: list[int]) -> set[int]:
    """Paths of the nodes ``own`` whose smoothed ratio of text and punctuation is above the threshold."""
    length, marks, count, links = Counter(), Counter(), Counter(), Counter()
    sizes, paths = [], [page.path[page.node_of[k]] for k in own]
    for k, path in zip(own, paths):
        n = len(page.text[k].strip())
        sizes.append(n)
        if n:
            length[path] += n
            marks[path] += len(PUNCTUATION.findall(page.text[k]))
            count[path] += 1
            links[path] += n if page.linked[k] else 0
    # text per node times punctuation per node, without linked text
    score = {p: (length[p] - links[p]) / count[p] * (1 + marks[p] / count[p]) for p in length}
    if not score:
        return set()
    sizes = np.array(sizes, float)
    raw = np.array([score.get(p, 0.0) for p in paths])
    line = np.convolve(raw, SMOOTH, mode="same") if len(raw) > len(SMOOTH) else raw
    fused = np.sqrt(np.maximum(line, 0) * raw)  # smoothed along the page, fused with the path's own
    mean = float((fused * sizes).sum() / max(sizes.sum(), 1))
    above = defaultdict(float)
    for path, x, n in zip(paths, fused, sizes):
        above[path] += n if x >= SHARE * mean else 0
    return {p for p in score if above[p] * 2 >= length[p] and above[p] > 0}


def _upward(page: Page, sizes: dict[int, int]) -> list[int]:
    """Sum of the sizes of the nodes below each element."""
    total = [0] * len(page.tag)
    for e, n in sizes.items():
        total[e] += n
    for e in range(len(total) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    return total


def _below(page: Page, marked: list[bool]) -> list[bool]:
    """Elements that are marked or lie in a marked one."""
    out = list(marked)
    for e in range(1, len(out)):
        out[e] = out[e] or out[page.parent[e]]
    return out


def misnamed(page: Page, sizes: dict[int, int], total: list[int]) -> list[bool]:
    """Elements that are left out for their names: not those around an article, and not those that hold at least
    ``MOST`` of the article they are in, or of a page without articles."""
    is_article = [page.tag[e] in ARTICLES and not page.named[e] for e in range(len(total))]
    in_article = _below(page, is_article)
    articles = _upward(page, {e: n for e, n in sizes.items() if in_article[e]})
    scope = [0] * len(total)                                 # the nearest article around an element
    for e in range(1, len(total)):
        up = page.parent[e]
        scope[e] = up if is_article[up] else scope[up]
    out = []
    for e in range(len(total)):
        most = total[e] >= MOST * total[scope[e]] if scope[e] or not articles[0] else articles[e] > 0
        out.append(page.named[e] > 0 and not most)
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks, white space turned into single spaces, joined by one space."""
    page = Page(source or "")
    lengths = [len(t.strip()) for t in page.text]
    sizes: Counter = Counter()
    for k, e in enumerate(page.node_of):
        sizes[e] += lengths[k]
    total = _upward(page, sizes)
    unwanted = _below(page, misnamed(page, sizes, total))
    own = [k for k, e in enumerate(page.node_of) if not unwanted[e]]
    good = content_paths(page, own)
    if not good:
        return ""
    content: Counter = Counter()
    for k in own:
        if page.path[page.node_of[k]] in good:
            content[page.node_of[k]] += lengths[k]
    held = _upward(page, content)
    enough = [e for e in range(len(held)) if held[e] >= CONTAINS * held[0] and not unwanted[e]]
    named = [e for e in enough if page.tag[e] in ARTICLES]
    articles = [page.tag[e] in ARTICLES and held[e] > 0 and not unwanted[e] for e in range(len(held))]
    in_articles = _below(page, articles)
    first = [articles[e] and not in_articles[page.parent[e]] for e in range(len(held))]
    if named:
        roots = {max(named, key=lambda e: page.depth[e])}
    elif sum(held[e] for e in range(len(held)) if first[e]) >= CONTAINS * held[0]:
        roots = {e for e in range(len(held)) if first[e]}   # several articles on a page without a common one
    else:
        roots = {max(enough, key=lambda e: page.depth[e])}
    whole = all(page.tag[e] in ARTICLES for e in roots)
    inside = _below(page, [e in roots for e in range(len(held))])
    linked: Counter = Counter()
    for k in own:
        linked[page.node_of[k]] += lengths[k] if page.linked[k] else 0
    linked_below = _upward(page, linked)
    # the child of the root that an element lies in
    branch = list(range(len(held)))
    for e in range(1, len(held)):
        if page.parent[e] not in roots and inside[page.parent[e]]:
            branch[e] = branch[page.parent[e]]

    def kept(k: int) -> bool:
        e = page.node_of[k]
        if unwanted[e] or not inside[e]:
            return False
        if whole:
            return True
        if e in roots:
            return page.path[e] in good or not page.linked[k]
        b = branch[e]
        if held[b]:
            return True
        if page.tag[b] in INLINE:
            return not page.linked[k]
        return page.tag[b] in BODY_PARTS and (page.heading[k] or linked_below[b] < LINKED * total[b])
    blocks: dict[int, list[str]] = {}
    for k, text in enumerate(page.text):
        if kept(k):
            blocks.setdefault(page.block_of[k], []).append(text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(t for t in texts if t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages`` (page_id, url, html).

    A null or empty page, or one without content, has the empty text; page_id and url are passed on as they are,
    also null or repeated. Other columns are ignored.
    """
    def extract(batch):
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
               "n_chars": [len(t) for t in texts]}
    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return map_batches(chosen, extract, "page_id bigint, url string, text string, n_chars bigint")
