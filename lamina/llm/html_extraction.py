"""The main text of a web page, by scoring the tree of its elements.

A page is read into a tree; what can be no article (navigation, headers and footers of the page, sidebars,
forms, scripts, adverts, notices, reader comments) is left out with all that it holds. What only a word of a class says so of
stays where it holds the article itself, and where the word stands beside others and the text is prose. Each run of text between
block boundaries is a paragraph. It passes points, one and one for each comma and up to three for its length,
to its container in full, to the next in half, and then ever less. A container's points are discounted by the
share of its text that lies in links. The best container is widened to the article that holds it. Of its
siblings, paragraphs are kept by their own length, commas and links, headings with what follows them, and
containers with a fifth of its points or with paragraphs about as good as its own.

A page is one row, so this is one pass per row in the task that reads it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.batches import map_texts

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Left out with all that they hold.
LEFT_OUT = frozenset(
    "nav header footer aside form script style noscript template head title button select textarea input iframe object embed svg canvas "
    "dialog menu audio video map datalist".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre dd dt blockquote figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A container beside the best one is kept if its paragraphs have on average this share of the points of the best one's.
SIBLING_SHARE = 0.4
#: Containers further out than this get nothing of a paragraph.
REACH = 8
ARTICLE = frozenset(("article", "main"))
#: Words of a class or id that mark what is no article; those of the second line do so alone or beside words for parts of a page.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments disqus cookie cookies consent gdpr popup modal newsletter subscribe pagination pager login signup".split())
DOUBTFUL = frozenset("promo promotion banner aside widget respond reply replies notice overlay share sharing social related recommended toolbar skip".split())
#: Words run together, such as commentlist, sidenav or adbox.
JOINED = re.compile(r"comment|^(?:side|top|main|sub)nav$|^nav(?:bar|menu|list)|^ad(?:box|slot|unit|block|banner|wrap|space|container)s?$|^cookie|^feedback$|^breadcrumb|^sidebar|^usermenu$")
PARTS = frozenset(
    "area article articles bar block blocks body bottom box button buttons card column container content entry footer form group head header icon icons inner "
    "item items left link links list main media message module more page panel post posts region right row section site stories text title top wrap wrapper".split())
#: A class such as category-social-science or tag-notice says what the text is about.
DESCRIBING = frozenset("category tag topic type format status series".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class such as no-sidebar or has-comments says nothing of the element itself.
NEGATIONS = frozenset("no not has with without".split())
#: An opening tag of the first kind ends an open element of the second, unless one of the third lies between.
P_ENDERS = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr summary".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")


def _is_left_out(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in ROLES:
            return True
    return False


def _mark(tag: str, attributes: str) -> int:
    """What the class and id of an element say: 2 that it is no article, 1 perhaps, 0 nothing."""
    if not attributes or tag in ("body", "html") or tag in ARTICLE:
        return 0
    most = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id"):
            continue
        for given in html.unescape(a or b or c).lower().split():
            words = WORD.findall(given)
            if not words or words[0] in NEGATIONS or (len(words) > 1 and words[0] in DESCRIBING):
                continue
            if not MARKS.isdisjoint(words) or any(map(JOINED.search, words)):
                return 2
            if not DOUBTFUL.isdisjoint(words):
                others = [w for w in words if w not in DOUBTFUL and w not in PARTS and not w[0].isdigit()]
                most = max(most, 1 if others else 2)
    return most


def _worth(text: str) -> float:
    """Points of a paragraph: one, one for each comma and up to three for its length."""
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)


class Page:
    """The tree of a page: per element its tag, parent and fate; per run of text its block, text and link text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.left_out, self.marks = ["#page"], [-1], [False], [0]
        self.runs: list[tuple[int, str, int]] = []
        self._stack, self._open, self._links = [0], {}, 0
        self._words: list[str] = []
        self._linked = 0
        self._read(source)
        self._drop_marked()

    def _block(self) -> int:
        for element in reversed(self._stack):
            if self.tags[element] in BLOCKS or element == 0:
                return element
        return 0

    def _break(self) -> None:
        """End the run of text at a block boundary."""
        if self._words:
            text = " ".join("".join(self._words).split())
            if text:
                self.runs.append((self._block(), text, min(self._linked, len(text))))
        self._words, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if raw and not self.left_out[self._stack[-1]]:
            text = html.unescape(raw)
            self._words.append(text)
            if self._open.get("a"):
                self._linked += len(" ".join(text.split()))

    def _push(self, tag: str, attributes: str) -> None:
        parent = self._stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        mark = _mark(tag, attributes)
        # Inside a line there is nothing to judge by.
        out = _is_left_out(tag, attributes) or (mark == 2 and tag not in BLOCKS)
        self.left_out.append(self.left_out[parent] or out)
        self.marks.append(mark if tag in BLOCKS else 0)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, place: int) -> None:
        for element in self._stack[place:]:
            self._open[self.tags[element]] -= 1
        del self._stack[place:]

    def _end(self, tags: set[str] | tuple[str, ...], stops) -> None:
        """Close the innermost open element of ``tags``, if nothing of ``stops`` is open inside it."""
        if not any(self._open.get(tag) for tag in tags):
            return
        for place in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[place]]
            if tag in tags:
                if tag in BLOCKS:
                    self._break()
                self._pop_to(place)
                return
            if tag in stops:
                return

    def _read(self, source: str) -> None:
        at, find = 0, TAG.search
        while True:
            found = find(source, at)
            if not found:
                break
            self._text(source[at:found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._end((tag,), () if tag in BLOCKS else BLOCKS)
                continue
            attributes = found[3] or found[6] or ""
            if tag in BLOCKS:
                if tag in P_ENDERS:
                    self._end(("p",), ("button", "table", "td", "th"))
                self._break()
            if tag in ENDS:
                self._end(*ENDS[tag])
            if tag == "br":
                self._text(" ")
            elif tag == "a" and self._open.get("a"):
                self._end(("a",), BLOCKS)
            if tag in VOID:
                continue
            self._push(tag, attributes)
            if tag in RAW and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                at = close.start() if close else len(source)
        self._text(source[at:])
        self._break()


    def _drop_marked(self) -> None:
        """Leave out the runs of marked elements, but for those that hold the article or, where the mark is in doubt, prose."""
        if not any(self.marks):
            return
        n = len(self.tags)
        worth, count, length, linked, holds, heads = [0.0] * n, [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
        for block, text, in_links in self.runs:
            worth[block] += _worth(text) * (1 - in_links / len(text))
            count[block] += 1
            length[block] += len(text)
            linked[block] += in_links
        for element in range(n - 1, 0, -1):  # a parent comes before its children
            parent = self.parents[element]
            holds[parent] |= holds[element] or self.tags[element] in ARTICLE
            heads[parent] |= heads[element] or self.tags[element] == "h1"
            for sums in (worth, count, length, linked):
                sums[parent] += sums[element]
        under = [False] * n  # in a marked element
        for element in range(1, n):
            under[element] = under[self.parents[element]] or self.marks[element] > 0
        plain = [_worth(t) * (1 - k / len(t)) for b, t, k in self.runs if not under[b]]
        least = SIBLING_SHARE * sum(plain) / len(plain) if plain else 0.0
        dropped = [False] * n
        for element in range(1, n):
            own = False
            if self.marks[element] == 2:
                own = not holds[element] and not (heads[element] and worth[element] > worth[0] / 2)
            elif self.marks[element] and count[element]:
                own = not holds[element] and (linked[element] > 0.25 * length[element] or worth[element] / count[element] < least)
            dropped[element] = dropped[self.parents[element]] or own
        self.runs = [run for run in self.runs if not dropped[run[0]]]


def _is_prose(links: float, worth: float) -> bool:
    """Whether a paragraph beside the best container is text: few links, or some in much text."""
    return links <= 0.25 or (links <= 0.5 and worth >= 2.0)


def _siblings(page: Page, best: int, score: dict[int, float], length: dict[int, int], linked: dict[int, int]) -> set[int]:
    """What stands beside the best container and belongs to its article.

    Paragraphs are judged by their own length, commas and links, containers by points a paragraph. A heading
    belongs to what follows it.
    """
    parent = page.parents[best]
    if parent < 0:
        return set()
    worths: dict[int, list[float]] = {}
    for block, text, in_links in page.runs:
        element = block
        while element >= 0 and page.parents[element] != parent:
            element = page.parents[element]
        if element >= 0:
            worths.setdefault(element, []).append(_worth(text) * (1 - in_links / len(text)))
    if best not in worths:
        return set()
    least = SIBLING_SHARE * sum(worths[best]) / len(worths[best])
    kept, follows = set(), False
    for element in sorted(worths, reverse=True):  # in page order, the last first
        links = linked[element] / length[element]
        if element == best:
            follows = True
            continue
        if page.tags[element] in HEADINGS:
            belongs = follows and links <= 0.5
        elif page.tags[element] in PARAGRAPHS:
            belongs = _is_prose(links, sum(worths[element]))
        else:
            belongs = score.get(element, 0.0) >= max(0.2 * score[best], 2.0) or (links <= 0.25 and sum(worths[element]) / len(worths[element]) >= least)
        follows = belongs
        if belongs:
            kept.add(element)
    return kept


def extract_text(source: str | None) -> str:
    """The main text of one page: blocks in page order, joined by line feeds; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    if not page.runs:
        return ""
    points, length, linked = {}, {}, {}
    for block, text, in_links in page.runs:
        worth = _worth(text)
        # A paragraph's container is the element around it; text that lies in a container is its own.
        holder = page.parents[block] if page.tags[block] in PARAGRAPHS else block
        level, element = 0, holder
        while element >= 0 and level <= REACH:
            share = 1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level)
            points[element] = points.get(element, 0.0) + worth * share
            level, element = level + 1, page.parents[element]
        length[block] = length.get(block, 0) + len(text)
        linked[block] = linked.get(block, 0) + in_links
    for element in range(len(page.tags) - 1, 0, -1):  # a parent comes before its children
        if element in length:
            parent = page.parents[element]
            length[parent] = length.get(parent, 0) + length[element]
            linked[parent] = linked.get(parent, 0) + linked[element]
    score = {e: p * (1 - linked.get(e, 0) / max(length.get(e, 0), 1)) + (0.5 if page.tags[e] in ARTICLE else 0) for e, p in points.items()}
    best = max(score, key=lambda e: (score[e], -e))
    element = best
    while element > 0:
        if page.tags[element] in ARTICLE:
            best = element
        element = page.parents[element]
    kept = {best} | _siblings(page, best, score, length, linked)
    # A list or box inside that is nearly all links is a menu.
    menus = {e for e in length if page.tags[e] in ("ul", "ol", "div", "table", "section") and e not in kept and linked[e] > 0.7 * length[e]}
    inside: dict[int, bool] = {}

    def within(element: int) -> bool:
        path, found = [], False
        while element >= 0 and element not in inside:
            path.append(element)
            if element in menus:
                break
            if element in kept:
                found = True
                break
            element = page.parents[element]
        else:
            found = inside.get(element, False)
        for step in path:
            inside[step] = found
        return found

    around = page.parents[best]  # its own text, in no element beside the best

    def beside(block: int, text: str, in_links: int) -> bool:
        return block == around and _is_prose(in_links / len(text), _worth(text) * (1 - in_links / len(text)))

    return "\n".join(text for block, text, in_links in page.runs if within(block) or beside(block, text, in_links))


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the html and with ``text_col``: the main text of each, empty if there is none.

    Null and empty pages give empty text; text without any tag is an article. Repeated rows and nulls in
    other columns stay. A column of the name ``text_col`` is replaced. No rows: no rows.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col)]

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([extract_text(source) for source in batch.column(0).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], names=[text_col, *others])

        return step

    picked = pages.select(F.col(f"`{html_col}`").cast("string").alias(html_col), *[F.col(f"`{c}`") for c in others])
    schema = ", ".join([f"`{text_col}` string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in others)])
    return map_texts(picked, 0, work, schema)
