"""Main text of HTML pages by tag-path ratios.

Each text node has the path of tags (with classes) from the root to its leaf. Text length and
punctuation are added up per path; their ratios to the number of nodes are smoothed along the page and
fused into one score, which names of surroundings lower and article elements raise. Paths above a
threshold hold content. The article's element lies around all content nodes, with its heading;
what else it holds stays if it is flowing text, a list of text or a table, and a box in it
only if the box's own mean score is not far below. All passes over a page are linear in its size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from valuegrain.llm.tables import only

#: Paths with this share of the page's mean score hold content; boxes beside them need the second.
THRESHOLD = 0.5
WEAK = 0.2
#: Weights of neighbours in page order.
SMOOTHING = (0.25, 0.5, 0.25)
#: What names of surroundings and article elements multiply a score by.
NAMED_FACTOR = 0.01
ARTICLE_FACTOR = 3.0

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset(
    "head nav header footer aside form button select option menu dialog svg canvas object audio video map math "
    "script style textarea title xmp iframe noembed noframes noscript template".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul br".split()
)
# The open elements an opening tag ends.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
        "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split(),
        frozenset({"p"}),
    ),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
#: Elements beyond which an opening tag ends nothing.
SCOPES = frozenset("ul ol dl table td th div article section main body blockquote select".split())
# Words in class, id and role that mark parts around an article; users' comments are never its text.
_COMMENTS = r"(?:comments?|commentlist|disqus|replies)"
_WORDS = (
    r"(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed)?|promo(?:tion)?s?|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|sidebars?|aside|widgets?|cookies?|consent|gdpr|notices?|popups?|modal|overlay|"
    r"newsletter|subscribe|subscription|reviews?|related|recommended|share|sharing|social|"
    r"login|signup|search|pagination|pager|toolbar|complementary|contentinfo|dialog|skip|disclaimer|alerts?)"
)
# A name counts as a whole: no-sidebar, header-fixed and comments-open say how an element looks, not what it is.
_BEFORE = r"(?:(?:site|global|top|bottom|left|right|main|primary|secondary|mobile)[_-])*"
_AFTER = (
    r"(?:[_-](?:{}|area|bar|list|container|wrapper|wrap|inner|box|block|section|items?|links?|buttons?|icons?|form|body|posts?|"
    r"left|right|top|bottom|main|primary|secondary|\d+))*$"
)
NAMED = re.compile(rf"^{_BEFORE}{_WORDS}{_AFTER.format(f'{_WORDS}|{_COMMENTS}')}", re.IGNORECASE)
COMMENTS = re.compile(rf"^{_BEFORE}{_COMMENTS}{_AFTER.format(f'{_WORDS}|{_COMMENTS}')}", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![A-Za-z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRS = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟¿¡\"“”«»()-]")


_ROOTS = ("", "html", "body", "main")
_HEADINGS = ("h1", "h2", "h3")
# Elements that split a page into boxes, and those that hold a list or a table.
_BOXES = frozenset("div section article main aside center details dialog address hgroup header search body html".split())
_STRUCTURES = frozenset("ul ol dl table pre blockquote figure".split())
_LISTS = frozenset("ul ol dl table".split())
_LEAVES = frozenset(
    "p a b i u s em strong span font small big sub sup code pre q cite abbr mark time del ins label blockquote li ul ol "
    "dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th figure figcaption center tt kbd samp var address header "
    "hgroup details summary".split()
)


class Tree:
    """The elements of a page in order of their opening, each a number; 0 stands for the page."""

    def __init__(self) -> None:
        self.tag, self.parent, self.path = [""], [0], [0]
        self.dropped, self.linked, self.article, self.main = [False], [False], [False], [False]
        #: Whether names mark the element as surroundings, and as users' comments.
        self.named, self.comments = [False], [False]
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, tag: str, parent: int, attrs: str) -> int:
        step, hidden, named, comments = _named(tag, attrs)
        inside, main = self.article[parent] or tag == "article", self.main[parent] or tag == "main"
        # The header of an article is its heading; that of a page is not.
        mild = tag == "header" and (inside or main)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self._paths.setdefault((self.path[parent], step), len(self._paths) + 1))
        self.dropped.append(self.dropped[parent] or hidden or (tag in DROPPED and not mild))
        self.linked.append(self.linked[parent] or tag == "a")
        self.article.append(inside)
        self.main.append(main)
        self.named.append(named)
        self.comments.append(comments)
        return len(self.tag) - 1


def _named(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """The element's step in a path, whether it is hidden, and what its names mark it as."""
    step, hidden, named, comments = tag, False, False, False
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, a, b, c in _ATTRS.findall(attrs):
            value, key = a or b or c, key.lower()
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif value:
                if key == "class":
                    step += f" {value}"
                for name in _CAMEL.sub("-", value).split():
                    named = named or bool(NAMED.search(name))
                    comments = comments or bool(COMMENTS.search(name))
    if tag in ("html", "body", "main"):
        return step, False, False, False
    return step, hidden, named, comments


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self) -> None:
        self.elements = [0]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, element: int) -> None:
        self.places[tag].append(len(self.elements))
        self.elements.append(element)

    def cut(self, place: int, tags: list[str]) -> None:
        """End the element at the place and all in it."""
        while len(self.elements) > place:
            self.places[tags[self.elements.pop()]].pop()

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else 0

    def ended_by(self, closed: frozenset) -> int:
        """The outermost place that an opening tag ends, up to the nearest scope; 0 if it ends none."""
        scope = max((self.last(t) for t in SCOPES - closed), default=0)
        found = []
        for t in closed:
            places = self.places.get(t, ())
            k = bisect_right(places, scope)
            if k < len(places):
                found.append(places[k])
        return min(found, default=0)


def parse(html: str) -> tuple[Tree, list[tuple[int, str | None]]]:
    """The page's elements, and its text in order as (element, text); text None where a block begins or ends."""
    tree, opened, out = Tree(), _Open(), []
    at = position = 0
    while True:
        m = _MARKUP.search(html, position)
        to = m.start() if m else len(html)
        if to > at:
            out.append((opened.elements[-1], html[at:to]))
        if not m:
            return tree, out
        at = position = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in BLOCKS:
            out.append((0, None))
        if m["end"]:
            if opened.last(tag):
                opened.cut(opened.last(tag), tree.tag)
            continue
        closed = CLOSES.get(tag)
        if closed:
            place = opened.ended_by(closed)
            if place:
                opened.cut(place, tree.tag)
        if tag in VOID:
            continue
        element = tree.add(tag, opened.elements[-1], m["attrs"])
        if tag in RAW and not m["attrs"].rstrip().endswith("/"):  # raw text up to its closing tag
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, position)
            at = position = end.start() if end else len(html)
        else:
            opened.push(tag, element)


def _surroundings(tree: Tree, nodes: list[tuple[int, str]]) -> list[bool]:
    """Of each element: whether it lies in one whose names mark it as surroundings.

    Names don't count on an element that holds most of the page's own text: that of its articles and
    main elements if they have any, comments left out. Without such text comments are the page's text.
    """
    size = len(tree.tag)
    comments = [False] * size
    for e in range(1, size):
        comments[e] = comments[tree.parent[e]] or tree.comments[e]
    held, inside = [0] * size, [0] * size
    for e, text in nodes:
        if not tree.linked[e] and not comments[e]:
            n = len(text.strip())
            held[e] += n
            inside[e] += n if tree.article[e] or tree.main[e] else 0
    for e in range(size - 1, 0, -1):
        held[tree.parent[e]] += held[e]
        inside[tree.parent[e]] += inside[e]
    mine = inside if inside[0] else held
    marked = [False] * size
    for e in range(1, size):
        if held[0]:
            own = (tree.named[e] or tree.comments[e]) and 2 * mine[e] <= mine[0]
        else:
            own = tree.named[e] and not tree.comments[e]
        marked[e] = marked[tree.parent[e]] or own
    return marked


def path_scores(tree: Tree, nodes: list[tuple[int, str]], marked: list[bool]) -> dict[int, float]:
    """The fused, smoothed ratio of each path among the nodes, times the factors of names and articles."""
    count, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    paths = [tree.path[e] for e, _ in nodes]
    for path, (e, text) in zip(paths, nodes):
        count[path] += 1
        if not tree.linked[e]:
            length[path] += len(text)
            marks[path] += len(_PUNCTUATION.findall(text))
    texts = np.array([length[p] / count[p] for p in paths])
    points = np.array([1 + marks[p] / count[p] for p in paths])
    kernel = np.array(SMOOTHING)
    smooth = [np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") for x in (texts, points)]
    fused = np.sqrt(smooth[0] * smooth[1])
    total = defaultdict(float)
    for path, (e, _), score in zip(paths, nodes, fused):
        factor = NAMED_FACTOR if marked[e] else ARTICLE_FACTOR if tree.article[e] else 1.0
        total[path] += float(score) * factor
    return {p: total[p] / count[p] for p in total}


class _Page:
    """The text nodes of a page with their scores, and sums over the nodes of any element."""

    def __init__(self, tree: Tree, nodes: list[tuple[int, str]]):
        self.tree, self.nodes = tree, nodes
        self.marked = _surroundings(tree, nodes)
        self.scores = path_scores(tree, nodes, self.marked)
        sizes = [len(t) for _, t in nodes]
        loose = [0 if tree.linked[e] else n for (e, _), n in zip(nodes, sizes)]
        total = sum(loose)
        each = [self.scores[tree.path[e]] for e, _ in nodes]
        self.mean = sum(s * n for s, n in zip(each, loose)) / total if total else 0.0
        least = THRESHOLD * self.mean
        self.content = [n > 0 and s >= least for s, n in zip(each, loose)]
        sums = lambda x: [0, *accumulate(x)]
        self._text, self._links = sums(loose), sums(n - k for n, k in zip(sizes, loose))
        self._scores = sums(each)
        # The nodes of an element are a range, the elements in it as well.
        size = len(tree.tag)
        self.first, self.last, self.end = [len(nodes)] * size, [-1] * size, list(range(size))
        self.holds, self.structured = [False] * size, [t in _STRUCTURES for t in tree.tag]
        for k, (e, _) in enumerate(nodes):
            self.first[e], self.last[e] = min(self.first[e], k), k
            self.holds[e] = self.holds[e] or self.content[k]
        for e in range(size - 1, 0, -1):
            up = tree.parent[e]
            self.first[up], self.last[up] = min(self.first[up], self.first[e]), max(self.last[up], self.last[e])
            self.end[up] = max(self.end[up], self.end[e])
            self.holds[up] = self.holds[up] or self.holds[e]
            self.structured[up] = self.structured[up] or self.structured[e]

    def inside(self, element: int, container: int) -> bool:
        return container <= element <= self.end[container]

    def _range(self, sums: list, element: int, without: int | None = None) -> float:
        total = sums[self.last[element] + 1] - sums[self.first[element]] if self.last[element] >= 0 else 0
        return total - (self._range(sums, without) if without is not None else 0)

    def flows(self, element: int, without: int | None = None) -> bool:
        """Whether an element holds more text than links."""
        return self._range(self._text, element, without) >= self._range(self._links, element, without)

    def near(self, element: int, without: int | None = None) -> bool:
        """Whether the mean score of an element's nodes is not far below the page's."""
        number = self.last[element] - self.first[element] + 1
        if without is not None:
            number -= self.last[without] - self.first[without] + 1
        return number <= 0 or self._range(self._scores, element, without) >= WEAK * self.mean * number


def _around(tree: Tree, elements: list[int]) -> int:
    """The innermost element around all: that around the first and the last opened."""
    low, high = min(elements), max(elements)
    while low != high:
        low, high = sorted((low, tree.parent[high]))
    return low


def _container(page: _Page) -> tuple[int, set[int]]:
    """The article's element, and the numbers of the nodes in front of it that belong to it.

    The element lies around all content nodes. It is the article element around them if there is
    one; else it grows to the one that has the h1 among its children; else, unless it begins with a
    heading, as far as what it gains is text with scores not far below. If it has no h1, the
    text from the h1 before it belongs to it as well.
    """
    tree = page.tree
    container = _around(tree, [e for (e, _), c in zip(page.nodes, page.content) if c])
    while tree.tag[container] in _LEAVES:
        container = tree.parent[container]
    # The elements that each h1 (and each heading) is in, and the ranges of nodes that are an h1.
    heads = [e for e, t in enumerate(tree.tag) if t == "h1" and page.last[e] >= 0]
    titled = set()
    for e in heads:
        up = tree.parent[e]
        while tree.tag[up] in ("header", "hgroup"):
            up = tree.parent[up]
        titled.add(up)
    has_title = lambda c: any(page.inside(e, c) for e in heads)
    article, up = 0, container
    while up:
        article = up if tree.tag[up] == "article" else article
        up = tree.parent[up]
    if article:
        container = article
    elif not has_title(container):
        up = tree.parent[container]
        while tree.tag[up] not in _ROOTS and up not in titled:
            up = tree.parent[up]
        if tree.tag[up] not in _ROOTS:
            container = up
        else:
            heading, e = False, page.nodes[page.first[container]][0]
            while e > container:
                heading, e = heading or tree.tag[e] in _HEADINGS, tree.parent[e]
            while not heading and tree.tag[container] not in _ROOTS:
                up = tree.parent[container]
                if tree.tag[up] in _ROOTS or not (page.flows(up, container) and page.near(up, container)):
                    break
                container = up
    before: set[int] = set()
    if not has_title(container):
        start, scope = page.first[container], container
        while scope and tree.tag[scope] != "main":
            scope = tree.parent[scope]
        # The heading of an article lies in the same main element.
        earlier = [e for e in heads if page.last[e] < start and page.inside(e, scope)] if scope or not article else []
        if earlier:
            head = range(page.first[earlier[-1]], page.last[earlier[-1]] + 1)
            before = {*head, *(k for k in range(head.stop, start) if not tree.linked[page.nodes[k][0]])}
    return container, before


def _kept(page: _Page) -> set[int]:
    """The numbers of the nodes that are the page's main text."""
    tree = page.tree
    if not any(page.content):
        return {k for k, (e, _) in enumerate(page.nodes) if not page.marked[e]}
    container, before = _container(page)
    # The branch of an element without content: its outermost ancestor without.
    branch = [0] * len(tree.tag)
    for e in range(1, len(tree.tag)):
        if not page.holds[e]:
            branch[e] = e if page.holds[tree.parent[e]] else branch[tree.parent[e]]
    stays: dict[int, bool] = {0: True}
    kept = set()
    for k, (e, _) in enumerate(page.nodes):
        if k in before:
            if not page.marked[e]:
                kept.add(k)
            continue
        if not page.inside(e, container):
            continue
        if page.content[k]:
            kept.add(k)
        elif not page.marked[e]:
            b = branch[e]
            if b not in stays:
                box, flows = tree.tag[b] in _BOXES, page.flows(b)
                stays[b] = (flows or not (box or tree.tag[b] in _LISTS)) and (not box or page.structured[b] or page.near(b))
            if stays[b]:
                kept.add(k)
    return kept


def main_text(html: str | None) -> str:
    """The main text of a page; empty for a null, blank or textless one."""
    if not html:
        return ""
    tree, found = parse(html)
    # Blank text keeps words apart but is no node.
    pieces, nodes = [], []
    for e, text in found:
        if text is None:
            pieces.append((-1, None))
        elif not tree.dropped[e]:
            text = unescape(text)
            blank = text.isspace() or not text
            pieces.append((-1 if blank else len(nodes), text))
            if not blank:
                nodes.append((e, text))
    if not nodes:
        return ""
    kept = _kept(_Page(tree, nodes))
    out, run = [], []
    for number, text in [*pieces, (-1, None)]:
        if text is None:
            if run:
                out.append(" ".join("".join(run).split()))
                run = []
        elif number < 0 or number in kept:
            run.append(text)
    return " ".join(b for b in out if b)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every row, from its whole html.

    A null html is empty; repeated rows each give a row; an empty table gives none. Texts of any length
    are read whole, in time and memory linear in their length; a batch holds one page at a time beside its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = only(pages, "page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
