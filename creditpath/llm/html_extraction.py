"""Main text of web pages by wrapper induction.

Pages of a host that show the same sections are a layout; its shortest page is the
pattern. Every page's tree is aligned with the pattern by simple tree matching: children
in order, tag by tag, as many nodes as can be, equal texts first. A node whose aligned
text is nearly always the same is template, the slots that vary are content, and so is
constant text between them. Elements whose role is stated in the markup (menus, forms,
adverts, comments and so on) are no content, unless they wrap it; an article or main
element bounds it only in layouts of a single page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.llm.common import hinted, small_enough, stash

# Fewest different pages of a layout that make a template.
MIN_PAGES = 2
# A constant text is on so many pages (all, if the layout has fewer), on such a share of the layout's
# pages, and on such a share of the pages that have a node aligned with its own.
ENOUGH, LEAST, SHARE = 3, 0.05, 0.9
# Most layouts, and most nodes of their patterns, that are broadcast.
BROADCAST_LAYOUTS = 20_000
# How the same alignment is computed: levels by calls (deeper ones by a stack), pairs of two child lists whose table is
# held at once (of longer lists its rows are made again on the way back), scores held.
LEVELS, LEAF_PAIRS, KNOWN = 60, 1_000_000, 500_000
# Child lists with more pairs are aligned by rows of an array.
SMALL_PAIRS = 1_000
# In these, a child that holds leaves only is scored at once with all such children of the other list that hold at most
# ``FLAT_WIDTH`` leaves, when there are so many of them.
FLAT, FLAT_WIDTH = 16, 64
# Share of a page's varying text that its core, the least node around it, holds.
CORE = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Text of these is no part of a page's words.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
APART = frozenset("nav header footer aside form menu dialog button select textarea fieldset label input".split())
# Of these, those that may be drawn around a whole page.
WRAPS = frozenset("form fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar note".split())
# Words of a class or id that state a part which is no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation"
    " breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments"
    " disqus respond reply replies widget toolbar pagination pager skip copyright legal disclaimer".split()
)
WORD = re.compile("[a-z0-9]+")
# Start tags that end an open element of these kinds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = ({"p"}, set("div article section main td th li blockquote button form".split()))


class Node:
    __slots__ = ("tag", "marks", "parts")

    def __init__(self, tag: str, marks: frozenset[str] = frozenset()):
        self.tag, self.marks, self.parts = tag, marks, []


class _Builder(HTMLParser):
    """A tree from any markup: missing end tags are supplied, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _end_until(self, tags: set[str], bounds: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in bounds:
                return
            if self.open[at].tag in tags:
                del self.open[at:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in ENDS:
            self._end_until(*ENDS[tag])
        elif tag not in INLINE:
            self._end_until(*ENDS_P)
        marks = set()
        for name, value in attrs:
            if name in ("class", "id") and value:
                marks.update(MARKS.intersection(WORD.findall(value.lower())))
            elif name == "role" and value and value.lower().strip() in ROLES:
                marks.add("form" if value.lower().strip() == "form" else "role")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                marks.add("hidden")
            elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                marks.add("hidden")
        node = Node(tag, frozenset(marks))
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in ("html", "body"):
            self.open.pop()

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parsed(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _is_apart(node: Node) -> bool:
    return node.tag in HIDDEN or node.tag in APART or bool(node.marks)


def _is_firm(node: Node) -> bool:
    """Whether an element is apart by its tag or role, which no wrapper of a page's content has."""
    return node.tag in HIDDEN or (node.tag in APART and node.tag not in WRAPS) or "role" in node.marks or "hidden" in node.marks


def own_text(node: Node) -> tuple[str, int]:
    """The text of a node with that of the inline elements inside it, and how many of its characters are no links."""
    said: list[str] = []
    plain, links = 0, 0
    stack = [(node, iter(node.parts))]
    while stack:
        for part in stack[-1][1]:
            if isinstance(part, str):
                said.append(part)
                plain += 0 if links else len(part.strip())
            elif part.tag in INLINE and not part.marks:
                said.append(" " if part.tag == "br" else "")
                links += part.tag == "a"
                stack.append((part, iter(part.parts)))
                break
        else:
            done, _ = stack.pop()
            links -= bool(stack) and done.tag == "a"
    return " ".join("".join(said).split()), plain


# A node in page order: (node, place of its parent, key of its text, characters of its text outside links).
Row = tuple[Node, int, int, int]


def outline(root: Node) -> list[Row]:
    """All shown nodes of a page; inline elements and nodes without text have key 0."""
    rows: list[Row] = []
    stack = [(root, -1)]
    while stack:
        node, up = stack.pop()
        if node.tag in HIDDEN or "hidden" in node.marks:
            continue
        key, plain = 0, 0
        if node.tag not in INLINE:
            text, plain = own_text(node)
            key = _signed(xxhash.xxh64_intdigest(text)) or 1 if text else 0
        place = len(rows)
        stack.extend([(child, place) for child in reversed(node.parts) if isinstance(child, Node)])
        rows.append((node, up, key, plain))
    return rows


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


class Shape:
    """A page's block elements as a tree: parent, label (tag and marks) and text key of each, parents first."""

    def __init__(self, ups: list[int], labels: list[int], keys: list[int]):
        self.ups, self.labels, self.keys = ups, labels, keys
        self.children: list[list[int]] = [[] for _ in ups]
        for at in range(1, len(ups)):
            self.children[ups[at]].append(at)
        # Of each subtree, an identity and the score of a match with its like.
        self.same, self.full = [0] * len(ups), [0] * len(ups)
        for at in range(len(ups) - 1, -1, -1):
            below = self.children[at]
            self.same[at] = hash((labels[at], keys[at], *(self.same[c] for c in below)))
            self.full[at] = 1 + (keys[at] != 0) + sum(self.full[c] for c in below)


@lru_cache(10_000)
def _label(tag: str, marks: frozenset[str]) -> int:
    return _signed(xxhash.xxh64_intdigest(" ".join([tag, *sorted(marks)])))


def shape_of(rows: list[Row]) -> tuple[Shape, list[int]]:
    """The shape of an outline, and the place in the outline of each of its nodes."""
    at: list[int] = []
    ups: list[int] = []
    # The shape's node at or around each row.
    around: list[int] = []
    for place, (node, up, _, _) in enumerate(rows):
        outer = around[up] if up >= 0 else -1
        if node.tag in INLINE:
            around.append(outer)
            continue
        around.append(len(at))
        at.append(place)
        ups.append(outer)
    labels = [_label(rows[p][0].tag, rows[p][0].marks) for p in at]
    return Shape(ups, labels, [rows[p][2] for p in at]), at


class _Matching:
    """Simple tree matching of two shapes: a node scores 1, and 1 more for the same text."""

    def __init__(self, one: Shape, two: Shape):
        self.one, self.two = one, two
        # Scores by the identities of both subtrees; one that is dropped is made again.
        self.known: dict[tuple[int, int], int] = {}
        self.level = 0

    def score(self, i: int, j: int) -> int:
        one, two = self.one, self.two
        if one.labels[i] != two.labels[j]:
            return 0
        if one.same[i] == two.same[j]:
            return one.full[i]
        if not one.children[i] or not two.children[j]:
            return 1 + (one.keys[i] == two.keys[j] != 0)
        found = self.known.get((one.same[i], two.same[j]))
        if found is None:
            found = self._scored(i, j) if self.level < LEVELS else self._from_below(i, j)
        return found

    def _scored(self, i: int, j: int) -> int:
        one, two = self.one, self.two
        self.level += 1
        found = 1 + (one.keys[i] == two.keys[j] != 0) + sum(s for _, _, s in self.paired(one.children[i], two.children[j]))
        self.level -= 1
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[one.same[i], two.same[j]] = found
        return found

    def _from_below(self, i: int, j: int) -> int:
        """The same without calls inside calls: the pairs of inner children are scored first."""
        one, two = self.one, self.two
        found = 0
        stack = [(i, j, False)]
        while stack:
            x, y, ready = stack.pop()
            if ready:
                found = self._scored(x, y)
            elif (one.same[x], two.same[y]) not in self.known or not stack:
                stack.append((x, y, True))
                start, end = self._equal_ends(one.children[x], two.children[y])
                left = [c for c in one.children[x][start : len(one.children[x]) - end] if one.children[c]]
                right = [d for d in two.children[y][start : len(two.children[y]) - end] if two.children[d]]
                stack += [
                    (c, d, False)
                    for c in left
                    for d in right
                    if one.labels[c] == two.labels[d] and one.same[c] != two.same[d] and (one.same[c], two.same[d]) not in self.known
                ]
        return found

    def _equal_ends(self, a: list[int], b: list[int]) -> tuple[int, int]:
        """How many children at the beginning and at the end of both lists are equal."""
        one, two = self.one, self.two
        start, end = 0, 0
        least = min(len(a), len(b))
        while start < least and one.same[a[start]] == two.same[b[start]]:
            start += 1
        while end < least - start and one.same[a[-1 - end]] == two.same[b[-1 - end]]:
            end += 1
        return start, end

    def paired(self, a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
        """The best pairs of two child lists, in order: (child, child, score)."""
        full = self.one.full
        start, end = self._equal_ends(a, b)
        pairs = [(i, j, full[i]) for i, j in zip(a[:start], b[:start])]
        if start + end < min(len(a), len(b)):
            pairs += self._best(a[start : len(a) - end], b[start : len(b) - end])
        return pairs + [(i, j, full[i]) for i, j in zip(a[len(a) - end :], b[len(b) - end :])]

    def _best(self, a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
        """The alignment of the highest score, by dynamic programming over both lists.

        The table is made in blocks of rows. Of each only the first row is kept; on the way
        back through the table a block is made again, so the pairs are those of a whole table.
        """
        m, n = len(a), len(b)
        if m * n <= SMALL_PAIRS:
            height, block = m, self._small
        else:
            height, block = max(LEAF_PAIRS // n, isqrt(m)), self._by_rows(b)
        tops = [None]
        for low in range(0, m, height):
            scores, best = block(a[low : low + height], b, tops[-1])
            tops.append(best[-1])
        pairs = []
        for low in range((m - 1) // height * height, -1, -height):
            if low + height < len(a):
                if not n:
                    break
                scores, best = block(a[low : low + height], b, tops[low // height])
            while m > low and n:
                here = best[m - low]
                if here[n] == here[n - 1]:
                    n -= 1
                elif here[n] == best[m - low - 1][n]:
                    m -= 1
                else:
                    m, n = m - 1, n - 1
                    pairs.append((a[m], b[n], int(scores[m - low][n])))
        return pairs[::-1]

    def _small(self, a: list[int], b: list[int], _top: None) -> tuple[list, list]:
        """The scores of all pairs and the best sums of all beginnings, cell by cell."""
        one, two = self.one, self.two
        others = [(j, two.labels[j], two.keys[j], bool(two.children[j])) for j in b]
        scores, best = [], [[0] * (len(b) + 1)]
        for i in a:
            label, key, inner = one.labels[i], one.keys[i], bool(one.children[i])
            row, above, sums, last = [], best[-1], [0], 0
            for n, (j, other, text, below) in enumerate(others):
                if label != other:
                    found = 0
                elif inner and below:
                    found = self.score(i, j)
                else:
                    found = 2 if key == text and key else 1
                row.append(found)
                last = max(last, above[n + 1], above[n] + found)
                sums.append(last)
            scores.append(row)
            best.append(sums)
        return scores, best

    def _by_rows(self, b: list[int]):
        """The same for long lists, a row at a time, going on from the row ``top``."""
        one, two = self.one, self.two
        labels = np.array([two.labels[j] for j in b])
        keys = np.array([two.keys[j] for j in b])
        inner = [n for n, j in enumerate(b) if two.children[j]]
        flat = [n for n in inner if len(two.children[b[n]]) <= FLAT_WIDTH and _is_flat(two, b[n])]
        flat = flat if len(flat) >= FLAT else []
        other = sorted(set(inner) - set(flat))
        width = max((len(two.children[b[n]]) for n in flat), default=0)
        held = [[two.children[b[n]][w] if w < len(two.children[b[n]]) else -1 for n in flat] for w in range(width)]
        leaf_labels = np.array([[two.labels[c] if c >= 0 else 0 for c in at] for at in held])
        leaf_keys = np.array([[two.keys[c] if c >= 0 else 0 for c in at] for at in held])
        is_leaf = np.array([[c >= 0 for c in at] for at in held])

        def flat_scores(i: int) -> np.ndarray:
            """The best sums of the children of ``i`` and of each of ``flat``."""
            last = np.zeros((width + 1, len(flat)), dtype=np.int32)
            for c in one.children[i]:
                like = (leaf_labels == one.labels[c]) & is_leaf
                found = last[:-1] + like + (like & (leaf_keys == one.keys[c]) & (one.keys[c] != 0))
                last[1:] = np.maximum.accumulate(np.maximum(last[1:], found), axis=0)
            return last[-1]

        def block(a: list[int], b: list[int], top: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            scores = np.zeros((len(a), len(b)), dtype=np.int32)
            best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
            if top is not None:
                best[0] = top
            for m, i in enumerate(a):
                row, like = scores[m], labels == one.labels[i]
                np.add(like, like & (keys == one.keys[i]) & (one.keys[i] != 0), out=row, dtype=np.int32)
                if one.children[i]:
                    at_once = flat if _is_flat(one, i) else []
                    if at_once:
                        row[at_once] += flat_scores(i) * like[at_once]
                    for n in other if at_once else inner:
                        if row[n]:
                            row[n] = self.score(i, b[n])
                np.maximum.accumulate(np.maximum(best[m, 1:], best[m, :-1] + row), out=best[m + 1, 1:])
            return scores, best

        return block


def _is_flat(shape: Shape, at: int) -> bool:
    return not any(shape.children[c] for c in shape.children[at])


def aligned(page: Shape, pattern: Shape) -> list[tuple[int, int]]:
    """The pairs of nodes (page, pattern) that simple tree matching aligns, parents first."""
    matching = _Matching(page, pattern)
    pairs = [(0, 0)] if page.labels[0] == pattern.labels[0] else []
    for i, j in pairs:
        pairs.extend((x, y) for x, y, _ in matching.paired(page.children[i], pattern.children[j]))
    return pairs


class Wrapper:
    """A layout's pattern and the text key of each of its constant nodes."""

    def __init__(self, pattern: Shape, constant: dict[int, int]):
        self.pattern, self.constant = pattern, constant

    def constants(self, rows: list[Row]) -> set[int]:
        """The places in an outline of the nodes that are template."""
        if not self.constant:
            return set()
        shape, at = shape_of(rows)
        return {at[i] for i, j in aligned(shape, self.pattern) if shape.keys[i] and self.constant.get(j) == shape.keys[i]}


def _collect(node: Node, constant: set[int], skipped: set[int], out: list[str]) -> None:
    """Append the blocks of a subtree in page order."""
    said: list[str] = []

    def flush() -> None:
        block = " ".join("".join(said).split())
        said.clear()
        if block:
            out.append(block)

    # (iterator, whether the end of it ends a block); no recursion, markup may be deep.
    stack = [(iter(node.parts), id(node) not in constant, True)]
    while stack:
        parts, speaks, is_block = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if speaks:
                    said.append(part)
                continue
            if part.tag in HIDDEN or "hidden" in part.marks or id(part) in skipped:
                if part.tag not in HIDDEN and part.tag not in INLINE:
                    flush()
                continue
            if part.tag == "br":
                said.append(" ")
                continue
            if part.tag in VOID:
                if part.tag == "hr":
                    flush()
                continue
            inline = part.tag in INLINE
            if not inline:
                flush()
            stack.append((iter(part.parts), speaks if inline else id(part) not in constant, not inline))
            break
        else:
            if is_block:
                flush()
            stack.pop()


def _regions(rows: list[Row], skipped: set[int]) -> list[Node]:
    """The outermost main and article elements outside of the skipped parts, in page order."""
    inside: list[bool] = []
    found: list[Node] = []
    for node, up, *_ in rows:
        closed = up >= 0 and inside[up]
        if not closed and id(node) not in skipped and node.tag in ("main", "article"):
            found.append(node)
            closed = True
        inside.append(closed or id(node) in skipped)
    return found


def _chief(rows: list[Row], constant: set[int]) -> tuple[int | None, list[int]]:
    """The place of the main or else article element with most varying text, and every node's amount of such text.

    What is in a menu, footer and so on counts for none of the nodes around it.
    """
    weights = [0 if id(node) in constant else plain for node, _, _, plain in rows]
    for at in range(len(rows) - 1, 0, -1):
        if not _is_firm(rows[at][0]):
            weights[rows[at][1]] += weights[at]
    firm: list[bool] = []
    best: dict[str, int] = {}
    for at, (node, up, *_) in enumerate(rows):
        firm.append(_is_firm(node) or (up >= 0 and firm[up]))
        if node.tag in ("main", "article") and not firm[at] and weights[at] > weights[best.get(node.tag, at)] - (node.tag not in best):
            best[node.tag] = at
    return best.get("main", best.get("article")), weights


def _skipped(rows: list[Row], chief: int | None, weights: list[int]) -> set[int]:
    """The ids of the elements that are no content with all they hold.

    An element that is or holds the chief main or article, or on a page without one most
    of the varying text, is a wrapper whatever its words say.
    """
    around = set()
    while chief is not None and chief >= 0:
        around.add(chief)
        chief = rows[chief][1]
    apart = {at for at, row in enumerate(rows) if _is_apart(row[0])}
    if not around:
        around = {at for at in apart if not _is_firm(rows[at][0]) and 2 * weights[at] > weights[0]}
    return {id(rows[at][0]) for at in apart - around}


def _copied(rows: list[Row], constant: set[int], chief: int | None, weights: list[int]) -> set[int]:
    """The ids of the nodes of articles that are copied on their host, whose constant text is content.

    These are articles whose own h1 is constant, and the chief element when nothing varies in it.
    """
    of: list[int] = []
    same = set() if chief is None or weights[chief] else {chief}
    for at, (node, up, *_) in enumerate(rows):
        outer = of[up] if up >= 0 else -1
        of.append(at if outer < 0 and (node.tag == "article" or at in same) else outer)
        if node.tag == "h1" and id(node) in constant and rows[of[at]][0].tag == "article" and of[at] >= 0:
            same.add(of[at])
    return {id(row[0]) for row, article in zip(rows, of) if article in same}


def _enclosed(rows: list[Row], constant: set[int], chief: int | None, weights: list[int], skipped: set[int]) -> set[int]:
    """The ids of the constant nodes of the page's core that have varying text of the core before and after them.

    The core is the chief element, or the least node that holds ``CORE`` of the varying text.
    """
    core = chief
    if core is None:
        core = max(at for at, weight in enumerate(weights) if weight >= CORE * weights[0])
    inside = [False] * len(rows)
    varying: list[int] = []
    for at, (node, up, key, _) in enumerate(rows):
        inside[at] = (at == core or (up >= 0 and inside[up])) and (at == core or id(node) not in skipped)
        if inside[at] and key and id(node) not in constant:
            varying.append(at)
    if not varying:
        return set()
    return {id(rows[at][0]) for at in range(varying[0], varying[-1]) if inside[at]}


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The blocks of a page's content, joined by an empty line; an empty page has no text.

    ``wrapper`` is that of the page's layout. Without it, main and article elements bound
    the content where there are some.
    """
    root = parsed(html)
    rows = outline(root)
    constant = {id(rows[at][0]) for at in wrapper.constants(rows)} if wrapper else set()
    chief, weights = _chief(rows, constant)
    skipped = _skipped(rows, chief, weights)
    if constant:
        constant -= _copied(rows, constant, chief, weights)
        constant -= _enclosed(rows, constant, chief, weights, skipped)
    blocks: list[str] = []
    for region in (_regions(rows, skipped) if wrapper is None else []) or [root]:
        _collect(region, constant, skipped, blocks)
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return found


def layout_of(url: Column, html: Column) -> Column:
    """A hash of the host, and of the section elements and the block ids without digits on the page, each once in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(nav|header|footer|aside|main|article|section|form)[\s/>]"), F.lit(1))
    ids = F.regexp_extract_all(html, F.lit(r"""(?i)<div\s(?:[^>]*\s)?id\s*=\s*["']?([a-z_-]+)["'\s>]"""), F.lit(1))
    return F.xxhash64(host_of(url), F.array_distinct(F.transform(tags, F.lower)), F.array_distinct(ids))


def patterns(shown: DataFrame) -> DataFrame:
    """The shape of the shortest page of each layout of ``shown`` (layout, html) that has different pages."""
    each = shown.select("layout", F.struct(F.length("html").alias("long"), F.xxhash64("html").alias("hash")).alias("page"))
    ends = each.groupBy(F.col("layout").alias("_of")).agg(F.min("page").alias("least"), F.max("page").alias("most"))
    ends = stash(ends.where("least.hash != most.hash").select("_of", F.col("least.hash").alias("_hash")), "patterns")
    # The shape is the page's alone, so a page that is many layouts' pattern is read once.
    hashes = hinted(ends.select("_hash").distinct())
    chosen = shown.select("html", F.xxhash64("html").alias("hash")).join(hashes, F.col("hash") == F.col("_hash"), "left_semi")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            shapes = [shape_of(outline(parsed(html.as_py())))[0] for html in part.column(0)]
            columns = [
                part.column(1),
                pa.array([s.ups for s in shapes], pa.list_(pa.int32())),
                pa.array([s.labels for s in shapes], pa.list_(pa.int64())),
                pa.array([s.keys for s in shapes], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "ups", "labels", "keys"])

    shapes = chosen.mapInArrow(batches, "hash long, ups array<int>, labels array<bigint>, keys array<bigint>")
    shapes = shapes.dropDuplicates(["hash"]).join(ends, F.col("hash") == F.col("_hash"))
    return shapes.select(F.col("_of").alias("_layout"), "ups", "labels", "keys")


def _light(found: DataFrame) -> DataFrame:
    """``found`` marked for a broadcast when its layouts and the nodes of their patterns are few."""
    light = small_enough(found, BROADCAST_LAYOUTS) and small_enough(found.select(F.explode("keys")))
    return F.broadcast(found) if light else found


class _Cache:
    """The wrappers that a task has met last, by layout."""

    def __init__(self):
        self.known: dict[int, Wrapper | None] = {}

    def of(self, layout: int, ups, labels, keys, constant=None) -> Wrapper | None:
        if layout not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            held = ups.as_py()
            pairs = {} if constant is None else {c["node"]: c["key"] for c in constant.as_py() or []}
            self.known[layout] = None if held is None else Wrapper(Shape(held, labels.as_py(), keys.as_py()), pairs)
        return self.known[layout]


def wrappers(pages: DataFrame) -> DataFrame:
    """(_layout, ups, labels, keys, constant): the pattern of each layout with at least ``MIN_PAGES`` different pages.

    ``constant`` lists node and text key of the constant nodes. All pages are aligned and
    counted; pages of the same aligned texts count once. No page is held beside another,
    and a layout's counts have one row per node before they meet.
    """
    shown = pages.where(F.length("html") > 0).select(layout_of(F.col("url"), F.col("html")).alias("layout"), "html")
    found = stash(patterns(shown), "shapes")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for part in parts:
            layouts, ids, nodes, keys = [], [], [], []
            for layout, html, *held in zip(part.column(0).to_pylist(), *part.columns[1:]):
                shape, _ = shape_of(outline(parsed(html.as_py())))
                pairs = aligned(shape, cache.of(layout, *held).pattern)
                page = _signed(xxhash.xxh64_intdigest(np.array([*shape.keys, *(n for pair in pairs for n in pair)], np.int64).tobytes()))
                layouts += [layout] * len(pairs)
                ids += [page] * len(pairs)
                nodes += [j for _, j in pairs]
                keys += [shape.keys[i] for i, _ in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (layouts, ids, nodes, keys)], ["_of", "page", "node", "key"]
            )

    both = shown.join(_light(found), F.col("layout") == F.col("_layout")).select("layout", "html", "ups", "labels", "keys")
    seen = both.mapInArrow(batches, "_of long, page long, node long, key long").distinct()
    counts = seen.groupBy("_of", "node", "key").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.when(F.col("key") != 0, F.struct("n", "key"))).alias("top")
    nodes = counts.groupBy("_of", "node").agg(F.sum("n").alias("among"), top)
    # Node 0 is the root, which every page has.
    layouts = nodes.groupBy("_of").agg(
        F.max(F.when(F.col("node") == 0, F.col("among"))).alias("pages"),
        F.collect_list(F.when(F.col("top.n") >= SHARE * F.col("among"), F.struct("node", "top.key", "top.n"))).alias("often"),
    )
    enough = F.greatest(F.least(F.lit(ENOUGH), "pages"), LEAST * F.col("pages"))
    often = F.transform(F.filter("often", lambda x: x["n"] >= enough), lambda x: F.struct(x["node"], x["key"]))
    layouts = layouts.where(f"pages >= {MIN_PAGES}").select("_of", often.alias("constant"))
    return found.join(layouts, F.col("_layout") == F.col("_of")).drop("_of")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A NULL or empty html, and a page without content, has the empty text. A NULL url
    belongs to the host without a name. Repeated rows are returned as often; layouts with
    fewer than ``MIN_PAGES`` different pages have no template. Further columns are ignored.
    """
    found = _light(stash(wrappers(pages), "wrappers"))
    rows = pages.select("page_id", "url", "html", layout_of(F.col("url"), F.coalesce("html", F.lit(""))).alias("layout"))
    rows = rows.join(found, F.col("layout") == F.col("_layout"), "left")
    rows = rows.select("page_id", "url", "html", "layout", "ups", "labels", "keys", "constant")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for part in parts:
            each = zip(part.column(2), part.column(3).to_pylist(), *part.columns[4:])
            texts = [main_text(html.as_py(), cache.of(layout, *held)) for html, layout, *held in each]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    done = rows.mapInArrow(batches, f"page_id {kind}, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
