"""Main text of HTML pages by tree scoring.

A page's blocks (paragraphs and other runs of text between block borders) give points for length and commas to their
ancestors, less with distance; a node's points are discounted by its link density. Blocks below an element whose class, id
or role names a menu, header, footer, sidebar, notice, advert, form or comments give less. The node with most points is
kept, or the article that it lies in; siblings that also look like text stay, and of several articles side by side those
with at least SHARE of the longest one's text.

Inside what is kept, an element with such a name goes if it isn't above the best node and holds less than SMALL of the
page's text outside links; comments go whatever they hold. Of headers, the headings stay. Menus, footers, scripts and the
like go by their tags, and so do lists that are mostly links.

Null html, html without text, and pages without any text outside such parts give the empty text. Cut-off pages end
where they end: an unfinished tag is dropped, an unfinished reference stays as it is. Nesting may be of any depth, and
work is linear in the page. Nothing is capped. Repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas button select textarea nav aside footer menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag closes an open one of these first, if no border tag is between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words in class, id or role that name what isn't the article: any such part, reader comments, headers. Fixed values.
BAD = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies "
    "dialog disclaimer footer footnav form gdpr hidden login menu menubar message modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination popup promo promoted promotion related remark search share sharing sidebar signup skyscraper social "
    "sponsor sponsored subscribe subscription toolbar topbar widget warning".split()
)
COMMENTS = frozenset("comment comments discussion disqus replies reply respond shoutbox".split())
HEADERS = frozenset("header masthead".split())
GOOD = frozenset("article body content entry main post story text".split())
WORSE = 0.3
SMALL = 0.4
SHARE = 0.2
# What may border or close another element; all else that is open between them is inline.
_HOLDERS = BLOCKS | frozenset("button object select option".split())
_STOPS = frozenset("div section article body main".split())


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _words(attributes: dict[str, str]) -> set[str]:
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    return {w.lower() for w in _MARK.findall(named)} | {w.lower() for w in named.split()}


class Tree:
    """Nodes in order of their start tags; a subtree is a range of nodes. Blocks are [node, text, letters in links].
    `bad` says what a node's names make of it: "", "bad", "comments" or "header"."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped, self.bad, self.good = ["#root"], [-1], [False], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.open, self.holders, self.count = [0], [0], Counter()
        run, links = [], 0
        at, last = 0, len(source)

        def finish() -> None:
            nonlocal run, links
            if run:
                text = _SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
                if text:
                    node = next(n for n in reversed(self.holders) if self.tag[n] in BLOCKS or n == 0)
                    self.blocks.append((node, text, min(links, len(text))))
            run, links = [], 0

        while at < last:
            m = _TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                if m[0][0] != "<" or m[0] == "<":
                    if not self.dropped[self.open[-1]]:
                        run.append(m[0])
                        links += len(m[0]) if self.count["a"] else 0
                continue
            name = name.lower()
            if name in BLOCKS:
                finish()
            elif name in ("br", "img"):
                run.append(" ")
            if m[1]:
                if self.count[name]:
                    while self.tag[self.open[-1]] != name:
                        self._pop()
                    self._pop()
                continue
            if name in BLOCKS:
                self._close({"p"}, {"table", "button", "object"})
            if name in CLOSES:
                self._close(*CLOSES[name])
            if name in VOID:
                continue
            attributes = _attributes(m[3]) if m[3] else {}
            above = self.open[-1]
            words = _words(attributes) if attributes else set()
            self.dropped.append(self.dropped[above] or name in DROPPED or _is_hidden(name, attributes))
            self.bad.append(_named(name, words))
            self.good.append(not words.isdisjoint(GOOD))
            self.tag.append(name)
            self.parent.append(above)
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = found.start() if found else last
                if name == "noscript" or name == "title":
                    self.dropped[-1] = True
            self.open.append(len(self.tag) - 1)
            self.count[name] += 1
            if name in _HOLDERS:
                self.holders.append(len(self.tag) - 1)
        finish()

    def _pop(self) -> None:
        node = self.open.pop()
        self.count[self.tag[node]] -= 1
        if self.holders[-1] == node:
            self.holders.pop()

    def _close(self, names: set[str], borders: set[str]) -> None:
        if not any(self.count[n] for n in names):
            return
        for node in reversed(self.holders):
            tag = self.tag[node]
            if tag in names:
                while self.open[-1] != node:
                    self._pop()
                self._pop()
                return
            if tag in borders or tag in _STOPS:
                return


def _is_hidden(name: str, attributes: dict[str, str]) -> bool:
    if not attributes or name in ("html", "body"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def _named(name: str, words: set[str]) -> str:
    if name in ("html", "body"):
        return ""
    if words & COMMENTS:
        return "comments"
    if name in ("article", "main"):
        return "bad" if words & {"related", "promo", "sponsored", "ad"} else ""
    if name == "header" or words & HEADERS:
        return "header"
    return "bad" if name == "form" or words & BAD else ""


def node_points(tree: Tree) -> list[float]:
    """Points that each node gets from the blocks in it."""
    points, below = [0.0] * len(tree.tag), [0] * len(tree.tag)
    for n in range(1, len(tree.tag)):
        below[n] = below[tree.parent[n]] + bool(tree.bad[n])
    for node, text, links in tree.blocks:
        tag = tree.tag[node]
        if tree.dropped[node] or tag in HEADINGS:
            continue
        worth = 1 + text.count(",") + text.count("،") + text.count("、") + text.count("，") + min(len(text) / 100, 3) if len(text) >= 25 else 0.2
        worth *= (1 - links / len(text)) * WORSE ** min(2, below[node])
        above, share = (tree.parent[node] if tag in PARAGRAPHS else node), 1.0
        for level in range(5):
            if above < 0:
                break
            points[above] += worth * share
            above, share = tree.parent[above], 1 / (2 if level == 0 else 3 * (level + 1))
    return points


def main_text(source: str | None) -> str:
    """The text of the article of a page; empty if there is none."""
    if not source:
        return ""
    tree = Tree(source)
    size, tag, parent = len(tree.tag), tree.tag, tree.parent
    letters, linked, points = [0] * size, [0] * size, node_points(tree)
    for node, text, links in tree.blocks:
        if not tree.dropped[node]:
            letters[node] += len(text)
            linked[node] += links
    for n in range(size - 1, 0, -1):
        letters[parent[n]] += letters[n]
        linked[parent[n]] += linked[n]
    density = [linked[n] / letters[n] if letters[n] else 0.0 for n in range(size)]
    plain = [letters[n] - linked[n] for n in range(size)]
    scores = [
        0.0 if points[n] <= 0 or tree.dropped[n] else (points[n] + (5 if tag[n] in ("article", "main") else 0) + (2 if tree.good[n] else 0)) * (1 - density[n])
        for n in range(size)
    ]
    best = max(range(size), key=lambda n: (scores[n], -n))
    if scores[best] <= 0:
        best = 0
    line, n = set(), best
    while n >= 0:
        line.add(n)
        n = parent[n]
    # What goes: dropped elements, and those with a bad name that aren't above the best node.
    gone, header = [False] * size, [False] * size
    for n in range(1, size):
        bad = tree.bad[n] if n not in line else ""
        gone[n] = gone[parent[n]] or tree.dropped[n] or bad == "comments" or bad == "bad" and plain[n] < SMALL * plain[0]
        header[n] = header[parent[n]] or bad == "header"
    kept = _kept(tree, best, scores, letters, plain, density, gone)
    whole = tag[min(kept)] in ("#root", "html", "body")
    inside, skip = [False] * size, [False] * size
    inside[0] = 0 in kept
    for n in range(1, size):
        inside[n] = inside[parent[n]] or n in kept
        menu = tag[n] in ("ul", "ol", "dl", "table", "div", "section", "p") and linked[n] > 0 and density[n] > (0.9 if tag[n] == "p" else 0.6) and n not in kept
        skip[n] = skip[parent[n]] or gone[n] or menu
    fits = lambda n: inside[n] and not skip[n] and (not header[n] or tag[n] in HEADINGS and not whole)
    return "\n".join(text for node, text, _ in tree.blocks if fits(node))


def _kept(tree: Tree, best: int, scores: list[float], letters: list[int], plain: list[int], density: list[float], gone: list[bool]) -> set[int]:
    """The best node or its article, with those beside it that also are text."""
    tag, parent, size = tree.tag, tree.parent, len(tree.tag)
    above = best
    while above > 0 and tag[above] != "article":
        above = parent[above]
    if above > 0:
        beside = [n for n in range(1, size) if tag[n] == "article" and parent[n] == parent[above] and not gone[n] and density[n] < 0.5]
        least = SHARE * max(plain[n] for n in [above, *beside])
        return {above, *(n for n in beside if plain[n] >= least)}
    kept = {best}
    articles = [n for n in range(best + 1, size) if tag[n] == "article" and not gone[n] and letters[n]] if best else []
    if best and best in {parent[n] for n in articles}:
        own = [n for n in articles if parent[n] == best]
        least = SHARE * max(plain[n] for n in own)
        for n in own:
            gone[n] = gone[n] or plain[n] < least
        for n in range(best + 1, size):
            gone[n] = gone[n] or gone[parent[n]]
    for n in range(parent[best] + 1, size) if best else ():
        if parent[n] == parent[best] and n != best and not gone[n] and letters[n]:
            text_like = tag[n] in PARAGRAPHS and letters[n] > 80 and density[n] < 0.25
            if text_like or scores[n] >= max(4.0, 0.2 * scores[best]) or tag[n] == "h1" and density[n] < 0.5:
                kept.add(n)
    return kept


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
