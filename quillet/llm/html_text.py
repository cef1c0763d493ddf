"""Main text of web pages by composite text density.

Every node of a page's tree gets its link-adjusted characters per tag (composite text density, Sun, Song and Liao,
2011); a node's density sum is that of its children. Of the nodes that hold blocks, the subtree of the largest sum is
the article; the least density on the path from the body down to it is the threshold above which other subtrees count
as well. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by their element,
role, class or id, count in densities but are never chosen. Pages are parsed one by one in Arrow batches; no row
meets another, so nothing is shuffled.

Defined cases: null or empty html, or a page without text outside such parts: empty text. Unclosed and misplaced
tags are closed as browsers do, about; a tag without its end takes the rest of the page; nesting beyond 512 levels
stays at that level. Repeated rows and null ids are pages each for itself. Whole pages count, of any length. Extra
columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, small_batches

DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
CELL = frozenset(["td", "th"])
#: What an element of this name ends when it starts, and where the search for that stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEAD = frozenset("base link meta noscript script style template title".split())
#: Parts of a page that are no article: by element, by role, and by words of class or id.
NOISE_TAG = frozenset("nav aside footer form head script style textarea title iframe noembed noframes noscript template object svg canvas button select option input dialog menu search".split())
NOISE_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORD = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation navigations newsletter notice notices pagination paywall popup promo promotion promotions related replies respond share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
SITE_HEADER = frozenset("header site-header page-header top-header".split())
#: Class words that say what a container has, not what it is.
LAYOUT = re.compile(r"(?:has|no|with|without)[-_]\S*")
MARKUP = re.compile(r"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT = re.compile(r"[^a-z]+")


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE_TAG or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    said = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "").lower() for a in ATTRIBUTE.finditer(attributes)}
    if "hidden" in said or re.search(r"display\s*:\s*none", said.get("style", "")) or said.get("role") in NOISE_ROLE:
        return True
    names = LAYOUT.sub(" ", f" {said.get('class', '')} {said.get('id', '')}")
    return not NOISE_WORD.isdisjoint(SPLIT.split(names)) or (not in_article and not SITE_HEADER.isdisjoint(names.split()))


class Page:
    """A page's nodes in page order (parents before children), and its text pieces: (node, text), text None at the edge of a block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise, self.chars = ["#"], [-1], [False], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._open, self._count, self._article = [0], Counter(), 0
        self._read(source)

    def _push(self, tag: str, attributes: str, void: bool) -> None:
        node, up = len(self.tag), self._open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.noise.append(self.noise[up] or _is_noise(tag, attributes, self._article > 0))
        self.chars.append(0)
        if not void and len(self._open) < DEPTH:
            self._open.append(node)
            self._count[tag] += 1
            self._article += tag in ("article", "main")

    def _pop_to(self, place: int) -> None:
        """Close the elements from this place in the stack on."""
        for node in self._open[place:]:
            self._count[self.tag[node]] -= 1
            self._article -= self.tag[node] in ("article", "main")
            if self.tag[node] in BLOCK:
                self.pieces.append((node, None))
        del self._open[place:]

    def _find(self, tags: set[str], stop: set[str] | frozenset[str] = frozenset()) -> int:
        for place in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[place]]
            if name in tags:
                return place
            if name in stop:
                break
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._count["body"]:
            return
        if self._count["head"] and tag not in HEAD:
            self._pop_to(self._find({"head"}))
        if tag in BLOCK and self._count["p"]:
            self._pop_to(self._find({"p"}))
        if tag in ENDS and any(self._count[t] for t in ENDS[tag][0]) and (place := self._find(*ENDS[tag])):
            self._pop_to(place)
        self._push(tag, attributes, tag in VOID)
        if tag in BLOCK:
            self.pieces.append((len(self.tag) - 1, None))
        elif tag == "br" or tag in CELL:
            self.pieces.append((len(self.tag) - 1, " "))

    def _end(self, tag: str) -> None:
        # An inline end tag does not close the blocks around it; the body's and the page's end wait for what follows.
        if self._count[tag] > 0 and tag not in ("html", "body") and (place := self._find({tag}, frozenset() if tag in BLOCK or tag in CELL else BLOCK)):
            self._pop_to(place)

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            text = html.unescape(text)
            if self._count["head"] and self.tag[self._open[-1]] == "head":
                self._pop_to(self._find({"head"}))
            self.chars[self._open[-1]] += sum(map(len, text.split()))
        if text:
            self.pieces.append((self._open[-1], text))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = source.find("<", at)
            if found < 0:
                self._text(source[at:])
                break
            m = MARKUP.match(source, found)
            if not m:
                # A lone sign is text, up to the next one.
                after = source.find("<", found + 1)
                self._text(source[at : after if after > 0 else size])
                at = after if after > 0 else size
                continue
            self._text(source[at:found])
            at = m.end()
            tag = (m[2] or "").lower()
            if tag and m[1]:
                self._end(tag)
            elif tag:
                self._start(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    at = end.start() if end else size
        self._pop_to(1)

    def densities(self) -> tuple[list[float], list[float], int]:
        """Composite text density and density sum of every node, and the node of the body."""
        n, body = len(self.tag), next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        chars, tags, link_chars, links = self.chars[:], [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if self.tag[i] == "a":
                link_chars[i], links[i] = chars[i], links[i] + 1
            chars[up] += chars[i]
            tags[up] += 1 + tags[i]
            link_chars[up] += link_chars[i]
            links[up] += links[i]
        share = link_chars[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t, lc = chars[i], max(1, tags[i]), link_chars[i]
            if c:
                density[i] = c / t
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                if base > 1:
                    density[i] *= math.log(max(1.0, c / max(1, lc) * t / max(1, links[i]))) / math.log(base)
            if i and not self.noise[i]:
                sums[self.parent[i]] += density[i]
        return density, sums, body

    def article(self) -> list[bool]:
        """Whether each node belongs to the article: in a chosen subtree and in none of the parts that never count."""
        density, sums, body = self.densities()
        n, best = len(self.tag), list(range(len(self.tag)))
        # An article holds blocks: the marked-up words of one long paragraph do not outweigh it.
        holds = {self.parent[i] for i in range(1, n) if self.tag[i] in BLOCK and not self.noise[i]}
        sums = [x if i in holds else 0.0 for i, x in enumerate(sums)]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not self.noise[i] and sums[best[i]] >= sums[best[up]] and sums[best[i]] > sums[up]:
                best[up] = best[i]
        least, node = density[best[body]], best[body]
        while node != body:
            node = self.parent[node]
            least = min(least, density[node])
        seen, chosen = [False] * n, [False] * n
        for i in range(body, n):
            if (i == body or seen[self.parent[i]]) and not self.noise[i] and density[i] >= least:
                seen[i] = chosen[best[i]] = True
        for i in range(1, n):
            chosen[i] = chosen[i] or chosen[self.parent[i]]
        return [c and not x for c, x in zip(chosen, self.noise)]


def main_text(source: str | None) -> str:
    """The article's blocks, white space in each as single blanks, joined by line ends."""
    if not source:
        return ""
    page = Page(source)
    inside, blocks, now = page.article(), [], []
    for node, text in page.pieces:
        if text is None:
            blocks.append("".join(now))
            now = []
        elif inside[node]:
            now.append(text)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of rows (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pick(pages, page_id="page_id", url="url", html="html")

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
