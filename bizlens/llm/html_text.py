"""Main text of web pages by composite text density.

Every block element of the page gets its characters per tag, adjusted by its
links (much link text, or a page of many links, lowers it).  A node's density
sum adds the densities of its block children.  The node of the largest sum is
the centre of the article; the least density on its path to ``body`` is the
threshold that siblings along the path must reach to belong to it.  An
enclosing ``article`` or ``main`` is taken whole.  Menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are pruned by tag, role and class words before densities are computed.  A class
or id word alone does not prune what holds the article (``_settle``).

A page is parsed inside a task by the standard library's tolerant parser: end
tags that match nothing are ignored, unclosed elements end with their parent,
and a page that breaks off ends all of them.

Edge cases: null or empty html gives empty text; text without any tag is the
article; null page_id and url pass through; repeated rows stay; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
SKIP_TAGS = frozenset("annotation applet aside audio button canvas datalist embed footer head iframe input menu nav noscript optgroup option script select style svg template textarea title video".split())
#: Elements that go like those of skip names: not when they wrap the page or its article.
WRAPPERS = frozenset("dialog form object".split())
#: Names of fields, which go with their form or without it.
FIELD_NAMES = frozenset("label legend".split())
SKIP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promotion related respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "thead": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot")}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
#: Words that make the rest of a compound the name of a layout ("has-sidebar").
LAYOUT_WORDS = frozenset("has no not with without".split())
#: Share of an element's characters in links from which its compound class name is believed.
LINK_SHARE = 1 / 3
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _skip_name(attrs) -> int:
    """2 where a class or id is a skip word, 1 where a compound holds one, 0 otherwise; layout compounds hold none."""
    found = 0
    for name, value in attrs:
        if name in ("class", "id") and value:
            for own in value.lower().split():
                words = _WORD.findall(own)
                at = next((i for i, w in enumerate(words) if w in LAYOUT_WORDS), len(words))
                if not SKIP_WORDS.isdisjoint(words[:at]):
                    found = max(found, 2 if len(words) == 1 else 1)
    return found


class _Dom(HTMLParser):
    """Nodes as parallel lists and the text in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.skip = ["#page"], [-1], [False]
        self.named = [0]  # 2 where a class or id is a skip word, 1 where a compound holds one
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        self.open = [0]

    def _pop_to(self, names, stop) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[i]]
            if t in names:
                del self.open[i:]
                return
            if t in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._pop_to(("p",), ("button", "td", "th", "table", "caption", "object", "article", "section", "div", "li"))
        if tag in SAME_LEVEL:
            names = SAME_LEVEL[tag]
            for _ in names:
                self._pop_to(names, SCOPE.get(tag, {"table"}))
        up = self.open[-1]
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.skip.append(self.skip[up] or self._pruned(tag, attrs, up))
        self.named.append(0 if tag in ("html", "body", "article", "main", "header") else 2 if tag in WRAPPERS else _skip_name(attrs))
        if tag not in INLINE:
            self.events.append((node, None))
        if tag not in VOID:
            self.open.append(node)

    def _pruned(self, tag, attrs, up) -> bool:
        if tag in SKIP_TAGS or (tag in FIELD_NAMES and any(self.tag[i] == "form" for i in self.open)):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        if tag == "header":  # a page header; the header of an article holds its title
            return not any(self.tag[i] in ("article", "main") for i in self.open)
        for name, value in attrs:
            if name == "role" and value and value.strip().lower() in SKIP_ROLES:
                return True
            if name == "hidden" or (name == "style" and value and _HIDDEN.search(value.lower())):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[i]] == tag:
                if tag not in INLINE:
                    self.events.append((self.open[i], None))
                del self.open[i:]
                return
            if tag in INLINE and self.tag[self.open[i]] not in INLINE:
                return  # an inline end tag never closes a block

    def handle_data(self, data):
        if data:
            self.events.append((self.open[-1], data))


def _settle(dom: _Dom) -> None:
    """Prune the elements of skip names, but for those whose content speaks against it.

    An element stays that holds more than half of the page's characters, or an
    ``article`` or ``main``, unless the page has an ``article`` or ``main``
    outside all such elements (then it must hold both).  One that is named by a
    compound alone also stays when its links are few and its characters per tag
    are at least half of those of the page outside such elements.
    """
    if not any(dom.named):
        return
    n = len(dom.tag)
    inside, in_link = [False] * n, [False] * n
    chars, links, tags, articles = [0] * n, [0] * n, [1] * n, [0] * n
    for i in range(1, n):
        p = dom.parent[i]
        inside[i] = inside[p] or dom.named[i] > 0
        in_link[i] = in_link[p] or dom.tag[i] == "a"
        articles[i] = int(dom.tag[i] in ("article", "main") and not dom.skip[i])
    for node, text in dom.events:
        if text and not dom.skip[node]:
            k = len("".join(text.split()))
            chars[node] += k
            links[node] += k * in_link[node]
    rest_chars = sum(c for c, x in zip(chars, inside) if not x)
    rest_tags = sum(not x and not s for x, s in zip(inside, dom.skip))
    for i in range(n - 1, 0, -1):
        if not dom.skip[i]:
            for sums in (chars, links, tags, articles):
                sums[dom.parent[i]] += sums[i]
    elsewhere = any(dom.tag[i] in ("article", "main") and not inside[i] and not dom.skip[i] and chars[i] for i in range(1, n))
    for i in range(1, n):
        if dom.skip[dom.parent[i]]:
            dom.skip[i] = True
        elif dom.named[i] and not dom.skip[i]:
            holds, bulk = articles[i] > 0, 2 * chars[i] > chars[0]
            stays = (holds and bulk) if elsewhere else (holds or bulk)
            if dom.named[i] == 1 and not stays:
                stays = links[i] < LINK_SHARE * chars[i] and 2 * chars[i] * rest_tags >= rest_chars * tags[i]
            dom.skip[i] = not stays


def densities(dom: _Dom) -> tuple[list[float], list[float], list[int]]:
    """(composite density, density sum, characters) of every node."""
    n = len(dom.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = dom.tag[i] == "a" or in_link[dom.parent[i]]
    for node, text in dom.events:
        if text and not dom.skip[node]:
            k = len("".join(text.split()))
            chars[node] += k
            if in_link[node]:
                links[node] += k
    for i in range(n - 1, 0, -1):  # children stand after their parents
        if not dom.skip[i]:
            p = dom.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (dom.tag[i] == "a")
    page = links[0] / chars[0] if chars[0] else 0.0
    dens, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c or dom.skip[i]:
            continue
        lc, t, lt = max(links[i], 1), max(tags[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - links[i], 1) * links[i] + page * c + math.e)
        ratio = c / lc * t / lt
        dens[i] = c / t * max(math.log(ratio) / math.log(base), 0.0) if base > 1 and ratio > 0 else c / t
        dens[i] = dens[i] if base > 1 else c / t
    for i in range(1, n):
        if dom.tag[i] not in INLINE:
            sums[dom.parent[i]] += dens[i]
    return dens, sums, chars


def _chosen(dom: _Dom) -> list[bool]:
    """Nodes whose text belongs to the article."""
    n = len(dom.tag)
    dens, sums, chars = densities(dom)
    best = max((i for i in range(n) if not dom.skip[i] and dom.tag[i] not in INLINE), key=lambda i: (sums[i], dens[i], -i))
    path = [best]
    while dom.parent[path[-1]] >= 0:
        path.append(dom.parent[path[-1]])
    whole = next((i for i in path if dom.tag[i] in ("article", "main")), None)
    if whole is None:
        body = next((k for k, i in enumerate(path) if dom.tag[i] == "body"), len(path) - 1)
        threshold = min(dens[i] for i in path[:body + 1])
        keep_roots = {best}
        on_path = set(path[:body + 1])
        for i in range(1, n):
            if dom.parent[i] in on_path and dom.parent[i] != best and i not in on_path and dens[i] >= threshold and dens[i] > 0 and not dom.skip[i]:
                keep_roots.add(i)
    else:
        keep_roots, on_path = {whole}, set()
    kept = [False] * n
    for i in range(n):
        p = dom.parent[i]
        kept[i] = not dom.skip[i] and (i in keep_roots or (p >= 0 and kept[p]))
    if whole is None:  # text that stands directly in a node of the path, beside its blocks
        for i in on_path:
            if not dom.skip[i] and dom.tag[i] != "#page":
                kept[i] = True
        for i in range(n):
            p = dom.parent[i]
            if p >= 0 and kept[p] and dom.tag[i] in INLINE and not dom.skip[i]:
                kept[i] = True
    return kept


def main_text(html: str | None) -> str:
    """Text of the article: its blocks in page order, one a line."""
    if not html:
        return ""
    dom = _Dom()
    dom.feed(html)
    dom.close()
    _settle(dom)
    kept = _chosen(dom)
    blocks, now = [], []
    for node, text in dom.events:
        if text is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif kept[node]:
            now.append(text)
    if now:
        blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0).cast(pa.int64()), "url": batch.column(1).cast(pa.string()),
                "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
