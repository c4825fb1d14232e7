"""Main-text extraction by composite text density.

Every DOM node gets its link-adjusted characters per tag,

    CTD = C/T * log_base(C/LC * T/LT),   base = ln(C/(C-LC) * LC + LCb/Cb * C + e)

with C characters, T tags, LC characters in links, LT link tags of the subtree
and Cb, LCb those of the body (zero divisors count 1).  A node's density sum adds
up its children's densities.  The node of maximum sum is the content (its parent,
where it is but one paragraph), and the least density on its path from the body is
the threshold: beside the path, headings and whatever is at or above the threshold
and not mostly links belong to it too, loose text between elements like an element.

Marks (article, main) are a prior to that: the innermost one around the maximum is
taken whole, and other marked elements, and what lies beside the path in an outer
one, need no threshold.  A page without marks goes by densities alone.

Within the content only lists of page numbers go.  Where nothing is marked and the
content is the whole page, blocks of links ahead of all other text are its menu if
they are below the threshold.

Scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and
reader comments are left out of tree and densities by element, role and name.

One pass over the tokens builds the tree as parallel lists, one pass backwards
sums it up: linear in the page.  Spark deals out the pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Names of elements, roles and class or id words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset(
    "applet aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object "
    "option script select style svg template textarea title video".split())
NOISE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adsense adslot adunit advert adverts advertisement advertising alert alerts banner banners breadcrumb "
    "breadcrumbs comment comments commentary commentlist consent cookie cookies copyright disclaimer discussion "
    "disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination paywall popup promo promos promoted promotion reactions related recommended "
    "replies reply respond responses share sharing sidebar sidebars signup skip social sponsor sponsored "
    "sponsors subscribe subscription teaser toolbar topbar widget widgets".split())
#: Names of what readers write, which may outgrow the text.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Names that, as an id, parts of a text have as well.
TEXT_WORDS = frozenset("commentary discussion related response responses".split())
#: First words of names that tell of the page around, such as ``has-sidebar``.
STATE_WORDS = frozenset("has have hide no non with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an element of the key ends when it starts inside them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",),
         "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|</?([a-zA-Z][^\s/><]*)[^<>]*+>"""
    r"""|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")


def _attribute_noise(attrs: str, tag: str, inside_article: bool) -> str:
    """What role, hiding, class and id make of an element: ``noise`` for certain,
    ``comments``, ``part`` (of the page) or ``text`` by name, or nothing."""
    marks = set()
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "class" or (name == "id" and tag not in HEADINGS):
            for token in value.split():
                words = [w.lower() for w in NAME_WORD.findall(token)]
                if len(words) > 1 and words[0] in STATE_WORDS:
                    continue
                for w in words:
                    if w in COMMENT_WORDS:
                        marks.add("comments")
                    elif w in NOISE_WORDS and not (w == "header" and inside_article):
                        marks.add("text" if name == "id" and w in TEXT_WORDS else "part")
        elif name == "role":
            if value.lower() in NOISE_ROLES:
                return "noise"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "noise"
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return "noise"
    return next((m for m in ("comments", "part", "text") if m in marks), "")


def _length(text: str) -> int:
    """Characters other than white space."""
    return len(text) - sum(map(len, SPACE.findall(text)))


class Page:
    """DOM of one page as parallel lists; node 0 is the root."""

    def __init__(self, html: str):
        self.tag, self.parent, self.noise, self.items = ["#root"], [-1], [False], [[]]
        self.marks: dict[int, str] = {}       # elements with a name of NOISE_WORDS
        self.body = 0
        open_nodes = [0]
        opened: Counter = Counter()           # open elements per name: an end tag without one costs nothing
        in_article = 0
        pos = 0
        lowered = None
        while pos < len(html):
            m = TOKEN.search(html, pos)
            end = m.start() if m else len(html)
            if end > pos:
                seg = html[pos:end]
                self.items[open_nodes[-1]].append(unescape(seg) if "&" in seg else seg)
            if m is None:
                break
            pos = m.end()
            name = m[2] or m[4]
            if not name:
                continue                      # comment, doctype, instruction
            name = name.lower()
            closing = m[1] == "/" if m[2] else html.startswith("</", m.start())
            if closing:
                if not opened[name]:
                    continue
                for at in range(len(open_nodes) - 1, 0, -1):
                    if self.tag[open_nodes[at]] == name:
                        for n in open_nodes[at:]:
                            in_article -= self.tag[n] in ("article", "main")
                        self._end(open_nodes, at, opened)
                        break
                continue
            if name in ("html", "body") and (name == "html" or self.body):
                if name == "html":
                    continue
            if name in BLOCK or name in CLOSES:
                self._close_implied(open_nodes, name, opened)
            node = len(self.tag)
            parent = open_nodes[-1]
            attrs = m[3] or ""
            bad = self.noise[parent] or name in NOISE_TAGS or (name == "header" and not in_article)
            if not bad and attrs and name not in ("body", "main"):
                mark = _attribute_noise(attrs, name, in_article > 0)
                bad = mark == "noise"
                if mark and not bad:
                    self.marks[node] = mark
            self.tag.append(name)
            self.parent.append(parent)
            self.noise.append(bad)
            self.items.append([])
            self.items[parent].append(node)
            if name == "body":
                self.body = node
            if name in RAW:
                if lowered is None:
                    lowered = html.lower()
                    if len(lowered) != len(html):
                        lowered = re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                stop = lowered.find("</" + name, pos)
                pos = len(html) if stop < 0 else stop
                if stop >= 0:
                    gt = html.find(">", stop)
                    pos = len(html) if gt < 0 else gt + 1
            elif name not in VOID and not (m[0].endswith("/>") and name in ("svg", "path")):
                open_nodes.append(node)
                opened[name] += 1
                in_article += name in ("article", "main")
        self.own = [0 if bad else sum(_length(x) for x in items if isinstance(x, str))
                    for items, bad in zip(self.items, self.noise)]
        if self.marks:
            self._settle_marks()

    def _settle_marks(self) -> None:
        """Makes noise of elements marked by name.

        Not of one that most of the page's text outside links is in, if it is built
        like a text: it holds the first heading, or an article, or two paragraphs
        where no article is marked.  Readers' comments may outgrow the text and hold
        all that: they must hold the first heading, and it must be an h1.  Not of one
        named like a part of a text, unless half of it or more is links or noise.
        """
        n = len(self.tag)
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]

        def plain():
            out = [0] * n
            for i in range(n - 1, -1, -1):
                if not self.noise[i]:
                    if not in_link[i]:
                        out[i] += self.own[i]
                    if i:
                        out[self.parent[i]] += out[i]
            return out

        text = plain()
        whole, articles, paragraphs = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.noise[i]:
                whole[i] += self.own[i]
                articles[i] += self.tag[i] in ("article", "main") and i not in self.marks
                paragraphs[i] += self.tag[i] == "p" and text[i] > 0
                whole[p] += whole[i]
                articles[p] += articles[i]
                paragraphs[p] += paragraphs[i]
        over_heading = set()
        i = next((i for i in range(1, n) if self.tag[i] in HEADINGS and text[i] and not self.noise[i]), 0)
        h1 = self.tag[i] == "h1"
        while i > 0:
            over_heading.add(i)
            i = self.parent[i]
        for i in range(1, n):
            mark = self.marks.get(i)
            if self.noise[self.parent[i]]:
                self.noise[i] = True
            elif mark in ("comments", "part"):
                title = i in over_heading and (h1 or mark == "part")
                self.noise[i] = not (text[i] * 2 > text[0] and (title or (mark == "part" and (
                    articles[i] > 0 or (not articles[0] and paragraphs[i] >= 2)))))
        if "text" in self.marks.values():
            text = plain()
            for i in range(1, n):
                self.noise[i] = self.noise[i] or self.noise[self.parent[i]] or (
                    self.marks.get(i) == "text" and text[i] * 2 <= whole[i])

    def _end(self, open_nodes: list[int], at: int, opened: Counter) -> None:
        for n in open_nodes[at:]:
            opened[self.tag[n]] -= 1
        del open_nodes[at:]

    def _close_implied(self, open_nodes: list[int], name: str, opened: Counter) -> None:
        ended = CLOSES.get(name, ())
        if not (name in BLOCK and opened["p"]) and not any(opened[t] for t in ended):
            return                            # nothing that it could end is open
        fence = SCOPE.get(name, ())
        for at in range(len(open_nodes) - 1, 0, -1):
            t = self.tag[open_nodes[at]]
            if t in ended or (t == "p" and name in BLOCK):
                self._end(open_nodes, at, opened)
                if t == "p":
                    continue
                return
            if t in fence or (not ended and t in BLOCK):
                return

    def measure(self):
        """Density of every node and density sums, from subtree totals."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if self.noise[i]:
                continue
            chars[i] += self.own[i]
            is_link = self.tag[i] == "a"
            if is_link:
                link_chars[i] = chars[i]
                link_tags[i] += 1
            p = self.parent[i]
            if p >= 0:
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i]
        body = self.body
        self.ratio = link_chars[body] / max(chars[body], 1)
        density = [self._density(*x) if x[0] else 0.0 for x in zip(chars, tags, link_chars, link_tags)]
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        self.chars, self.tags, self.link_chars, self.link_tags = chars, tags, link_chars, link_tags
        self.density, self.sums = density, sums

    def _density(self, c: int, t: int, lc: int, lt: int) -> float:
        t, lt = max(t, 1), max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc + self.ratio * c + math.e)
        inner = c / max(lc, 1) * (t / lt)
        return c / t * (math.log(inner) / math.log(base) if base > 1.0 and inner > 1.0
                        else (math.log(inner) if inner > 1.0 else 0.0))

    def best_below(self):
        """For every node the maximum-sum node of its subtree (first of equals)."""
        n = len(self.tag)
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.sums[best[i]] > self.sums[best[p]] or (
                    best[p] != p and self.sums[best[i]] == self.sums[best[p]]):
                best[p] = best[i]
        return best

    def content(self) -> set[int]:
        """Roots of the content subtrees; ``loose`` has the text runs beside them."""
        self.measure()
        self.loose: set[tuple[int, int]] = set()
        self.threshold, self.whole_page = 0.0, False
        self.lettered: list[bool] | None = None      # of every node, once a pager may be there
        if not self.chars[self.body]:
            return set()
        parent, tag = self.parent, self.tag
        top = self.best_below()[self.body]
        # the inline elements of one paragraph are no content of their own
        while top != self.body and (tag[top] == "p" or tag[top] in HEADINGS or tag[top] not in BLOCK) \
                and parent[top] >= 0:
            top = parent[top]
        # a mark around the maximum says how far the content goes
        i = top
        while i > 0 and tag[i] not in ("article", "main"):
            i = parent[i]
        top = i or top
        self.whole_page = self.chars[top] == self.chars[self.body] and tag[top] not in ("article", "main")
        threshold, path, i = self.density[top], {top}, top
        while i > 0:
            i = parent[i]
            path.add(i)
            if i >= self.body:
                threshold = min(threshold, self.density[i])
        self.threshold = threshold
        roots = {top}
        n = len(tag)
        blocky, inside, marked = [False] * n, [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            blocky[parent[i]] |= blocky[i] or tag[i] in BLOCK
        for i in range(1, n):
            p = parent[i]
            inside[i] = inside[p] or p in roots
            is_marked = tag[i] in ("article", "main")
            marked[i] = marked[p] or is_marked
            if inside[i] or self.noise[i] or i in path or not self.chars[i] \
                    or self.link_chars[i] * 2 >= self.chars[i]:
                continue
            if is_marked or (p in path and (tag[i] in BLOCK or blocky[i]) and (
                    marked[p] or tag[i] in HEADINGS or self.density[i] >= threshold > 0)):
                roots.add(i)
        for p in path - {top}:
            run: list[int] = []
            for at, x in enumerate([*self.items[p], None]):
                if isinstance(x, str) or (x is not None and x not in path and not blocky[x]
                                          and (tag[x] not in BLOCK or self.noise[x])):
                    run.append(at)
                    continue
                self._join_run(p, run, marked[p], roots)
                run = []
        return roots

    def _join_run(self, p: int, run: list[int], marked: bool, roots: set[int]) -> None:
        """Text and inline elements between two blocks of a node on the path join
        the content like an element around them."""
        nodes = [x for at in run if not isinstance(x := self.items[p][at], str) and not self.noise[x]]
        texts = [at for at in run if isinstance(self.items[p][at], str)]
        c = sum(_length(self.items[p][at]) for at in texts) + sum(self.chars[x] for x in nodes)
        lc = sum(self.link_chars[x] for x in nodes)
        if not c or lc * 2 >= c:
            return
        t, lt = sum(self.tags[x] + 1 for x in nodes), sum(self.link_tags[x] for x in nodes)
        if marked or self._density(c, t, lc, lt) >= self.threshold > 0:
            roots.update(nodes)
            self.loose.update((p, at) for at in texts)

    def blocks(self, roots: set[int]) -> list[str]:
        """Texts of the blocks below ``roots`` in page order, white space folded."""
        out: list[str] = []
        part: list[str] = []

        def flush():
            text = SPACE.sub(" ", "".join(part)).strip()
            part.clear()
            if text:
                out.append(text)

        stack: list = [(0, False)]
        while stack:
            x, live = stack.pop()
            if x is None:                     # end of a block
                flush()
                continue
            if isinstance(x, str):
                if live:
                    part.append(x)
                continue
            if self.noise[x]:
                continue
            started = live or x in roots
            if started and x not in roots and (self._pager(x) or (
                    self.whole_page and not out and self._menu(x))):
                continue
            if self.tag[x] == "br":
                if started:
                    part.append(" ")
                continue
            if self.tag[x] in BLOCK:
                flush()
                stack.append((None, started))
            if started or not self.loose:
                stack.extend((y, started) for y in reversed(self.items[x]))
            else:
                stack.extend((y, started or (x, at) in self.loose) for at, y in reversed([*enumerate(self.items[x])]))
        flush()
        return out

    def _menu(self, i: int) -> bool:
        """A block of three links or more, nearly all link text and below the threshold."""
        return self.tag[i] in BLOCK and self.tag[i] != "p" and self.link_tags[i] >= 3 \
            and self.link_chars[i] * 10 > self.chars[i] * 8 and self.density[i] < self.threshold

    def _pager(self, i: int) -> bool:
        """A list of three links or more to numbered pages: no letter, no text beside the links."""
        if self.tag[i] not in ("ul", "ol") or not 3 <= self.link_tags[i] \
                or not 0 < self.chars[i] == self.link_chars[i] <= 3 * self.link_tags[i]:
            return False
        if self.lettered is None:
            self.lettered = [not bad and any(any(map(str.isalpha, x)) for x in items if isinstance(x, str))
                             for items, bad in zip(self.items, self.noise)]
            for x in range(len(self.tag) - 1, 0, -1):
                self.lettered[self.parent[x]] |= self.lettered[x]
        return not self.lettered[i]


def main_text(html: str | None) -> str:
    """Main text of a page; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    return "\n\n".join(page.blocks(page.content()))


def main_text_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in pages], dtype=object)
    return extract(html)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``text_col`` (in place of
    a column of that name).  Null, empty or text-free pages give an empty text;
    repeated rows one text each; an empty table stays empty."""
    return pages.withColumn(text_col, main_text_column(F.col(html_col)))


def pages_main_text(spark, sf_dir: str) -> DataFrame:
    """Contract query over all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
