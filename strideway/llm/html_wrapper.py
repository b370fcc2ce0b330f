"""HTML main-text extraction by wrapper induction.

Pages are parsed to trees and folded: consecutive siblings of one label (element and classes, page numbers in them aside) form a run, so a list or
the paragraphs of an article are one node. Up to SAMPLES pages of a host are aligned by simple tree matching (the
largest order-preserving mapping of nodes with equal labels). A node that says the same on all of them that have it (LEAST at least), with all below it, is
template; the nodes whose words vary are slots. The content region is where the slots are: from the root, the child that holds most of the varying words outside
links is entered, until headings, paragraphs or text of their own vary beside it. No element or class name leads there.

Each page is then aligned with its host's wrapper and says what the region holds, without
* what template nodes say (headings, paragraphs and list items of an article or main element stay even so: pages that share a sentence don't show that it isn't the article's),
* nodes labelled like those that the wrapper has outside the region (an advert between paragraphs as in the margin),
* menus, sidebars, forms, footers and dialogs by element or role (nav, aside, form, footer, ...), hidden ones, and blocks whose class or id is exactly one of STRICT: adverts
  and reader comments vary from page to page as articles do, so no alignment tells them apart.

A page that doesn't fit the wrapper, or whose host has too few, is its own wrapper: its region is its article or main element, or else is found by the same descent over all
its words. Only outside a region are class and id words (_HINTS) taken as signs of menus, notices, adverts and the like.

Only the sample is grouped by host: SAMPLES pages at most, one for each residue of a hash, chosen by a
map-side minimum. The pages themselves aren't grouped, so a host with a third of all pages costs nothing extra.

Cases. Null or empty html, or no words in the region: empty text. Null url: host '', no wrapper; likewise a url without host.
Elements nested deeper than DEPTH are read flat. Broken markup: unclosed elements end with their block, an unclosed comment or raw element ends with the page. Long pages: one page in memory
at a time beside its batch. Repeated rows: equal results. Pages that say the same count once in induction, so copies don't turn an article into template.
Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import join_small

#: Pages of a host that make its wrapper, and how many different ones it takes to call a text template.
SAMPLES, LEAST = 8, 3
#: Open elements that a tree nests; the texts of deeper ones count to the deepest of these.
DEPTH = 150
#: Classes and ids of adverts and reader comments inside a content region, whole words of a block's class or id.
STRICT = frozenset("ad ads advert advertisement comments comment-list commentlist comments-area disqus_thread".split())
TEXTS = "page_id long, url string, text string, n_chars long, host string, by_wrapper boolean"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|</\s*(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
_ENDS_P = _BLOCK - {"option", "html", "head", "body"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = frozenset("html body article section div ul ol dl table td th main nav aside form fieldset blockquote".split())
_ARTICLE = frozenset(("article", "main"))
_FURNITURE_TAGS = frozenset("nav aside footer form button select dialog menu search head".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_HINTS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|"
    r"side-?bar\w*|menu\w*|nav\w*|breadcrumb\w*|pagination|pager|foot(?:er)?|site-?header|page-?header|masthead|topbar|comments?|comment-\w+|commentlist|disqus\w*|respond|repl(?:y|ies)|"
    r"related\w*|recommend\w*|share\w*|sharing|social\w*|widget\w*|toolbar|skip-?link\w*|login|signup|search\w*)(?:$|[-_\s])",
    re.I,
)


_FLOW = frozenset("#text p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address hgroup".split())
#: Numbers of a page in its classes, such as post-123.
_DIGITS = re.compile(r"(?<=[-_])\d+|\d{3,}")


class Node:
    """hint: 2 for a class or id of STRICT, 1 for one of _HINTS, else 0."""

    __slots__ = ("tag", "label", "furniture", "hint", "children", "block")

    def __init__(self, tag: str, label: str, furniture: bool, hint: int = 0) -> None:
        self.tag, self.label, self.furniture, self.hint, self.children, self.block = tag, label, furniture, hint, [], tag in _BLOCK


def parse(page: str) -> Node:
    """The tree of a page; texts are str children, character references decoded."""
    root = Node("#root", "#root", False)
    stack, at, n = [root], 0, len(page)
    deeper: list[str] = []

    def close_to(k: int) -> None:
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(htmllib.unescape(page[at:]))
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            stack[-1].children.append(htmllib.unescape(page[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            stack[-1].children.append(htmllib.unescape(page[at:lt]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag:
            tag = tag.lower()
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            if tag in _VOID:
                if tag == "br" or tag == "wbr":
                    stack[-1].children.append(" " if tag == "br" else "")
                elif tag == "hr":
                    stack[-1].children.append(Node("hr", "hr", False))
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k].tag
                    if t == "p":
                        close_to(k)
                        break
                    if t in _SCOPE or t == "li":
                        break
            if same := _SAME.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k].tag
                    if t in same:
                        close_to(k)
                        if tag != "tr" and tag != "tbody":
                            break
                    elif t in ("ul", "ol", "dl", "table", "select", "menu", "nav", "article"):
                        break
            label, furniture, hint = tag, tag in _FURNITURE_TAGS, 0
            if tag == "header":
                furniture = not any(s.tag in ("article", "main") for s in stack)
            if attrs and "=" in attrs or "hidden" in attrs:
                cls = ""
                for a in _ATTR.finditer(attrs):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name in ("class", "id"):
                        if name == "class":
                            cls = ".".join(sorted({_DIGITS.sub("#", x) for x in value.split()}))
                        hint = max(hint, 2 if not STRICT.isdisjoint(value.lower().split()) else 1 if _HINTS.search(value) else 0)
                    elif name == "role":
                        furniture = furniture or value.lower() in _FURNITURE_ROLES
                    elif name == "hidden" or value.lower() == "true":
                        furniture = True
                label = f"{tag}.{cls}" if cls else tag
            if tag in ("html", "body", "main", "article"):
                furniture, hint = False, 0
            node = Node(tag, label, furniture, hint)
            stack[-1].children.append(node)
            if not attrs.rstrip().endswith("/") or tag in _BLOCK:
                if len(stack) < DEPTH:
                    stack.append(node)
                else:
                    deeper.append(tag)
        elif m["end"]:
            tag = m["end"].lower()
            if deeper and deeper[-1] == tag:
                deeper.pop()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag not in _BLOCK and stack[k].block:
                    break
    return root


class Run:
    """Consecutive siblings of one label. A leaf run has the texts of its blocks, another one has child runs."""

    __slots__ = ("label", "tag", "furniture", "hint", "texts", "linked", "children")

    def __init__(self, label: str, tag: str, furniture: bool, hint: int = 0) -> None:
        self.label, self.tag, self.furniture, self.hint = label, tag, furniture, hint
        self.texts: list[str] = []
        self.linked = 0
        self.children: list[Run] = []


def _inline(node: Node, out: list[str]) -> int:
    """Appends the texts under a node without blocks; the characters that are in links."""
    linked = 0
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif not c.furniture:
            before = len(out)
            linked += _inline(c, out)
            if c.tag == "a":
                linked = sum(map(len, out[before:]))
    return linked


def _has_block(node: Node, memo: dict[int, bool]) -> bool:
    k = id(node)
    if k not in memo:
        memo[k] = any(not isinstance(c, str) and (c.block or _has_block(c, memo)) for c in node.children)
    return memo[k]


def fold(nodes: list[Node], memo: dict[int, bool]) -> Run:
    """The run of sibling nodes of one label, with everything below them."""
    kind = lambda n: (n.label, n.tag, n.furniture, n.hint)
    run = Run(*kind(nodes[0]))
    groups: list[list[Node] | Run] = []

    def text(parts: list[str], linked: int) -> None:
        words = " ".join("".join(parts).split())
        parts.clear()
        if words:
            leaf = Run("#text", "#text", False)
            leaf.texts.append(words)
            leaf.linked = linked
            groups.append(leaf)

    def walk(node: Node, parts: list[str]) -> int:
        """Children in order: inline ones add to parts, blocks end them."""
        linked = 0
        for c in node.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.block:
                text(parts, linked)
                linked = 0
                if groups and isinstance(groups[-1], list) and kind(groups[-1][0]) == kind(c):
                    groups[-1].append(c)
                else:
                    groups.append([c])
            elif c.furniture:
                continue
            elif _has_block(c, memo):
                linked += walk(c, parts)
            else:
                before = len(parts)
                got = _inline(c, parts)
                linked += sum(map(len, parts[before:])) if c.tag == "a" else got
        return linked

    leaf = not any(_has_block(n, memo) for n in nodes)
    for n in nodes:
        parts: list[str] = []
        linked = walk(n, parts)
        if leaf:
            words = " ".join("".join(parts).split())
            if words:
                run.texts.append(words)
                run.linked += linked
        else:
            text(parts, linked)
    run.children = [fold(g, memo) if isinstance(g, list) else g for g in groups]
    return run


def page_runs(page: str) -> Run:
    return fold([parse(page)], {})


def matching(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of runs: (matched nodes, pairs of positions)."""
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, up = table[i + 1], table[i]
        for j in range(m):
            best = row[j] if row[j] > up[j + 1] else up[j + 1]
            if a[i].label == b[j].label:
                got = up[j] + score(a[i], b[j], memo)
                if got > best:
                    best = got
            row[j + 1] = best
    pairs, i, j = [], n, m
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return table[n][m], pairs[::-1]


def score(a, b, memo: dict) -> int:
    key = id(a), id(b)
    if key not in memo:
        memo[key] = 1 + (matching(a.children, b.children, memo)[0] if a.children and b.children else 0)
    return memo[key]


class Slot:
    """A node of a wrapper: texts that all pages say here, whether it is the same on all pages, and how many characters it has outside links."""

    __slots__ = ("label", "tag", "furniture", "hint", "constant", "pages", "same", "first", "chars", "children")

    def __init__(self, run: Run) -> None:
        self.label, self.tag, self.furniture, self.hint = run.label, run.tag, run.furniture, run.hint
        self.constant, self.pages, self.same, self.first = set(run.texts), 1, True, run.texts
        self.chars = sum(map(len, run.texts)) - run.linked
        self.children = [Slot(c) for c in run.children]

    def merge(self, run: Run, memo: dict) -> None:
        self.pages += 1
        self.constant &= set(run.texts)
        self.same = self.same and run.texts == self.first
        self.chars += sum(map(len, run.texts)) - run.linked
        _, pairs = matching(self.children, run.children, memo)
        met = dict((j, i) for i, j in pairs)
        out, at = [], 0
        for j, r in enumerate(run.children):
            if j in met:
                out += self.children[at : met[j]]
                at = met[j] + 1
                slot = self.children[met[j]]
                slot.merge(r, memo)
                out.append(slot)
            else:
                out.append(Slot(r))
        self.children = out + self.children[at:]

    def template(self) -> bool:
        """Whether LEAST pages or more have this node and all of them say the same in it."""
        return self.pages >= LEAST and self.same and all(c.pages == self.pages and c.template() for c in self.children)


def _mass(node) -> int:
    """Varying characters of a slot, or characters of a run, outside links, furniture and hinted blocks."""
    if node.furniture or node.hint:
        return 0
    if isinstance(node, Slot):
        own = 0 if node.same and node.pages > 1 else node.chars - node.pages * sum(map(len, node.constant)) if node.pages > 1 else node.chars
    else:
        own = sum(map(len, node.texts)) - node.linked
    return max(0, own) + sum(_mass(c) for c in node.children)


def descent(node) -> list[int]:
    """The child positions that lead from a wrapper's or page's root to where its words are."""
    path: list[int] = []
    while node.children:
        masses = [_mass(c) for c in node.children]
        k = max(range(len(masses)), key=masses.__getitem__)
        child = node.children[k]
        beside = any(m and c.tag in _FLOW for c, m in zip(node.children, masses) if c is not child)
        if beside or child.tag in _FLOW or not masses[k] or masses[k] < 0.7 * _mass(node):
            break
        path.append(k)
        node = child
    return path


def own_region(page: Run) -> list[int]:
    """The region of a page without a wrapper: its fullest article or main element, or else by descent."""

    def named(node: Run, path: list[int]) -> list[tuple[int, list[int]]]:
        if node.furniture or node.hint:
            return []
        inner = [x for k, c in enumerate(node.children) for x in named(c, [*path, k])] if node.tag != "article" else []
        return inner or ([(_mass(node), path)] if node.tag in _ARTICLE else [])

    best = max(named(page, []), key=lambda x: x[0], default=(0, []))
    return best[1] if best[0] else descent(page)


def induce(pages: list[str]) -> str | None:
    """The wrapper of a host's pages as JSON, None if fewer than LEAST of them differ in what they say."""
    seen, trees = set(), []
    for p in pages:
        tree = page_runs(p or "")
        said = tuple(blocks(tree, None))
        if said and said not in seen:
            seen.add(said)
            trees.append(tree)
    if len(trees) < LEAST:
        return None
    top = Slot(trees[0])
    for t in trees[1:]:
        top.merge(t, {})
    path, outside = descent(top), set()

    def dump(s: Slot) -> list:
        return [s.label, s.tag, sorted(s.constant) if s.template() else None, [dump(c) for c in s.children]]

    def labels(s: Slot, way: list[int] | None) -> None:
        """Classed blocks outside the region; way: the rest of the path to it, None off it."""
        if way is None and "." in s.label and s.tag not in _FLOW:
            outside.add(s.label)
        for k, c in enumerate(s.children):
            if way is None or k != way[0]:
                labels(c, None)
            elif way[1:]:
                labels(c, way[1:])

    if path:
        labels(top, path)
        node = top
        for k in path:  # a label on the way to the region says nothing against it
            node = node.children[k]
            outside.discard(node.label)
    return json.dumps([path, sorted(outside), dump(top)], ensure_ascii=False)


class Wrapper:
    """constant: a template node's texts, None for a slot; path and outside at the root: the way to the region, labels of blocks beside it."""

    __slots__ = ("label", "tag", "constant", "children", "path", "outside")

    def __init__(self, data: list, path: list[int] | None = None, outside: list[str] | None = None) -> None:
        self.label, self.tag = data[0], data[1]
        self.constant, self.path, self.outside = None if data[2] is None else frozenset(data[2]), path, frozenset(outside or ())
        self.children = [Wrapper(c) for c in data[3]]

    @classmethod
    def load(cls, text: str) -> Wrapper:
        path, outside, top = json.loads(text)
        return cls(top, path, outside)


def _emit(run: Run, slot: Wrapper | None, out: list[str], memo: dict, least: int, outside: frozenset = frozenset(), article: bool = False) -> None:
    """The blocks under a run, without furniture, blocks hinted at by `least` or more, those labelled as outside the region, and template."""
    if run.furniture or run.hint >= least or run.label in outside:
        return
    article = article or run.tag in _ARTICLE
    constant = slot.constant if slot is not None and not (article and run.tag in _FLOW) else None
    out += [t for t in run.texts if constant is None or t not in constant]
    if run.children:
        pairs = dict((j, i) for i, j in matching(slot.children, run.children, memo)[1]) if slot is not None and slot.children else {}
        for j, c in enumerate(run.children):
            _emit(c, slot.children[pairs[j]] if j in pairs else None, out, memo, least, outside, article)


def _least(run: Run) -> int:
    """Inside a content region only STRICT names count; where the region is the page itself, all hints do."""
    return 1 if run.tag in ("#root", "html", "body") else 2


def blocks(page: Run, wrapper: Wrapper | None) -> list[str]:
    """The main text's blocks. The wrapper's region is followed as far as the page aligns with it."""
    memo: dict = {}
    out: list[str] = []
    if wrapper is not None:
        run, slot, article = page, wrapper, False
        for k in wrapper.path:
            pairs = {i: j for i, j in matching(slot.children, run.children, memo)[1]}
            if k not in pairs:
                break
            slot, run = slot.children[k], run.children[pairs[k]]
            article = article or run.tag in _ARTICLE
        else:
            _emit(run, slot, out, memo, _least(run), wrapper.outside, article)
            if out:
                return out
    run = page
    for k in own_region(page):
        run = run.children[k]
    _emit(run, None, out, memo, _least(run))
    return out


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    return "\n".join(blocks(page_runs(page or ""), wrapper))


# --- Spark --------------------------------------------------------------------------------------


def _hosted(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def _induce_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pages = pdf.sort_values(["salt"])["html"].tolist()
    wrapper = induce(pages)
    rows = [(pdf["host"].iloc[0], wrapper)] if wrapper else []
    return pd.DataFrame(rows, columns=["host", "wrapper"])


def induce_wrappers(pages: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(host, wrapper) from at most `samples` pages of each host; pages as _hosted gives them."""
    rank = F.xxhash64("page_id", "url")
    keyed = pages.filter("host <> ''").withColumn("salt", F.pmod(rank, F.lit(samples))).withColumn("pick", rank)
    picks = keyed.groupBy("host", "salt").agg(F.min("pick").alias("pick"))
    sample = join_small(keyed.select("host", "salt", "pick", "html"), picks, ["host", "salt", "pick"], "left_semi", 64, "wrapper-picks")
    sample = sample.dropDuplicates(["host", "salt", "pick"])
    return sample.groupBy("host").applyInPandas(_induce_group, "host string, wrapper string")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, Wrapper] = {}
    for pdf in batches:
        texts, used = [], []
        for host, text, page in zip(pdf["host"], pdf["wrapper"], pdf["html"]):
            wrapper = None
            if isinstance(text, str):
                wrapper = known.get(host)
                if wrapper is None:
                    if len(known) > 2000:
                        known.clear()
                    wrapper = known[host] = Wrapper.load(text)
            texts.append(main_text(page, wrapper))
            used.append(wrapper is not None)
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "host": pdf["host"], "by_wrapper": used})


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", samples: int = SAMPLES) -> DataFrame:
    """The main text of every page (TEXTS)."""
    pages = _hosted(df, id_col, url_col, html_col)
    wrappers = induce_wrappers(pages, samples)
    rows = join_small(pages, wrappers, ["host"], "left", F.octet_length("wrapper") + 64, "wrappers")
    return rows.select("page_id", "url", "host", "html", "wrapper").mapInPandas(_extract, TEXTS)
