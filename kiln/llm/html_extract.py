"""HTML extraction by wrapper induction.

Pages of a host are aligned with up to three other pages of it (the host's
pivots: the smallest page hash in each of three classes, so the choice depends
on the pages alone) by simple tree matching: the largest order-keeping mapping
of two DOM trees in which mapped nodes have equal tags and mapped parents.
Nodes mapped with equal text are constant and belong to the host's template;
nodes with differing text are slots and hold content. A pivot says nothing if
most of the page is constant against it (a copy of the page is no template).

Before the alignment, what is boilerplate by its markup leaves the tree: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments,
by tag, ARIA role or words of class and id. If what is left has an article (or
else a main element), its blocks are the content: an article may quote the same
licence on every page, but constant blocks that are mostly links are menus that
no markup names, and are left out. Otherwise the blocks are content that
at least two usable pivots (or the only one) do not show as constant and that
are not lists of links.

Pages stream through tasks sorted by host with the host's pivots first. Hosts
above 1/256 of all pages (256 at most) are spread over 32 salts, each with its
pivots, so a host with a third of all pages is not one task.

Defined results. Null or empty html: empty text. A null url is a host of its
own. Repeated pages are extracted each. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and joined by one
space. Unclosed and stray tags are repaired. An empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.bloom import may_hold
from kiln.llm.common import table

PIVOTS = 3
HOT_SHARE = 256
SALTS = 32

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul br caption option".split())
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
_SCOPE = frozenset("html body article section div main aside nav header footer table td th blockquote form "
                   "fieldset figure details ul ol dl li dd dt".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
             "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead"}, {"table"})}
_DROP = frozenset("script style noscript template head title nav footer aside form iframe object svg canvas button "
                  "select textarea dialog menu audio video map noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form "
                   "toolbar tablist".split())
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo "
                   "promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer header "
                   "masthead topbar toolbar cookie cookies consent notice notices gdpr popup modal overlay newsletter "
                   "subscribe subscription signup login share sharing social related recommended recommendations "
                   "comment comments commentlist disqus respond replies widget widgets pagination pager skip copyright "
                   "disclaimer".split())
_REMARKS = frozenset("comment comments commentlist reply replies respond".split())
_NOT = frozenset("has no with without hide show".split())
_KEPT = frozenset(("html", "body", "main"))


class Node:
    __slots__ = ("tag", "attrs", "kids", "size")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.size = tag, attrs, [], 1


def parse(text: str) -> Node:
    """The DOM tree of a page; kids are nodes and decoded strings."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if not s.startswith(("<!", "<?")):
                stack[-1].kids.append(html_lib.unescape(s) if "&" in s else s)
            elif s.startswith("<![CDATA["):
                stack[-1].kids.append(s[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag in _CLOSES_P:
            _close_open(stack, {"p"}, _SCOPE)
        if tag in _SIBLINGS:
            _close_open(stack, *_SIBLINGS[tag])
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in _VOID and not m[3].rstrip().endswith("/") or tag in _BLOCK - _VOID:
            stack.append(node)
    return root


def _close_open(stack: list, tags: set, scope):
    """Close the nearest open element of ``tags`` that no element of ``scope`` hides."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def _close(stack: list, tag: str):
    inline = tag not in _BLOCK
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if inline and stack[i].tag in _BLOCK:  # a stray end tag of an inline element closes no block
            return


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)}


def _marked(node: Node, in_article: bool) -> bool:
    """Whether markup names the element as boilerplate."""
    tag = node.tag
    if tag in _DROP or (tag == "header" and not in_article):
        return True
    if not node.attrs.strip(" /\n\t"):
        return False
    a = attributes(node)
    if tag not in _KEPT:
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            return True
        if a.get("role", "").lower() in _ROLES:
            return True
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))
        if not words & _NOT:
            found = words & (_REMARKS if tag == "article" else _WORDS)
            return bool(found - {"header"} if in_article else found)
    return False


def _landmark(node: Node) -> str:
    if node.tag in ("article", "main"):
        return node.tag
    if "role" in node.attrs:
        return {"article": "article", "main": "main"}.get(attributes(node).get("role", "").lower(), "")
    return ""


def _run(call):
    """The value of a recursion written as generators, each yielding the calls it needs: their stack is a list, so
    pages nest as deep as they like."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def clean(node: Node, in_article: bool = False) -> tuple[Node, bool]:
    """A copy without boilerplate, and whether an article or main element is left in it."""
    return _run(_clean(node, in_article))


def _clean(node: Node, in_article: bool):
    out, found = Node(node.tag, node.attrs), bool(_landmark(node))
    for kid in node.kids:
        if isinstance(kid, str):
            out.kids.append(kid)
            continue
        inside = in_article or _landmark(kid) != ""
        kept, has = (yield _clean(kid, inside)) if kid.tag not in _DROP else (None, False)
        if kept is None or (_marked(kid, in_article) and not (has and _landmark(kid) == "")):
            out.kids.append(" ")
            continue
        out.kids.append(kept)
        found |= has
    return out, found


class Block:
    """A run of text between block boundaries, with the element that holds it."""

    __slots__ = ("text", "links", "node", "parts")

    def __init__(self, node: Node):
        self.node, self.parts, self.text, self.links = node, [], "", 0


def blocks(root: Node) -> list[Block]:
    """The blocks of a tree in page order."""
    out: list[Block] = []
    current: list = [Block(root)]

    def end(node):
        b = current[0]
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            out.append(b)
        current[0] = Block(node)

    def walk(node, holder, link):
        for kid in node.kids:
            if isinstance(kid, str):
                current[0].parts.append(kid)
                if link:
                    current[0].links += len(kid.strip())
            elif kid.tag in _BLOCK:
                end(kid)
                yield walk(kid, kid, link)
                end(holder)
            else:
                yield walk(kid, holder, link or kid.tag == "a")

    _run(walk(root, root, False))
    end(root)
    return out


class Tree:
    """The elements that hold text, as (tag, own text, kids): what is aligned. ``key`` is equal for equal trees,
    ``size`` the number of nodes."""

    __slots__ = ("tag", "text", "kids", "node", "key", "size")

    def __init__(self, tag, text, kids, node):
        self.tag, self.text, self.kids, self.node = tag, text, kids, node
        self.key, self.size = hash((tag, text, *[k.key for k in kids])), 1 + sum(k.size for k in kids)


def outline(root: Node, held: dict[int, str]) -> Tree | None:
    return _run(_outline(root, held))


def _outline(root: Node, held: dict[int, str]):
    kids, inline = [], []
    for k in root.kids:
        if isinstance(k, Node):
            t = yield _outline(k, held)
            if t and k.tag in _BLOCK:
                kids.append(t)
            elif t and t.kids:
                inline.append(t)
    kids += inline
    text = held.get(id(root), "")
    return Tree(root.tag, text, kids, id(root)) if text or kids else None


def _match(a: Tree, b: Tree, memo: dict) -> int:
    """Nodes in the largest simple tree matching of a and b, equal texts counting twice."""
    return _run(_matched(a, b, memo))


def _matched(a: Tree, b: Tree, memo: dict):
    if a.tag != b.tag:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        inner = (yield _aligned(a, b, memo))[0] if a.kids and b.kids else 0
        memo[key] = 1 + (a.text == b.text) + inner
    return memo[key]


def _aligned(a: Tree, b: Tree, memo: dict):
    """Weight of the best matching of the two lists of kids, and its pairs. Equal kids at both ends go with each other,
    which no matching betters: a tree matches none better than its equal. The dynamic programme is for the rest."""
    x, y = a.kids, b.kids
    least, p, q = min(len(x), len(y)), 0, 0
    while p < least and x[p].key == y[p].key:
        p += 1
    while q < least - p and x[-1 - q].key == y[-1 - q].key:
        q += 1
    weight = 2 * (sum(k.size for k in x[:p]) + sum(k.size for k in x[len(x) - q:]))
    pairs = [(i, i) for i in range(p)] + [(len(x) - i, len(y) - i) for i in range(q, 0, -1)]
    x, y = x[p:len(x) - q], y[p:len(y) - q]
    rows = [[0] * (len(y) + 1)]
    for u in x:
        last, row = rows[-1], [0]
        for j, v in enumerate(y):
            best = 0
            if u.tag == v.tag:
                known = memo.get((id(u), id(v)))
                best = last[j] + (known if known is not None else (yield _matched(u, v, memo)))
            row.append(max(best, last[j + 1], row[j]))
        rows.append(row)
    i, j = len(x), len(y)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((p + i, p + j))
    return weight + rows[-1][-1], pairs


def constants(a: Tree, b: Tree) -> set[int]:
    """Nodes of a that the matching maps to nodes of b with equal text."""
    memo: dict = {}
    out: set[int] = set()
    todo = [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        if x.text and x.text == y.text:
            out.add(x.node)
        if x.key == y.key:
            todo += zip(x.kids, y.kids)
        elif x.kids and y.kids:
            todo += [(x.kids[i], y.kids[j]) for i, j in _run(_aligned(x, y, memo))[1]]
    return out


class Page:
    """A parsed page: its cleaned tree, blocks and outline."""

    def __init__(self, text: str | None):
        root, _ = clean(parse(text or ""))
        self.root = root
        self.blocks = blocks(root)
        held: dict[int, str] = {}
        for b in self.blocks:
            held[id(b.node)] = f"{held[id(b.node)]} {b.text}" if id(b.node) in held else b.text
        self.outline = outline(root, held) or Tree("#root", "", [], 0)

    def region(self) -> list[Node]:
        """The outermost articles, or else main elements."""
        found: dict[str, list[Node]] = {"article": [], "main": []}

        def walk(node, open_: frozenset):
            mark = _landmark(node)
            if mark and mark not in open_:
                found[mark].append(node)
                open_ = open_ | {mark}
            for kid in node.kids:
                if isinstance(kid, Node):
                    yield walk(kid, open_)

        _run(walk(self.root, frozenset()))
        return found["article"] or found["main"]

    def template(self, pivots: list[Page]) -> set[int]:
        """Nodes that the usable pivots show as constant."""
        votes: Counter = Counter()
        usable = 0
        size = {id(b.node): 0 for b in self.blocks}
        for b in self.blocks:
            size[id(b.node)] += len(b.text)
        for p in pivots:
            same = constants(self.outline, p.outline)
            if 5 * sum(size.get(x, 0) for x in same) <= 4 * sum(size.values()):
                usable += 1
                votes.update(same)
        return {x for x, n in votes.items() if n >= min(2, usable)}

    def text(self, pivots: list[Page]) -> str:
        constant = self.template(pivots)
        region = self.region()
        if region:
            return " ".join(b.text for r in region for b in blocks(r) if not (id(b.node) in constant and 2 * b.links > len(b.text)))
        kept = [b for b in self.blocks if id(b.node) not in constant]
        lists = Counter(b.node.tag for b in kept if 2 * b.links > len(b.text))
        return " ".join(b.text for b in kept if not (2 * b.links > len(b.text) and lists[b.node.tag] >= 3))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every page."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    base = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host.alias("host"), F.xxhash64(html_col).alias("h"))
    per = base.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.min(F.when(F.pmod("h", F.lit(PIVOTS)) == k, F.col("h"))).alias(f"h{k}") for k in range(PIVOTS)])
    total = base.count()
    # at most HOT_SHARE hosts can hold more than 1 / HOT_SHARE of the pages
    hot = [(r["host"],) for r in per.where(F.col("n") > max(500, total // HOT_SHARE)).select("host").collect()]
    hot_df = spark.createDataFrame(hot, "host string").withColumn("salts", F.lit(SALTS)).coalesce(1)
    least = F.filter(F.array(*[f"h{k}" for k in range(PIVOTS)]), lambda x: x.isNotNull())
    wanted = per.select("host", F.explode(least).alias("h"))
    # of the pages only those that may be pivots are shuffled for this join
    likely = base.where(may_hold(wanted.select("h"), F.col("h")))
    pivots = likely.join(wanted, ["host", "h"]).dropDuplicates(["host", "h"]).join(F.broadcast(hot_df), "host", "left")
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    placed = base.join(F.broadcast(hot_df), "host", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64("h", "id"), F.lit(SALTS)).cast("int")))
    cols = ["host", "salt", "is_page", "h", "id", "url", "html"]
    stream = spread.withColumn("is_page", F.lit(0)).select(cols).unionByName(
        placed.withColumn("is_page", F.lit(1)).select(cols))
    stream = stream.repartition("host", "salt").sortWithinPartitions("host", "salt", "is_page", "h")

    def extract(it):
        at, known = None, {}
        for pdf in it:
            out = []
            for h_, s, is_page, h, i, u, t in zip(*(pdf[c].tolist() for c in cols)):
                if (h_, s) != at:
                    at, known = (h_, s), {}
                if not is_page:
                    known[h] = Page(t)
                    continue
                out.append((i, u, Page(t).text([p for k, p in known.items() if k != h])))
            if out:
                yield pd.DataFrame(out, columns=["id", "url", "text"])

    got = stream.mapInPandas(extract, "id string, url string, text string")
    return got.withColumn("id", F.col("id").cast(dict(pages.dtypes)[id_col]))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_pages(table(spark, sf_dir, "pages"))
    return got.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
