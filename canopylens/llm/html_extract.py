"""HTML extraction by wrapper induction: what pages of a host share is template, what varies between them is content.

The block elements of every page make a tree. Trees of a host are aligned by simple tree matching, which finds the
largest common top-down part of two ordered trees, and merged into one wrapper: each node knows in how many pages it was
found, whether its text was ever another one, and how much text it held. Wrappers of partitions are merged in two
levels. The slot of a host is the node that holds its articles: the article element, or else the node below which most
of the varying text lies. Pages are then aligned with their host's wrapper: what lies in the slot is content, but for
nodes whose text is constant in the host, and for menus, forms, notices and the like, which are told by tag and name.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopylens.llm.common import cut, forget, shielded
from canopylens.llm.url_filter import split_url

# Elements of HTML by how they are parsed and what they hold.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li main menu nav noscript ol optgroup option p pre search section select button summary svg table tbody td template tfoot th thead tr ul video audio object canvas map".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element that ends where one of these begins, unless an element of the second set lies between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that are never part of an article, and those that aren't where they surround it.
NEVER = set("head nav footer aside form menu dialog noscript select option button svg template object canvas map search video audio".split())
OUTSIDE = {"header"}
#: Names (classes, ids, roles) of what is never part of an article.
NAMES = set(
    "nav navbar navigation navi menu menubar sidebar aside complementary footer contentinfo ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager paging toolbar form search widget widgets skip sitemap "
    "adbox adslot adunit adbanner textad cookiebar cookiebanner cookienotice commentlist commentform usercomments mainmenu topmenu submenu mainnav topnav sidenav subnav "
    "sitenav sitefooter pagefooter sharebar sharebuttons socialbar relatedposts relatedarticles searchbox searchform loginform leftbar rightbar".split()
)
OUTSIDE_NAMES = {"header", "masthead", "topbar"}
#: With more than this share of a page's text an element isn't judged by its name.
MOSTLY = 0.6
COMMENTS = {"comment", "comments", "commentlist", "usercomments", "disqus", "reply", "replies", "respond", "related", "relatedposts", "relatedarticles", "recommended"}
#: Elements nested deeper are kept as blocks of the one at this depth.
DEEP = 150
#: Siblings of one kind in a row are one node of a tree: of these tags however many they are, of others from MANY on.
MANY = 12
REPEATED = {"p", "li", "tr", "td", "th", "dt", "dd", "option", "blockquote", "pre", *HEADINGS}

#: Pages that must agree before a constant text counts as template, and the share of a host's pages that must have it.
MIN_PAGES = 4
MIN_SHARE = 0.5
#: A wrapper keeps nodes that one in so many of its pages have; share of varying text with which a node leads to the slot.
RARE = 20
LEADS = 0.6

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.DOTALL)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class Node:
    """An element of a page: its tag, its names, and its children in order, texts among them."""

    __slots__ = ("tag", "names", "kids", "dropped")

    def __init__(self, tag: str, names: frozenset[str] = frozenset(), kids: list | None = None, dropped: bool = False):
        self.tag, self.names, self.kids, self.dropped = tag, names, [] if kids is None else kids, dropped

    @property
    def kind(self) -> str:
        return " ".join([self.tag, *sorted(self.names)])


class Link(str):
    """A text inside a link."""


def names_of(attributes: str) -> frozenset[str]:
    """The words of classes, id and role, in lower case, numbers left out."""
    if "=" not in attributes:
        return frozenset()
    values = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    return frozenset(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", values).lower()))


def parse(html: str | None) -> Node:
    """The tree of a page's block elements. Inline elements leave their text where they stand; scripts leave nothing.

    Beyond DEEP levels an element is a break in its parent and adds its blocks to it, unless it is no part of an article.
    """
    html = html or ""
    root = Node("html")
    open_nodes, links, at = [root], 0, 0

    def end(tags: set[str], stops: set[str] = frozenset()) -> None:
        for k in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[k].tag in tags:
                if k >= DEEP:
                    open_nodes[k - 1].kids.append(Node("hr"))
                del open_nodes[k:]
                return
            if open_nodes[k].tag in stops:
                return

    def add(text: str) -> None:
        if text:
            text = entities.unescape(text)
            open_nodes[-1].kids.append(Link(text) if links else text)

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = 0
            elif tag in BLOCKS:
                end(HEADINGS if tag in HEADINGS else {tag})
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else len(html)
        elif tag == "br":
            open_nodes[-1].kids.append(" ")
        elif tag == "hr":
            open_nodes[-1].kids.append(Node("hr"))
        elif tag == "a":
            links = 1
        elif tag in BLOCKS and tag != "html":
            links = 0
            if open_nodes[-1].tag == "p" or (tag in HEADINGS and open_nodes[-1].tag in HEADINGS):
                open_nodes.pop()
            if tag in ENDED_BY:
                end(*ENDED_BY[tag])
            if tag == "body" or (tag not in ("head", "noscript", "template") and open_nodes[-1].tag == "head"):
                end({"head"})
            new, parent = Node(tag, names_of(m[3] or m[6] or "")), open_nodes[-1]
            if len(open_nodes) < DEEP:
                parent.kids.append(new)
            elif not parent.dropped and foreign(tag, new.names, True):
                new.dropped = True
                parent.kids.append(new)
            else:
                parent.kids.append(Node("hr"))
                new = Node(tag, new.names, parent.kids, parent.dropped)
            if not (m[3] or "").endswith("/") or tag not in ("svg", "object"):
                open_nodes.append(new)
    add(html[at:])
    return root


def foreign(tag: str, names: frozenset[str] | set[str], inside: bool, share: float = 0.0) -> bool:
    """Whether an element is no part of an article, by its tag and names; inside: it lies in the article.

    share: what it holds of the page's text outside links. An element with most of it is named after its layout, such as
    a page with a sidebar, unless it is named as comments are.
    """
    if tag in NEVER or (not inside and tag in OUTSIDE):
        return True
    if tag in ("html", "body", "main", *HEADINGS) or (share > MOSTLY and not names & COMMENTS):
        return False
    return bool(names & NAMES or (not inside and names & OUTSIDE_NAMES))


# A wrapper's node is a list: kind, pages, smallest and largest hash of its text, characters outside links, children.
KIND, PAGES, LEAST, MOST, CHARS, KIDS = range(6)


def groups_of(node: Node) -> list[list[Node]]:
    """The child elements of a node, repeated paragraphs, rows and the like in a row together."""
    runs: list[list[Node]] = []
    for k in node.kids:
        if isinstance(k, Node) and k.tag != "hr":
            if runs and runs[-1][-1].kind == k.kind:
                runs[-1].append(k)
            else:
                runs.append([k])
    return [g for run in runs for g in ([run] if run[0].tag in REPEATED or len(run) >= MANY else [[k] for k in run])]


def tree_of(page: Node) -> list:
    """The wrapper of one page. A group of repeated siblings is one node."""

    def tree(node: Node) -> tuple[list, str]:
        done = {id(k): tree(k) for k in node.kids if isinstance(k, Node)}
        kids = []
        for group in groups_of(node):
            one = done[id(group[0])][0]
            for k in group[1:]:
                one = merged(one, done[id(k)][0])
            if len(group) > 1:
                one[PAGES] = 1
                one[LEAST] = one[MOST] = text_hash(" ".join(done[id(k)][1] for k in group))
            kids.append(one)
        text = " ".join("".join(k if isinstance(k, str) else f" {done[id(k)][1]} " for k in node.kids).split())
        chars = sum(len(k) for k in node.kids if isinstance(k, str) and not isinstance(k, Link)) + sum(k[CHARS] for k in kids)
        digest = text_hash(text)
        return [node.kind, 1, digest, digest, chars, kids], text

    return tree(page)[0]


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def matching(a: list, b: list, known: dict) -> int:
    """The number of nodes in the largest matching of two trees: roots of one kind, children matched in order."""
    if a[KIND] != b[KIND]:
        return 0
    key = (id(a), id(b))
    if key not in known:
        if len(a[KIDS]) * len(b[KIDS]) > COMPARED:
            below = sum(matching(a[KIDS][i], b[KIDS][j], known) for i, j in in_both_orders(a[KIDS], b[KIDS]))
        else:
            below = table_of(a[KIDS], b[KIDS], known)[-1][-1] if a[KIDS] and b[KIDS] else 0
        known[key] = 1 + below
    return known[key]


def table_of(left: list, right: list, known: dict) -> list[list[int]]:
    """The best matching of the first i and first j children, for all i and j."""
    best = [[0] * (len(right) + 1)]
    for a in left:
        row, above = [0], best[-1]
        for j, b in enumerate(right):
            row.append(max(above[j + 1], row[j], above[j] + matching(a, b, known)))
        best.append(row)
    return best


#: Pairs of children that are compared one by one.
COMPARED = 100_000


def pairs(left: list, right: list, known: dict) -> list[tuple[int, int]]:
    """(i, j) of the children that simple tree matching pairs, in order.

    Of very many children, those of one kind that come at the same time are paired, by the longest run in both orders.
    """
    if [x[KIND] for x in left] == [x[KIND] for x in right]:
        return [(i, i) for i in range(len(left))]
    if len(left) * len(right) > COMPARED:
        return in_both_orders(left, right)
    best, i, j, out = table_of(left, right, known), len(left), len(right), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def in_both_orders(left: list, right: list) -> list[tuple[int, int]]:
    """The longest increasing run of pairs of the n-th children of one kind."""
    def nth(kids: list) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        out = []
        for k in kids:
            seen[k[KIND]] = seen.get(k[KIND], 0) + 1
            out.append((k[KIND], seen[k[KIND]]))
        return out

    at = {name: j for j, name in enumerate(nth(right))}
    both = [(i, at[name]) for i, name in enumerate(nth(left)) if name in at]
    ends: list[int] = []
    places: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(both):
        n = bisect_left(ends, j)
        before.append(places[n - 1] if n else -1)
        ends[n : n + 1], places[n : n + 1] = [j], [k]
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def merged(a: list, b: list, known: dict | None = None) -> list:
    """The wrapper of two wrappers of one kind: matched nodes together, others kept in their order."""
    known = {} if known is None else known
    kids, i, j = [], 0, 0
    for p, q in [*pairs(a[KIDS], b[KIDS], known), (len(a[KIDS]), len(b[KIDS]))]:
        kids += a[KIDS][i:p] + b[KIDS][j:q]
        if p < len(a[KIDS]):
            kids.append(merged(a[KIDS][p], b[KIDS][q], known))
        i, j = p + 1, q + 1
    return [a[KIND], a[PAGES] + b[PAGES], min(a[LEAST], b[LEAST]), max(a[MOST], b[MOST]), a[CHARS] + b[CHARS], kids]


def without_rare(tree: list, pages: int) -> list:
    """tree without nodes that fewer than one in RARE of its pages have: they are no part of a wrapper."""
    tree[KIDS] = [without_rare(k, pages) for k in tree[KIDS] if k[PAGES] * RARE >= pages]
    return tree


def merge_all(trees: list[list]) -> list:
    out = trees[0]
    for t in trees[1:]:
        out = merged(out, t)
        if out[PAGES] >= RARE:
            out = without_rare(out, out[PAGES])
    return out


def constant(tree: list, pages: int) -> bool:
    """Whether a node's text is the same in all pages that have it, of which there are enough."""
    return tree[LEAST] == tree[MOST] and tree[PAGES] >= max(MIN_PAGES, MIN_SHARE * pages)


def varying(tree: list, pages: int, whole: int) -> int:
    """Characters below a node that vary between pages, links and what is no part of an article left out.

    whole: the characters of all of the tree.
    """
    tag, *names = tree[KIND].split(" ")
    if foreign(tag, set(names), False, tree[CHARS] / max(1, whole)) or constant(tree, pages):
        return 0
    return tree[CHARS] - sum(k[CHARS] for k in tree[KIDS]) + sum(varying(k, pages, whole) for k in tree[KIDS])


def finish(tree: list) -> list:
    """The wrapper that pages are aligned with: (kind, role, ..) with the role slot, constant or none."""
    pages = tree[PAGES]
    roles: dict[int, str] = {}

    def all_nodes(t: list, tags: tuple[str, ...]) -> Iterator[list]:
        tag, *names = t[KIND].split(" ")
        if tag in tags and t[PAGES] >= MIN_SHARE * pages and not set(names) & NAMES:
            yield t
        elif not foreign(tag, set(names), False):
            for k in t[KIDS]:
                yield from all_nodes(k, tags)

    slots = list(all_nodes(tree, ("article",))) or list(all_nodes(tree, ("main",)))
    if not slots:
        at = tree
        while True:
            below = [k for k in at[KIDS] if k[KIND].split(" ")[0] not in REPEATED]
            if any(k[KIND].split(" ")[0] == "h1" and not constant(k, pages) for k in at[KIDS]) or not below:
                break
            lead = max(below, key=lambda k: varying(k, pages, tree[CHARS]))
            if varying(lead, pages, tree[CHARS]) < LEADS * max(1, varying(at, pages, tree[CHARS])):
                break
            at = lead
        slots = [at]
    for slot in slots:
        roles[id(slot)] = "slot"

    def mark(t: list) -> None:
        for k in t[KIDS]:
            if constant(k, pages):
                roles.setdefault(id(k), "constant")
            mark(k)

    for slot in slots:
        if not constant(slot, pages):
            mark(slot)

    def plain(t: list) -> list:
        return [t[KIND], roles.get(id(t), ""), 0, 0, 0, [plain(k) for k in t[KIDS]]]

    return plain(tree)


def aligned(page: Node, wrapper: list) -> dict[int, str]:
    """The role of each node of a page that simple tree matching pairs with a node of the wrapper that has one."""
    roles: dict[int, str] = {}

    def pair(node: Node, w: list) -> None:
        roles[id(node)] = w[1]
        groups = groups_of(node)
        for i, j in pairs([light(g[0]) for g in groups], w[KIDS], known):
            for k in groups[i]:
                pair(k, w[KIDS][j])

    made: dict[int, list] = {}
    known: dict = {}

    def light(node: Node) -> list:
        if id(node) not in made:
            made[id(node)] = [node.kind, 1, 0, 0, 0, [light(g[0]) for g in groups_of(node)]]
        return made[id(node)]

    pair(page, wrapper)
    return roles


def articles(page: Node, tag: str) -> list[Node]:
    """The elements of a tag that no element foreign to articles surrounds; else those outside comments and the like."""
    for strict in (True, False):
        out: list[Node] = []

        def walk(n: Node, out: list[Node] = out, strict: bool = strict) -> None:
            if n.tag == tag and not n.names & NAMES:
                out.append(n)
            elif not (foreign(n.tag, n.names, False) if strict else n.names & COMMENTS or n.tag == "aside"):
                for k in n.kids:
                    if isinstance(k, Node):
                        walk(k)

        walk(page)
        if out:
            return out
    return []


def main_text(html: str | None, wrapper: list | None = None) -> str:
    """The text of a page's article: its blocks in order, white space of a block as one space, two \\n between blocks."""
    page = parse(html)
    roles = aligned(page, wrapper) if wrapper else {}
    roots: list[Node] = []

    def slots(n: Node) -> None:
        if roles.get(id(n)) == "slot":
            roots.append(n)
        else:
            for k in n.kids:
                if isinstance(k, Node):
                    slots(k)

    found = articles(page, "article") or articles(page, "main")
    if found:
        roots = found
    else:
        slots(page)
    blocks: list[str] = []
    chars: dict[int, int] = {}

    def count(n: Node) -> int:
        chars[id(n)] = sum(count(k) if isinstance(k, Node) else 0 if isinstance(k, Link) else len(k) for k in n.kids)
        return chars[id(n)]

    whole = max(1, count(page)) if not found else 1

    def walk(n: Node, inside: bool) -> None:
        parts: list[str] = []
        for k in [*n.kids, None]:
            if isinstance(k, str):
                parts.append(k)
                continue
            if text := " ".join("".join(parts).split()):
                blocks.append(text)
            parts = []
            if k is not None and roles.get(id(k)) != "constant" and not foreign(k.tag, k.names, inside, chars.get(id(k), 0) / whole):
                walk(k, inside)

    for root in roots or [page]:
        walk(root, bool(roots) and root.tag not in ("html", "body"))
    return "\n\n".join(blocks)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of each host of pages (host, html): partitions make partial ones, which are merged in two levels.

    A partition passes its wrappers on whenever it holds many; no task holds more than these, or one of so many groups
    of a host's partial wrappers.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trees: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"host": pa.array(list(trees), pa.string()), "tree": pa.array([json.dumps(t) for t in trees.values()], pa.string())})
            trees.clear()
            return rows

        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                tree = tree_of(parse(html.as_py()))
                trees[host] = merge_all([trees[host], tree]) if host in trees else tree
                if len(trees) >= 2000:
                    yield out()
        if trees:
            yield out()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [json.loads(t) for t in sorted(pdf["tree"])]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [json.dumps(merge_all(trees))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(pdf).assign(wrapper=lambda d: [json.dumps(finish(json.loads(t))) for t in d["tree"]])[["host", "wrapper"]]

    parts = pages.where("host <> ''").mapInArrow(partial, "host string, tree string").withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(256)))
    return parts.groupBy("host", "part").applyInPandas(merge, "host string, tree string").groupBy("host").applyInPandas(last, "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text, the main text of each, and n_chars, its code points, instead of their html.

    A null or empty page, and one without an article, has an empty text. Urls without a host share no wrapper: their
    pages are judged by tags and names alone. Repeated rows are extracted alike, each counts in its host's wrapper.
    Of articles of any length every block is kept. Columns of pages with the names of the new ones are replaced. An
    empty table gives an empty table.
    """
    new = ["text", "n_chars"]
    kept = pages.drop(*[c for c in new if c not in (url, html)])
    others = [c for c in kept.columns if c != html]
    hosted = lambda d: d.withColumn("_host", F.coalesce(split_url(F.col(url))[0], F.lit("")))
    known = cut(wrappers(hosted(kept.select(url, html)).select(F.col("_host").alias("host"), F.col(html).alias("html"))), "wrappers")

    def work(d: DataFrame) -> DataFrame:
        rows = hosted(d).join(known, F.col("_host") == F.col("host"), "left").drop("_host", "host")
        passed = [c for c in rows.columns if c not in (html, "wrapper")]
        schema = T.StructType([*[rows.schema[c] for c in passed], T.StructField("_text", T.StringType()), T.StructField("_n_chars", T.LongType())])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for whole in batches:
                loaded: dict[str, list] = {}
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    texts = []
                    for page, w in zip(batch.column(html), batch.column("wrapper"), strict=True):
                        w = w.as_py()
                        if w and w not in loaded:
                            loaded[w] = json.loads(w)
                        texts.append(main_text(page.as_py(), loaded.get(w)))
                    columns = [*[batch.column(c) for c in passed], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*passed, "_text", "_n_chars"])

        return rows.mapInArrow(read, schema).withColumn(html, F.lit(None).cast("string"))

    out = shielded(kept, (url, html), work, ["_text", "_n_chars"])
    return out.select(*others, F.col("_text").alias("text"), F.col("_n_chars").alias("n_chars"))


def report(pages: DataFrame) -> DataFrame:
    """The main text of every page."""
    return extract(pages).select("page_id", "url", "text", "n_chars")
