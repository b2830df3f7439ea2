"""HTML extraction, the filter audit and hard negatives against plain versions."""

import html
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose

from canopylens.llm import filter_audit, hard_negatives, html_extract

# HTML extraction

def article_of(page):
    """The article of the given pages, which name it, by regular expressions."""
    m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|$)", lambda t: " " if t[0] == "<br>" else "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    got = html_extract.report(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == pages.count()


def unnamed(host, k):
    """A page whose elements have no telling names: the template of its host, and its article."""
    body = [f"{prose(9000 + 50 * host + k, 30 + j)} &amp; {j}" for j in range(1 + k % 5)]
    menu = "".join(f"<div><a href='/{i}'>Section {host} {i}</a></div>" for i in range(6))
    notice = f"<div class='x{host}'>All rights of host {host} are reserved, and have been for years and years.</div>"
    extra = "<div><div>Today only: a thing that some pages say</div></div>" if k % 3 == 0 else ""
    inside = f"<div>Printed by the press of host {host}</div>"
    page = f"<html><body><div>{menu}</div>{extra}<div><div><h1>Title {host} {k}</h1><div>{''.join(f'<p>{b}' for b in body)}</div>{inside}</div></div>{notice}</body></html>"
    return page, "\n\n".join([f"Title {host} {k}", *(html.unescape(b) for b in body)])


def test_slots_of_pages_without_telling_names(spark):
    made = [(host, k, *unnamed(host, k)) for host in range(4) for k in range(30)]
    pages = [(i, f"http://h{host}.example.org/{k}", page) for i, (host, k, page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in html_extract.report(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == {i: want for i, (_, _, _, want) in enumerate(made)}


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text", "plain text"),
    ("<article>a<br>b  c<p>d&nbsp;e<p>f</article>g", "a b c\n\nd e\n\nf"),
    ("<body><div class=ad>x<article><h1>t</h1>y</article>", "t\n\ny"),
    ("<main><header><h1>t</h1></header><p>a</p><div class='comments'><p>no</p></div><form>no</form><aside>no</aside></main>", "t\n\na"),
    ("<nav>no</nav><header>no</header><div id='cookie-notice'>no</div><p>yes &lt;b&gt; &#233;</p><footer>no</footer>", "yes <b> é"),
    ("<article><p>a<script>var x='</p>'</script> b<style>p{}</style><!-- c --> d</p><ul><li>e<li>f</ul><table><tr><td>g<td>h</table>", "a b d\n\ne\n\nf\n\ng\n\nh"),
    ("<article><p>a < b and 3 &am", "a < b and 3 &am"), ("<article><p>cut off</artic", "cut off"), ("<article><p>a</p><script>never ends", "a"),
    ("<body><div class='page with-sidebar'><div class=menu><a>no</a> no</div><p>A text that is most of what this page holds, and more.</p></div><div class=footer>no</div>", "A text that is most of what this page holds, and more."),
    ("<p>A text.</p><div class=comments><p>A very long comment that is longer than the text, by far, and goes on and on.</p></div>", "A text."),
    ("<section class=comments><article class=comment>no</article></section><article><p title='a > b'>yes</p></article>", "yes"),
    ("<article>" + "<div>" * 150 + "deep" + "</div>" * 150 + "</article>", "deep"), ("<article><p>" + "word " * 100_000, ("word " * 100_000).strip()),
])
def test_single_pages(page, text):
    assert html_extract.main_text(page) == text


def test_very_deep_and_very_wide_pages():
    deep = "<article>" + "".join(f"<div>a{k}" for k in range(3000)) + "<nav>no<nav>no</nav></nav>" + "</div>" * 3000 + "end</article><footer>no</footer>"
    assert html_extract.main_text(deep) == "\n\n".join([*(f"a{k}" for k in range(3000)), "end"])
    wide = [f"<body><div class=x{k}>Article {k} {prose(k, 9)}</div>" + "".join(f"<div class=c{(j * (1 + k)) % 900}>menu</div><p>{k} {j}</p>" for j in range(900)) for k in range(5)]
    trees = [html_extract.tree_of(html_extract.parse(w)) for w in (deep, *wide)]
    whole = html_extract.merge_all(trees[1:])
    assert whole[1] == 5 and html_extract.merged(trees[0], trees[0])[1] == 2
    assert html_extract.main_text(wide[0], html_extract.finish(whole)).count("\n\n") == 900
    left, right = ([["k" + "abc"[(i * m) % 3], 1, 0, 0, 0, []] for i in range(400)] for m in (1, 2))
    both = html_extract.in_both_orders(left, right)
    assert all(a < c and b < d for (a, b), (c, d) in zip(both, both[1:], strict=False)) and all(left[i][0] == right[j][0] for i, j in both) and len(both) > 100


def test_pages_of_one_article_and_odd_tables(spark):
    same = "<html><body><div><p>The one article there is.</p></div></body></html>"
    data = [(i, "http://one.example.org/x", same, "clash") for i in range(9)] + [(20, None, same, None), (21, "no host", same, None), (22, "http://n.example.org/", None, None), (0, "http://one.example.org/x", same, "clash")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, wrapper string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "wrapper", "text", "n_chars"]
    assert Counter((r.page_id, r.text, r.wrapper) for r in got.collect()) == Counter((i, "The one article there is." if h else "", w) for i, _, h, w in data)
    assert html_extract.report(pages.where("false")).count() == 0


def test_matching_is_the_largest_one():
    """Simple tree matching against all order-keeping pairings of small trees."""
    def tree(r, depth):
        return [r.choice("ab"), 1, 0, 0, 1, [tree(r, depth - 1) for _ in range(r.randint(0, 3))] if depth else []]

    def brute(a, b):
        if a[0] != b[0]:
            return 0
        left, right = a[5], b[5]
        return 1 + max(sum(brute(left[i], right[j]) for i, j in zip(p, q, strict=True)) for n in range(min(len(left), len(right)) + 1)
                       for p in itertools.combinations(range(len(left)), n) for q in itertools.combinations(range(len(right)), n))

    r = random.Random(1)
    for _ in range(60):
        a, b = tree(r, 2), tree(r, 2)
        known = {}
        assert html_extract.matching(a, b, known) == brute(a, b)
        both = html_extract.merged(a, b) if a[0] == b[0] else None
        size = lambda t: 1 + sum(map(size, t[5]))  # noqa: B023, E731
        assert both is None or size(both) == size(a) + size(b) - brute(a, b)


# Filter audit

def plain_audit(docs, labels):
    """The contract word by word, every order by itself."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, found in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (f, len(left), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone))
    return {k: (*v[1:], shapley[k[0], v[0]]) for k, v in out.items()}


def test_audit_of_odd_tables(spark):
    long, shout = prose(1, 260, vocabulary=900), prose(2, 250, vocabulary=900).upper()
    texts = [long, long, long, None, "", "", "few words", shout, long + " #", "x " * 300, "é" * 10, "A\tB\x0bC", long]
    docs = [(i, t, ("de", "fr", None)[i % 3]) for i, t in enumerate(texts)] + [(None, long, "de")] * 3 + [(None, "unique to nobody", None), (0, long, "de"), (0, "other text", "de"), (12, long, "it")]
    labels = [(0, 1, 0), (0, 0, 1), (2, 1, 1), (None, 1, 1), (7, None, 1), (77, 1, 1), (12, 1, 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = filter_audit.report(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got.collect()} == plain_audit(docs, labels)
    assert got.count() == 4 * 600
    assert filter_audit.report(table.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_diagrams_keep_their_counts_through_swaps():
    r = random.Random(2)
    for n in (1, 2, 3, 4, 5):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n))) and len(filter_audit.adjacent_swaps(n)) == len(seen) - 1
    counts = {m: (r.randint(0, 5), r.randint(0, 2)) for m in r.sample(range(16), 9)}
    d = filter_audit.Diagram(counts, "abcd")
    for k in [r.randrange(3) for _ in range(50)]:
        d.swap(k)
        assert d.weights[d.root] == tuple(map(sum, zip(*counts.values(), strict=True)))
        passed = [sum(c[0] for m, c in counts.items() if not any(m >> "abcd".index(f) & 1 for f in d.order[: s + 1])) for s in range(4)]
        assert [kept[0] for _, kept, _ in d.steps()] == passed
    assert len(filter_audit.Diagram({0: (1, 1)}, "abcd").kids) == 7  # equal nodes are one: two a level but the first


# Hard negatives

def plain_mining(data):
    kept = {}
    for i, label, v in data:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, (_, v) in kept.items()}
    out = set()
    for a in kept:
        if a % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), b) for b in kept if b != a and len(whole[b]) == len(whole[a]))
            for p, i in [x for x in near if kept[x[1]][0] == kept[a][0]][:5]:
                window = [(s, j) for s, j in near if kept[j][0] != kept[a][0] and 50 * -p <= 100 * -s <= 95 * -p]
                out |= {(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(window[:3], 1)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 16384), (7, 3)])
def test_hard_negatives_of_odd_tables(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[1])
    r = np.random.default_rng(5)
    data = [(i, int(r.integers(0, 3)), [float(np.float32(x)) for x in r.normal(0.3, 0.4, 4)]) for i in range(0, 420, 2)]
    data += [(i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(1, 60, 2)]  # equal scores
    data += [(500, 1, [1e6, -2e6, 3e5, 0.25]), (501, 2, [9e5, -2e6, 3e5, 0.25]), (502, 1, [1e6, -2e6, 3e5, 0.3]), (550, 1, [0.0] * 4)]  # beyond the whole numbers of doubles
    data += [(1000, 1, [1.0, 2.0]), (1001, 1, [1.0, 2.0]), (1002, 2, [1.0, 1.5]), (1003, 2, [])]  # other lengths
    data += [data[0], (50, 0, [0.1, 0.2, 0.3, 0.4]), (None, 1, [1.0] * 4), (600, None, [1.0] * 4), (601, 1, None), (602, 1, [1.0, None, 1.0, 1.0]), (650, 1, [float("nan")] * 4), (652, 1, [float("inf")] * 4)]
    table = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    got = [tuple(x) for x in hard_negatives.mine(table).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_mining(data) and len(got) > 50
    assert hard_negatives.mine(table.where("false")).count() == 0
