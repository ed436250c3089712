"""Extraction on pages of many shapes, importances against a slow style tree, and the given pages' articles."""

import html as entities
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from terravane.llm import site_tree
from terravane.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def alone(html):
    page = site_tree.Page(html)
    return "\n\n".join(page.blocks(page.keys(""), set()))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("just  text\n", "just text"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"),
        ("<p>a<br>b &amp; c&nbsp;d &lt;p&gt; &copy &#233;</p>", "a b & c d <p> © é"),
        ("<script>var t='</p><p>x';</script><p>a<style>p{}</style>b", "ab"),
        ("<p>a<!-- <p>no</p> -->b<!-->c", "abc"),
        ("<p>a < b and 3<4</p><p>x &am", "a < b and 3<4\n\nx &am"),
        ("<p>kept</p><p class='x", "kept"),
        ("<nav>m</nav><header>h</header><article><h1>T</h1><p>a</p></article><aside>s</aside><footer>f</footer>", "T\n\na"),
        ("<article><header><h1>T</h1></header><p>a</p><footer>by</footer></article>", "T\n\na"),
        ("<ARTICLE><P>A<B>b<BR><P>c</ARTICLE>out", "Ab\n\nc"),
        ("<main><p>a</p><div class='comments'><p>no</p></div><form>f</form></main><p>out</p>", "a"),
        ("<div class='page sidebar-left'><article><p>a</p></article></div>", "a"),
        ("<form id='aspnet'><main>a</main></form>", "a"),
        ("<div id='sidebar-1'>s</div><div class='postAd'>x</div><div class='cookieNotice'>n</div><p>a</p>", "a"),
        ("<div class='shadow header-less adaptive'>a</div>", "a"),
        ("<p hidden>h</p><p style='display: none'>h</p><p>a</p>", "a"),
        ("<div class='content'>" + "main words " * 9 + "</div><div>x</div>", ("main words " * 9).strip()),
        ("<div class='box'><div class='content'>ad</div></div><div>" + "other words " * 9 + "</div>", "ad\n\n" + ("other words " * 9).strip()),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>", "a\n\nb\n\nc\n\nd\n\ne\n\nf"),
        ("<article>a</article><div><article class='comment'>no</article></div><article>b</article>", "a\n\nb"),
        ("<div a=\"x>y\" b='>' c=>t</div>", "t"),
        ("</p></div>x</b></article>y", "xy"),
        ("<p>" + "<b>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\n\ner"),
        ("<article></article><p class='ad'>x</p>", ""),
    ],
)
def test_pages(html, want):
    assert alone(html) == want


def slow_importances(pages):
    """The same tree by dictionaries: presentation and content of each element."""
    seen = defaultdict(list)
    for site, html in pages:
        page = site_tree.Page(html)
        for key, (chain, children, texts) in page.layout(page.keys(site)).items():
            seen[key].append((tuple(chain), " ".join(children), Counter(" ".join(texts).lower().split())))

    def entropy(values, m):
        total = sum(values)
        return -sum(v / total * math.log(v / total, m) for v in values if v)

    out = {}
    for key, rows in seen.items():
        told = [w for _, _, w in rows if w]
        total = sum(sum(w.values()) for w in told)
        content = 0.0 if not told else 1.0
        if len(told) > 1:
            words = set().union(*told)
            content = 1 - sum(sum(w[x] for w in told) / total * entropy([w[x] for w in told], len(told)) for x in words)
        looks = entropy(list(Counter(r[1] for r in rows).values()), len(rows)) if len(rows) > 1 else 1.0
        out[key] = 1.0 if len(rows) < site_tree.MIN_PAGES else max(content, looks)
    return out


def site(n, rng, extra=""):
    """Pages of one host without any telling names; the same box of links and motto stand on each."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    pages, texts = [], []
    for i in range(n):
        paras = [" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(rng.randrange(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in paras)
        pages.append(f"<body><div id=x{i}><ul><li>Home<li>About us<li>Contact</ul></div>{extra}<div class=z>{body}</div><div><p>All our best wishes to you, number {i}</p></div></body>")
        texts.append("\n\n".join(paras))
    return pages, texts


def test_low_branches_are_removed_from_every_page(spark):
    rng = random.Random(3)
    pages, texts = site(30, rng)
    other, _ = site(2, rng)
    rows = [(i, f"http://www.One.example/{i}", h) for i, h in enumerate(pages)] + [(100 + i, f"http://two.example/{i}", h) for i, h in enumerate(other)]
    table = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], "page_id long, url string, html string, site string, node string, `a.b` string")
    got = {r.page_id: r.text for r in site_tree.extract(table).collect()}
    assert [got[i] for i in range(30)] == texts
    assert all("Contact" in got[100 + i] for i in range(2))  # two pages tell nothing
    tree = site_tree.importances(table, Scratch(spark)).collect()
    want = slow_importances([("www.one.example", h) for h in pages] + [("two.example", h) for h in other])
    assert {r.node for r in tree} == set(want) and len(tree) == len(want)
    assert all(math.isclose(r.importance, want[r.node], abs_tol=1e-9) for r in tree)


def test_shuffled_branches_give_the_same(spark, monkeypatch):
    pages, texts = site(12, random.Random(4))
    table = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    monkeypatch.setattr(site_tree, "BROADCAST_BRANCHES", -1)
    assert {r.page_id: r.text for r in site_tree.extract(table).collect()} == dict(enumerate(texts))


def test_copies_of_a_page_keep_their_article(spark):
    one, text = site(1, random.Random(6))
    article = f"<article><h1>T</h1>{one[0]}</article>"
    near = [article.replace("wishes", f"wishes{i}") for i in range(40)]
    table = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate([article] * 40 + near)], "page_id long, url string, html string")
    for r in site_tree.extract(table).collect():
        assert text[0] in r.text


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (2, "no host", ""), (3, "http:///x", "<p>b ☃\U0001f600"), (4, "http://h/", "<p>" + "word " * 300_000)]
    rows += [(5, "http://h/", None), (6, "http://h/", "<nav>only</nav>"), (7, "http://h", "\x00<p>c퟿")]
    out = site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in out.collect())
    want = [("None", "None", ""), ("1", "None", "a"), ("1", "None", "a"), ("2", "no host", ""), ("3", "http:///x", "b ☃\U0001f600"), ("4", "http://h/", ("word " * 300_000).strip())]
    want += [("5", "http://h/", ""), ("6", "http://h/", ""), ("7", "http://h", "\x00\n\nc퟿")]
    assert got == sorted((*w, len(w[2])) for w in want)
    assert site_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_give_their_articles(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in site_tree.extract(table).collect()}
    for r in table.collect():
        found = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        inner = re.sub(r"<[^>]*\Z", "", found[1] if found else "")
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner.replace("<b>", ""))]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
