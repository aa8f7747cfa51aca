import re

import pytest

from pulsegrid.llm import html_main as op
from pulsegrid.llm import queries

PAGE = """<!DOCTYPE html><html lang="en"><head><title>No</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies</div><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="wrap header-fixed"><article><header><h1>Title &amp; more</h1></header><p><b>Lead&nbsp;text.<br>goes  on<p>Second
 &lt;b&gt; &#233;<a href="x>y">link</a>.</p><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table>
<!-- no <p>comment</p> --><aside>Also read</aside><form><label>Mail</label><input></form><div class="share">Tweet</div>
<section class="comments"><article class="comment"><p>First!</p></article></section><footer>By me</footer></article></div>
<div class="sidebar"><p>Side</p></div><footer>&copy; site</footer></body></html>"""


def test_article_and_nothing_else():
    assert op.main_text(PAGE) == "Title & more\nLead text. goes on\nSecond <b> élink.\none\ntwo\n1 2\n3"


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<main><p>a</p></main><p>out</p>", "a"),
        ("<div role=main><div>a</div>b</div><div>c</div>", "a\nb"),
        ("<article></article><p>all</p>", "all"),
        ("<article>one</article><article>two</article>", "one\ntwo"),
        ("a <b>b</b>c<i> d</i>", "a bc d"),
        ("1 < 2 & 3 &gt; 2 &amp;amp;", "1 < 2 & 3 > 2 &amp;"),
        ("<p>x</p><script>never closed <p>", "x"),
        ("<article><p>cut <a href='of", "cut"),
        ("<!-- never closed <p>x", ""),
        ("<b><p>x</b>y</p>z", "xy\nz"),
        ("<p title='a>b'>x</p><p data=\"1>0\" class=big>y", "x\ny"),
        ("<div class='page has-sidebar'><div class=content><p>a long text of the page</p></div><div class=sidebar>b</div></div>", "a long text of the page"),
        ("<article><div class='entry-header'><h1>T</h1></div><p class=social-science>x</p><div class=notice>n</div><div id=comments>" + "c " * 50 + "</div></article>", "T\nx"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
    ],
)
def test_small_pages(source, text):
    assert op.main_text(source) == text


def test_depth_and_length_are_no_problem():
    assert op.main_text("<div>" * 50_000 + "deep") == "deep"
    assert len(op.main_text("<article>" + "<p>word word</p>" * 30_000)) == 30_000 * 10 - 1
    assert op.main_text("<" * 20_000 + "a='" * 20_000) is not None


def test_templates_go_by_host(spark):
    def page(host, i, extra=""):
        return (i, f"http://{host}/p/{i}", f"<body><div class=x1><p>Template of {host}</p></div><div><p>Own text {i}</p>{extra}</div><div>Bottom <b>line</b></div></body>", "x")

    rows = [page("a.example", i) for i in range(20)] + [page("b.example", i) for i in range(100, 103)]
    rows += [(200 + i, "http://a.example/same", "<body><p>A copy</p></body>", "x") for i in range(30)]
    rows += [(300 + i, f"http://c.example/{i}", f"<article><p>Shared licence line</p><p>Text {i}</p><div class=z>Read on</div></article>", "x") for i in range(12)]
    rows += [(400, None, None, "x"), (401, "no url", "", "x"), (400, None, None, "x"), (None, "http://a.example/q", "<p>q</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {}
    for r in op.extract(df).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Own text 3"]  # recurs on 20 pages of the host
    assert got[101] == ["Template of b.example\nOwn text 101\nBottom line"]  # too few pages
    assert got[205] == ["A copy"]  # copies count once
    assert got[304] == ["Shared licence line\nText 4"]  # plain paragraphs of an article stay
    assert got[400] == ["", ""] and got[401] == [""] and got[None] == ["q"]
    assert op.extract(df.limit(0)).count() == 0


def test_query_on_its_table(spark):
    got = queries.op1_html_main(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert all(r.text and "<" not in r.text and "©" not in r.text for r in got)


def bare(html):
    """The page with nothing left that names its parts: only templates can tell them."""
    for tag in ("nav", "article", "footer", "header"):
        html = re.sub(rf"<(/?){tag}\b[^>]*>", r"<\1div>", html)
    return re.sub(r'<div class="ad">', "<div>", html)


def test_templates_alone_equal_brute_force_and_find_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rows = [(p.page_id, p.url, bare(p.html)) for p in pages]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    hosts, parts = {}, {}
    for i, url, html in rows:
        h = re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", url.lower())
        parts[i] = h, op.Page(html).parts()
        for k, kind in parts[i][1][2].items():
            hosts.setdefault((h, k), (kind, set()))[1].add(html)
    least = (op.MIN_PAGES, op.MIN_PAGES_PLAIN, op.MIN_PAGES_SKELETON)
    deleted = {k for k, (kind, where) in hosts.items() if len(where) >= least[kind]}
    for i, (h, (texts, under, _)) in parts.items():
        assert got[i] == "\n".join(t for t, u in zip(texts, under) if not any((h, x) in deleted for x in u))
    assert any(hosts[k][0] == op.SKELETON for k in deleted)
    large = [p for p in pages if sum(parts[p.page_id][0] == h for h, _ in parts.values()) >= op.MIN_PAGES_SKELETON]
    menus = [re.findall(r"<nav>.*?</nav>", p.html)[0] for p in large]
    names = [[t for t in re.split(r"<[^>]*>", m) if t] for m in menus]
    assert sum(got[p.page_id].split("\n")[: len(n)] != n for p, n in zip(large, names)) >= 0.95 * len(large)
    for p in pages:  # and nothing of the article goes
        assert got[p.page_id].endswith(op.main_text(p.html)) or op.main_text(p.html) in got[p.page_id]


def test_large_hosts_are_treated_like_small_ones(spark):
    """A section's template on 6 of 3,000 pages, a menu of other links on each page, and a list of links that is an article's."""
    def page(i):
        links = "".join(f"<li><a href='/{i}/{k}'>link {i * 7 + k}</a></li>" for k in range(i % 5 + 2))
        promo = "<section class=box>Written by the desk</section>" if i < 6 else ""
        return (i, f"http://big.example/{i}", f"<div id=top><ul>{links}</ul></div><article><h1>Head {i}</h1><p>Text {i}</p>{promo}<ul>{links}</ul></article><div class=low><div><a href='/x{i}'>More {i}</a></div></div>")

    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame([page(i) for i in range(3000)], "page_id long, url string, html string").repartition(4)).collect()}
    for i in (0, 5, 6, 2999):
        assert got[i].split("\n") == [f"Head {i}", f"Text {i}", *(f"link {i * 7 + k}" for k in range(i % 5 + 2))]
    free = {r.page_id: r.text for r in op.extract(spark.createDataFrame([(i, u, h.replace("article", "div")) for i, u, h in map(page, range(3000))], "page_id long, url string, html string").repartition(4)).collect()}
    assert free[2999].split("\n") == ["Head 2999", "Text 2999"]  # a list of links isn't known to be an article's then


def test_recurrence_alone_takes_menus_notices_and_footers(spark):
    """On sf0.1, with nothing left that names a page's parts. What should recur is counted here from the pages' source."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    df = spark.createDataFrame([(p.page_id, p.url, bare(p.html)) for p in pages], "page_id long, url string, html string").repartition(8)
    got = {r.page_id: r.text for r in op.extract(df).collect()}
    fold = lambda x: " ".join(re.sub(r"<[^>]*>", " ", op.charrefs.unescape(x)).split())
    by_host, seen = {}, {}
    for p in pages:
        host = re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", p.url.lower())
        menu, notice, footer = (fold(re.search(x, p.html, re.S)[1]) for x in (r"<nav>(.*?)</nav>", r'<div class="ad">(.*?)</div>', r"<footer>(.*?)</footer>"))
        by_host.setdefault(host, {})[p.html] = (menu, notice, footer)
        for kind, text in (("notice", notice), ("footer", footer)):
            seen.setdefault((host, kind, text), set()).add(p.html)
    alone = whole = total = 0
    for p in pages:
        host = re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", p.url.lower())
        if len(by_host[host]) < op.MIN_PAGES_SKELETON:
            continue
        menu, notice, footer = by_host[host][p.html]
        article = op.main_text(p.html)
        size = len(article) + len(menu) + len(notice) + len(footer)
        for kind, text in (("notice", notice), ("footer", footer)):
            if len(text) < 0.9 * op.SMALL * size or len(seen[host, kind, text]) >= op.MIN_PAGES:
                assert text not in got[p.page_id].split("\n") or text in article.split("\n"), (p.page_id, kind)
        items = [fold(x) for x in re.findall(r"<li>(.*?)</li>", p.html.split("</nav>")[0]) if fold(x)]
        assert len(items) < 2 or got[p.page_id].split("\n")[: len(items)] != items
        total, alone, whole = total + 1, alone + (got[p.page_id] == article), whole + (article in got[p.page_id])
    assert total > 2000 and alone >= 0.95 * total and whole >= 0.98 * total
    marked = {r.page_id: r.text for r in op.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}
    assert all(marked[p.page_id] == op.main_text(p.html) for p in pages)  # where the article is marked, nothing of it goes
