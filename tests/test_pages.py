"""Parsing, selection, inspection and extraction over small inline pages."""

import random

import pytest

from pageloom.operators import dom, extract, inspect

TABLE = "<table><tr><th>#</th><th>Country</th><th>Land Area</th></tr>" + "".join(f"<tr><td>{i}</td><td>Land {i}</td><td>{i}00</td></tr>" for i in range(1, 7)) + "</table>"
LIST = "<ul>" + "".join(f"<li><h3>Film number {i}</h3><a href='/f/{i}'>more about {i}</a><span>(199{i})</span></li>" for i in range(4)) + "</ul>"
FORM = "<form action='/s' method='post'><input type='text' name='q'><select name='c'></select><input type=hidden name=h><button>Go</button></form><p>" + "words " * 60 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://s.com/a", TABLE), (2, "http://s.com/b/", LIST), (3, "http://s.com/c", FORM), (4, "http://s.com/d", ""), (5, None, None), (6, "http://s.com/e", "<div id=x class='k m'><p class='k'>one<p>two<b>bold<br>x &amp; y<!-- c --></div><script>'</p>'</script><i data-q='Abc'>z</i>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").cache()


@pytest.fixture(scope="module")
def nodes(pages):
    return dom.parse_pages(pages).cache()


def test_the_lenient_tree():
    rows = dom.parse_html("<div><p>a<br>b<p>c<li>d</div></p><script>var x = '</p>';</script><b>e")
    assert [r["tag"] for r in rows] == ["div", "p", "br", "p", "li", "script", "b"]
    by = {r["pre"]: r for r in rows}
    assert by[1]["post"] == 4 and by[3]["parent"] == 1 and by[4]["parent"] == 3 and by[0]["post"] == 4
    assert by[6]["text"] == "e" and dom.parse_html(None) == [] and dom.parse_html("plain") == []
    implied = dom.parse_html("<ul><li>a<li>b</ul>", implied=True)
    assert [r["parent"] for r in implied] == [-1, 0, 0]


def test_intervals_hold_descendants_only():
    rows = dom.parse_html("<a><b><c></c></b><d></d></a><e></e>" * 5)
    for r in rows:
        inside = {x["pre"] for x in rows if r["pre"] < x["pre"] <= r["post"]}
        kids = {x["pre"] for x in rows if x["parent"] == r["pre"]}
        assert kids <= inside and all(x["parent"] in inside | {r["pre"]} for x in rows if x["pre"] in inside)


@pytest.mark.parametrize(
    "selector, page, want",
    [
        ("div.k.m", 6, 1), ("#x > p", 6, 1), ("#x p", 6, 2), ("p ~ b", 6, 0), ("i[data-q='abc' i]", 6, 1), ("i[data-q^='Ab']", 6, 1), ("i[data-q$='x']", 6, 0), ("i[data-q*='b']", 6, 1), ("p:not(.k)", 6, 1), ("li:first-child", 2, 1),
        ("li:last-child", 2, 1), ("h3, span", 2, 8), ("li > a:has-text('about 2')", 2, 1), ("td ~ td", 1, 12), ("nothing", 1, 0), ("*", 2, 17),
    ],
)
def test_selection(nodes, selector, page, want):
    assert dom.select(nodes, selector).filter(f"page_id = {page}").count() == want


def test_selectors_that_are_not_supported(nodes):
    with pytest.raises(ValueError):
        dom.select(nodes, "p::before")


def test_tables_map_headers_to_fields(nodes):
    got = [r.asDict() for r in extract.from_tables(nodes, ["country", "land_area"]).orderBy("page_id", "item_ord").collect() if r.page_id == 1]
    assert [(r["country"], r["land_area"]) for r in got] == [(f"Land {i}", f"{i}00") for i in range(1, 7)]


def test_lists_give_typed_pieces(nodes, pages):
    got = extract.from_lists(nodes, ["title", "year", "link"], pages).filter("page_id = 2").orderBy("item_ord").collect()
    assert [(r.title, r.year, r.link) for r in got] == [(f"Film number {i}", f"199{i}", f"http://s.com/f/{i}") for i in range(4)]


def test_forms(nodes):
    form = inspect.form_inventory(nodes).filter("page_id = 3").collect()
    assert len(form) == 1
    assert {r.page_id: r.is_search_form for r in inspect.search_forms(nodes).collect()}.get(3) is True
    assert not {r.page_id: r.is_search_form for r in inspect.search_forms(nodes).collect()}.get(1)


def test_pages_without_html_have_no_nodes(nodes, spark):
    assert {r.page_id for r in nodes.select("page_id").distinct().collect()} == {1, 2, 3, 6}
    none = dom.parse_pages(spark.createDataFrame([], "page_id long, html string"))
    assert none.collect() == [] and dom.select(none, "div p").collect() == [] and inspect.page_profile(none).collect() == []


def naive_texts(html):
    """Every element's text by joining its parts, an element after its children."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.out = [], {}
            self.n = 0

        def handle_starttag(self, tag, attrs):
            self.stack.append((tag, self.n, []))
            self.n += 1
            if tag in dom.VOID:
                self.shut()

        def shut(self):
            tag, pre, parts = self.stack.pop()
            whole = "".join(parts)
            lines = [" ".join(x.split()) for x in whole.split("\n")]
            self.out[pre] = "\n".join(x for x in lines if x)
            if self.stack and tag not in dom._NO_TEXT:
                edge = "\n" if tag in dom._BLOCK else ""
                self.stack[-1][2].append(edge + whole + edge)

        def handle_endtag(self, tag):
            if any(t == tag for t, _, _ in self.stack):
                while self.stack[-1][0] != tag:
                    self.shut()
                self.shut()

        def handle_data(self, data):
            if self.stack:
                self.stack[-1][2].append(" ".join(data.split()) if data.strip() and data == data.strip() else __import__("re").sub(r"\s+", " ", data))

    w = Walk()
    w.feed(html)
    w.close()
    while w.stack:
        w.shut()
    return w.out


def test_texts_are_slices_of_one_string():
    rnd = random.Random(3)
    bits = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<li>", "<br>", "<script>", "</script>", "<noscript>", "</noscript>", "<i>", "</i>", "foo", " bar ", "\n", "x  y", "&amp;", "<span>", "</span>", " "]
    for _ in range(3000):
        html = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))
        rows = dom.parse_html(html)
        assert {r["pre"]: r["text"] for r in rows} == naive_texts(html), html


def test_long_and_deep_pages_are_whole(spark):
    words = "word " * 20_000
    deep = "<div>" * 400 + "x" + "</div>" * 400
    df = spark.createDataFrame([(1, "u", f"<table><tr><th>UPC</th><td>{words}</td></tr></table>"), (2, "u", deep)], "page_id long, url string, html string")
    n = dom.node_table(df)
    assert n.filter("tag = 'td'").first().text == words.strip() and n.filter("page_id = 2 AND text = 'x'").count() == 400


@pytest.mark.parametrize("name", ["list_records", "list_items", "page_profile", "next_page", "tier_fallback", "page_links", "container_records", "greedy_assignment"])
def test_queries_parse_a_page_once(spark, name, monkeypatch):
    """The parser's operator runs in one written table at most and never in two branches of the plan."""
    from pageloom import catalog

    parsed = []
    parse = dom.parse_pages
    monkeypatch.setattr(dom, "parse_pages", lambda *a, **k: parsed.append(1) or parse(*a, **k))
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(parsed) == 1 and plan.count("MapInArrow") <= 1


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_nodes_meet_all_elements_around_them(spark, bucket, monkeypatch):
    monkeypatch.setattr(dom, "BUCKET", bucket)
    rnd = random.Random(6)
    html = {k: "".join(rnd.choice(["<div>", "<div>", "</div>", "<b>x</b>", "</div>"]) for _ in range(120)) for k in range(3)}
    n = dom.node_table(spark.createDataFrame([(k, "u", h) for k, h in html.items()], "page_id long, url string, html string"))
    outer = n.filter("tag = 'div'").selectExpr("page_id AS o_page", "pre AS o_pre", "post AS o_post")
    got = sorted((r.page_id, r.pre, r.o_pre) for r in dom.within(n, outer, "o_page", "o_pre", "o_post").collect())
    want = []
    for k, h in html.items():
        rows = dom.parse_html(h)
        want += [(k, x["pre"], o["pre"]) for o in rows if o["tag"] == "div" for x in rows if o["pre"] < x["pre"] <= o["post"]]
    assert got == sorted(want)


def test_letters_of_pages_are_those_of_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from pageloom.queries import pages as q

    html = {1: "<title>this &amp</title><p>a &amp; b&copy;c</p>", 2: "<p>x &Eacute; &#65; &#x41; &frac12 y &nosuch; R&D</p>", 3: "before<p>in</p>after", 4: "", 5: "<style>p{}</style><p>it</p><script>if (a&&b) c</script>"}
    spark.createDataFrame([(k, "u", h) for k, h in html.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, q.QUERIES["page_visible_text"](spark, str(tmp_path)).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(q.ORACLE_SQL["page_visible_text"]).fetchall())


def test_pages_are_given_away_by_rows(monkeypatch):
    """What the parser holds of a long page is what is open, not the page's rows; pieces change nothing."""
    html = "<div class='grid'>" + "".join(f"<p class=c>x {i} &amp; <b>y</b> < z</p><script>if (a<b) {i}</script>" for i in range(3000)) + "</div>"
    whole = dom.parse_html(html)
    monkeypatch.setattr(dom, "PIECE", 1000)
    tree = dom._Tree()
    seen, most, rows = 0, 0, []
    for r in tree.run(html):
        rows.append(r)
        most = max(most, len(tree.ready) + len(tree.stack))
    assert most < 60 and sorted(rows, key=lambda r: r["pre"]) == whole and len(whole) == 9001


def test_tags_that_are_read_fast_are_read_alike(monkeypatch):
    import re

    rnd = random.Random(8)
    bits = ["<p>", "</p>", "<B>", "</b >", "<a HREF='x' b=\"y\">", "</a>", "<i t='&amp;'>", "<i\nid='1'\n c=''>", "</i>", "<br/>", "<script>", "</script>", "<u x=1>", "<u x='1'y='2'>", "< ", "t", "&lt"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(1500)]
    fast = [dom.parse_html(h) for h in pages]
    monkeypatch.setattr(dom, "_PLAIN_START", re.compile("(?!)"))
    monkeypatch.setattr(dom, "_PLAIN_END", re.compile("(?!)"))
    assert fast == [dom.parse_html(h) for h in pages]


def test_book_pages_are_not_shuffled(spark):
    """A page is made, parsed and read in one task; what is dealt is the small rows that pages are made of."""
    from pageloom.operators.dom import spread

    rows = spread(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_partkey")
    pages = rows.selectExpr("p_partkey AS page_id", "'http://b.example/catalogue/x/index.html' AS url", "concat('<h1>', p_name, '</h1><div id=product_description></div><p>d</p><img>') AS html")
    got = extract.detail_records(pages)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and plan.count("MapInArrow") == 1
    assert got.filter("title <> '' AND description = 'd'").count() == rows.count()


def test_detail_pages_of_odd_layout(spark):
    html = "<ul class='breadcrumb'><li>a</li><ul class='breadcrumb'><li>b</li></ul></ul><h1></h1><h1>late</h1><p id='product_description'></p><div><p>no</p></div><p>yes</p><div class='item active'><img alt='x'><img src='/i.jpg'></div>"
    html += "<table><tr><td><table><tr><th>UPC</th><td>in</td></tr></table></td></tr><tr><th>UPC</th><td>out</td></tr><tr><th>UPC</th><td>last</td></tr></table><table><tr><th>Tax</th><td>9</td></tr></table>"
    r = extract.detail_records(spark.createDataFrame([(1, "http://s/x/", html), (2, "http://s/y/", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].description, r[0].breadcrumb, r[0].category, r[0].image_url, r[0].upc, r[0].tax_gbp) == ("", "yes", "a > b > b", "b", "", "last", "")
    assert len(r) == 2 and r[1].title == ""


def test_pages_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """Tasks grow in number with the pages, where a file's splits are few; and only what is asked for is made."""
    spark.range(300).selectExpr("id AS page_id", "'u' AS url", "concat('<a href=/', id, '>', sha2(string(id), 512), '</a><p>t</p>') AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    p = spark.read.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(dom, "SHARE", 1)
    assert dom.spread(p, share=2_000).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    some = dom.parse_pages(p, columns="pre tag text", tags="a")
    assert some.columns == ["page_id", "pre", "tag", "text"] and some.filter("tag = 'a' AND length(text) = 128").count() == some.count() == 300


def _held(tree) -> int:
    """Characters of a page that the parser holds."""
    return sum(map(len, tree.waiting)) + len(tree.rawdata) + sum(len(x) for r in tree.stack for x in [*(r["said"] or ()), *r["bits"], *r["own"]])


def test_of_texts_that_nobody_reads_just_lengths_are_held(monkeypatch):
    html = "<div class='grid'>" + "".join(f"<div class='card'><h3>Part no. {i}</h3><p>some <b>words</b><br>of it</p><script>x()</script> </div>" for i in range(3000)) + "</div>"
    whole = dom.parse_html(html)
    monkeypatch.setattr(dom, "PIECE", 1000)
    for which, held in (({"wanted": frozenset({"text_len", "joined_len"})}, 1300), ({"says": lambda r: r["tag"] == "td", "short": 30, "joins": lambda r: r["tag"] == "h3"}, 1300)):
        tree, most, rows = dom._Tree(**which), 0, []
        for r in tree.run(html):
            rows.append(r)
            most = max(most, _held(tree))
        rows.sort(key=lambda r: r["pre"])
        assert most < held and [(r["text_len"], r["joined_len"]) for r in rows] == [(len(r["text"]), len(r["joined"])) for r in whole]
    assert [r["text"] for r in rows] == [r["text"] if len(r["text"]) <= 30 else "" for r in whole]
    assert [r["joined"] for r in rows] == [r["joined"] if r["tag"] == "h3" else "" for r in whole]


def test_pages_go_to_python_in_parts(spark, monkeypatch):
    """Parts are small, however large a page; they cut characters, tags and texts, and change nothing."""
    htmls = ["<p>é😀 a</p>" * 50, None, "", "no element", "<div>" + "<i a='ß'>ü &amp; ö</i>\n" * 30 + "</div><td>x", "<p>1234567</p>", "<p>twice", "<p>twice"]
    ids = [0, 1, 2, 3, 4, 5, 6, 6]
    pages = spark.createDataFrame(list(zip(ids, htmls)), "page_id long, html string").coalesce(1)
    want = sorted((i, r["pre"], r["post"], r["text"], r["joined"], r["src_from"], r["src_to"]) for i, h in zip(ids, htmls) for r in dom.parse_html(h))
    for part in (1, 7, 4096):
        monkeypatch.setattr(dom, "PART", part)
        parts = dom._parts(pages.select("page_id", "html"))
        assert parts.selectExpr("max(octet_length(part))").first()[0] <= part
        got = dom.parse_pages(pages).select("page_id", "pre", "post", "text", "joined", "src_from", "src_to").collect()
        assert sorted(map(tuple, got)) == want


def test_texts_that_are_not_made_change_no_result(spark):
    """What operators say they read of a page is all that they read."""
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "no. 7", "$9.50", "8.1", "(1999)", "x" * 90, "long " * 50])
    leaf = lambda: rnd.choice(["<h3>{}</h3>", "<span class='price'>{}</span>", "<a href='/x/{}'>{}</a>", "<p class='star-rating Two'></p><p class='price_color'>{}</p>", "{}"]).replace("{}", word())
    card = lambda: rnd.choice(["<div class='card'>{}{}</div>", "<article class='product_pod'><h3><a href='/y'>{}</a></h3>{}</article>", "<li class='item'>{}</li>", "<li>{}</li>"]).replace("{}", leaf())
    table = lambda: "<table><tr><th>title</th><th>price</th></tr>" + "".join(f"<tr><td><b>{word()}</b></td><td>{leaf()}</td></tr>" for _ in range(rnd.randrange(8))) + "</table>"
    body = lambda: "".join(rnd.choice([card, card, card, leaf, table])() for _ in range(rnd.randrange(25)))
    pages = spark.createDataFrame([(i, "http://s/", f"<div id='all'>{body()}<ul>{body()}</ul></div>") for i in range(40)], "page_id long, url string, html string")
    full, fields = dom.node_table(pages), ["title", "price", "link"]
    reads = [
        (extract.PIECES, lambda n: extract.shortcut(n, fields, pages)), (extract.PIECES, lambda n: extract.fallback(n, fields, pages)), (extract.LISTINGS, lambda n: extract.listing_records(n, pages)),
        (inspect.PATTERNS, inspect.repeated_patterns), (inspect.CONTAINER, lambda n: inspect.top_container(n, pages)), (inspect.FIRST_CLASS, inspect.repeated_first_class), (inspect.REPORT, inspect.report_flags),
        (extract.SCOPES, lambda n: extract.refine_containers(n, inspect.find_containers(n, "div.card"), {"t": {"selector": "h3"}, "p": {"selector": ".price"}}).select("page_id", "pre", "selector")),
    ]
    for which, read in reads:
        some = read(dom.node_table(pages, **which))
        got, want = (sorted(map(repr, df.collect())) for df in (some, read(full)))
        assert got == want and got
