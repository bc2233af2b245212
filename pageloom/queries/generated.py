"""Queries over pages that are made out of the driver's tables, so SQL says from the tables what must come back.

Every nation, brand, part or customer has a page of its own; names, numbers and what is missing vary with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions import values as v
from ..operators import crawl, dom, extract, inspect, nested, records
from ..plans.adapters import Books, Vehicles
from ..sources.readers import read_table
from ..sources.staging import staged
from . import registry

QUERIES, ORACLE_SQL, query = registry()


def _paged(rows: DataFrame, page: str, order: str, item: Column, before: str, after: str, url: str) -> DataFrame:
    """(page_id, url, html): a page for each value of `page`, with the items in order between before and after."""
    body = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))["i"], "")
    made = rows.groupBy(F.col(page).cast("long").alias("page_id")).agg(F.concat(F.lit(before), body, F.lit(after)).alias("html"))
    return made.select("page_id", F.concat(F.lit(url), F.col("page_id").cast("string"), F.lit("/index.html")).alias("url"), "html")


def _rows(spark, d, table: str, key: str) -> DataFrame:
    """A table each of whose rows becomes a page, dealt over tasks while its rows are small: pages are made where they are parsed."""
    return dom.spread(read_table(spark, d, table), key, dom.SHARE >> 4)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- tables (D5, D21, A9) -------------------------------------------------------------------------------
def _customer_tables(spark, d, head: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    row = _text("<tr><td>", F.col("c_custkey"), "</td><td>", F.col("c_name"), "</td><td>", F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), "</td></tr>")
    return _paged(c, "c_nationkey", "c_custkey", row, f"<h1>Customers</h1><table><tr>{head}</tr>", "</table>", "http://t.example/n/")


_CUSTOMERS = """c AS (SELECT c_nationkey AS page_id, c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS segment,
 CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS item_ord FROM customer)"""


@query(f"WITH {_CUSTOMERS} SELECT CAST(page_id AS BIGINT) AS page_id, item_ord, c_name AS customer, segment AS market_segment, CAST(c_custkey AS VARCHAR) AS remark FROM c")
def generated_tables(spark, d):
    """Two fields by their headers; one that no header names takes the first cell that none of them has."""
    n = dom.node_table(_customer_tables(spark, d, "<th>Key</th><th>Customer</th><th>Market segment</th>"))
    return extract.from_tables(n, ["customer", "market_segment", "remark"]).drop("table_pre")


@query(f"WITH {_CUSTOMERS} SELECT CAST(page_id AS BIGINT) AS page_id, item_ord, CAST(c_custkey AS VARCHAR) AS customer, CAST(c_custkey AS VARCHAR) AS market_segment FROM c")
def generated_tables_blank_header(spark, d):
    """D21's hard case: an empty header is contained in every field, so it comes first for all of them."""
    n = dom.node_table(_customer_tables(spark, d, "<th></th><th>Customer</th><th>Market segment</th>"))
    return extract.from_tables(n, ["customer", "market_segment"]).drop("table_pre")


@query(f"WITH {_CUSTOMERS} SELECT CAST(page_id AS BIGINT) AS page_id, count(*) + 1 AS n_rows, 'Key,Customer,Market segment' AS headers, CAST(least(count(*) + 1, 5) AS INT) AS sampled FROM c GROUP BY page_id")
def generated_table_inventory(spark, d):
    """D5, A9."""
    inv = inspect.table_inventory(dom.node_table(_customer_tables(spark, d, "<th>Key</th><th>Customer</th><th>Market segment</th>")))
    return inv.select("page_id", "n_rows", F.array_join("headers", ",").alias("headers"), F.size("rows").alias("sampled"))


# --- cards (D8, D10, D12, D13, D22, D24, D27, W5) ----------------------------------------------------------
def _part_cards(spark, d, some_without_price: bool = False) -> DataFrame:
    p = read_table(spark, d, "part")
    k = F.col("p_partkey")
    price = _text("<span class='price'>$", F.format_string("%.2f", "p_retailprice"), "</span>")
    price = F.when(k % 5 == 0, F.lit("")).otherwise(price) if some_without_price else price
    card = _text("<div class='card'><h3>", F.initcap("p_name"), " no. ", k, "</h3>", price, "<a href='/p/", k, "'>more about it ", k, "</a><span>", k % 9 + 1, ".", k % 10, "</span></div>")
    page = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return _paged(p.withColumn("page", page), "page", "p_partkey", card, "<div class='grid'>", "</div>", "http://c.example/b/")


_PARTS = r"""p AS (SELECT CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS page_id, p_partkey AS k, p_name, p_brand, p_retailprice, p_size,
 CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS item_ord, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"""
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' no. ' || k"


@query(f"WITH {_PARTS} SELECT page_id, item_ord, {_TITLE} AS title, '$' || printf('%.2f', p_retailprice) AS price, (k % 9 + 1) || '.' || (k % 10) AS rating, 'http://c.example/p/' || k AS link FROM p WHERE n >= 10")
def generated_cards(spark, d):
    """Every part's card, on pages of ten and more."""
    p = _part_cards(spark, d)
    return extract.shortcut(dom.node_table(p, **extract.PIECES), ["title", "price", "rating", "link"], p).drop("tier")


@query(f"WITH {_PARTS} SELECT page_id, 'div.card' AS signature, count(*) AS n, CAST(3 AS BIGINT) AS child_tags FROM p WHERE n >= 3 GROUP BY page_id")
def generated_patterns(spark, d):
    """The best pattern of each page."""
    return inspect.repeated_patterns(dom.node_table(_part_cards(spark, d), **inspect.PATTERNS)).filter("rank = 1").select("page_id", "signature", "n", "child_tags")


@query(f"WITH {_PARTS} SELECT page_id, 'div.card' AS selector, count(*) AS n, CAST(2 AS INT) AS samples FROM p WHERE n >= 3 GROUP BY page_id")
def generated_top_container(spark, d):
    """D8, D9, W3."""
    p = _part_cards(spark, d)
    return inspect.top_container(dom.node_table(p, **inspect.CONTAINER), p).select("page_id", "selector", "n", F.size("samples").alias("samples"))


@query(f"WITH {_PARTS} SELECT page_id, 1 AS rank, 'card' AS cls, count(*) AS n FROM p WHERE n BETWEEN 3 AND 200 GROUP BY page_id UNION ALL SELECT page_id, 2, 'price', count(*) FROM p WHERE n BETWEEN 3 AND 200 GROUP BY page_id")
def generated_first_classes(spark, d):
    """A1, D12."""
    return inspect.repeated_first_class(dom.node_table(_part_cards(spark, d), **inspect.FIRST_CLASS)).select("page_id", "rank", "cls", "n")


@query(f"WITH {_PARTS}, g AS (SELECT page_id, count(*) FILTER (k % 5 <> 0) AS priced, count(*) AS n FROM p GROUP BY page_id) SELECT page_id, CASE WHEN priced = 0 THEN n ELSE priced END AS kept FROM g WHERE n >= 2")
def generated_refinement(spark, d):
    """Of the cards those in which most field selectors hit; a fifth has no price."""
    n = dom.node_table(_part_cards(spark, d, True), **extract.SCOPES)
    found = inspect.find_containers(n, "div.card").filter("tag = 'div'")
    kept = extract.refine_containers(n, found, {"title": {"selector": "h3"}, "price": {"selector": ".price"}})
    return kept.groupBy("page_id").agg(F.count("*").alias("kept"))


@query(f"WITH {_PARTS} SELECT page_id, item_ord, {_TITLE} AS name, CASE WHEN k % 5 = 0 THEN (k % 9 + 1) || '.' || (k % 10) ELSE '$' || printf('%.2f', p_retailprice) END AS cost, 'http://c.example/p/' || k AS href FROM p WHERE n >= 2")
def generated_selectors(spark, d):
    """Names and prices by selectors; a card without a price gets its only other number; references by assignment."""
    p = _part_cards(spark, d, True)
    fields = {"name": {"selector": "h4", "backup_selector": "h3", "attribute": "text"}, "cost": {"selector": "b.price", "attribute": "text", "transform": "to_number"}, "href": {"attribute": "href"}}
    return extract.by_selectors(dom.node_table(p), fields, p, "div.card")


# --- lists and pages with several kinds of things (D23, D25, D27) ------------------------------------------------
def _supplier_lists(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    item = _text("<li><h3>", F.col("s_name"), "</h3><a href='../s/", k, ".html'>see them, number ", k, "</a><span>(", k % 60 + 1950, ")</span></li>")
    return _paged(read_table(spark, d, "supplier"), "s_nationkey", "s_suppkey", item, "<ul><li>x</li><li>y</li></ul><ul id='all'>", "</ul>", "http://l.example/n/")


_SUPPLIERS = "s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"


@query(f"WITH {_SUPPLIERS} SELECT CAST(s_nationkey AS BIGINT) AS page_id, CAST(r AS INT) AS item_ord, s_name AS title, CAST(s_suppkey % 60 + 1950 AS VARCHAR) AS year, 'http://l.example/n/s/' || s_suppkey || '.html' AS link FROM s WHERE n >= 3")
def generated_lists(spark, d):
    """Suppliers of nations that have three and more."""
    p = _supplier_lists(spark, d)
    return extract.from_lists(dom.node_table(p), ["title", "year", "link"], p)


@query(f"WITH {_CUSTOMERS} SELECT CAST(page_id AS BIGINT) AS page_id, item_ord, c_name AS customer FROM c WHERE page_id IN (SELECT page_id FROM c GROUP BY page_id HAVING count(*) >= 2)")
def generated_fallback(spark, d):
    """Tables of three rows and more come before anything else."""
    p = _customer_tables(spark, d, "<th>Key</th><th>Customer</th><th>Market segment</th>")
    return extract.fallback(dom.node_table(p), ["customer"], p).drop("tier")


@query(f"""WITH {_CUSTOMERS}, {_SUPPLIERS}, {_PARTS}, t AS (SELECT CAST(page_id AS BIGINT) AS page_id, count(*) + 1 AS n FROM c GROUP BY page_id), u AS (SELECT 2000 + page_id AS page_id, count(*) AS n FROM p GROUP BY page_id),
 l AS (SELECT CAST(1000 + s_nationkey AS BIGINT) AS page_id, count(*) AS n FROM s GROUP BY s_nationkey)
 SELECT page_id, n >= 5 AS table_found, false AS pattern_found, false AS list_found FROM t UNION ALL SELECT page_id, false, false, true FROM l WHERE n >= 3 UNION ALL SELECT page_id, false, n >= 10, false FROM u WHERE n >= 3""")
def generated_report(spark, d):
    """Table pages, list pages and card pages."""
    t, s, c = _customer_tables(spark, d, "<th>Key</th>"), _supplier_lists(spark, d), _part_cards(spark, d)
    every = t.unionByName(s.withColumn("page_id", F.col("page_id") + 1000)).unionByName(c.withColumn("page_id", F.col("page_id") + 2000))
    return inspect.report_flags(dom.node_table(every, **inspect.REPORT)).drop("report")


# --- forms, links, pagination (D3, D4, D6, D36, P8, P14, S8) --------------------------------------------------------
def _nation_pages(spark, d) -> DataFrame:
    n, k = read_table(spark, d, "nation"), F.col("n_nationkey")
    form = F.when(k % 3 < 2, _text("<form action='/find/", k, "' method='", F.when(k % 3 == 0, "post").otherwise("get"), "'><input type='text' name='q", k, "'>", F.when(k % 3 == 0, F.lit("<button>Go</button>")).otherwise(F.lit("")), "<input type='hidden' name='h'></form>")).otherwise(F.lit(""))
    nav = F.when(k % 4 == 0, _text("<ul><li class='next'><a href='page-", k + 1, ".html'>Onward</a></li></ul>")).when(k % 4 == 1, _text("<a href='?page=", k + 1, "'>Next</a>")).when(k % 4 == 2, _text("<a aria-label='Next page' href='/p/", k + 1, "'>on</a>")).otherwise(F.lit("<a href='/login'>Sign in</a>"))
    html = _text("<title>", F.col("n_name"), "</title><p>", F.repeat(F.lit("some words of text "), 20), "</p>", form, nav)
    return n.select(k.cast("long").alias("page_id"), _text("http://n.example/dir/page-", k, ".html").alias("url"), html.alias("html"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS page_id, CASE n_nationkey % 4 WHEN 0 THEN 'http://n.example/dir/page-' || (n_nationkey + 1) || '.html' WHEN 1 THEN 'http://n.example/dir/page-' || n_nationkey || '.html?page=' || (n_nationkey + 1)
 WHEN 2 THEN 'http://n.example/p/' || (n_nationkey + 1) ELSE '' END AS next_url FROM nation""")
def generated_next_pages(spark, d):
    """By class, by text, by label, and none."""
    p = _nation_pages(spark, d)
    return crawl.next_pages(dom.node_table(p), p)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS page_id, 'text_link' AS kind FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT n_nationkey, 'url_pattern' FROM nation WHERE n_nationkey % 4 = 1""")
def generated_pagination_hints(spark, d):
    """D6, U7."""
    return inspect.pagination_hints(dom.node_table(_nation_pages(spark, d))).select("page_id", "kind")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS page_id, '/find/' || n_nationkey AS action, CASE WHEN n_nationkey % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, 'q' || n_nationkey || ':text,h:hidden' AS inputs, n_nationkey % 3 = 0 AS is_search_form
 FROM nation WHERE n_nationkey % 3 < 2""")
def generated_forms(spark, d):
    """Forms with a button, and without."""
    n = dom.node_table(_nation_pages(spark, d))
    f = inspect.form_inventory(n).join(inspect.search_forms(n), "page_id")
    return f.select("page_id", "action", "method", F.array_join(F.transform("inputs", lambda x: F.concat_ws(":", x["name"], x["type"])), ",").alias("inputs"), "is_search_form")


@query("SELECT CAST(n_nationkey AS BIGINT) AS page_id, CAST(1 + CASE n_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS n FROM nation")
def generated_interactive(spark, d):
    """Links, forms, inputs and buttons, hidden inputs aside."""
    return inspect.interactive_elements(dom.node_table(_nation_pages(spark, d))).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS page_id, n_name AS own_text, n_nationkey % 4 = 3 AS skipped FROM nation")
def generated_links(spark, d):
    """Own text of the title, and links that lead nowhere."""
    n = dom.node_table(_nation_pages(spark, d))
    title = n.filter("tag = 'title'").select("page_id", "own_text")
    return title.join(inspect.link_sample(n).groupBy("page_id").agg(F.bool_and(urls.is_skipped_link("href")).alias("skipped")), "page_id")


@query("SELECT CAST(n_nationkey AS BIGINT) AS page_id, CAST(3 AS BIGINT) AS browser_items, CAST(1 AS BIGINT) AS lenient_items FROM nation")
def generated_implied_ends(spark, d):
    """D1's two parsers: list items without end tags stand beside one another or within."""
    p = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), _text("<ul><li>", F.col("n_name"), "<li>b<li>c</ul>").alias("html"))
    count = lambda implied, name: dom.parse_pages(p, implied).filter("tag = 'li' AND parent = 0").groupBy("page_id").agg(F.count("*").alias(name))
    return count(True, "browser_items").join(count(False, "lenient_items"), "page_id")


# --- books (D30, D31, E6) ----------------------------------------------------------------------------------------
_WORDS = ["Zero", "One", "Two", "Three", "Four", "Five"]


def _book_pages(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 6 + 1).cast("int"))
    stock = F.when(k % 3 == 0, F.lit("Out of stock")).otherwise(_text("In stock (", F.col("p_size"), " available)"))
    html = _text(
        "<ul class='breadcrumb'><li>Home</li><li>", F.col("p_brand"), "</li><li>", F.col("p_name"), "</li></ul><div class='product_main'><h1>", F.when(k % 11 == 0, F.lit("")).otherwise(F.col("p_name")), "</h1><p class='price_color'>£",
        F.format_string("%.2f", "p_retailprice"), "</p><p class='instock availability'>", stock, "</p><p class='star-rating ", word, "'></p></div><div id='product_description'><h2>On it</h2></div><p>",
        F.repeat(_text("About ", F.col("p_name"), ". "), 400), "</p><table><tr><th>UPC</th><td>", F.when(k % 7 == 0, F.lit("")).otherwise(_text("u", k)), "</td></tr><tr><th>Tax</th><td>£0.00</td></tr></table>",
    )
    return _rows(spark, d, "part", "p_partkey").select(k.alias("page_id"), _text("http://b.example/catalogue/", k, "/index.html").alias("url"), html.alias("html"))


_BOOKS = """b AS (SELECT *, p_partkey AS k, 'http://b.example/catalogue/' || p_partkey || '/index.html' AS url FROM part WHERE p_partkey % 11 <> 0)"""


@query(
    f"""WITH {_BOOKS} SELECT url AS product_page_url, CASE WHEN k % 7 = 0 THEN left(sha1(url), 16) ELSE 'u' || k END AS book_id, p_name AS title, printf('%.2f', p_retailprice) AS price_gbp, CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS stock_count,
 CASE k % 6 WHEN 0 THEN '' ELSE list_extract(['One', 'Two', 'Three', 'Four', 'Five'], CAST(k % 6 AS INT)) END AS rating_text, CASE k % 6 WHEN 0 THEN '' ELSE CAST(k % 6 AS VARCHAR) END AS rating_value, p_brand AS category,
 'Home > ' || p_brand || ' > ' || p_name AS breadcrumb, '0.00' AS tax_gbp, CAST(length('About ' || p_name || '. ') * 400 - 1 AS INT) AS n_description, CASE WHEN k % 5 = 0 THEN 'http://b.example/list' ELSE '' END AS catalogue_page_url FROM b"""
)
def generated_books(spark, d):
    """The books adapter end to end; descriptions of thousands of characters are whole."""
    p, adapter = _book_pages(spark, d), Books()
    listed = p.filter("page_id % 5 = 0").select("url", F.lit("http://b.example/list").alias("catalogue_page_url"))
    rows = adapter.rows(adapter.extract(p, listed))
    return rows.select("product_page_url", "book_id", "title", "price_gbp", "stock_count", "rating_text", "rating_value", "category", "breadcrumb", "tax_gbp", F.length("description").alias("n_description"), "catalogue_page_url")


@query(f"WITH {_BOOKS} SELECT 'duplicate_book_detected' AS category, count(*) AS n FROM b HAVING count(*) > 0")
def generated_book_issues(spark, d):
    """The adapter's checks over two deliveries of every book."""
    adapter = Books()
    books = staged(adapter.extract(_book_pages(spark, d)).select(*adapter.checked), "books")
    return adapter.validate(books.unionByName(books))


@query(
    f"""WITH {_PARTS} SELECT page_id, item_ord, p_name AS title, 'http://c.example/b/' || page_id || '/item/' || k || '.html' AS detail_url, printf('%.2f', p_retailprice) AS price_gbp, CASE WHEN k % 6 > 0 THEN CAST(k % 6 AS INT) END AS rating_value FROM
 (SELECT * EXCLUDE item_ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS item_ord FROM p WHERE k % 8 <> 0)"""
)
def generated_listings(spark, d):
    """A listing page a brand; items without a link go."""
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 6 + 1).cast("int"))
    link = F.when(k % 8 == 0, F.lit("<a title='gone'>x</a>")).otherwise(_text("<a href='item/", k, ".html' title='", F.col("p_name"), "'>", F.left("p_name", F.lit(3)), "...</a>"))
    item = _text("<article class='product_pod'><h3>", link, "</h3><p class='star-rating ", word, "'></p><p class='price_color'>£", F.format_string("%.2f", "p_retailprice"), "</p></article>")
    page = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    p = _paged(read_table(spark, d, "part").withColumn("page", page), "page", "p_partkey", item, "<section>", "</section>", "http://c.example/b/")
    return extract.listing_records(dom.node_table(p, **extract.LISTINGS), p).select("page_id", "item_ord", "title", "detail_url", "price_gbp", "rating_value")


# --- vehicles (D32 to D34, E6) --------------------------------------------------------------------------------------
def _vehicle_pages(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    a = _text("car-", k, "-20l-v6-6mt-rwd-", k % 300 + 90, "-hp")
    label = F.when(k % 2 == 0, _text("3.0L V8 9AT AWD (", k % 300 + 91, " HP)")).otherwise(F.lit("2019"))
    other = F.when(k % 4 == 0, F.lit("<li id='li_eng_van-1-20l'><a href='#aeng_van-1-20l'>van</a></li>")).otherwise(F.lit(""))
    html = _text(
        "<p>Available with 1 engine</p><ul><li id='li_eng_", a, "'><a href='#aeng_", a, "'>", label, "</a></li>", other, "</ul><table class='techdata'><tr><td colspan='2'>ENGINE SPECS - ", k, "</td></tr><tr><td>Name:</td><td>", F.col("c_name"),
        "</td></tr><tr><td>Power</td><td>", k % 300 + 90, " HP</td></tr><tr><td colspan='2'>nothing to see</td></tr><tr><td colspan='2'>FUEL ECONOMY</td></tr><tr><td>Segment:</td><td>", F.when(k % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")),
        "</td></tr></table>",
    )
    return _rows(spark, d, "customer", "c_custkey").select(k.alias("page_id"), _text("http://v.example/car-", k, ".html").alias("url"), html.alias("html"))


_CARS = """e AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey, 'http://v.example/car-' || c_custkey || '.html' AS url, 'aeng_car-' || c_custkey || '-20l-v6-6mt-rwd-' || (c_custkey % 300 + 90) || '-hp' AS anchor,
  CASE WHEN c_custkey % 2 = 0 THEN '3.0L V8 9AT AWD (' || (c_custkey % 300 + 91) || ' HP)' ELSE '2.0L V6 6MT RWD (' || (c_custkey % 300 + 90) || ' HP)' END AS engine_name FROM customer),
 i AS (SELECT *, 1 AS position, 'ENGINE SPECS' AS section_name, 'Name' AS spec_label, c_name AS spec_value FROM e UNION ALL SELECT *, 2, 'ENGINE SPECS', 'Power', (k % 300 + 90) || ' HP' FROM e
  UNION ALL SELECT *, 3, 'FUEL ECONOMY', 'Segment', c_mktsegment FROM e WHERE k % 3 <> 0)"""


@query(
    f"""WITH {_CARS} SELECT sha1(url || '|' || anchor) AS engine_id, anchor AS engine_anchor_id, url || '#' || anchor AS engine_url, engine_name, n_name AS brand_name, section_name, spec_label, spec_value, CAST(position AS INT) AS position,
 sha1(sha1(url || '|' || anchor) || '|' || section_name || '|' || spec_label || '|' || spec_value) AS spec_id FROM i JOIN nation ON c_nationkey = n_nationkey"""
)
def generated_vehicles(spark, d):
    """The vehicles adapter end to end, a page a customer."""
    p = _vehicle_pages(spark, d)
    inputs = read_table(spark, d, "customer").select(_text("http://v.example/car-", F.col("c_custkey"), ".html").alias("model_year_url"), F.lit("2019").alias("model_year_label"), F.col("c_custkey").cast("string").alias("model_year_id"), F.lit("m").alias("model_id"), F.col("c_nationkey").cast("string").alias("brand_id"))
    brands = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("brand_id"), F.col("n_name").alias("name"))
    adapter = Vehicles(brands)
    return adapter.rows(adapter.extract(p, inputs)).select("engine_id", "engine_anchor_id", "engine_url", "engine_name", "brand_name", "section_name", "spec_label", "spec_value", "position", "spec_id")


@query(f"WITH {_CARS} SELECT 'missing_engine_' || f AS category, count(*) AS n FROM e, (SELECT unnest(['brand_name', 'model_name', 'model_id', 'model_year_id', 'model_year_label']) AS f) GROUP BY f UNION ALL SELECT 'brand_id_orphan', count(*) FROM e WHERE c_nationkey % 5 = 0 HAVING count(*) > 0")
def generated_vehicle_issues(spark, d):
    """What the adapter's checks say of engines without labels, models and names, a fifth of whose brands no lookup has."""
    p = _vehicle_pages(spark, d)
    plain = Vehicles().extract(p).drop("brand_id").join(read_table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").cast("string").alias("brand_id")), "page_id")
    return Vehicles(read_table(spark, d, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("brand_id"))).validate(plain)


@query("SELECT c_custkey AS page_id, CAST(1 AS INT) AS expected, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS INT) AS harvested FROM customer")
def generated_anchors(spark, d):
    """D33, F23, U6."""
    n = dom.node_table(_vehicle_pages(spark, d))
    said = n.filter("tag = 'p'").select("page_id", v.expected_count("text").alias("expected"))
    return said.join(extract.harvest_anchors(n).select("page_id", F.size("anchors").alias("harvested")), "page_id")


@query(
    """WITH s AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 90 + 10) || ' KWH' ELSE printf('%.1f', c_custkey % 90 + 10.5) || ' KWH' END END AS kwh FROM customer)
 SELECT c_custkey, kwh AS battery, CASE WHEN c_custkey % 3 = 0 THEN kwh || ' AWD (' || (c_custkey % 300 + 90) || ' HP)' WHEN c_custkey % 3 = 1 THEN '2.0L L4 6MT FWD (' || (c_custkey % 300 + 90) || ' HP)' ELSE (c_custkey % 300 + 90) || ' HP' END AS name,
  (c_custkey % 300 + 90) || ' HP' AS power FROM s"""
)
def generated_spec_names(spark, d):
    """Electric engines, burning ones, and such of which only the power is known."""
    k = F.col("c_custkey")
    item = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    power = item("Power", _text(k % 300 + 90, " hp @ 5000"))
    size = F.when(k % 2 == 0, (k % 90 + 10).cast("string")).otherwise(F.format_string("%.1f", (k % 90) + F.lit(10.5)))
    electric = F.array(item("Fuel", F.lit("Electric")), power, item("Battery Capacity", F.lit("5 kWh")), item("Capacity (net)", _text(size, " kWh")), item("Drive Type", F.lit("All Wheel Drive")))
    burning = F.array(item("Displacement", F.lit("1998 cc")), item("Cylinders", F.lit("L4")), power, item("Gearbox", F.lit("6-Speed Manual")), item("Drive Type", F.lit("front wheel drive")))
    items = F.when(k % 3 == 0, electric).when(k % 3 == 1, burning).otherwise(F.array(power))
    c = read_table(spark, d, "customer").select("c_custkey", F.array(F.struct(F.lit("A").alias("section_name"), F.slice(items, 1, 1).alias("items")), F.struct(F.lit("B").alias("section_name"), F.slice(items, 2, 9).alias("items"))).alias("s"))
    c = c.select("c_custkey", v.battery("s").alias("battery"), v.name_from_specs("s").alias("name"), v.label_value("s", "power", "total maximum power").alias("power"))
    return c.withColumn("power", F.regexp_replace("power", " hp @ 5000", " HP"))


@query(f"WITH {_CARS} SELECT k, anchor, k % 4 > 0 AS of_page, length(anchor) > 10 AS valid, k % 2 = 1 AS generic FROM e")
def generated_anchor_tests(spark, d):
    """P9 to P11."""
    k = F.col("c_custkey")
    a = _text("aeng_car-", k, "-20l-v6-6mt-rwd-", k % 300 + 90, "-hp")
    page = F.when(k % 4 == 0, F.lit("http://v.example/van.html")).otherwise(_text("http://v.example/car-", k, ".html"))
    label = F.when(k % 2 == 1, F.lit("2019-2021")).otherwise(F.lit("2019 model"))
    return read_table(spark, d, "customer").select(k.alias("k"), a.alias("anchor"), urls.anchor_of_page(a, page).alias("of_page"), urls.valid_anchor(a).alias("valid"), v.is_generic_label(label).alias("generic"))
