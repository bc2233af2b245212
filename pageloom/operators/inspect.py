"""What a page is made of: repeated patterns, tables, lists, forms, pagination, profiles. All groupings of the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import dom

_SKIP = "script style noscript link meta br hr img svg path input button select textarea iframe video audio source canvas picture figure".split()


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def is_cell(row: dict) -> bool:
    return row["tag"] in ("td", "th")


# What operators read of a page, for node_table(pages, **...): other texts are not made.
PATTERNS = {"columns": "pre parent tag id classes attrs hidden text_len"}  # repeated_patterns
CONTAINER = {"columns": "pre post tag classes joined_len src_from src_to"}  # top_container
FIRST_CLASS = {"columns": "pre tag classes"}  # repeated_first_class
REPORT = {"columns": "pre post parent tag id classes attrs hidden text text_len", "says": is_cell}  # report_flags


def distinct_classes() -> Column:
    """Sorted distinct class names with points between: one inspector's signature."""
    return F.array_join(F.array_sort(F.array_distinct("classes")), ".")


def repeating_classes(nodes: DataFrame, least: int = 5) -> DataFrame:
    """(page_id, combo, n, first_pre) of class combinations that occur at least `least` times, in document order of the first."""
    with_class = nodes.filter(F.size("classes") > 0).withColumn("combo", distinct_classes())
    return with_class.groupBy("page_id", "combo").agg(F.count("*").alias("n"), F.min("pre").alias("first_pre")).filter(F.col("n") >= least)


def link_sample(nodes: DataFrame, most: int = 100) -> DataFrame:
    """D3: the first references of a page, (page_id, ord, href, text)."""
    links = nodes.filter((F.col("tag") == "a") & _attr("href").isNotNull())
    w = Window.partitionBy("page_id").orderBy("pre")
    return links.select("page_id", F.row_number().over(w).alias("ord"), _attr("href").alias("href"), "text").filter(F.col("ord") <= most)


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner nodes with the outer node that holds them: page_id, o_pre and inner's columns. An interval join next to page equality."""
    o = outer.select(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    return dom.within(inner, o, "o_page", "o_pre", "o_post").drop("o_page", "o_post")


def form_inventory(nodes: DataFrame) -> DataFrame:
    """(page_id, form_ord, action, method, inputs array<struct<name, type>>)."""
    forms = nodes.filter("tag = 'form'")
    inputs = _inside(nodes.filter(F.col("tag").isin("input", "select", "textarea")), forms)
    each = inputs.groupBy("page_id", "o_pre").agg(F.array_sort(F.collect_list(F.struct("pre", F.coalesce(_attr("name"), F.lit("")).alias("name"), F.coalesce(_attr("type"), F.lit("")).alias("type")))).alias("i"))
    ord_ = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).alias("form_ord")
    f = forms.select("page_id", "pre", ord_, F.coalesce(_attr("action"), F.lit("")).alias("action"), F.upper(F.coalesce(_attr("method"), F.lit("get"))).alias("method"))
    got = f.join(each.withColumnRenamed("o_pre", "pre"), ["page_id", "pre"], "left")
    return got.select("page_id", "form_ord", "action", "method", F.coalesce(F.transform("i", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))), F.array().cast("array<struct<name:string,type:string>>")).alias("inputs"))


def table_cells(nodes: DataFrame) -> DataFrame:
    """Every cell: (page_id, table_pre, row_pre, row_ord, cell_ord, cell_tag, colspan, text), in its innermost table and row."""
    rows = _inside(nodes.filter("tag = 'tr'").select("page_id", "pre", "post"), nodes.filter("tag = 'table'"))
    rows = rows.groupBy("page_id", "pre", "post").agg(F.max("o_pre").alias("table_pre"))
    cells = _inside(nodes.filter("tag IN ('td', 'th')"), rows)
    cells = cells.withColumnRenamed("o_pre", "row_pre").withColumn("deepest", F.max("row_pre").over(Window.partitionBy("page_id", "pre"))).filter("row_pre = deepest")
    cells = cells.join(rows.select("page_id", F.col("pre").alias("row_pre"), "table_pre"), ["page_id", "row_pre"])
    return cells.select(
        "page_id", "table_pre", "row_pre", (F.dense_rank().over(Window.partitionBy("page_id", "table_pre").orderBy("row_pre")) - 1).alias("row_ord"),
        (F.row_number().over(Window.partitionBy("page_id", "row_pre").orderBy("pre")) - 1).alias("cell_ord"), F.col("tag").alias("cell_tag"), F.coalesce(_attr("colspan"), F.lit("1")).alias("colspan"), "text",
    )


def table_inventory(nodes: DataFrame, sample_rows: int = 5) -> DataFrame:
    """(page_id, table_pre, headers, n_rows, rows): texts of header cells and of the data cells of the first rows."""
    c = table_cells(nodes)
    row = c.groupBy("page_id", "table_pre", "row_ord").agg(
        F.array_sort(F.collect_list(F.when(F.col("cell_tag") == "td", F.struct("cell_ord", "text")))).alias("td"), F.array_sort(F.collect_list(F.when(F.col("cell_tag") == "th", F.struct("cell_ord", "text")))).alias("th")
    )
    row = row.select("page_id", "table_pre", "row_ord", F.col("td.text").alias("td"), F.col("th.text").alias("th"))
    return row.groupBy("page_id", "table_pre").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("row_ord", "th")))["th"]).alias("headers"),
        F.count("*").alias("n_rows"),
        F.array_sort(F.collect_list(F.when(F.col("row_ord") < sample_rows, F.struct("row_ord", "td"))))["td"].alias("rows"),
    )


def pagination_hints(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, kind, text, href, class), up to three rows a link."""
    a = nodes.filter((F.col("tag") == "a") & _attr("href").isNotNull()).select("page_id", "pre", F.lower("joined").alias("text"), _attr("href").alias("href"), F.lower(F.array_join("classes", " ")).alias("class"))
    kinds = F.filter(
        F.array(
            F.when(F.col("text").rlike("next|prev|page|[»«→←]"), F.lit("text_link")), F.when(F.col("class").rlike("pagination|page"), F.lit("class_hint")),
            F.when(F.col("href").contains("?page=") | F.col("href").contains("/page/"), F.lit("url_pattern")),
        ),
        lambda x: x.isNotNull(),
    )  # "previous" has "prev", and "pager" has "page"
    return a.select("page_id", "pre", F.explode(kinds).alias("kind"), "text", "href", "class")


def visible_text(nodes: DataFrame, most: int = 2000) -> DataFrame:
    """(page_id, text): text outside scripts and styles, one line, cut."""
    root = nodes.filter("parent = -1 AND tag NOT IN ('script', 'style', 'noscript', 'template')")
    t = root.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pre", "text")))["text"], " ").alias("t"))
    return t.select("page_id", F.left(tx.collapse("t"), F.lit(most)).alias("text"))


def top_container(nodes: DataFrame, pages: DataFrame, least: int = 3, samples: int = 2) -> DataFrame:
    """(page_id, selector, n, score, samples): the richest repeated tag-and-class signature (descendants of its first element
    times its text) and scrubbed HTML of the first ones. Earliest wins ties; pages without one have no row."""
    noise = nodes.filter("tag IN ('script', 'style', 'noscript', 'link', 'meta')").groupBy("page_id").agg(F.collect_list("pre").alias("noise"))
    n = nodes.filter((F.size("classes") > 0) & ~F.col("tag").isin("script", "style", "noscript", "link", "meta")).withColumn("sig", F.concat_ws(".", "tag", distinct_classes()))
    w = Window.partitionBy("page_id", "sig").orderBy("pre")
    n = n.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("page_id", "sig"))).filter((F.col("n") >= least) & (F.col("k") <= max(samples, 1)))
    n = n.join(noise, "page_id", "left")
    desc = F.col("post") - F.col("pre") - F.coalesce(F.size(F.filter("noise", lambda x: (x > F.col("pre")) & (x <= F.col("post")))), F.lit(0))
    n = n.withColumn("desc", desc)
    html = pages.select("page_id", "html")
    first = n.filter((F.col("k") == 1) & (F.col("desc") >= 2) & (F.col("joined_len") >= 15)).withColumn("score", F.col("desc") * F.col("joined_len"))
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pre"))).filter("r = 1").select("page_id", "sig", "n", "score")
    taken = n.select("page_id", "sig", "k", "src_from", "src_to").join(best, ["page_id", "sig"]).join(html, "page_id")
    piece = tx.scrub_snapshot(F.substr("html", F.col("src_from") + 1, F.col("src_to") - F.col("src_from")))
    return taken.groupBy("page_id", F.col("sig").alias("selector"), "n", "score").agg(F.array_sort(F.collect_list(F.struct("k", piece.alias("s"))))["s"].alias("samples"))


def repeated_patterns(nodes: DataFrame, least: int = 3, least_text: int = 3, top: int = 8) -> DataFrame:
    """(page_id, rank, signature, n, avg_text, child_tags, score, first_pre) of visible elements with a class, id, role or
    data-testid. score = n * (child tags of the first three + 1) * min(average text of those, 200); ties go to the earlier."""
    seen = nodes.filter(~F.col("tag").isin(*_SKIP, "html", "body", "head", "title") & ~F.col("hidden"))
    names = F.array_sort(F.filter("classes", lambda c: (F.length(c) > 1) & (F.length(c) < 50)))
    seen = seen.withColumn("cls", F.array_join(names, "."))
    seen = seen.filter((F.col("cls") != "") | (F.col("id") != "") | _attr("role").isNotNull() | _attr("data-testid").isNotNull())
    sig = F.concat("tag", F.when(F.col("cls") != "", F.concat(F.lit("."), "cls")).otherwise(""), F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).otherwise(""))
    seen = seen.withColumn("signature", sig).withColumn("k", F.row_number().over(Window.partitionBy("page_id", "signature").orderBy("pre")))
    three = seen.filter("k <= 3")
    kids = nodes.select("page_id", F.col("parent").alias("pre"), F.col("tag").alias("kid")).join(three.select("page_id", "pre", "signature"), ["page_id", "pre"])
    kids = kids.groupBy("page_id", "signature").agg(F.count_distinct("kid").alias("child_tags"))
    g = seen.groupBy("page_id", "signature").agg(F.count("*").alias("n"), F.min("pre").alias("first_pre"), F.avg(F.when(F.col("k") <= 3, F.least("text_len", F.lit(300)))).alias("avg_text"))
    g = g.filter((F.col("n") >= least) & (F.col("avg_text") >= least_text)).join(kids, ["page_id", "signature"], "left").fillna(0, ["child_tags"])
    g = g.withColumn("score", F.col("n") * (F.col("child_tags") + 1) * F.least("avg_text", F.lit(200.0)))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "first_pre"))).filter(F.col("rank") <= top)


def list_inventory(nodes: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """Lists of D10: (page_id, list_ord, list_pre, n_items) of the first `top` ul and ol with at least `least` li of their own."""
    items = nodes.filter("tag = 'li'").groupBy("page_id", F.col("parent").alias("pre")).agg(F.count("*").alias("n_items"))
    lists = nodes.filter("tag IN ('ul', 'ol') AND NOT hidden").join(items.filter(F.col("n_items") >= least), ["page_id", "pre"])
    return lists.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).alias("list_ord"), F.col("pre").alias("list_pre"), F.col("post").alias("list_post"), "n_items").filter(F.col("list_ord") <= top)


def report_flags(nodes: DataFrame) -> DataFrame:
    """(page_id, table_found, pattern_found, list_found, report), the report cut at 3200 characters. Pages with nothing have no row."""
    tables = table_inventory(nodes).groupBy("page_id").agg(F.max("n_rows").alias("rows"))
    pats = repeated_patterns(nodes).filter("rank <= 3").groupBy("page_id").agg(F.max("n").alias("most"), F.array_join(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "signature", "n").alias("s"))))["s"], "; ").alias("p"))
    lists = list_inventory(nodes, top=3).groupBy("page_id").agg(F.max("n_items").alias("items"))
    out = tables.join(pats, "page_id", "full").join(lists, "page_id", "full")
    flag = lambda c, n: F.coalesce(F.col(c) >= n, F.lit(False))
    return out.select("page_id", flag("rows", 5).alias("table_found"), flag("most", 10).alias("pattern_found"), flag("items", 3).alias("list_found"), F.left(F.concat_ws(" | ", F.concat_ws("=", F.lit("rows"), "rows"), "p", F.concat_ws("=", F.lit("items"), "items")), F.lit(3200)).alias("report"))


# Fixed values, set by parity of results (survey D11): selectors that often hold records, by precedence at equal counts.
CONTAINERS = [
    ".product",
    ".product-item",
    ".product-card",
    ".product-tile",
    ".product-thumb",
    "[class*='product']",
    ".item",
    ".card",
    ".listing-item",
    ".result",
    ".entry",
    ".post",
    ".article-item",
    "[class*='item']",
    "[class*='card']",
    "li.col-sm-4",
    "li.col-md-4",
    "li.col-lg-4",
    ".col-sm-4",
    ".col-md-4",
    "div.col-sm-4",
    "div.col-md-4",
    ".thumbnail",
    ".thumb",
    "tbody tr",
    "tr[class]",
    "article",
    ".post",
    ".blog-post",
    ".quote",
    ".review",
    ".testimonial",
    ".story",
    ".news-item",
    ".headline",
]


def repeated_first_class(nodes: DataFrame, low: int = 3, high: int = 200, top: int = 10) -> DataFrame:
    """(page_id, rank, cls, n, first_pre, first_tag): elements by the first of their classes, most frequent first."""
    one = nodes.filter(F.length(F.get("classes", F.lit(0))) > 1).withColumn("cls", F.get("classes", F.lit(0)))
    g = one.groupBy("page_id", "cls").agg(F.count("*").alias("n"), F.min("pre").alias("first_pre"), F.min_by("tag", "pre").alias("first_tag")).filter(F.col("n").between(low, high))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "first_pre"))).filter(F.col("rank") <= top)


def find_containers(nodes: DataFrame, plan_selector: str = "") -> DataFrame:
    """(page_id, selector, node columns) of a page's record containers: the plan's selector if it hits twice, else the common
    selector with most hits (the earlier of equals; not one that first hits a span or a link), else the most repeated first class."""
    by_rank = {r: s for r, s in enumerate([plan_selector, *CONTAINERS]) if s}
    hits = dom.matches(nodes, by_rank).withColumn("selector", F.element_at(F.create_map(*(F.lit(x) for r, s in by_rank.items() for x in (r, s))), F.col("rank")))
    counted = hits.groupBy("page_id", "rank", "selector").agg(F.count("*").alias("n"), F.min_by("tag", "pre").alias("first_tag"))
    good = counted.filter((F.col("n") >= 2) & ((F.col("rank") == 0) | ~F.col("first_tag").isin("span", "a")))
    order = Window.partitionBy("page_id").orderBy(F.when(F.col("rank") == 0, 0).otherwise(1), F.desc("n"), "rank")
    best = good.withColumn("r", F.row_number().over(order)).filter("r = 1").select("page_id", "rank", "selector")
    found = hits.drop("selector").join(best, ["page_id", "rank"]).drop("rank")
    rest = nodes.join(best, "page_id", "left_anti")
    cls = repeated_first_class(rest).filter(~F.col("first_tag").isin("span", "a"))
    cls = cls.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("rank"))).filter("r = 1").select("page_id", "cls")
    other = rest.join(cls, "page_id").filter(F.get("classes", F.lit(0)) == F.col("cls")).withColumn("selector", F.concat(F.lit("."), "cls")).drop("cls")
    return found.unionByName(other)


def element_counts(nodes: DataFrame) -> DataFrame:
    """A2: (page_id, links, images, tables, forms)."""
    count = lambda test: F.count_if(test)
    return nodes.groupBy("page_id").agg(
        count((F.col("tag") == "a") & _attr("href").isNotNull()).alias("links"), count(F.col("tag") == "img").alias("images"), count(F.col("tag") == "table").alias("tables"), count(F.col("tag") == "form").alias("forms"),
    )


def page_profile(nodes: DataFrame) -> DataFrame:
    """One row a page with elements: title, counts, repeated containers (top 10), next link, breadcrumb, candidate fields,
    link patterns, page type, js-heavy flag and confidence (fifths of five clues; pagination's is always there)."""
    has = lambda part: F.array_join("classes", " ").contains(part)
    per_page = nodes.groupBy("page_id").agg(
        F.max_by(F.when(F.col("tag") == "title", F.col("own_text")), F.when(F.col("tag") == "title", -F.col("pre"))).alias("title"),
        F.count_if((F.col("tag") == "script") & _attr("src").isNotNull()).alias("scripts"),
        F.bool_or(_attr("data-reactroot").isNotNull() | _attr("ng-app").isNotNull() | (F.col("id") == "__next")).alias("framework"),
        F.count_if(has("price")).alias("price"), F.count_if(has("rating")).alias("rating"), F.count_if(has("availability") | F.array_contains("classes", "instock")).alias("availability"),
        F.count_if(F.col("tag") == "h1").alias("h1"), F.count_if(F.col("tag").isin("h2", "h3")).alias("h23"), F.count_if(has("title") | ((F.col("tag") == "a") & _attr("title").isNotNull())).alias("titles"),
        F.bool_or(F.array_contains("classes", "breadcrumb") | (_attr("aria-label") == "breadcrumb") | ((F.col("tag") == "nav") & F.array_contains("classes", "breadcrumbs"))).alias("crumb"),
        F.count_if((F.col("tag") == "a") & _attr("href").contains("catalogue/") & _attr("href").contains("/index.html")).alias("detail_links"),
        F.count_if((F.col("tag") == "a") & _attr("href").contains("category/") & ~(_attr("href").contains("catalogue/") & _attr("href").contains("/index.html"))).alias("category_links"),
    )
    images = dom.select(nodes, ".product_pod img, .product img, article img, .thumbnail img").groupBy("page_id").agg(F.count("*").alias("image"))
    nxt = dom.select(nodes, 'li.next > a, a.next, a[rel="next"], .pagination a:last-child').groupBy("page_id").agg(F.min_by(_attr("href"), "pre").alias("next_href"))
    sig = F.concat("tag", F.when(F.size("classes") > 0, F.concat(F.lit("."), F.array_join(F.array_sort("classes"), "."))).otherwise(""))
    boxes = nodes.filter("tag IN ('article', 'li', 'div', 'section')").groupBy("page_id", sig.alias("sig")).agg(F.count("*").alias("n"), F.min("pre").alias("p")).filter("n >= 3")
    boxes = boxes.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "p", "sig", "n"))), 1, 10).alias("b"))
    p = per_page.join(element_counts(nodes), "page_id").join(images, "page_id", "left").join(nxt, "page_id", "left").join(boxes, "page_id", "left")
    boxes_ = F.coalesce(F.transform("b", lambda x: F.struct(x["sig"].alias("selector"), x["n"].alias("n"))), F.array().cast("array<struct<selector:string,n:bigint>>"))
    fields = F.filter(
        F.array(*(F.when(t, F.lit(n)) for n, t in (("price", F.col("price") > 0), ("rating", F.col("rating") > 0), ("availability", F.col("availability") > 0), ("title_h1", F.col("h1") > 0), ("title_repeating", F.col("h23") >= 3), ("title_class", F.col("titles") > 0), ("image", F.coalesce("image", F.lit(0)) > 0)))),
        lambda x: x.isNotNull(),
    )
    p = p.withColumn("containers", boxes_).withColumn("fields", fields)
    top = F.coalesce(F.get("containers", F.lit(0))["n"], F.lit(0))
    kind = F.when(top >= 5, "listing").when((F.col("h1") > 0) & (F.col("tables") >= 1) & F.col("crumb"), "detail").when(F.col("crumb") & (top > 0), "category").otherwise("unknown")
    clues = [kind != "unknown", F.size("containers") > 0, F.lit(True), F.size("fields") > 0, (F.col("detail_links") + F.col("category_links")) > 0]
    p = p.withColumn("confidence", sum((c.cast("int") for c in clues), F.lit(0)) / 5.0)
    return p.select("page_id", F.coalesce("title", F.lit("")).alias("title"), "links", "images", "tables", "forms", "containers", "fields", F.coalesce("next_href", F.lit("")).alias("next_href"), F.col("crumb").alias("breadcrumb"), "detail_links", "category_links", kind.alias("page_type"), ((F.col("scripts") > 10) | F.col("framework")).alias("is_js_heavy"), "confidence")


def interactive_elements(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, tag, type, role, text, placeholder, aria_label, class_names, id, name), an element once."""
    roles = "button combobox listbox option tab".split()
    names = F.array_join("classes", " ")
    test = (
        F.col("tag").isin("input", "select", "textarea", "button", "form") | ((F.col("tag") == "a") & _attr("href").isNotNull()) | F.coalesce(_attr("role").isin(*roles), F.lit(False))
        | F.coalesce(_attr("tabindex") != "-1", F.lit(False)) | _attr("aria-label").isNotNull() | _attr("data-testid").isNotNull() | names.rlike("btn|button|cta|search")
    ) & ~((F.col("tag") == "input") & (F.coalesce(_attr("type"), F.lit("")) == "hidden"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return nodes.filter(test & ~F.col("hidden")).select(
        "page_id", "pre", "tag", blank(_attr("type")).alias("type"), blank(_attr("role")).alias("role"), F.left("text", F.lit(50)).alias("text"), blank(_attr("placeholder")).alias("placeholder"),
        blank(_attr("aria-label")).alias("aria_label"), F.left(F.array_join("classes", " "), F.lit(80)).alias("class_names"), "id", blank(_attr("name")).alias("name"),
    )


def search_forms(nodes: DataFrame, records_found: int = 0) -> DataFrame:
    """(page_id, is_search_form): no records yet, some text, a text-like control, a button, and no table of ten rows."""
    e = interactive_elements(nodes)
    typing = (F.col("tag").isin("input", "select", "textarea") & ~F.col("type").isin("hidden", "checkbox", "radio", "submit", "button")) | F.col("role").isin("combobox", "listbox", "searchbox")
    pressing = (F.col("tag") == "button") | (F.col("type").isin("submit", "button")) | (F.col("role") == "button")
    e = e.groupBy("page_id").agg(F.bool_or(typing).alias("typing"), F.bool_or(pressing).alias("pressing"))
    rows = table_inventory(nodes).groupBy("page_id").agg(F.max("n_rows").alias("rows"))
    size = nodes.filter("parent = -1").groupBy("page_id").agg(F.sum("text_len").alias("size"))
    p = size.join(e, "page_id", "left").join(rows, "page_id", "left")
    test = F.lit(records_found == 0) & (F.col("size") > 200) & F.coalesce("typing", F.lit(False)) & F.coalesce("pressing", F.lit(False)) & (F.coalesce("rows", F.lit(0)) < 10)
    return p.select("page_id", test.alias("is_search_form"))
