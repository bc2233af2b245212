"""Walking over pages that are at hand: frontier, next pages, levels. Each step is an equality join on URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.staging import staged
from . import dom
from .inspect import _attr

# Fixed values, set by parity of results (survey S8): where a next link usually is, by precedence. Text is compared in any case.
NEXT_SELECTORS = [
    "a[rel='next']",
    ".next a",
    "li.next a",
    ".next > a",
    "a.next",
    ".pagination .next a",
    "a:has-text('Next')",
    "[aria-label='Next page']",
    "[aria-label='Next']",
]


def next_pages(nodes: DataFrame, pages: DataFrame, pagination: dict | None = None) -> DataFrame:
    """(page_id, next_url), '' where there is none. A URL template gives the page after page_num (a column of pages, 1 if absent);
    else the first selector with a reference, resolved. Type none behaves as next_button; infinite_scroll has no next page."""
    p = pagination or {}
    kind = p.get("type", "none")
    if kind in ("url_increment", "page_numbers"):
        n = F.col("page_num") if "page_num" in pages.columns else F.lit(1)
        t = p.get("url_template", "")
        return pages.select("page_id", (F.replace(F.lit(t), F.lit("{page_num}"), (n + 1).cast("string")) if t else F.lit("")).alias("next_url"))
    if kind not in ("none", "next_button", "next_link"):
        return pages.select("page_id", F.lit("").alias("next_url"))
    found = None
    for rank, s in enumerate(x for x in (p.get("selector", ""), p.get("next_selector", ""), *NEXT_SELECTORS) if x):
        first = dom.select(nodes, s).groupBy("page_id").agg(F.min_by(F.coalesce(_attr("href"), F.lit("")), "pre").alias("href")).withColumn("rank", F.lit(rank))
        found = first if found is None else found.unionByName(first)
    best = found.filter("href <> ''").groupBy("page_id").agg(F.min_by("href", "rank").alias("href"))
    return pages.select("page_id", "url").join(best, "page_id", "left").select("page_id", urls.resolve("url", "href").alias("next_url"))


def follow(start: DataFrame, links: DataFrame, most_pages: int = 50) -> DataFrame:
    """(url, step) reached from start (url) over links (url, next_url), the first visit of each, at most most_pages steps."""
    seen = staged(start.select("url").distinct().withColumn("step", F.lit(0)), "seen")
    front = seen
    for step in range(1, most_pages):
        nxt = front.join(links, "url").select(F.col("next_url").alias("url")).filter("url <> ''").distinct().join(seen.select("url"), "url", "left_anti").withColumn("step", F.lit(step))
        nxt = staged(nxt, "front")  # else each step would plan all before it again
        if nxt.isEmpty():
            break
        seen, front = seen.unionByName(nxt), nxt
    return seen


def parent_key(entity: str, fields: list[str]) -> str:
    """The column that a level's name goes to: the entity without its s's and _name, if that is or resembles a field, else the entity."""
    from .records import match_key

    return match_key(f"{entity.rstrip('s')}_name", fields) or entity


def merge_parent(child: DataFrame, columns: list[str]) -> DataFrame:
    """From (parent map<string,string>, columns): a column takes the parent's value where its own is empty."""
    return child.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.try_element_at("parent", F.lit(c)), F.lit("")) for c in columns}).drop("parent")


def merge_maps(child: str | Column, parent: str | Column) -> Column:
    """J5 on maps: the child's values that are not empty, the parent's for all other keys."""
    own = F.map_filter(child, lambda k, v: F.coalesce(v, F.lit("")) != "")
    return F.map_concat(F.map_filter(parent, lambda k, v: ~F.map_contains_key(own, k)), own)


def expand_levels(seeds: DataFrame, links: DataFrame, levels: list[str], fields: list[str], most_links: int | None = None) -> DataFrame:
    """(url, parent, level) of the last level's frontier. seeds have url; links are (url, ord, name, next_url); a level names an
    entity, whose name at each step is carried under parent_key(). At most most_links of each level's frontier go on, in order."""
    front = seeds.select("url", F.create_map().cast("map<string,string>").alias("parent"), F.lit("").alias("trail"))
    for entity in levels:
        key = parent_key(entity, fields)
        step = front.join(links, "url").filter("next_url <> ''")
        front = step.select(F.col("next_url").alias("url"), merge_maps(F.create_map(F.lit(key), F.col("name")), F.col("parent")).alias("parent"), F.concat("trail", F.format_string("/%010d", "ord")).alias("trail"))
        if most_links is not None:
            front = front.orderBy("trail").limit(most_links)
    return front.withColumn("level", F.lit(len(levels)))


def frontier(links: DataFrame, visited: DataFrame, most: int) -> DataFrame:
    """Links (url, ord) that were not visited, each once, the first `most` in order."""
    fresh = links.groupBy("url").agg(F.min("ord").alias("ord")).join(visited.select("url").distinct(), "url", "left_anti")
    return fresh.orderBy("ord", "url").limit(most)
