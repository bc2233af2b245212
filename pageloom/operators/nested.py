"""Nested records: sections of labelled items to flat rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import make_id


def flatten_sections(df: DataFrame, id_: str, sections: str = "sections") -> DataFrame:
    """A row an item: df's other columns, spec_id, section_name, spec_label, spec_value, position (1-based, over all sections)."""
    keep = [c for c in df.columns if c != sections]
    flat = df.select(*keep, F.posexplode(sections).alias("_s", "_sec")).select(*keep, "_s", F.col("_sec.section_name").alias("section_name"), F.posexplode("_sec.items").alias("_i", "_it"))
    w = Window.partitionBy(id_).orderBy("_s", "_i")
    return flat.select(*keep, make_id(F.col(id_), F.col("section_name"), F.col("_it.label"), F.col("_it.value")).alias("spec_id"), "section_name", F.col("_it.label").alias("spec_label"), F.col("_it.value").alias("spec_value"), F.row_number().over(w).alias("position"))


def nest_sections(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sections) from (keys, position, section_name, spec_label, spec_value); sections in order of their first item."""
    item = F.struct("position", F.col("spec_label").alias("label"), F.col("spec_value").alias("value"))
    sec = rows.groupBy(*keys, "section_name").agg(F.min("position").alias("p"), F.array_sort(F.collect_list(item)).alias("i"))
    sec = sec.withColumn("items", F.transform("i", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))))
    g = sec.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "section_name", "items"))).alias("s"))
    return g.select(*keys, F.transform("s", lambda x: F.struct(x["section_name"].alias("section_name"), x["items"].alias("items"))).alias("sections"))


def item_total(sections: str | Column = "sections") -> Column:
    """Number of items over all sections."""
    return F.aggregate(sections, F.lit(0), lambda a, s: a + F.size(s["items"]))


def breadcrumb(crumbs: str | Column) -> Column:
    """N4."""
    return F.array_join(crumbs, " > ")


def category(crumbs: str | Column) -> Column:
    """The last but one; '' if there are fewer than two."""
    return F.coalesce(F.try_element_at(crumbs, F.lit(-2)), F.lit(""))


def key_values(pairs: str | Column, names: dict[str, str]) -> list[Column]:
    """Columns out of an array of (key, value) structs; a key's last value counts."""
    at = lambda k: F.try_element_at(F.filter(pairs, lambda p: p["key"] == k), F.lit(-1))["value"]
    return [F.coalesce(at(k), F.lit("")).alias(n) for k, n in names.items()]


def joined_values(array: str | Column, most: int = 10) -> Column:
    """The first values that are not empty, with bars between."""
    return F.array_join(F.filter(F.slice(array, 1, most), lambda x: x != ""), " | ")
