"""Site adapters: inputs, extraction, flat rows, checks. Two are built in."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls, values
from ..operators import checks, dom, extract, nested, records
from ..sources import readers
from ..sources.staging import staged


class SiteAdapter(ABC):
    """What a site needs to say; every step maps DataFrames to DataFrames."""

    site_name: str
    url_field = "url"
    label_field = "title"
    columns: list[str]

    @abstractmethod
    def extract(self, pages: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
        """Records out of pages (page_id, url, html)."""

    @abstractmethod
    def rows(self, extracted: DataFrame) -> DataFrame:
        """Flat rows in the adapter's columns."""

    @abstractmethod
    def validate(self, extracted: DataFrame) -> DataFrame:
        """(category, n)."""


class Books(SiteAdapter):
    """Flat records of 20 string columns."""

    site_name = "books"
    url_field = "product_page_url"
    columns = extract.BOOK_COLUMNS
    required = ("book_id", "product_page_url", "title")
    flaggable = ("description", "rating_value", "stock_count", "image_url")
    checked = (*required, "price_gbp", "rating_value")

    def extract(self, pages: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
        """Detail pages with a title; inputs (url, catalogue_page_url) give where a page was listed."""
        out = records.require(extract.detail_records(pages), "title")
        if inputs is not None:
            i = inputs.select(F.col("url").alias("product_page_url"), F.col("catalogue_page_url").alias("_from")).dropDuplicates(["product_page_url"])
            out = records.carry_forward(out.join(i, "product_page_url", "left"), {"catalogue_page_url": "_from"}).drop("_from")
        return checks.flag_missing(out, list(self.flaggable), "flags")

    def rows(self, extracted: DataFrame) -> DataFrame:
        return records.complete(extracted, self.columns)

    def validate(self, extracted: DataFrame) -> DataFrame:
        """A12, over a written table of what is checked: each check reads it, and none extracts anew."""
        extracted = staged(extracted.select(*(c for c in self.checked if c in extracted.columns)), "checked")
        return checks.merged_issues(checks.missing_required(extracted, list(self.required), "book"), checks.duplicate_issue(extracted, "book_id", "duplicate_book"), checks.range_issues(extracted, "price_gbp", "rating_value"))


class Vehicles(SiteAdapter):
    """Nested records (sections of labelled items), 17 flat columns."""

    site_name = "vehicles"
    url_field = "model_year_url"
    label_field = "model_year_label"
    columns = (
        "spec_id engine_id engine_anchor_id engine_specs_url engine_url model_year_id model_id brand_id brand_name model_name model_year_url model_year_label engine_name section_name spec_label spec_value position"
    ).split()
    required = ("engine_id", "brand_id", "model_id", "model_year_id", "model_year_url", "model_year_label", "engine_name", "engine_anchor_id", "engine_specs_url", "engine_url", "brand_name", "model_name")

    def __init__(self, brands: DataFrame | None = None, models: DataFrame | None = None):
        self.brands, self.models = brands, models

    def extract(self, pages: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
        """An engine an anchor of its page (P9, P10), named by label, anchor or specifications (F17, P11); engines without items go."""
        nodes = dom.node_table(pages)
        anchors = extract.harvest_anchors(nodes).select("page_id", F.explode("anchors").alias("engine_anchor_id")).join(pages.select("page_id", F.col("url").alias("model_year_url")), "page_id")
        anchors = anchors.filter(urls.valid_anchor("engine_anchor_id") & urls.anchor_of_page("engine_anchor_id", "model_year_url"))
        labels = extract.best_engine_label(nodes, anchors.select("page_id", F.col("engine_anchor_id").alias("anchor"))).withColumnRenamed("anchor", "engine_anchor_id")
        sections = extract.spec_sections(nodes)
        e = anchors.join(labels, ["page_id", "engine_anchor_id"], "left").join(sections, "page_id").filter(nested.item_total("sections") > 0)
        label = F.when(values.is_generic_label("label"), F.lit("")).otherwise(F.coalesce("label", F.lit("")))
        base = F.regexp_replace("model_year_url", "#.*$", "")
        e = e.withColumn("engine_name", values.engine_name(label, "engine_anchor_id", "sections")).withColumn("engine_url", F.concat(base, F.lit("#"), "engine_anchor_id")).withColumn("engine_specs_url", F.col("engine_url"))
        if inputs is not None:
            e = e.join(inputs, "model_year_url")
        else:
            e = e.withColumns({c: F.lit("") for c in ("model_year_label", "model_year_id", "model_id", "brand_id")})
        for dim, key, name in ((self.brands, "brand_id", "brand_name"), (self.models, "model_id", "model_name")):
            e = e.withColumn(name, F.lit("")) if dim is None else self._named(e, dim, key, name)
        return e.withColumn("engine_id", values.make_id("model_year_url", "engine_anchor_id"))

    @staticmethod
    def _named(e: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
        d = readers.lookup_table(dim, key, [name, "name"], key).select(F.col("id").alias("_id"), F.col("name").alias(name))
        return e.join(d, F.col(key) == F.col("_id"), "left").drop("_id").fillna("", [name])

    def rows(self, extracted: DataFrame) -> DataFrame:
        flat = nested.flatten_sections(extracted, "engine_id")
        return flat.select(*(F.col(c) if c == "position" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in self.columns))

    def validate(self, extracted: DataFrame) -> DataFrame:
        """Required fields, duplicate engines, and keys that no lookup has."""
        issues = [checks.missing_required(extracted, list(self.required), "engine"), checks.duplicate_issue(extracted, "engine_id", "duplicate_engine")]
        issues += [checks.orphan_issue(extracted, key, dim, key, key) for dim, key in ((self.brands, "brand_id"), (self.models, "model_id")) if dim is not None]
        return checks.merged_issues(*issues)
