"""Running a plan over page tables: parse, engines by tier, gate, clean, junk, dedup, report; and the facade with jobs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, dom, extract, inspect, records, semi
from ..sources import sinks
from ..sources.staging import staged
from . import model


class Extractor(Protocol):
    """An extractor of the user's own: (nodes, pages, fields) to (page_id, item_ord, fields)."""

    def __call__(self, nodes: DataFrame, pages: DataFrame, fields: list[str]) -> DataFrame: ...


class Planner(Protocol):
    """Makes a plan of a request; the built-in one looks fields up by name."""

    def __call__(self, url: str, fields: list[str], max_pages: int) -> model.Plan: ...


#: The primary engine's records stand only if they fill this share of cells.
PRIMARY_GATE = 0.60


def extract_pages(pages: DataFrame, plan: model.Plan, own: Extractor | None = None, responses: DataFrame | None = None) -> DataFrame:
    """(page_id, item_ord, fields, tier) of each page's first tier that holds: the user's extractor or the shortcut and fallback
    chain (gated), records of API responses (page_id, body), selectors."""
    fields = plan.names
    nodes = dom.node_table(pages)
    tiers = [own(nodes, pages, fields)] if own else [extract.shortcut(nodes, fields, pages).drop("tier"), extract.fallback(nodes, fields, pages).drop("tier")]
    gates = {i: PRIMARY_GATE for i in range(len(tiers))}
    if responses is not None:
        items = semi.resolve_records(responses.select("page_id", "body"))
        api = semi.project(items, {f: f for f in fields}).withColumn("item_ord", F.col("item_ord").cast("int"))
        tiers.append(records.drop_valueless(records.align(api, fields, ["page_id", "item_ord"]), fields))
    if any(f.selector for f in plan.fields):
        tiers.append(extract.by_selectors(nodes, plan.specs(), pages, plan.container))
    return records.choose_tier([staged(t.select("page_id", "item_ord", *fields), "engine") for t in tiers], "page_id", fields, gates)


def finish(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, dict]:
    """The records that stay, and how many went as junk and as duplicates."""
    clean = records.drop_junk(rows, fields)
    kept = records.dedup_content(clean, fields, ["page_id", "item_ord"])
    n, c, k = rows.count(), clean.count(), kept.count()
    return kept, {"kept": k, "junk": n - c, "duplicates": c - k}


@dataclass
class Job:
    """M16."""

    id: str
    status: str = "pending"
    progress: int = 0
    step: str = ""
    error: str | None = None
    value: object = None
    files: dict = field(default_factory=dict)


class Session:
    """E5: analyse pages, clarify, extract, ask for status and results. The callback (E4) gets (job id, percent, step, records)."""

    def __init__(self, spark: SparkSession, planner: Planner | None = None, progress: Callable[[str, int, str, int], None] | None = None):
        self.spark, self.planner, self.progress = spark, planner or (lambda u, f, n: model.fallback_plan(u, f, n)), progress
        self.jobs: dict[str, Job] = {}

    def _tell(self, job: Job, percent: int, step: str, n: int = 0) -> None:
        job.progress, job.step = percent, step
        if self.progress:
            self.progress(job.id, percent, step, n)

    def health(self) -> dict:
        return {"status": "ok", "version": self.spark.version}

    def analyze(self, pages: DataFrame, url: str, fields: list[str], max_pages: int = 100) -> Job:
        """Profiles the pages at hand and plans their extraction."""
        job = Job(uuid.uuid4().hex, "running")
        self.jobs[job.id] = job
        try:
            self._tell(job, 10, "parse")
            nodes = dom.node_table(pages)
            profile = inspect.page_profile(nodes).orderBy("page_id").first()
            forms = bool(inspect.search_forms(nodes).filter("is_search_form").limit(1).count())
            plan = self.planner(url, fields, max_pages)
            confidence = "high" if profile and profile.confidence >= 0.8 else "medium" if profile and profile.confidence >= 0.4 else "low"
            job.value = {"plan": plan, "profile": profile, "is_search_form": forms, "preview": model.preview({"fields": plan.names, "confidence": confidence})}
            job.status = "success"
            self._tell(job, 100, "analysed")
        except Exception as e:
            job.status, job.error = "error", str(e)
            raise
        return job

    def clarify(self, job_id: str, max_pages: int | None = None, more_fields: tuple[str, ...] = ()) -> Job:
        job = self.jobs[job_id]
        job.value["plan"] = job.value["plan"].with_answers(max_pages, more_fields)
        return job

    def extract(self, job_id: str, pages: DataFrame, folder: str, own: Extractor | None = None, responses: DataFrame | None = None, one_file: bool = False) -> Job:
        """Runs an analysed plan over pages and exports the formats it names; one_file as in sinks.export()."""
        plan = self.jobs[job_id].value["plan"]
        job = Job(uuid.uuid4().hex, "running")
        self.jobs[job.id] = job
        began = time.time()
        try:
            some = records.limited(pages, ["page_id"], plan.max_pages)
            self._tell(job, 20, "extract")
            kept, counts = finish(extract_pages(some, plan, own, responses), plan.names)
            self._tell(job, 80, "export", counts["kept"])
            text = sinks.report(plan.target_url, some.count(), counts["kept"], counts["junk"], counts["duplicates"], plan.names, "pageloom")
            got = sinks.export(kept.orderBy("page_id", "item_ord"), folder, plan.names, plan.formats, text, one_file)
            job.status, job.files, job.value = got["status"], got.get("files", {}), {**counts, "seconds": time.time() - began}
            job.error = None if got["status"] == "success" else "no records"
            self._tell(job, 100, job.status, counts["kept"])
        except Exception as e:
            job.status, job.error = "error", str(e)
            raise
        return job

    def status(self, job_id: str) -> Job:
        return self.jobs[job_id]

    def result(self, job_id: str, fmt: str) -> str:
        """K5: where a format lies; ValueError for a format there is not, LookupError for one that was not written."""
        fmt = {"excel": "xlsx"}.get(fmt, fmt)
        if fmt not in ("csv", "json", "xlsx"):
            raise ValueError(f"unknown format {fmt!r}")
        if fmt not in self.jobs[job_id].files:
            raise LookupError(f"{fmt} was not written")
        return self.jobs[job_id].files[fmt]


def crawl_levels(seeds: DataFrame, pages: DataFrame, links: DataFrame, plan: model.Plan, crawl_plan: model.CrawlPlan) -> DataFrame:
    """J6 in full: expands the levels before the last, extracts the last level's pages, and fills empty fields from the parents."""
    entities = [level["entity"] for level in crawl_plan.levels[:-1]]
    front = crawl.expand_levels(seeds, links, entities, plan.names, crawl_plan.max_links_per_level)
    got = extract_pages(pages.join(front.select("url").distinct(), "url", "left_semi"), plan)
    named = got.join(pages.select("page_id", "url"), "page_id").join(front.select("url", "parent", "trail"), "url")
    extra = [crawl.parent_key(e, plan.names) for e in entities]
    extra = [e for e in extra if e not in plan.names]
    named = named.withColumns({e: F.lit("") for e in extra})
    return crawl.merge_parent(named, [*plan.names, *extra]).select("trail", "url", "item_ord", *plan.names, *extra)
