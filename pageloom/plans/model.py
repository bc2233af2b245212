"""Plans: what is asked for, as frozen values; building, checking, answering, and what a profile suggests."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a field of that name usually is: (selector, attribute).
FIELD_TEMPLATES = {
    **dict.fromkeys(("title", "name"), (".storylink", "text")), **dict.fromkeys(("link", "url"), (".storylink", "href")), "price": ("[class*='price']", "innerText"), "description": ("[class*='description'], p", "innerText"),
    "author": ("small.author, .author", "innerText"), "quote": (".text, blockquote", "innerText"), "tags": ("div.tags a, .tag", "text"), "points": (".score, [class*='points']", "innerText"), "rating": (".star-rating", "class"),
}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    selector: str = ""
    attribute: str = "innerText"
    backup_selector: str = ""
    multiple: bool = False
    is_relative: bool | None = None
    transform: str = "none"
    required: bool = False

    def spec(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "name"}


@dataclass(frozen=True)
class Plan:
    target_url: str
    fields: tuple[FieldSpec, ...]
    max_pages: int = 100
    strategy: str = "single"
    container: str = ""
    pagination: dict = field(default_factory=dict)
    formats: tuple[str, ...] = ("csv", "json", "xlsx")
    plan_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: str = field(default_factory=lambda: datetime.datetime.now(datetime.timezone.utc).isoformat())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def specs(self) -> dict[str, dict]:
        return {f.name: f.spec() for f in self.fields}

    def with_answers(self, max_pages: int | None = None, more_fields: tuple[str, ...] = ()) -> Plan:
        """Answers to questions: another page limit, and fields still to detect."""
        new = tuple(FieldSpec(n, selector="", attribute="to_detect") for n in more_fields if n not in self.names)
        return replace(self, max_pages=max_pages or self.max_pages, fields=self.fields + new)


@dataclass(frozen=True)
class CrawlPlan:
    """M17."""

    strategy: str = "single"
    levels: tuple[dict, ...] = ()
    max_links_per_level: int | None = None


def fallback_plan(url: str, fields: list[str], max_pages: int = 100) -> Plan:
    """G2, J8."""
    return Plan(url, tuple(FieldSpec(f, *FIELD_TEMPLATES.get(str(f).lower(), ("", "innerText"))) for f in fields), max_pages)


def plan_is_valid(plan: object) -> bool:
    """P13, of a plan as JSON: a target, a page limit, and fields."""
    if not isinstance(plan, dict) or not plan.get("target_url"):
        return False
    crawler, extraction = plan.get("crawler_config"), plan.get("extraction_config")
    if not isinstance(crawler, dict) or not crawler.get("max_pages") or not isinstance(extraction, dict):
        return False
    return isinstance(extraction.get("fields"), dict) and bool(extraction["fields"])


def plan_from_json(plan: dict) -> Plan:
    """The plan that a valid JSON plan describes; ValueError for others."""
    if not plan_is_valid(plan):
        raise ValueError("the plan lacks a target, a page limit or fields")
    e, out = plan["extraction_config"], plan.get("output_config") or {}
    known = {k for k in FieldSpec.__dataclass_fields__ if k != "name"}
    specs = tuple(FieldSpec(n, **{k: v for k, v in (c or {}).items() if k in known}) for n, c in e["fields"].items())
    formats = tuple(out.get("formats") or ("csv", "json", "xlsx"))
    return Plan(plan["target_url"], specs, int(plan["crawler_config"]["max_pages"]), plan.get("strategy", "single"), e.get("container_selector", ""), plan["crawler_config"].get("pagination") or {}, formats)


def preview(analysis: dict) -> dict:
    """What a user sees before a run."""
    minutes = analysis.get("estimated_time", analysis.get("estimated_minutes", "unknown"))
    return {
        "estimated_records": analysis.get("estimated_records", "unknown"), "estimated_time": f"{minutes} minutes" if isinstance(minutes, (int, float)) and not isinstance(minutes, bool) else minutes,
        "fields": list(analysis.get("fields", [])), "confidence": str(analysis.get("confidence", "medium")).lower(), "warnings": list(analysis.get("warnings", [])),
    }


def choose_strategy(is_search_form: bool, crawl: CrawlPlan | None) -> str:
    """A search form rules out several levels."""
    return "multilevel" if crawl and crawl.strategy == "multilevel" and crawl.levels and not is_search_form else "single"


def should_checkpoint(dirty: bool, count: int, age_s: float, force: bool = False, every: int = 10, seconds: float = 30.0) -> bool:
    """G6."""
    return force or (dirty and (count >= every or age_s >= seconds))


# --- G1 --------------------------------------------------------------------------------------------
_TYPES = {"str": "string", "int": "bigint", "float": "double", "url": "string", "datetime": "timestamp"}


def suggest_schema(listing: dict, detail: dict | None = None, entity: str = "record") -> dict:
    """From page profiles: entity, fields (name, source, required, type_hint, notes), columns, rules, id_candidate and the Spark DDL."""
    add = lambda name, source, hint="str", required=False, notes="": {"name": name, "source": source, "required": required, "type_hint": hint, "notes": notes}
    found = [add("record_id", "computed", required=True), add("product_page_url", "link", "url", True), add("title", "heading", required=True)]
    for c in listing.get("fields") or []:
        if "price" in c:
            found.append(add("price", c, "float"))
        elif "rating" in c:
            found.append(add("rating_value", c, "int"))
        elif "availability" in c:
            found += [add("availability_text", c), add("stock_count", "availability text", "int")]
        elif "image" in c:
            found.append(add("image_url", c, "url"))
    tables = bool(detail and detail.get("tables", 0) > 0)
    if detail:
        if tables:
            found.append(add("product_info_table", "table"))
        if detail.get("breadcrumb"):
            found += [add("category", "breadcrumb"), add("breadcrumb", "breadcrumb")]
        found.append(add("description", "paragraph"))
    fields = list({f["name"]: f for f in reversed(found)}.values())[::-1]
    per_hint = {"int": "integer_when_present", "float": "numeric_when_present", "url": "valid_url_when_present"}
    rules = [{"field": f["name"], "rule": r} for f in fields for r in (["required_non_empty"] if f["required"] else []) + ([per_hint[f["type_hint"]]] if f["type_hint"] in per_hint else [])]
    return {"entity": entity, "fields": fields, "columns": [f["name"] for f in fields], "rules": rules, "id_candidate": "UPC or product_page_url hash" if tables else "product_page_url hash", "ddl": ", ".join(f"{f['name']} {_TYPES[f['type_hint']]}" for f in fields)}


def rule_column(rule: dict) -> Column:
    """The test that a suggested rule makes of a record; true where it holds."""
    c = F.coalesce(F.col(rule["field"]).cast("string"), F.lit(""))
    tests = {"required_non_empty": F.trim(c) != "", "integer_when_present": (c == "") | c.rlike(r"^-?\d+$"), "numeric_when_present": (c == "") | c.try_cast("double").isNotNull(), "valid_url_when_present": (c == "") | c.rlike(r"^https?://\S+$")}
    return tests[rule["rule"]]
