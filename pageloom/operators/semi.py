"""Records out of JSON payloads: finding the data array, digging along a path, projecting fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, set by parity of results (survey S10): words in a URL that make a response worth a look although its content
# type is not JSON.
API_WORDS = ["api", "search", "listing", "property", "results", "data", "query", "fetch", "graphql", "ajax", "xhr", "endpoint", "service"]


def _qualifies(x) -> bool:
    return isinstance(x, list) and len(x) >= 5 and all(isinstance(i, dict) for i in x[:5])


def has_data_array(x, depth: int = 6) -> bool:
    """A list of five objects and more within reach: all values of an object, the first ten items of a list."""
    if depth < 0:
        return False
    if _qualifies(x):
        return True
    inner = x.values() if isinstance(x, dict) else x[:10] if isinstance(x, list) else ()
    return any(has_data_array(i, depth - 1) for i in inner)


def longest_array(x, depth: int = 6) -> list:
    """The longest qualifying list, the first of equals; items of lists are searched up to the twentieth."""
    if depth < 0:
        return []
    best = x if _qualifies(x) else []
    for i in x.values() if isinstance(x, dict) else x[:20] if isinstance(x, list) else ():
        found = longest_array(i, depth - 1)
        if len(found) > len(best):
            best = found
    return best


def dig(x, path: str):
    """Along a dotted path through objects only; None where it ends."""
    for part in path.split(".") if path else ():
        if not isinstance(x, dict) or part not in x:
            return None
        x = x[part]
    return x


def _load(s):
    try:
        return json.loads(s) if s else None
    except ValueError:
        return None


@F.pandas_udf(T.BooleanType())
def contains_data_array(body: pd.Series) -> pd.Series:
    return pd.Series([has_data_array(_load(b)) for b in body], dtype=bool)


def resolve_records(df: DataFrame, body: str = "body", path: str = "") -> DataFrame:
    """df's other columns, item_ord (0-based) and item (JSON of one object): of the list at path, else of the longest data array."""

    @F.pandas_udf("array<string>")
    def items(s: pd.Series) -> pd.Series:
        out = []
        for b in s:
            x = _load(b)
            at = dig(x, path) if path else None
            found = at if isinstance(at, list) else longest_array(x)
            out.append([json.dumps(i, ensure_ascii=False) for i in found if isinstance(i, dict)])
        return pd.Series(out)

    keep = [c for c in df.columns if c != body]
    return df.select(*keep, F.posexplode(items(F.col(body))).alias("item_ord", "item"))


def dig_path(c: str | Column, path: str) -> Column:
    """X3 as an expression: text of the value at a path of object keys; null where there is none."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path.split(".")))


def project(items: DataFrame, mapping: dict[str, str], item: str = "item") -> DataFrame:
    """Every field from its path in the item's JSON, '' where there is none. Other columns stay."""
    keep = [c for c in items.columns if c != item]
    return items.select(*keep, *(F.coalesce(dig_path(item, p), F.lit("")).alias(f) for f, p in mapping.items()))


def lenient_json(c: str | Column, strip_fences: bool = False, need: str | None = None) -> Column:
    """Text of a JSON value: the whole, else from the first brace to the last, else null. strip_fences first takes Markdown fences
    off and wants an object; need is a key that it must have."""
    s = F.col(c) if isinstance(c, str) else c
    if strip_fences:
        s = F.regexp_replace(s, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    whole, inner = F.try_parse_json(s), F.try_parse_json(F.regexp_extract(s, r"(?s)\{.*\}", 0))
    # an empty string is no JSON value
    whole = F.when(F.trim(s) != "", whole)
    out = F.to_json(F.coalesce(whole, F.when(F.regexp_extract(s, r"(?s)\{.*\}", 0) != "", inner)))
    if strip_fences:
        out = F.when(F.ltrim(out).startswith("{"), out)
    return F.when(F.get_json_object(out, f"$.{need}").isNotNull(), out) if need else out


def api_candidates(responses: DataFrame, most: int = 20) -> DataFrame:
    """(url, body, preview) of successful JSON responses with a data array: the content type says JSON or the URL a telling word;
    each URL and body start once, the first `most` by seq. From (seq, url, status, content_type, body)."""
    from .records import dedup_candidates

    telling = F.lower("url").rlike("|".join(API_WORDS))
    ok = responses.filter((F.col("status") == 200) & (F.lower(F.coalesce("content_type", F.lit(""))).contains("json") | telling)).filter(contains_data_array("body"))
    return dedup_candidates(ok, ["seq"], most).select("url", "body", F.left("body", F.lit(500)).alias("preview"))


def choose_response(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """X6, by rule: the response whose objects name most fields, then the longest array, then the earliest URL."""
    names = [f.lower() for f in fields]

    @F.pandas_udf("named int, size int")
    def rate(s: pd.Series) -> pd.DataFrame:
        got = [longest_array(_load(b)) for b in s]
        return pd.DataFrame({"named": [len({k.lower() for i in g[:5] for k in i} & set(names)) for g in got], "size": [len(g) for g in got]})

    return candidates.withColumn("_r", rate("body")).orderBy(F.desc("_r.named"), F.desc("_r.size"), "url").limit(1).drop("_r")
