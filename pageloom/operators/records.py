"""Record sets: alignment, junk, coverage, gates, deduplication, merging. Every set carries its order; nothing relies on arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _cells(fields: list[str]) -> Column:
    return F.array(*(F.coalesce(tx.strip(F.col(f).cast("string")), F.lit("")) for f in fields))


def match_key(field: str, keys: list[str]) -> str | None:
    """R1 for names: the exact key, else the first equal with case, spaces and underscores aside, else the first where one contains the other."""
    if field in keys:
        return field
    forms = lambda s: {s.lower().replace(" ", "_"), s.lower().replace("_", " "), s.lower().replace("_", "").replace(" ", "")}
    for k in keys:
        if forms(k) & forms(field):
            return k
    return next((k for k in keys if k.lower() in field.lower() or field.lower() in k.lower()), None)


def align(df: DataFrame, fields: list[str], keys: list[str], clean: bool = True) -> DataFrame:
    """df's keys and every field under its own name, cleaned by what it is called; '' where no column fits.
    The columns are resolved once, on the driver."""
    have = [c for c in df.columns if c not in keys]
    pick = {f: match_key(f, have) for f in fields}
    value = lambda f: F.lit("") if pick[f] is None else F.coalesce(F.col(f"`{pick[f]}`").cast("string"), F.lit(""))
    return df.select(*keys, *((tx.clean_value(f, value(f)) if clean else value(f)).alias(f) for f in fields))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns, as strings, '' for null or absent."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """R6: '' where one of these columns is null or absent."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns})


def carry_forward(df: DataFrame, pairs: dict[str, str], stamp: str | None = "scraped_at") -> DataFrame:
    """Targets take their source column where that is not empty; stamp gets the time in UTC, ISO 8601."""
    df = df.withColumns({to: F.when(F.coalesce(F.col(of), F.lit("")) != "", F.col(of)).otherwise(F.col(to)) for to, of in pairs.items()})
    return df.withColumn(stamp, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) if stamp else df


def is_junk(fields: list[str]) -> Column:
    """Nothing but blanks; or several values, all the same; or all of two characters at most."""
    v = F.filter(_cells(fields), lambda x: x != "")
    return (F.size(v) == 0) | ((F.size(v) > 1) & (F.size(F.array_distinct(v)) == 1)) | F.forall(v, lambda x: F.length(x) <= 2)


def drop_junk(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.filter(~is_junk(fields))


def drop_valueless(df: DataFrame, fields: list[str]) -> DataFrame:
    """P2."""
    return df.filter(reduce(lambda a, b: a | b, (tx.has_value(F.col(f)) for f in fields)))


def drop_blank(df: DataFrame, fields: list[str]) -> DataFrame:
    """P3."""
    return df.filter(F.exists(_cells(fields), lambda x: x != ""))


def require(df: DataFrame, field: str) -> DataFrame:
    """Records whose field is not blank."""
    return df.filter(~tx.is_blank(F.col(field)))


def filled(fields: list[str]) -> Column:
    """Number of a record's cells that hold a value."""
    return reduce(lambda a, b: a + b, (tx.has_value(F.col(f)).cast("int") for f in fields))


def coverage_by(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, records, coverage): cells with a value over all cells."""
    return df.groupBy(*keys).agg(F.count("*").alias("records"), (F.sum(filled(fields)) / (F.count("*") * len(fields))).alias("coverage"))


def gate(df: DataFrame, keys: list[str], fields: list[str], least: float) -> DataFrame:
    """The groups that fill at least that share of their cells."""
    return df.join(coverage_by(df, keys, fields).filter(F.col("coverage") >= least).select(*keys), keys, "left_semi")


def choose_tier(engines: list[DataFrame], page: str, fields: list[str], gates: dict[int, float] | None = None) -> DataFrame:
    """Engine outputs in order of preference (each with the page's key and the fields); a page keeps the first that gives
    records and passes its gate. Adds tier. An output may be empty."""
    tagged = [e.withColumn("tier", F.lit(i)) for i, e in enumerate(engines)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cov = coverage_by(every, [page, "tier"], fields)
    need = F.coalesce(*(F.when(F.col("tier") == t, F.lit(g)) for t, g in (gates or {}).items()), F.lit(0.0))
    best = cov.filter(F.col("coverage") >= need).groupBy(page).agg(F.min("tier").alias("tier"))
    return every.join(best, [page, "tier"])


# --- deduplication -------------------------------------------------------------------------------
def content_key(fields: list[str], cells: int = 3, chars: int = 80) -> Column:
    """The first cells that are not blank, cut and joined; '' if there are none."""
    v = F.slice(F.filter(_cells(fields), lambda x: x != ""), 1, cells)
    return F.array_join(F.transform(v, lambda x: F.left(x, F.lit(chars))), "||")


def keep_first(df: DataFrame, key: str | Column, order: list[str | Column]) -> DataFrame:
    """The first row of each key. A partial minimum runs before the shuffle, so a hot key costs a row a task."""
    cols = df.columns
    k = F.col(key) if isinstance(key, str) else key
    o = F.struct(*[F.col(x) if isinstance(x, str) else x for x in order])
    return df.groupBy(k.alias("_k")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), o).alias("_r")).select("_r.*")


def dedup_content(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """Records with no content key go; of equal keys the first stays."""
    key = tx.free_name(df.columns, "_ck")
    return keep_first(df.withColumn(key, content_key(fields)).filter(F.col(key) != ""), key, order).drop(key)


def dedup_id(df: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """The first of each id; all records without one share the id ''."""
    return keep_first(df, F.coalesce(F.col(id_).cast("string"), F.lit("")), order)


def merge_patch(base: DataFrame, patch: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """All of base, and of patch the first of each id that is not empty and not in base. The base wins."""
    new = patch.filter(F.coalesce(F.col(id_).cast("string"), F.lit("")) != "")
    new = keep_first(new, id_, order).join(base.select(id_).distinct(), id_, "left_anti")
    return base.unionByName(new.select(*base.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """U4: the latest row of each key by seq; old and new share their columns."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), seq).alias("_r")).select(key, "_r.*").select(*both.columns)


def add_records(known: DataFrame, batch: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """What a batch adds: the first of each id that is not known, and every record without an id."""
    some = F.coalesce(F.col(id_).cast("string"), F.lit("")) != ""
    fresh = keep_first(batch.filter(some), id_, order).join(known.select(id_).distinct(), id_, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.filter(~some))


def dedup_candidates(df: DataFrame, order: list[str], most: int = 20, chars: int = 120) -> DataFrame:
    """U8, S10's tail: the first of each URL and body start, `most` of them in order."""
    first = keep_first(df, F.concat_ws("|", "url", F.left("body", F.lit(chars))), order)
    return first.orderBy(*order).limit(most)


# --- windows, limits -------------------------------------------------------------------------------
def ordinal(df: DataFrame, within: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """W1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def fill_forward(df: DataFrame, column: str, within: list[str], order: list[str], name: str) -> DataFrame:
    """W4."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def top_k(df: DataFrame, within: list[str], order: list, k: int) -> DataFrame:
    """L2: the first k of each group."""
    n = tx.free_name(df.columns, "_n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col(n) <= k).drop(n)


def limited(df: DataFrame, order: list[str], n: int | None, zero_is_all: bool = False) -> DataFrame:
    """L1, L3: the first n in order; None is all, and so is 0 if asked."""
    return df if n is None or (zero_is_all and n == 0) else df.orderBy(*order).limit(n)


def progress(done: int, total: int, elapsed: float) -> dict[str, float]:
    """Rate and seconds left; 0 where nothing is known."""
    rate = done / elapsed if elapsed > 0 else 0.0
    return {"rate": rate, "eta": (total - done) / rate if rate else 0.0}
