"""Mixing sources to target weights by Pareto order sampling. DataFrame and SQL functions only.

A document's expected number of copies is proportional to a weight, up to the cap: 16 and the number of binary digits of its
number of words, so the longest are taken up to about twice as often as the shortest. The factor is the one at which the
expected words of its source are the target. The whole part is taken for certain; the rest
is the document's own inclusion probability, and documents are ranked by random odds over inclusion odds. The smallest
ranks are taken until the words reach the target (a sample of fixed size in words, to within half a document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, free_name, text_or_empty, word_count, write_table

#: Bins of the rank scale. Only the documents of one bin of each source are sorted; the bin that holds the cut has about
#: 1/BINS of a source's documents, because odds/(1+odds) spreads them evenly or thinner around the cut at odds of 1.
BINS = 4096


def source_targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: source, ord, source_size, target. From (source, size).

    Sources by code point, null last, take the weights in turn. Targets share the total size by weight, none above cap
    times its source's size; what is above is shared again among the others.
    """
    cycle = "CASE (ord - 1) % {} {} END".format(len(weights), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)))
    return sizes.sparkSession.sql(
        f"""
        WITH src AS (SELECT source, sum(size) AS source_size FROM {{sizes}} GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM src),
        weighed AS (SELECT *, {cycle} AS w FROM ranked),
        levels AS (
          SELECT *, row_number() OVER o AS pos, {cap} * source_size / CAST(w AS double) AS full_at,
                 (sum(source_size) OVER () - coalesce(sum({cap} * source_size) OVER before, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS double) AS level
          FROM weighed
          WINDOW o AS (ORDER BY {cap} * source_size / CAST(w AS double), ord),
                 before AS (ORDER BY {cap} * source_size / CAST(w AS double), ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT min_by(level, pos) AS level FROM levels WHERE level <= full_at)
        SELECT source, ord, source_size, least(CAST({cap} * source_size AS double), (SELECT level FROM level) * w) AS target FROM weighed
        """,
        sizes=sizes,
    )


#: An integer, so sums of it are exact and reruns agree; it rises with size, which shares() relies on.
WEIGHT = "CAST(16 + length(bin({size})) AS bigint)"

EXPECTED = "CASE WHEN source_size > 0 THEN least(CAST({cap} AS double), {factor} * {w}) ELSE 0D END"


def shares(sizes: DataFrame, sources: DataFrame, cap: int = 3) -> DataFrame:
    """(source, ord, source_size, target, factor, room) of every source: the expected copies of a document are least(cap, factor
    * weight), and room is how many words the certain copies leave for the sample. From (source, size) of documents and
    source_targets(). The heaviest sizes reach the cap first, so the factor is found on running sums over a source's
    distinct sizes; documents are not sorted.
    """
    return sizes.sparkSession.sql(
        f"""
        WITH g AS (SELECT b.ord, a.size, first(b.source_size) AS source_size, first(b.target) AS target, count(*) AS n, {WEIGHT.format(size="a.size")} AS w
                   FROM {{sizes}} a JOIN {{sources}} b ON a.source <=> b.source GROUP BY b.ord, a.size),
        s AS (SELECT *, CAST(n AS decimal(38,0)) * size AS words, CAST(n AS decimal(38,0)) * size * w AS weighed FROM g),
        r AS (SELECT *, coalesce(sum(words) OVER heavier, 0) AS full, sum(weighed) OVER lighter AS open
              FROM s WINDOW heavier AS (PARTITION BY ord ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                            lighter AS (PARTITION BY ord ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        f AS (SELECT *, CASE WHEN open > 0 THEN (target - {cap} * CAST(full AS double)) / CAST(open AS double) ELSE 0D END AS factor FROM r),
        best AS (SELECT ord, max_by(factor, size) AS factor FROM f WHERE factor * w <= {cap} GROUP BY ord),
        e AS (SELECT s.ord, words, coalesce(best.factor, CAST({cap} AS double)) AS factor, {EXPECTED.format(cap=cap, factor=f"coalesce(best.factor, {cap})", w="w")} AS copies FROM s LEFT JOIN best ON s.ord = best.ord),
        certain AS (SELECT ord, max(factor) AS factor, CAST(sum(CAST(floor(copies) AS decimal(38,0)) * words) AS double) AS words FROM e GROUP BY ord)
        SELECT b.source, b.ord, b.source_size, b.target, factor, target - words AS room FROM {{sources}} b JOIN certain ON b.ord = certain.ord
        """,
        sizes=sizes,
        sources=broadcast_if_small(sources),
    )


def _take_some(df: DataFrame, keys: list[str], m: str, flag: str) -> DataFrame:
    """df with flag true for m (a column, the same in a group) of the rows of each group, whichever. A group is counted by
    partition and never gathered in a task."""
    part, before, at = (free_name(df, x) for x in ("part", "before", "at"))
    df = write_table(df.withColumn(part, F.spark_partition_id()), "repeats")
    tied = ", ".join(f"`{k}`" for k in keys)
    counted = df.groupBy(*keys, part).agg(F.count("*").alias(at))
    counted = counted.withColumn(before, F.expr(f"coalesce(sum({at}) OVER (PARTITION BY {tied} ORDER BY {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).drop(at)
    other = {k: f"{at}_{i}" for i, k in enumerate([*keys, part])}
    side = broadcast_if_small(write_table(counted, "repeat-counts").select(*(F.col(k).alias(v) for k, v in other.items()), before))
    met = df.join(side, [F.col(k).eqNullSafe(F.col(v)) for k, v in other.items()])
    met = met.withColumn(at, F.expr(f"row_number() OVER (PARTITION BY {tied}, {part} ORDER BY {before})"))
    return met.withColumn(flag, F.col(before) + F.col(at) <= F.col(m)).select(*(c for c in df.columns if c != part), flag)


def mix(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (copies times size), digest (of the text).

    size is the number of words; a null text has none, and a document without words may get copies but takes no words.
    A null source is a source. Random numbers come from doc_id, text and seed alone, so reruns agree; ties go by doc_id,
    size and digest; of rows that repeat in all of these as many get a copy as there are words left for. An empty table
    gives no rows. Only doc_id, source and text are read. The sources themselves, one row each, are sorted in one task.
    """
    spark = docs.sparkSession
    sizes = write_table(docs.select("doc_id", "source", word_count().alias("size"), F.md5(text_or_empty()).alias("digest")), "sizes")
    sources = write_table(source_targets(sizes, cap, weights), "sources")
    sources = write_table(shares(sizes, sources, cap), "shares")
    u = f"(CAST(conv(substring(md5(concat('{seed}', coalesce(CAST(doc_id AS string), 'none'), ':', digest)), 1, 13), 16, 10) AS double) + 0.5) / 4503599627370496D"
    ranked = spark.sql(
        f"""
        WITH d AS (SELECT a.*, b.ord, b.source_size, b.target, b.room, {u} AS u, {EXPECTED.format(cap=cap, factor="b.factor", w=WEIGHT.format(size="a.size"))} AS expected
                   FROM {{sizes}} a JOIN {{sources}} b ON a.source <=> b.source),
        r AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS rest FROM d),
        o AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (rest / (1 - rest)) END AS odds FROM r)
        SELECT doc_id, source, size, source_size, target, digest, ord, whole, room, odds / (1 + odds) AS p, CAST(floor({BINS} * (odds / (1 + odds))) AS int) AS bin FROM o
        """,
        sizes=sizes,
        sources=broadcast_if_small(sources),
    )
    ranked = write_table(ranked, "ranked")
    cuts = spark.sql(
        """
        WITH bins AS (SELECT ord, bin, max(room) AS room, sum(size) AS words FROM {ranked} WHERE p IS NOT NULL GROUP BY ord, bin),
        run AS (SELECT *, sum(words) OVER (PARTITION BY ord ORDER BY bin) AS upto FROM bins)
        SELECT ord, min(bin) AS cut, min_by(upto - words, bin) AS before FROM run WHERE upto >= room GROUP BY ord
        """,
        ranked=ranked,
    )
    placed = ranked.join(broadcast_if_small(write_table(cuts, "cuts")), "ord", "left")
    outside = placed.filter("p IS NULL OR cut IS NULL OR bin <> cut").withColumn("more", F.expr("p IS NOT NULL AND (cut IS NULL OR bin < cut)"))
    # in the cut's bin: rows that repeat are one group with as many copies as fit
    inside = write_table(placed.filter("bin = cut"), "cut-bins")
    keys = ["ord", "p", "doc_id", "size", "digest"]
    fit = spark.sql(
        """
        WITH g AS (SELECT ord, p, doc_id, size, digest, count(*) AS n, max(room) AS room, max(before) AS before FROM {inside} GROUP BY ord, p, doc_id, size, digest),
        r AS (SELECT *, before + coalesce(sum(size * n) OVER (PARTITION BY ord ORDER BY p, doc_id, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM g)
        SELECT ord, p, doc_id, size, digest, n, CASE WHEN size = 0 THEN CASE WHEN upto <= room THEN n ELSE 0 END ELSE least(n, greatest(0, floor((room - upto) / size + 0.5D))) END AS m FROM r
        """,
        inside=inside,
    )
    fit = write_table(fit, "fits").select(*(F.col(k).alias(f"fit_{k}") for k in keys), "n", "m")
    met = inside.join(broadcast_if_small(fit), [inside[k].eqNullSafe(F.col(f"fit_{k}")) for k in keys])
    columns = [*outside.columns]
    known = met.filter("m = 0 OR m = n").withColumn("more", F.expr("m > 0")).select(*columns)
    some = met.filter("m > 0 AND m < n")
    out = outside.unionByName(known)
    if not some.isEmpty():
        out = out.unionByName(_take_some(some, keys, "m", "more").select(*columns))
    out = out.withColumn("copies", F.expr("CAST(whole AS bigint) + CAST(more AS int)"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "digest")


def apply_mix(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it (not at all where it takes none; documents without words go).

    Rows with the same doc_id, source and text share their copies: as many rows as the mix took of them. Columns may have
    any names; an empty table gives an empty table.
    """
    keys = ["doc_id", "source", "digest"]
    plan = mix(docs, cap, weights).filter("taken > 0").groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    plan = write_table(plan, "mix-plan")
    names = {k: free_name(docs, f"_mix_{k}") for k in [*keys, "copies", "n", "one", "rest", "own"]}
    tagged = docs.withColumn(names["own"], F.md5(text_or_empty()))
    side = plan.select(*(F.col(k).alias(names[k]) for k in [*keys, "copies", "n"]))
    on = [F.col("doc_id").eqNullSafe(F.col(names["doc_id"])), F.col("source").eqNullSafe(F.col(names["source"])), F.col(names["own"]) == F.col(names["digest"])]
    met = tagged.join(broadcast_if_small(side), on).withColumn(names["rest"], F.expr(f"`{names['copies']}` % `{names['n']}`"))
    each = F.expr(f"`{names['copies']}` div `{names['n']}`")
    out = met.filter(F.col(names["rest"]) == 0).withColumn(names["one"], each)
    if not plan.filter("copies % n > 0").isEmpty():
        several = _take_some(met.filter(F.col(names["rest"]) > 0), ["doc_id", "source", names["own"]], names["rest"], names["one"])
        out = out.unionByName(several.withColumn(names["one"], each + F.col(names["one"]).cast("int")))
    out = out.filter(F.col(names["one"]) > 0)
    return out.withColumn(names["n"], F.explode(F.expr(f"sequence(1L, `{names['one']}`)"))).select(*(f"`{c}`" for c in docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents. Null texts have no words, a null source is a source; ties and repeated rows as mix() says; an
    empty table gives no rows; further columns are not read."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_SQL = r"""
WITH sizes AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM src),
weighed AS (SELECT *, (ord - 1) % 3 + 1 AS w, 3 * source_size / CAST((ord - 1) % 3 + 1 AS DOUBLE) AS full_at FROM ranked),
levels AS (SELECT *, row_number() OVER (ORDER BY full_at, ord) AS pos,
   (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY full_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM weighed),
targets AS (SELECT source, ord, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, pos) FROM levels WHERE level <= full_at) * w) AS target FROM weighed),
g AS (SELECT b.ord, a.size, any_value(b.source_size) AS source_size, any_value(b.target) AS target, count(*) AS n,
   CAST(16 + length(bin(CAST(a.size AS BIGINT))) AS BIGINT) AS w
   FROM sizes a JOIN targets b ON a.source IS NOT DISTINCT FROM b.source GROUP BY b.ord, a.size),
s AS (SELECT *, CAST(n * size AS HUGEINT) AS words, CAST(n * size AS HUGEINT) * w AS weighed FROM g),
r AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY ord ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
   sum(weighed) OVER (PARTITION BY ord ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_words FROM s),
f AS (SELECT *, CASE WHEN open_words > 0 THEN (target - 3 * CAST(full_words AS DOUBLE)) / CAST(open_words AS DOUBLE) ELSE 0 END AS factor FROM r),
best AS (SELECT ord, arg_max(factor, size) AS factor FROM f WHERE factor * w <= 3 GROUP BY ord),
e AS (SELECT s.*, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, coalesce(best.factor, 3) * w) ELSE 0 END AS expected FROM s LEFT JOIN best ON s.ord = best.ord),
parts AS (SELECT ord, size, floor(expected) AS whole, expected - floor(expected) AS rest,
   target - CAST(sum(CAST(floor(expected) AS HUGEINT) * words) OVER (PARTITION BY ord) AS DOUBLE) AS room FROM e),
d AS (SELECT a.*, b.ord, b.source_size, b.target,
   (CAST(CAST(('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'none') || ':' || digest)[1:13]) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
   FROM sizes a JOIN targets b ON a.source IS NOT DISTINCT FROM b.source),
o AS (SELECT d.*, t.whole, t.room, CASE WHEN t.rest > 0 THEN (u / (1 - u)) / (t.rest / (1 - t.rest)) END AS odds FROM d JOIN parts t ON d.ord = t.ord AND d.size = t.size),
p AS (SELECT *, odds / (1 + odds) AS p FROM o),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY ord ORDER BY p NULLS LAST, doc_id, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
m AS (SELECT *, CAST(whole + CASE WHEN p IS NOT NULL AND before + size / 2.0::DOUBLE <= room THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM m
"""
