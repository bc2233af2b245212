"""Record sets, checks, nested records and walks, against small hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions.values import make_id
from pageloom.operators import checks, crawl, nested
from pageloom.operators import records as rec


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("field, keys, want", [("title", ["Title", "title"], "title"), ("release year", ["x", "Release_Year"], "Release_Year"), ("price", ["old", "unit_price"], "unit_price"), ("price", ["old"], None)])
def test_match_key(field, keys, want):
    assert rec.match_key(field, keys) == want


def test_align_and_complete(spark):
    df = spark.createDataFrame([(1, " The  Film ", "in 1994", None)], "k int, Film_Title string, year string, extra string")
    assert rows(rec.align(df, ["title", "year", "gone"], ["k"]), "k") == [(1, "The Film", "1994", "")]
    assert rows(rec.complete(df, ["year", "none", "extra"]), "year") == [("in 1994", "", "")]
    out = rec.carry_forward(rec.defaults(df, ["extra"]), {"extra": "year"})
    assert out.first().extra == "in 1994" and out.first().scraped_at.endswith("+00:00")


def test_junk_and_value_filters(spark):
    data = [(1, "a b c", "x y z"), (2, "", None), (3, "same", "same"), (4, "ab", "cd"), (5, "null", " None "), (6, "only one", ""), (7, " ", "long enough")]
    df = spark.createDataFrame(data, "k int, a string, b string")
    assert [r[0] for r in rows(rec.drop_junk(df, ["a", "b"]), "k")] == [1, 5, 6, 7]
    assert [r[0] for r in rows(rec.drop_valueless(df, ["a", "b"]), "k")] == [1, 3, 4, 6, 7]
    assert [r[0] for r in rows(rec.drop_blank(df, ["a", "b"]), "k")] == [1, 3, 4, 5, 6, 7]
    assert [r[0] for r in rows(rec.require(df, "b"), "k")] == [1, 3, 4, 5, 7]


def test_coverage_gate_and_tiers(spark):
    one = spark.createDataFrame([(1, "x", ""), (2, "y", "z")], "page int, a string, b string")
    two = spark.createDataFrame([(1, "p", "q"), (3, "r", "")], "page int, a string, b string")
    assert {r.page: r.coverage for r in rec.coverage_by(one, ["page"], ["a", "b"]).collect()} == {1: 0.5, 2: 1.0}
    assert rows(rec.gate(one, ["page"], ["a", "b"], 0.6), "page") == [(2, "y", "z")]
    got = rec.choose_tier([one, two], "page", ["a", "b"], {0: 0.6}).select("page", "a", "tier")
    assert rows(got, "page") == [(1, "p", 1), (2, "y", 0), (3, "r", 1)]


def test_content_dedup_matches_a_loop(spark):
    rng = random.Random(5)
    data = [(i, *(rng.choice(["", " ", "a", " a ", "b", None, "q" * 90, "q" * 85]) for _ in range(4))) for i in range(400)]
    df = spark.createDataFrame(data, "i int, a string, b string, c string, d string")
    seen, want = set(), []
    for row in data:
        key = "||".join(v.strip()[:80] for v in [v for v in row[1:] if v and v.strip()][:3])
        if key and key not in seen:
            seen.add(key)
            want.append(row)
    got = rec.dedup_content(df.repartition(7), ["a", "b", "c", "d"], ["i"])
    assert rows(got, "i") == want
    assert rows(rec.dedup_content(got, ["a", "b", "c", "d"], ["i"]), "i") == want


def test_dedup_merge_upsert_add(spark):
    s = "i int, id string, v string"
    base = spark.createDataFrame([(1, "a", "1"), (2, "a", "2"), (3, None, "3"), (4, "", "4")], s)
    patch = spark.createDataFrame([(5, "a", "5"), (6, "b", "6"), (7, "b", "7"), (8, None, "8"), (9, "", "9")], s)
    assert [r[0] for r in rows(rec.dedup_id(base, "id", ["i"]), "i")] == [1, 3]
    assert [r[0] for r in rows(rec.merge_patch(base, patch, "id", ["i"]), "i")] == [1, 2, 3, 4, 6]
    assert [r[0] for r in rows(rec.add_records(base, patch, "id", ["i"]), "i")] == [6, 8, 9]
    assert [tuple(r)[0] for r in rows(rec.upsert(base.filter("i = 1"), patch.filter("i < 8"), "id", "i"), "i")] == [5, 7]
    none = spark.createDataFrame([], s)
    assert rows(rec.merge_patch(none, none, "id", ["i"]), "i") == [] and rows(rec.dedup_content(none, ["v"], ["i"]), "i") == []


def test_windows_and_limits(spark):
    df = spark.createDataFrame([(1, 1, "h"), (1, 2, None), (1, 3, "k"), (2, 1, None)], "p int, o int, h string")
    assert [r[3] for r in rows(rec.fill_forward(df, "h", ["p"], ["o"], "f"), "p", "o")] == ["h", "h", "k", None]
    assert [r[:2] for r in rows(rec.top_k(df, ["p"], [F.desc("o")], 2), "p", "o")] == [(1, 2), (1, 3), (2, 1)]
    assert [r[3] for r in rows(rec.ordinal(df, ["p"], ["o"]), "p", "o")] == [1, 2, 3, 1]
    assert rec.limited(df, ["p", "o"], 0).count() == 0 and rec.limited(df, ["p", "o"], 0, True).count() == 4 and rec.limited(df, ["o"], None).count() == 4
    assert rec.progress(5, 10, 2.0) == {"rate": 2.5, "eta": 2.0} and rec.progress(0, 10, 0) == {"rate": 0.0, "eta": 0.0}


def test_candidates(spark):
    df = spark.createDataFrame([(i, f"u{i % 3}", ("x" * 120) + str(i)) for i in range(9)], "i int, url string, body string")
    assert [r[0] for r in rows(rec.dedup_candidates(df, ["i"], 2), "i")] == [0, 1]


def test_lookup_and_orphans(spark):
    child = spark.createDataFrame([(1, "a"), (2, "z"), (3, " "), (4, None)], "i int, fk string")
    parent = spark.createDataFrame([("a", "A"), ("", "no"), (None, "no")], "pk string, n string")
    dim = parent.filter("pk = 'a'").withColumnRenamed("pk", "fk")
    assert [r[2] for r in rows(checks.lookup(child, dim, "fk", "n", "name"), "i")] == ["A", "", "", ""]
    assert [r[0] for r in rows(checks.orphans(child, "fk", parent, "pk"), "i")] == [2]
    assert rows(checks.orphan_issue(child, "fk", parent, "pk", "brand"), "category") == [("brand_orphan", 1)]
    assert [r.url for r in checks.pending(child.withColumnRenamed("fk", "url"), dim.withColumnRenamed("fk", "url")).orderBy("i").collect()] == ["z", " ", None]


def test_reports(spark):
    df = spark.createDataFrame([("1", "x", "-5", "9"), ("1", "", "20000", "3"), ("1", None, "5", "n/a"), (None, "y", None, "0")], "id string, t string, price string, rating string")
    missing = checks.missing_required(df, ["id", "t", "absent"], "book")
    assert rows(missing, "category") == [("missing_book_absent", 4), ("missing_book_id", 1), ("missing_book_t", 2)]
    assert rows(checks.duplicate_issue(df, "id", "dup"), "n") == [("dup_detected", 2)]
    assert rows(checks.range_issues(df, "price", "rating"), "category") == [("price_out_of_range", 2), ("rating_out_of_range", 2)]
    merged = checks.merged_issues(missing, checks.duplicate_issue(df, "id", "dup"), missing)
    assert [tuple(r) for r in merged.collect()] == [("dup_detected", 2), ("missing_book_absent", 8), ("missing_book_id", 2), ("missing_book_t", 4)]
    assert [r.missing for r in checks.flag_missing(df, ["id", "t"]).orderBy("price").collect()] == [["id"], [], ["t"], ["t"]]


def test_run_metrics(spark):
    df = spark.createDataFrame([("ok", 3, 6), ("ok", 1, 1), ("failed", 0, 0), ("flagged", 2, 2)], "status string, n_records int, n_rows int")
    r = checks.run_metrics(df, 2.0).first()
    assert (r.ok, r.failed, r.flagged, r.processed, r.records, r.csv_rows, r.success_rate, r.records_per_second) == (2, 1, 1, 4, 6, 9, 0.5, 2.0)
    r = checks.run_metrics(df.limit(0)).first()
    assert (r.processed, r.records, r.success_rate, r.records_per_second) == (0, 0, 0.0, 0.0)


SECTIONS = "id string, sections array<struct<section_name:string,items:array<struct<label:string,value:string>>>>"


def test_flatten_then_nest_is_the_identity(spark):
    data = [("e1", [("A", [("x", "1"), ("y", "2")]), ("B", [("x", "3")])]), ("e2", [("C", [("z", "")])])]
    df = spark.createDataFrame(data, SECTIONS)
    flat = nested.flatten_sections(df, "id")
    assert [(r.id, r.position, r.section_name, r.spec_label) for r in flat.orderBy("id", "position").collect()] == [("e1", 1, "A", "x"), ("e1", 2, "A", "y"), ("e1", 3, "B", "x"), ("e2", 1, "C", "z")]
    assert flat.select((F.col("spec_id") == make_id("id", "section_name", "spec_label", "spec_value")).alias("same")).distinct().collect()[0].same
    assert flat.count() == df.select(F.sum(nested.item_total())).first()[0]
    back = nested.nest_sections(flat, ["id"])
    assert sorted(back.collect()) == sorted(df.collect())


def test_array_helpers(spark):
    df = spark.createDataFrame([(["Home", "Books", "Poetry", "It"], [("UPC", "1"), ("Tax", "0"), ("UPC", "2")])], "c array<string>, p array<struct<key:string,value:string>>")
    got = df.select(nested.breadcrumb("c"), nested.category("c"), nested.joined_values("c", 2), *nested.key_values("p", {"UPC": "upc", "Type": "kind"})).first()
    assert tuple(got) == ("Home > Books > Poetry > It", "Poetry", "Home | Books", "2", "")


def test_levels_carry_names_down(spark):
    seeds = spark.createDataFrame([("root",)], "url string")
    links = spark.createDataFrame([("root", 1, "Oslo", "c1"), ("root", 2, "Rome", "c2"), ("c1", 1, "Inn", "h1"), ("c2", 1, "Villa", "h2"), ("c2", 2, "Empty", "")], "url string, ord int, name string, next_url string")
    got = {r.url: r.parent for r in crawl.expand_levels(seeds, links, ["citys", "hotels"], ["city_name"]).collect()}
    assert got == {"h1": {"city_name": "Oslo", "hotels": "Inn"}, "h2": {"city_name": "Rome", "hotels": "Villa"}}
    assert crawl.expand_levels(seeds, links, ["citys"], [], 1).collect()[0].url == "c1"


def test_following_ends_in_cycles_and_at_the_cap(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "")], "url string, next_url string")
    start = spark.createDataFrame([("a",)], "url string")
    assert rows(crawl.follow(start, links), "step") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(crawl.follow(start, links, 2), "step") == [("a", 0), ("b", 1)]


def test_frontier_and_parent_merge(spark):
    links = spark.createDataFrame([("a", 3), ("b", 1), ("b", 5), ("c", 2)], "url string, ord int")
    seen = spark.createDataFrame([("c",)], "url string")
    assert [r.url for r in crawl.frontier(links, seen, 5).collect()] == ["b", "a"]
    df = spark.createDataFrame([({"x": "p", "y": "p"}, "", "own")], "parent map<string,string>, x string, y string")
    assert tuple(crawl.merge_parent(df, ["x", "y"]).first()) == ("p", "own")
