"""Column expressions against row-at-a-time Python, on written and fuzzed strings."""

import hashlib
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions import urls, values

SPECS = "array<struct<section_name:string,items:array<struct<label:string,value:string>>>>"


def over(spark, inputs, make):
    """make(column)'s value for each input, in order."""
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, c string")
    return [r.v for r in df.select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]


def fuzz(alphabet, n=200, seed=0, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_white_space(spark):
    rows = [None, "", " a  b ", " x y ", "\tz\n", *fuzz(["a", " ", "\n", "\t", " ", "​", "﻿", "b"])]
    assert over(spark, rows, tx.clean) == ["" if x is None else x.strip() for x in rows]
    assert over(spark, rows, tx.collapse) == [None if x is None else re.sub(r"\s+", " ", x).strip() for x in rows]
    assert over(spark, rows, tx.normalize_space) == [re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", (x or "").replace(" ", " "))).strip() for x in rows]
    assert over(spark, rows, tx.first_line) == [next((y.strip() for y in (x or "").split("\n") if y.strip()), "") for x in rows]


def test_html_text_and_cuts(spark):
    assert over(spark, ["<p style='x'>a</p><script>no</script>  <b>c</b>", "<style>\nq{}</style>d", None], tx.strip_html) == ["a c", "d", None]
    assert over(spark, ["", "abc", "a" * 4000], tx.estimate_tokens) == [1, 1, 1000]
    assert over(spark, ["abcdef", "abc", None], lambda c: tx.truncate(c, 3)) == ["abc...[truncated]", "abc", None]
    assert over(spark, ["ENGINE SPECS - 2.0L", "A-B", "X – y"], tx.cut_dash) == ["ENGINE SPECS", "A-B", "X"]
    assert over(spark, ['<i data-x="1" data-testid="k" onclick="f()" aria-label="q"> <svg>d</svg></i>'], tx.scrub_snapshot) == ['<i data-testid="k"> </i>']


@pytest.mark.parametrize(
    "field, value, want",
    [
        ("release_year", "out in 1999 (2h 3m)", "1999"), ("imdb_score", "8.7 of 10", "8.7"), ("rank", "  12. x", "12"), ("price", "now £ 1,234.50!", "£ 1,234.50"),
        ("runtime", "2h 3min long", "2h 3min"), ("title", "  Some   title  ", "Some title"), ("notes", "7 dwarfs", "7"), ("price", "none", "none"), ("title", "Heat Read more", "Heat"), ("x", None, ""),
    ],
)
def test_values_by_field_name(spark, field, value, want):
    assert over(spark, [value], lambda c: tx.clean_value(field, c)) == [want]


def test_transform_hints(spark):
    assert over(spark, [" A "], lambda c: tx.transformed(c, "strip")) == ["A"]
    assert over(spark, ["-1,2x"], lambda c: tx.transformed(c, "to_number")) == [-12.0]
    with pytest.raises(ValueError):
        tx.transformed(F.col("c"), "shout")


def test_prices(spark):
    def price(x):
        try:
            return float(re.sub(r"[^0-9.]", "", x)) if x is not None else None
        except ValueError:
            return None

    rows = [None, "", "£51.77", "1.234.5", "-3", "1,000", ".", *fuzz("019.,£-x ", 300, 1, 8)]
    assert over(spark, rows, values.parse_price) == [price(x) for x in rows]
    assert over(spark, ["£51.7", "free", None], values.price_text) == ["51.70", "", ""]


def test_ratings_and_stock(spark):
    assert over(spark, ["star-rating Three", "five one", "sixty", None], values.rating_value) == [3, 5, None, None]
    assert over(spark, ["star-rating Three", "x"], values.rating_word) == ["Three", ""]
    assert over(spark, ["In stock (22 available)", "Out of Stock", "In stock", "", None], values.stock_count) == [22, 0, None, None, None]


def test_engine_codes(spark):
    assert over(spark, ["1998 cc", "2.0 l", "1,984 cc", "none"], values.liters) == ["2.0L", "2.0L", "2.0L", None]
    assert over(spark, ["150 hp @ 4000", "100.5 HP", "101.5 HP", "x"], values.horsepower) == [150, 100, 102, None]
    assert over(spark, ["6-Speed Manual", "8-speed automatic", "5-Speed", "CVT"], values.gearbox_code) == ["6MT", "8AT", "5", "CVT"]
    assert over(spark, ["Rear Wheel Drive", "4WD", "front wheel drive", " odd "], values.drive_code) == ["RWD", "AWD", "FWD", "odd"]
    assert over(spark, ["ENGINE SPECS - x", "BRAKES SPECS", "Dimensions", "Cargo"], values.is_section_header) == [True, True, True, False]
    assert over(spark, ["2020", "2019-2021", "2020 x", None], values.is_generic_label) == [True, True, False, False]
    assert over(spark, ["Available with 12 engines", "none"], values.expected_count) == [12, None]


@pytest.mark.parametrize(
    "anchor, slots",
    [
        ("aeng_bmw-3-2019-20l-v6-8at-rwd-190-hp", {"liters": "2.0L", "cylinders": "V6", "gearbox": "8AT", "drive": "RWD", "hp": "190"}),
        ("aeng_x-2020-ev-75kwh-4wd", {"kwh": "75 KWH", "drive": "AWD"}),
        ("aeng_x-ev-525-kwh-300-hp", {"kwh": "52.5 KWH", "hp": "300"}),
        ("aeng_x-ev-204-hp", {"liters": "20.4L"}), ("aeng_x-ev-1200-hp", {"hp": "1200"}), ("aeng_x-150-hp-2l", {"liters": "2.0L"}), ("aeng_x-150-hp-v6", {"liters": "15.0L", "cylinders": "V6"}), ("aeng_x-2l-75-kwh-v8-v6", {"liters": "2.0L", "kwh": "7.5 KWH", "cylinders": "V8"}),
        ("aeng_x-99kwh-120-kwh-5-hp", {"kwh": "99 KWH", "hp": "5"}), ("", {}), (None, {}), ("aeng_2020-1999", {}),
        ("aeng_plain", {}),
    ],
)
def test_anchor_slots(spark, anchor, slots):
    got = over(spark, [anchor], values.anchor_slots)[0].asDict()
    assert {k: v for k, v in got.items() if v is not None} == slots


def test_engine_names_cascade(spark):
    specs = [("ENGINE", [("Displacement", "1998 cc"), ("Cylinders", "L4"), ("Power", "150 HP")]), ("DRIVE", [("Gearbox", "6-Speed Manual"), ("Drive Type", "Front Wheel Drive")])]
    electric = [("E", [("Fuel", "Electric"), ("Power", "201 HP"), ("Battery Capacity", "75 kWh"), ("Drive Type", "AWD")])]
    rows = [("Label", "aeng_x-2l", specs), ("", "aeng_none", specs), ("", "aeng_none", electric), ("", "aeng_car-2l-v6", specs), ("", "aeng_none", [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, label string, anchor string, s {SPECS}")
    got = [r.n for r in df.select("i", values.engine_name("label", "anchor", "s").alias("n")).orderBy("i").collect()]
    assert got == ["Label", "2.0L L4 6MT FWD (150 HP)", "75 KWH AWD (201 HP)", "2.0L V6 6MT FWD (150 HP)", ""]


def test_identifiers(spark):
    df = spark.createDataFrame([("a", None), ("", "u")], "x string, y string")
    assert [r.v for r in df.select(values.make_id("x", "y").alias("v")).collect()] == [hashlib.sha1(s.encode()).hexdigest() for s in ("a|None", "|u")]
    assert [r.v for r in df.select(values.book_id("x", "y").alias("v")).collect()] == ["a", hashlib.sha1(b"u").hexdigest()[:16]]


@pytest.mark.parametrize(
    "text, role, href, kind",
    [
        ("(1999)", "text", "", "year"), ("1234", "text", "", "text"), ("8.7", "text", "", "rating"), ("51.77", "text", "", "text"), ("8.7 (2M)", "text", "", "rating_with_info"),
        ("1,250", "text", "", "rank_or_number"), ("2h 3m", "text", "", "duration"), ("£5", "text", "", "price"), ("9.5K", "text", "", "count"), ("123456", "text", "", "count"),
        ("PG-13", "text", "", "age_rating"), ("go here", "link", "/x", "link"), ("A heading", "heading", "", "title"), ("plain", "text", "", "text"),
    ],
)
def test_value_types(spark, text, role, href, kind):
    df = spark.createDataFrame([(text, role, href)], "t string, r string, h string")
    assert df.select(values.value_type("t", "r", "h")).first()[0] == kind


def test_retries(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 9)], "n int")
    assert [r[0] for r in df.select(values.retry_wait("n")).collect()] == [0.0, 2.0, 4.0, 20.0]
    df = spark.createDataFrame([(0, 0, 0), (None, 0, 0), (3, 0, 0), (0, 1, 0), (0, 0, 2)], "e int, l int, a int")
    assert [r[0] for r in df.select(values.failure_status("e", "l", "a")).collect()] == ["flagged", "flagged", "failed", "failed", "failed"]


def test_joined_references(spark):
    refs = ["", "x", "/x", "//h/x", "../x", "./a/../b", "?q=1", "#f", "http://o/p", "/a/../b", "mailto:x", "/a b", "g;x=1/./y", *fuzz("ab/.?#:", 150, 4, 9)]
    for base in ("http://s.com/catalogue/page-2.html", "https://s.com", "not a url"):
        want = []
        for r in refs:
            try:
                want.append("" if r == "" else r if r.startswith("http") else urljoin(base, r))
            except ValueError:
                want.append(r)
        assert over(spark, refs, lambda c: urls.resolve(F.lit(base), c)) == want


def test_url_parts(spark):
    rows = ["https://WWW.Shop.com/a?b=1#top", "nothing", None]
    assert over(spark, rows, urls.domain) == ["shop.com", "", ""]
    assert over(spark, rows, urls.fragment) == ["top", "", ""]
    assert over(spark, ["javascript:x()", "/login?next=/", "/a", "mailto:a@b", "#", None], urls.is_skipped_link) == [True, True, False, True, True, False]
    assert over(spark, ["aeng_bmw-3-x", "aeng_", "x", None], urls.valid_anchor) == [True, False, False, False]


@pytest.mark.parametrize(
    "title, url, orig, n, reason",
    [
        ("t", "http://b.com/x", "http://a.com/x", 900, "other_domain"), ("t", "http://www.a.com/", "http://a.com/deep/x", 900, "lost_path"), ("t", "http://a.com/", "http://a.com/", 499, "thin"),
        ("Just a moment...", "http://a.com/x", "http://a.com/x", 900, "challenge"), (None, "http://a.com/x", "http://a.com/x", 900, "ok"), ("t", "", "http://a.com/x", 900, "ok"),
    ],
)
def test_page_validity(spark, title, url, orig, n, reason):
    df = spark.createDataFrame([(title, url, orig, n)], "t string, u string, o string, n int")
    r = df.select(urls.page_validity("t", "u", "o", "n").alias("v")).first().v
    assert (r.valid, r.reason) == (reason == "ok", reason)
