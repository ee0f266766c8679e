import pytest
from pyspark.sql import functions as F

from tablewise.functions import (
    blank_to_null,
    checked_url,
    clean_url,
    collapse,
    comma_list,
    domain,
    formula_guard,
    is_email,
    is_missing,
    map_value,
    num_loose,
    num_strict,
    parse_boolean,
    standard_date,
    standard_place,
    title_case,
    url_safety,
)
from tablewise.functions.text import MISSING_FILTER, MISSING_PROFILE, MISSING_REQUIRED


def apply(spark, rule, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("t"))).collect()]


def test_strict_number(spark):
    texts = ["1.0d", " 12 ", "1,000", "1e3", "inf", "", "nan", "1_000", ".5", "5.", "+7", "1f", None]
    assert apply(spark, num_strict, *texts) == [
        None, 12.0, None, 1000.0, float("inf"), None, None, None, 0.5, 5.0, 7.0, None, None,
    ]
    flags = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert [r[0] for r in flags.select(num_strict(F.col("b"), flags.schema["b"].dataType)).collect()] == [1.0, 0.0]


def test_loose_number(spark):
    texts = ["₹35,00,000", "1-2", "-", "1e3", "A-12", "", ".", None]
    assert apply(spark, num_loose, *texts) == [3500000.0, None, None, 13.0, -12.0, None, None, None]


def test_text(spark):
    assert apply(spark, title_case, "it's AB-cd 9x") == ["It'S Ab-Cd 9X"]
    assert apply(spark, collapse, "  a   b\t\nc ") == ["a b c"]
    assert apply(spark, blank_to_null, "N/A", " - ", "undefined", "", "nan", " x ") == [None, None, None, None, "nan", " x "]
    assert apply(spark, comma_list, "a, ,b,,c ") == [["a", "b", "c"]]
    assert apply(spark, formula_guard, "=1+1", "-5", "\tx", "\rx", "a=1", " =", None) == ["'=1+1", "'-5", "'\tx", "'\rx", "a=1", " =", None]
    assert apply(spark, parse_boolean, "YES", "f", "0", "", "other") == [True, False, False, False, True]
    assert apply(spark, is_email, "a.b+c@x-y.co.uk", "a@b", "a b@c.d") == [True, False, False]


def test_missing_presets(spark):
    texts = [None, "", " \t", "NULL", "none", "n/a", "nothing at all"]

    def missing(words):
        return apply(spark, lambda c: is_missing(c, words), *texts)

    assert missing(()) == [True] + [False] * 6
    assert missing(MISSING_PROFILE) == [True, True, True, True, False, False, False]
    assert missing(MISSING_FILTER) == [True, True, True, True, True, False, False]
    assert missing(MISSING_REQUIRED) == [True] * 6 + [False]


def test_value_map(spark):
    def rule(c):
        return map_value(c, {"A": "exact", "b": "loose", "gone": None})

    assert apply(spark, rule, " A ", "a", "B", "GONE", "x", None) == ["exact", "exact", "loose", None, "x", None]


def test_dates(spark):
    texts = [
        "03/04/2023", "13/25/2023", "12/25/2023", "September 5, 2023", "Sep 5, 2023", "2024/01/05", "05/01/24",
        "3-4-2023", "2024-02-30", "2024-01-05T10:20:30.123Z", " 2024-01-05 10:20:30 ", "2024-1-5", None,
    ]
    assert apply(spark, standard_date, *texts) == [
        "2023-04-03", "13/25/2023", "2023-12-25", "2023-09-05", "2023-09-05", "2024-01-05", "05/01/24",
        "2023-04-03", "2024-02-30", "2024-01-05", "2024-01-05", "2024-01-05", None,
    ]


def test_urls(spark):
    long = "https://Example.com:8080/a/?utm_source=x&id=1&ref=z&e=#top"
    assert apply(spark, clean_url, long, "HTTPS://X.org/A", "x.org/p;v=1/?q=a b", "", None) == [
        "https://example.com:8080/a?id=1", "https://x.org/A", "https://x.org/p;v=1?q=a+b", "", None,
    ]
    assert apply(spark, clean_url, "http://x.org/a/b/;v=1?q=%C3%A9*~&gclid=1") == ["http://x.org/a/b;v=1?q=%C3%A9%2A~"]
    assert apply(spark, checked_url, long, "https://www.site.example.org/", "https:///x", "x.org/a/?b=1&c=2&b=3&UTM_x=1") == [
        "https://example.com:8080/a?id=1&ref=z", "https://www.site.example.org/", None, "https://x.org/a?b=1&b=3&c=2",
    ]
    assert apply(spark, domain, "https://www.site.example.org/", "Example.com:8080/x", "a_b.org", "", None) == [
        "site.example.org", "example.com:8080", "a_b.org", None, None,
    ]


@pytest.mark.parametrize(
    "url",
    [
        "http://127.0.0.1:8000", "http://localhost/admin", "http://169.254.169.254/latest/meta-data/", "ftp://example.com/file.txt",
        "file:///etc/passwd", "http://internal-service.local/api", "http://10.0.0.1/", "http://192.168.1.1/", "http://172.16.0.1/",
        "http://[::1]/", "http://[fe80::1]/", "http://[fc00::1]/", "http://[ff02::1]/", "http://[2001:db8::1]/", "http://[::ffff:10.0.0.1]/",
        "http://[2002:a00::1]/", "http://[::]/", "http://[zz::1]/", "http://224.0.0.1/", "http://240.1.1.1/", "http://0.1.2.3/",
        "http://198.18.0.1/", "http://user@10.1.1.1:80/", "http://LOCALHOST./", "https://", "", None, "http://x.internal/",
    ],
)
def test_blocked_urls(spark, url):
    assert apply(spark, lambda c: url_safety(c)["is_safe"], url) == [False]


@pytest.mark.parametrize(
    "url",
    [
        "https://example.com/a", "http://8.8.8.8/", "https://[2606:4700::1111]/", "http://172.32.0.1/", "http://192.0.0.9/",
        "http://11.0.0.1/", "https://localhost.example.org/", "http://[2001:4860:4860::8888]:443/",
    ],
)
def test_open_urls(spark, url):
    assert apply(spark, lambda c: url_safety(c)["is_safe"], url) == [True]


def test_safety_agrees_with_the_standard_library(spark):
    import ipaddress
    import random

    draw = random.Random(5)
    four = [str(ipaddress.IPv4Address(draw.getrandbits(32))) for _ in range(300)]
    firsts = (0x2001, 0x2002, 0x2600, 0x3FFF, 0xFE80, 0xFC12, 0xFF02, 0x0064, 0x4000, 0xFEC0)
    six = [
        str(ipaddress.IPv6Address((draw.choice(firsts) << 112) | draw.getrandbits(112 if draw.random() < 0.5 else 20)))
        for _ in range(300)
    ]

    def open_(text):
        ip = ipaddress.ip_address(text)
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    got = apply(spark, lambda c: url_safety(c)["is_safe"], *[f"http://{a}/" for a in four], *[f"http://[{a}]/" for a in six])
    wrong = [(a, g) for a, g in zip(four + six, got) if g != open_(a)]
    assert wrong == []


def test_places(spark):
    texts = ["NYC", "sf, CA", "Austin us", " Bengaluru ", "usable", "UK", None]
    assert apply(spark, standard_place, *texts) == [
        "New York City", "San Francisco, CA", "Austin United States", "Bangalore", "usable", "United Kingdom", None,
    ]


def test_canonical_links(spark):
    from tablewise.functions.html import canonical_link

    cases = [
        (None, None),
        ("", None),
        ("<html><head><title>canonical</title></head></html>", None),
        ('<link rel="canonical" href="u">', "u"),
        ("<link href='u' rel='canonical'>", "u"),
        ("<LINK REL=CANONICAL HREF=u/v />", "u/v"),
        ('<link\n rel="a canonical b"\n href="u?x=1&amp;y=2">', "u?x=1&y=2"),
        ('<link rel="canonical" href=""><link rel="canonical" href="v"><link rel="canonical" href="w">', "v"),
        ('<link rel="canonicals" href="u">', None),
        ('<linker rel="canonical" href="u">', None),
        ('<link data-rel="canonical" href="u">', None),
        ('<link title=\'rel="canonical" >\' href="u">', None),
        ("<link rel=canonical href=\"it's\">", "it's"),
        ('<!--<link rel="canonical" href="u">--><link rel="canonical" href="v">', "v"),
        ('<style>link{}</style ><link rel="canonical" href="v">', "v"),
        ("<link rel=\"canonical\" " + "x " * 50_000 + 'href="far">', "far"),
        ("<link rel=canonical " + "'" * 50_001, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    got = {r["i"]: r["c"] for r in df.select("i", canonical_link(F.col("h")).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
