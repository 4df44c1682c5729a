"""Findings and the pages they belong to: the ladder of keys, its stops and its edge cases."""

from lintel.operators import attribution

PAGES = [
    ("home", "Home", "https://x.example/", 0, ["app/page.tsx", "ui\\nav.tsx"]),
    ("about", "About", "https://x.example/about", 1, ["app/about/page.tsx", "ui/nav.tsx", ""]),
    ("again", "ABOUT", "https://x.example/about", 2, None),
    ("bare", None, None, 3, []),
]
FINDINGS = "n long, page string, file string, capture string, source_file string, sample_page string, id string, key string"


def attributed(spark, rows, pages=PAGES):
    df = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], FINDINGS)
    scope = spark.createDataFrame(pages, "id string, name string, url string, position long, sources array<string>")
    out = attribution.attribute_pages(df, scope, "shots/pages")
    assert out.columns == ["n", "file", "capture", "source_file", "sample_page", "id", "key", "page", "page_kind", "approximate"]
    return [tuple(r)[7:] for r in out.orderBy("n").collect()]


def test_ladder(spark):
    rows = [
        ("elsewhere", "shots/pages/home/dom.html", None, None, None),
        (None, "a\\b\\shots\\pages\\home\\dom.html", None, None, "about"),
        (None, "x.html", "shots/pages/about/dom.html", "app/page.tsx", None),
        (None, "shots/pages/nobody/dom.html", None, "app/page.tsx", "home"),
        (None, "shots/pages/home/other.html", None, None, None),
        (None, "shots/pages/ho me/dom.html", None, None, "home"),
        (None, "HTTPS://x.example/", None, None, "home"),
        (None, "https://x.example/about", None, None, "home"),
        (None, "app/page.tsx", None, None, "aBOUT"),
        (None, "src/app/page.tsx", None, None, "nobody"),
        (None, "page.tsx", None, None, None),
        (None, "bundle.js", None, "/w/ui/nav.tsx", None),
        (None, "v.tsx", None, None, None),
        (None, None, None, None, None),
        (None, "", "", "", ""),
        ("home", "ui/nav.tsx", None, None, None),
        ("home", "app/about/page.tsx", None, None, None),
    ]
    assert attributed(spark, rows) == [
        ("elsewhere", "stamp", False),
        ("home", "snapshot", False),
        ("about", "snapshot", False),
        (None, None, False),
        (None, None, False),
        ("home", "sample", False),
        (None, None, False),
        ("again", "address", False),
        ("again", "sample", False),
        ("home", "source", False),
        ("home", "source", True),
        ("home", "source", True),
        (None, None, False),
        (None, None, False),
        (None, None, False),
        ("home", "stamp", True),
        ("home", "stamp", False),
    ]


def test_hot_places_and_empty_tables(spark, monkeypatch):
    from lintel.operators import skew

    rows = [(None, "ui/nav.tsx", None, None, None)] * 300 + [(None, f"app/{i}/page.tsx", None, None, None) for i in range(20)]
    monkeypatch.setattr(skew, "max", lambda a, b: 30, raising=False)
    got = attributed(spark, rows)
    assert got[:300] == [("home", "source", True)] * 300 and got[300:] == [(None, None, False)] * 20
    monkeypatch.undo()
    assert attributed(spark, []) == []
    assert attributed(spark, rows[-2:], []) == [(None, None, False)] * 2
    found = spark.createDataFrame([("a", None), ("b", "p")], "n string, page string")
    assert [r["n"] for r in attribution.unattributed(found).collect()] == ["a"]
