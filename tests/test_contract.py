"""The verdict contract: citations and what was shown, grounding, presupposed neighbours, and every violation once."""

from dataclasses import replace

import pytest

from lintel.operators import contract

PLACE = "sc string, file string, line int, selector string, snippet string"
PAGE = "<main>\n<h1>Café menu</h1>\n<a href='/pricing'>Read more</a>\n<img src=\"/assets/help.svg\" alt=\"\" class=\"icon\">\n</main>" + "\n" * 40 + "<p id='Late'>ﬁnal words</p>"


@pytest.fixture()
def file(spark):
    def rows(columns, *data):
        return spark.createDataFrame(list(data), columns)

    return contract.VerdictFile(
        verdicts=rows("sc string, verdict string, justification string, decided_by string, auditor string, reason string"),
        open_criteria=rows("sc string, complete boolean"),
        citations=rows(PLACE),
        claims=rows(PLACE + ", ref string"),
        advice=rows(PLACE),
        evidence=rows("sc string, cls string, file string, line int, selector string, snippet string, note string"),
        siblings=rows("sc string, cls string, file string, line int"),
        sources=rows("file string, source string", ("a.html", PAGE), ("shots/pages/p1/dom.html", PAGE.replace("\n", " "))),
        tests=rows("ref string, sc string", ("1.1", "1.1"), ("1.1.2", "1.1"), ("2.1", "2.1")),
        folder="shots/pages",
    )


def found(file, drift=10):
    return sorted((r["sc"], r["violation"], r["place"] or "") for r in contract.violations(file, drift).collect())


def given(spark, file, verdicts, **tables):
    schemas = {"citations": file.citations, "claims": file.claims, "advice": file.advice, "evidence": file.evidence, "siblings": file.siblings, "open_criteria": file.open_criteria}
    made = {n: spark.createDataFrame(rows, schemas[n].schema) for n, rows in tables.items()}
    items = [(sc, v, "because", "agent", None, None) if isinstance(v, (str, type(None))) else (sc, *v) for sc, v in verdicts]
    made.setdefault("open_criteria", spark.createDataFrame(sorted({(sc, True) for sc, _ in verdicts}), file.open_criteria.schema))
    return replace(file, verdicts=spark.createDataFrame(items, file.verdicts.schema), **made)


LINK = ("1.1", "link", "a.html", 3, "a", "<a href='/pricing'>Read more</a>", None)


def test_verdicts_and_their_authors(spark, file):
    f = given(
        spark, file,
        [("a", None), ("b", "Perhaps"), ("c", (" na ", " ", None, None, None)), ("d", ("manual", None, "engine", None, "later")), ("e", ("manual", None, "human", " ", " UNDECIDABLE")), ("e2", ("manual", None, "human", "Ada", "undecidable")), ("f", "NC"), ("g", "C"), ("g", "C"), ("h", "C")],
        open_criteria=[(sc, sc != "g") for sc in ("a", "b", "c", "d", "e", "e2", "f", "g", "i", "j")],
    )
    f = replace(f, expected=spark.createDataFrame([("j",)], "sc string"), always=spark.createDataFrame([("c",), ("c",)], "sc string"))
    assert found(f) == sorted(
        [("a", "no-verdict", ""), ("b", "unknown-verdict", ""), ("c", "justification", ""), ("c", "always-applicable", ""), ("d", "decided-by", ""), ("d", "reason", ""), ("e", "auditor", ""), ("f", "no-finding", "")]
        + [("g", "duplicate", ""), ("g", "incomplete-evidence", ""), ("g", "no-evidence", ""), ("h", "not-open", ""), ("i", "missing", "")]
    )


def test_citations_meet_what_was_shown(spark, file):
    """One criterion per case: its citation, what it was shown, and what is held against it."""
    cite = lambda line, snippet, selector=None, path="a.html": (path, line, selector, snippet)
    there, link = [("link", "b.html", 7)], [LINK[1:]]
    cases = [
        ([], link, [], [("uncited", "")]),
        ([cite(3, "<a href='/pricing'>Read more</a>")], link, [], []),
        # Quoted as it is, or retyped but recognisable; another element at the same place is not.
        ([cite(3, '<a class="x" href="/pricing">Read more now</a>')], link, [], []),
        ([cite(3, "<a href='/invented'>Nowhere</a>")], link, [], [("ungrounded", "a.html:3")]),
        ([cite(3, "<img src='/pricing'>")], link, [], [("ungrounded", "a.html:3")]),
        # In an audited file a citation belongs, but must stand there as written.
        ([cite(40, '<a class="x" href="/pricing">Read more</a>')], link, [], [("ungrounded", "a.html:40")]),
        ([cite(40, "<h1>Café menu</h1>")], link, [], []),
        ([cite(900, "<h1>Café menu</h1>")], link, [], [("ungrounded", "a.html:900")]),
        # Outside both.
        ([cite(3, None, path="b.html")], link, [], [("outside-evidence", "b.html:3"), ("ungrounded", "b.html:3")]),
        # The other place of a class belongs and has no text of its own: its selector is looked for.
        ([cite(9, None, path="b.html")], link, there, [("ungrounded", "b.html:9")]),
        ([cite(30, None, path="b.html")], link, there, [("outside-evidence", "b.html:30"), ("ungrounded", "b.html:30")]),
        ([cite(6, "<a>retyped</a>")], [(*LINK[1:5], None, None)], [("link", "a.html", 6)], []),
    ]
    on = lambda i: [(f"c{n:02}", *r) for n, c in enumerate(cases) for r in c[i]]
    f = given(spark, file, [(f"c{n:02}", "C") for n in range(len(cases))], citations=on(0), evidence=on(1), siblings=on(2))
    assert found(f) == sorted(on(3))


def test_windows_of_lines(spark, file):
    for drift in (0, 1, 2, 10):
        for line in range(20, 45):
            anchors = [("s", "f", n) for n in range(0, 90)]
            places = spark.createDataFrame([("at", "s", "f", line)], "at string, sc string, path string, line int")
            if line in (20, 21, 33, 44):
                got = contract.near(places, spark.createDataFrame(anchors, "sc string, path string, a_line int"), drift, []).collect()
                assert sorted(r["a_line"] for r in got) == list(range(line - drift, line + drift + 1))


def test_snapshots_are_known_by_their_published_path(spark, file):
    shown = ("1.1", "x", "/ci/run/shots/pages/p1/dom.html", 1, "img", '<img src="/assets/help.svg">', None)
    f = given(spark, file, [("1.1", "C")], citations=[("1.1", "shots/pages/p1/dom.html", 1, None, "<img alt src='/assets/help.svg'>")], evidence=[shown])
    assert found(f) == [("1.1", "ungrounded", "shots/pages/p1/dom.html:1")]  # the anchor's own path is not an audited file here
    moved = ("1.1", "x", "shots/pages/p1/dom.html", 1, "img", '<img src="/assets/help.svg" alt="" class="icon">', None)
    f = given(spark, file, [("1.1", "C")], citations=[("1.1", "else/shots/pages/p1/dom.html", 80, "img", "<img retyped help.svg>")], evidence=[moved])
    assert found(f) == []  # same selector on the same snapshot, far from the line
    f = given(spark, file, [("1.1", ("manual", None, "agent", None, "needs-rendered-dom"))], evidence=[moved])
    assert found(f) == [("1.1", "already-rendered", "")]


def test_claims(spark, file):
    ok = ("1.1", "a.html", 3, "a", "Read more", "1.1.2")
    f = given(spark, file, [("1.1", "NC"), ("2.1", "NC")], evidence=[LINK], claims=[
        ok, (*ok[:5], None), (*ok[:5], "2.1"), (*ok[:5], "1.1.9"), ("1.1", " ", 3, None, None, "1.1"), ("1.1", "b.html", 3, None, None, "1.1"), ("2.1", "a.html", 45, "#Late", None, " 2.1 "), ("2.1", "a.html", 45, "#late", None, "2.1"),
    ], advice=[("2.1", None, 3, None, None), ("2.1", "a.html", 2, None, "invented words")])
    want = [("1.1", "claim-without-test", "a.html:3"), ("1.1", "foreign-test", "a.html:3"), ("1.1", "claim-without-file", ""), ("1.1", "outside-evidence", "b.html:3"), ("1.1", "ungrounded", "b.html:3")]
    want += [("2.1", "ungrounded", "a.html:45"), ("2.1", "advice-without-file", ""), ("2.1", "ungrounded", "a.html:2")]
    assert found(f) == sorted(want)
    assert ("1.1", "foreign-test", "a.html:3") in found(replace(f, own_tests=False)) and len(found(replace(f, own_tests=False))) == len(want)
    engine = spark.createDataFrame([("1.0", "a.html", 3, "a"), ("9.9", "a.html", 45, "#Late")], "sc string, file string, line int, selector string")
    ahead = spark.createDataFrame([("1.1", "1.0"), ("2.1", "2.0")], "sc string, presupposed string")
    assert set(found(replace(f, engine=engine, presupposed=ahead))) - set(want) == {("1.1", "presupposed", "a.html:3")}


def test_grounding(spark, file):
    rows = [
        ("found", "a.html", 2, None, "<h1>Cafe\u0301 menu</h1>"), ("found", "a.html", 2, None, " <h1> Café   menu </h1>"), ("found", "a.html", 45, None, "final words"), ("moved", "a.html", 2, None, "ﬁnal words"), ("no-snippet", "a.html", 2, "h1", "<h1>Other</h1>"),
        ("out-of-range", "a.html", 46, None, None), ("no-file", "b.html", 1, None, None), ("found", "", 1, None, "x"), ("found", None, 1, None, "x"), ("found", "https://x.example/", 1, None, "x"), ("found", "-", None, None, "x"),
        ("found", "a.html", 3, "nav > a[href]", None), ("found", "a.html", 4, "IMG.icon", " "), ("moved", "a.html", 2, "p", None), ("no-selector", "a.html", 2, "#late", None), ("moved", "a.html", 2, "#Late", None), ("found", "a.html", 2, "handler", None), ("found", "a.html", None, "#Late", None), ("found", "a.html", 0, None, "final words"),
    ]
    places = spark.createDataFrame([(f"{i}", *r[1:]) for i, r in enumerate(rows)], "at string, file string, line int, selector string, snippet string")
    got = {int(r["at"]): r["state"] for r in contract.ground(places, file.sources).collect()}
    assert [got[i] for i in range(len(rows))] == [r[0] for r in rows]


def test_presupposed_neighbours(spark):
    rows = [
        ("11.1", "forms", ["1.3.1", "3.3.2"], True), ("11.2", "forms", ["1.3.1", "3.3.2", "2.4.6"], False), ("11.5", "forms", ["1.3.1"], True), ("11.4", "forms", ["1.3.1"], False),
        ("8.5", "page", ["2.4.2"], True), ("8.6", "page", ["2.4.2"], False), ("9.9", "other", ["2.4.2"], False), ("9.8", "other", None, True),
    ]
    got = contract.presupposed(spark.createDataFrame(rows, "sc string, theme string, wcag array<string>, mechanical boolean"))
    assert sorted(tuple(r) for r in got.collect()) == [("11.2", "11.1"), ("8.6", "8.5")]


def test_citations_as_text_and_empty_tables(spark, file):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a/b.html:12",), ("C:\\x.html:3",), ("no line",), (":4",), ("x:",), (None,)], "t string")
    parts = contract.read_citation(F.col("t"))
    assert [tuple(r) for r in rows.select(*parts).collect()] == [("a/b.html", 12), ("C:\\x.html", 3), (None, None), (None, None), (None, None), (None, None)]
    assert found(file) == []


def test_many_citations_of_one_line(spark, file):
    """All evidence and all citations on one line of one page: every citation is judged once."""
    shown = [("1.1", f"c{i}", "a.html", 3, "a", f"<a href='/p{i}'>Link {i}</a>", None) for i in range(60)]
    cites = [("1.1", "a.html", 3, None, f"<a class='y' href='/p{i}'>") for i in range(50)] + [("1.1", "a.html", 3, None, "<a href='/invented'>")] * 20
    f = given(spark, file, [("1.1", "C")], citations=cites, evidence=shown)
    f = replace(f, sources=spark.createDataFrame([("a.html", "\n\n" + "".join(s[5] for s in shown))], "file string, source string"))
    assert found(f) == [("1.1", "ungrounded", "a.html:3")]
