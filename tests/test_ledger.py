"""Stored citations in today's evidence, and tickets of five grains."""

from lintel.operators import ledger, verdicts

STORED = "at long, sc string, file string, line int, selector string, snippet string"


def test_reanchored(spark):
    stored = [
        (1, "c", "/old/src/a.html", 5, "p", "one"), (2, "c", "/old/src/a.html", 9, None, "two"), (3, "c", "/old/src/b.html", 4, None, "three"), (4, "c", "/old/src/b.html", 4, "x", "four"), (5, "c", "/old/src/gone.html", 1, None, None),
        (6, "d", "/old/src/a.html", 5, "p", "one"), (7, "c", "ci/shots/pages/p1/dom.html", 1, "a", "snap"), (8, None, None, None, None, None), (9, "c", "/old/src/a.html", 5, "p", "  one "),
    ]
    evidence = [(1, "c", "src/a.html", 4, "p", "one"), (2, "c", "src/a.html", 7, "p", "one\n"), (3, "c", "src/a.html", 9, "q", "other"), (4, "c", "src/b.html", 4, "y", "four"), (5, "c", "src/b.html", 4, "z", "four"), (6, "c", "src/b.html", 4, "w", "five"), (7, "c", "shots/pages/p1/dom.html", 30, "a", "snap")]
    files = spark.createDataFrame([("src/a.html",), ("src/b.html",), ("shots/pages/p1/dom.html",)], "file string")
    got = ledger.reanchored(spark.createDataFrame(stored, STORED), spark.createDataFrame(evidence, STORED.replace("at", "seq")), files, "shots/pages", root="/old/")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "src/a.html", 7, "exact"), (2, "src/a.html", 9, "place"), (3, "src/b.html", 4, "file"), (4, "src/b.html", 4, "text"), (5, "/old/src/gone.html", 1, "kept"),
        (6, "src/a.html", 5, "file"), (7, "shots/pages/p1/dom.html", 30, "exact"), (8, None, None, "kept"), (9, "src/a.html", 7, "exact"),
    ]
    none = spark.createDataFrame([], STORED.replace("at", "seq"))
    assert {r["how"] for r in ledger.reanchored(spark.createDataFrame(stored, STORED), none, files, "shots/pages", root="/old").collect()} == {"file", "kept"}


def test_ticket_plan(spark):
    rows = [("1.1.1", "home", "a", "mineur", True), ("1.1.1", "home", "b", "bloquant", False), ("1.3.1", None, "a", "majeur", True), ("1.3.1", "about", None, "mineur", True)]
    found = spark.createDataFrame(rows, "sc string, page string, file string, severity string, advisory boolean")
    got = {r["title"]: (r["occurrences"], r["severity"], r["advisory"]) for r in verdicts.ticket_plan(found).collect()}
    assert got == {
        "criterion 1.1.1": (2, "bloquant", False), "criterion 1.3.1": (2, "majeur", True), "page home": (2, "bloquant", False), "page about": (1, "mineur", True), "page-criterion home 1.1.1": (2, "bloquant", False),
        "page-criterion about 1.3.1": (1, "mineur", True), "file a": (2, "majeur", True), "file b": (1, "bloquant", False), "file": (1, "mineur", True), "single": (4, "bloquant", False),
    }
    assert verdicts.unattributed_count(found).first()[0] == 1
    assert verdicts.ticket_plan(found.limit(0)).count() == 0
