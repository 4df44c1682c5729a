"""Files, scope, addresses, sinks and the stream, on small inputs with answers worked out by hand."""

import json
import os

from pyspark.sql import functions as F

from lintel.functions import urls
from lintel.operators import changes, graph, rules, sinks, verdicts
from lintel.sources import files
from lintel.sources.html import elements
from lintel.streaming.ingest import audit_stream


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scope(spark):
    paths = ["src/a.html", "src/__tests__/b.html", "src/c.test.tsx", "lib/d.css", "lib/deep/e.vue", "out/f.html"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    keep = lambda **k: [r[0] for r in rows.where(files.in_scope(F.col("path"), **k)).orderBy("path").collect()]
    assert keep() == ["lib/deep/e.vue", "out/f.html", "src/a.html"]
    assert keep(tests=True) == ["lib/deep/e.vue", "out/f.html", "src/__tests__/b.html", "src/a.html", "src/c.test.tsx"]
    assert keep(include=["lib/**"]) == ["lib/deep/e.vue"] and keep(exclude=["out/*"]) == ["lib/deep/e.vue", "src/a.html"]
    assert files.glob_pattern("a?/*.html") == "(?:^|/)a[^/]/[^/]*\\.html$"


def test_read_pages_and_tiers(spark, tmp_path):
    for name, body in (("pages/home.html", "<p>h</p>"), ("components/x.vue", "<b>x</b>"), ("tests/t.html", "no"), ("other.html", "<i>é</i>")):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(body)
    pages = files.read_pages(spark, str(tmp_path))
    got = {os.path.relpath(r["url"].replace("file:", ""), tmp_path): (r["html"], r["kind"]) for r in pages.collect()}
    assert got == {"pages/home.html": ("<p>h</p>", "html"), "components/x.vue": ("<b>x</b>", "sfc"), "other.html": ("<i>é</i>", "html")}
    tiers = {os.path.basename(r["url"]): r["tier"] for r in files.tiered(pages.unionByName(pages)).collect()}
    assert tiers == {"home.html": 0, "x.vue": 1, "other.html": 2}


def test_page_ids_are_unique(spark):
    slugs = ["a", "a", "a-2", "a-2", "a", "a-4", "b"]
    rows = spark.createDataFrame([(i, f"https://x.example/{s}") for i, s in enumerate(slugs)], "page_id long, url string")
    got = [r["id"] for r in urls.page_ids(rows).orderBy("page_id").collect()]
    assert got == ["a", "a-3", "a-2", "a-2-2", "a-5", "a-4", "b"]


def test_sitemap_and_absolute(spark):
    row = spark.createDataFrame([("<urlset><url><loc> https://a.example/x </loc></url><url><LOC>https://a.example/y</LOC></url></urlset>",)], "xml string")
    assert row.select(urls.sitemap_urls(F.col("xml"))).first()[0] == ["https://a.example/x", "https://a.example/y"]
    cases = [("/r", "https://h.example/r"), ("c/../d", "https://h.example/a/d"), ("?q", "https://h.example/a/b?q"), ("//z.example/1", "https://z.example/1"), ("mailto:x", "mailto:x")]
    got = spark.createDataFrame(cases, "href string, want string").select(urls.absolute(F.col("href"), F.lit("https://h.example/a/b")), "want").collect()
    assert all(a == b for a, b in got)


def test_crawl_bounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x")], "src string, dst string")
    start = spark.createDataFrame([("a", "a")], "root string, node string")
    assert pairs(graph.reach(start, edges, depth=1).select("node", "depth")) == [("a", 0), ("b", 1), ("x", 1)]
    assert pairs(graph.reach(start, edges, most=3).select("node")) == [("a",), ("b",), ("x",)]


def test_findings_that_another_file_settles(spark):
    pages = spark.createDataFrame([(1, '<html><body><button {...rest}></button><a href="#main">skip</a><input aria-labelledby="far near"></body></html>'), (2, "<html><body>x</body></html>")], "page_id long, html string")
    parsed = elements(pages)
    rows = [(1, 2, "button-empty-name", ""), (1, 3, "skip-link-target-missing", "main"), (1, 4, "aria-ref-missing-id", "aria-labelledby #far, #near"), (2, 0, "html-lang-missing", ""), (2, 1, "h1-missing", "")]
    found = spark.createDataFrame(rows, "page_id long, ord int, rule_id string, detail string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    given = spark.createDataFrame([(2,)], "page_id long")
    left = lambda known, lang: {r["rule_id"] for r in graph.cross_suppressed(found, parsed, known, lang).collect()}
    assert left(ids("main", "far", "near"), given) == {"h1-missing"}
    assert left(ids("far"), given.where("false")) == {"skip-link-target-missing", "aria-ref-missing-id", "html-lang-missing", "h1-missing"}


def test_outputs(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<html lang=en><head><title>t</title></head><body><img src=a><blink>x</blink><img src=b></body></html>")], "page_id long, html string")
    parsed = elements(pages)
    located = rules.located(rules.findings(parsed, ["blink-marquee", "img-alt-missing"]), parsed)
    results = sinks.sarif_results(located).orderBy("col").collect()
    assert [(r["rule_id"], r["rule_index"]) for r in results] == [("img-alt-missing", 0), ("blink-marquee", 1), ("img-alt-missing", 0)]
    sinks.write_findings(located, str(tmp_path / "out"), "json")
    lines = [json.loads(x) for folder, _, names in os.walk(tmp_path / "out") for n in names if n.endswith(".json") for x in open(os.path.join(folder, n))]
    assert len(lines) == 3
    marked = spark.createDataFrame([(0, "1.1.1", "NC"), (0, "1.10.1", "C"), (0, "1.2.1", "?")], "page_id long, sc string, status string")
    text = sinks.markdown_grid(verdicts.grid(marked, [0]), "Grid")
    assert text.splitlines()[2:] == ["| criterion | 0 |", "| --- | --- |", "| 1.1.1 | NC |", "| 1.2.1 | ? |", "| 1.10.1 | C |"]


def test_stream_writes_every_file_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    page = lambda i: spark.createDataFrame([(i, f"u{i}", "<img src=x>")], "page_id long, url string, html string")
    for i in (1, 2):
        page(i).write.mode("append").parquet(source)
        audit_stream(spark, source, sink, mark, ["img-alt-missing"]).awaitTermination()
    assert pairs(spark.read.parquet(sink).select("page_id", "rule_id")) == [(1, "img-alt-missing"), (2, "img-alt-missing")]


def test_distinct_sources_spread_copies(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}") for i in range(1, 60)] + [(None, "same  text"), (60, "same text")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"] for r in changes.distinct_sources(df, "text", "id").collect()}
    assert got == {None, 60, *range(3, 60, 3)}
    assert {r["id"] for r in changes.distinct_sources(df, "text", "id", squeeze=True).collect()} == {None, *range(3, 60, 3)}


def test_regression_keys(spark):
    rows = spark.createDataFrame([("div#:r1a: > a.btn-x9f3k2:nth-child(3)",), ("div#:r7: > a.btn-q8z1m4:nth-child(4)",)], "s string")
    assert rows.select(changes.regression_key(F.lit("r"), F.lit("1.1.1"), F.col("s"))).distinct().count() == 1


def test_components_text_and_changed_files(spark):
    rows = [(1, "/r/a.astro", "---\nconst x = '<img>';\n---\n<img alt=x>", "sfc"), (2, "/r/b.vue", "<template><p>b</p></template>", "sfc"), (3, "/r/c.tsx", "return <p/>", "jsx"), (4, "/r/d.html", "---\nno\n---", "html")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    got = {r["page_id"]: r["html"] for r in files.readable(pages).collect()}
    assert set(got) == {1, 2, 4} and got[4] == rows[3][2] and got[1].endswith("\n<img alt=x>") and "const" not in got[1]
    parsed = elements(files.readable(pages), ["tag", "line"]).where("page_id = 1").collect()
    assert [(r["tag"], r["line"]) for r in parsed] == [("img", 4)]
    assert [r["tag"] for r in elements(files.from_text(spark, "<i>x</i>"), ["tag"]).collect()] == ["i"]
    changed = spark.createDataFrame([("./a.astro",), ("d.html",), ("other/b.vue",)], "file string")
    assert {r["page_id"] for r in files.changed_only(pages, changed).collect()} == {1, 4}


def test_pdf_files(spark, tmp_path):
    for name, body in (("x/a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF-1"), ("c.pdf", b"%PDF-2"), ("d.txt", b"no")):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = sorted((os.path.basename(r["file"]), r["bytes"]) for r in files.pdf_files(spark, str(tmp_path)).collect())
    assert got == [("b.PDF", 6), ("c.pdf", 6)]


def test_more_outputs(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<img src=a id=x7f3k9><blink>x</blink>")], "page_id long, html string")
    parsed = elements(pages)
    located = rules.located(rules.findings(parsed, ["blink-marquee", "img-alt-missing"]), parsed)
    criteria = verdicts.criteria_dim(spark).limit(3)
    sinks.write_document(str(tmp_path / "doc"), criteria, located, pages)
    assert spark.read.json(str(tmp_path / "doc/findings")).count() == 2 and spark.read.json(str(tmp_path / "doc/criteria")).count() == 3
    counts = sinks.baseline_counts(located)
    assert pairs(counts.select("n")) == [(1,), (1,)]
    tickets = verdicts.tickets(located, "criterion")
    assert pairs(sinks.new_tickets(tickets, tickets.where("title like '%2.2.2%'")).select("title")) == [("criterion 1.1.1",)]
    assert [r["sc"] for r in sinks.backlog(verdicts.units(located)).collect()] == ["1.1.1", "2.2.2"]
    diff = changes.against_baseline(located, located.where("rule_id = 'blink-marquee'"))
    assert sinks.comment(located, diff).splitlines() == ["1 new, 0 fixed", "", "- bloquant `img-alt-missing` 1:1:1"]
    decided = spark.createDataFrame([("1.1.1", "C"), ("1.2.1", "manual")], "sc string, verdict string")
    evidence = spark.createDataFrame([("1.1.1", "b"), ("1.1.1", "a")], "sc string, key string")
    ledger = sinks.ledger_entries(decided, evidence)
    assert pairs(changes.replayed(ledger, evidence, decided.select("sc"))) == [("1.1.1", "fresh"), ("1.2.1", "missing")]
