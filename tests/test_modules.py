"""Imports of source files: what statements say, how paths resolve, and which file a specifier stands for."""

from pyspark.sql import functions as F

from lintel.sources import modules


def said(spark, file, source):
    rows = modules.statements(spark.createDataFrame([(file, source)], "file string, source string"))
    return sorted((r["kind"], r["target"]) for r in rows.collect())


def test_statements(spark):
    source = """
    import def from './a'; import * as ns from "./b"
    import { x, type Y } from './c'
    import type Z from './gone'
    import { type A, type B } from './gone'
    import {} from './gone'
    import './side.css'
    export { p as q } from './d'; export * from './e'; export * as all from './f'
    export type { T } from './gone'; export { type U } from './gone'
    const l = import('./g'), r = require( "./h" ), t = import(`./i`), dyn = import(`./${x}`)
    // import no from './gone'
    /* import no from './gone' */
    import Default, {
      many,
    } from './j'
    """
    got = said(spark, "x.ts", source)
    assert got == sorted(
        [("import", f"./{x}") for x in "abcj"] + [("side-effect", "./side.css")] + [("export", f"./{x}") for x in "def"] + [("dynamic", f"./{x}") for x in "ghi"] + [("dynamic", "./${x}")]
    )
    assert said(spark, "x.scss", "@use 'a'; @import url('b.css'); @forward \"c\"; /* @use 'no' */") == [("style", "a"), ("style", "b.css"), ("style", "c")]
    assert said(spark, "p.html", "<script src='a.js'></script><!-- <img src=no> <a href='no'> --><LINK rel=x href=\"b.css\"><a id=t href='c'>") == [("resource", "a.js"), ("resource", "b.css"), ("resource", "c")]
    assert said(spark, "x.ts", None) == [] and said(spark, "x.ts", "") == []


def test_paths(spark):
    paths = {"a/./b/../c": "a/c", "/a//b/": "a/b", "../a": "../a", "a/../../b": "../b", "": "", "a\\b": "a/b", "..": "..", "a/..": ""}
    rows = spark.createDataFrame([(k,) for k in paths], "p string").select("p", modules.plain_path(F.col("p")).alias("q")).collect()
    assert {r["p"]: r["q"] for r in rows} == paths


def test_resolution(spark, monkeypatch):
    from lintel.operators import skew

    files = ["src/a.ts", "src/a.js", "src/b/index.tsx", "src/c.vue", "src/d", "lib/e.js", "src/styles/_base.scss", "src/styles/base.css", "src/styles/theme/_index.scss", "index.html", "docs/x.html"]
    asks = [
        ("src/m.ts", "./a", "src/a.ts"), ("src/m.ts", "./a.js", "src/a.js"), ("src/m.ts", "./b", "src/b/index.tsx"), ("src/b/m.ts", "../c", "src/c.vue"), ("src/m.ts", "./d", "src/d"), ("src/m.ts", "@/a?url", "src/a.ts"), ("src/m.ts", "@lib/e", "lib/e.js"),
        ("src/m.ts", "/lib/e", "lib/e.js"), ("src/m.ts", "react", None), ("src/m.ts", "node:fs", None), ("src/m.ts", "https://x.example/a", None), ("src/m.ts", "../../out", None), ("src/m.ts", "./none", None), ("src/m.ts", "#x", None),
        ("src/styles/m.scss", "base", "src/styles/_base.scss"), ("src/styles/m.scss", "./theme", "src/styles/theme/_index.scss"), ("src/styles/m.scss", "~pkg/x", None), ("docs/m.html", "../index.html#top", "index.html"), ("docs/m.html", "x.html?q", "docs/x.html"),
    ]
    kind = lambda f: "style" if f.endswith("scss") else "resource" if f.endswith("html") else "import"
    statements = spark.createDataFrame([(f, kind(f), t) for f, t, _ in asks] + [(f"src/hot{i}.ts", "import", "./a") for i in range(60)], "file string, kind string, target string")
    known = spark.createDataFrame([(f,) for f in [*files, files[0]]], "file string")
    monkeypatch.setattr(skew, "max", lambda a, b: 20, raising=False)
    got = {(r["file"], r["target"]): r["dst"] for r in modules.resolved(statements, known, {"@/": "src/", "@lib/": "lib/"}).collect()}
    assert len(got) == len(asks) + 60 and {got[f"src/hot{i}.ts", "./a"] for i in range(60)} == {"src/a.ts"}
    assert [got[f, t] for f, t, _ in asks] == [d for _, _, d in asks]


def test_edges_feed_the_closure(spark):
    from lintel.operators.graph import reach

    sources = {"a.ts": "import './b'; import './b'; import './a'", "b.ts": "export * from './c'", "c.ts": "", "d.ts": "import './a'", "e.ts": None}
    files = spark.createDataFrame(list(sources.items()), "file string, source string")
    links = modules.edges(files)
    assert sorted(tuple(r) for r in links.collect()) == [("a.ts", "a.ts"), ("a.ts", "b.ts"), ("b.ts", "c.ts"), ("d.ts", "a.ts")]
    seeds = spark.createDataFrame([("d", "d.ts")], "root string, node string")
    assert sorted(r["node"] for r in reach(seeds, links).collect()) == ["a.ts", "b.ts", "c.ts", "d.ts"]
    assert modules.edges(files.limit(0)).count() == 0
