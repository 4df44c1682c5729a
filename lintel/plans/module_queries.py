"""Named queries of module resolution: a project made from the rows of ``part``, whose imports the SQL knows by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import graph
from lintel.plans.registry import query
from lintel.plans.storage import materialize, table
from lintel.sources import modules

_ALIASES = {"@/": "src/"}
_PATH = "'src/d' || {k} % 7 || '/m' || {k} || CASE {k} % 4 WHEN 0 THEN '/index.tsx' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' ELSE '.vue' END"
#: Row k imports rows k / 8, k / 27 and, in every fifth row, k / 5.
_EDGES = (
    "p AS (SELECT p_partkey AS k FROM part), t AS (SELECT k, k // 8 AS j FROM p UNION SELECT k, k // 27 FROM p UNION SELECT k, k // 5 FROM p WHERE k % 5 = 0), "
    f"e AS (SELECT DISTINCT t.k, t.j, {_PATH.format(k='t.k')} AS src, {_PATH.format(k='t.j')} AS dst FROM t JOIN p ON p.k = t.j)"
)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _stem(k: Column) -> Column:
    return _text("d", k % 7, "/m", k)


def _path(k: Column) -> Column:
    return _text("src/", _stem(k), F.when(k % 4 == 0, "/index.tsx").when(k % 4 == 1, ".ts").when(k % 4 == 2, ".js").otherwise(".vue"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    first, second, third = F.floor(k / 8), F.floor(k / 27), F.floor(k / 5)
    up = F.when(k % 4 == 0, "../../").otherwise("../")
    source = _text(
        "/* import old from '../d1/m1' */\n// import older from '../d2/m2'\nimport React, { useState } from 'react';\nimport type { T } from '", up, "d3/m3';\nimport { type U, type V } from '", up, "d4/m4';\nimport {} from '", up, "d5/m5';\n",
        "import a, {\n  b as c,\n} from '", up, "./x/../", _stem(first), "';\nconst lazy = () => import(`@/", _stem(second), "?raw`);\nexport type { W } from '", up, "d6/m6';\nimport 'node:fs';\n",
        F.when(k % 5 == 0, _text('export * from "', up, _stem(third), F.when(third % 4 == 1, ".ts").otherwise(""), '";\n')).otherwise(""),
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), _path(k).alias("file"), source.alias("source"))


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def modules_edges(spark, sf_dir):
    """Edges between the files of the project."""
    return modules.edges(_files(spark, sf_dir), _ALIASES)


@query(
    f"WITH RECURSIVE {_EDGES}, r AS (SELECT k AS root, k AS node FROM p WHERE k % 10 = 1 UNION SELECT r.root, e.j FROM r JOIN e ON e.k = r.node), "
    f"h AS (SELECT root, {_PATH.format(k='node')} AS file FROM r WHERE node % 9 = 4) SELECT 'page' || root AS page, min(file) AS reason FROM h GROUP BY root"
)
def modules_affected(spark, sf_dir):
    """Pages, one for every tenth file, that render a file that changed, every ninth; through all imports."""
    files = materialize(_files(spark, sf_dir), "files")
    links = materialize(modules.edges(files, _ALIASES), "edges")
    pages = files.where("k % 10 = 1").select(_text("page", F.col("k")).alias("page"), F.col("file").alias("source"))
    return graph.affected_pages(pages, links, files.where("k % 9 = 4").select("file"), [])


@query(
    "WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS file FROM pages), "
    "l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"#?]+)', 1)) AS t FROM pages WHERE html NOT LIKE '%<!--%<a %-->%') "
    "SELECT page_id, count(DISTINCT t) AS targets FROM l GROUP BY page_id"
)
def modules_resources(spark, sf_dir):
    """How many resources each page names."""
    pages = table(spark, sf_dir, "pages").where("html NOT LIKE '%<!--%<a %-->%'")
    said = modules.statements(pages.select(_text("p", F.col("page_id"), ".html").alias("file"), F.col("html").alias("source")))
    target = F.regexp_extract("target", "^([^#?]*)", 1)
    rows = said.select(F.regexp_extract("file", "([0-9]+)", 1).cast("long").alias("page_id"), target.alias("t")).where("t <> ''")
    return rows.groupBy("page_id").agg(F.count_distinct("t").alias("targets"))
