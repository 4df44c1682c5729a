"""Containment by blocks against plain walks over random trees, and rules that use it on nested markup."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel.operators import tree
from lintel.operators.rules import findings, needed
from lintel.sources.html import elements

NODES = "page_id long, ord int, last_ord int, kind string"


def random_tree(rnd, n, page):
    """(page, ord, last, kind) of n places; each stands in a random open one."""
    parents, rows = [], []
    for i in range(n):
        at = i - 1
        while at >= 0 and rnd.random() < 0.45:
            at = parents[at]
        parents.append(at)
    last = list(range(n))
    for i in range(n - 1, -1, -1):
        if parents[i] >= 0:
            last[parents[i]] = max(last[parents[i]], last[i])
    for i in range(n):
        rows.append((page, i, last[i], rnd.choice("abc")))
    return rows


@pytest.fixture(scope="module")
def nodes(spark):
    rnd = random.Random(11)
    rows = [r for page, n in enumerate([1, 2, 9, 64, 65, 300, 520]) for r in random_tree(rnd, n, page)]
    return rows, spark.createDataFrame(rows, NODES)


def test_covers_hold_each_place_once(spark):
    spans = [(0, -1), (5, 4), (0, 0), (0, 7), (1, 8), (3, 70), (64, 127), (63, 600), (0, 4095), (1, 5000), (2_097_000, 2_097_300), (16_777_210, 16_777_230)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", tree.cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        places = [x for b in r["c"] for x in range(b["block"] << (3 * b["level"]), (b["block"] + 1) << (3 * b["level"]))]
        assert places == sorted(set(places)) or len(places) == len(set(places))
        assert sorted(places) == list(range(r["a"], r["b"] + 1))
        assert len(r["c"]) <= 14 * 7


def test_nearest_counts_and_pairs(nodes):
    rows, df = nodes
    outer, inner = [r for r in rows if r[3] == "a"], [r for r in rows if r[3] != "c"]
    o, i = df.where("kind = 'a'"), df.where("kind <> 'c'")
    pairs = [(p, a, b, kind) for p, a, last, _ in outer for q, b, _, kind in inner if p == q and a < b <= last]
    assert sorted(tuple(r) for r in tree.pairs_below(o, i, inner_keep=["kind"]).select("page_id", "o_ord", "i_ord", "kind").collect()) == sorted(pairs)
    nearest = {}
    for p, a, b, _ in pairs:
        nearest[p, b] = max(a, nearest.get((p, b), -1))
    got = tree.nearest_above(i, o, ["kind"]).collect()
    assert {(r["page_id"], r["ord"]): r["o_ord"] for r in got} == nearest and len(got) == len(nearest) and {r["kind"] for r in got} == {"a"}
    counts = Counter((p, a, kind) for p, a, _, kind in pairs)
    assert {(r["page_id"], r["ord"], r["kind"]): r["n"] for r in tree.count_below(o, i, ["kind"]).collect()} == dict(counts)
    none = df.limit(0)
    assert tree.nearest_above(i, none).count() == tree.count_below(none, i).count() == tree.pairs_below(o, none).count() == 0


def test_one_large_page_is_many_keys(spark):
    """A page of 40,000 places: no key holds more than the blocks of one size, and pairs are not made to count."""
    n = 40_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") % 100 == 0, F.least(F.col("id") + 99, F.lit(n - 1))).otherwise(F.col("id")).cast("int").alias("last_ord"))
    outer = rows.where("last_ord > ord")
    assert [tuple(r) for r in tree.count_below(outer, rows).groupBy("n").count().collect()] == [(99, n // 100)]
    keys = tree._placed(rows).groupBy("page_id", "level", "block").count().where("level <= 3")
    assert keys.count() > 5000 and keys.agg(F.max("count")).first()[0] == 512


def test_owners_and_what_they_own(spark):
    """aria-owns, wrappers, references through wrappers, and undecided children."""
    cases = {
        "<div role=tablist aria-owns=x></div><p id=x role=tab>t</p>": [],
        "<div role=tablist aria-owns=x></div><p id=x role=button>t</p>": ["tablist button"],
        "<div role=tablist aria-owns='x gone'></div><p id=x role=button>t</p>": [],
        "<div role=tablist aria-owns='{x}'></div>": [],
        "<div role=tablist aria-owns=x></div><span id=x><i><b role=button>t</b></i></span>": ["tablist button"],
        "<main><div role=tablist aria-owns=x></div><span id=x><i><b role=tab>t<em role=button>u</em></b></i></span></main>": [],
        "<div role=menu><i role=menuitem>a</i><div><b role=link>l</b></div><u role=button>b</u></div>": ["menu link"],
        "<div role=menu><i role=menuitem>a</i><div aria-label=x><b role=link>l</b></div></div>": [],
        "<div role=menu><i role=menuitem>a</i><template><b role=link>l</b></template><b role=link hidden>m</b></div>": [],
        "<div role=table><div role=rowgroup><div role=row><b role=cell>x</b></div></div><h2>t</h2></div>": ["table heading"],
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {}
    for r in findings(elements(pages), ["aria-required-children"]).collect():
        if r["msg_id"].endswith("forbidden-child"):
            got.setdefault(r["page_id"], []).append(r["detail"])
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_frames_read_few_columns(spark):
    columns, facts = needed(spark, ["aria-required-parent", "th-no-data-cells"])
    assert not {"anc_tags", "name", "label_via", "desc_title"} & set(columns) and {"attrs", "last_ord", "parent_ord"} <= set(columns)
    pages = spark.createDataFrame([(1, "<div role=tab>t</div><table><tr><th>a</th><th>b</th></tr><tr><td>c</td></tr></table>")], "page_id long, html string")
    slim = findings(elements(pages, columns), ["aria-required-parent", "th-no-data-cells"])
    whole = findings(elements(pages), ["aria-required-parent", "th-no-data-cells"])
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 2


def test_firsts_flags_and_as_of_matches(nodes):
    rows, df = nodes
    outer, inner = [r for r in rows if r[3] == "a"], [r for r in rows if r[3] != "c"]
    below = {(p, a): [b for q, b, _, _ in inner if p == q and a < b <= last] for p, a, last, _ in outer}
    got = tree.first_below(df.where("kind = 'a'"), df.where("kind <> 'c'"), 3, F.concat("kind", F.col("ord").cast("string"))).collect()
    kinds = {(p, a): kind for p, a, _, kind in rows}
    assert {(r["page_id"], r["ord"]): (r["n"], [(x["ord"], x["value"]) for x in r["first"]]) for r in got} == {(p, a): (len(b), [(x, f"{kinds[p, x]}{x}") for x in b[:3]]) for (p, a), b in below.items() if b}
    flagged = df.where("kind <> 'c'").withColumn("flags", F.when(F.col("kind") == "a", 1).otherwise(2))
    want = {(p, b): (1 if any(x[3] == "a" for x in over) else 0) | (2 if any(x[3] == "b" for x in over) else 0) for p, b, _, _ in rows if (over := [x for x in inner if x[0] == p and x[1] < b <= x[2]])}
    assert {(r["page_id"], r["ord"]): r["flags"] for r in tree.flags_above(df.select("page_id", "ord"), flagged).collect()} == want
    spread = df.withColumn("ord", F.col("ord") * 97)  # over many runs
    want = {(p, b * 97): max([a * 97 for q, a, _, kind in rows if q == p and kind == "a" and a < b], default=None) for p, b, _, _ in rows}
    got = tree.last_before(spread.select("page_id", "ord"), spread.where("kind = 'a'"), F.col("ord")).collect()
    assert len(got) == len(rows) and {(r["page_id"], r["ord"]): r["value"] for r in got} == want
