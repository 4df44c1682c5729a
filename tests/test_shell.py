"""Pages whose content is injected at run time, and pages that only hold per cents: per cents on both sides of a tag, and around letters beyond ASCII, are no placeholder."""

import os

import duckdb
import pytest

from lintel.plans import catalog
from lintel.sources.html import Page
from tests.test_queries import plain

_BODIES = ["<h1>x%%</h1><p><b>Th%%% y</b></p>", "<h1>a % b</h1><p>%Paraó% c</p>", "<h1>x%</h1><p>De%</p>"]


@pytest.mark.parametrize("body", _BODIES)
def test_per_cents_are_no_shell(body):
    assert Page(0, f"<html><head><title>50%</title><style>p%</style></head><body>{body}</body></html>").shell == (False, False)


@pytest.mark.parametrize("body", ["%sveltekit.body%", "<p>x</p>\n%a.b_1%", "<div><b>5% of %name%</b></div>", "{{ a <b>c</b> }}", "<p>@RenderBody()</p>", '<div id="root"></div>'])
def test_placeholders_are_a_shell(body):
    assert Page(0, f"<html><head></head><body>{body}</body></html>").shell == (True, False)


def test_placeholder_in_the_head():
    assert Page(0, "<html><head><title>%app.title%</title></head><body></body></html>").shell == (False, True)


@pytest.fixture(scope="module")
def with_per_cents(sf_dir, tmp_path_factory):
    """The small tables, with pages that hold per cents among the others."""
    folder = tmp_path_factory.mktemp("per-cents")
    for name in os.listdir(sf_dir):
        if name != "pages.parquet":
            os.symlink(f"{sf_dir}/{name}", folder / name)
    extra = [(900000 + i, f'<!DOCTYPE html><html lang="{lang}"><head><title>T%</title></head><body><article>{body}</article></body></html>') for i, (lang, body) in enumerate((g, b) for g in ("en", "fr") for b in _BODIES)]
    rows = ", ".join(f"({i}, 'https://x.example/{i}', '{html}')" for i, html in extra)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT page_id, url, html FROM read_parquet('{sf_dir}/pages.parquet') UNION ALL SELECT CAST(page_id AS BIGINT), url, html FROM (VALUES {rows}) v(page_id, url, html)) TO '{folder}/pages.parquet' (FORMAT parquet)")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return str(folder), con


@pytest.mark.parametrize("name", ["rule_missing_main_landmark", "audit_baseline", "audit_sarif", "audit_severities", "audit_tickets", "audit_units", "audit_upsert_tallies", "audit_upserts"])
def test_query_over_per_cents(spark, with_per_cents, name):
    folder, con = with_per_cents
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = sorted((tuple(plain(v) for v in row) for row in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in row) for row in catalog.QUERIES[name](spark, folder).select(*columns).collect()), key=repr) == want
