"""Queries and operators do the whole job, not a part of it."""

from lintel.operators import harvest
from lintel.plans import catalog
from lintel.plans.storage import table
from lintel.sources.html import elements


def test_grid_has_every_page(spark, sf_dir):
    got = catalog.QUERIES["audit_grid_pages"](spark, sf_dir)
    pages = {r[0] for r in table(spark, sf_dir, "pages").select("page_id").collect()}
    cells = [(r["page_id"], r["sc"]) for r in got.collect()]
    assert len(pages) > 3 and {p for p, _ in cells} == pages
    assert len(cells) == len(set(cells)) == len(pages) * len({sc for _, sc in cells})


PAGE = """<!DOCTYPE html><html lang="fr"><head><style>
p:focus { outline: none; line-height: 2 }
@media (orientation: portrait) { p { width: 900px } }
</style></head><body><p>setTimeout( in prose</p><p id="a" style="order: 2">Please read</p><p id="a">un</p>
<iframe src="f.html"></iframe><a href="#"><button class="tab--active">x</button></a><i onclick="go()">y</i>
<video src="v.mp4"></video><noscript>none</noscript><b class="toast">z</b><pre>t</pre>
<script>
setTimeout(f, 1)
e.preventDefault(); e.textContent = 1; window.open(u)
v.play(); c.getContext()
if (e.key === "k") location.href = u
</script></body></html>"""
WANT = {
    ("focusStyles", "focusrule|p:focus { outline: none; line-height: 2 }"), ("textSpacing", "spacingdecl|p:focus { outline: none; line-height: 2 }"), ("additionalContent", "cssstate|p:focus { outline: none; line-height: 2 }"),
    ("orientation", "orientation|@media (orientation: portrait) { p { width: 900px } }"), ("reflow", "reflowdecl|@media (orientation: portrait) { p { width: 900px } }"), ("reflow", "reflowblock|pre|t"),
    ("langParts", "foreign|Please read"), ("readingOrder", "orderinline|order: 2"), ("markupValidity", "dupid|a"), ("markupValidity", "nesting|button"), ("focusables", "embed|iframe|f.html"),
    ("focusables", "preventDefault|e.preventDefault(); e.textContent = 1; window.open(u)"), ("liveRegions", "statuswrite|e.preventDefault(); e.textContent = 1; window.open(u)"), ("liveRegions", "statusclass|toast|"),
    ("contextChange", "open|e.preventDefault(); e.textContent = 1; window.open(u)"), ("newWindow", "open|e.preventDefault(); e.textContent = 1; window.open(u)"), ("contextChange", "script|inline"),
    ("colourState", 'colourstate|button|class "tab--active"|x'), ("pointerActions", "pointer|i|onclick|y"), ("pointerActions", "pointer|native|button"), ("temporalMediaControls", "temporal-media|video|v.mp4|controls=false"),
    ("temporalMediaControls", "temporal-control|v.play(); c.getContext()"), ("nonTemporalMediaControls", "non-temporal-control|v.play(); c.getContext()"), ("flashes", "flash-media|video|v.mp4"),
    ("scriptAlternatives", "noscript|none"), ("shortcuts", 'shortcut|if (e.key === "k") location.href = u'), ("contextChange", 'navigate|if (e.key === "k") location.href = u'), ("timers", "timer|setTimeout(f, 1)"),
}


def test_harvest_reads_scripts_and_styles(spark):
    pages = spark.createDataFrame([(-1, PAGE), (-2, None)], "page_id long, html string")
    got = harvest.harvest(elements(pages), pages=pages).collect()
    found = {(r["subject"], r["cls"]) for r in got}
    assert WANT <= found, WANT - found
    assert [c for s, c in found if s == "timers"] == ["timer|setTimeout(f, 1)"]
    assert [c for s, c in found if c.startswith("foreign")] == ["foreign|Please read"]
    assert {r["page_id"] for r in got} == {-1}
