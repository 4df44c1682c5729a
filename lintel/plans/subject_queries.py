"""A query over all subjects of evidence: for every row of ``supplier`` and every subject a made page, whose evidence the SQL counts by arithmetic.

Each page also holds what just misses its subject.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.operators import harvest
from lintel.plans.registry import query
from lintel.plans.storage import materialize, table

_LINE = "<{0}>' || repeat('\n{1}', k % 3) || '</{0}>"
#: Subject -> (markup of the page of row k, how often the subject stands in it).
PAGES = {
    "images": ("repeat('<img src=a>', k % 3) || '<span role=img><svg></svg></span>'", "k % 3 + 1"),
    "links": ("repeat('<a href=x>l</a>', k % 4) || '<b role=link>m</b>'", "k % 4 + 1"),
    "colourPairs": ("repeat('<p style=\"color:red\">x</p>', k % 3) || '<p style=\"margin:0\">y</p>'", "k % 3"),
    "headings": ("repeat('<h3>a</h3>', k % 3) || '<p role=heading>b</p>'", "k % 3 + 1"),
    "controls": ("repeat('<input name=a>', k % 4) || '<p>input</p>'", "k % 4"),
    "buttons": ("repeat('<button>b</button>', k % 3) || '<p>c</p>'", "k % 3"),
    "autocomplete": ("repeat('<input autocomplete=tel>', k % 3) || '<select></select>'", "k % 3 + 1"),
    "errors": ("'<form>' || repeat('<p class=my-error>e</p>', k % 3) || '</form><p class=error>no</p>' || repeat('<input aria-invalid=true>', k % 2)", "k % 3 + k % 2"),
    "structure": ("repeat('<ul></ul>', k % 3) || '<h2>h</h2><p>p</p>'", "k % 3 + 1"),
    "tables": ("repeat('<table></table>', k % 3) || '<div role=grid></div><div role=row></div>'", "k % 3 + 1"),
    "lists": ("repeat('<ol><li>a</li></ol>', k % 4) || '<p>1. a</p>'", "k % 4"),
    "landmarks": ("repeat('<nav>n</nav>', k % 3) || '<a href=\"#x\">s</a><a href=y>t</a>'", "k % 3 + 1"),
    "navMechanisms": ("repeat('<nav>n</nav>', k % 3) || '<input name=recherche><a href=/sitemap>m</a><a href=index.html>i</a>'", "k % 3 + 2"),
    "repeatedBlocks": ("repeat('<footer>f</footer>', k % 3) || '<main>m</main>'", "k % 3"),
    "aria": ("repeat('<p aria-label=x>a</p>', k % 3) || '<p role=note>b</p><p title=x>c</p>'", "k % 3 + 1"),
    "liveRegions": ("repeat('<p role=status>s</p>', k % 3) || '<p class=toast>t</p><form class=message></form>'", "k % 3 + 1"),
    "focusOrder": ("repeat('<p tabindex=0>a</p>', k % 3) || '<dialog>d</dialog><a href=x>l</a>'", "k % 3 + 1"),
    "declaredLang": ("'<html lang=\"' || repeat('fr', k % 2) || '\"><body>x</body></html>'", "k % 2"),
    "docLang": ("repeat('<html><body>x</body></html>', k % 2) || '<p lang=fr>y</p>'", "k % 2"),
    "langParts": ("repeat('<p lang=de>das</p>', k % 3) || '<p>read more</p><p>lire</p>'", "k % 3 + 1"),
    "frames": ("repeat('<iframe src=f></iframe>', k % 3) || '<object data=f></object>'", "k % 3"),
    "docTitle": ("repeat('<title>t</title>', k % 2) || '<svg><title>s</title></svg>'", "k % 2"),
    "doctype": ("'<!DOCTYPE html>' || repeat('<p>x</p>', k % 3)", "CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END"),
    "nameVsAccName": ("repeat('<a aria-label=n>t</a>', k % 3) || '<a aria-label=n></a><a>u</a>'", "k % 3"),
    "pointerHandlers": ("repeat('<p onclick=x>a</p>', k % 3) || '<button onclick=y>b</button>'", "k % 3"),
    "externalScripts": ("repeat('<script src=s.js></script>', k % 3) || '<script>1</script>'", "k % 3"),
    "shortcuts": ("repeat('<a accesskey=a>x</a>', k % 3) || '<a>y</a>'", "k % 3"),
    "timers": (f"'{_LINE.format('script', 'setTimeout(f, 1)')}<p>setTimeout(g)</p>'", "k % 3"),
    "motion": ("repeat('<marquee>m</marquee>', k % 3) || '<img src=\"a.GIF?1\" alt=a><img src=gif alt=b>'", "k % 3 + 1"),
    "nonTemporalMedia": ("repeat('<canvas></canvas>', k % 3) || '<video></video>'", "k % 3"),
    "temporalMedia": ("repeat('<video></video>', k % 3) || '<canvas></canvas>'", "k % 3"),
    "presentationalMarkup": ("repeat('<center>c</center>', k % 3) || '<b>b</b>'", "k % 3"),
    "newWindow": ("repeat('<a target=_blank href=x>a</a>', k % 3) || '<a target=_self href=y>b</a>'", "k % 3"),
    "hiddenContent": ("repeat('<p hidden>h</p>', k % 3) || '<p class=\"a sr-only\">s</p><p aria-hidden=false>t</p>'", "k % 3 + 1"),
    "quotes": ("repeat('<q>q</q>', k % 3) || '<p>p</p>'", "k % 3"),
    "cryptic": ("repeat('<p>fine :-)</p>', k % 3) || '<pre>x</pre><p>fine: (x)</p>'", "k % 3 + 1"),
    "stylesheets": ("repeat('<link rel=stylesheet href=s>', k % 3) || '<style>p{}</style><link rel=icon href=i>'", "k % 3 + 1"),
    "zoom": ("repeat('<meta name=viewport content=x>', k % 2) || '<meta name=author content=y>'", "k % 2"),
    "downloadDocs": ("repeat('<a href=\"a.PDF#p\">d</a>', k % 3) || '<a href=a.html>e</a>'", "k % 3"),
    "tabOrder": ("repeat('<button>b</button>', k % 3) || '<a>x</a>'", "CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END"),
    "instructions": ("repeat('<p>this is required</p>', k % 3) || '<p>this is not</p>'", "k % 3"),
    "sensoryText": ("repeat('<p>click the green one</p>', k % 3) || '<p>the green one</p>'", "k % 3"),
    "stickies": ("repeat('<p style=\"position: fixed\">s</p>', k % 3) || '<p style=\"position: static\">t</p>'", "k % 3"),
    "focusables": ("repeat('<embed src=e>', k % 3) || '<p aria-modal=true>m</p><p aria-modal=false>n</p>'", "k % 3 + 1"),
    "pointerActions": ("repeat('<p onmousedown=x>a</p>', k % 3) || '<button>n</button><button>m</button>'", "k % 3 + 1"),
    "colourState": ("repeat('<p class=is-active>a</p>', k % 3) || '<p class=activeness>b</p><p aria-current=page>c</p>'", "k % 3 + 1"),
    "temporalMediaControls": ("repeat('<audio></audio>', k % 3) || '<object type=\"image/png\" data=a></object>'", "k % 3"),
    "flashes": ("repeat('<canvas></canvas>', k % 3) || '<script src=a></script><iframe></iframe>'", "k % 3 + 1"),
    "scriptAlternatives": ("repeat('<noscript>n</noscript>', k % 3) || '<script>1</script><canvas></canvas>'", "k % 3 + 1"),
    "contextChange": ("repeat('<script>1</script>', k % 3) || '<style>p{}</style>'", "k % 3"),
    "readingOrder": ("repeat('<p style=\"order: 2\">x</p>', k % 3) || '<p style=\"border: 2\">y</p>'", "k % 3"),
    "reflow": ("repeat('<pre>x</pre>', k % 3) || '<meta name=viewport content=w>'", "k % 3 + 1"),
    "textSpacing": (f"'{_LINE.format('style', 'p{line-height: 2}')}'", "k % 3"),
    "orientation": (f"'{_LINE.format('style', '@media (orientation: portrait) {}')}'", "k % 3"),
    "focusStyles": (f"'{_LINE.format('style', 'a:focus{x:y}')}'", "k % 3"),
    "markupValidity": ("repeat('<p id=a>x</p>', k % 4) || '<a href=x><button>b</button></a>'", "CASE WHEN k % 4 > 1 THEN 2 ELSE 1 END"),
    "nonTemporalMediaControls": (f"'{_LINE.format('script', 'c.getContext()')}'", "k % 3"),
    "additionalContent": ("repeat('<summary>s</summary>', k % 3) || '<p>t</p>'", "k % 3"),
    "siteMapPage": ("'<title>Sitemap</title>' || repeat('<a href=a>a</a>', k % 3) || '<a>b</a>'", "CASE WHEN k % 3 > 0 THEN k % 3 + 1 ELSE 0 END"),
    "colourDecls": (f"'{_LINE.format('style', 'p{color: red}')}'", "k % 3"),
}
_NAMES = list(PAGES)


@query(
    "WITH m AS (SELECT s_suppkey AS k FROM supplier), n AS (" + " UNION ALL ".join(f"SELECT '{name}' AS subject, k, CAST({n} AS BIGINT) AS n FROM m" for name, (_, n) in PAGES.items()) + ") "
    "SELECT subject, k, n AS occurrences FROM n WHERE n > 0"
)
def subjects_made(spark, sf_dir):
    """Every subject harvested at once, counted on the pages that are made for it."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(html).alias("html")) for i, (html, _) in enumerate(PAGES.values())]))
    pages = materialize(rows.select("k", made.alias("p")).select((F.col("k") * 100 + F.col("p.i")).alias("page_id"), "p.html"), "made-pages")
    subject = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.pmod("page_id", F.lit(100)).cast("int") + 1)
    return harvest.counts(pages).select(subject.alias("subject"), F.floor(F.col("page_id") / 100).alias("k"), F.col("counts")[subject].alias("occurrences")).where("occurrences > 0")
