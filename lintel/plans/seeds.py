"""Seed pages: for every rule at least one defect with what it must report, and a clean twin.

Each entry is (markup, expected), expected being a list of (criterion, severity, advisory,
variant, count); an empty list is a clean twin. They back the rule queries, whose oracles are
these expectations, because the generated pages hold few of the constructs.
"""

from __future__ import annotations

HEAD = '<!doctype html><html lang="en"><head><title>t</title></head><body><main><h1>h</h1>'
TAIL = "</main></body></html>"


def page(body: str, lang: str = ' lang="en"', head: str = "<title>t</title>", main: bool = True) -> str:
    inner = f"<main><h1>h</h1>{body}</main>" if main else body
    return f"<!doctype html><html{lang}><head>{head}</head><body>{inner}</body></html>"


B, M, m = "bloquant", "majeur", "mineur"
_TABLE = "<table><caption>c</caption><tr>{0}</tr><tr>{1}</tr></table>"

SEEDS: dict[str, list[tuple[str, list[tuple[str, str, bool, str, int]]]]] = {
    "img-alt-missing": [
        ('<img src="a.png">', [("1.1.1", B, False, "", 1)]),
        ('<img src="a.png" title="t"><img alt="  "><svg role="img"><text>x</text></svg>', [("1.1.1", m, True, "title-only", 1), ("1.1.1", B, False, "", 2)]),
        ('<img alt=""><img alt="x"><img :alt="y"><img aria-label="z"><img {...p}><div hidden><img></div><svg role="img"><title>t</title></svg><div role="img">text</div>', []),
    ],
    "decorative-alt-misuse": [
        ('<img alt="" title="t"><img alt="x" role="presentation">', [("1.1.1", M, False, "empty-but-named", 1), ("1.1.1", M, False, "role-but-alt", 1)]),
        ('<img alt=""><img alt="x"><img role="none" alt="">', []),
    ],
    "canvas-fallback-missing": [("<canvas></canvas>", [("1.1.1", M, False, "", 1)]), ('<canvas>text</canvas><canvas aria-hidden="true"></canvas><canvas aria-label="c"></canvas>', [])],
    "input-image-alt-missing": [('<input type="image" src="a">', [("1.1.1", B, False, "", 1)]), ('<input type="image" alt="go"><input type="IMAGE" title="go"><input type="image" hidden>', [])],
    "object-embed-no-name": [("<object data='a'></object><embed src='b'>", [("1.1.1", M, False, "", 2)]), ('<object title="t"></object><object>fallback</object><embed aria-label="x">', [])],
    "chart-no-accessible-name": [
        ('<svg class="recharts-surface"></svg><div class="bar chart"><svg class="chart"></svg></div>', [("1.1.1", M, False, "", 2)]),
        ('<svg class="typography-graphics"></svg><figure><svg class="chart"></svg><figcaption>c</figcaption></figure><svg class="chart"><title>t</title></svg>', []),
    ],
    "figure-caption-unassociated": [
        ('<figure><img alt="a"><figcaption>Cap</figcaption></figure><figure role="group" aria-label="Other"><img alt=""><figcaption>Cap</figcaption></figure>', [("1.1.1", M, True, "", 2)]),
        ('<figure role="figure" aria-label="Cap"><img alt="a"><figcaption> Cap </figcaption></figure><figure><figcaption>no image</figcaption></figure>', []),
    ],
    "iframe-title-missing": [('<iframe src="a"></iframe>', [("4.1.2", B, False, "", 1)]), ('<iframe title="t"></iframe><iframe aria-label="x"></iframe><iframe aria-hidden="true"></iframe>', [])],
    "invalid-aria-role": [('<div role="foo bar"></div>', [("4.1.2", M, False, "", 1)]), ('<div role="foo button"></div><div role="TAB"></div><div role="{x}"></div>', [])],
    "aria-ref-missing-id": [
        ('<p aria-labelledby="a b" id="c"></p><i aria-describedby="zz" aria-controls="c d"></i>', [("4.1.2", B, False, "", 3)]),
        ('<p id="a"></p><p aria-labelledby="a"></p><p aria-owns="{x}"></p>', []),
    ],
    "redundant-aria": [('<button role="button">b</button><a href="#" role="link">l</a>', [("4.1.2", m, False, "", 2)]), ('<a role="link">l</a><ul role="tree"></ul>', [])],
    "clickable-noninteractive": [
        ('<div onclick="x()">a</div><span onclick="x()" tabindex="0">b</span>', [("2.1.1", M, False, "", 1), ("4.1.2", M, False, "", 1)]),
        ('<div role="button" tabindex="0" onclick="x()">a</div><p onclick="y()">p</p>', []),
    ],
    "aria-required-children": [
        ('<div role="list"><p>x</p></div><div role="tablist"><div role="tab">t</div><button>b</button></div>', [("4.1.2", M, False, "", 1), ("4.1.2", M, False, "forbidden-child", 1)]),
        ('<div role="list"><div><div role="listitem">x</div></div></div><div role="list" aria-busy="true"></div><div role="menu"><div role="group"><i role="menuitem">a</i></div></div>', []),
    ],
    "aria-hidden-focusable": [('<div aria-hidden="true"><a href="#">x</a></div><button aria-hidden="true">b</button>', [("4.1.2", M, False, "", 2)]), ('<div aria-hidden="true"><a href="#" tabindex="-1">x</a><b hidden><a href="#">y</a></b></div>', [])],
    "presentational-children-focusable": [('<button>x<a href="#">y</a></button><div role="img"><input></div>', [("4.1.2", M, False, "", 2)]), ('<button>x<span>y</span></button><div role="tab"><a>z</a></div>', [])],
    "decorative-marked-exposed": [('<img alt="" tabindex="0"><div role="none" aria-label="x"></div>', [("1.1.1", M, False, "", 1), ("4.1.2", M, False, "", 1)]), ('<img alt=""><div role="presentation"></div>', [])],
    "menuitem-empty-name": [('<div role="menuitem"></div>', [("4.1.2", B, False, "", 1)]), ('<div role="menuitem">x</div><div role="menuitem" :aria-labelledby="y"></div>', [])],
    "nested-interactive": [('<button><input></button><div role="link"><a href="#">x</a></div>', [("4.1.2", M, False, "", 2)]), ("<div><button>x</button><a>y</a></div>", [])],
    "live-region-conflict": [
        ('<p aria-live="loud"></p><p role="alert" aria-live="polite"></p><p role="status" aria-live="off"></p>', [("4.1.3", M, False, "invalid-value", 1), ("4.1.3", M, False, "mismatch", 1), ("4.1.3", m, False, "mismatch", 1)]),
        ('<p role="alert" aria-live="assertive"></p><p aria-live="{x}"></p><p role="timer" aria-live="polite"></p>', []),
    ],
    "status-message-not-assertive": [('<p aria-live="polite" class="form-error"></p>', [("4.1.3", m, False, "", 1)]), ('<p aria-live="polite" class="note"></p><p aria-live="polite" role="status" class="error"></p>', [])],
    "invalid-aria-attr": [('<p aria-foo="1" aria-labeledby="x"></p>', [("4.1.2", M, False, "", 2)]), ('<p aria-label="x" aria-foo="{y}"></p>', [])],
    "invalid-aria-value": [
        ('<p aria-hidden="yes" aria-level="two"></p><p aria-relevant="text foo"></p><p role="scrollbar" aria-controls="gone" aria-valuenow="1"></p>', [("4.1.2", M, False, "", 3), ("4.1.2", M, False, "dangling-required", 1)]),
        ('<p aria-hidden="TRUE" aria-level="-2" aria-valuenow="1.5" aria-current="page" aria-checked=""></p><p role="combobox" aria-controls="gone"></p>', []),
    ],
    "aria-required-attr": [('<div role="checkbox"></div><div role="slider"></div>', [("4.1.2", M, False, "", 2)]), ('<div role="checkbox" aria-checked="true"></div><input type="checkbox" role="switch"><div role="slider" :aria-valuenow="x"></div>', [])],
    "aria-required-parent": [('<div role="tab">t</div><div role="table"><div role="cell"></div><div role="gridcell"></div></div>', [("1.3.1", M, False, "", 2)]), ('<div role="tablist"><div><div role="tab">t</div></div></div><ul><li role="listitem">x</li></ul>', [])],
    "aria-prohibited-attr": [('<div role="generic" aria-label="x"></div><p aria-sort="none"></p>', [("4.1.2", m, False, "", 1), ("4.1.2", m, False, "unsupported", 1)]), ('<div aria-label="x"></div><button aria-pressed="true">b</button>', [])],
    "html-lang-missing": [(page("", lang=""), [("3.1.1", B, False, "", 1)]), (page(""), []), ("<p>fragment</p>", [])],
    "document-language-missing": [(page("<p>text</p>", lang=""), [("3.1.1", B, False, "", 1)]), (page('<div lang="en"><p>t</p></div>', lang="", main=False), [])],
    "html-lang-xml-lang-mismatch": [(page("", lang=' lang="en" xml:lang="fr"'), [("3.1.1", M, False, "", 1)]), (page("", lang=' lang="en-GB" xml:lang="en"'), [])],
    "duplicate-attribute": [('<p id="a" class="x" id="b">t</p>', [("4.1.2", M, False, "", 1)]), ('<p id="a" class="b">t</p>', [])],
    "title-missing-empty": [(page("", head=""), [("2.4.2", B, False, "", 1)]), (page("", head="<title> </title>"), [("2.4.2", B, False, "", 1)]), (page(""), []), (page("", head="{{ head }}"), [])],
    "duplicate-id": [('<p id="a"></p><p id="a"></p><p id="a"></p>', [("4.1.2", M, False, "", 2)]), ('<p id="a"></p><p id="b"></p><p id="{x}"></p><p id="{x}"></p>', [])],
    "inline-lang-change-missing": [('<p lang="">x</p>', [("3.1.2", m, False, "", 1)]), ('<p lang="fr">x</p>', [])],
    "lang-invalid": [
        (page('<p lang="english">x</p><p lang="xq">y</p><p lang="fra">z</p>', lang=' lang="en_US"'), [("3.1.1", m, False, "", 1), ("3.1.2", m, False, "", 3)]),
        (page('<p lang="fr-CA">x</p><p lang="zz1"></p><p lang="qqq">private</p>'), []),
    ],
    "heading-order-skip": [("<h1>a</h1><h3>b</h3><h2>c</h2><div role='heading' aria-level='5'>d</div>", [("1.3.1", M, False, "", 2)]), ("<h2>a</h2><h3>b</h3><h1>c</h1>", [])],
    "h1-missing": [(page("<h2>x</h2>", main=False), [("1.3.1", m, True, "", 1)]), (page(""), []), (page('<div id="root"></div>', main=False), [])],
    "h1-multiple": [(page("<h1>x</h1><h1>y</h1>"), [("1.3.1", m, True, "", 2)]), (page(""), [])],
    "list-structure": [
        ("<ul><p>a</p><div>b</div></ul><div><li>c</li></div>", [("1.3.1", M, False, "invalid-child", 1), ("1.3.1", M, False, "li-outside-list", 1)]),
        ("<ul><li>a</li><script></script></ul><menu><li>b</li></menu><ul><x-item></x-item></ul><template><li>c</li></template>", []),
    ],
    "empty-heading": [('<h2></h2><h3><img alt=""></h3>', [("1.3.1", M, False, "", 2)]), ('<h2>x</h2><h3><img alt="y"></h3><h2 aria-hidden="true"></h2><h2><slot></slot></h2>', [])],
    "dl-structure": [("<dl><p>x</p><dt>a</dt><dd>b</dd></dl><dt>c</dt>", [("1.3.1", M, False, "foreign-child", 1), ("1.3.1", M, False, "orphan", 1)]), ("<dl><div><dt>a</dt><dd>b</dd></div></dl>", [])],
    "data-table-no-headers": [
        (_TABLE.format("<td>a</td><td>b</td>", "<td>c</td><td>d</td>") + _TABLE.format("<th>a</th><td>b</td>", "<td>c</td><th>d</th>"), [("1.3.1", M, False, "no-th", 1), ("1.3.1", M, False, "no-assoc", 1)]),
        (_TABLE.format("<th>a</th><th>b</th>", "<td>c</td><td>d</td>") + _TABLE.format("<th>a</th><td>b</td>", "<th>c</th><td>d</td>") + '<table role="none"><tr><td>x</td></tr></table>', []),
    ],
    "table-caption-missing": [("<table><tr><th>a</th></tr><tr><td>b</td></tr></table>", [("1.3.1", m, False, "", 1)]), (_TABLE.format("<th>a</th>", "<td>b</td>") + '<table aria-label="t"><tr><th>a</th></tr></table>', [])],
    "layout-table-data-markup": [('<table role="presentation"><tr><th>a</th></tr></table>', [("1.3.1", m, False, "", 1)]), ('<table role="presentation"><tr><td>a</td></tr></table>', [])],
    "sortable-header-no-aria-sort": [(_TABLE.format('<th><button class="sort">a</button></th>', "<td>b</td>"), [("1.3.1", m, False, "", 1)]), (_TABLE.format('<th aria-sort="none"><button class="sort">a</button></th><th><button>b</button></th>', "<td>b</td>"), [])],
    "table-empty-data-cell": [(_TABLE.format("<th>a</th><th>b</th>", "<td> </td><td>-</td>"), [("1.3.1", m, True, "", 2)]), (_TABLE.format("<th>a</th><th>b</th>", '<td><img alt=""></td><td aria-label="none"></td>'), [])],
    "headers-attr-dangling": [(_TABLE.format('<th id="a">a</th>', '<td id="c" headers="a c gone">b</td>'), [("1.3.1", M, False, "", 1)]), (_TABLE.format('<th id="a">a</th>', '<td headers="a">b</td>'), [])],
    "table-scope-invalid": [('<table><tr><th scope="column">a</th></tr></table>', [("1.3.1", M, False, "", 1)]), ('<table><tr><th scope="COL">a</th><th scope="{x}">b</th></tr></table>', [])],
    "th-no-data-cells": [
        (_TABLE.format("<th>a</th><th>b</th>", "<td>c</td>") + '<div role="grid"><div role="row"><i role="columnheader">a</i><i role="columnheader">b</i></div><div role="row"><i role="gridcell">c</i></div></div>', [("1.3.1", m, False, "", 2)]),
        (_TABLE.format("<th>a</th><th>b</th>", "<td>c</td><td>d</td>") + _TABLE.format("<th>a</th><th colspan=2>b</th>", "<td>c</td>"), []),
    ],
    "link-empty-name": [
        ('<a href="#x"></a><map name="m"><area href="y"></map><img usemap="#m" alt="">', [("2.4.4", B, False, "", 2)]),
        ('<a href="#x">t</a><a></a><a href="#y"><img alt="z"></a><a href="#i"><i class="icon"></i></a><map name="n"><area href="y"></map><a href="#h" hidden></a>', []),
    ],
    "button-empty-name": [("<button></button><div role='button'></div>", [("4.1.2", B, False, "", 2)]), ("<button>x</button><form><button></button></form><input type='submit'><button><svg></svg></button>", [])],
    "form-button-empty-name": [("<form><button></button></form><form id=f></form><button form=f></button>", [("4.1.2", B, False, "", 2)]), ("<form><button>x</button></form><button></button>", [])],
    "icon-only-control-unnamed": [('<a href="#"><svg></svg></a><button><i class="fa fa-x"></i></button>', [("2.4.4", B, False, "", 1), ("4.1.2", B, False, "", 1)]), ('<button aria-label="x"><svg></svg></button><button><svg><title>t</title></svg></button>', [])],
    "control-name-title-only": [('<a href="#" title="t"></a><button title="t"></button><input title="t">', [("4.1.2", m, False, "", 3)]), ('<a href="#" title="t">x</a><input title="t" aria-label="y"><input type="submit" title="t">', [])],
    "label-in-name-mismatch": [('<button aria-label="Close">Send it</button>', [("2.5.3", M, False, "", 1)]), ('<button aria-label="Send it now">Send it!</button><button aria-label="Close">X</button>', [])],
    "form-label-in-name-mismatch": [('<form><button aria-label="Close">Send it</button></form>', [("2.5.3", M, False, "", 1)]), ('<form><button aria-label="Send it">Send it</button></form><button aria-label="Close">Send it</button>', [])],
    "link-label-in-name-mismatch": [('<a href="#" aria-label="Home">Contact us</a>', [("2.5.3", M, False, "", 1)]), ('<a href="#" aria-label="Contact us today">Contact us</a>', [])],
    "field-label-in-name-mismatch": [('<label for="a">First name</label><input id="a" aria-label="Surname">', [("2.5.3", M, False, "", 1)]), ('<label for="a">First name <span class="sr-only">help</span></label><input id="a" aria-label="Your first name">', [])],
    "control-label-missing": [("<input><select></select><div role='textbox'></div>", [("4.1.2", B, False, "", 3)]), ('<input placeholder="p"><label>x<input></label><label for="a">y</label><input id="a"><input title="t"><input type="hidden"><div role="textbox" aria-label="z"></div>', [])],
    "placeholder-as-label": [('<input placeholder="p"><input placeholder="q" title="t">', [("4.1.2", M, False, "", 2)]), ('<label>x<input placeholder="p"></label>', [])],
    "fieldset-legend-missing": [("<fieldset><input><input></fieldset>", [("1.3.1", M, False, "", 1)]), ("<fieldset><legend>l</legend><input><input></fieldset><fieldset><input></fieldset>", [])],
    "form-field-multiple-labels": [('<label for="a">x</label><label for="a">y</label><input id="a">', [("4.1.2", m, False, "", 1)]), ('<label for="a">x</label><input id="a">', [])],
    "select-has-option": [("<select></select>", [("4.1.2", m, False, "", 1)]), ("<select><optgroup><option>a</option></optgroup></select><select><slot></slot></select>", [])],
    "label-for-dangling": [('<label for="gone">x</label>', [("1.3.1", M, False, "", 1)]), ('<label for="a">x</label><input id="a"><label for="b">y</label><x-field inputid="b"></x-field><label for="{c}">z</label>', [])],
    "aria-invalid-no-description": [('<input aria-invalid="true">', [("3.3.1", M, False, "", 1)]), ('<input aria-invalid="true" aria-describedby="e"><input aria-invalid="false">', [])],
    "error-not-associated": [('<p class="error-message" id="e">bad</p>', [("3.3.1", M, False, "", 1)]), ('<p class="error-message" id="e">bad</p><input aria-describedby="e"><p class="field-error" id="f" role="alert">x</p><p class="field-error" id="g">y</p><a href="#g">go</a>', [])],
    "field-purpose-incomplete": [
        ('<input type="email"><input name="userPhone"><div role="textbox" class="is-required"></div>', [("1.3.5", m, False, "autocomplete", 2), ("4.1.2", m, False, "aria-required", 1)]),
        ('<input type="email" autocomplete="email"><input name="q"><input type="checkbox" name="city">', []),
    ],
    "disabled-context-content": [("<fieldset disabled><input></fieldset><div inert><input></div>", [("4.1.2", M, False, "fieldset", 1), ("4.1.2", M, False, "inert", 1)]), ("<fieldset disabled><input><button>go</button></fieldset><div inert>x</div>", [])],
    "radio-checkbox-group-ungrouped": [
        ('<input type="radio" name="r"><input type="radio" name="r"><input type="checkbox" name="c"><input type="checkbox" name="c">', [("1.3.1", M, False, "", 2)]),
        ('<fieldset><input type="radio" name="r"><input type="radio" name="r"></fieldset><table><tr><td><input type="checkbox" name="c"></td></tr><tr><td><input type="checkbox" name="c"></td></tr></table><form><input type="radio" name="z"></form><form><input type="radio" name="z"></form>', []),
    ],
    "date-fields-ungrouped": [('<p><input type="date"><input name="start-day"></p>', [("3.3.2", M, False, "", 1)]), ('<fieldset><input type="date"><input type="date"></fieldset><p><input type="date"></p>', [])],
    "autocomplete-token-invalid": [('<input autocomplete="nam"><input autocomplete="home name">', [("1.3.5", M, False, "", 2)]), ('<input autocomplete="section-a shipping home tel"><input autocomplete="ON"><input autocomplete="username webauthn"><input autocomplete="x" disabled>', [])],
    "credential-entry-blocked": [('<input type="password" onpaste="return false"><input autocomplete="off" type="password">', [("3.3.8", B, False, "paste", 1), ("3.3.8", B, False, "autocomplete", 1)]), ('<input type="password"><input autocomplete="off">', [])],
    "on-input-context-change": [('<select onchange="this.form.submit()"></select>', [("3.2.2", M, False, "", 1)]), ('<select onchange="update()"></select>', [])],
    "skip-link-target-missing": [(page('<a href="#gone">s</a><a href="#caf%C3%A9">t</a>'), [("2.4.1", M, False, "", 2)]), (page('<a href="#a">s</a><p id="a"></p><a href="#n">u</a><a name="n"></a><a href="#">v</a><a href="#caf%C3%A9">t</a><p id="café"></p>'), [])],
    "positive-tabindex": [('<p tabindex="3">x</p><p tabindex="5x">y</p>', [("2.4.3", M, False, "", 2)]), ('<p tabindex="0">x</p><p tabindex="-1">y</p><p tabindex="a">z</p>', [])],
    "missing-main-landmark": [(page("<h1>x</h1>", main=False), [("1.3.1", M, False, "", 1)]), (page(""), []), (page('<div role="main"></div>', main=False), [])],
    "multiple-main-landmark": [(page('<div role="main">x</div>'), [("1.3.1", M, False, "", 1)]), (page('<main aria-hidden="true"></main>'), [])],
    "nav-landmark-missing": [(page("<header>" + '<a href="/x">l</a> ' * 4 + "</header>"), [("1.3.1", M, False, "", 1)]), (page("<header>" + '<a href="/x">l</a> ' * 4 + "</header><nav></nav>"), []), (page("<header>" + '<a href="/x">l</a> ' * 3 + "</header>"), [])],
    "nav-landmark-unnamed": [(page('<nav>a</nav><nav aria-label="b">b</nav>'), [("1.3.1", m, False, "", 1)]), (page("<nav>a</nav>"), [])],
    "bypass-blocks-missing": [(page('<nav><a href="/a">a</a></nav><p>Here is some content after the navigation.</p>', main=False), [("2.4.1", M, False, "", 1)]), (page('<nav><a href="/a">a</a></nav><p>Here is some content after the navigation.</p>'), []), (page('<a href="#c">skip</a><nav>n</nav><p id="c">Here is some content after the navigation.</p>', main=False), [])],
    "autoplay-media": [
        ("<video autoplay muted></video><video autoplay></video><audio autoplay></audio>", [("2.2.2", M, True, "muted-video", 1), ("2.2.2", M, False, "audible", 1), ("1.4.2", M, False, "audible", 1)]),
        ("<video autoplay controls></video><audio></audio>", []),
    ],
    "media-no-track": [("<video></video>", [("1.2.2", M, True, "", 1)]), ("<video><track></video><video muted></video>", [])],
    "meta-viewport-zoom-block": [('<meta name="viewport" content="width=device-width, user-scalable=no"><meta name="viewport" content="maximum-scale=1.5">', [("1.4.4", M, False, "", 2)]), ('<meta name="viewport" content="width=device-width, maximum-scale=5">', [])],
    "css-generated-content-informative": [("<style>a::before{content:'New item'} b::after{content:\"→\"} c::after{content:'New item'} d{content:'\\\\f001abc'}</style>", [("1.3.1", m, True, "", 1)]), ("<style>a{color:red}</style>", [])],
    "letter-spacing-important": [('<p style="letter-spacing: 0.05em !important">x</p>', [("1.4.12", M, False, "", 1)]), ('<p style="letter-spacing:0.2em !important">x</p><p style="letter-spacing:0.05em">y</p><p style="letter-spacing:1px !important">z</p>', [])],
    "word-spacing-important": [('<p style="word-spacing: 0 !important;color:red">x</p>', [("1.4.12", M, False, "", 1)]), ('<p style="word-spacing:.3em !important">x</p>', [])],
    "line-height-important": [('<p style="line-height:1.2 !important">x</p><p style="line-height:110%!important">y</p>', [("1.4.12", M, False, "", 2)]), ('<p style="line-height:1.6 !important">x</p><div style="overflow:auto"><p style="line-height:1 !important">y</p></div>', [])],
    "presentational-element": [("<center>x</center><font>y</font>", [("1.3.1", M, True, "", 2)]), ("<b>x</b><small>y</small>", [])],
    "presentational-attribute": [('<p align="center" bgcolor="red">x</p><td width="3"></td><input size="4">', [("1.3.1", M, True, "", 3)]), ('<img width="3" alt=""><select size="3"></select><svg><path color="red"/></svg>', [])],
    "presentational-spacing": [("<p>S P E L L E D</p><p>a   b</p>", [("1.3.1", M, True, "", 2)]), ("<p>A B C</p><pre>S P E L L E D</pre>", [])],
    "meta-refresh-redirect": [('<meta http-equiv="refresh" content="30; url=/x"><meta http-equiv="refresh" content="60">', [("2.2.1", M, False, "", 1)]), ('<meta http-equiv="refresh" content="0; url=/x">', []), ('<meta http-equiv="refresh" content="100000">', [])],
    "blink-marquee": [("<blink>x</blink><marquee>y</marquee>", [("2.2.2", M, False, "", 2)]), ("<p>x</p>", [])],
    "contrast-literal": [
        ('<p style="color:#777;background:#888">x</p><div style="background-color:white"><p style="color:rgb(200, 200, 200)">y</p></div>', [("1.4.3", M, False, "", 2)]),
        ('<p style="color:#000;background:#fff">x</p><p style="color:#777">y</p><p style="color:#888;background:white;font-size:24px">z</p><p style="color:rgba(0,0,0,.1);background:#fff">w</p>', []),
    ],
}
