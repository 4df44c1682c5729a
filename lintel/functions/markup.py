"""Column helpers for element predicates: attributes, roles, vocabularies, colours."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What script engines trim.
BLANKS = " \t\n\x0b\x0c\r ﻿"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value written and computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def attr(name: str) -> Column:
    """The literal attribute; null when it is missing."""
    return F.col("attrs")[name]


def has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def text_of(name: str) -> Column:
    """The trimmed attribute, empty when it is missing."""
    return trim(F.coalesce(attr(name), F.lit("")))


def bound(name: str) -> Column:
    """The attribute in its literal or in a framework's binding spelling."""
    return F.coalesce(*[attr(p + name) for p in ("", ":", "v-bind:", "x-bind:", "bind:")])


def has_bound(name: str) -> Column:
    return bound(name).isNotNull()


def lower_of(name: str) -> Column:
    return F.lower(text_of(name))


def role() -> Column:
    return lower_of("role")


def first_role() -> Column:
    return F.split(role(), "\\s+")[0]


def input_type() -> Column:
    """The declared type, text when there is none."""
    return F.lower(trim(F.coalesce(attr("type"), F.lit("text"))))


def tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def below(name: str) -> Column:
    """How many elements of a tag the subtree holds."""
    return F.coalesce(F.col("desc_tags")[name], F.lit(0))


def above(*names: str) -> Column:
    return F.arrays_overlap("anc_tags", strings(names))


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(key: Column, table: dict[str, Iterable[str]]) -> Column:
    """The list that a fixed table has for a key; null without one."""
    parts: list[Column] = []
    for k, v in table.items():
        parts += [F.lit(k), strings(v)]
    return F.try_element_at(F.create_map(*parts), key)


def dynamic(value: Column) -> Column:
    return value.contains("{")


def spread() -> Column:
    """Attributes may be injected at run time."""
    return F.exists(F.map_keys("attrs"), lambda k: (k == "v-bind") | k.startswith("{"))


def tokens(value: Column) -> Column:
    return F.filter(F.split(value, "\\s+"), lambda t: t != "")


def number(value: Column) -> Column:
    """A script engine's Number(): the empty string is 0, other text is null."""
    return F.when(trim(value) == "", F.lit(0.0)).otherwise(value.try_cast("double"))


def focusable() -> Column:
    """Reachable by keyboard: an explicit tabindex decides, then the native or interactive nature."""
    index = number(attr("tabindex"))
    disabled = tag("button", "input", "select", "textarea", "fieldset", "optgroup", "option") & has("disabled")
    summary = tag("summary") & (F.get("anc_tags", F.lit(0)) == "details") & F.coalesce(F.col("first_summary"), F.lit(False))
    editable = has("contenteditable") & (attr("contenteditable") != "false")
    return F.when(has("tabindex") & index.isNotNull(), index >= 0).when(disabled, F.lit(False)).otherwise(interactive() | F.coalesce(summary | editable, F.lit(False)))


#: Roles that take part in interaction.
INTERACTIVE_ROLES = "button link checkbox radio tab menuitem menuitemcheckbox menuitemradio option switch textbox combobox slider spinbutton".split()


def interactive() -> Column:
    by_role = text_of("role").isin(*INTERACTIVE_ROLES)
    return (
        F.when(tag("a"), has("href"))
        .when(tag("button", "select", "textarea"), F.lit(True))
        .when(tag("input"), F.lower(F.coalesce(attr("type"), F.lit("text"))) != "hidden")
        .otherwise(by_role)
    )


def can_focus() -> Column:
    """Focusable at all, by Tab or by script."""
    index = text_of("tabindex")
    return (
        F.when((index != "") & ~dynamic(index) & index.try_cast("double").isNotNull(), F.lit(True))
        .when(tag("button", "input", "select", "textarea") & has("disabled"), F.lit(False))
        .when(tag("button", "select", "textarea", "iframe", "summary"), F.lit(True))
        .when(tag("a", "area"), has("href"))
        .when(tag("input"), input_type() != "hidden")
        .otherwise(F.lit(False))
    )


def name_exempt() -> Column:
    """No accessible name can be asked for: not exposed, or declared presentational."""
    return F.col("at_hidden") | (role().isin("presentation", "none") & ~can_focus())


def may_inject() -> Column:
    return below("slot") > 0


def named_by_aria() -> Column:
    return (trim(F.coalesce(bound("aria-label"), F.lit(""))) != "") | (has_bound("aria-labelledby") & ~F.col("ref_empty"))


def form_field() -> Column:
    return tag("input", "select", "textarea") & ~has("hidden") & ~(tag("input") & F.lower(F.coalesce(attr("type"), F.lit("text"))).isin("hidden", "submit", "reset", "button", "image"))


def button() -> Column:
    return tag("button") | (F.coalesce(attr("role"), F.lit("")) == "button") | (tag("input") & F.lower(text_of("type")).isin("button", "submit", "reset", "image"))


def link() -> Column:
    return tag("a") & has("href")


def plain(value: Column) -> Column:
    """For comparing names: lower case, letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]+", " "))


#: Colour keywords that are decided.
NAMED_COLOURS = {
    "white": "ffffff", "black": "000000", "red": "ff0000", "lime": "00ff00", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff", "aqua": "00ffff",
    "magenta": "ff00ff", "fuchsia": "ff00ff", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "maroon": "800000", "olive": "808000", "purple": "800080", "teal": "008080",
    "navy": "000080", "orange": "ffa500",
}


def parse_colour(value: Column) -> Column:
    """array(r, g, b, alpha) of a literal colour; null when it is none."""
    names = F.create_map(*[F.lit(x) for kv in NAMED_COLOURS.items() for x in kv])
    nothing = F.lit(None).cast("array<double>")

    def by_hex(digits: Column) -> Column:
        part = lambda i: F.conv(F.substring(digits, 2 + 2 * i, 2), 16, 10).cast("double")
        whole = F.array(part(0), part(1), part(2), F.when(F.length(digits) == 9, part(3) / 255).otherwise(1.0))
        return F.when(digits.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), whole).otherwise(nothing)

    def level(p: Column, full: float) -> Column:
        return F.when(p.endswith("%"), F.regexp_replace(p, "%", "").try_cast("double") * (full / 100)).otherwise(p.try_cast("double"))

    def by_rgb(parts: Column) -> Column:
        at = lambda i: F.try_element_at(parts, F.lit(i + 1))
        channel = lambda i: bind(at(i), lambda p: F.when(p.endswith("%"), F.floor(level(p, 255.0) + 0.5).cast("double")).otherwise(level(p, 255.0)))
        alpha = F.when(F.size(parts) > 3, bind(at(3), lambda p: level(p, 1.0))).otherwise(1.0)
        return bind(F.array(channel(0), channel(1), channel(2), alpha), lambda c: F.when((F.size(parts) >= 3) & ~F.exists(c, lambda x: x.isNull()), c).otherwise(nothing))

    def of(s: Column) -> Column:
        digits = F.coalesce(F.concat(F.lit("#"), F.try_element_at(names, s)), s)
        doubled = F.regexp_replace(digits, "^#([0-9a-f])([0-9a-f])([0-9a-f])([0-9a-f]?)$", "#$1$1$2$2$3$3$4$4")
        parts = F.filter(F.split(F.regexp_extract(s, "^rgba?\\(([^)]+)\\)$", 1), "[,/\\s]+"), lambda p: p != "")
        return F.when(s == "transparent", F.array(*[F.lit(0.0)] * 4)).otherwise(F.coalesce(bind(doubled, by_hex), bind(parts, by_rgb)))

    return bind(F.lower(trim(value)), of)


def luminance(colour: Column) -> Column:
    def linear(c: Column) -> Column:
        return bind(c / 255, lambda x: F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4)))

    return 0.2126 * linear(colour[0]) + 0.7152 * linear(colour[1]) + 0.0722 * linear(colour[2])


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast ratio of two opaque colours."""
    return bind(F.array(bind(a, luminance), bind(b, luminance)), lambda l: (F.array_max(l) + 0.05) / (F.array_min(l) + 0.05))


def style_values(style: Column, *properties: str) -> Column:
    """The last value of each property in an inline style, as an array in the order asked."""
    pairs = F.filter(F.split(style, ";"), lambda d: d.contains(":"))

    def last(p: str) -> Column:
        mine = F.filter(pairs, lambda d: F.lower(trim(F.substring_index(d, ":", 1))) == p)
        value = F.transform(mine, lambda d: trim(F.regexp_replace(d, "^[^:]*:", "")))
        return F.try_element_at(F.filter(value, lambda v: v != ""), F.lit(-1))

    return F.array(*[last(p) for p in properties])
