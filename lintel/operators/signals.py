"""Rules over what a browser measured: computed styles, boxes, style rules, probes.

Signal tables join elements on (page, ordinal). A page whose digest names another tag at any
ordinal is dropped whole, since a shifted digest would blame the wrong elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.markup import attr, contrast, parse_colour, tag, trim


def aligned(digest: DataFrame, elements: DataFrame) -> DataFrame:
    """The digest's rows of those pages where every ordinal has the tag it claims."""
    both = digest.join(elements.select("page_id", "ord", F.col("tag").alias("real")), ["page_id", "ord"], "left")
    bad = both.where(~F.col("tag").eqNullSafe(F.col("real"))).select("page_id").distinct()
    return digest.join(bad, "page_id", "left_anti")


def _css(name: str, default: str = "") -> Column:
    return F.coalesce(F.col("css")[name], F.lit(default))


def _px(value: Column) -> Column:
    return F.regexp_extract(value, "^\\s*(-?[0-9.]+)", 1).try_cast("double")


def _invisible() -> Column:
    return (_css("display") == "none") | (_css("visibility") == "hidden") | F.coalesce(_px(_css("opacity", "1")) == 0, F.lit(False))


def _large() -> Column:
    size, weight = _px(_css("fontSize")), _px(_css("fontWeight", "400"))
    bold = F.coalesce(weight >= 700, _css("fontWeight") == "bold")
    return F.coalesce((size >= 24) | ((size >= 18.66) & bold), F.lit(False))


def backdrops(elements: DataFrame, styles: DataFrame) -> DataFrame:
    """(page_id, ord, backdrop): colour of the nearest opaque background at or above an element.

    Null when an image or gradient comes first or nothing is opaque: that is unknown, not white.
    ``elements`` needs the column ``path``.
    """
    chain = elements.select("page_id", "ord", F.posexplode(F.concat(F.array("ord"), "path")).alias("step", "at"))
    paint = styles.select("page_id", F.col("ord").alias("at"), (_css("backgroundImage", "none").isin("none", "") == F.lit(False)).alias("image"), parse_colour(_css("backgroundColor")).alias("colour"))
    stops = chain.join(paint, ["page_id", "at"]).where(F.col("image") | (F.get("colour", F.lit(3)) >= 1))
    first = stops.groupBy("page_id", "ord").agg(F.min_by(F.struct("image", "colour"), "step").alias("b"))
    return first.where("not b.image").select("page_id", "ord", F.col("b.colour").alias("backdrop"))


def _shown_text(elements: DataFrame, styles: DataFrame) -> DataFrame:
    """Text elements with their computed style, active and visible."""
    skip = ("script", "style", "head", "title", "meta", "noscript", "link", "html", "br", "wbr")
    off = (F.coalesce(attr("aria-disabled"), F.lit("")) == "true") | (tag("button", "input", "select", "textarea", "option", "optgroup", "fieldset") & F.map_contains_key("attrs", "disabled"))
    idle = elements.where(off).select("page_id", F.col("ord").alias("o"), F.col("last_ord").alias("l"))
    rows = elements.where(~tag(*skip) & (trim(F.col("direct_text")) != "")).join(styles.select("page_id", "ord", "css"), ["page_id", "ord"])
    active = rows.join(idle, (rows["page_id"] == idle["page_id"]) & (F.col("ord") >= F.col("o")) & (F.col("ord") <= F.col("l")), "left_anti")
    return active.where(~_invisible())


def _row(rule: str, sc: str) -> list[Column]:
    return [F.lit(rule).alias("rule_id"), F.lit(sc).alias("sc"), F.lit("majeur").alias("severity")]


def rendered_contrast(elements: DataFrame, styles: DataFrame) -> DataFrame:
    fg = parse_colour(_css("color"))
    rows = _shown_text(elements, styles).select("page_id", "ord", fg.alias("fg"), _large().alias("large")).where(F.get("fg", F.lit(3)) >= 1)
    low = rows.join(backdrops(elements, styles), ["page_id", "ord"]).withColumn("ratio", contrast(F.col("fg"), F.col("backdrop")))
    return low.where(F.col("ratio") < F.when(F.col("large"), 3.0).otherwise(4.5)).select("page_id", "ord", *_row("rendered-contrast", "1.4.3"), F.format_string("%.2f", "ratio").alias("detail"))


def pixel_contrast(elements: DataFrame, styles: DataFrame, dominant: DataFrame) -> DataFrame:
    """Text over images, against the dominant colour of its box (page_id, ord, colour array).

    ``dominant`` comes from :func:`dominant_colours`.
    """
    fg = parse_colour(_css("color"))
    rows = _shown_text(elements, styles).select("page_id", "ord", fg.alias("fg"), _large().alias("large")).where(F.get("fg", F.lit(3)) >= 1)
    unknown = rows.join(backdrops(elements, styles), ["page_id", "ord"], "left_anti")
    low = unknown.join(dominant, ["page_id", "ord"]).withColumn("ratio", contrast(F.col("fg"), F.col("colour")))
    return low.where(F.col("ratio") < F.when(F.col("large"), 3.0).otherwise(4.5)).select("page_id", "ord", *_row("rendered-contrast-pixel", "1.4.3"), F.format_string("%.2f", "ratio").alias("detail"))


def dominant_colours(pixels: DataFrame, share: float = 0.6) -> DataFrame:
    """(page_id, ord, colour): mean of the commonest 16-step bucket of a box, if it holds ``share`` of it.

    ``pixels``: page_id, ord, r, g, b, one row per sampled pixel of a box.
    """
    bucket = F.struct(*[F.floor(F.col(c) / 16).alias(c) for c in "rgb"])
    sums = pixels.groupBy("page_id", "ord", bucket.alias("k")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "rgb"])
    best = sums.groupBy("page_id", "ord").agg(F.sum("n").alias("all"), F.max_by(F.struct("n", "mr", "mg", "mb"), F.struct("n", "k")).alias("b"))
    colour = F.array(F.round("b.mr"), F.round("b.mg"), F.round("b.mb"), F.lit(1.0))
    return best.where(F.col("b.n") >= share * F.col("all")).select("page_id", "ord", colour.alias("colour"))


def links_by_colour(elements: DataFrame, styles: DataFrame) -> DataFrame:
    blocks = ("p", "li", "dd", "dt", "td", "th", "blockquote", "figcaption", "caption")
    own = styles.select("page_id", "ord", "css")
    rest = styles.select("page_id", F.col("ord").alias("parent_ord"), F.col("css").alias("around"))
    texts = elements.select("page_id", F.col("ord").alias("parent_ord"), F.col("text").alias("block_text"))
    rows = elements.where(tag("a") & (trim(F.col("direct_text")) != "") & F.get("anc_tags", F.lit(0)).isin(*blocks)).join(own, ["page_id", "ord"]).join(rest, ["page_id", "parent_ord"]).join(texts, ["page_id", "parent_ord"])
    words = F.length(F.regexp_replace("block_text", "[^\\p{L}\\p{N}]", "")) > F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}]", ""))
    line = _css("textDecorationLine")
    around = F.coalesce(_px(F.coalesce(F.col("around")["fontWeight"], F.lit("400"))), F.lit(400.0))
    cue = (
        ~line.isin("", "none")
        | ((_css("borderBottomStyle", "none") != "none") & F.coalesce(_px(_css("borderBottomWidth", "0")) > 0, F.lit(False)))
        | F.coalesce(F.get(parse_colour(_css("backgroundColor")), F.lit(3)) > 0, F.lit(False))
        | (_css("backgroundImage", "none") != "none")
        | (_css("boxShadow", "none") != "none")
        | F.coalesce(_px(_css("fontWeight", "400")) >= around + 200, F.lit(False))
    )
    ratio = contrast(parse_colour(_css("color")), parse_colour(F.coalesce(F.col("around")["color"], F.lit(""))))
    bad = rows.where(words & ~_invisible() & ~cue).withColumn("ratio", ratio).where(F.col("ratio") > 1.02)
    return bad.select("page_id", "ord", *_row("rendered-link-colour-only", "1.4.1"), F.format_string("%.2f", "ratio").alias("detail"))


def control_boundaries(elements: DataFrame, styles: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce(attr("type"), F.lit("")))
    said = F.col("text").rlike("[\\p{L}\\p{N}]")
    is_button = tag("button") | (tag("input") & kind.isin("button", "submit", "reset"))
    rows = elements.where(tag("input", "select", "textarea", "button") & ~(tag("input") & kind.isin("hidden", "image")) & ~(tag("button") & said) & ~F.map_contains_key("attrs", "disabled"))
    rows = rows.where(~(tag("input") & kind.isin("button", "submit", "reset") & F.coalesce(attr("value"), F.lit("")).rlike("[\\p{L}\\p{N}]")))
    rows = rows.where(~F.coalesce(attr("class"), F.lit("")).rlike("(^|\\s)(fr-sr-only|sr-only|visually-hidden|visuallyhidden)(\\s|$)")).join(styles.select("page_id", "ord", "css"), ["page_id", "ord"])
    behind = backdrops(elements, styles).withColumnRenamed("ord", "parent_ord")
    rows = rows.join(behind, ["page_id", "parent_ord"])
    own = parse_colour(_css("backgroundColor"))
    fill = F.when(F.get(own, F.lit(3)) >= 1, own).otherwise(F.col("backdrop"))
    outline = (_css("outlineStyle", "none") != "none") & F.coalesce(_px(_css("outlineWidth", "0")) > 0, F.lit(False))
    glyph = parse_colour(_css("color"))
    drawn = F.lit(False)
    for side in ("Top", "Right", "Bottom", "Left"):
        line = parse_colour(_css(f"border{side}Color"))
        seen = ~_css(f"border{side}Style", "none").isin("none", "hidden", "") & F.coalesce(_px(_css(f"border{side}Width", "0")) > 0, F.lit(False)) & (F.get(line, F.lit(3)) >= 1)
        drawn = drawn | F.coalesce(seen & ((contrast(line, F.col("backdrop")) >= 3) | (contrast(line, fill) >= 3)), F.lit(False))
    shows = F.coalesce(is_button & (F.get(glyph, F.lit(3)) >= 1) & (contrast(glyph, F.col("backdrop")) >= 3), F.lit(False))
    bad = rows.where(~_invisible() & (_css("boxShadow", "none") == "none") & ~outline & (contrast(fill, F.col("backdrop")) < 3) & ~shows & ~drawn)
    return bad.select("page_id", "ord", *_row("rendered-nontext-contrast", "1.4.11"), F.col("tag").alias("detail"))


def _kills() -> Column:
    d = lambda n: F.trim(F.coalesce(F.col("decls")[n], F.lit("")))
    return d("outline").rlike("^0(px)?( |$)|\\bnone\\b") | (d("outlineStyle") == "none") | F.coalesce(_px(d("outlineWidth")) == 0, F.lit(False))


def _restores() -> Column:
    d = lambda n: F.coalesce(F.col("decls")[n], F.lit(""))
    lively = F.exists(
        F.map_entries("decls"),
        lambda e: (e["key"].rlike("^border(Top|Right|Bottom|Left)?(Color|Width|Style)?$") & ~e["value"].isin("", "none")) | (e["key"].rlike("^background(Color|Image)?$") & ~e["value"].isin("", "none", "rgba(0, 0, 0, 0)")),
    )
    outline = (~d("outlineStyle").isin("", "none") & (F.coalesce(_px(F.coalesce(F.col("decls")["outlineWidth"], F.lit("1"))), F.lit(0.0)) > 0)) | ((d("outline") != "") & ~_kills())
    other = F.col("decls")["filter"].isNotNull() | F.col("decls")["transform"].isNotNull() | F.col("decls")["color"].isNotNull()
    return ~d("boxShadow").isin("", "none") | outline | ~d("textDecorationLine").isin("", "none") | lively | other


def focus_not_visible(elements: DataFrame, css_rules: DataFrame, css_meta: DataFrame) -> DataFrame:
    """Pages whose focus rules remove the outline and give nothing instead; unreadable sheets abstain."""
    quiet = "main section article aside header footer nav div span p body html h1 h2 h3 h4 h5 h6 ul ol li dl table form figure img".split()
    tabbable = elements.where(F.coalesce(F.regexp_extract(F.coalesce(attr("tabindex"), F.lit("")), "^\\s*(-?\\d+)", 1).try_cast("int") >= 0, F.lit(False))).select("page_id", F.col("tag").alias("subject")).distinct().withColumn("there", F.lit(True))
    parts = css_rules.where(F.col("selector").rlike(":focus(-visible|-within)?\\b")).select("page_id", "i", "decls", F.explode(F.split("selector", ",")).alias("part"))
    subject = F.lower(F.regexp_extract(F.element_at(F.split(F.trim("part"), "[\\s>+~]+"), -1), "^([A-Za-z][A-Za-z0-9-]*)", 1))
    parts = parts.withColumn("subject", subject).join(tabbable, ["page_id", "subject"], "left")
    rules = parts.where(~F.col("subject").isin(*quiet) | F.col("there")).groupBy("page_id", "i").agg(F.first("decls").alias("decls"))
    good = css_meta.where("unreadable = 0 and not truncated").select("page_id")
    pages = rules.join(good, "page_id", "left_semi").groupBy("page_id").agg(F.max(_kills()).alias("kills"), F.max(_restores()).alias("restores")).where("kills and not restores")
    controls = elements.where(tag("a", "button", "input", "select", "textarea")).select("page_id").distinct()
    return pages.join(controls, "page_id", "left_semi").select("page_id", F.lit(0).alias("ord"), *_row("rendered-focus-not-visible", "2.4.7"), F.lit("").alias("detail"))


def orientation_locked(css_rules: DataFrame, css_meta: DataFrame) -> DataFrame:
    turn = F.abs(F.regexp_extract(F.coalesce(F.col("decls")["transform"], F.lit("")), "(?i)rotate[ZY]?\\(\\s*(-?[\\d.]+)deg\\s*\\)", 1).try_cast("double")) % 180
    rows = css_rules.join(css_meta.where("unreadable = 0").select("page_id"), "page_id", "left_semi")
    rows = rows.where(F.col("media").rlike("(?i)orientation\\s*:") & F.exists(F.split("selector", ","), lambda s: s.rlike("(?i)^\\s*(\\*|:root|html|body)\\s*$")) & (F.abs(turn - 90) < 1))
    first = rows.groupBy("page_id").agg(F.min_by("media", "i").alias("detail"))
    return first.select("page_id", F.lit(0).alias("ord"), *_row("rendered-orientation-lock", "1.3.4"), "detail")
