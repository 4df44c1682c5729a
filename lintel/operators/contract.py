"""The contract of a verdict file: every violation that keeps a verdict from being folded in.

Each check is one query over the file's tables, and the result is their union, (sc, violation, place). A verdict with a
violation stays out (:func:`lintel.operators.review.folded`), alone or, strictly, with the whole file.

Tables, all keyed by criterion (sc):

* ``verdicts``: verdict, justification, decided_by, auditor, reason.
* ``open_criteria``: complete (whether all its evidence was shown).
* ``citations`` (of C and NA), ``claims`` (of NC, with ref, the failed test), ``advice``: file, line, selector, snippet.
* ``evidence``: cls, file, line, selector, snippet, note: what a reviewer was shown, a row or more per class; ``siblings``: cls, file,
  line: the other places of the classes in ``evidence``.
* ``sources``: file, source: the audited files.

Citations meet evidence by a range join on buckets of lines: a citation looks in the two buckets that its window
touches, evidence stands in one, so the join is an equi join on (criterion, file, bucket) that also parts a file of a million lines.
A page written on a single line has all its evidence in one bucket; places are made distinct before they are asked only for being there.

Edge cases: a null verdict, reason or name is a violation where one is asked for; verdicts and reasons in any case and with
spaces around are read as meant; a criterion with several verdicts is a duplicate, and each of them is checked; verdicts on
criteria that are not open are refused as such and not looked at further; null files and lines find nothing; empty tables give no violations but
the missing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.attribution import snapshot_id
from lintel.plans.storage import materialize

#: What a verdict, its author and an open verdict's reason may say.
VERDICTS = ("C", "NC", "NA", "manual")
AUTHORS = ("agent", "human")
REASONS = ("needs-rendered-dom", "undecidable")


@dataclass(frozen=True)
class VerdictFile:
    """The tables of a verdict file and of what it is checked against."""

    verdicts: DataFrame
    open_criteria: DataFrame
    citations: DataFrame
    claims: DataFrame
    advice: DataFrame
    evidence: DataFrame
    siblings: DataFrame
    sources: DataFrame
    #: (ref, sc): what a claim may name as its failed test. Without ``own_tests`` any listed ref will do.
    tests: DataFrame
    own_tests: bool = True
    #: (sc): criteria that the file is known not to cover.
    expected: DataFrame | None = None
    #: (sc): criteria that apply to every page, so never NA.
    always: DataFrame | None = None
    #: (sc, file, line, selector): the engine's own failures, and (sc, presupposed): whose subject a criterion presupposes.
    engine: DataFrame | None = None
    presupposed: DataFrame | None = None
    #: Folder of page snapshots.
    folder: str = "snapshots/pages"


def canonical(value: Column, words: tuple[str, ...]) -> Column:
    """The word that a text means, whatever its case and the spaces around it; otherwise the text itself."""
    meant = F.lower(F.trim(value))
    out = F.when(F.lit(False), "")
    for word in words:
        out = out.when(meant == word.lower(), word)
    return out.otherwise(value)


def read_citation(text: Column) -> tuple[Column, Column]:
    """(file, line) of a citation written ``file:line``; nulls where it is not."""
    there = text.rlike("(?s)^.+:[0-9]{1,9}$")
    return F.when(there, F.regexp_extract(text, "(?s)^(.+):[0-9]{1,9}$", 1)), F.when(there, F.regexp_extract(text, ":([0-9]{1,9})$", 1).cast("int"))


def canonical_file(path: Column, folder: str) -> Column:
    """Snapshots are known by their published path, whatever checkout held them; other paths by their slashes."""
    plain = F.translate(path, "\\", "/")
    tail = F.substring_index(plain, f"{folder}/", -1)
    return F.when(F.contains(plain, F.lit(f"{folder}/")), F.concat(F.lit(f"{folder}/"), tail)).otherwise(plain)


# --- what a citation shows and what was shown to the reviewer


def _lower_tag(snippet: Column, selector: Column) -> Column:
    tag = lambda text, pattern: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))
    return F.lower(F.coalesce(tag(snippet, "<\\s*([a-zA-Z][\\w-]*)"), tag(selector, "^\\s*([a-zA-Z][\\w-]*)")))


def content_words(markup: Column) -> Column:
    """Distinct words of three letters or more in attribute values and text: what tells one element from another."""
    said = F.coalesce(markup, F.lit(""))
    values = F.regexp_extract_all(said, F.lit("=\\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(0))
    values = F.transform(values, lambda v: F.regexp_replace(v, "^=\\s*[\"']|[\"']$", ""))
    text = F.regexp_replace(said, "<[^>]*>", " ")
    words = F.flatten(F.transform(F.concat(values, F.array(text)), lambda v: F.split(F.lower(v), "[\\s/_-]+")))
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 3))


def _overlap(words: Column, other: Column) -> Column:
    return F.size(F.array_intersect(words, other))


def _recognisable() -> Column:
    """The cited element can be the one that was shown: same tag, and a word in common where both have any."""
    a, b = _lower_tag(F.col("snippet"), F.col("selector")), _lower_tag(F.col("e_snippet"), F.col("e_selector"))
    silent = (F.coalesce("snippet", F.lit("")) == "") | (F.coalesce("e_snippet", F.lit("")) == "")
    said, shown = F.col("words"), F.col("e_words")
    common = silent | (F.size(said) == 0) | (F.size(shown) == 0) | F.arrays_overlap(said, shown)
    return (a.isNull() | b.isNull() | (a == b)) & common


def _buckets(line: Column, drift: int) -> Column:
    width = 2 * drift + 1
    low, high = F.floor((line - drift) / width), F.floor((line + drift) / width)
    return F.when(low == high, F.array(low)).otherwise(F.array(low, high))


def _bucket(line: Column, drift: int) -> Column:
    return F.floor(line / (2 * drift + 1))


def near(places: DataFrame, anchors: DataFrame, drift: int, keep: list[str]) -> DataFrame:
    """Pairs of places and anchors of the same criterion and file, at most ``drift`` lines apart; once each.

    ``places``: at, sc, path, line; ``anchors``: sc, path, a_line and the columns in ``keep``.
    """
    asked = places.select("*", F.explode(_buckets(F.col("line"), drift)).alias("bucket"))
    stood = anchors.select("sc", "path", "a_line", *keep, _bucket(F.col("a_line"), drift).alias("bucket"))
    pairs = asked.join(stood, ["sc", "path", "bucket"])
    return pairs.where(F.abs(F.col("line") - F.col("a_line")) <= drift).drop("bucket")


def anchored(places: DataFrame, file: VerdictFile, drift: int) -> DataFrame:
    """Per place that resolves to evidence: how, the evidence (e_file, e_line, e_selector, e_snippet), whether it is recognisably
    the same (alike) and whether a place of the criterion's evidence is near (close).

    First evidence near by, then on a page snapshot any evidence of that file with the same selector or content, then
    a class with another place near by; among several the one that shares most words, then the first.
    """
    kept = ["cls", "e_file", "e_line", "e_selector", "e_snippet", "e_words", "n_words"]
    shown = file.evidence.select(
        "sc", "cls", canonical_file(F.col("file"), file.folder).alias("path"), F.col("file").alias("e_file"), F.col("line").alias("e_line"), F.col("selector").alias("e_selector"),
        F.col("snippet").alias("e_snippet"), content_words(F.col("snippet")).alias("e_words"), content_words(F.col("note")).alias("n_words"), F.col("line").alias("a_line"),
    )
    asked = places.select("at", "sc", "path", "page", "line", "selector", "snippet", content_words(F.col("snippet")).alias("words"))
    own = near(asked, shown, drift, kept).withColumn("how", F.lit(1))
    moved = asked.where(F.col("page").isNotNull()).join(shown.drop("a_line"), ["sc", "path"])
    same = (F.coalesce("selector", F.lit("")) != "") & F.coalesce(F.col("selector") == F.col("e_selector"), F.lit(False))
    alike = (_overlap(F.col("words"), F.col("e_words")) > 0) & _recognisable()
    moved = moved.where(same | alike).withColumn("how", F.lit(2))
    elsewhere = file.siblings.select("sc", "cls", canonical_file(F.col("file"), file.folder).alias("path"), F.col("line").alias("a_line")).distinct()
    met = near(asked, elsewhere, drift, ["cls"]).drop("a_line").dropDuplicates(["at", "cls"])
    sibling = met.join(shown.drop("path", "a_line"), ["sc", "cls"]).withColumn("how", F.lit(3))
    score = _overlap(F.col("words"), F.col("e_words")) + _overlap(F.col("words"), F.col("n_words"))
    every = own.drop("a_line").unionByName(moved).unionByName(sibling)
    rank = F.struct(F.col("how"), (-score).alias("score"), F.col("cls"), F.col("e_file"), F.col("e_line"), F.col("e_selector"), F.col("e_snippet"))
    best = F.min_by(F.struct("how", "e_file", "e_line", "e_selector", "e_snippet", "alike"), rank).alias("best")
    found = every.withColumn("alike", _recognisable()).groupBy("at").agg(best, F.bool_or(F.col("how") != 2).alias("close"))
    return found.select("at", "close", "best.*")


# --- grounding


def _nfkc(batches: Iterator) -> Iterator:
    import unicodedata

    import pyarrow as pa

    for batch in batches:
        text = [None if t is None else unicodedata.normalize("NFKC", t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(text, pa.string())], ["key", "text"])


def loose(text: Column) -> Column:
    """Text as citations are compared: plain quotes, single spaces, none beside brackets of markup."""
    quotes = F.translate(text, "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(quotes, "[\\s\\u00a0]+", " "), "> ", ">"), " <", "<"))


def compatible(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with compatibility forms of characters made one (NFKC); only texts that are not plain ASCII visit Python."""
    pair = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    plain = F.coalesce(F.octet_length("text") == F.char_length("text"), F.lit(True))
    kind = pair.schema["key"].dataType.simpleString()
    out = pair.where(plain).unionByName(pair.where(~plain).mapInArrow(_nfkc, f"key {kind}, text string"))
    return out.select(F.col("key").alias(key), F.col("text").alias(text))


def _probes(selector: Column) -> tuple[Column, Column]:
    """What a selector implies of the markup: (in any case: tags and attribute names, as written: ids and classes)."""
    said = F.when(F.lower(F.trim(selector)) == "handler", "").otherwise(F.coalesce(selector, F.lit("")))
    tags = F.transform(F.regexp_extract_all(said, F.lit("(?:^|[\\s>+~,])([a-zA-Z][\\w-]*)"), F.lit(1)), lambda t: F.concat(F.lit("<"), F.lower(t)))
    attributes = F.transform(F.regexp_extract_all(said, F.lit("\\[([\\w-]+)"), F.lit(1)), F.lower)
    return F.concat(tags, attributes), F.regexp_extract_all(said, F.lit("[#.]([\\w-]+)"), F.lit(1))


def ground(places: DataFrame, sources: DataFrame, window: int = 10) -> DataFrame:
    """(at, state) of places (at, file, line, selector, snippet): what stands where they say.

    found within ``window`` lines, moved elsewhere in the file, no-snippet, no-selector, out-of-range or no-file. Places
    without a file to open (streams, addresses) are found.
    """
    cited = compatible(places.where(F.col("snippet").isNotNull()), "at", "snippet")
    rows = places.drop("snippet").join(cited, "at", "left").join(compatible(sources, "file", "source"), "file", "left")
    rows = rows.withColumn("lines", F.split("source", "\n"))
    low = F.greatest(F.col("line") - window, F.lit(1))
    around = F.array_join(F.slice("lines", low, F.least(F.col("line") + window, F.size("lines")) - low + 1), "\n")
    here = F.when(F.col("line") > F.size("lines"), "").when(F.col("line") >= 1, around).otherwise(F.col("source"))
    rows = rows.select("at", "file", "line", "source", F.size("lines").alias("n"), loose(F.col("snippet")).alias("quoted"), loose(here).alias("here"), loose(F.col("source")).alias("whole"), *[p.alias(n) for p, n in zip(_probes(F.col("selector")), ("folded", "exact"), strict=True)])
    holds = lambda text: F.exists("folded", lambda p: F.contains(F.lower(text), p)) | F.exists("exact", lambda p: F.contains(text, p))
    nowhere = F.coalesce(F.col("file"), F.lit("")).isin("", "-", "stdin", "<stdin>") | F.coalesce(F.col("file").rlike("^[a-z][a-z0-9+.-]*://"), F.lit(False))
    quotes = F.coalesce(F.col("quoted"), F.lit("")) != ""
    state = (
        F.when(nowhere, "found")
        .when(F.col("source").isNull(), "no-file")
        .when(F.coalesce(F.col("line"), F.lit(0)) > F.col("n"), "out-of-range")
        .when(quotes & F.contains("here", "quoted"), "found")
        .when(quotes & F.contains("whole", "quoted"), "moved")
        .when(quotes, "no-snippet")
        .when((F.size("folded") + F.size("exact")) == 0, "found")
        .when(holds(F.col("here")), "found")
        .when(holds(F.col("whole")), "moved")
        .otherwise("no-selector")
    )
    return rows.select("at", state.alias("state"))


# --- the contract


def presupposed(criteria: DataFrame) -> DataFrame:
    """(sc, presupposed): the one mechanical neighbour whose subject a judged criterion takes for granted.

    ``criteria``: sc, theme, wcag (list of success criteria), mechanical. Neighbours share the theme and at least one success criterion; the
    closest shares most, and a tie presupposes nothing.
    """
    rows = criteria.select("sc", "theme", "mechanical", F.explode(F.array_distinct("wcag")).alias("w"))
    ours, theirs = rows.where("not mechanical"), rows.where("mechanical").select("theme", "w", F.col("sc").alias("presupposed"))
    shared = ours.join(theirs, ["theme", "w"]).groupBy("sc", "presupposed").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("sc").orderBy(F.desc("n"))
    first = shared.withColumn("place", F.row_number().over(order)).withColumn("tied", F.lead("n").over(order) == F.col("n"))
    return first.where((F.col("place") == 1) & ~F.coalesce("tied", F.lit(False))).select("sc", "presupposed")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def _found(rows: DataFrame, at: Column | None, *checks: tuple[str, Column]) -> DataFrame:
    """(sc, violation, place): all checks of a row in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks]))
    return rows.select("sc", F.explode(broken).alias("violation"), (at if at is not None else F.lit(None).cast("string")).alias("place"))


def _place() -> Column:
    return F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")))


def _tallies(file: VerdictFile) -> DataFrame:
    """Per criterion what the tables hold of it, in one shuffle: items, opened, complete, shown, captured, cited, claimed, expected, always."""
    yes = F.lit(True)
    parts = [
        file.verdicts.select("sc", F.lit("item").alias("kind"), yes.alias("flag")),
        file.open_criteria.select("sc", F.lit("open"), F.coalesce("complete", yes)),
        file.evidence.select("sc", F.lit("shown"), snapshot_id(F.col("file"), file.folder).isNotNull()),
        file.citations.select("sc", F.lit("cited"), yes),
        file.claims.select("sc", F.lit("claimed"), yes),
    ]
    parts += [t.select("sc", F.lit(kind), yes) for t, kind in ((file.expected, "expected"), (file.always, "always")) if t is not None]
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return reduce(DataFrame.union, parts).groupBy("sc").agg(
        n("item").alias("items"), (n("open") > 0).alias("opened"), F.bool_and(F.when(F.col("kind") == "open", F.col("flag"))).alias("complete"), n("shown").alias("shown"),
        F.bool_or((F.col("kind") == "shown") & F.col("flag")).alias("captured"), n("cited").alias("cited"), n("claimed").alias("claimed"), (n("expected") > 0).alias("expected"), (n("always") > 0).alias("always"),
    )


def violations(file: VerdictFile, drift: int = 10) -> DataFrame:
    """(sc, violation, place): distinct; ``place`` is the cited file:line where one is at fault."""
    given = file.verdicts.select("sc", canonical(F.col("verdict"), VERDICTS).alias("verdict"), "justification", "decided_by", "auditor", canonical(F.col("reason"), REASONS).alias("reason"))
    facts = materialize(_tallies(file).join(given, "sc", "left"), "verdict-facts")
    verdict, by, opened = F.col("verdict"), F.col("decided_by"), F.col("opened")
    item = opened & (F.col("items") > 0)
    clearing = verdict.isin("C", "NA")
    manual = verdict == "manual"
    of_items = _found(
        facts, None,
        ("missing", opened & (F.col("items") == 0) & ~F.col("expected")),
        ("duplicate", F.col("items") > 1),
        ("not-open", ~opened & (F.col("items") > 0)),
        ("decided-by", item & by.isNotNull() & ~by.isin(*AUTHORS)),
        ("auditor", item & (by == "human") & _blank("auditor")),
        ("no-verdict", item & verdict.isNull()),
        ("unknown-verdict", item & ~verdict.isin(*VERDICTS)),
        ("justification", item & clearing & _blank("justification")),
        ("always-applicable", item & (verdict == "NA") & F.col("always")),
        ("incomplete-evidence", item & (verdict == "C") & ~F.col("complete")),
        ("no-evidence", item & (verdict == "C") & (F.col("shown") == 0)),
        ("uncited", item & clearing & (F.col("shown") > 0) & (F.col("cited") == 0)),
        ("no-finding", item & (verdict == "NC") & (F.col("claimed") == 0)),
        ("reason", item & manual & ~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))),
        ("already-rendered", item & manual & (F.col("reason") == "needs-rendered-dom") & F.col("captured")),
    )
    # A clearing verdict without evidence is refused as such; its citations are not looked at.
    looked_at = facts.where(item).groupBy("sc").agg(F.bool_or(clearing & (F.col("shown") > 0)).alias("citation"), F.bool_or(verdict == "NC").alias("claim"))
    none = F.lit(None).cast("string")
    told = lambda rows, kind, ref=none: rows.select("sc", F.lit(kind).alias("kind"), "file", "line", "selector", "snippet", ref.alias("ref"))
    told_all = told(file.citations, "citation").unionByName(told(file.claims, "claim", F.trim(F.coalesce("ref", F.lit(""))))).unionByName(told(file.advice, "advice"))
    kind = F.col("kind")
    told_all = materialize(told_all.join(looked_at, "sc").where((kind == "advice") | (F.col("citation") & (kind == "citation")) | (F.col("claim") & (kind == "claim"))).drop("citation", "claim"), "cited-places")
    nowhere = _blank("file") & (kind != "citation")
    allowed = file.tests.select("ref", *(["sc"] if file.own_tests else [])).distinct().withColumn("known", F.lit(True))
    claims = told_all.where(kind == "claim").join(allowed, [c for c in allowed.columns if c != "known"], "left")
    out = [
        of_items,
        _found(told_all, None, ("claim-without-file", nowhere & (kind == "claim")), ("advice-without-file", nowhere & (kind == "advice"))),
        _found(claims, _place(), ("claim-without-test", ~_blank("file") & (F.col("ref") == "")), ("foreign-test", ~_blank("file") & (F.col("ref") != "") & F.col("known").isNull())),
    ]
    if file.engine is not None and file.presupposed is not None:
        key = F.coalesce("selector", F.lit("")).alias("key")
        owned = file.presupposed.join(file.engine.select(F.col("sc").alias("presupposed"), "file", "line", key), "presupposed").select("sc", "file", "line", "key").distinct()
        out.append(_found(told_all.where(kind == "claim").withColumn("key", key).join(owned, ["sc", "file", "line", "key"], "left_semi"), _place(), ("presupposed", F.lit(True))))
    out.append(_unfounded(file, told_all.where(~nowhere).drop("ref"), drift))
    return reduce(DataFrame.unionByName, out).distinct()


def _unfounded(file: VerdictFile, told: DataFrame, drift: int) -> DataFrame:
    """Citations and claims outside what was shown and audited, and places where the file does not hold what they quote."""
    body = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("sc", "kind", "file", "line", "selector", "snippet")]
    key = F.sha2(F.concat_ws("\n", *[F.concat(F.length(b).cast("string"), b) for b in body]), 256)
    places = told.distinct().select(key.alias("at"), "*", canonical_file(F.col("file"), file.folder).alias("path"), snapshot_id(F.col("file"), file.folder).alias("page"))
    places = materialize(places, "places")
    judged = places.where("kind <> 'advice'")
    audited = file.sources.select(canonical_file(F.col("file"), file.folder).alias("path")).distinct().withColumn("audited", F.lit(True))
    rows = materialize(judged.join(anchored(judged, file, drift), "at", "left").join(audited, "path", "left"), "anchored")
    belongs = F.col("audited").isNotNull() | F.when(F.col("kind") == "claim", F.col("how").isNotNull()).otherwise(F.coalesce("close", F.lit(False)))
    outside = _found(rows, _place(), ("outside-evidence", ~belongs))
    # What the engine read at the anchor vouches for a retyped citation; another place of a class has no text of its own.
    own = (F.col("kind") == "claim") | (F.col("how") < 3)
    backing = rows.where("alike").select(
        F.concat(F.lit("+"), F.col("at")).alias("at"), F.when(own, F.col("e_file")).otherwise(F.col("file")).alias("file"), F.when(own, F.col("e_line")).otherwise(F.col("line")).alias("line"),
        F.coalesce("e_selector", "selector").alias("selector"), F.when(own, F.col("e_snippet")).alias("snippet"),
    )
    states = ground(places.select("at", "file", "line", "selector", "snippet").unionByName(backing), file.sources)
    good = states.where(F.col("state").isin("found", "moved")).select(F.ltrim(F.col("at"), F.lit("+")).alias("at")).distinct()
    return outside.unionByName(_found(places.join(good, "at", "left_anti"), _place(), ("ungrounded", F.lit(True))))
