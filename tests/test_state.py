"""The audit state: last versions, late and repeated ones, removals, replays, and tallies by difference against a plain model."""

import random
from collections import Counter

from lintel.operators.state import AuditState, latest_pages
from lintel.streaming.ingest import audit_stream, record_pages

ONLY = ["img-alt-missing", "blink-marquee"]
PAGES = "page_id long, html string, version long, removed boolean"


def html(images, blinks):
    return "<p>" + "<img src=a>" * images + "<blink>x</blink>" * blinks + "</p>"


def expected(batches):
    last = {}
    for number, rows in enumerate(batches):
        best = {}
        for page, images, blinks, version, removed in rows:
            version = number if version is None else version
            if page not in best or version > best[page][0]:
                best[page] = (version, number, None if removed else (images, blinks))
        for page, found in best.items():
            if page not in last or found[:2] > last[page][:2]:
                last[page] = found
    out = Counter()
    for page, (_, _, counts) in last.items():
        for rule, n in zip(ONLY, counts or (0, 0)):
            out[page, rule] += n
    return +out


def frame(spark, rows):
    return spark.createDataFrame([(p, html(i, b), v, r) for p, i, b, v, r in rows], PAGES)


def seen(state):
    return Counter((r["page_id"], r["rule_id"]) for r in state.findings().collect())


def tallied(state):
    return {r["rule_id"]: r["n"] for r in state.tallies().collect()}


def by_rule(found):
    out = Counter()
    for (_, rule), n in found.items():
        out[rule] += n
    return dict(out)


def test_batches_against_a_plain_model(spark, tmp_path):
    rnd = random.Random(4)
    batches = []
    for _ in range(4):
        rows = [(rnd.choice([None, *range(9)]), rnd.randint(0, 2), rnd.randint(0, 2), v, rnd.random() < 0.15) for v in rnd.sample(range(100), 7)]
        batches.append(rows)
    state = AuditState(spark, f"file://{tmp_path}/state", shards=3)
    assert seen(state) == Counter() and tallied(state) == {}
    for number, rows in enumerate(batches):
        record_pages(state, number, frame(spark, rows), ONLY)
        want = expected(batches[: number + 1])
        assert seen(state) == want
        assert tallied(state) == by_rule(want)
    # A batch that runs again, and one without pages, change nothing; neither does leaving out what was replaced.
    record_pages(state, 3, frame(spark, batches[3]), ONLY)
    record_pages(state, 4, frame(spark, []), ONLY)
    assert seen(state) == want and tallied(state) == by_rule(want)
    small = state.compacted(f"file://{tmp_path}/small")
    assert seen(small) == want and tallied(small) == by_rule(want)
    assert spark.read.parquet(small.folder).count() == sum(want.values()) < spark.read.parquet(state.folder).count()
    assert seen(state.compacted(f"file://{tmp_path}/again")) == want


def test_versions_default_to_the_batch(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, None), (2, "c")], "page_id long, html string")
    got = latest_pages(rows, 7).collect()
    assert sorted((r["page_id"] or 0, r["version"], r["removed"]) for r in got) == [(0, 7, False), (1, 7, False), (2, 7, False)]
    assert [r["html"] for r in latest_pages(rows.repartition(3), 7).collect() if r["page_id"] == 1] == [r["html"] for r in got if r["page_id"] == 1]


def test_stream_replaces_older_findings(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for page, images in ((1, 2), (2, 1), (1, 0), (2, 3)):
        spark.createDataFrame([(page, f"u{page}", html(images, 0))], "page_id long, url string, html string").write.mode("append").parquet(source)
        audit_stream(spark, source, sink, mark, ONLY).awaitTermination()
    state = AuditState(spark, sink)
    assert seen(state) == Counter({(2, "img-alt-missing"): 3}) and tallied(state) == {"img-alt-missing": 3}
    assert spark.read.parquet(sink).count() == 6
